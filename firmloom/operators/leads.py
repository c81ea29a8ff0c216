"""Lead queries: list, filters, ordering, detail, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmloom.functions.text import col
from firmloom.session import cut

STRONG, MODERATE = 70, 40
SIZE_RANK = {"1-10": 1, "11-50": 2, "51-200": 3, "200+": 4}
ASSESSMENT_COLUMNS = [
    "employee_band", "recommended_angle", "qualification_score", "signal_strength",
    "guard_passed", "guard_score", "guard_failures", "generated_at",
]


# --- Joins -----------------------------------------------------------------

def latest_per_company(rows: DataFrame, at: str = "generated_at") -> DataFrame:
    """Rows carrying the newest `at` of their company; equal newest rows all stay.

    `rank() = 1` lets Spark drop older rows before the shuffle.
    """
    newest = Window.partitionBy("company_id").orderBy(F.col(at).desc())
    return (
        rows.filter(F.col(at).isNotNull())
        .withColumn("__rank", F.rank().over(newest)).filter("__rank = 1").drop("__rank")
    )


def _pick(rows: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    present = [c for c in columns if c in rows.columns]
    return rows.select("company_id", *[F.col(c).alias(prefix + c) for c in present])


def lead_list(
    companies: DataFrame, enrichment: DataFrame, emails: DataFrame, rejections: DataFrame
) -> DataFrame:
    """Companies with their newest assessment, draft email and rejection."""
    assessed = _pick(latest_per_company(enrichment), ASSESSMENT_COLUMNS)
    drafts = _pick(emails.filter("status = 'draft'"), ["subject", "body"], "email_")
    refused = _pick(rejections, ["reason", "guard_failures", "guard_score", "rejected_at"], "rejection_")
    leads = companies.withColumnRenamed("id", "company_id")
    for side in (assessed, drafts.withColumn("has_draft", F.lit(True)), refused):
        leads = leads.join(side, "company_id", "left")
    return leads.withColumn("has_draft", F.coalesce("has_draft", F.lit(False)))


def unenriched(companies: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Active companies without any assessment, oldest first."""
    todo = companies.join(
        enrichment.select(F.col("company_id").alias("id")), "id", "left_anti"
    ).filter(F.lower("cro_status") == "normal")
    return todo.orderBy(F.col("ingested_at").asc_nulls_first(), "id")


def assessed_without_email(companies: DataFrame, enrichment: DataFrame, emails: DataFrame) -> DataFrame:
    """Assessments of companies that have no draft yet, best score first."""
    drafts = emails.filter("status = 'draft'").select("company_id")
    named = companies.select(F.col("id").alias("company_id"), "legal_name", "county")
    return (
        enrichment.join(drafts, "company_id", "left_anti").join(named, "company_id")
        .select("company_id", "legal_name", "county", F.col("id").alias("enrichment_id"), "qualification_score")
        .orderBy(F.col("qualification_score").desc_nulls_last(), "company_id", "enrichment_id")
    )


def top_opportunities(
    companies: DataFrame, enrichment: DataFrame, emails: DataFrame, n: int = 5
) -> DataFrame:
    """The n best-scored assessments, with whether an email exists."""
    mailed = emails.select("company_id").distinct().withColumn("has_email", F.lit(True))
    named = companies.select(F.col("id").alias("company_id"), "legal_name", "county")
    scored = enrichment.filter("qualification_score is not null")
    # Only n rows can appear: cut them before the joins look anything up.
    best = scored.join(named.select("company_id"), "company_id", "left_semi").orderBy(
        F.col("qualification_score").desc(), "company_id", "id"
    ).limit(n)
    return (
        F.broadcast(best).join(named, "company_id").join(mailed, "company_id", "left")
        .select(
            "company_id", "legal_name", "county", F.col("id").alias("enrichment_id"),
            "qualification_score", F.coalesce("has_email", F.lit(False)).alias("has_email"),
        )
        .orderBy(F.col("qualification_score").desc(), "company_id", "enrichment_id")
    )


def _newest(rows: DataFrame, at: str, columns: list[str], name: str) -> DataFrame:
    by = F.struct(F.col(at), F.col("id") if "id" in rows.columns else F.lit(0))
    return rows.groupBy("company_id").agg(F.max_by(F.struct(*columns), by).alias(name))


def lead_detail(
    companies: DataFrame, enrichment: DataFrame, emails: DataFrame, contacts: DataFrame, rejections: DataFrame
) -> DataFrame:
    """One row per company: newest assessment, newest draft, rejection, contact count.

    Every child is reduced with a partial aggregate before its join. The
    contacts themselves are `lead_contacts`, one row each: a company may have
    any number of them.
    """
    own = [c for c in enrichment.columns if c != "company_id"]
    counted = contacts.groupBy("company_id").agg(F.count(F.lit(1)).alias("contact_count"))
    drafts = emails.filter("status = 'draft'")
    detail = companies.withColumnRenamed("id", "company_id")
    for child in (
        _newest(enrichment, "generated_at", own, "assessment"),
        _newest(drafts, "generated_at", [c for c in emails.columns if c != "company_id"], "draft"),
        _newest(rejections, "rejected_at", [c for c in rejections.columns if c != "company_id"], "rejection"),
        counted,
    ):
        detail = detail.join(child, "company_id", "left")
    return detail.withColumn("contact_count", F.coalesce("contact_count", F.lit(0)))


def lead_contacts(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts of every company, the child rows of `lead_detail`."""
    return contacts.join(companies.select(F.col("id").alias("company_id"), "legal_name"), "company_id")


def choose_contacts(model: Column, extracted: Column, name: str = "name") -> Column:
    """The model's contacts when it gave some and each has a name, else the extracted ones."""
    named = F.forall(model, lambda c: F.trim(F.coalesce(c[name], F.lit(""))) != "")
    return F.when((F.size(model) > 0) & named, model).otherwise(extracted)


# --- Filters ---------------------------------------------------------------

def lead_filter(
    df: DataFrame,
    county: str | None = None,
    min_score: int | None = None,
    max_score: int | None = None,
    status: str | None = None,
    needs_review: bool | None = None,
) -> DataFrame:
    """Optional equality and range filters; an empty value filters nothing.

    `needs_review` is accepted and has no effect.
    """
    for column, value in (("county", county), ("cro_status", status)):
        if value:
            df = df.filter(F.lower(column) == value.lower())
    if min_score is not None:
        df = df.filter(F.col("qualification_score") >= min_score)
    if max_score is not None:
        df = df.filter(F.col("qualification_score") <= max_score)
    return df


def lead_search(q: str) -> Column:
    """Case-insensitive substring over legal name, trading name and county."""
    needle = q.strip().lower()
    parts = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle) for c in ("legal_name", "trading_name", "county")]
    return parts[0] | parts[1] | parts[2]


def status_filter(status: str) -> Column:
    score = F.col("qualification_score")
    registry = F.lower(F.trim(F.coalesce(F.col("cro_status"), F.lit(""))))
    return {
        "qualified": score.isNotNull(),
        "with_email": F.col("has_draft"),
        "pending": score.isNull(),
        "needs_review": registry != "normal",
    }[status]


def assessed_age(window: str, as_of: Column) -> Column:
    """Assessed within 24h, 7d or 30d of `as_of` (inclusive), or longer ago ("older")."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("generated_at").cast("timestamp"))
    day = 86_400
    within = {"24h": day, "7d": 7 * day, "30d": 30 * day}
    test = age > within["30d"] if window == "older" else age <= within[window]
    return F.coalesce(test, F.lit(False))


def bracket_filter(bracket: str) -> Column:
    score = F.col("qualification_score")
    registry = F.lower(F.trim(F.coalesce(F.col("cro_status"), F.lit(""))))
    active = registry.isin("normal", "")
    tests = {
        "strong": (score >= STRONG) & active,
        "moderate": score.between(MODERATE, STRONG - 1) & active,
        "lower": score.between(1, MODERATE - 1) & active,
        "review": ~active,
    }
    return F.coalesce(tests[bracket], F.lit(False))


def email_preflight(has_enrichment: Column, confidence: Column, has_website: Column, contacts: Column) -> Column:
    """Why an outreach email must not be written yet; NULL when it may."""
    weak = (F.coalesce(confidence, F.lit(0)) < 50) & ~F.coalesce(has_website, F.lit(False)) & (
        F.coalesce(contacts, F.lit(0)) == 0
    )
    return (
        F.when(~F.coalesce(has_enrichment, F.lit(False)), "no assessment")
        .when(weak, "low confidence, no website, no contacts")
    )


# --- Order -----------------------------------------------------------------

def _sort_key(key: str) -> Column:
    band = F.col("employee_band")
    size = F.lit(0)
    for label, rank in SIZE_RANK.items():
        size = F.when(band == label, rank).otherwise(size)
    return {
        "score": F.col("qualification_score"),
        "name": F.lower("legal_name"),
        "county": F.lower("county"),
        "status": F.lower("cro_status"),
        "incorporated": F.col("incorporation_date"),
        "size": size,
    }[key]


SORT_KEYS = ("score", "name", "county", "status", "incorporated", "size")


def lead_sort(key: str = "score", direction: str = "desc", strict: bool = False) -> list[Column]:
    """Sort columns: NULLs last both ways, then legal name, then id.

    An unknown key sorts by score, or raises when `strict`.
    """
    if key not in SORT_KEYS:
        if strict:
            raise ValueError(f"unknown sort key {key!r}")
        key = "score"
    value = _sort_key(key)
    first = value.asc_nulls_last() if direction.lower() == "asc" else value.desc_nulls_last()
    return [first, F.col("legal_name").asc(), F.col("company_id").asc()]


def list_sort(key: str, direction: str = "desc") -> list[Column]:
    """Sort columns that treat NULL as smaller than everything."""
    value = _sort_key(key)
    return [
        value.asc_nulls_first() if direction.lower() == "asc" else value.desc_nulls_last(),
        F.col("company_id").asc(),
    ]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows `offset` to `offset + limit` of the order.

    The first page is a top-k, cut in every task. A later one seeks: rows are dealt to ranges of the order, the
    ranges are counted, and only those that hold the page are read and numbered, so no task
    holds the rows before it. The order should tell rows apart, as `lead_sort` does.
    """
    if not offset:
        return df.orderBy(*order).limit(limit)
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dict(map(tuple, dealt.groupBy("__range").count().collect()))  # one number a range
    start, held = 0, []
    for number in sorted(sizes):
        if start < offset + limit and start + sizes[number] > offset:
            held.append((number, start))
        start += sizes[number]
    if not held:
        return df.limit(0)
    before = F.create_map(*[F.lit(x) for pair in held for x in pair])
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.element_at(before, F.col("__range"))
    return (
        dealt.filter(F.col("__range").isin([n for n, _ in held])).withColumn("__place", place)
        .filter((F.col("__place") > offset) & (F.col("__place") <= offset + limit)).orderBy("__place")
        .drop("__place", "__range")
    )


LEVEL_RANK = {"high": 3, "medium": 2, "low": 1}


def rank_contacts(contacts: Column) -> Column:
    """Contacts by overall confidence, high first; equal ones keep their order."""
    def keyed(c: Column, at: Column) -> Column:
        level = F.lower(c["confidence"]["overall"]["level"])
        rank = F.lit(0)
        for name, value in LEVEL_RANK.items():
            rank = F.when(level == name, value).otherwise(rank)
        return F.struct((-rank).alias("rank"), at.alias("at"), c.alias("contact"))

    ordered = F.array_sort(
        F.transform(contacts, keyed),
        lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["at"] - b["at"]),
    )
    return F.transform(ordered, lambda s: s["contact"])


# --- Aggregates ------------------------------------------------------------

def pipeline_stats(companies: DataFrame, enrichment: DataFrame, emails: DataFrame) -> DataFrame:
    score = F.col("qualification_score")
    total = companies.agg(F.count(F.lit(1)).alias("total"))
    scores = enrichment.agg(
        F.count(score).alias("assessed"),
        F.count_if(score >= STRONG).alias("strong"),
        F.count_if(score.between(MODERATE, STRONG - 1)).alias("moderate"),
        F.count_if(score.between(1, MODERATE - 1)).alias("lower"),
        F.round(F.avg(score), 1).alias("avg_score"),
    )
    drafts = emails.agg(F.count_if(F.col("status") == "draft").alias("outreach_drafts"))
    # Three one-row frames, laid over each other.
    rows = total
    for frame in (scores, drafts):
        rows = rows.unionByName(frame, allowMissingColumns=True)
    stats = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return stats.withColumns({
        "needs_review": F.col("assessed") - F.col("strong") - F.col("moderate") - F.col("lower"),
        "awaiting": F.col("total") - F.col("assessed"),
    })


def pipeline_segments(stats: DataFrame) -> DataFrame:
    """The five segments of `pipeline_stats`, with their share of all companies."""
    names = ["strong", "moderate", "lower", "needs_review", "awaiting"]
    pairs = F.array(*[F.struct(F.lit(n).alias("segment"), F.col(n).alias("firms")) for n in names])
    share = F.when(F.col("total") > 0, F.round(100.0 * F.col("s.firms") / F.col("total"), 1)).otherwise(0.0)
    return stats.select("total", F.explode(pairs).alias("s")).select(
        "s.segment", "s.firms", share.alias("share_pct")
    )


def score_bracket(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(F.coalesce(s, F.lit(0)) < 1, "No Score")
        .when(s >= STRONG, "High (70-100)")
        .when(s >= MODERATE, "Medium (40-69)")
        .otherwise("Low (1-39)")
    )


def score_distribution(enrichment: DataFrame) -> DataFrame:
    bracket = score_bracket("qualification_score").alias("bracket")
    return enrichment.groupBy(bracket).agg(F.count(F.lit(1)).alias("firms")).orderBy("bracket")


def guard_stats(enrichment: DataFrame) -> DataFrame:
    """Guard verdict totals; rows whose guards were skipped do not count."""
    passed = F.col("guard_passed")
    return (
        enrichment.filter(passed.isNotNull())
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(passed).alias("passed"),
            F.count_if(~passed).alias("failed"),
            F.round(F.avg("guard_score"), 1).alias("avg_score"),
        )
        .withColumn(
            "pass_rate",
            F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 1)).otherwise(0.0),
        )
    )


def lead_count(companies: DataFrame, enrichment: DataFrame, **filters) -> DataFrame:
    """Rows of companies joined to all their assessments, after `lead_filter`."""
    scores = enrichment.select("company_id", "qualification_score")
    joined = companies.withColumnRenamed("id", "company_id").join(scores, "company_id", "left")
    return lead_filter(joined, **filters).agg(F.count(F.lit(1)).alias("leads"))


def county_options(companies: DataFrame) -> DataFrame:
    return companies.filter("county <> ''").select("county").distinct().orderBy("county")


def batch_outcomes(outcomes: DataFrame) -> DataFrame:
    """Totals of one bulk run; a rate-limited row turns the summary into an error."""
    count = lambda c: F.count_if(c)
    status = F.col("status")
    counted = outcomes.agg(
        F.count(F.lit(1)).alias("attempted"),
        count(status == "enriched").alias("enriched"),
        count(status == "rejected").alias("rejected"),
        count(F.coalesce(F.col("rate_limited"), F.lit(False))).alias("limited"),
    )
    limited = F.col("limited") > 0
    keep = lambda c: F.when(~limited, c)
    return counted.select(
        F.when(limited, "rate limited").alias("error"),
        keep(F.col("attempted")).alias("attempted"),
        keep(F.col("enriched")).alias("enriched"),
        keep(F.col("rejected")).alias("rejected"),
        keep(F.col("attempted") - F.col("enriched") - F.col("rejected")).alias("failed"),
    )


def batch_errors(outcomes: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of a bulk run that were not stored; with `n` the first of them in run order."""
    failed = outcomes.filter(F.col("status") != "enriched")
    return failed if n is None else failed.orderBy("ordinal").limit(n)


def cost_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))


def ingest_counts(resolved: DataFrame) -> DataFrame:
    """Records found, new, matched and needing review of one ingestion."""
    return resolved.agg(
        F.count(F.lit(1)).alias("records_found"),
        F.count_if("is_new").alias("records_new"),
        F.count_if(~F.col("needs_review")).alias("matched"),
        F.count_if("needs_review").alias("needs_review"),
    )


def contact_counts(firms: DataFrame, kept: str = "kept", dropped: str = "dropped") -> DataFrame:
    """High-confidence and dropped contacts per firm."""
    high = F.filter(F.col(kept), lambda c: F.lower(c["confidence"]["overall"]["level"]) == "high")
    return firms.select(
        "company_id",
        F.size(high).alias("high_confidence"),
        F.size(F.col(kept)).alias("kept"),
        F.size(F.col(dropped)).alias("dropped"),
    )
