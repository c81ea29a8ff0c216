"""Lead list, filters, ordering, detail and statistics."""

from pyspark.sql import functions as F

from catalog.registry import query
from firmloom.operators import leads as O

LEADS = """
  leads AS (
    SELECT c.id AS company_id, c.legal_name, c.trading_name, c.county, c.cro_status, c.incorporation_date,
           e.employee_band, e.qualification_score, e.generated_at, e.id AS eid,
           m.id IS NOT NULL AS has_draft, m.subject AS email_subject,
           r.reason AS rejection_reason, r.guard_score AS rejection_guard_score
    FROM $companies c
    LEFT JOIN $enrichment e ON e.company_id = c.id AND e.generated_at = (
        SELECT max(x.generated_at) FROM $enrichment x WHERE x.company_id = c.id)
    LEFT JOIN $emails m ON m.company_id = c.id AND m.status = 'draft'
    LEFT JOIN $rejections r ON r.company_id = c.id)
"""
COLUMNS = [
    "company_id", "legal_name", "county", "cro_status", "employee_band", "qualification_score",
    "has_draft", "email_subject", "rejection_reason", "rejection_guard_score",
]
LIST = ", ".join(COLUMNS)


def leads(v):
    return O.lead_list(v.companies, v.enrichment, v.emails, v.rejections)


@query("lead_list", f"WITH {LEADS} SELECT {LIST} FROM leads")
def _(v):
    return leads(v).select(*COLUMNS)


@query("lead_filter", f"""WITH {LEADS} SELECT {LIST} FROM leads
    WHERE lower(county) = lower('Nation_3') AND qualification_score BETWEEN 10 AND 90 AND lower(cro_status) = 'normal'""")
def _(v):
    kept = O.lead_filter(leads(v), county="NATION_3", min_score=10, max_score=90, status="normal", needs_review=True)
    return kept.select(*COLUMNS)


@query("lead_search", f"""WITH {LEADS} SELECT {LIST} FROM leads
    WHERE contains(lower(coalesce(legal_name, '')), 'building') OR contains(lower(coalesce(trading_name, '')), 'building')
       OR contains(lower(coalesce(county, '')), 'building')""")
def _(v):
    return leads(v).filter(O.lead_search(" Building")).select(*COLUMNS)


@query("lead_status_filter", f"""WITH {LEADS}
    SELECT 'qualified' AS status, company_id, qualification_score FROM leads WHERE qualification_score IS NOT NULL
    UNION ALL SELECT 'with_email', company_id, qualification_score FROM leads WHERE has_draft
    UNION ALL SELECT 'pending', company_id, qualification_score FROM leads WHERE qualification_score IS NULL
    UNION ALL SELECT 'needs_review', company_id, qualification_score FROM leads WHERE lower(trim(coalesce(cro_status, ''))) <> 'normal'""")
def _(v):
    names = ["qualified", "with_email", "pending", "needs_review"]
    hit = F.array_compact(F.array(*[F.when(O.status_filter(n), F.lit(n)) for n in names]))
    return leads(v).select(F.explode(hit).alias("status"), "company_id", "qualification_score")


AS_OF = "1999-06-15 00:00:00"


@query("lead_assessed_age", f"""WITH {LEADS}, aged AS (
      SELECT company_id, eid, date_diff('second', generated_at, TIMESTAMP '{AS_OF}') AS age FROM leads WHERE generated_at IS NOT NULL)
    SELECT '24h' AS age_window, company_id, count(*) AS n FROM aged WHERE age <= 86400 GROUP BY company_id
    UNION ALL SELECT '7d', company_id, count(*) FROM aged WHERE age <= 604800 GROUP BY company_id
    UNION ALL SELECT '30d', company_id, count(*) FROM aged WHERE age <= 2592000 GROUP BY company_id
    UNION ALL SELECT 'older', company_id, count(*) FROM aged WHERE age > 2592000 GROUP BY company_id""")
def _(v):
    as_of = F.lit(AS_OF).cast("timestamp")
    hit = F.array_compact(F.array(*[F.when(O.assessed_age(w, as_of), F.lit(w)) for w in ("24h", "7d", "30d", "older")]))
    return (
        leads(v).select(F.explode(hit).alias("age_window"), "company_id")
        .groupBy("age_window", "company_id").agg(F.count(F.lit(1)).alias("n"))
    )


@query("lead_bracket_filter", f"""WITH {LEADS}, marked AS (
      SELECT *, lower(trim(coalesce(cro_status, ''))) IN ('normal', '') AS active FROM leads)
    SELECT 'strong' AS bracket, company_id, qualification_score FROM marked WHERE active AND qualification_score >= 70
    UNION ALL SELECT 'moderate', company_id, qualification_score FROM marked WHERE active AND qualification_score BETWEEN 40 AND 69
    UNION ALL SELECT 'lower', company_id, qualification_score FROM marked WHERE active AND qualification_score BETWEEN 1 AND 39
    UNION ALL SELECT 'review', company_id, qualification_score FROM marked WHERE NOT active""")
def _(v):
    names = ["strong", "moderate", "lower", "review"]
    hit = F.array_compact(F.array(*[F.when(O.bracket_filter(n), F.lit(n)) for n in names]))
    return leads(v).select(F.explode(hit).alias("bracket"), "company_id", "qualification_score")


@query("email_preflight", """
    WITH per AS (SELECT company_id, count(*) AS contacts FROM $contact_rows GROUP BY company_id),
    best AS (SELECT company_id, max(guard_score) AS confidence FROM $enrichment GROUP BY company_id)
    SELECT c.id AS company_id,
      CASE WHEN b.company_id IS NULL THEN 'no assessment'
           WHEN coalesce(b.confidence, 0) < 50 AND c.trading_name IS NULL AND coalesce(p.contacts, 0) = 0
           THEN 'low confidence, no website, no contacts' END AS skip_reason
    FROM $companies c LEFT JOIN per p ON p.company_id = c.id LEFT JOIN best b ON b.company_id = c.id""")
def _(v):
    per = v.contact_rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("contacts"))
    best = v.enrichment.groupBy("company_id").agg(F.max("guard_score").alias("confidence")).withColumn("assessed", F.lit(True))
    firms = v.companies.withColumnRenamed("id", "company_id").join(per, "company_id", "left").join(best, "company_id", "left")
    why = O.email_preflight(F.col("assessed"), F.col("confidence"), F.col("trading_name").isNotNull(), F.col("contacts"))
    return firms.select("company_id", why.alias("skip_reason"))


@query("unenriched", """SELECT id AS company_id, legal_name, county FROM $companies c
    WHERE lower(cro_status) = 'normal' AND NOT EXISTS (SELECT 1 FROM $enrichment e WHERE e.company_id = c.id)""")
def _(v):
    return O.unenriched(v.companies, v.enrichment).select(F.col("id").alias("company_id"), "legal_name", "county")


@query("assessed_without_email", """
    SELECT c.id AS company_id, c.legal_name, c.county, e.id AS enrichment_id, e.qualification_score
    FROM $enrichment e JOIN $companies c ON c.id = e.company_id
    WHERE NOT EXISTS (SELECT 1 FROM $emails m WHERE m.company_id = c.id AND m.status = 'draft')""")
def _(v):
    return O.assessed_without_email(v.companies, v.enrichment, v.emails)


@query("top_opportunities", """
    SELECT e.company_id, c.legal_name, c.county, e.id AS enrichment_id, e.qualification_score,
           EXISTS (SELECT 1 FROM $emails m WHERE m.company_id = c.id) AS has_email
    FROM $enrichment e JOIN $companies c ON c.id = e.company_id WHERE e.qualification_score IS NOT NULL
    ORDER BY e.qualification_score DESC, e.company_id, e.id LIMIT 5""")
def _(v):
    return O.top_opportunities(v.companies, v.enrichment, v.emails)


@query("lead_detail", """
    WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY generated_at DESC, id DESC) AS n FROM $enrichment) x WHERE n = 1),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY generated_at DESC, id DESC) AS n FROM $emails WHERE status = 'draft') x WHERE n = 1),
    k AS (SELECT company_id, count(*) AS contact_count FROM $contact_rows GROUP BY company_id)
    SELECT c.id AS company_id, c.legal_name, e.id AS enrichment_id, e.qualification_score,
           e.narrative_assessment ->> '$.executive_summary' AS executive_summary,
           m.subject, r.reason, coalesce(k.contact_count, 0) AS contact_count
    FROM $companies c LEFT JOIN e ON e.company_id = c.id LEFT JOIN m ON m.company_id = c.id
    LEFT JOIN $rejections r ON r.company_id = c.id LEFT JOIN k ON k.company_id = c.id""")
def _(v):
    detail = O.lead_detail(v.companies, v.enrichment, v.emails, v.contact_rows, v.rejections)
    return detail.select(
        "company_id", "legal_name", F.col("assessment.id").alias("enrichment_id"), "assessment.qualification_score",
        F.get_json_object("assessment.narrative_assessment", "$.executive_summary").alias("executive_summary"),
        "draft.subject", "rejection.reason", "contact_count",
    )


@query("lead_contacts", """SELECT k.company_id, c.legal_name, k.full_name, k.role_title, k.ordinal
    FROM $contact_rows k JOIN $companies c ON c.id = k.company_id""")
def _(v):
    return O.lead_contacts(v.companies, v.contact_rows).select("company_id", "legal_name", "full_name", "role_title", "ordinal")


for key in O.SORT_KEYS:
    for direction in ("asc", "desc"):
        value = {
            "score": "qualification_score", "name": "lower(legal_name)", "county": "lower(county)", "status": "lower(cro_status)",
            "incorporated": "incorporation_date",
            "size": "CASE employee_band WHEN '1-10' THEN 1 WHEN '11-50' THEN 2 WHEN '51-200' THEN 3 WHEN '200+' THEN 4 ELSE 0 END",
        }[key]

        @query(f"lead_page_by_{key}_{direction}", f"""WITH {LEADS}
            SELECT company_id, legal_name, qualification_score FROM leads
            ORDER BY {value} {direction} NULLS LAST, legal_name ASC, company_id ASC, qualification_score LIMIT 50 OFFSET 25""")
        def _(v, key=key, direction=direction):
            order = [*O.lead_sort(key, direction), F.col("qualification_score").asc_nulls_last()]
            return O.page(leads(v), order, 50, 25).select("company_id", "legal_name", "qualification_score")


@query("lead_page_deep", f"""WITH {LEADS}
    SELECT company_id, legal_name, qualification_score FROM leads
    QUALIFY row_number() OVER (ORDER BY qualification_score DESC NULLS LAST, legal_name, company_id)
            BETWEEN (SELECT count(*) // 2 FROM leads) + 1 AND (SELECT count(*) // 2 FROM leads) + 50""")
def _(v):
    rows = leads(v)
    return O.page(rows, O.lead_sort("score", "desc"), 50, rows.count() // 2).select("company_id", "legal_name", "qualification_score")


@query("list_sort_nulls_low", f"""WITH {LEADS}
    SELECT company_id, qualification_score FROM leads ORDER BY qualification_score ASC NULLS FIRST, company_id LIMIT 100""")
def _(v):
    return O.page(leads(v), O.list_sort("score", "asc"), 100).select("company_id", "qualification_score")


STATS = """
  SELECT c.total, s.*, d.outreach_drafts,
         assessed - strong - moderate - lower AS needs_review, total - assessed AS awaiting
  FROM (SELECT count(*) AS total FROM $companies) c, (SELECT count(qualification_score) AS assessed,
               count(*) FILTER (WHERE qualification_score >= 70) AS strong,
               count(*) FILTER (WHERE qualification_score BETWEEN 40 AND 69) AS moderate,
               count(*) FILTER (WHERE qualification_score BETWEEN 1 AND 39) AS lower,
               round(avg(qualification_score), 1) AS avg_score FROM $enrichment) s,
       (SELECT count(*) FILTER (WHERE status = 'draft') AS outreach_drafts FROM $emails) d
"""


@query("pipeline_stats", STATS)
def _(v):
    return O.pipeline_stats(v.companies, v.enrichment, v.emails)


@query("pipeline_segments", f"""WITH st AS ({STATS})
    SELECT segment, firms, CASE WHEN total > 0 THEN round(100.0 * firms / total, 1) ELSE 0.0 END AS share_pct FROM (
      SELECT 'strong' AS segment, strong AS firms, total FROM st UNION ALL SELECT 'moderate', moderate, total FROM st
      UNION ALL SELECT 'lower', lower, total FROM st UNION ALL SELECT 'needs_review', needs_review, total FROM st
      UNION ALL SELECT 'awaiting', awaiting, total FROM st) x""")
def _(v):
    return O.pipeline_segments(O.pipeline_stats(v.companies, v.enrichment, v.emails))


@query("score_distribution", """SELECT CASE WHEN coalesce(qualification_score, 0) = 0 THEN 'No Score'
      WHEN qualification_score >= 70 THEN 'High (70-100)' WHEN qualification_score >= 40 THEN 'Medium (40-69)' ELSE 'Low (1-39)' END AS bracket,
      count(*) AS firms FROM $enrichment GROUP BY 1""")
def _(v):
    return O.score_distribution(v.enrichment)


@query("guard_stats", """SELECT total, passed, total - passed AS failed, avg_score, round(100.0 * passed / total, 1) AS pass_rate FROM (
    SELECT count(*) AS total, count(*) FILTER (WHERE guard_passed) AS passed, round(avg(guard_score), 1) AS avg_score
    FROM $enrichment WHERE guard_passed IS NOT NULL) g""")
def _(v):
    return O.guard_stats(v.enrichment)


@query("lead_count", """SELECT count(*) AS leads FROM $companies c LEFT JOIN $enrichment e ON e.company_id = c.id
    WHERE lower(c.cro_status) = 'normal' AND e.qualification_score >= 20""")
def _(v):
    return O.lead_count(v.companies, v.enrichment, status="Normal", min_score=20)


@query("county_options", "SELECT DISTINCT county FROM $companies WHERE county <> ''")
def _(v):
    return O.county_options(v.companies)


@query("batch_outcomes", """SELECT CAST(NULL AS VARCHAR) AS error, count(*) AS attempted, count(*) FILTER (WHERE status = 'enriched') AS enriched,
    count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'failed') AS failed FROM $outcomes""")
def _(v):
    return O.batch_outcomes(v.outcomes)


@query("batch_errors", "SELECT ordinal, company_id, status FROM $outcomes WHERE status <> 'enriched'")
def _(v):
    return O.batch_errors(v.outcomes).select("ordinal", "company_id", "status")


@query("cost_by_model", "SELECT model, count(*) AS calls, CAST(sum(cost) AS BIGINT) AS cost FROM $model_calls GROUP BY model")
def _(v):
    return O.cost_by_model(v.model_calls)


def _confident(name, level):
    return F.struct(name.alias("name"), F.struct(F.struct(level.alias("level")).alias("overall")).alias("confidence"))


def contact_arrays(v):
    """Documents as firms with three contacts each, levels from their columns."""
    level = F.when(F.col("lang") == "en", "High").when(F.col("lang") == "fr", "medium").otherwise("low")
    other = F.when(F.col("n_chars") > 500, "high").otherwise(F.lit("none"))
    contacts = F.array(
        _confident(F.concat(F.lit("a-"), F.col("source")), other), _confident(F.lit("b"), level),
        _confident(F.when(F.col("lang") != "de", F.lit("c")), F.lit("medium")),
    )
    return v.documents.select("doc_id", "lang", "source", "n_chars", contacts.alias("contacts"))


@query("rank_contacts", """
    SELECT doc_id, string_agg(name, ',' ORDER BY r DESC, pos) AS ranked FROM (
      SELECT doc_id, 1 AS pos, 'a-' || source AS name, CASE WHEN n_chars > 500 THEN 3 ELSE 0 END AS r FROM $documents
      UNION ALL SELECT doc_id, 2, 'b', CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END FROM $documents
      UNION ALL SELECT doc_id, 3, CASE WHEN lang = 'de' THEN '?' ELSE 'c' END, 2 FROM $documents) x GROUP BY doc_id""")
def _(v):
    names = F.transform(O.rank_contacts(F.col("contacts")), lambda c: F.coalesce(c["name"], F.lit("?")))
    return contact_arrays(v).select("doc_id", F.array_join(names, ",").alias("ranked"))


@query("choose_contacts", """SELECT doc_id, CASE WHEN lang = 'de' THEN 'extracted' ELSE 'a-' || source END AS first_name FROM $documents""")
def _(v):
    extracted = F.array(_confident(F.lit("extracted"), F.lit("low")))
    chosen = O.choose_contacts(F.col("contacts"), extracted)
    return contact_arrays(v).select("doc_id", F.get(chosen, 0)["name"].alias("first_name"))


@query("contact_counts", """SELECT doc_id AS company_id,
    CASE WHEN n_chars > 500 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS high_confidence, 3 AS kept, 0 AS dropped FROM $documents""")
def _(v):
    firms = contact_arrays(v).select(F.col("doc_id").alias("company_id"), F.col("contacts").alias("kept"), F.slice("contacts", 1, 0).alias("dropped"))
    return O.contact_counts(firms)
