"""Quality guards over assessments, schema rules, email check, storage routing.

An assessment is a row with the columns of `ASSESSMENT`. A guard is a
(id, name, build) triple whose `build()` returns a struct<passed, severity,
score, reason>; a NULL struct or score means the guard crashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.functions.people import is_plausible_person
from firmloom.functions.text import col

Guard = tuple[str, str, Callable[[], Column]]

CONFIDENCE_FAIL, CONFIDENCE_LOW, CONFIDENCE_FAIR = 30, 50, 70
SUMMARY_MIN, REASON_MIN = 80, 10


def _result(passed: Column | bool, severity: Column | str, score: Column | float, reason: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(passed).cast("boolean").alias("passed"), as_col(severity).alias("severity"),
        as_col(score).cast("double").alias("score"), as_col(reason).alias("reason"),
    )


def effective_confidence() -> Column:
    """Top-level confidence, the nested copy when that is missing or zero, else 0."""
    top = F.col("research_confidence").try_cast("double")
    nested = F.col("nested_confidence").try_cast("double")
    return F.coalesce(F.nullif(top, F.lit(0.0)), nested, F.lit(0.0))


def confidence_guard() -> Column:
    c = effective_confidence()
    return (
        F.when(c < CONFIDENCE_FAIL, _result(False, "error", c, "research confidence below 30"))
        .when(c < CONFIDENCE_LOW, _result(True, "warning", c, "low research confidence"))
        .when(c < CONFIDENCE_FAIR, _result(True, "warning", c, "moderate research confidence"))
        .otherwise(_result(True, "info", c, "research confidence sufficient"))
    )


def summary_guard(signals: list[str] = L.SUMMARY_SIGNALS, fallback: str = L.SUMMARY_FALLBACK) -> Column:
    s = F.trim(F.coalesce("executive_summary", F.lit("")))
    seen = F.lit(False)
    for signal in signals:
        seen = seen | s.rlike(signal)
    return (
        F.when(s == "", _result(False, "error", 0, "summary missing"))
        .when(F.length(s) < SUMMARY_MIN, _result(False, "error", 20, "summary too short"))
        .when(s.rlike(fallback), _result(False, "error", 10, "summary is a fallback"))
        .when(~seen, _result(True, "warning", 65, "summary names no signal"))
        .otherwise(_result(True, "info", 100, "summary specific"))
    )


def sources_guard(registries: list[str] = L.REGISTRY_SOURCES) -> Column:
    """Registry sources against others. An integer in `sources_count` stands in for a missing list."""
    counted = F.coalesce(F.col("sources_count").try_cast("int"), F.lit(0))
    rebuilt = F.transform(
        F.sequence(F.lit(1), F.greatest(counted, F.lit(1))), lambda i: F.concat(F.lit("source "), i.cast("string"))
    )
    listed = F.coalesce(
        F.col("sources_reviewed"),
        F.when(counted > 0, rebuilt).otherwise(F.array().cast("array<string>")),
    )
    filled = F.filter(listed, lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")
    official = F.size(F.filter(filled, lambda s: F.lower(F.trim(s)).isin(registries)))
    external = F.size(filled) - official
    return (
        F.when(official >= 2, _result(True, "info", 80, "two registry sources"))
        .when((official >= 1) & (external >= 1), _result(True, "info", 90, "registry and external source"))
        .when(external >= 2, _result(True, "info", 100, "external sources"))
        .otherwise(_result(False, "error", 0, "too few sources"))
    )


def dimension_guard(dimensions: list[str]) -> Column:
    """Scorecard completeness. `scorecard` maps a dimension to struct<is_object, reason>."""
    card = F.col("scorecard")
    entries = [card[d] for d in dimensions]
    present = F.array(*[F.when(e.isNotNull(), e) for e in entries])
    reason = lambda e: F.trim(F.coalesce(e["reason"], F.lit("")))
    objects = F.filter(present, lambda e: F.coalesce(e["is_object"], F.lit(False)))
    missing = F.size(F.filter(present, lambda e: e.isNull()))
    thin = F.size(F.filter(objects, lambda e: F.length(reason(e)) < REASON_MIN))
    reasons = F.filter(F.transform(objects, reason), lambda r: r != "")
    same = F.when((F.size(reasons) >= 2) & (F.size(F.array_distinct(reasons)) == 1), 1).otherwise(0)
    issues = missing + thin + same
    return (
        F.when(card.isNull() | (F.size(F.map_keys(card)) == 0), _result(False, "error", 0, "no scorecard"))
        .when(issues == 0, _result(True, "info", 100, "scorecard complete"))
        .otherwise(_result(True, "warning", F.greatest(F.lit(30), 100 - 15 * issues), "scorecard has gaps"))
    )


def presence_guard(pattern: str = L.PRESENCE_MISMATCH) -> Column:
    claimed = F.coalesce("has_website", F.lit(False))
    text = F.concat_ws(" ", "executive_summary", "presence_notes", F.array_join("avoid", " "))
    return (
        F.when(~claimed, _result(True, "info", 100, "no website claimed"))
        .when(text.rlike(pattern), _result(True, "warning", 20, "text disputes the website"))
        .otherwise(_result(True, "info", 100, "website consistent"))
    )


def standard_guards(dimensions: list[str]) -> list[Guard]:
    """The five guards in the order they run, for scorecards of these dimensions."""
    return [
        ("CONF", "Research confidence", confidence_guard),
        ("SUMM", "Executive summary", summary_guard),
        ("QUAL", "Source quality", sources_guard),
        ("DIM", "Dimension scorecard", lambda: dimension_guard(dimensions)),
        ("DPRES", "Digital presence", presence_guard),
    ]


def _judged(guard: Guard) -> Column:
    """Result struct of a guard already evaluated into its column; a crash is a passing, errored warning."""
    guard_id, name, _ = guard
    r = F.col(f"__guard_{guard_id}")
    crashed = F.coalesce(r["passed"].isNull() | r["score"].isNull(), F.lit(True))
    return F.struct(
        F.lit(guard_id).alias("guard_id"), F.lit(name).alias("name"),
        F.when(crashed, True).otherwise(r["passed"]).alias("passed"),
        F.when(crashed, "warning").otherwise(r["severity"]).alias("severity"),
        F.when(crashed, 0.0).otherwise(r["score"]).alias("score"),
        F.when(crashed, "guard error").otherwise(r["reason"]).alias("reason"),
        crashed.alias("errored"),
    )


def run_guards(df: DataFrame, guards: list[Guard], fail_fast: bool = True) -> DataFrame:
    """Add `guard_report`: results, passed, score, failures, warnings, errored.

    Guards are evaluated into columns of their own, each once per row; under
    `fail_fast` the results after the first failure are cut off. The score is
    the plain mean of the evaluated guards that did not crash.
    """
    staged = df.withColumns({f"__guard_{g[0]}": g[2]() for g in guards})
    staged = staged.withColumn("__all", F.array(*[_judged(g) for g in guards]))
    failed_at = F.array_position(F.transform("__all", lambda r: r["passed"]), False)
    kept = F.when(failed_at > 0, F.slice("__all", 1, failed_at.cast("int"))).otherwise(F.col("__all"))
    staged = staged.withColumn("__results", kept if fail_fast else F.col("__all"))
    r = F.col("__results")
    scored = F.filter(r, lambda x: ~x["errored"])
    total = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + x["score"])
    ids = lambda test: F.transform(F.filter(r, test), lambda x: x["guard_id"])
    report = F.struct(
        r.alias("results"),
        F.forall(r, lambda x: x["passed"]).alias("passed"),
        F.when(F.size(scored) > 0, total / F.size(scored)).otherwise(0.0).alias("score"),
        ids(lambda x: ~x["passed"]).alias("failures"),
        ids(lambda x: x["passed"] & (x["severity"] == "warning")).alias("warnings"),
        F.exists(r, lambda x: x["errored"]).alias("errored"),
    )
    made = [f"__guard_{g[0]}" for g in guards]
    return staged.withColumn("guard_report", report).drop("__all", "__results", *made)


# --- Storage routing -------------------------------------------------------

MODES = ("off", "warn", "block")


def guard_mode(mode: str | None) -> str:
    cleaned = (mode or "warn").strip().lower()
    return cleaned if cleaned in MODES else "warn"


def storage_route(df: DataFrame, mode: str | None = "warn") -> DataFrame:
    """Add `stored` and `route_reason` from guard_passed (three-state) and guard_failures."""
    mode = guard_mode(mode)
    verdict = F.col("guard_passed")
    names = F.array_join(F.coalesce("guard_failures", F.array().cast("array<string>")), ", ")
    if mode != "block":
        reason = F.when(~verdict & F.lit(mode == "warn"), F.concat(F.lit("stored despite guards: "), names))
        return df.withColumns({"stored": F.lit(True), "route_reason": reason})
    return df.withColumns({
        "stored": F.coalesce(verdict, F.lit(False)),
        "route_reason": F.when(verdict.isNull(), "no guard verdict")
        .when(~verdict, F.concat(F.lit("guards failed: "), names)),
    })


# --- Schema rules ----------------------------------------------------------

LEVELS = ["high", "medium", "low"]


def validate_assessment(dimensions: list[str]) -> Column:
    """Violation codes of an assessment row, in a fixed order; empty when it is valid."""
    summary = F.trim(F.coalesce("executive_summary", F.lit("")))
    confidence = F.col("research_confidence").try_cast("double")
    score = F.col("qualification_score").try_cast("double")
    bad = lambda test: F.coalesce(test, F.lit(True))
    rules = [
        (bad(~score.between(0, 100) | (score != F.floor(score))), "score_range"),
        (bad(~F.col("signal_strength").isin(LEVELS)), "signal_level"),
        (bad(~confidence.between(0, 100)), "confidence_range"),
        (bad(F.trim("recommended_angle") == ""), "angle_missing"),
        (F.length(summary) < 30, "summary_short"),
        (summary.rlike(L.SUMMARY_FALLBACK), "summary_fallback"),
        (F.coalesce(confidence < 50, F.lit(False)) & ~summary.rlike(L.LOW_CONFIDENCE_WORDS), "confidence_unqualified"),
    ]
    signals = F.col("signals")
    for d in dimensions:
        entry = signals[d]
        reason = F.trim(F.coalesce(entry["reason"], F.lit("")))
        invalid = (
            bad(~entry["level"].isin(LEVELS))
            | bad(~entry["pct"].between(0, 100))
            | (F.length(reason) < REASON_MIN)
            | F.lower(reason).isin(L.GENERIC_REASONS)
        )
        rules.append((entry.isNull(), f"{d}_missing"))
        rules.append((entry.isNotNull() & invalid, f"{d}_invalid"))
    contacts = F.col("contacts")
    rules.append((F.coalesce(~F.forall(contacts, valid_contact), F.lit(False)), "contact_shape"))
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))


def valid_contact(contact: Column) -> Column:
    """A name, and a level with a reason of eight characters or more for all seven confidences."""
    ok = F.trim(F.coalesce(contact["name"], F.lit(""))) != ""
    for name in L.CONFIDENCE_FIELDS:
        graded = contact["confidence"][name]
        ok = ok & F.coalesce(
            graded["level"].isin(*LEVELS, "none") & (F.length(F.trim(graded["reason"])) >= 8), F.lit(False)
        )
    return ok


def validate_contacts(contacts: Column, fallback: Column, junk: list[str]) -> Column:
    """Well-formed plausible contacts, or the fallback when none is left."""
    kept = F.filter(contacts, lambda c: valid_contact(c) & is_plausible_person(c["name"], junk))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(fallback)


# --- Outreach email --------------------------------------------------------

WORDS_MIN, WORDS_MAX = 25, 180


def _hits(text: Column, phrases: list[str], prefix: str, whole_words: bool = False) -> list[Column]:
    def test(p: str) -> Column:
        return text.rlike(rf"\b{p}\b") if whole_words else text.contains(p)

    return [F.when(test(p), F.lit(f"{prefix}:{p}")) for p in phrases]


def content_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct lower-case words of five or more letters that are not stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{5,})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(s) for s in stopwords]))


def check_email(
    subject: Column | str,
    body: Column | str,
    grounding: Column | str,
    competitors: list[str],
    stopwords: list[str] | None = None,
    banned: list[str] = L.BANNED_PHRASES,
    competitor_words: bool = False,
) -> Column:
    """Issue codes of an outreach email; it passes when there are none.

    Competitor names match inside words unless `competitor_words`. Words are runs of
    letters and apostrophes. Stop words are Spark's English ones unless given.
    """
    if stopwords is None:
        stopwords = StopWordsRemover.loadDefaultStopWords("english")
    head = F.lower(F.coalesce(col(subject), F.lit("")))
    text = F.coalesce(col(body), F.lit(""))
    lowered = F.lower(text)
    words = F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z'’]+)"), F.lit(1)))
    grounds = content_tokens(F.coalesce(col(grounding), F.lit("")), stopwords)
    ungrounded = (F.size(grounds) > 0) & ~F.arrays_overlap(grounds, content_tokens(text, stopwords))
    both = F.concat_ws("\n", head, lowered)
    return F.array_compact(F.array(
        F.when(words < WORDS_MIN, "too_short"),
        F.when(words > WORDS_MAX, "too_long"),
        *_hits(both, banned, "banned"),
        *_hits(lowered, competitors, "competitor", competitor_words),
        F.when(F.concat_ws("\n", col(subject), text).rlike(L.PLACEHOLDERS), "placeholder"),
        F.when(text.rlike(L.GENERIC_PITCH), "generic_pitch"),
        F.when(ungrounded, "ungrounded"),
    ))
