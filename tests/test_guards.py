import pytest
from pyspark.sql import functions as F

from catalog.lists import COMPETITORS, DIMENSIONS, NOT_A_NAME
from firmloom import lexicons as L
from firmloom.operators import guards as G

GOOD = "Acme is an authorised intermediary in Cork with a small team, a current website and regular renewals to bill for."
CARD = "map<string,struct<is_object:boolean,reason:string>>"
ROW = ("company_id string, qualification_score int, signal_strength string, research_confidence string, nested_confidence string, "
       "executive_summary string, recommended_angle string, sources_reviewed array<string>, sources_count string, "
       f"scorecard {CARD}, has_website boolean, presence_notes string, avoid array<string>")


def assessment(spark, **changes):
    row = dict(
        company_id="c", qualification_score=80, signal_strength="high", research_confidence="85", nested_confidence=None,
        executive_summary=GOOD, recommended_angle="billing", sources_reviewed=list(L.REGISTRY_SOURCES), sources_count=None,
        scorecard={d: (True, f"because of {d}") for d in DIMENSIONS}, has_website=True, presence_notes="", avoid=[])
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], ROW)


def judge(spark, guard, **changes):
    r = assessment(spark, **changes).select(guard().alias("r")).first().r
    return r.passed, r.severity, r.score


def test_confidence(spark):
    at = lambda c, nested=None: judge(spark, G.confidence_guard, research_confidence=c, nested_confidence=nested)
    assert at("25") == (False, "error", 25) and at("45")[:2] == (True, "warning") and at("69")[1] == "warning" and at("70") == (True, "info", 70)
    assert at("high") == (False, "error", 0) and at(None) == (False, "error", 0) and at("0", "75") == (True, "info", 75)


def test_summary(spark):
    at = lambda s: judge(spark, G.summary_guard, executive_summary=s)[::2]
    assert at("Too short") == (False, 20) and at(" ") == (False, 0) and at("Unable to assess this firm. " + GOOD) == (False, 10)
    assert at("Plain words about nothing in particular. " * 3) == (True, 65) and at(GOOD) == (True, 100)
    # Stems end at a word boundary: "insurance" alone is no signal. "n/a" is too short before it is a fallback.
    assert at("Sells insurance " + "and more " * 10) == (True, 65) and at("n/a") == (False, 20)


def test_sources(spark):
    at = lambda s, n=None: judge(spark, G.sources_guard, sources_reviewed=s, sources_count=n)[::2]
    registry = L.REGISTRY_SOURCES[0]
    assert at(["https://a.ie"]) == (False, 0) and at(["https://a.ie/1", "https://a.ie/2"]) == (True, 100)
    assert at([f" {registry.upper()} ", registry]) == (True, 80) and at([registry, "x"]) == (True, 90) and at([]) == (False, 0)
    assert at(None, "3") == (True, 100) and at(None, None) == (False, 0)


def test_dimensions(spark):
    full = {d: (True, f"because of {d}") for d in DIMENSIONS}
    at = lambda card: judge(spark, lambda: G.dimension_guard(DIMENSIONS), scorecard=card)[::2]
    assert at(full) == (True, 100) and at(None) == (False, 0) and at({}) == (False, 0)
    first, second = DIMENSIONS[:2]
    assert at({**full, first: (True, "thin")}) == (True, 85)
    assert at({d: v for d, v in full.items() if d != first}) == (True, 85)
    # An entry that is not an object is neither missing nor thin.
    assert at({**full, first: (False, None)}) == (True, 100)
    assert at({d: (True, "one same reason") for d in DIMENSIONS}) == (True, 85)
    assert at({first: (True, "x")}) == (True, 30)


def test_presence(spark):
    at = lambda **c: judge(spark, G.presence_guard, **c)[1:]
    assert at() == ("info", 100) and at(presence_notes="No website found") == ("warning", 20)
    assert at(has_website=False, presence_notes="No website found") == ("info", 100)


def report(spark, guards=G.standard_guards(DIMENSIONS), fail_fast=True, **changes):
    return G.run_guards(assessment(spark, **changes), guards, fail_fast).first().guard_report


def test_pipeline(spark):
    good = report(spark)
    assert good.passed and [r.guard_id for r in good.results] == ["CONF", "SUMM", "QUAL", "DIM", "DPRES"]
    assert good.score == pytest.approx((85 + 100 + 80 + 100 + 100) / 5)
    bad = report(spark, executive_summary="Too short", research_confidence="45")
    assert not bad.passed and bad.failures == ["SUMM"] and bad.warnings == ["CONF"] and bad.score == 32.5 and len(bad.results) == 2
    assert len(report(spark, fail_fast=False, executive_summary="Too short").results) == 5


def test_crashed_guards_do_not_block(spark):
    crash = ("X", "Crashes", lambda: G._result(True, "info", F.col("presence_notes").try_cast("double"), "r"))
    good = ("Y", "Good", lambda: G._result(True, "info", 100, "r"))
    r = report(spark, [crash, good])
    assert r.passed and r.errored and r.score == 100 and r.warnings == ["X"]
    assert report(spark, [crash]).score == 0 and report(spark, [crash]).passed


def test_modes(spark):
    assert [G.guard_mode(m) for m in (None, "", "nonsense", " Block ", "OFF")] == ["warn", "warn", "warn", "block", "off"]
    rows = spark.createDataFrame([("a", True, []), ("b", False, ["SUMM"]), ("c", None, [])], "id string, guard_passed boolean, guard_failures array<string>")
    route = lambda m: [(r.stored, r.route_reason) for r in G.storage_route(rows, m).orderBy("id").collect()]
    assert route("block") == [(True, None), (False, "guards failed: SUMM"), (False, "no guard verdict")]
    assert [s for s, _ in route("off")] == [s for s, _ in route("warn")] == [True] * 3


def with_shape(df, reason="a good reason", level="high", name="Mary Byrne"):
    signal = lambda: F.struct(F.lit("high").alias("level"), F.lit(80.0).alias("pct"), F.lit("solid evidence seen").alias("reason"))
    graded = F.struct(*[F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason")).alias(f) for f in L.CONFIDENCE_FIELDS])
    return df.withColumns({
        "signals": F.struct(*[signal().alias(d) for d in DIMENSIONS]),
        "contacts": F.array(F.struct(F.lit(name).alias("name"), graded.alias("confidence")))})


def test_schema_rules(spark):
    codes = lambda shape={}, **c: with_shape(assessment(spark, **c), **shape).select(G.validate_assessment(DIMENSIONS)).first()[0]
    assert codes() == []
    assert codes(qualification_score=120) == ["score_range"]
    assert codes(research_confidence="35") == ["confidence_unqualified"]
    assert codes(research_confidence="35", executive_summary=GOOD + " Staff numbers are unverified.") == []
    assert codes(signal_strength="huge", recommended_angle=" ", executive_summary="N/A") == [
        "signal_level", "angle_missing", "summary_short", "summary_fallback"]
    assert codes(dict(reason="short")) == ["contact_shape"]


def test_contacts_fall_back(spark):
    pick = lambda **shape: with_shape(assessment(spark), **shape).select(G.validate_contacts(
        F.col("contacts"), F.transform("contacts", lambda c: c.withField("name", F.lit("fallback"))), NOT_A_NAME)).first()[0][0].name
    assert pick() == "Mary Byrne" and pick(reason="short") == "fallback" and pick(name="Our Team") == "fallback"


WORDS = "We noticed your renewals in Cork and wondered how billing works across branches today, since several brokers told us that manual invoices cost many hours monthly."


@pytest.mark.parametrize("subject, body, grounding, issues", [
    ("Renewals", WORDS, "renewals in Cork", []),
    ("Renewals", "Too few words about renewals", "renewals", ["too_short"]),
    ("Renewals", WORDS + " word" * 170, "renewals", ["too_long"]),
    ("Act now", WORDS, "renewals", ["banned:act now"]),
    ("x", WORDS + " Your message", "renewals", ["competitor:sage"]),
    ("Sage", WORDS, "renewals", []),
    ("x", WORDS + " Dear [First Name]", "renewals", ["placeholder"]),
    ("x", WORDS + " We help businesses like yours.", "renewals", ["generic_pitch"]),
    ("x", WORDS, "unrelated mortgage topics", ["ungrounded"]),
    ("x", WORDS, "a few tiny bits", []),
])
def test_email(value, subject, body, grounding, issues):
    assert value(G.check_email(F.lit(subject), F.lit(body), F.lit(grounding), COMPETITORS)) == issues


def test_competitor_word_mode(value):
    assert value(G.check_email(F.lit("x"), F.lit(WORDS + " Your message"), F.lit("renewals"), COMPETITORS, competitor_words=True)) == []
