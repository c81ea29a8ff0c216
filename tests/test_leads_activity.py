import random

import pytest
from pyspark.sql import functions as F

from firmloom import schemas
from firmloom.operators import activity as A
from firmloom.operators import leads as O
from firmloom.plans.leads import lead_query


def frame(spark, schema, *rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    companies = frame(spark, schemas.COMPANIES, *[
        dict(id=i, legal_name=n, county=c, cro_status=s) for i, n, c, s in [
            ("1", "Acme", "Cork", "Normal"), ("2", "beta", "Mayo", "Dissolved"), ("3", "Gamma", None, "Normal")]])
    enrichment = frame(spark, schemas.ENRICHMENT, *[
        dict(id=i, company_id=c, qualification_score=q, generated_at=day(d), employee_band=b) for i, c, q, d, b in [
            ("e1", "1", 90, 1, "1-10"), ("e2", "1", 30, 2, "200+"), ("e3", "2", 55, 1, None)]])
    emails = frame(spark, schemas.OUTREACH_EMAILS, dict(id="m", company_id="1", status="draft", subject="s"), dict(id="n", company_id="2", status="sent"))
    rejections = frame(spark, schemas.ASSESSMENT_REJECTIONS, dict(company_id="2", reason="guards failed: CONF", guard_score=12.0))
    return companies, enrichment, emails, rejections


def test_lead_list(tables):
    rows = {r.company_id: r for r in O.lead_list(*tables).collect()}
    assert (rows["1"].qualification_score, rows["1"].has_draft, rows["1"].email_subject) == (30, True, "s")
    assert (rows["2"].rejection_reason, rows["2"].rejection_guard_score, rows["2"].has_draft) == ("guards failed: CONF", 12.0, False)
    assert rows["3"].qualification_score is None


def test_lead_query(tables):
    ids = lambda **q: [r.company_id for r in lead_query(*tables, **q).collect()]
    assert ids() == ["2", "1", "3"] and ids(direction="asc") == ["1", "2", "3"]
    assert ids(sort="size", direction="asc") == ["3", "2", "1"]  # equal sizes by name, capitals first
    assert ids(county="cork") == ["1"] and ids(county="") == ["2", "1", "3"] and ids(min_score=0) == ["2", "1"]
    assert ids(search="GAM") == ["3"] and ids(status="needs_review") == ["2"] and ids(bracket="lower") == ["1"]
    assert ids(limit=1, offset=1) == ["1"]
    with pytest.raises(ValueError):
        ids(sort="shoe size")


def test_detail_shows_rejection_and_contacts(spark, tables):
    companies, enrichment, emails, rejections = tables
    contacts = frame(spark, schemas.CONTACTS, dict(id="k", company_id="2", full_name="Mary"))
    rows = {r.company_id: r for r in O.lead_detail(companies, enrichment, emails, contacts, rejections).collect()}
    assert rows["2"].rejection.reason == "guards failed: CONF" and rows["2"].contact_count == 1 and rows["1"].assessment.id == "e2"


def test_batch_outcomes(spark):
    schema = "ordinal int, status string, rate_limited boolean"
    rows = [(0, "enriched", False), (1, "rejected", None), (2, "failed", False), (3, "failed", False)]
    got = O.batch_outcomes(spark.createDataFrame(rows, schema)).first()
    assert (got.error, got.attempted, got.enriched, got.rejected, got.failed) == (None, 4, 1, 1, 2)
    got = O.batch_outcomes(spark.createDataFrame([*rows, (4, "failed", True)], schema)).first()
    assert got.error == "rate limited" and got.attempted is None
    assert [r.ordinal for r in O.batch_errors(spark.createDataFrame(rows, schema), 2).collect()] == [1, 2]


def test_empty_statistics(spark):
    stats = O.guard_stats(spark.createDataFrame([], schemas.ENRICHMENT)).first()
    assert (stats.total, stats.pass_rate) == (0, 0.0)


def test_physical_plans(spark, tables):
    companies, enrichment, emails, _ = tables
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan(O.unenriched(companies, enrichment))
    assert "TakeOrderedAndProject" in plan(O.top_opportunities(companies, enrichment, emails))
    assert "WindowGroupLimit" in plan(O.latest_per_company(enrichment))


def test_single_flight_against_a_replay(spark):
    rng = random.Random(4)
    log = [(rng.choice(["hot", "hot", "a", "b"]), rng.choice(["assess", "refresh"]), i, rng.choice(["request", "request", "finish"])) for i in range(200)]
    active, expected = set(), {}
    for company, kind, seq, action in log:
        key = (company, kind)
        if action == "finish":
            active.discard(key)
        elif kind == "refresh" and (company, "assess") in active:
            expected[seq] = "refused"
        else:
            expected[seq] = "joined" if key in active else "started"
            active.add(key)
    df = spark.createDataFrame(log, "company_id string, kind string, seq long, action string").repartition(4)
    assert {r.seq: r.outcome for r in A.single_flight(df).collect()} == expected


def test_prune(spark):
    runs = spark.createDataFrame([("a", None), ("b", "2024-01-01 10:00:00"), ("c", "2024-01-01 09:59:59")], "run_id string, f string").select(
        "run_id", F.col("f").cast("timestamp").alias("finished_at"))
    kept = A.prune(runs, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert sorted(r.run_id for r in kept.collect()) == ["a", "b"]


@pytest.mark.parametrize("key, direction", [("score", "desc"), ("county", "asc"), ("size", "desc")])
def test_deep_pages(spark, key, direction):
    """Pages of any offset are the pieces of the whole order, NULLs and equal keys included."""
    rows = [(f"C{i}", f"Firm {i % 40:02d}", None if i % 9 == 0 else i % 7, f"K{i % 3}" if i % 4 else None, "11-50" if i % 2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "company_id string, legal_name string, qualification_score int, county string, employee_band string").repartition(6)
    order = O.lead_sort(key, direction)
    whole = [r.company_id for r in df.orderBy(*order).collect()]
    for limit, offset in ((20, 0), (20, 7), (300, 150), (50, 480), (10, 500), (10, 9000), (0, 30)):
        assert [r.company_id for r in O.page(df, order, limit, offset).collect()] == whole[offset:offset + limit]


def test_a_deep_page_reads_its_ranges_only(spark):
    df = spark.range(20_000).select(F.col("id").alias("company_id"), F.lit("x").alias("legal_name"), F.col("id").alias("qualification_score"))
    plan = O.page(df, O.lead_sort("score", "desc"), 10, 12_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan.replace("GlobalLimit 0", "")
