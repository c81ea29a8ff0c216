import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from catalog.guards import assessments
from catalog.lists import DIMENSIONS
from catalog.views import Views
from firmloom.operators import activity as A
from firmloom.operators.guards import standard_guards
from firmloom.sources.sinks import read_snapshot
from firmloom.streaming.activity import (
    event_stream, settled_status_stream, single_flight_stream, step_status_stream, tail_stream)
from firmloom.streaming.assess import assess_batch, assess_sink

ENTRY = "run_id string, seq long, step string, status string, started_at timestamp, completed_at timestamp"
at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
EVENTS = [
    [("r", 1, "research", "running", at(1), None), ("r", 2, "research", "done", None, at(2)), ("q", 1, "research", "running", at(1), None)],
    [("r", 3, "guard", "running", at(3), None), ("q", 2, "research", "running", None, None)],
    [("r", 4, None, "failed", None, at(9)), ("q", 3, "email", "done", None, at(5))],
]


def put(spark, folder, i, rows):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, ENTRY)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")


def drain(spark, tmp_path, build, schema=ENTRY, mode="update"):
    """All rows that the query gives for what is new in the folder, in the order of its batches."""
    # Time to live and timers ask for empty batches for ever; the tests only want those with data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = []
    source = event_stream(spark, str(tmp_path / "in"), schema, 1)
    query = build(source).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).start()
    assert query.awaitTermination(120)
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def stream(spark, tmp_path, build):
    """Newest row of each step, over a restart of the query before the last batch."""
    latest = {}
    for part in (EVENTS[:-1], EVENTS[-1:]):
        for rows in part:
            put(spark, tmp_path / "in", EVENTS.index(rows), rows)
        for r in drain(spark, tmp_path, build):
            latest[(r.run_id, r.step)] = (r.seq, r.status, r.started_at, r.completed_at)
    return latest


def batch_events(spark):
    return spark.createDataFrame([r for rows in EVENTS for r in rows], ENTRY)


def as_map(df):
    return {(r.run_id, r.step): (r.seq, r.status, r.started_at, r.completed_at) for r in df.collect()}


def test_step_status_stream(spark, tmp_path):
    only_steps = lambda df: step_status_stream(df.filter("step is not null"))
    assert stream(spark, tmp_path, only_steps) == as_map(A.step_status(batch_events(spark).filter("step is not null")))


def test_settled_status_stream(spark, tmp_path):
    events = batch_events(spark)
    runs = events.filter("step is null").select("run_id", "status", F.col("completed_at").alias("finished_at"))
    expected = as_map(A.settled_status(A.step_status(events.filter("step is not null")), runs))
    assert stream(spark, tmp_path, settled_status_stream) == expected
    assert expected[("r", "guard")][1] == "failed"


def test_settled_status_of_the_whole_table(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    ends = v.runs.filter("finished_at is not null").select(
        "run_id", F.lit(10**9).cast("long").alias("seq"), F.lit(None).cast("string").alias("step"), "status",
        F.lit(None).cast("timestamp").alias("started_at"), F.col("finished_at").alias("completed_at"))
    log = v.activity.select(*ends.columns).unionByName(ends)
    for i in range(3):
        put(spark, tmp_path / "in", i, log.filter(F.pmod("seq", F.lit(3)) == i))
    got = {}
    for r in drain(spark, tmp_path, settled_status_stream):
        got[(r.run_id, r.step)] = (r.seq, r.status, r.started_at, r.completed_at)
    assert got == as_map(A.settled_status(A.step_status(v.activity), v.runs))


def test_an_expired_run_leaves_the_state(spark, tmp_path):
    build = lambda df: settled_status_stream(df, retention_seconds=1)
    put(spark, tmp_path / "in", 0, [("r", 1, "research", "running", at(1), None), ("r", 2, None, "failed", None, at(9))])
    assert [r.status for r in drain(spark, tmp_path, build)] == ["failed"]
    time.sleep(3)
    # Neither the start nor the end is known any more.
    put(spark, tmp_path / "in", 1, [("r", 3, "research", "running", None, None)])
    assert [(r.status, r.started_at) for r in drain(spark, tmp_path, build)] == [("running", None)]


REQUEST = "company_id string, kind string, seq long, action string"


def test_single_flight_stream_of_the_whole_table(spark, tmp_path):
    log = Views(spark, "/root/testdata/sf0.001").run_requests
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    cuts = [low + (high + 1 - low) * i // 4 for i in range(5)]
    got = []
    for part in ((0, 1, 2), (3,)):  # the query starts again before the last part
        for i in part:
            put(spark, tmp_path / "in", i, log.filter((F.col("seq") >= cuts[i]) & (F.col("seq") < cuts[i + 1])))
        got += drain(spark, tmp_path, single_flight_stream, REQUEST, "append")
    expected = A.single_flight(log).collect()
    assert sorted((r.company_id, r.kind, r.seq, r.outcome) for r in got) == sorted(
        (r.company_id, r.kind, r.seq, r.outcome) for r in expected)
    assert {r.outcome for r in got} == {"started", "joined", "refused"}
    started = {(r.company_id, r.kind, r.seq) for r in got if r.outcome == "started"}
    assert all((r.company_id, r.kind, r.run_seq) in started for r in got if r.outcome == "joined")


def test_a_run_without_a_finish_expires(spark, tmp_path):
    build = lambda df: single_flight_stream(df, expire_seconds=1)
    rows = lambda *r: spark.createDataFrame([("c", *x) for x in r], REQUEST)
    put(spark, tmp_path / "in", 0, rows(("assess", 1, "request"), ("refresh", 2, "request"), ("assess", 3, "request")))
    first = [(r.seq, r.outcome, r.run_seq) for r in drain(spark, tmp_path, build, REQUEST, "append")]
    assert first == [(1, "started", 1), (2, "refused", None), (3, "joined", 1)]
    time.sleep(3)
    # Rows of a batch come before its timers: the batch after this one finds no run.
    put(spark, tmp_path / "in", 1, rows(("other", 4, "request")))
    put(spark, tmp_path / "in", 2, rows(("assess", 5, "request"), ("assess", 6, "finish"), ("assess", 7, "request")))
    later = [(r.kind, r.seq, r.outcome, r.run_seq) for r in drain(spark, tmp_path, build, REQUEST, "append")]
    assert sorted(x for x in later if x[0] == "assess" and x[2] == "expired") == [("assess", 1, "expired", 1), ("assess", 3, "expired", 1)]
    assert [x for x in later if x[0] == "assess" and x[2] != "expired"] == [("assess", 5, "started", 5), ("assess", 7, "started", 7)]


def state_rows(spark, tmp_path, build, rows, schema, mode):
    """Rows that the state store holds after one batch."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    put(spark, tmp_path / "in", 0, spark.createDataFrame(rows, schema))
    query = build(event_stream(spark, str(tmp_path / "in"), schema)).writeStream.outputMode(mode).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, i: df.count()).start()
    assert query.awaitTermination(120)
    return [p for p in query.recentProgress if p["numInputRows"]][-1]["stateOperators"][0]["numRowsTotal"]


def test_a_run_is_one_value_of_the_state(spark, tmp_path):
    rows = [(r, i, step, "running", at(1), None) for r in ("r", "q") for i, step in enumerate(("research", "guard", "email"))]
    assert state_rows(spark, tmp_path, settled_status_stream, rows, ENTRY, "update") == 2


def test_a_company_is_one_value_of_the_state(spark, tmp_path):
    rows = [(c, kind, i, "request") for c in ("c", "d") for i, kind in enumerate(("refresh", "assess", "other", "assess", "other"))]
    assert state_rows(spark, tmp_path, single_flight_stream, rows, REQUEST, "append") == 2


def test_tail_gives_each_event_once(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    log = v.activity.select("run_id", "seq", "step")
    runs = v.runs
    seen = []
    for i in range(2):
        put(spark, tmp_path / "in", i, log.filter(F.pmod("seq", F.lit(2)) == i))
        build = lambda df: tail_stream(df, 400, runs)
        seen += drain(spark, tmp_path, build, "run_id string, seq long, step string", "append")
    assert drain(spark, tmp_path, build, "run_id string, seq long, step string", "append") == []
    key = lambda r: (r.run_id, r.seq, r.step, r.run_status)
    assert sorted(map(key, seen)) == sorted(map(key, A.tail(log, 400, runs).collect()))


@pytest.fixture(scope="module")
def judged(spark):
    rows = assessments(Views(spark, "/root/testdata/sf0.001"))
    return rows.withColumns({
        "ordinal": F.col("doc_id"), "company_id": F.concat(F.lit("C"), (F.col("doc_id") % 60).cast("string")),
        "generated_at": F.lit("2024-01-01").cast("timestamp")})


def final(spark, root):
    stored = {r.company_id: (r.qualification_score, r.guard_passed) for r in read_snapshot(spark, root, "enrichment").collect()}
    refused = {r.company_id: r.reason for r in read_snapshot(spark, root, "assessment_rejections").collect()}
    return stored, refused


def test_assess_in_batches_equals_all_at_once(spark, judged, tmp_path):
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    failing = []

    def audit(outcomes):
        failing.append(outcomes.count())
        raise RuntimeError("audit down")

    guards = standard_guards(DIMENSIONS)
    write = assess_sink(many, "a", guards, "block", on_audit=audit, buckets=8)
    parts = [judged.filter("doc_id < 70"), judged.filter("doc_id between 70 and 130"), judged.filter("doc_id > 130")]
    for i, part in enumerate(parts):
        write(part, i)
    write(parts[2], 2)  # replayed
    assess_sink(one, "b", guards, "block", buckets=4)(judged, 0)
    assert final(spark, many) == final(spark, one)
    stored, refused = final(spark, many)
    assert stored and refused
    outcomes = spark.read.parquet(f"{many}/outcomes")
    expected = {r.outcome: r["count"] for r in assess_batch(judged, guards, "block").groupBy("outcome").count().collect()}
    # A failed audit changes no outcome.
    assert {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()} == expected and len(failing) == 4


def test_a_new_checkpoint_keeps_the_table(spark, judged, tmp_path):
    root, guards = str(tmp_path), standard_guards(DIMENSIONS)
    assess_sink(root, "a", guards, buckets=4)(judged.filter("doc_id < 100"), 0)
    before = read_snapshot(spark, root, "enrichment").count()
    assess_sink(root, "b", guards, buckets=4)(judged.filter("doc_id > 190"), 0)
    assert read_snapshot(spark, root, "enrichment").count() >= before
    with pytest.raises(RuntimeError, match="has no batch 2"):
        assess_sink(root, "b", guards, buckets=4)(judged, 3)
    assess_sink(root, "b", guards, buckets=4)(judged.filter("doc_id > 180"), 1)
    with pytest.raises(RuntimeError, match="past batch 0"):
        assess_sink(root, "b", guards, buckets=4)(judged, 0)
