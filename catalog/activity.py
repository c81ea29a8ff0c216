"""Run event log, in batch and as streams."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.registry import query
from firmloom.operators import activity as A
from firmloom.session import checkpoint_dir, configure
from firmloom.streaming import activity as live

STATUS = """
  status AS (
    SELECT run_id, step, seq, status, completed_at,
           coalesce(started_at, earlier) AS started_at FROM (
      SELECT *, last_value(started_at IGNORE NULLS) OVER (PARTITION BY run_id, step ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS earlier,
             row_number() OVER (PARTITION BY run_id, step ORDER BY seq DESC) AS n FROM $activity) x WHERE n = 1)
"""
OUT = "run_id, step, seq, status, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us"


def _out(df):
    return df.select(
        "run_id", "step", "seq", "status",
        F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"),
    )


def streamed(v, log, build, mode, parts=4):
    """`log` written as files in the order of `seq`; what the stream over them has put out when the query, started
    again after three of the `parts`, has read all."""
    root = f"{checkpoint_dir(v.spark).rstrip('/')}/firmloom-stream-{uuid.uuid4().hex}"
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    quiet = configure(v.spark.newSession())  # time to live and timers ask for empty batches for ever; this log ends
    quiet.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def collect(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    for i in range(parts):
        at = F.floor((F.col("seq") - low) * parts / max(1, high + 1 - low))
        log.filter(at == i).write.parquet(f"{root}/in/{i}")
        if i >= parts - 2:
            query = build(live.event_stream(quiet, f"{root}/in", log.schema)).writeStream.outputMode(mode).option(
                "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(collect).start()
            query.awaitTermination()
    return v.spark.read.parquet(f"{root}/out").drop("part")


def newest(out, *keys):
    """The last row that a stream in update mode put out for each key."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])


@query("step_status", f"WITH {STATUS} SELECT {OUT} FROM status")
def _(v):
    return _out(A.step_status(v.activity))


@query("close_stragglers", f"""WITH {STATUS} SELECT s.run_id, step, seq, r.status, epoch_us(s.started_at) AS started_us,
    epoch_us(r.finished_at) AS completed_us FROM status s JOIN $runs r ON r.run_id = s.run_id
    WHERE s.status = 'running' AND r.finished_at IS NOT NULL""")
def _(v):
    return _out(A.close_stragglers(A.step_status(v.activity), v.runs))


SETTLED = f"""WITH {STATUS} SELECT s.run_id, step, seq,
    CASE WHEN s.status = 'running' AND r.finished_at IS NOT NULL THEN r.status ELSE s.status END AS status,
    epoch_us(s.started_at) AS started_us,
    epoch_us(CASE WHEN s.status = 'running' AND r.finished_at IS NOT NULL THEN r.finished_at ELSE s.completed_at END) AS completed_us
    FROM status s LEFT JOIN $runs r ON r.run_id = s.run_id"""


@query("settled_status", SETTLED)
def _(v):
    return _out(A.settled_status(A.step_status(v.activity), v.runs))


@query("settled_status_stream", SETTLED)
def _(v):
    columns = ["run_id", "seq", "step", "status", "started_at", "completed_at"]
    last = v.activity.agg(F.max("seq")).first()[0] or 0
    none = F.lit(None)
    ends = v.runs.filter("finished_at is not null").select(
        "run_id", (F.lit(last) + F.row_number().over(W.partitionBy("run_id").orderBy("finished_at"))).cast("long").alias("seq"),
        none.cast("string").alias("step"), "status", none.cast("timestamp").alias("started_at"), F.col("finished_at").alias("completed_at"))
    log = v.activity.select(*columns).unionByName(ends)
    return _out(newest(streamed(v, log, live.settled_status_stream, "update"), "run_id", "step"))


SINGLE_FLIGHT = """
    WITH seen AS (
      SELECT *, last_value(CASE WHEN kind = 'assess' THEN action END IGNORE NULLS) OVER (
        PARTITION BY company_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocker FROM $run_requests),
    marked AS (SELECT *, kind = 'refresh' AND action = 'request' AND coalesce(blocker, '') = 'request' AS refused FROM seen),
    state AS (
      SELECT *, last_value(CASE WHEN NOT refused THEN action END IGNORE NULLS) OVER (
        PARTITION BY company_id, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked)
    SELECT company_id, kind, seq, CASE WHEN refused THEN 'refused' WHEN coalesce(before, 'finish') = 'finish' THEN 'started' ELSE 'joined' END AS outcome
    FROM state WHERE action = 'request'"""


@query("single_flight", SINGLE_FLIGHT)
def _(v):
    return A.single_flight(v.run_requests).select("company_id", "kind", "seq", "outcome")


@query("single_flight_stream", SINGLE_FLIGHT)
def _(v):
    return streamed(v, v.run_requests, live.single_flight_stream, "append").select("company_id", "kind", "seq", "outcome")


TAIL = "SELECT a.run_id, seq, step, r.status AS run_status FROM $activity a LEFT JOIN $runs r ON r.run_id = a.run_id WHERE seq > 400"


@query("event_tail", TAIL)
def _(v):
    return A.tail(v.activity, 400, v.runs).select("run_id", "seq", "step", "run_status")


@query("event_tail_stream", TAIL)
def _(v):
    log = v.activity.select("run_id", "seq", "step")
    out = streamed(v, log, lambda events: live.tail_stream(events, 400, v.runs), "append")
    return out.select("run_id", "seq", "step", "run_status")


@query("active_runs", "SELECT run_id, company_id, kind FROM $runs WHERE finished_at IS NULL")
def _(v):
    return A.active_runs(v.runs).select("run_id", "company_id", "kind")


@query("prune_runs", """SELECT run_id, status FROM $runs WHERE finished_at IS NULL
    OR date_diff('second', finished_at, TIMESTAMP '2024-01-30 22:00:00') <= 7200""")
def _(v):
    return A.prune(v.runs, F.lit("2024-01-30 22:00:00").cast("timestamp")).select("run_id", "status")


STEPS = ["click", "error", "purchase", "signup", "view"]


@query("stage_durations", "SELECT run_id, " + ", ".join(
    f"""epoch(date_trunc('second', max(completed_at) FILTER (WHERE step = '{s}')))::BIGINT
        - epoch(date_trunc('second', min(started_at) FILTER (WHERE step = '{s}')))::BIGINT AS {s}""" for s in STEPS
) + " FROM $activity GROUP BY run_id")
def _(v):
    return A.stage_durations(v.activity, STEPS)
