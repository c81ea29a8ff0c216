"""Run event log: step status, stragglers, single flight, tail, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.operators.ordered import previous_value

RETENTION_SECONDS = 7200


def step_status(events: DataFrame) -> DataFrame:
    """Newest entry per (run, step); a missing start comes from the latest earlier entry that has one.

    Both are partial aggregates, so a run with most of the log still combines map-side.
    """
    rest = [c for c in events.columns if c not in ("run_id", "step", "seq", "started_at")]
    newest = F.max(F.struct("seq", *[F.col(c) for c in rest]))
    started = F.max(F.when(F.col("started_at").isNotNull(), F.struct("seq", "started_at")))
    return (
        events.groupBy("run_id", "step").agg(newest.alias("e"), started.alias("s"))
        .select("run_id", "step", "e.seq", F.col("s.started_at").alias("started_at"), *[F.col(f"e.{c}") for c in rest])
    )


def close_stragglers(status: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps still running when their run finished, closed with the run's status."""
    finished = runs.filter("finished_at is not null").select(
        "run_id", F.col("status").alias("run_status"), "finished_at"
    )
    closed = (
        status.filter("status = 'running'").join(finished, "run_id")
        .withColumns({"status": F.col("run_status"), "completed_at": F.col("finished_at")})
    )
    return closed.select(*status.columns)


def settled_status(status: DataFrame, runs: DataFrame) -> DataFrame:
    """`step_status` with stragglers closed."""
    ended = runs.filter("finished_at is not null").select(
        "run_id", F.col("status").alias("run_status"), "finished_at"
    )
    late = (F.col("status") == "running") & F.col("finished_at").isNotNull()
    return status.join(ended, "run_id", "left").withColumns({
        "status": F.when(late, F.col("run_status")).otherwise(F.col("status")),
        "completed_at": F.when(late, F.col("finished_at")).otherwise(F.col("completed_at")),
    }).select(*status.columns)


def single_flight(log: DataFrame, refused_while: tuple[str, str] | None = ("refresh", "assess")) -> DataFrame:
    """What each request does: start a run, join the active one, or be refused.

    `log`: (company_id, kind, seq, action) with action 'request' or 'finish'.
    After any accepted request its (company, kind) is active until the next
    finish, so a request starts a run exactly when the entry before it is a
    finish or there is none. Requests of `refused_while[0]` are refused while a
    run of `refused_while[1]` is active for the company.
    """
    if refused_while:
        blocked, blocker = refused_while
        seen = previous_value(
            log, ["company_id"], ["seq"],
            F.when(F.col("kind") == blocker, F.col("action")), "blocker_action",
        )
        refused = (F.col("kind") == blocked) & (F.col("action") == "request") & (
            F.coalesce(F.col("blocker_action"), F.lit("")) == "request"
        )
        log = seen.withColumn("refused", refused)
    else:
        log = log.withColumn("refused", F.lit(False))
    state = previous_value(
        log.drop("blocker_action"), ["company_id", "kind"], ["seq"],
        F.when(~F.col("refused"), F.col("action")), "before",
    )
    outcome = (
        F.when(F.col("refused"), "refused")
        .when(F.coalesce(F.col("before"), F.lit("finish")) == "finish", "started")
        .otherwise("joined")
    )
    return state.filter("action = 'request'").withColumn("outcome", outcome).drop("before", "refused", "action")


def tail(events: DataFrame, since: int, runs: DataFrame | None = None) -> DataFrame:
    """Entries after an offset, with the status of their run."""
    newer = events.filter(F.col("seq") > since)
    if runs is None:
        return newer
    return newer.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter("finished_at is null")


def prune(runs: DataFrame, as_of: Column, seconds: int = RETENTION_SECONDS) -> DataFrame:
    """Runs still active, or finished no more than `seconds` ago."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("finished_at")
    return runs.filter(F.col("finished_at").isNull() | (age <= seconds))


def stage_durations(events: DataFrame, steps: list[str]) -> DataFrame:
    """Seconds per run spent in each named step, one column per step."""
    seconds = F.unix_timestamp(F.max("completed_at")) - F.unix_timestamp(F.min("started_at"))
    return events.groupBy("run_id").pivot("step", steps).agg(seconds)
