"""The run event log as a stream: step status, stragglers, expiry, single flight, tail.

State is keyed and small: the steps of a run, the active kinds of a company's runs. It comes
and goes with the rows of a micro-batch, one value a key. Entries leave by a time to live or a
deadline. Rows of a key are taken by their `seq` within a micro-batch; batches come in the
order of the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from firmloom.operators.activity import RETENTION_SECONDS, tail

STEP_ROWS = "run_id string, step string, seq long, status string, started long, completed long"
STEP_STATE = (
    "steps array<string>, seqs array<long>, statuses array<string>, starts array<long>, start_seqs array<long>, "
    "completions array<long>, changes array<long>, end_status string, end_at long, end_change long")
FLIGHT_SCHEMA = "company_id string, kind string, seq long, outcome string, run_seq long"
FLIGHT_STATE = "kinds array<string>, run_seqs array<long>, deadlines array<long>, joined_kinds array<string>, joined_seqs array<long>"
MISSING = -1  # no time, no entry yet


def _in_order(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key by `seq`."""
    frames = list(frames)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames)
    order = np.argsort(rows["seq"].to_numpy(), kind="stable")
    return zip(*(rows[c].to_numpy()[order].tolist() for c in columns))


# --- Step status ----------------------------------------------------------

def _steps(ttl: int):
    """One run: the newest entry of each step and the newest start before it; once the run ended, its open steps end too.

    State: an entry per step (seq, status, start and the seq it came with, completion; times
    in microseconds) and the run's end, each dropped `ttl` milliseconds after its last change.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        steps, before, ended_change, changed = {}, None, MISSING, set()
        if state.exists:
            *entries, status, end_at, ended_change = state.get
            steps = {step: entry for step, *entry in zip(*entries) if entry[5] + ttl > now}
            if ended_change != MISSING and ended_change + ttl > now:
                before = (status, end_at)
        ended = before
        for step, seq, status, started, completed in _in_order(frames, "step", "seq", "status", "started", "completed"):
            if step is None:
                ended = (status, completed)
                continue
            entry = steps.setdefault(step, [MISSING, None, MISSING, MISSING, MISSING, now])
            if started != MISSING and seq > entry[3]:
                entry[2], entry[3] = started, seq
                changed.add(step)
            if seq > entry[0]:
                entry[0], entry[1], entry[4] = seq, status, completed
                changed.add(step)
        if ended is not None:
            if ended != before:
                ended_change = now
            for step, entry in steps.items():
                if entry[1] == "running":
                    entry[1], entry[4] = ended
                    changed.add(step)
        for step in changed:
            steps[step][5] = now
        status, end_at = (None, MISSING) if ended is None else ended
        lists = list(zip(*((step, *entry) for step, entry in steps.items()))) or [()] * 7
        state.update((*map(list, lists), status, end_at, MISSING if ended is None else ended_change))
        last = max([e[5] for e in steps.values()] + ([] if ended is None else [ended_change]), default=now)
        state.setTimeoutDuration(max(1, last + ttl - now))
        if changed:
            out = [(key[0], step, *(steps[step][i] for i in (0, 1, 2, 4))) for step in sorted(changed)]
            yield pd.DataFrame(out, columns=["run_id", "step", "seq", "status", "started", "completed"])

    return update


def settled_status_stream(events: DataFrame, retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """Step status with stragglers closed, from a stream of step entries and run ends (update mode).

    The end of a run is an entry whose step is NULL, with the run's status and finish time. A
    run leaves the state `retention_seconds` after its last change.
    """
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(MISSING)).alias(c.removesuffix("_at"))
    time = lambda c: F.when(F.col(c) != MISSING, F.timestamp_micros(c)).alias(f"{c}_at")
    entries = events.select("run_id", "seq", "step", "status", micros("started_at"), micros("completed_at"))
    return entries.groupBy("run_id").applyInPandasWithState(
        _steps(retention_seconds * 1000), STEP_ROWS, STEP_STATE, "update", "ProcessingTimeTimeout",
    ).select("run_id", "step", "seq", "status", time("started"), time("completed"))


def step_status_stream(events: DataFrame, retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """`step_status` as a stream: run ends are left out."""
    return settled_status_stream(events.filter("step is not null"), retention_seconds)


# --- Single flight --------------------------------------------------------

def _flights(refused_while: tuple[str, str] | None, expire_ms: int | None):
    """One company: which kinds of run are active, since which request, and who joined them.

    A deadline ends a run whose finish does not come: those that wait for it hear `expired`,
    after the rows of the batch. Without deadlines nobody is told, so nobody is noted.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if expire_ms is not None else MISSING
        runs, joined, out = {}, {}, []
        if state.exists:
            kinds, run_seqs, deadlines, joined_kinds, joined_seqs = state.get
            runs = {k: (seq, deadline) for k, seq, deadline in zip(kinds, run_seqs, deadlines)}
            for kind, seq in zip(joined_kinds, joined_seqs):
                joined.setdefault(kind, []).append(seq)
        for kind, seq, action in () if state.hasTimedOut else _in_order(frames, "kind", "seq", "action"):
            active = runs.get(kind)
            if action == "finish":
                runs.pop(kind, None)
                joined.pop(kind, None)
            elif refused_while and kind == refused_while[0] and refused_while[1] in runs:
                out.append((key[0], kind, seq, "refused", None))
            elif active:
                if expire_ms is not None:
                    joined.setdefault(kind, []).append(seq)
                out.append((key[0], kind, seq, "joined", active[0]))
            else:
                runs[kind] = (seq, MISSING if expire_ms is None else now + expire_ms)
                out.append((key[0], kind, seq, "started", seq))
        if expire_ms is not None:
            for kind in [k for k, (_, deadline) in runs.items() if deadline <= now]:
                run, _ = runs.pop(kind)
                out += [(key[0], kind, seq, "expired", run) for seq in (run, *joined.pop(kind, []))]
        if runs:
            waiting = [(kind, seq) for kind, seqs in joined.items() for seq in seqs]
            state.update((
                list(runs), [r for r, _ in runs.values()], [d for _, d in runs.values()],
                [k for k, _ in waiting], [s for _, s in waiting]))
            if expire_ms is not None:
                state.setTimeoutDuration(max(1, min(d for _, d in runs.values()) - now))
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["company_id", "kind", "seq", "outcome", "run_seq"])
            yield found.astype({"seq": "int64", "run_seq": "Int64"})

    return update


def single_flight_stream(
    log: DataFrame, refused_while: tuple[str, str] | None = ("refresh", "assess"), expire_seconds: int | None = None
) -> DataFrame:
    """`single_flight` as a stream (append mode), with the seq of the request that started the run.

    With `expire_seconds` a run ends that long after its start if no finish comes; a request
    after that starts a new one.
    """
    return log.select("company_id", "kind", "seq", "action").groupBy("company_id").applyInPandasWithState(
        _flights(refused_while, None if expire_seconds is None else expire_seconds * 1000),
        FLIGHT_SCHEMA, FLIGHT_STATE, "append", "NoTimeout" if expire_seconds is None else "ProcessingTimeTimeout")


# --- Tail -----------------------------------------------------------------

def event_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 64) -> DataFrame:
    """The event log at `path`, a folder that writers add Parquet files to, as a stream.

    The offsets are those of Spark's file source: what a query has read stands in its
    checkpoint, so a query that starts again goes on behind it.
    """
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").parquet(path)
    )


def tail_stream(events: DataFrame, since: int, runs: DataFrame | None = None) -> DataFrame:
    """Entries after `since`, each once, with the status of their run as it is when they are read."""
    return tail(events, since, runs)
