"""Register ingestion: scan, resolve, upsert, audit."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom import schemas
from firmloom.operators.leads import ingest_counts
from firmloom.operators.resolve import resolve
from firmloom.operators.upsert import replace_run, upsert_companies
from firmloom.session import cut
from firmloom.sources.delimited import scan_register, scan_snapshot
from firmloom.sources.sinks import newest, raw_payload, read_pointer, run_audit, update_snapshot, write_snapshot


def ingest(current: DataFrame, register: DataFrame, snapshot: DataFrame, source: str, at) -> tuple[DataFrame, DataFrame]:
    """New company snapshot and one outcome per register row."""
    resolved = cut(resolve(register, snapshot))
    ready = resolved.withColumns({
        "raw_payload": raw_payload(resolved.columns),
        "source": F.lit(source),
        "ingested_at": F.lit(at).cast("timestamp"),
    })
    done = upsert_companies(current, ready)
    outcomes = done.outcomes.join(resolved.select("ordinal", "match_method", "needs_review"), "ordinal")
    return done.companies, outcomes


def run_ingestion(
    spark: SparkSession, register_path: str, snapshot_path: str | None, root: str, run_id: str, source: str = "register"
) -> DataFrame:
    """Ingest one register file into the tables under `root`; returns the run's audit row.

    A register that cannot be read is a run with no records. A missing or empty
    registry snapshot is an error of the run, and every firm is kept for review. Companies
    are committed against the version they were made from: `LostRace` if another run came between.
    """
    started = datetime.now(timezone.utc)
    errors: list[str] = []
    try:
        register = scan_register(spark, register_path)
        register.isEmpty()
    except Exception as error:  # noqa: BLE001 - recorded in the audit row
        errors.append(f"register not read: {type(error).__name__}")
        register = None
    snapshot, degraded = None, True
    if register is not None and snapshot_path is not None:
        try:
            snapshot, degraded = scan_snapshot(spark, snapshot_path)
        except Exception as error:  # noqa: BLE001
            errors.append(f"registry snapshot not read: {type(error).__name__}")
    if register is not None and degraded:
        errors.append("no registry snapshot")
        snapshot = spark.createDataFrame([], "ordinal long, " + ", ".join(
            f"{c} string" for c in schemas.REGISTRY_SNAPSHOT.names))

    found = new = 0
    if register is not None:
        base = newest(spark, root, "companies")
        companies, outcomes = ingest(read_pointer(spark, root, "companies", base), register, snapshot, source, started)
        outcomes = cut(outcomes)
        counts = ingest_counts(outcomes).first()
        found, new = counts.records_found, counts.records_new
        write_snapshot(companies, root, "companies", run_id, base.number if base else 0)
    audit = run_audit(spark, run_id, source, started, datetime.now(timezone.utc), found, new, errors)
    update_snapshot(spark, root, "ingestion_runs", run_id, lambda runs: replace_run(runs, audit))
    return audit
