"""Assessments as a stream: guards, routing, and two sinks per micro-batch."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom.operators.guards import Guard, run_guards, storage_route
from firmloom.operators.upsert import record_rejection, replace_enrichment
from firmloom.session import cut
from firmloom.sources.sinks import BUCKETS, Pointer, pointers, read_pointer, touched_buckets, write_buckets

log = logging.getLogger(__name__)


def assess_batch(batch: DataFrame, guards: list[Guard], mode: str = "warn") -> DataFrame:
    """Batch of assessments with verdict and route columns and an outcome."""
    judged = run_guards(batch, guards)
    verdicts = judged.withColumns({
        "guard_passed": F.col("guard_report.passed"),
        "guard_score": F.col("guard_report.score"),
        "guard_failures": F.col("guard_report.failures"),
        "has_verdict": F.lit(True),
    })
    return storage_route(verdicts, mode).withColumn(
        "outcome", F.when(F.col("stored"), "enriched").otherwise("rejected")
    )


def _before_batch(spark: SparkSession, root: str, table: str, run: str, batch_id: int) -> tuple[Pointer | None, bool]:
    """The version this batch starts from, the same one when the batch is replayed, and whether it has been written.

    A stream's first batch starts from the table as it is. A batch whose predecessor
    is missing, or that comes after later ones of its run, is an error: the
    checkpoint and the table do not belong together.
    """
    known = pointers(spark, root, table)
    mine = {p.version: p for p in known if p.version.startswith(f"{run}-")}
    if any(int(v.rsplit("-", 1)[1]) > batch_id for v in mine):
        raise RuntimeError(f"{table}: run {run} is past batch {batch_id}; a reset checkpoint needs a new run name")
    by_number = {p.number: p for p in known}
    again = mine.get(f"{run}-{batch_id}")
    if again is not None:
        if again.base and again.base not in by_number:
            raise RuntimeError(f"{table}: the version before {again.version} is gone")
        return (by_number[again.base] if again.base else None), True
    if batch_id and f"{run}-{batch_id - 1}" not in mine:
        raise RuntimeError(f"{table}: run {run} has no batch {batch_id - 1}")
    return (known[-1] if known else None), False


def assess_sink(
    root: str, run: str, guards: list[Guard], mode: str = "warn", on_audit: Callable[[DataFrame], None] | None = None,
    buckets: int = BUCKETS,
):
    """foreachBatch function writing enrichment, rejections and outcomes under `root`.

    Versions are named by run and batch: a replay starts from the same predecessor as the
    first attempt and writes only what that did not commit. Each is committed against its
    predecessor and writes only the buckets of the batch's companies. `on_audit` may fail
    without changing outcomes.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {t: _before_batch(spark, root, t, run, batch_id) for t in ("enrichment", "assessment_rejections")}
        routed = cut(assess_batch(batch, guards, mode))
        text = routed.withColumn("guard_failures", F.to_json("guard_failures"))
        touched = {t: touched_buckets(routed, "company_id", p, buckets) for t, (p, _) in before.items()}
        enrichment, rejections = (read_pointer(spark, root, t, p, touched[t]) for t, (p, _) in before.items())
        refused = text.filter(~F.col("stored")).select(
            "company_id", "ordinal", F.col("route_reason").alias("reason"), "guard_failures", "guard_score",
            "llm_model", F.col("generated_at").alias("rejected_at"),
        )
        stored, cleared = replace_enrichment(enrichment, rejections, text.filter("stored"))
        # A company both stored and refused in one batch keeps what came last.
        last_stored = text.filter("stored").groupBy("company_id").agg(F.max("ordinal").alias("stored_at"))
        late = refused.join(last_stored, "company_id", "left").filter(
            "stored_at is null or ordinal > stored_at"
        ).drop("stored_at")
        for table, rows in (("enrichment", stored), ("assessment_rejections", record_rejection(cleared, late))):
            start, written = before[table]
            if not written:
                write_buckets(rows, root, table, f"{run}-{batch_id}", start, "company_id", touched[table], buckets)
        outcomes = routed.select("company_id", "ordinal", "outcome", "route_reason")
        outcomes.write.mode("overwrite").parquet(f"{root}/outcomes/run={run}/batch={batch_id}")
        if on_audit is not None:
            try:
                on_audit(outcomes)
            except Exception:  # noqa: BLE001 - the audit never decides an outcome
                log.exception("audit of batch %s of run %s failed", batch_id, run)

    return write


def assess_stream(assessments: DataFrame, root: str, checkpoint: str, guards: list[Guard], mode: str = "warn"):
    """Writer of the streaming query; call `start()` on it. A checkpoint folder is one run."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (
        assessments.writeStream.foreachBatch(assess_sink(root, run, guards, mode))
        .option("checkpointLocation", checkpoint)
    )
