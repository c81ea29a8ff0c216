"""Mix sources to target weights by weighted fair queueing.

Targets: the sources, ordered by code point with null last, take the given weights
in turn and share `share` times all words. A target ends at `repeats` times its
source's words; the excess goes to the others by weight until none is above its end.

Queue: a source's documents stand in the order of a hash of their id, `repeats`
rounds one after the other. A copy's virtual finish time is the number of words of
its source up to and with it, divided by the source's target. All copies are
range-sorted by finish time and taken while their running total is within the
budget, the sum of the targets. Sources with the same finish time so far have the
same part of their targets, hence each ends within a document of its own.

Running totals are taken along range partitions (operators/ordered.py): a source
with a third of all rows is summed by many tasks.

Defined cases: a null text has size 0; a null source is a source; rows without words
take 0; ties of the hash go by id, size and row; repeated rows queue on their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import WORDS, free_name, stage, text_of
from firmloom.operators.ordered import running_sum


def word_count(text_column: str = "text"):
    return F.regexp_count(text_of(text_column), F.lit(WORDS)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """`sizes` (source, source_size) with weight and target.

    Each step fixes the sources whose end lies below the level that the rest would
    get; it ends when a step fixes no more. One row comes to the driver per step.
    """
    ranked = running_sum(
        sizes.withColumn("no_source", F.col("source").isNull()), [], ["no_source", "source"], F.lit(1).cast("bigint"), "rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = stage(
        ranked.withColumn("weight", turn).withColumn("end", F.col("source_size") * repeats).drop("rank", "no_source"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = -1.0, -1
    while True:
        full = F.col("end") / F.col("weight") <= F.lit(level)
        step = sources.agg(
            F.sum(full.cast("bigint")).alias("full"), F.sum(F.when(full, F.col("end")).otherwise(0)).alias("ends"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if step.full is None or step.full == full_before or not step.open:
            break
        full_before, level = step.full, (share * total - step.ends) / step.open
    return sources.withColumn(
        "target", F.when(F.col("end") / F.col("weight") <= F.lit(level), F.col("end").cast("double"))
        .otherwise(F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and the columns of `keep`."""
    rows = stage(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).alias("draw"),
        F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    ), "queue")
    sources = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    queued = running_sum(
        rows.select("source", "draw", "doc_id", "size", "row"), ["source"], ["draw", "doc_id", "size", "row"],
        F.col("size"), "upto",
    )
    targets = sources.select(F.col("source").alias("of"), "source_size", "target")
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = (
        queued.filter("size > 0")
        .withColumn("round", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(repeats)])))
        .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("upto")) / F.col("target"))
        .select("finish", "draw", "doc_id", "row", "round", "size")
    )
    ordered = running_sum(copies, [], ["finish", "draw", "doc_id", "row", "round"], F.col("size"), "total")
    taken = (
        ordered.filter(F.col("total") <= F.lit(budget)).groupBy("row").agg(F.sum("size").alias("taken"))
    )
    out = queued.select("row", "source_size", "target").join(taken, "row", "left")
    return rows.join(out, "row").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        *[F.col(f"kept_{c}").alias(c) for c in keep])


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their columns, each as often as the mix takes it."""
    columns, name = docs.columns, free_name(docs.columns, "whole")
    mixed = mix(docs.withColumn(name, F.struct(*[F.col(f"`{c}`") for c in columns])), keep=(name,), **options)
    taken = mixed.filter("taken > 0").select(
        F.col(name).alias("whole"), F.explode(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))))
    return taken.select(*[F.col("whole").getField(c).alias(c) for c in columns])
