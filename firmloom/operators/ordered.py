"""Running values along an order, without putting one key into one task.

A window over a hot key would sort all of its rows in a single task. Here rows
are range-partitioned on (keys, order), so a hot key spreads over many
partitions; each partition is scanned on its own and only one summary row per
(key, partition) travels further. The range-partitioned rows are written to the
checkpoint folder first: partition numbers must not change when a task is rerun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmloom.session import cut

_CHUNK = "__chunk"


def _chunked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*keys, *order).withColumn(_CHUNK, F.spark_partition_id()))


def _combine(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    on = [rows[k].eqNullSafe(totals[k]) for k in keys] + [rows[_CHUNK] == totals[_CHUNK]]
    joined = rows.join(totals, on, "left")
    for k in keys:
        joined = joined.drop(totals[k])
    return joined.drop(totals[_CHUNK])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add `name`: sum of `value` over this and all earlier rows of the key."""
    rows = _chunked(df.withColumn("__v", value), keys, order)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, _CHUNK).agg(F.sum("__v").alias("__t"))
        .withColumn("__base", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    )
    local = rows.withColumn("__local", F.sum("__v").over(within))
    return (
        _combine(local, totals, keys)
        .withColumn(name, F.col("__local") + F.col("__base"))
        .drop("__v", "__local", "__base", _CHUNK)
    )


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the last non-null `value` among the strictly earlier rows of the key."""
    rows = _chunked(df.withColumn("__v", value), keys, order)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])
    totals = (
        rows.groupBy(*keys, _CHUNK)
        .agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), at)).alias("__t"))
        .withColumn("__base", F.last("__t", ignorenulls=True).over(before)).drop("__t")
    )
    local = rows.withColumn("__local", F.last("__v", ignorenulls=True).over(within))
    return (
        _combine(local, totals, keys)
        .withColumn(name, F.coalesce("__local", "__base"))
        .drop("__v", "__local", "__base", _CHUNK)
    )
