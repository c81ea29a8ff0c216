"""Best fuzzy match per name, within blocks, on a grid of bounded cells.

Both sides are distinct names. A block larger than one cell is split on both
sides, and every left chunk meets every right chunk in a task of its own, so a
block holding a third of all names is many bounded tasks. Names are compared
inside the task against a prepared column of candidates and only the best one
per left name and cell is emitted: no pair ever becomes a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmloom.functions.similarity import LevenshteinIndex, WRatioIndex
from firmloom.session import cut

CELL_NAMES = 4096
BROADCAST_BLOCKS = 200_000

_BEST = T.StructType([
    T.StructField("block", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

SCORERS = {"wratio": WRatioIndex, "levenshtein": LevenshteinIndex}


def _cell_matcher(scorer: str, floor: float):
    def match_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        candidates = dict(iter(right.sort_values(["block", "ordinal"]).groupby("block", sort=False)))
        for block, names in left.groupby("block", sort=False):
            side = candidates.get(block)
            if side is None:
                continue
            texts, ordinals = side["name"].tolist(), side["ordinal"].tolist()
            index = SCORERS[scorer](texts)
            for name in names["name"]:
                at, score = index.best(name, floor)
                rows.append((block, name, texts[at], ordinals[at], score))
        return pd.DataFrame(rows, columns=[f.name for f in _BEST.fields])

    return match_cell


def _with_chunk(side: DataFrame, sizes: DataFrame, own: str, other: str, cell: int, bins: int) -> DataFrame:
    """Own chunk number by hash, one copy per chunk of the other side."""
    joined = side.join(sizes, "block", "left")
    mine = F.coalesce(F.col(own), F.lit(1))
    theirs = F.coalesce(F.col(other), F.lit(1))
    copies = F.explode(F.sequence(F.lit(0), (theirs - 1).cast("int")))
    joined = joined.withColumn("__mine", F.pmod(F.xxhash64("name"), mine).cast("int")).withColumn(
        "__theirs", copies
    )
    # Small blocks share a cell: one Python call per few thousand names, not per block.
    big = F.col(own).isNotNull()
    return joined.select(
        "block", "name", *[c for c in ("ordinal",) if c in side.columns],
        F.when(big, F.col("block")).otherwise(
            F.pmod(F.xxhash64("block"), F.lit(bins)).cast("string")
        ).alias("__cell"),
        big.alias("__big"),
        F.when(F.lit(own == "n_left"), F.col("__mine")).otherwise(F.col("__theirs")).alias("__l"),
        F.when(F.lit(own == "n_left"), F.col("__theirs")).otherwise(F.col("__mine")).alias("__r"),
    )


def best_matches(
    left: DataFrame,
    right: DataFrame,
    cutoff: float | None = 60.0,
    scorer: str = "wratio",
    cell: int = CELL_NAMES,
) -> DataFrame:
    """Best candidate per (block, name).

    `left`: (block, name), distinct. `right`: (block, name, ordinal), names
    distinct within a block. Ties go to the lowest ordinal.
    """
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / cell)).cast("int")
    blocks = cut(
        left.groupBy("block").agg(F.count(F.lit(1)).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.groupBy("block").agg(F.lit(0).alias("l"), F.count(F.lit(1)).alias("r")))
        .groupBy("block").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .withColumn("large", F.greatest("l", "r") > cell)
    )
    # Only blocks beyond one cell get chunk numbers; at most (names / cell) of them exist.
    sizes = blocks.filter("large").select("block", chunks("l").alias("n_left"), chunks("r").alias("n_right"))
    # As many bins as keep the names of small blocks to about a cell each; a task for each bin and each grid cell.
    counted = blocks.agg(
        F.sum(F.when(~F.col("large"), F.col("l") + F.col("r"))).alias("small"),
        F.sum(F.when(F.col("large"), chunks("l").cast("bigint") * chunks("r"))).alias("cells"),
    ).first()
    least = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(least, -(-(counted.small or 0) // cell))
    tasks = bins + (counted.cells or 0)
    # Broadcast by its counted size: then a block of most names stays where it was read.
    if sizes.count() <= BROADCAST_BLOCKS:
        sizes = F.broadcast(sizes)
    keys = ["__cell", "__big", "__l", "__r"]
    lhs = _with_chunk(left, sizes, "n_left", "n_right", cell, bins)
    rhs = _with_chunk(right, sizes, "n_right", "n_left", cell, bins)
    # Few bytes, much work: a fixed count keeps AQE from merging the cells into one task.
    lhs, rhs = (side.repartition(tasks, *keys) for side in (lhs, rhs))
    found = (
        lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInPandas(
            _cell_matcher(scorer, cutoff or 0.0), _BEST
        )
    )
    best = found.groupBy("block", "name").agg(
        F.max_by(
            F.struct("match", "ordinal", "score"), F.struct(F.col("score"), -F.col("ordinal"))
        ).alias("b")
    ).select("block", "name", "b.match", "b.ordinal", "b.score")
    return best if cutoff is None else best.filter(F.col("score") >= cutoff)
