"""Weighted rendezvous hashing of record keys over shards.

Each key draws one number u in (0, 1) for each shard and goes to the shard with the
smallest -ln(u) / weight. The draw for a shard depends on nothing but the key and
that shard, so a further shard takes rows only into itself, about its share of the
weights, and all other rows stay. The work per row is one MD5 for each shard.

Slots number the rows of a shard from 0 in the order of key, checksum and size.
They come from a running count along a range partitioning, so that a shard of any
size is numbered by many tasks.

Defined cases: a null text has no bytes and checksum 0; rows with a null key are
all of one key, as are rows that repeat a key, and share a shard; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import text_of
from firmloom.operators.ordered import running_sum

DRAWS = 2**52


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide: 13 hexadecimal digits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(DRAWS))


def choose_shard(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(cost, shard) of the shard that wins the key; ties go to the lower number."""
    costs = [
        F.struct((-F.log(draw(key, first + i)) / F.lit(float(w))).alias("cost"), F.lit(first + i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return costs[0] if len(costs) == 1 else F.array_min(F.array(*costs))


def shard_rows(
    docs: DataFrame, weights: list[float], grown_weight: float = 1.0,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    `weights` has one positive number a shard. grown_shard is the shard of the row if
    one more shard of `grown_weight` is added.
    """
    text = text_of(text_column)
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    rows = (
        docs.select(
            F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), choose_shard(key, weights).alias("won"),
            choose_shard(key, [grown_weight], len(weights)).alias("new"),
        )
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("won.shard").alias("shard"),
            F.when(F.col("new") < F.col("won"), F.col("new.shard")).otherwise(F.col("won.shard")).alias("grown_shard"),
        )
    )
    counted = running_sum(rows, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(1).cast("bigint"), "slot")
    return counted.select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")
