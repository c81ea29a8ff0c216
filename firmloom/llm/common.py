"""Shared helpers of the pipeline operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom.session import checkpoint_dir, configure

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one attempt, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/firmloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later steps re-read files instead of recomputing, so partition numbers and row
    ids keep their values when an executor is lost, and the reader knows the size.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text; a null is an empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if it was counted to have at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(columns: list[str], name: str) -> str:
    """`name`, or a longer one if one of `columns` is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"found_{name}"
    return name


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Identity of a row by its content; rows that repeat id and text share it."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), text_of(text_column)))


def without(docs: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of `docs` whose row_key is not in `keys`; broadcast if these were counted to be few."""
    name = free_name(docs.columns, "key")
    few = broadcast_if_small(keys.select(F.col("key").alias(name)))
    return docs.join(few, row_key(id_column, text_column) == F.col(name), "left_anti")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], salt: str, how: str = "inner") -> DataFrame:
    """Join `rows` with `groups` (one row a key) so that a hot key spreads over the salts.

    The group's columns go to the distinct (key, salt) pairs first, at most one for
    each salt, and from there to the rows of that pair. Keys must not be null.
    """
    cells = rows.select(*keys, salt).distinct().join(groups, keys, how)
    return rows.join(cells, [*keys, salt], how)
