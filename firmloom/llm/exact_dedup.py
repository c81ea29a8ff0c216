"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition is one run: its digests, sorted, one entry for each distinct
text. In each round `fan_in` neighbouring runs are merged into one (with fan_in 2
the classic binomial exchange); a merge keeps, per digest, the best row and the
count. A group's rows meet as one entry a run, so a text that fills a third of the
table is no hot key. Entries of a round are dealt by (run, digest), so no task
gets a whole run. On the way back the result reaches the rows through the same runs.

Texts are equal if they agree after the characters of `[\\x20\\x09-\\x0D]` are
deleted. Entries merge only if SHA-256, length and CRC-32 of that text agree.

Defined cases: a null text is empty; all empty texts are one group. Of equal texts
the row with most code points stays, then the smallest id; a null id comes after
all others, and of fully repeated rows one stays. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import BLANKS, attach, stage, text_of

KEY = ["digest", "bare_chars", "check"]


def digest_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One narrow row per document: id, digest of the bare text, its run; written once."""
    texts = docs.select(
        F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
    )
    bare = texts.withColumn("bare", F.regexp_replace("text", BLANKS, ""))
    return stage(bare.select(
        "doc_id", "run", "row", F.length("text").alias("chars"),
        F.unhex(F.sha2("bare", 256)).alias("digest"), F.length("bare").alias("bare_chars"),
        F.crc32(F.col("bare").cast("binary")).alias("check"),
    ), "digests")


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """digest key -> best row and group size, merged round by round."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        runs = -(-runs // fan_in)
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too."""
    rows = digest_rows(docs, id_column, text_column)
    merged = merge_runs(rows, fan_in)
    return attach(rows, merged, KEY, "run").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
