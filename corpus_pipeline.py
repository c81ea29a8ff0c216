"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality: rows that the classifier rejects go.
2. near_duplicates: of each group of texts linked by a similarity of 0.8 or more in
   shingles of five words the row of the smallest id stays.
3. decontamination: documents in which a benchmark window occurs go.
4. mixing: each document stays as often as the mix takes it, that is 0, 1 or 2 times.
5. sharding: the rows get their shard and slot.

All stages but the last keep the columns of the table, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firmloom.llm.common import stage, table
from firmloom.llm.decontamination import remove_contaminated
from firmloom.llm.jaccard_join import JaccardJoin
from firmloom.llm.mixing import take_mix
from firmloom.llm.quality import keep_good
from firmloom.llm.sharding import shard_rows

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return JaccardJoin(docs, n=5, percent=80).keep_one()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs, [1.0] * SHARDS)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing), ("sharding", sharding),
]

# The classifier is trained; SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
