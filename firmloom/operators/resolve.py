"""Entity resolution of register firms against a company registry snapshot.

The cascade is number, then folded name, then best fuzzy name; each stage only
sees what the ones before left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.functions.text import blank_to_null, first_token, fold_id, fold_legal_name
from firmloom.operators.fuzzy import best_matches
from firmloom.session import cut

MERGE_SCORE, REVIEW_SCORE = 85.0, 60.0
# Company column filled from the snapshot column.
MERGED = {
    "cro_number": "company_num",
    "cro_status": "company_status",
    "incorporation_date": "company_reg_date",
    "company_type": "company_type",
    "last_annual_return": "last_ar_date",
    "last_accounts_date": "last_accounts_date",
    "principal_object": "princ_object_code",
}
NORMAL = "normal"


def _payload() -> Column:
    return F.struct("company_name", *MERGED.values(), "ordinal").alias("hit")


def snapshot_by_number(snapshot: DataFrame) -> DataFrame:
    """One row per folded company number; the last row in file order wins."""
    keyed = snapshot.withColumn("number_key", fold_id("company_num")).filter("number_key <> ''")
    return keyed.groupBy("number_key").agg(F.max_by(_payload(), "ordinal").alias("hit"))


def snapshot_by_name(snapshot: DataFrame) -> DataFrame:
    """One row per folded company name; the last row in file order wins."""
    keyed = snapshot.withColumn("name_key", fold_legal_name("company_name")).filter("name_key <> ''")
    return keyed.groupBy("name_key").agg(
        F.max_by(_payload(), "ordinal").alias("hit"), F.min("ordinal").alias("first_ordinal")
    )


def _spread(key: Column, ordinal: str = "ordinal") -> Column:
    """Join key that scatters missing values instead of sending them all to one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.col(ordinal).cast("string")))


def match_by_number(register: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Register rows with `number_hit`, the snapshot row of the same company number."""
    numbers = snapshot_by_number(snapshot).withColumnRenamed("hit", "number_hit")
    key = F.nullif(fold_id("cro_number"), F.lit(""))
    return (
        register.withColumn("number_key", _spread(key))
        .join(numbers, "number_key", "left").drop("number_key")
    )


def match_by_name(register: DataFrame, snapshot: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Register rows with `name_hit`, the snapshot row of the same folded name.

    Rows that already carry a `number_hit` are left alone.
    """
    names = snapshot_by_name(snapshot) if names is None else names
    names = names.select("name_key", F.col("hit").alias("name_hit"))
    key = F.nullif(fold_legal_name("legal_name"), F.lit(""))
    if "number_hit" in register.columns:
        key = F.when(F.col("number_hit").isNull(), key)
    return (
        register.withColumn("name_key", _spread(key))
        .join(names, "name_key", "left").drop("name_key")
    )


def match_fuzzy(
    residue: DataFrame, names: DataFrame, cutoff: float = REVIEW_SCORE, scorer: str = "wratio"
) -> DataFrame:
    """Best registry name per distinct folded name: (name, match, ordinal, score).

    Candidates share the first token; a name whose first token no candidate has
    is compared with every name.
    """
    wanted = cut(residue.select("name").distinct().withColumn("block", first_token("name")))
    pool = names.select(
        F.col("name_key").alias("name"),
        F.col("first_ordinal").alias("ordinal"),
        first_token("name_key").alias("block"),
    )
    blocks = pool.select("block").distinct()
    alone = cut(wanted.join(blocks, "block", "left_anti"))
    near = pool.join(wanted.select("block").distinct(), "block", "left_semi")
    left = wanted.join(alone, "name", "left_anti").select("block", "name")
    right = near.select("block", "name", "ordinal")
    if not alone.isEmpty():
        everyone = F.lit("").alias("block")
        left = left.unionByName(alone.select(everyone, "name"))
        right = right.unionByName(pool.select(everyone, "name", "ordinal"))
    return best_matches(left, right, cutoff, scorer).drop("block")


def resolve(register: DataFrame, snapshot: DataFrame, scorer: str = "wratio") -> DataFrame:
    """Register rows with the registry fields of their match and how it was found.

    `register` has (ordinal, legal_name, cro_number, ...), `snapshot` the
    registry columns and `ordinal`. Adds the seven registry fields,
    match_confidence, needs_review, match_method, near_miss and degraded.
    """
    degraded = snapshot.isEmpty()
    names = cut(snapshot_by_name(snapshot))
    exact = match_by_name(match_by_number(register, snapshot), snapshot, names)
    hit = F.coalesce("number_hit", "name_hit")
    folded = F.nullif(fold_legal_name("legal_name"), F.lit(""))
    exact = cut(exact.withColumn("name", _spread(F.when(hit.isNull(), folded))))
    residue = exact.filter(hit.isNull() & folded.isNotNull()).select("name")
    fuzzy = (
        match_fuzzy(residue, names, scorer=scorer)
        .join(names.select(F.col("name_key").alias("match"), F.col("hit").alias("fuzzy_hit")), "match")
        .select("name", "match", "score", "fuzzy_hit")
    )
    joined = exact.join(fuzzy, "name", "left").drop("name")

    merged = F.col("score") >= MERGE_SCORE
    source = F.coalesce("number_hit", "name_hit", F.when(merged, F.col("fuzzy_hit")))
    exactly = hit.isNotNull()
    columns = {
        target: blank_to_null(source[column].cast("string")) for target, column in MERGED.items()
    }
    return joined.select(
        *[F.col(c) for c in register.columns if c not in MERGED],
        *[value.alias(target) for target, value in columns.items()],
        F.round(
            F.when(exactly, 1.0).otherwise(F.coalesce(F.col("score") / 100, F.lit(0.0))), 4
        ).alias("match_confidence"),
        (~(exactly | F.coalesce(merged, F.lit(False)))).alias("needs_review"),
        F.when(F.lit(degraded), "no_cro_snapshot")
        .when(F.col("number_hit").isNotNull(), "exact_cro_number")
        .when(F.col("name_hit").isNotNull(), "exact_normalized_name")
        .when(merged, "fuzzy_name")
        .when(F.col("score").isNotNull(), "fuzzy_name_low_confidence")
        .otherwise("no_match").alias("match_method"),
        F.when(~exactly & ~merged, F.col("fuzzy_hit.company_name")).alias("near_miss"),
        F.lit(degraded).alias("degraded"),
    )
