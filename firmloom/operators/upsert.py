"""Table maintenance: each function turns a snapshot and a batch into the next snapshot.

Batches carry an `ordinal`, the row order of their source. Where several batch
rows meet one key, aggregates pick the first or last value by ordinal, so hot
keys combine before the shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmloom.functions.text import blank_to_null, fold_legal_name
from firmloom.operators import identity
from firmloom.session import kept

COALESCED = [
    "cbi_reference", "cro_number", "trading_name", "cro_status", "incorporation_date",
    "registered_address", "county", "eircode", "company_type", "last_annual_return",
    "last_accounts_date", "principal_object",
]
KEPT = ["id", "legal_name", "legal_name_normalized", "sector_tag", "source", "ingested_at"]
CONTACT_COALESCED = ["role_title", "email", "phone", "confidence_score"]
BEFORE = -1


def derived_id(*parts: Column) -> Column:
    """Row id that a retried task derives again unchanged."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _last_value(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ordinal"))).alias(name)


def _first_value(name: str) -> Column:
    return F.min_by(name, "ordinal").alias(name)


def last_per_key(batch: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "ordinal").alias("r")
    ).select(*keys, *[f"r.{c}" for c in rest])


def replace_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows whose key the incoming rows do not have, and the incoming rows."""
    kept = current.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*current.columns).unionByName(
        incoming.select(*current.columns)
    )


# --- Companies -------------------------------------------------------------

class Upserted(NamedTuple):
    companies: DataFrame
    outcomes: DataFrame


def _name_key(normalized: Column, legal_name: Column) -> Column:
    return F.coalesce(
        F.nullif(normalized, F.lit("")),
        F.nullif(fold_legal_name(legal_name), F.lit("")),
        F.concat(F.lit("="), legal_name),
    )


def upsert_companies(current: DataFrame, batch: DataFrame, chunk_rows: int = 100_000) -> Upserted:
    """Fold a register batch into the company table, in batch order.

    Returns the new snapshot and one outcome per batch row (ordinal,
    company_id, is_new).
    """
    name = F.col("legal_name")
    existing = current.withColumn("name", _name_key(F.col("legal_name_normalized"), name))
    first_id = existing.groupBy("name").agg(F.min("id").alias("id")).withColumn("leads", F.lit(True))
    # A second company of the same name can only be met through its number.
    existing = existing.join(first_id, ["name", "id"], "left").withColumn(
        "owner", F.when(F.col("leads"), F.col("name")).otherwise(F.concat(F.lit("#"), F.col("id")))
    ).drop("leads", "name")
    rows = batch.withColumns({
        "cro_number": blank_to_null("cro_number"),
        "name": _name_key(F.lit(None).cast("string"), name),
    })
    # Three joins below read the owners; the fold must run once.
    assigned = kept(identity.owners(
        rows.select("ordinal", "name", F.col("cro_number").alias("number")),
        existing.select(F.col("owner").alias("name"), F.col("cro_number").alias("number")),
        chunk_rows,
    ))
    columns = [f.name for f in current.schema.fields]
    incoming = rows.drop("name").join(assigned, "ordinal").withColumns({
        "id": derived_id(F.lit("company"), F.col("owner")),
        "legal_name_normalized": fold_legal_name(name),
    })
    owners = assigned.select("owner").distinct()
    touched = existing.join(owners, "owner", "left_semi").withColumn("ordinal", F.lit(BEFORE).cast(batch.schema["ordinal"].dataType))
    untouched = existing.join(owners, "owner", "left_anti")
    # What the batch has no column for can only come from the company: it does not travel with the rows.
    shared = [c for c in columns if c in incoming.columns]
    absent = [c for c in columns if c not in shared]
    merge = lambda of: [
        *[_last_value(c) for c in COALESCED if c in of], *[_first_value(c) for c in KEPT if c in of],
        *[F.max_by(F.struct(c), "ordinal")[c].alias(c) for c in ("raw_payload",) if c in of],
    ]
    together = touched.select("owner", "ordinal", *shared).unionByName(incoming.select("owner", "ordinal", *shared))
    merged = together.groupBy("owner").agg(*merge(shared))
    if absent:
        merged = merged.join(touched.groupBy("owner").agg(*merge(absent)), "owner", "left")
    companies = untouched.select(*columns).unionByName(merged.select(*columns))
    first = together.groupBy("owner").agg(
        F.min("ordinal").alias("first_ordinal"), _first_value("id").alias("company_id")
    )
    outcomes = assigned.join(first, "owner").select(
        "ordinal", "company_id", (F.col("ordinal") == F.col("first_ordinal")).alias("is_new")
    )
    return Upserted(companies, outcomes)


def upsert_contacts(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge contacts on (company_id, full_name); a contact without a name is always added."""
    columns = current.columns
    missing = [c for c in columns if c not in batch.columns and c != "id"]
    incoming = batch.withColumns(
        {c: F.lit(None).cast(current.schema[c].dataType) for c in missing}
    ).withColumn("id", derived_id(
        F.lit("contact"), F.col("company_id"),
        F.coalesce("full_name", F.concat(F.lit("#"), F.col("ordinal").cast("string"))),
    ))
    both = current.withColumn("ordinal", F.lit(BEFORE).cast("long")).unionByName(
        incoming.select(*columns, "ordinal")
    )
    named = both.filter("full_name is not null").groupBy("company_id", "full_name").agg(
        *[_last_value(c) for c in CONTACT_COALESCED],
        *[_first_value(c) for c in columns if c not in ("company_id", "full_name", *CONTACT_COALESCED)],
    )
    return named.select(*columns).unionByName(both.filter("full_name is null").select(*columns))


# --- Assessments, rejections, drafts --------------------------------------

def clear_rejection(rejections: DataFrame, stored: DataFrame) -> DataFrame:
    return rejections.join(stored.select("company_id").distinct(), "company_id", "left_anti").select(
        *rejections.columns
    )


def replace_enrichment(
    enrichment: DataFrame, rejections: DataFrame, batch: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Store one assessment per company and clear the company's rejection.

    `has_verdict` tells a missing verdict (stored as false) from an explicit
    NULL (guards skipped, stored as NULL).
    """
    newest = last_per_key(batch, ["company_id"])
    verdict = F.when(F.col("has_verdict"), F.col("guard_passed")).otherwise(F.lit(False))
    defaults = {
        "signal_strength": "low", "billing_pain_points": "[]", "guard_failures": "[]",
        "assessment_breakdown": "{}", "narrative_assessment": "{}",
    }
    prepared = newest.withColumn("guard_passed", verdict)
    for c in enrichment.columns:
        if c == "id":
            prepared = prepared.withColumn(c, derived_id(F.lit("enrichment"), F.col("company_id")))
        elif c not in prepared.columns:
            prepared = prepared.withColumn(c, F.lit(None).cast(enrichment.schema[c].dataType))
        if c in defaults:
            prepared = prepared.withColumn(c, F.coalesce(F.col(c), F.lit(defaults[c])))
    stored = replace_rows(enrichment, prepared, ["company_id"])
    return stored, clear_rejection(rejections, prepared)


def record_rejection(rejections: DataFrame, batch: DataFrame) -> DataFrame:
    """Keep the latest rejection of each company."""
    return replace_rows(rejections, last_per_key(batch, ["company_id"]), ["company_id"])


def replace_draft(emails: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace the draft email of each company in the batch; sent emails stay."""
    drafts = last_per_key(batch, ["company_id"])
    incoming = drafts.withColumns({
        "status": F.lit("draft"), "id": derived_id(F.lit("draft"), F.col("company_id")),
    })
    for c in emails.columns:
        if c not in incoming.columns:
            incoming = incoming.withColumn(c, F.lit(None).cast(emails.schema[c].dataType))
    return replace_rows(emails, incoming, ["company_id", "status"])


def patch_contacts(enrichment: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set the `contacts` key of the newest assessment document of each patched company.

    `patches`: (company_id, contacts JSON text), one per company. Returns the
    snapshot and (company_id, patched), false where there is no assessment.
    """
    ids = enrichment.join(patches.select("company_id"), "company_id", "left_semi").groupBy("company_id").agg(
        F.max_by("id", F.struct("generated_at", "id")).alias("id")
    )
    change = ids.join(patches, "company_id").select("id", F.col("contacts").alias("__contacts"))
    entries = "map<string,variant>"
    document = F.from_json(F.coalesce("narrative_assessment", F.lit("{}")), entries)
    kept = F.map_filter(F.coalesce(document, F.create_map().cast(entries)), lambda k, _: k != "contacts")
    patched = F.to_json(F.map_concat(kept, F.create_map(F.lit("contacts"), F.try_parse_json("__contacts"))))
    snapshot = enrichment.join(change, "id", "left").withColumn(
        "narrative_assessment",
        F.when(F.col("__contacts").isNotNull(), patched).otherwise(F.col("narrative_assessment")),
    ).select(*enrichment.columns)
    done = patches.select("company_id").join(
        ids.select("company_id", F.lit(True).alias("patched")), "company_id", "left"
    ).withColumn("patched", F.coalesce("patched", F.lit(False)))
    return snapshot, done


def replace_run(runs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace ingestion runs by id."""
    return replace_rows(runs, incoming, ["id"])


# --- Schema ---------------------------------------------------------------

def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns `schema` has and the table lacks; fill in missing folded names."""
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    if "legal_name_normalized" in schema.names:
        folded = F.nullif(fold_legal_name("legal_name"), F.lit(""))
        df = df.withColumn("legal_name_normalized", F.coalesce("legal_name_normalized", folded))
    return df


def typed_export(
    df: DataFrame,
    timestamps: list[str] = (),
    booleans: list[str] = (),
    smallints: list[str] = (),
    documents: list[str] = (),
) -> DataFrame:
    """Text columns as timestamp, boolean, smallint and JSON; bad values become NULL."""
    changes = {c: F.try_to_timestamp(F.col(c)) for c in timestamps}
    changes |= {c: F.col(c).try_cast("boolean") for c in booleans}
    changes |= {c: F.col(c).try_cast("smallint") for c in smallints}
    changes |= {c: F.try_parse_json(F.col(c)) for c in documents}
    return df.withColumns(changes) if changes else df
