"""Model-written JSON: salvage, required keys, misplaced fields, lenient columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.functions.text import col

PATHLESS = "map<string,string>"


def parse_json_column(text: Column | str, schema: str, default: Column | None = None) -> Column:
    """Stored JSON text as `schema`; malformed or missing text gives `default`."""
    parsed = F.when(F.try_parse_json(col(text)).isNotNull(), F.from_json(col(text), schema))
    return F.coalesce(parsed, default) if default is not None else parsed


def _informative_object(candidate: Column) -> Column:
    """Whether text is a JSON object with at least one value that is not blank or "..."."""
    fields = F.when(F.try_parse_json(candidate).isNotNull(), F.from_json(candidate, PATHLESS))
    value = lambda v: F.trim(F.coalesce(v, F.lit("")))
    return F.coalesce(
        candidate.startswith("{")
        & F.exists(F.map_values(fields), lambda v: ~value(v).isin("", "...", "null")),
        F.lit(False),
    )


def salvage_json(response: Column | str) -> Column:
    """JSON object text inside a model response, NULL when there is none.

    Tried in order: the whole text, a fenced block, the innermost brace
    blocks, the outermost brace block. Objects whose every value is blank are
    taken for an echoed template and passed over.
    """
    text = F.trim(F.coalesce(col(response), F.lit("")))
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    inner = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tried = F.concat(F.array(text, fenced), inner, F.array(outer))
    return F.get(F.filter(tried, _informative_object), 0)


def has_required(document: Column | str, keys: list[str], kind: str = "string") -> Column:
    """Whether every key holds a value: a non-blank string, or (kind="array") a non-empty list."""
    variant = F.try_parse_json(col(document))
    checks = []
    for key in keys:
        if kind == "array":
            checks.append(F.size(F.try_variant_get(variant, f"$.{key}", "array<variant>")) > 0)
        else:
            value = F.try_variant_get(variant, f"$.{key}", "variant")
            text = F.try_variant_get(variant, f"$.{key}", "string")
            is_text = F.schema_of_variant(value) == "STRING"
            checks.append(is_text & (F.trim(text) != ""))
    ok = checks[0]
    for check in checks[1:]:
        ok = F.coalesce(ok, F.lit(False)) & F.coalesce(check, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def _empty_to_null(raw: Column) -> Column:
    return F.when(~F.trim(raw).isin("", "[]", "{}", "null", '""'), raw)


def hoist_misplaced(document: Column | str, fields: list[str] = L.NARRATIVE_FIELDS) -> Column:
    """Struct of narrative fields (raw JSON text), each taken from contacts[0] when the top level is empty."""
    doc = col(document)
    return F.struct(*[
        F.coalesce(
            _empty_to_null(F.get_json_object(doc, f"$.{f}")),
            _empty_to_null(F.get_json_object(doc, f"$.contacts[0].{f}")),
        ).alias(f)
        for f in fields
    ])
