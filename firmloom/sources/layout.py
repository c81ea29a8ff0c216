"""Registers laid out on pages: positioned words and table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.functions.text import blank_to_null, parse_register_date
from firmloom.operators.ordered import running_sum

HEADER_WORDS = ["ref no", "reference", "firm name", "intermediary", "name"]
SLACK = 0.5


def column_at(x0: Column, columns: list[tuple[str, float]]) -> Column:
    """Of (name, left edge) pairs from left to right, the one whose left edge is the greatest at or before x0 (+0.5); the first one if none is."""
    found = F.lit(columns[0][0])
    for name, start in columns:
        found = F.when(F.lit(start) <= x0 + SLACK, name).otherwise(found)
    return found


def rows_from_positioned_words(
    words: DataFrame, columns: list[tuple[str, float]], keys: tuple[str, ...] = ("page",)
) -> DataFrame:
    """One row per printed line, its words joined per column in x order."""
    placed = words.withColumns({"line": F.bround("top").cast("long"), "column": column_at(F.col("x0"), columns)})
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " "
    )
    # Words meet per (line, column), the unit of output, before the columns meet per line.
    cells = placed.groupBy(*keys, "line", "column").agg(text.alias("text"))
    return cells.groupBy(*keys, "line").agg(*[
        F.max(F.when(F.col("column") == name, F.col("text"))).alias(name) for name, _ in columns
    ])


def records_from_layout(rows: DataFrame, keys: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("page", "line")) -> DataFrame:
    """Register records from printed lines.

    A line whose reference is C and digits starts a record; later lines with
    intermediary text belong to it, across page breaks. Lines before the first
    record and repeated headers are dropped.
    """
    ref = F.trim(F.coalesce("ref_no", F.lit("")))
    starts = ref.rlike(r"^C[0-9]+$")
    header = F.lower(ref).startswith("ref") & ~starts
    body = rows.filter(~header)
    numbered = running_sum(body, list(keys), list(order), starts.cast("int"), "record")
    text = blank_to_null("intermediary")
    member = F.when(text.isNotNull(), F.struct(*order, text.alias("text")))
    return (
        numbered.filter("record > 0")
        .groupBy(*keys, "record").agg(
            F.max(F.when(starts, ref)).alias("ref"),
            F.max(F.when(starts, blank_to_null("registered_as"))).alias("registered_as"),
            F.max(F.when(starts, blank_to_null("registered_on"))).alias("registered_on"),
            F.transform(F.sort_array(F.collect_list(member)), lambda m: m["text"]).alias("lines"),
        )
    )


def record_from_lines(records: DataFrame, suffixes: list[str] = L.LEGAL_SUFFIXES) -> DataFrame:
    """Names and address of a record from its lines.

    Line one is the legal name, a bare legal suffix after it belongs to it,
    then "t/a" lines are trading names and the rest is the address.
    """
    lines = F.col("lines")
    suffix = r"(?i)^(" + "|".join(suffixes) + r")\.?$"
    trading = lambda s: F.lower(s).startswith("t/a ")
    has_suffix = F.coalesce(F.get(lines, 1).rlike(suffix), F.lit(False))
    legal = F.when(has_suffix, F.concat_ws(" ", F.get(lines, 0), F.get(lines, 1))).otherwise(F.get(lines, 0))
    rest = F.slice(lines, F.when(has_suffix, 3).otherwise(2), F.greatest(F.size(lines), F.lit(1)))
    # Number of leading t/a lines: position of the first other line, less one.
    other = F.array_position(F.transform(rest, trading), False)
    leading = F.when(other > 0, other - 1).otherwise(F.size(rest)).cast("int")
    names = F.transform(F.slice(rest, 1, leading), lambda s: F.trim(F.substring(s, 5, 1_000_000)))
    address = F.slice(rest, leading + 1, F.greatest(F.size(rest), F.lit(1)))
    return records.select(
        *[c for c in records.columns if c not in ("ref", "registered_on", "lines")],
        F.col("ref").alias("cbi_reference"),
        legal.alias("legal_name"),
        blank_to_null(F.array_join(names, ", ")).alias("trading_name"),
        blank_to_null(F.array_join(address, ", ")).alias("registered_address"),
        parse_register_date("registered_on").alias("registered_on"),
    )


def rows_from_cells(
    cells: DataFrame, keys: tuple[str, ...] = ("file",), header_words: list[str] = HEADER_WORDS
) -> DataFrame:
    """Data rows of document tables as maps from header to cell.

    `cells`: keys, row_no, cells array<string>. The first row holding a header
    word is the header of its file; later non-empty rows are data. A repeated
    header keeps its last value.
    """
    texts = F.transform(F.col("cells"), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = cells.withColumn("cells", texts)
    is_header = F.exists("cells", lambda c: _any_contains(F.lower(c), header_words))
    headers = rows.filter(is_header).groupBy(*keys).agg(
        F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_row")
    )
    data = rows.join(headers, list(keys)).filter(F.col("row_no") > F.col("header_row")).filter(
        F.exists("cells", lambda c: c != "")
    )
    width = F.least(F.size("header"), F.size("cells"))
    pairs = F.arrays_zip(
        F.slice("header", 1, width).alias("key"), F.slice("cells", 1, width).alias("value")
    )
    # Later duplicates replace earlier ones, as in a dict.
    last = F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])),
    )
    return data.select(*keys, "row_no", last.alias("row"))


def _any_contains(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def fields_from_row(
    rows: DataFrame, synonyms: dict[str, list[str]], row: str = "row", keep: tuple[str, ...] = ("file", "row_no")
) -> DataFrame:
    """`canonicalise_headers` for rows held as maps, whose headers differ per file."""
    def hit(key: str) -> Column:
        filled = lambda e: F.lower(e["key"]).contains(key) & (F.trim(e["value"]) != "")
        return F.get(F.filter(F.map_entries(row), filled), 0)["value"]

    def field(keys: list[str]) -> Column:
        return blank_to_null(F.coalesce(*[hit(key) for key in keys]))

    return rows.select(*keep, F.col(row).alias("raw_row"), *[field(k).alias(t) for t, k in synonyms.items()])
