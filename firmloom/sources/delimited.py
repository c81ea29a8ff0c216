"""Delimited registers and registry snapshots with unknown headers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmloom.functions.text import blank_to_null, county, eircode, squash_ws
from firmloom.session import cut

RAW = "raw_row"

# Target field -> header keys, most specific first.
REGISTER_SYNONYMS = {
    "legal_name": ["firm name", "legal name", "entity name", "company name", "intermediary", "name"],
    "trading_name": ["trading name", "trading as", "trading"],
    "registered_address": ["registered address", "address"],
    "cbi_reference": ["reference number", "ref no", "reference", "ref"],
    "cro_number": ["cro number", "company number", "cro"],
    "authorisation_type": ["authorisation type", "registered as", "type"],
    "authorisation_status": ["authorisation status", "status"],
    "county": ["county"],
    "eircode": ["eircode", "postcode", "postal code"],
}
SNAPSHOT_COLUMNS = {
    "company_num": ["company_num", "company_number"],
    "company_name": ["company_name"],
    "company_status": ["company_status"],
    "company_reg_date": ["company_reg_date", "reg_date"],
    "company_type": ["company_type"],
    "last_ar_date": ["last_ar_date", "last_ar"],
    "last_accounts_date": ["last_accounts_date", "last_accounts"],
    "princ_object_code": ["princ_object_code", "princ_object"],
}


def _by_synonym(columns: list[str], keys: list[str]) -> list[str]:
    """Columns in the order they are tried: key by key, then file order."""
    return [c for key in keys for c in columns if key in c.lower()]


def _exact_then_synonym(columns: list[str], keys: list[str]) -> list[str]:
    """As `_by_synonym`, with columns named exactly like a key in front."""
    exact = [c for key in keys for c in columns if c.strip().lower() == key]
    return exact + _by_synonym(columns, keys)


def _first_filled(columns: list[str]) -> Column:
    tried = [blank_to_null(F.col(f"`{c}`")) for c in dict.fromkeys(columns)]
    return F.coalesce(*tried) if tried else F.lit(None).cast("string")


def canonicalise_headers(
    df: DataFrame, synonyms: dict[str, list[str]] = REGISTER_SYNONYMS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One column per target field: the first matching column that is filled in that row."""
    columns = [c for c in df.columns if c not in keep]
    fields = [_first_filled(_by_synonym(columns, keys)).alias(t) for t, keys in synonyms.items()]
    return df.select(*keep, *fields)


def pick_snapshot_columns(
    df: DataFrame, columns: dict[str, list[str]] = SNAPSHOT_COLUMNS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Snapshot fields: an exactly named column first, a name containing the key otherwise."""
    present = [c for c in df.columns if c not in keep]
    fields = [_first_filled(_exact_then_synonym(present, keys)).alias(t) for t, keys in columns.items()]
    return df.select(*keep, *fields)


def reader_options(spark: SparkSession, path: str) -> tuple[dict[str, str], bool]:
    """Encoding and separator that read the whole file right, and whether a field spans lines, from one distributed pass.

    Bytes that are not UTF-8 mean Latin-1. The separator is a tab where the file holds
    more tabs than commas. A line with a field that is opened by a quote and not closed
    means that some field spans lines.
    """
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    seen = spark.read.text(path).agg(
        F.coalesce(F.bool_or(~F.is_valid_utf8(value)), F.lit(False)).alias("other_bytes"),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open_quote"),
        (F.sum(F.length(value) - F.length(F.replace(value, F.lit("\t"), F.lit(""))))
         > F.sum(F.length(value) - F.length(F.replace(value, F.lit(","), F.lit(""))))).alias("tabs"),
    ).first()
    return {"encoding": "ISO-8859-1" if seen.other_bytes else "UTF-8", "sep": "\t" if seen.tabs else ","}, seen.open_quote


CSV = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns of one delimited file, or of the files of a folder, as strings, plus `ordinal`, the row order."""
    options, spans_lines = reader_options(spark, path)
    rows = _spanning_rows(spark, path, options) if spans_lines else with_source_order(
        spark.read.csv(path, header=True, **CSV, **options))
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def _left_open(line: Column, sep: str) -> Column:
    """Whether a line that begins outside of quotes ends inside of them: its last field has a quote that nothing closes."""
    quoted, other = f'"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+', f'[^"{sep}][^{sep}]*+'
    return line.rlike(f'^(?:(?:{quoted}|{other})?{sep})*+"[^"]*+(?:""[^"]*+)*+$')


def _states(inside: int, from_out: np.ndarray, from_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each line, inside (1) or outside (0) of quotes, if the first line begins in `inside`.

    A line sets the state, keeps it (no quotes) or swaps it: the state is what the last
    setting line left, swapped as often as lines since then swap.
    """
    swaps = np.cumsum(from_out & ~from_in)
    last = np.maximum.accumulate(np.where(from_out == from_in, np.arange(len(swaps)), -1))
    after = (np.where(last < 0, inside, from_out[last] + swaps[last]) + swaps) % 2
    return np.concatenate([[inside], after[:-1]]), after


def _flags(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


_BLOCK = ("file string, block long, part int, first long, last long, from_out int, from_in int, "
          "lead long, trail_out long, trail_in long, filled long")


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: how it ends from either state, and where the records begin that it leaves open.

    `lead` is the last line of a record that was begun before the block, -1 if the block does not end it.
    """
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    held = None

    def done() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([held[c]], k) for c, k in zip(names, kinds)], names=names)

    for batch in batches:
        file, (block, part, row, out, in_, filled) = batch.column("file"), _flags(batch, "block", "part", "row", "from_out", "from_in", "filled")
        # Blocks of a task follow each other; rows of a block have one file.
        borders = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)]) if len(row) else []
        for a, b in zip(borders, [*borders[1:], len(row)]):
            key = {"file": file[a].as_py(), "block": int(block[a])}
            if held is None or {c: held[c] for c in key} != key:
                if held is not None:
                    yield done()
                held = key | {"part": int(part[a]), "first": int(row[a]), "from_out": 0, "from_in": 1, "lead": -1, "trail_out": -1, "trail_in": -1, "filled": None}
            rows = row[a:b]
            held["last"] = int(rows[-1])
            if held["filled"] is None and filled[a:b].any():
                held["filled"] = int(rows[filled[a:b].argmax()])
            for state, trail in (("from_out", "trail_out"), ("from_in", "trail_in")):
                before, after = _states(held[state], out[a:b], in_[a:b])
                begins = np.flatnonzero(before == 0)
                if state == "from_in" and held["lead"] < 0 and (after == 0).any():
                    held["lead"] = int(rows[(after == 0).argmax()])
                if len(begins):
                    held[trail] = int(rows[begins[-1]])
                held[state] = int(after[-1])
                if not held[state]:
                    held[trail] = -1
    if held is not None:
        yield done()


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ordinal, value): the lines of each record put together. The first line of all begins outside of quotes."""
    open_lines, at = [], None

    def joined(lines: list[pa.Array]) -> pa.Array:
        lines = pa.concat_arrays(lines)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")

    def made(ordinals, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ordinals, pa.int64()), values], names=["ordinal", "value"])

    for batch in batches:
        if not len(batch):
            continue
        known, ordinal, out, in_ = _flags(batch, "known", "ordinal", "from_out", "from_in")
        if not known.all():
            raise ValueError("the files or the settings that split them changed since they were opened; read them again")
        value = batch.column("value")
        before, after = _states(int(bool(open_lines)), out, in_)
        begins = np.flatnonzero(before == 0)
        first = begins[0] if len(begins) else len(value)
        if first:
            open_lines.append(value[:first])
            if not after[first - 1]:
                yield made([at], joined(open_lines))
                open_lines = []
        if after[-1] and len(begins):
            begins, end = begins[:-1], begins[-1]
            open_lines, at = [value[end:]], int(ordinal[end])
        else:
            end = len(value)
        if len(begins):
            offsets = pa.array(np.r_[begins, end], pa.int32())
            yield made(ordinal[begins], pc.binary_join(pa.ListArray.from_arrays(offsets, value), "\n"))
    if open_lines:
        raise ValueError("a record is open at the end of its lines")


def _ordinal(block: str, row: str) -> Column:
    return F.shiftleft(block, 33) + F.col(row)


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, part, first, last, n, lead, trail, begun, header): one row a block of the files, in a few rows a task.

    Lines up to `lead` end a record that began at the ordinal `begun`; lines from `trail` on
    begin one that the block does not end. `header` is the ordinal of the file's first record.
    """
    ends = cut(lines.select("file", "block", "part", "row", "from_out", "from_in", (F.trim("value") != "").alias("filled"))
               .mapInArrow(_block_ends, _BLOCK))
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")
    sets = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out") + F.col("sum")) % 2)
    numbered = ends.withColumn("n", F.row_number().over(Window.orderBy("file", "block")).cast("bigint"))
    stated = numbered.withColumn("sum", F.sum(swaps).over(along)).withColumn("set", sets).withColumn(
        "inside", (F.coalesce(F.last("set", ignorenulls=True).over(earlier), F.lit(0)) + F.col("sum") - swaps) % 2 == 1)
    none = F.lit((1 << 33) - 1)
    trail = F.when(F.col("inside"), F.col("trail_in")).otherwise(F.col("trail_out"))
    bordered = stated.withColumns({
        "lead": F.when(~F.col("inside"), -1).when(F.col("lead") < 0, none).otherwise(F.col("lead")),
        "trail": F.when(trail < 0, none + 1).otherwise(trail),
    })
    left_open = F.when(F.col("trail") <= none, _ordinal("n", "trail"))
    return cut(bordered.select(
        "file", "block", "part", "first", "last", "n", "lead", "trail", F.last(left_open, ignorenulls=True).over(earlier).alias("begun"),
        F.min(_ordinal("n", "filled")).over(Window.partitionBy("file")).alias("header")))


def records(lines: DataFrame, sep: str) -> DataFrame:
    """(ordinal, value): whole records of the lines (file, block, part, row, value), without each file's first; read in blocks.

    A line is a function of the state it begins in, inside or outside of quotes, and so is a
    block of lines: one pass finds each block's function, running values along the
    blocks of a file give the state each begins in, and any number of tasks share one file.
    The next pass puts records together where they lie. Only lines of records that span
    blocks are gathered; no other text is shuffled or stored.
    """
    closed = F.regexp_replace("value", f'^[^"]*+(?:""[^"]*+)*+"[^{sep}]*+{sep}?+', "")
    from_in = (~F.col("value").rlike('^[^"]*+(?:""[^"]*+)*+"')) | (_left_open(closed, sep))
    marks = {"from_out": _left_open(F.col("value"), sep), "from_in": from_in}
    # As many rows as the splits of the files, which the driver deals out itself.
    blocks = F.broadcast(_blocks(lines.withColumns(marks)).withColumnsRenamed({"part": "__part"}))
    placed = lines.join(blocks, ["file", "block"], "left").withColumns({
        "known": F.coalesce((F.col("part") == F.col("__part")) & F.col("row").between(F.col("first"), F.col("last")), F.lit(False)),
        "ordinal": _ordinal("n", "row"),
    })
    within = (F.col("row") > F.col("lead")) & (F.col("row") < F.col("trail"))
    whole = placed.filter(~F.col("known") | within).withColumns(marks).select(
        "known", "ordinal", "value", "from_out", "from_in").mapInArrow(_whole_records, "ordinal long, value string")
    first = F.when(F.col("row") <= F.col("lead"), F.col("begun")).otherwise(_ordinal("n", "trail"))
    spread = placed.filter(F.col("known") & ~within).withColumn("first", first).groupBy("first").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("lines"))
    every = whole.unionByName(spread.select(
        F.col("first").alias("ordinal"), F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value")))
    return every.join(F.broadcast(blocks.select(F.col("header").alias("ordinal")).distinct()), "ordinal", "left_anti")


def _spanning_rows(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """Rows of files whose fields may hold line breaks: records put together from lines, each read by `from_csv`."""
    columns = spark.read.csv(path, header=True, multiLine=True, **CSV, **options).columns  # reads a header, no rows
    value = F.col("value") if options["encoding"] == "UTF-8" else F.decode(F.col("value").cast("binary"), options["encoding"])
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.spark_partition_id().alias("part"), _place_in_task().alias("row"), value.alias("value"))
    body = records(lines, options["sep"]).filter(F.trim("value") != "")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    row = F.from_csv("value", schema, {**CSV, "sep": options["sep"]})
    return body.select(row.alias("r"), "ordinal").select(*[F.col("r")[c].alias(c) for c in columns], "ordinal")


def _place_in_task() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def with_source_order(df: DataFrame) -> DataFrame:
    """Add `ordinal`, the row's place by file name, position of its block and place within the block.

    Blocks are numbered by their place in the files, not by the order in which Spark
    happens to deal them out.
    """
    placed = df.withColumns({
        "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__row": _place_in_task(),
    })
    blocks = placed.select("__file", "__block").distinct()
    numbered = blocks.withColumn("__n", F.row_number().over(Window.orderBy("__file", "__block")).cast("bigint"))
    # As many rows as the splits of the files, which the driver deals out itself.
    ordered = placed.join(F.broadcast(numbered), ["__file", "__block"]).withColumn("ordinal", _ordinal("__n", "__row"))
    return ordered.drop("__file", "__block", "__row", "__n")


def scan_register(spark: SparkSession, path: str) -> DataFrame:
    """Firms of a delimited register, without rows that lack a legal name."""
    return register_records(read_delimited(spark, path))


def register_records(rows: DataFrame, synonyms: dict[str, list[str]] = REGISTER_SYNONYMS) -> DataFrame:
    """Firm records from string rows with an `ordinal`; the original row stays in `raw_row`."""
    cells = [c for c in rows.columns if c != "ordinal"]
    pairs = [x for c in cells for x in (F.lit(c), F.col(f"`{c}`"))]
    with_raw = rows.withColumn(RAW, F.create_map(*pairs))
    return firm_records(canonicalise_headers(with_raw, synonyms, keep=("ordinal", RAW)))


def firm_records(records: DataFrame) -> DataFrame:
    """Clean names and address parts; drop records without a legal name.

    A register's own county and postcode count; the address is read where they are missing.
    """
    own = lambda c: blank_to_null(F.col(c)) if c in records.columns else F.lit(None).cast("string")
    return records.withColumns({
        "legal_name": squash_ws("legal_name"),
        "county": F.coalesce(own("county"), county("registered_address")),
        "eircode": F.coalesce(own("eircode"), eircode("registered_address")),
    }).filter("legal_name is not null")


def scan_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Registry snapshot rows and whether the snapshot is missing or empty."""
    rows = pick_snapshot_columns(read_delimited(spark, path), keep=("ordinal",))
    return rows, rows.isEmpty()


def latest_file(
    spark: SparkSession, directory: str, patterns: list[str], exclude_prefix: str = "companies_"
) -> str | None:
    """Newest file matching any pattern, without those of the registry prefix."""
    found = None
    for pattern in patterns:
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
            .select("path", "modificationTime")
        )
        found = files if found is None else found.unionByName(files)
    name = F.substring_index("path", "/", -1)
    newest = found.filter(~F.lower(name).startswith(exclude_prefix.lower())).agg(
        F.max_by("path", F.struct("modificationTime", "path"))
    )
    return newest.first()[0]
