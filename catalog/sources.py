"""Register sources: headers, positioned words, records, table cells."""

from pyspark.sql import functions as F

from catalog.lists import PAGE_COLUMNS
from catalog.registry import query
from firmloom.sources import delimited as S
from firmloom.sources import layout as Y


@query("register_records", r"""
    SELECT c_custkey AS ordinal, trim(regexp_replace(coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END, nullif(trim(trade), '')), '\s+', ' ', 'g')) AS legal_name,
           nullif(trim(trade), '') AS trading_name, c_mktsegment AS registered_address, CAST(c_nationkey AS VARCHAR) AS cbi_reference
    FROM (SELECT *, CASE WHEN c_nationkey > 12 THEN '' ELSE 'T  ' || c_name END AS trade FROM $customer) x
    WHERE c_acctbal >= 0 OR trim(trade) <> ''""")
def _(v):
    raw = v.customer.select(
        F.col("c_custkey").alias("ordinal"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("  "), "c_name")).alias("Firm Name"),
        F.when(F.col("c_nationkey") > 12, "").otherwise(F.concat(F.lit("T  "), "c_name")).alias("Trading Name"),
        F.col("c_mktsegment").alias("Registered Address"), F.col("c_nationkey").cast("string").alias("Reference Number"),
    )
    return S.register_records(raw).select("ordinal", "legal_name", "trading_name", "registered_address", "cbi_reference")


@query("canonicalise_headers", """SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'N' || CAST(s_nationkey AS VARCHAR)) AS legal_name,
    CAST(s_nationkey AS VARCHAR) AS cro_number FROM $supplier""")
def _(v):
    raw = v.supplier.select(
        "s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("Other name"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(" ").alias("LEGAL NAME"),
        F.col("s_nationkey").cast("string").alias("CRO Number"),
    )
    return S.canonicalise_headers(raw, keep=("s_suppkey",)).select("s_suppkey", "legal_name", "cro_number")


@query("pick_snapshot_columns", """SELECT s_suppkey, s_name AS company_name, coalesce(CASE WHEN s_acctbal > 0 THEN 'Normal' END, '1') AS company_status,
    CAST(s_suppkey AS VARCHAR) AS company_num FROM $supplier""")
def _(v):
    raw = v.supplier.select(
        "s_suppkey", F.lit("1").alias("company_status_code"), F.when(F.col("s_acctbal") > 0, "Normal").alias("Company_Status"),
        F.col("s_name").alias("COMPANY_NAME"), F.col("s_suppkey").cast("string").alias("company_number_text"),
    )
    return S.pick_snapshot_columns(raw, keep=("s_suppkey",)).select("s_suppkey", "company_name", "company_status", "company_num")


COLUMN_CASE = "CASE " + " ".join(
    f"WHEN {start} <= x0 + 0.5 THEN '{name}'" for name, start in reversed(PAGE_COLUMNS)
) + f" ELSE '{PAGE_COLUMNS[0][0]}' END"


@query("rows_from_positioned_words", f"""
    WITH placed AS (SELECT page, CAST(round_even(top, 0) AS BIGINT) AS line, {COLUMN_CASE} AS col, x0, word_no, text FROM $placed_words),
    cells AS (SELECT page, line, col, string_agg(text, ' ' ORDER BY x0, word_no, text) AS t FROM placed GROUP BY page, line, col)
    SELECT page, line, {", ".join(f"max(CASE WHEN col = '{n}' THEN t END) AS {n}" for n, _ in PAGE_COLUMNS)} FROM cells GROUP BY page, line""")
def _(v):
    return Y.rows_from_positioned_words(v.placed_words, PAGE_COLUMNS)


RECORDS = """
    numbered AS (SELECT *, sum(CASE WHEN regexp_full_match(ref_no, 'C[0-9]+') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY page, line) AS record
                 FROM $layout_lines WHERE ref_no <> 'Ref No'),
    records AS (SELECT file, record, max(CASE WHEN ref_no <> '' THEN ref_no END) AS ref,
                       max(CASE WHEN ref_no <> '' THEN registered_on END) AS registered_on,
                       list(trim(intermediary) ORDER BY page, line) FILTER (WHERE trim(intermediary) <> '') AS lines
                FROM numbered WHERE record > 0 GROUP BY file, record)"""


@query("records_from_layout", f"""WITH {RECORDS}
    SELECT file, record, ref, registered_on, coalesce(array_to_string(lines, '|'), '') AS lines FROM records""")
def _(v):
    records = Y.records_from_layout(v.layout_lines)
    return records.select("file", "record", "ref", "registered_on", F.array_join("lines", "|").alias("lines"))


@query("record_from_lines", f"""WITH {RECORDS}
    SELECT file, record, ref AS cbi_reference, lines[1] AS legal_name, nullif(array_to_string(lines[2:], ', '), '') AS registered_address,
           CASE registered_on WHEN '3 March 2020' THEN '2020-03-03' ELSE registered_on END AS registered_on FROM records""")
def _(v):
    records = Y.record_from_lines(Y.records_from_layout(v.layout_lines))
    return records.select("file", "record", "cbi_reference", "legal_name", "registered_address", "registered_on")


@query("rows_from_cells", """SELECT file, row_no, split_part(cells_text, '|', 1) AS firm_name, trim(split_part(cells_text, '|', 2)) AS segment,
    split_part(cells_text, '|', 4) AS last_name FROM $table_rows WHERE row_no >= 0 AND cells_text <> '||'""")
def _(v):
    cells = v.table_rows.select("file", "row_no", F.split("cells_text", "[|]").alias("cells"))
    rows = Y.rows_from_cells(cells)
    return rows.select(
        "file", "row_no", F.col("row")["Firm Name"].alias("firm_name"), F.col("row")["Segment"].alias("segment"),
        F.col("row")["Name"].alias("last_name"),
    )


@query("fields_from_row", """SELECT file, row_no, split_part(cells_text, '|', 1) AS legal_name, split_part(cells_text, '|', 3) AS registered_address
    FROM $table_rows WHERE row_no >= 0 AND cells_text <> '||'""")
def _(v):
    cells = v.table_rows.select("file", "row_no", F.split("cells_text", "[|]").alias("cells"))
    fields = Y.fields_from_row(Y.rows_from_cells(cells), S.REGISTER_SYNONYMS)
    return fields.select("file", "row_no", "legal_name", "registered_address")
