"""Read and write paths: a given table goes to files and comes back through the operators."""

import time
import uuid

from pyspark.sql import functions as F

from catalog.guards import REPORT, assessments
from catalog.lists import DIMENSIONS
from catalog.registry import query
from catalog.resolution import company_table
from catalog.scalars import fold
from firmloom.operators.guards import standard_guards
from firmloom.operators.ordered import running_sum
from firmloom.plans.ingest import run_ingestion
from firmloom.session import checkpoint_dir, cut, shuffles_dropped
from firmloom.sources import delimited as S
from firmloom.sources import sinks
from firmloom.streaming.assess import assess_sink

FILE_ROWS = 10_000  # rows of a file that holds whole texts


def folder(v, name):
    return f"{checkpoint_dir(v.spark).rstrip('/')}/firmloom-{name}-{uuid.uuid4().hex}"


def written(v, df, name):
    path = folder(v, name)
    with shuffles_dropped(v.spark):
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return path


@query("scan_register", """SELECT c_name || ', "' || c_mktsegment || '"' AS legal_name, 'Main Street, ' || n_name AS registered_address,
      CASE WHEN c_acctbal > 0 THEN n_name END AS county, 'C' || CAST(c_custkey AS VARCHAR) AS cbi_reference
    FROM $customer JOIN $nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY'""")
def _(v):
    firms = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat("c_name", F.lit(',  "'), "c_mktsegment", F.lit('"'))).otherwise(" ").alias("Firm Name"),
        F.concat(F.lit("Main Street, "), "n_name").alias("Registered Address"),
        F.when(F.col("c_acctbal") > 0, F.col("n_name")).otherwise("").alias("County"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("Reference Number"))
    rows = S.scan_register(v.spark, written(v, firms, "register"))
    return rows.select("legal_name", "registered_address", "county", "cbi_reference")


@query("read_spanning_lines", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, chr(13), ' ') AS text, source,
      row_number() OVER (ORDER BY doc_id) - 1 AS place FROM $documents""")
def _(v):
    # Whole texts with their line breaks and quotes as fields of files in the order of the ids, each written by one task.
    text = F.regexp_replace("text", "\r", " ")
    files = max(1, -(-v.documents.count() // FILE_ROWS))
    rows = v.documents.select("doc_id", text.alias("text"), "source").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    read = S.read_delimited(v.spark, written(v, rows, "spanning"))
    # Only the ordinals are put in order; the texts meet their places in one join by hash.
    numbered = running_sum(cut(read.select("ordinal")), [], ["ordinal"], F.lit(1).cast("long"), "n")
    placed = read.join(numbered.hint("shuffle_hash"), "ordinal")
    return placed.select("doc_id", "text", "source", (F.col("n") - 1).alias("place"))


@query("scan_snapshot", """SELECT CAST(s_suppkey AS VARCHAR) AS company_num, s_name AS company_name,
      CASE WHEN s_acctbal > 0 THEN 'Normal' END AS company_status FROM $supplier""")
def _(v):
    rows = v.supplier.select(
        F.col("s_suppkey").cast("string").alias("COMPANY_NUM"), F.col("s_name").alias("company_name"),
        F.when(F.col("s_acctbal") > 0, "Normal").otherwise("").alias("company_status"))
    return S.scan_snapshot(v.spark, written(v, rows, "snapshot"))[0].select("company_num", "company_name", "company_status")


@query("write_snapshot", "SELECT id, legal_name FROM $companies WHERE cbi_reference IS NOT NULL")
def _(v):
    root, table = folder(v, "tables"), company_table(v)
    sinks.write_snapshot(table, root, "companies", "first")
    known = sinks.read_snapshot(v.spark, root, "companies")
    sinks.write_snapshot(known.filter("cbi_reference is not null"), root, "companies", "first", base=1)
    return sinks.read_snapshot(v.spark, root, "companies").select("id", "legal_name")


@query("run_audit", f"""WITH firms AS (SELECT {fold('title')} AS k FROM $titled WHERE trim(title) <> '')
    SELECT 'first' AS id, count(*) AS records_found, count(DISTINCT k) AS records_new, '["no registry snapshot"]' AS errors FROM firms
    UNION ALL SELECT 'second', count(*), 0, '["no registry snapshot"]' FROM firms
    UNION ALL SELECT 'third', 0, 0, '["register not read: AnalysisException"]'""")
def _(v):
    root = folder(v, "tables")
    path = written(v, v.titled.select(F.regexp_replace("title", r"\s+", " ").alias("Firm Name")), "register")
    for run, register in (("first", path), ("second", path), ("third", f"{root}/nowhere")):
        run_ingestion(v.spark, register, None, root, run)
    return sinks.read_snapshot(v.spark, root, "ingestion_runs").select("id", "records_found", "records_new", "errors")


@query("latest_file", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM $supplier")
def _(v):
    path = folder(v, "files")
    older = v.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    newer = v.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    for rows in (older, newer):
        rows.coalesce(1).write.mode("append").option("header", True).csv(path)
        time.sleep(1.5)  # times of files may be whole seconds
    return v.spark.read.option("header", True).csv(S.latest_file(v.spark, path, ["*.csv"]))


@query("assess_sink", f"""WITH {REPORT} SELECT company_id, failures = '' AS guard_passed, CAST(score AS DOUBLE) AS guard_score FROM report""")
def _(v):
    root = folder(v, "assessments")
    write = assess_sink(root, "run", standard_guards(DIMENSIONS), "warn", buckets=8)
    rows = assessments(v).withColumns({"ordinal": F.col("doc_id"), "generated_at": F.lit("2024-01-01").cast("timestamp")})
    write(rows.filter("lang = 'en'"), 0)
    write(rows.filter("lang <> 'en'"), 1)
    write(rows.filter("lang <> 'en'"), 1)  # replayed
    return sinks.read_snapshot(v.spark, root, "enrichment").select("company_id", "guard_passed", "guard_score")
