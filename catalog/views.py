"""The shared test tables seen as lead-intelligence tables.

Each view is one SELECT in the dialect Spark and DuckDB share, over whole
tables, so a query and its check start from the same rows. `$name` is a table or
an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


VIEWS = {
    "companies": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS id,
               'CRO' || CAST(c_custkey AS STRING) AS cro_number,
               CASE WHEN c_acctbal > 0 THEN 'R' || CAST(c_custkey AS STRING) END AS cbi_reference,
               c_name AS legal_name,
               CASE WHEN c_acctbal > 5000 THEN n_name || ' ' || c_mktsegment || ' Ltd' END AS trading_name,
               n_name AS county,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Normal' WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN NULL
                    WHEN 'FURNITURE' THEN 'Dissolved' ELSE 'Liquidation' END AS cro_status,
               CAST(1950 + CAST(floor(abs(c_acctbal)) AS INT) % 90 AS STRING) || '-03-' ||
                    CASE WHEN c_acctbal > 0 THEN '15' ELSE '05' END AS incorporation_date,
               CASE WHEN c_acctbal > 2000 THEN '2023-11-30' END AS last_annual_return,
               CAST(c_custkey AS STRING) || ' Main Street, ' || n_name || ', A' || CAST(c_nationkey % 10 AS STRING) || '5 AC1C' AS registered_address,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * c_custkey AS ingested_at
        FROM $customer JOIN $nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 'S' || CAST(s_suppkey AS STRING), 'CRS' || CAST(s_suppkey AS STRING), NULL, s_name, NULL, n_name,
               CASE WHEN s_acctbal > 0 THEN 'NORMAL' ELSE 'Strike Off Listed' END, NULL, NULL,
               'Unit ' || CAST(s_suppkey AS STRING) || ', ' || n_name,
               TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' MINUTE * (s_suppkey % 10)
        FROM $supplier JOIN $nation ON s_nationkey = n_nationkey""",
    "enrichment": """
        SELECT 'E' || CAST(o_orderkey AS STRING) AS id, 'C' || CAST(o_custkey AS STRING) AS company_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN '200+' WHEN '2-HIGH' THEN '51-200'
                    WHEN '3-MEDIUM' THEN '11-50' WHEN '5-LOW' THEN '1-10' END AS employee_band,
               'Angle ' || o_orderpriority AS recommended_angle, '[]' AS billing_pain_points,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    ELSE CAST(floor(o_totalprice) AS INT) % 101 END AS qualification_score,
               '{}' AS assessment_breakdown,
               '{"executive_summary":"s' || CAST(o_orderkey AS STRING) || '","contacts":[]}' AS narrative_assessment,
               CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS signal_strength,
               CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS guard_passed,
               CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS guard_score,
               CASE o_orderstatus WHEN 'O' THEN '["SUMM"]' ELSE '[]' END AS guard_failures,
               'model-' || substring(o_orderpriority, 1, 1) AS llm_model, CAST(NULL AS STRING) AS llm_raw_response,
               o_orderdate AS generated_at
        FROM $orders""",
    "emails": """
        SELECT 'M' || CAST(o_orderkey AS STRING) AS id, 'C' || CAST(o_custkey AS STRING) AS company_id,
               CAST(NULL AS STRING) AS contact_id, 'Subject ' || CAST(o_orderkey AS STRING) AS subject,
               'Body ' || o_orderpriority AS body, 'footer' AS compliance_footer,
               'model-' || substring(o_orderpriority, 1, 1) AS llm_model, o_orderdate AS generated_at,
               CASE WHEN o_orderstatus = 'F' AND row_number() OVER (
                        PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1 THEN 'draft'
                    WHEN o_orderstatus = 'O' THEN 'sent' ELSE 'archived' END AS status
        FROM $orders""",
    "rejections": """
        SELECT company_id, reason, guard_failures, guard_score, llm_model, rejected_at FROM (
            SELECT 'C' || CAST(o_custkey AS STRING) AS company_id, 'guards failed: ' || o_orderpriority AS reason,
                   '["CONF"]' AS guard_failures, CAST(o_orderkey % 100 AS DOUBLE) AS guard_score,
                   'model-' || substring(o_orderpriority, 1, 1) AS llm_model, o_orderdate AS rejected_at,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
            FROM $orders WHERE o_orderstatus = 'P') p
        WHERE n = 1""",
    "contact_rows": """
        SELECT 'S' || CAST(l_suppkey AS STRING) AS company_id,
               CASE WHEN l_discount < 0.005 THEN NULL ELSE 'Person ' || CAST(l_partkey AS STRING) END AS full_name,
               CASE WHEN l_returnflag <> 'R' THEN 'Role ' || CAST(CAST(l_quantity AS INT) AS STRING) END AS role_title,
               CASE WHEN l_returnflag <> 'A' THEN 'p' || CAST(l_orderkey AS STRING) || '@example.com' END AS email,
               CASE WHEN l_tax > 0.03 THEN '0' || CAST(l_orderkey AS STRING) END AS phone,
               CASE WHEN l_tax > 0.05 THEN CAST(l_quantity AS DOUBLE) END AS confidence_score,
               'src-' || l_returnflag AS source, l_shipdate AS created_at, l_linestatus AS side,
               (l_orderkey * 8 + l_linenumber) * 100000000000 + l_partkey * 10000 + l_suppkey AS ordinal
        FROM $lineitem""",
    "activity": """
        SELECT 'U' || CAST(user_id AS STRING) AS run_id, event_id AS seq, event_type AS step,
               'Label ' || event_type AS label,
               CASE WHEN value < 50 THEN 'running' WHEN value < 100 THEN 'done' ELSE 'failed' END AS status,
               CASE WHEN value < 50 THEN ts END AS started_at,
               CASE WHEN value >= 50 THEN ts END AS completed_at, props AS metadata
        FROM $events""",
    "runs": """
        SELECT 'U' || CAST(user_id AS STRING) AS run_id, 'C' || CAST(user_id AS STRING) AS company_id,
               'assess' AS kind, CASE WHEN min(event_id) % 3 = 0 THEN 'failed' ELSE 'done' END AS status,
               min(ts) AS started_at, CASE WHEN max(event_id) % 2 = 0 THEN max(ts) END AS finished_at
        FROM $events GROUP BY user_id""",
    "run_requests": """
        SELECT 'U' || CAST(user_id AS STRING) AS company_id, event_id AS seq,
               CASE WHEN event_type IN ('signup', 'view') THEN 'assess' ELSE 'refresh' END AS kind,
               CASE WHEN event_type IN ('view', 'purchase') THEN 'finish' ELSE 'request' END AS action
        FROM $events""",
    "titled": """
        SELECT page_id, split_part(split_part(html, '<title>', 2), '</title>', 1) AS title,
               split_part(split_part(html, 'lang="', 2), '"', 1) AS lang, length(html) AS n_chars,
               'src' || CAST(page_id % 20 AS STRING) AS source
        FROM $pages""",
    "register": """
        SELECT page_id AS ordinal, title AS legal_name,
               CASE WHEN source = 'src1' THEN 'n-' || CAST(page_id AS STRING) END AS cro_number, lang, source
        FROM $titled""",
    "snapshot": """
        SELECT page_id AS ordinal, 'N' || CAST(page_id AS STRING) AS company_num,
               CASE WHEN lang = 'en' THEN title || ' Ltd' ELSE title || ' ' || source END AS company_name,
               CASE WHEN n_chars > 2000 THEN 'Normal' ELSE 'Dissolved' END AS company_status,
               '2001-02-03' AS company_reg_date, 'LTD' AS company_type, CAST(NULL AS STRING) AS last_ar_date,
               CAST(NULL AS STRING) AS last_accounts_date, source AS princ_object_code
        FROM $titled""",
    "served_pages": """
        SELECT page_id, url, html,
               CASE WHEN url LIKE 'https%' THEN 200 WHEN url LIKE '%?%' THEN 403 ELSE 503 END AS status,
               CASE WHEN url LIKE '%#%' THEN 'Cloudflare' ELSE 'nginx' END AS server,
               lower(split_part(split_part(split_part(split_part(url, '/', 3), ':', 1), '?', 1), '#', 1)) AS host
        FROM $pages""",
    "hits": """
        SELECT h.company_id, h.query_no, h.rank, h.title, h.url, h.page_id, h.legal_name, h.trading_name FROM (
            SELECT split_part(host, '.', 2) AS company_id, CAST(page_id % 4 AS INT) AS query_no,
                   CAST(page_id AS INT) AS rank, split_part(split_part(html, '<title>', 2), '</title>', 1) AS title,
                   url, page_id, split_part(host, '.', 2) || ' Brokers Ltd' AS legal_name,
                   split_part(host, '.', 1) AS trading_name
            FROM $served_pages
            UNION ALL
            SELECT split_part(host, '.', 2), CAST(page_id % 4 AS INT), CAST(page_id AS INT) + 1000000,
                   split_part(host, '.', 2) || ' on social',
                   CASE WHEN page_id % 3 = 0 THEN 'https://www.facebook.com/' WHEN page_id % 3 = 1 THEN 'https://ie.linkedin.com/company/'
                        ELSE 'https://x.com/' END || split_part(host, '.', 2) || CAST(page_id AS STRING),
                   page_id, split_part(host, '.', 2) || ' Brokers Ltd', split_part(host, '.', 1)
            FROM $served_pages) h""",
    "assessments": """
        SELECT doc_id, 'C' || CAST(doc_id AS STRING) AS company_id,
               CAST(n_chars % 104 AS INT) AS qualification_score,
               CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'medium' WHEN 'de' THEN 'low' ELSE 'none' END AS signal_strength,
               CASE WHEN source = 'src3' THEN NULL ELSE CAST(n_chars % 103 AS DOUBLE) END AS research_confidence,
               CASE WHEN lang = 'es' THEN CAST(n_chars % 100 AS DOUBLE) END AS nested_confidence,
               CASE WHEN source = 'src4' THEN 'Unable to assess. ' || text WHEN source = 'src5' THEN '' 
                    WHEN source = 'src6' THEN text || ' No website found.' WHEN source = 'src8' THEN text ELSE text || ' Authorised firm, team of two.' END AS executive_summary,
               CASE WHEN lang = 'de' THEN '' ELSE 'Angle ' || source END AS recommended_angle,
               CASE WHEN n_chars % 5 = 0 THEN 'company registry|regulator register'
                    WHEN n_chars % 5 = 1 THEN ' Company Registry |search:a.ie' WHEN n_chars % 5 = 2 THEN 'a.ie|a.ie'
                    WHEN n_chars % 5 = 3 THEN 'search:a.ie' ELSE '' END AS sources_text,
               n_chars, lang, source, lang <> 'en' AS has_website, 'notes ' || source AS presence_notes,
               'model-' || lang AS llm_model
        FROM $documents""",
    "outbox": """
        SELECT a.conv_id, a.turn, 'About ' || coalesce(u.text, a.text) AS subject, a.text AS body,
               coalesce(u.text, '') AS grounding
        FROM $conversations a LEFT JOIN $conversations u
             ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user'
        WHERE a.role = 'assistant'""",
    "responses": """
        SELECT conv_id, turn, role, model, summary,
               CASE WHEN role = 'system' THEN summary
                    WHEN turn % 4 = 0 THEN doc
                    WHEN turn % 4 = 1 THEN 'Here it is: ```json ' || doc || ' ``` done'
                    WHEN turn % 4 = 2 THEN 'Sure. ' || doc || ' Hope it helps.'
                    ELSE 'Template {"summary": "...", "angle": ""} then ' || doc END AS response
        FROM (SELECT conv_id, turn, role, 'model-' || role AS model,
                     replace(replace(replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(10), ' '), '{', '('), '}', ')') AS summary,
                     '{"summary":"' || replace(replace(replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(10), ' '), '{', '('), '}', ')')
                         || '","turn":' || CAST(turn AS STRING) || ',"angle":""}' AS doc
              FROM $conversations) c""",
    "placed_words": """
        SELECT l_orderkey AS page, l_linenumber * 10 + l_discount AS top, l_quantity * 16 AS x0,
               l_partkey * 1000 + l_suppkey AS word_no, l_returnflag || l_linestatus || CAST(l_partkey AS STRING) AS text
        FROM $lineitem""",
    "layout_lines": """
        SELECT l_linestatus AS file, l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS line,
               CASE WHEN l_linenumber <= 2 THEN 'C' || CAST(l_partkey AS STRING) WHEN l_quantity > 45 THEN 'Ref No' ELSE '' END AS ref_no,
               CASE WHEN l_discount < 0.005 THEN ' ' ELSE l_returnflag || CAST(l_partkey AS STRING) END AS intermediary,
               'Type ' || l_returnflag AS registered_as, CASE WHEN l_tax > 0.04 THEN '3 March 2020' ELSE 'Pending' END AS registered_on
        FROM $lineitem""",
    "table_rows": """
        SELECT n_name AS file, CAST(-1 AS BIGINT) AS row_no, 'Firm Name|Segment|Address|Name' AS cells_text FROM $nation
        UNION ALL
        SELECT n_name, c_custkey, CASE WHEN c_acctbal < 0 THEN '||' ELSE
               c_name || '|' || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE c_mktsegment END || '|' || n_name || ' road|' || c_name || ' Ltd' END
        FROM $customer JOIN $nation ON c_nationkey = n_nationkey""",
    "model_calls": """
        SELECT 'model-' || role AS model, length(text) AS cost FROM $conversations""",
    "outcomes": """
        SELECT o_orderkey AS ordinal, 'C' || CAST(o_custkey AS STRING) AS company_id,
               CASE o_orderstatus WHEN 'F' THEN 'enriched' WHEN 'O' THEN 'rejected' ELSE 'failed' END AS status,
               CAST(NULL AS BOOLEAN) AS rate_limited
        FROM $orders""",
}

_NAME = re.compile(r"\$([a-z_]+)")


def _parts(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


class Views:
    """Tables of one directory as DataFrames, base tables and views alike."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            parts = {p: getattr(self, p) for p in _parts(VIEWS[name])}
            # spark.sql names DataFrames in braces; other braces are escaped.
            sql = _NAME.sub(r"{\1}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
            self._made[name] = self.spark.sql(sql, **parts)
        return self._made[name]


def with_views(sql: str) -> str:
    """A DuckDB query with the views it names put in front as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _parts(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    bare = lambda text: _NAME.sub(lambda m: m.group(1), text)
    ctes = ",\n".join(f"{n} AS ({bare(VIEWS[n])})" for n in needed)
    body = bare(sql).strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
