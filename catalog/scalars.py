"""Scalar expressions over names, addresses, dates and model-written JSON."""

from pyspark.sql import functions as F

from catalog.lists import INBOXES, NOT_A_NAME
from catalog.registry import query
from firmloom import lexicons as L
from firmloom.functions import documents as D
from firmloom.functions import people as P
from firmloom.functions import text as X
from firmloom.sources.sinks import raw_payload


def fold(sql: str) -> str:
    suffix = "|".join(L.LEGAL_SUFFIXES)
    return rf"trim(regexp_replace(upper(regexp_replace(replace({sql}, 'ß', 'ss'), '(?i)\b({suffix})\b', '', 'g')), '\s+', ' ', 'g'))"


COUNTY_LIST = ", ".join(f"('{c}')" for c in L.COUNTIES)


@query("county", f"""
    WITH names(name) AS (VALUES {COUNTY_LIST}),
    texts AS (SELECT doc_id, text FROM $documents),
    hits AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(lower(text), name), length(name) DESC) AS n
             FROM texts JOIN names ON contains(lower(text), name))
    SELECT t.doc_id, upper(substring(h.name, 1, 1)) || substring(h.name, 2) AS county
    FROM texts t LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.n = 1""")
def _(v):
    return v.documents.select("doc_id", X.county("text").alias("county"))


@query("eircode", rf"""SELECT id, nullif(upper(regexp_extract(registered_address, '{L.EIRCODE}', 1)), '') AS eircode FROM $companies""")
def _(v):
    return v.companies.select("id", X.eircode("registered_address").alias("eircode"))


@query("squash_ws", r"""SELECT doc_id, nullif(trim(regexp_replace(text, '[\s\pZ\x{0b}\x{85}]+', ' ', 'g')), '') AS squashed FROM $documents""")
def _(v):
    return v.documents.select("doc_id", X.squash_ws("text").alias("squashed"))


@query("fold_legal_name", f"SELECT ordinal, {fold('company_name')} AS folded FROM $snapshot")
def _(v):
    return v.snapshot.select("ordinal", X.fold_legal_name("company_name").alias("folded"))


@query("fold_id", "SELECT id, upper(regexp_replace(cro_number || '-' || registered_address, '[^A-Za-z0-9]', '', 'g')) AS folded FROM $companies")
def _(v):
    return v.companies.select("id", X.fold_id(F.concat_ws("-", "cro_number", "registered_address")).alias("folded"))


@query("parse_register_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending ' || o_orderpriority
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM $orders""")
def _(v):
    written = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("pending "), "o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "d MMMM yyyy"))
    return v.orders.select("o_orderkey", X.parse_register_date(written).alias("parsed"))


@query("clean_firm_name", rf"""SELECT id, regexp_replace(regexp_replace(lower(coalesce(trading_name, legal_name)),
      '(?i)\b({"|".join(L.LEGAL_SUFFIXES + L.SECTOR_NOISE)})\b', ' ', 'g'), '[^a-z0-9]', '', 'g') AS cleaned FROM $companies""")
def _(v):
    return v.companies.select("id", X.clean_firm_name(F.coalesce("trading_name", "legal_name")).alias("cleaned"))


@query("years_operating", """SELECT id, CASE WHEN 2024 - TRY_CAST(substring(incorporation_date, 1, 4) AS INTEGER) >= 0
      THEN 2024 - TRY_CAST(substring(incorporation_date, 1, 4) AS INTEGER) END AS years FROM $companies""")
def _(v):
    return v.companies.select("id", X.years_operating("incorporation_date", F.lit("2024-06-01").cast("date")).alias("years"))


@query("display_date", """SELECT id, CASE WHEN incorporation_date IS NULL THEN NULL
      ELSE strftime(CAST(incorporation_date AS DATE), '%-d %b %Y') END AS shown FROM $companies""")
def _(v):
    return v.companies.select("id", X.display_date("incorporation_date").alias("shown"))


@query("tier", """SELECT id, CASE WHEN qualification_score >= 70 THEN 'high' WHEN qualification_score >= 40 THEN 'medium' ELSE 'low' END AS tier,
      CASE WHEN qualification_score >= 70 THEN 'Strong' WHEN qualification_score >= 40 THEN 'Moderate' ELSE 'Low' END AS fit FROM $enrichment""")
def _(v):
    return v.enrichment.select("id", X.tier("qualification_score").alias("tier"), X.fit_label("qualification_score").alias("fit"))


@query("dimension_pct", """SELECT id, pct, CAST(greatest(2, least(100, round(pct))) AS INTEGER) AS bar FROM (
      SELECT id, coalesce(CASE WHEN guard_passed THEN guard_score END,
             CASE signal_strength WHEN 'high' THEN 90.0 WHEN 'medium' THEN 58.0 ELSE 18.0 END)::DOUBLE AS pct FROM $enrichment) x""")
def _(v):
    pct = X.dimension_pct("signal_strength", F.when(F.col("guard_passed"), F.col("guard_score")))
    return v.enrichment.select("id", pct.alias("pct"), X.dimension_bar(pct).cast("int").alias("bar"))


KINDS = "CASE lang WHEN 'en' THEN 'insurance ' WHEN 'fr' THEN 'Reinsurance ' WHEN 'de' THEN 'Mortgage credit ' ELSE 'other ' END || source"


@query("describe_authorisation", f"""SELECT doc_id, CASE {" ".join(f"WHEN contains(lower(kind), '{k}') THEN '{t}'" for k, t in L.AUTHORISATIONS)}
      ELSE '{L.AUTHORISATION_OTHER}' END AS label FROM (SELECT doc_id, {KINDS} AS kind FROM $documents) x""")
def _(v):
    return v.documents.select("doc_id", X.describe_authorisation(F.expr(KINDS)).alias("label"))


@query("contact_channel", rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '{L.EMAIL}') THEN 'email' WHEN regexp_matches(text, '{L.PHONE}') THEN 'phone'
      WHEN regexp_matches(text, '{L.FORM_WORDS}') THEN 'form_only' ELSE 'none' END AS channel FROM $documents""")
def _(v):
    return v.documents.select("doc_id", P.contact_channel("text").alias("channel"))


INBOX = """SELECT doc_id, CASE source WHEN 'src1' THEN 'In.fo@a.ie' WHEN 'src2' THEN 'customer-service@a.ie'
      WHEN 'src3' THEN 'mary.byrne@a.ie' WHEN 'src4' THEN 'sales' ELSE source || '@a.ie' END AS email FROM $documents"""


@query("generic_inbox", f"""SELECT doc_id, contains(email, '@') AND
      replace(replace(replace(lower(split_part(email, '@', 1)), '.', ''), '_', ''), '-', '') IN ({", ".join(f"'{i}'" for i in INBOXES)}) AS generic
      FROM ({INBOX}) x""")
def _(v):
    emails = v.spark.sql(INBOX.replace("$documents", "{documents}"), documents=v.documents)
    return emails.select("doc_id", P.is_generic_inbox("email", INBOXES).alias("generic"))


@query("plausible_person", r"""SELECT ordinal, coalesce(len(t) BETWEEN 2 AND 5 AND len(list_filter(t, lambda x: NOT regexp_full_match(x, '\p{Lu}[\p{L}''’.-]+'))) = 0
      AND len(list_filter(t, lambda x: list_contains([%s], lower(replace(replace(replace(replace(x, '''', ''), '’', ''), '.', ''), '-', ''))))) = 0, false) AS plausible
      FROM (SELECT ordinal, string_split(trim(regexp_replace(legal_name, '\s+', ' ', 'g')), ' ') AS t FROM $register) x""" % ", ".join(f"'{w}'" for w in NOT_A_NAME))
def _(v):
    return v.register.select("ordinal", P.is_plausible_person("legal_name", NOT_A_NAME).alias("plausible"))


@query("people_bearing", rf"""SELECT doc_id, regexp_matches(text, '(?i)\b({"|".join(L.ROLE_WORDS)})s?\b') OR regexp_matches(text, '{L.EMAIL}') OR regexp_matches(text, '{L.PHONE}') AS bearing
      FROM $documents""")
def _(v):
    return v.documents.select("doc_id", P.people_bearing("text").alias("bearing"))


@query("parse_json_column", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_type = 'error' THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS k FROM $events""")
def _(v):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    parsed = D.parse_json_column(text, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return v.events.select("event_id", parsed["k"].alias("k"))


@query("salvage_json", """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN summary END AS summary FROM $responses""")
def _(v):
    found = D.salvage_json("response")
    return v.responses.select("conv_id", "turn", F.get_json_object(found, "$.summary").alias("summary"))


@query("has_required", """SELECT conv_id, turn, role <> 'system' AND trim(summary) <> '' AS has_text, false AS has_both, false AS has_list FROM $responses""")
def _(v):
    rows = v.responses.withColumn("doc", D.salvage_json("response"))
    return rows.select(
        "conv_id", "turn", D.has_required("doc", ["summary"]).alias("has_text"),
        D.has_required("doc", ["summary", "turn"]).alias("has_both"),
        D.has_required("doc", ["turn"], kind="array").alias("has_list"),
    )


MISPLACED = """SELECT o_orderkey, CASE o_orderstatus
      WHEN 'F' THEN '{"executive_summary":"top ' || o_orderpriority || '","contacts":[{"executive_summary":"nested"}]}'
      WHEN 'O' THEN '{"executive_summary":"","contacts":[{"executive_summary":"nested ' || o_orderpriority || '"}]}'
      ELSE '{"executive_summary":null,"contacts":[]}' END AS doc FROM $orders"""


@query("hoist_misplaced", f"""SELECT o_orderkey, coalesce(nullif(json_extract_string(doc, '$.executive_summary'), ''),
      nullif(json_extract_string(doc, '$.contacts[0].executive_summary'), '')) AS executive_summary FROM ({MISPLACED}) x""")
def _(v):
    escaped = MISPLACED.replace("{", "{{").replace("}", "}}").replace("$orders", "{orders}")
    docs = v.spark.sql(escaped, orders=v.orders)
    return docs.select("o_orderkey", D.hoist_misplaced("doc")["executive_summary"].alias("executive_summary"))


@query("raw_payload", """SELECT id, '{"id":"' || id || '","trading_name":' || CASE WHEN trading_name IS NULL THEN 'null' ELSE '"' || trading_name || '"' END
      || ',"county":"' || county || '"}' AS payload FROM $companies""")
def _(v):
    return v.companies.select("id", raw_payload(["id", "trading_name", "county", "raw_row"]).alias("payload"))
