"""Entity resolution and table maintenance."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.scalars import fold
from firmloom import schemas
from firmloom.functions.text import first_token, fold_legal_name
from firmloom.operators import fuzzy, leads, resolve as R, upsert as U

NUM = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
EXACT = f"""
  keyed AS (SELECT *, {NUM.format('company_num')} AS num_key, {fold('company_name')} AS name_key FROM $snapshot),
  by_num AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num_key ORDER BY ordinal DESC) AS n FROM keyed WHERE num_key <> '') x WHERE n = 1),
  by_name AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY ordinal DESC) AS n FROM keyed WHERE name_key <> '') x WHERE n = 1),
  reg AS (SELECT *, {NUM.format('cro_number')} AS num_key, {fold('legal_name')} AS name_key FROM $register)
"""


@query("match_by_number", f"""WITH {EXACT} SELECT r.ordinal, b.company_num, b.company_name FROM reg r LEFT JOIN by_num b ON b.num_key = r.num_key""")
def _(v):
    rows = R.match_by_number(v.register, v.snapshot)
    return rows.select("ordinal", F.concat(F.lit("N"), F.col("number_hit.ordinal").cast("string")).alias("company_num"), "number_hit.company_name")


@query("match_by_name", f"""WITH {EXACT} SELECT r.ordinal, b.company_num, b.company_name FROM reg r LEFT JOIN by_name b ON b.name_key = r.name_key""")
def _(v):
    rows = R.match_by_name(v.register, v.snapshot)
    return rows.select("ordinal", F.concat(F.lit("N"), F.col("name_hit.ordinal").cast("string")).alias("company_num"), "name_hit.company_name")


def _name_pool(v):
    names = R.snapshot_by_name(v.snapshot)
    return names.select(
        first_token("name_key").alias("block"), F.col("name_key").alias("name"), F.col("first_ordinal").alias("ordinal"))


def _wanted(v):
    folded = fold_legal_name("legal_name").alias("name")
    return v.register.select(folded).filter("name <> ''").distinct().select(first_token("name").alias("block"), "name")


@query("fuzzy_blocked_edit_distance", f"""WITH {EXACT},
    pool AS (SELECT regexp_replace(name_key, '[^ -~]', '?', 'g') AS match, min(ordinal) AS ordinal FROM keyed WHERE name_key <> '' GROUP BY 1),
    wanted AS (SELECT DISTINCT regexp_replace(name_key, '[^ -~]', '?', 'g') AS name FROM reg WHERE name_key <> ''),
    pairs AS (SELECT w.name, p.match, p.ordinal, levenshtein(w.name, p.match) AS distance
              FROM wanted w JOIN pool p ON split_part(w.name, ' ', 1) = split_part(p.match, ' ', 1))
    SELECT name, match, CAST(distance AS BIGINT) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, ordinal) AS n FROM pairs) x WHERE n = 1""")
def _(v):
    # The SQL counts bytes, so letters outside ASCII count as one placeholder on both sides.
    plain = F.regexp_replace("name", "[^ -~]", "?").alias("name")
    wanted = _wanted(v).select(plain).distinct().select(first_token("name").alias("block"), "name")
    pool = _name_pool(v).select(plain, "ordinal").groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    best = fuzzy.best_matches(
        wanted, pool.select(first_token("name").alias("block"), "name", "ordinal"), cutoff=None, scorer="levenshtein")
    return best.select("name", "match", (-F.col("score")).cast("long").alias("distance"))


@query("fuzzy_blocked_wratio")
def _(v):
    return fuzzy.best_matches(_wanted(v), _name_pool(v)).select("name", "match", "score")


@query("fuzzy_unblocked_wratio")
def _(v):
    # Part brands and types against all registry names: few share a first token.
    everyone = F.lit("").alias("block")
    wanted = v.part.select(everyone, F.upper("p_name").alias("name")).distinct()
    return fuzzy.best_matches(wanted, _name_pool(v).select(everyone, "name", "ordinal")).select("name", "match", "score")


@query("resolve")
def _(v):
    return R.resolve(v.register, v.snapshot).select(
        "ordinal", "legal_name", "cro_number", "cro_status", "match_method", "match_confidence", "needs_review", "near_miss")


@query("resolve_exact_stages", f"""WITH {EXACT}
    SELECT r.ordinal, coalesce(a.company_num, b.company_num) AS cro_number,
           CASE WHEN a.ordinal IS NOT NULL THEN 'exact_cro_number' ELSE 'exact_normalized_name' END AS match_method
    FROM reg r LEFT JOIN by_num a ON a.num_key = r.num_key LEFT JOIN by_name b ON b.name_key = r.name_key
    WHERE a.ordinal IS NOT NULL OR b.ordinal IS NOT NULL""")
def _(v):
    rows = R.resolve(v.register, v.snapshot).filter(F.col("match_method").startswith("exact"))
    return rows.select("ordinal", "cro_number", "match_method")


@query("ingest_counts", f"""WITH {EXACT} SELECT count(*) AS records_found, count(*) FILTER (WHERE lang = 'en') AS records_new,
    count(*) FILTER (WHERE b.ordinal IS NOT NULL) AS matched, count(*) FILTER (WHERE b.ordinal IS NULL) AS needs_review
    FROM reg r LEFT JOIN by_name b ON b.name_key = r.name_key""")
def _(v):
    rows = R.match_by_name(v.register, v.snapshot)
    return leads.ingest_counts(rows.select((F.col("lang") == "en").alias("is_new"), F.col("name_hit").isNull().alias("needs_review")))


# --- Upserts ---------------------------------------------------------------

def company_table(v):
    return U.evolve_schema(v.companies, schemas.COMPANIES).select(*schemas.COMPANIES.names).withColumn(
        "ingested_at", F.col("ingested_at").cast("timestamp"))


UPSERT_KEY = f"coalesce(nullif({fold('{0}')}, ''), '=' || {{0}})"
UPSERTED = f"""
  batch AS (SELECT page_id AS ordinal, {UPSERT_KEY.format('title')} AS k, title AS name, CASE WHEN lang <> 'fr' THEN source END AS county,
                   CASE WHEN n_chars > 2000 THEN 'Normal' END AS status FROM $titled),
  meeting AS (SELECT -1 AS ordinal, {UPSERT_KEY.format('legal_name')} AS k, legal_name AS name, county, cro_status AS status FROM $companies
           UNION ALL SELECT * FROM batch)
"""


def name_batch(v):
    """All page titles, whole, as the names of a register."""
    return v.titled.select(
        F.col("page_id").alias("ordinal"), F.col("title").alias("legal_name"), F.lit(None).cast("string").alias("cro_number"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("county"), F.when(F.col("n_chars") > 2000, "Normal").alias("cro_status"),
        F.lit("register").alias("source"), F.lit(None).cast("timestamp").alias("ingested_at"), F.col("page_id").cast("string").alias("raw_payload"),
    )


@query("upsert_companies", f"""WITH {UPSERTED}
    SELECT arg_min(name, ordinal) AS legal_name,
           arg_max(county, ordinal) FILTER (WHERE county IS NOT NULL) AS county,
           arg_max(status, ordinal) FILTER (WHERE status IS NOT NULL) AS cro_status, max(ordinal) AS last_ordinal
    FROM meeting GROUP BY k""")
def _(v):
    done = U.upsert_companies(company_table(v), name_batch(v))
    last = F.coalesce(F.col("raw_payload").try_cast("bigint"), F.lit(-1))
    return done.companies.select("legal_name", "county", "cro_status", last.alias("last_ordinal"))


@query("upsert_outcomes", f"""WITH {UPSERTED}
    SELECT ordinal, ordinal = min(ordinal) OVER (PARTITION BY k) AS is_new FROM meeting QUALIFY ordinal >= 0""")
def _(v):
    return U.upsert_companies(company_table(v), name_batch(v)).outcomes.select("ordinal", "is_new")


@query("upsert_companies_numbered", """
    WITH RECURSIVE batch AS (
      SELECT (l_orderkey * 8 + l_linenumber) * 100000000000 + l_partkey * 10000 + l_suppkey AS ordinal,
             'Firm ' || CAST(l_suppkey AS VARCHAR) AS name, CASE WHEN l_discount > 0.02 THEN CAST(l_partkey AS VARCHAR) END AS number,
             l_returnflag AS county, l_linestatus AS payload FROM $lineitem),
    rounds(round, ordinal, name, number, took, holder, changed) AS (
      SELECT 0, ordinal, name, number, true, name, true FROM batch WHERE number IS NOT NULL
      UNION ALL
      SELECT round + 1, ordinal, own, number, taking, holder, taking <> took OR round = 0 FROM (
        SELECT *, holder IS NULL OR coalesce(moved, -1) > since AS taking FROM (
          SELECT *, max(CASE WHEN place = 1 THEN ordinal END) OVER (
              PARTITION BY name ORDER BY ordinal, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM (
            SELECT round, ordinal, own, number, took, holder, since, coalesce(holder, own) AS name, 0 AS place FROM (
              SELECT round, ordinal, name AS own, number, took,
                     last_value(CASE WHEN took THEN name END IGNORE NULLS) OVER earlier AS holder,
                     last_value(CASE WHEN took THEN ordinal END IGNORE NULLS) OVER earlier AS since
              FROM rounds WINDOW earlier AS (PARTITION BY number ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a
            UNION ALL SELECT round, ordinal, name, number, took, NULL, NULL, name, 1 FROM rounds WHERE took) b) c
        WHERE place = 0) d
      WHERE (SELECT bool_or(changed) FROM rounds)),
    owned AS (
      SELECT ordinal, CASE WHEN took THEN name ELSE holder END AS owner FROM rounds WHERE round = (SELECT max(round) FROM rounds)
      UNION ALL SELECT ordinal, name FROM batch WHERE number IS NULL)
    SELECT owner AS legal_name, arg_max(number, ordinal) FILTER (WHERE number IS NOT NULL) AS cro_number,
           arg_max(county, ordinal) AS county, arg_max(payload, ordinal) AS raw_payload
    FROM owned JOIN batch USING (ordinal) GROUP BY owner
    UNION ALL SELECT legal_name, cro_number, county, NULL FROM $companies""")
def _(v):
    # Numbers and names both repeat: numbers change hands and are settled in rounds.
    name = F.concat(F.lit("Firm "), F.col("l_suppkey").cast("string"))
    number = F.when(F.col("l_discount") > 0.02, F.col("l_partkey").cast("string"))
    # Beyond some eleven million orders the ordinals are no longs.
    order, line, part, supplier = (F.col(f"l_{c}").cast("decimal(20,0)") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    batch = v.lineitem.select(
        ((order * 8 + line) * 100_000_000_000 + part * 10_000 + supplier).cast("decimal(38,0)").alias("ordinal"),
        name.alias("legal_name"), number.alias("cro_number"), F.col("l_returnflag").alias("county"),
        F.col("l_linestatus").alias("raw_payload"),
    )
    return U.upsert_companies(company_table(v), batch).companies.select("legal_name", "cro_number", "county", "raw_payload")


def contact_table(v):
    """The contacts of side 'O': the last of each name, and all without a name."""
    rows = v.contact_rows.filter("side = 'O'")
    one = U.last_per_key(rows.filter("full_name is not null"), ["company_id", "full_name"])
    every = one.unionByName(rows.filter("full_name is null").select(*one.columns))
    named = F.coalesce("full_name", F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    return every.select(U.derived_id(F.col("company_id"), named).alias("id"), *[c for c in schemas.CONTACTS.names if c != "id"])


@query("upsert_contacts", """
    WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, full_name ORDER BY ordinal DESC) AS n
                 FROM $contact_rows WHERE side = 'O') x WHERE n = 1 OR full_name IS NULL),
    meeting AS (SELECT company_id, full_name, role_title, email, phone, confidence_score, source, -1 AS ordinal FROM cur
             UNION ALL SELECT company_id, full_name, role_title, email, phone, confidence_score, source, ordinal FROM $contact_rows WHERE side = 'F')
    SELECT company_id, full_name, arg_max(role_title, ordinal) FILTER (WHERE role_title IS NOT NULL) AS role_title,
           arg_max(email, ordinal) FILTER (WHERE email IS NOT NULL) AS email, arg_max(phone, ordinal) FILTER (WHERE phone IS NOT NULL) AS phone,
           arg_max(confidence_score, ordinal) FILTER (WHERE confidence_score IS NOT NULL) AS confidence_score, arg_min(source, ordinal) AS source
    FROM meeting WHERE full_name IS NOT NULL GROUP BY company_id, full_name
    UNION ALL SELECT company_id, full_name, role_title, email, phone, confidence_score, source FROM meeting WHERE full_name IS NULL""")
def _(v):
    merged = U.upsert_contacts(contact_table(v), v.contact_rows.filter("side = 'F'").drop("side"))
    return merged.select("company_id", "full_name", "role_title", "email", "phone", "confidence_score", "source")


def verdict_batch(v):
    """Purchase-like orders as a fresh batch of verdicts for their customers."""
    return v.orders.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("company_id"), F.col("o_orderkey").alias("ordinal"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_verdict"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("guard_passed"),
        F.when(F.col("o_totalprice") > 250000, "high").alias("signal_strength"),
        (F.col("o_orderkey") % 97).cast("int").alias("qualification_score"), F.col("o_orderpriority").alias("reason"),
        F.lit("[]").alias("guard_failures"), F.lit(0.0).alias("guard_score"), F.lit("m").alias("llm_model"),
        F.col("o_orderdate").alias("rejected_at"), F.col("o_orderdate").alias("generated_at"),
        F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("body"),
    )


VERDICTS = """
  vb AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey AS ordinal, o_orderpriority, o_orderstatus, o_totalprice
         FROM $orders),
  last_vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ordinal DESC) AS n FROM vb) x WHERE n = 1)"""


def contact_suppliers(v):
    """Verdicts of suppliers, who have none yet, next to those of customers."""
    return v.supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("company_id"), F.lit("earlier").alias("reason"),
        F.lit("[]").alias("guard_failures"), F.lit(1.0).alias("guard_score"), F.lit("m").alias("llm_model"),
        F.lit("2024-01-01").cast("timestamp").alias("rejected_at"),
    )


@query("replace_enrichment", f"""WITH {VERDICTS}
    SELECT company_id, CAST(ordinal % 97 AS INTEGER) AS qualification_score, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS signal_strength,
           CASE WHEN o_orderpriority = '5-LOW' THEN false WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS guard_passed,
           '{{}}' AS assessment_breakdown FROM last_vb""")
def _(v):
    stored, _ = U.replace_enrichment(v.enrichment, v.rejections, verdict_batch(v).drop("reason", "rejected_at", "subject", "body"))
    return stored.select("company_id", "qualification_score", "signal_strength", "guard_passed", "assessment_breakdown")


@query("record_rejection", f"""WITH {VERDICTS}
    SELECT company_id, o_orderpriority AS reason FROM last_vb UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'earlier' FROM $supplier""")
def _(v):
    current = v.rejections.unionByName(contact_suppliers(v))
    return U.record_rejection(current, verdict_batch(v)).select("company_id", "reason")


@query("clear_rejection", "SELECT company_id, reason FROM $rejections r WHERE company_id NOT IN (SELECT company_id FROM $emails WHERE status = 'draft')")
def _(v):
    return U.clear_rejection(v.rejections, v.emails.filter("status = 'draft'")).select("company_id", "reason")


@query("replace_draft", f"""WITH {VERDICTS}
    SELECT company_id, subject, status FROM $emails WHERE status <> 'draft' UNION ALL SELECT company_id, o_orderpriority, 'draft' FROM last_vb""")
def _(v):
    batch = verdict_batch(v).select("company_id", "ordinal", "subject", "body", "llm_model", "generated_at")
    return U.replace_draft(v.emails, batch).select("company_id", "subject", "status")


@query("patch_contacts", """
    WITH newest AS (SELECT company_id, arg_max(id, (generated_at, id)) AS id FROM $enrichment GROUP BY company_id)
    SELECT e.id, json_extract_string(e.narrative_assessment, '$.executive_summary') AS summary,
           CASE WHEN n.id IS NOT NULL AND c.c_acctbal > 0 THEN 'P' || e.company_id END AS patched_name
    FROM $enrichment e LEFT JOIN newest n ON n.id = e.id LEFT JOIN $customer c ON 'C' || CAST(c.c_custkey AS VARCHAR) = e.company_id""")
def _(v):
    ids = v.customer.filter("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("company_id"))
    patches = ids.withColumn("contacts", F.concat(F.lit('[{"name":"P'), "company_id", F.lit('"}]')))
    snapshot, _ = U.patch_contacts(v.enrichment, patches)
    doc = "narrative_assessment"
    return snapshot.select(
        "id", F.get_json_object(doc, "$.executive_summary").alias("summary"), F.get_json_object(doc, "$.contacts[0].name").alias("patched_name"))


@query("replace_run", """SELECT 'U' || CAST(user_id AS VARCHAR) AS id, count(*) AS records_found FROM $events GROUP BY user_id
    UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 0 FROM $region""")
def _(v):
    found = v.events.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("records_found"))
    fresh = U.evolve_schema(found, schemas.INGESTION_RUNS)
    old = U.evolve_schema(
        v.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(0).cast("long").alias("records_found"))
        .unionByName(found.select("id", F.lit(-1).cast("long").alias("records_found"))), schemas.INGESTION_RUNS)
    return U.replace_run(old, fresh).select("id", "records_found")


@query("evolve_schema", f"SELECT id, nullif({fold('legal_name')}, '') AS legal_name_normalized, CAST(NULL AS VARCHAR) AS sector_tag FROM $companies")
def _(v):
    return U.evolve_schema(v.companies, schemas.COMPANIES).select("id", "legal_name_normalized", "sector_tag")


@query("typed_export", """SELECT event_id, epoch_us(TRY_CAST(CASE WHEN event_type = 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP)) AS at_us,
    CASE WHEN event_type = 'view' THEN NULL ELSE event_type = 'click' END AS flag, TRY_CAST(json_extract_string(props, '$.k') AS SMALLINT) AS k FROM $events""")
def _(v):
    text = v.events.select(
        "event_id", F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"),
        F.when(F.col("event_type") == "view", "maybe").when(F.col("event_type") == "click", "1").otherwise("0").alias("flag"),
        F.get_json_object("props", "$.k").alias("k"), "props",
    )
    typed = U.typed_export(text, ["at"], ["flag"], ["k"], ["props"])
    return typed.select("event_id", F.unix_micros("at").alias("at_us"), "flag", "k")
