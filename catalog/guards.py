"""Guards, schema rules, email check, routing."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.lists import COMPETITORS, DIMENSIONS, NOT_A_NAME, STOPWORDS
from firmloom import lexicons as L
from firmloom.operators import guards as G


def assessments(v):
    """Documents as assessments, with scorecards and signals derived from their columns."""
    reason = lambda i, d: (
        F.when(F.col("source") == "src7", "the same reason").when(F.col("n_chars") % 7 == 0, "thin")
        .otherwise(F.concat(F.lit(f"because of {d} "), F.col("source"))))
    entry = lambda i, d: F.when(
        F.col("n_chars") % (i + 2) != 0,
        F.struct((F.col("lang") != "es").alias("is_object"), reason(i, d).alias("reason")))
    pairs = F.array(*[F.struct(F.lit(d).alias("key"), entry(i, d).alias("value")) for i, d in enumerate(DIMENSIONS)])
    card = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    signal = lambda i, d: F.when(
        F.col("n_chars") % (i + 2) != 0,
        F.struct(F.col("signal_strength").alias("level"), (F.col("n_chars") % 105).cast("double").alias("pct"), reason(i, d).alias("reason")))
    graded = F.struct(*[F.struct(F.lit("high").alias("level"), F.col("recommended_angle").alias("reason")).alias(f) for f in L.CONFIDENCE_FIELDS])
    return v.assessments.withColumns({
        "sources_reviewed": F.when(F.col("sources_text") != "", F.split("sources_text", "[|]")).otherwise(F.array().cast("array<string>")),
        "sources_count": F.lit(None).cast("int"),
        "scorecard": F.when(F.col("source") != "src9", card),
        "signals": F.struct(*[signal(i, d).alias(d) for i, d in enumerate(DIMENSIONS)]),
        "avoid": F.array(F.lit("nothing")),
        "contacts": F.array(F.struct(F.lit("Mary Byrne").alias("name"), graded.alias("confidence"))),
    })


DIMS = "(VALUES " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(DIMENSIONS)) + ") dims(i, d)"
REASON = "CASE WHEN source = 'src7' THEN 'the same reason' WHEN n_chars % 7 = 0 THEN 'thin' ELSE 'because of ' || d || ' ' || source END"
SIGNALS = " OR ".join(f"regexp_matches(s, '{p}')" for p in L.SUMMARY_SIGNALS)

JUDGED = f"""
  a AS (SELECT *, trim(coalesce(executive_summary, '')) AS s, coalesce(nullif(research_confidence, 0), nested_confidence, 0) AS c,
               CASE WHEN sources_text = '' THEN [] ELSE string_split(sources_text, '|') END AS src FROM $assessments),
  cards AS (SELECT doc_id, count(*) FILTER (WHERE NOT present) AS missing, count(*) FILTER (WHERE present) AS held,
                   count(*) FILTER (WHERE present AND lang <> 'es' AND length(reason) < 10) AS thin,
                   count(*) FILTER (WHERE present AND lang <> 'es') AS reasons, count(DISTINCT CASE WHEN present AND lang <> 'es' THEN reason END) AS kinds
            FROM (SELECT doc_id, lang, n_chars % (i + 2) <> 0 AS present, {REASON} AS reason FROM $assessments, {DIMS}) x GROUP BY doc_id),
  b AS (SELECT a.*, k.missing + k.thin + CASE WHEN k.reasons >= 2 AND k.kinds = 1 THEN 1 ELSE 0 END AS issues, k.held,
               len(list_filter(src, lambda x: lower(trim(x)) IN ({", ".join(f"'{r}'" for r in L.REGISTRY_SOURCES)}))) AS official, len(src) AS listed
        FROM a JOIN cards k ON k.doc_id = a.doc_id),
  g AS (SELECT doc_id, company_id, llm_model, c AS conf_score, c >= 30 AS conf_ok, c >= 30 AND c < 70 AS conf_warn,
          CASE WHEN s = '' THEN 0 WHEN length(s) < 80 THEN 20 WHEN regexp_matches(s, '{L.SUMMARY_FALLBACK}') THEN 10 WHEN NOT ({SIGNALS}) THEN 65 ELSE 100 END AS summ_score,
          CASE WHEN official >= 2 THEN 80 WHEN official >= 1 AND listed > official THEN 90 WHEN listed - official >= 2 THEN 100 ELSE 0 END AS qual_score,
          CASE WHEN source = 'src9' OR held = 0 THEN 0 WHEN issues = 0 THEN 100 ELSE greatest(30, 100 - 15 * issues) END AS dim_score,
          CASE WHEN NOT has_website THEN 100 WHEN regexp_matches(s || ' ' || presence_notes || ' nothing', '{L.PRESENCE_MISMATCH}') THEN 20 ELSE 100 END AS pres_score
        FROM b)
"""


def _single(name, guard, score):
    @query(name, f"WITH {JUDGED} SELECT doc_id, CAST({score} AS DOUBLE) AS score, {score} >= {30 if guard is G.confidence_guard else 25} AS passed FROM g")
    def _(v, guard=guard):
        return assessments(v).select("doc_id", guard().alias("r")).select("doc_id", "r.score", "r.passed")


_single("guard_confidence", G.confidence_guard, "conf_score")
_single("guard_summary", G.summary_guard, "summ_score")
_single("guard_sources", G.sources_guard, "qual_score")
_single("guard_dimensions", lambda: G.dimension_guard(DIMENSIONS), "dim_score")


@query("guard_presence", f"WITH {JUDGED} SELECT doc_id, CAST(pres_score AS DOUBLE) AS score, CASE WHEN pres_score = 20 THEN 'warning' ELSE 'info' END AS severity FROM g")
def _(v):
    return assessments(v).select("doc_id", G.presence_guard().alias("r")).select("doc_id", "r.score", "r.severity")


REPORT = f"""{JUDGED},
  report AS (SELECT *,
    CASE WHEN NOT conf_ok THEN 'CONF' WHEN summ_score < 65 THEN 'SUMM' WHEN qual_score = 0 THEN 'QUAL' WHEN dim_score = 0 THEN 'DIM' ELSE '' END AS failures,
    CASE WHEN NOT conf_ok THEN conf_score WHEN summ_score < 65 THEN (conf_score + summ_score) / 2 WHEN qual_score = 0 THEN (conf_score + summ_score) / 3
         WHEN dim_score = 0 THEN (conf_score + summ_score + qual_score) / 4 ELSE (conf_score + summ_score + qual_score + dim_score + pres_score) / 5 END AS score,
    concat_ws(',', CASE WHEN conf_warn THEN 'CONF' END, CASE WHEN conf_ok AND summ_score = 65 THEN 'SUMM' END,
      CASE WHEN conf_ok AND summ_score >= 65 AND qual_score > 0 AND dim_score BETWEEN 1 AND 99 THEN 'DIM' END,
      CASE WHEN conf_ok AND summ_score >= 65 AND qual_score > 0 AND dim_score > 0 AND pres_score = 20 THEN 'DPRES' END) AS warnings FROM g)
"""


@query("run_guards", f"WITH {REPORT} SELECT doc_id, failures = '' AS passed, CAST(score AS DOUBLE) AS score, failures, warnings FROM report")
def _(v):
    r = "guard_report"
    return G.run_guards(assessments(v), G.standard_guards(DIMENSIONS)).select(
        "doc_id", f"{r}.passed", f"{r}.score", F.array_join(f"{r}.failures", ",").alias("failures"), F.array_join(f"{r}.warnings", ",").alias("warnings"))


@query("storage_route_block", f"""WITH {REPORT} SELECT doc_id, failures = '' AS stored, CASE WHEN failures <> '' THEN 'guards failed: ' || failures END AS route_reason FROM report""")
def _(v):
    from firmloom.streaming.assess import assess_batch

    return assess_batch(assessments(v), G.standard_guards(DIMENSIONS), "block").select("doc_id", "stored", "route_reason")


@query("storage_route_verdicts", """SELECT id, coalesce(guard_passed, false) AS stored_block, true AS stored_warn,
    CASE WHEN guard_passed IS NULL THEN 'no guard verdict' WHEN NOT guard_passed THEN 'guards failed: SUMM' END AS reason_block FROM $enrichment""")
def _(v):
    rows = v.enrichment.withColumn("guard_failures", F.from_json("guard_failures", "array<string>"))
    blocked = G.storage_route(rows, " BLOCK ").select("id", F.col("stored").alias("stored_block"), F.col("route_reason").alias("reason_block"), "guard_passed", "guard_failures")
    return G.storage_route(blocked, "unknown").select("id", "stored_block", F.col("stored").alias("stored_warn"), "reason_block")


RULES = ", ".join(f"""CASE WHEN n_chars % {i + 2} = 0 THEN '{d}_missing' END,
      CASE WHEN n_chars % {i + 2} <> 0 AND (signal_strength = 'none' OR n_chars % 105 > 100 OR (source <> 'src7' AND n_chars % 7 = 0)) THEN '{d}_invalid' END"""
                  for i, d in enumerate(DIMENSIONS))


@query("validate_assessment", f"""SELECT doc_id, concat_ws(',', CASE WHEN qualification_score > 100 THEN 'score_range' END,
      CASE WHEN signal_strength = 'none' THEN 'signal_level' END, CASE WHEN research_confidence IS NULL OR research_confidence > 100 THEN 'confidence_range' END,
      CASE WHEN recommended_angle = '' THEN 'angle_missing' END, CASE WHEN length(s) < 30 THEN 'summary_short' END,
      CASE WHEN regexp_matches(s, '{L.SUMMARY_FALLBACK}') THEN 'summary_fallback' END,
      CASE WHEN research_confidence < 50 AND NOT regexp_matches(s, '{L.LOW_CONFIDENCE_WORDS}') THEN 'confidence_unqualified' END,
      {RULES}, CASE WHEN length(recommended_angle) < 8 THEN 'contact_shape' END) AS violations
    FROM (SELECT *, trim(executive_summary) AS s FROM $assessments) x""")
def _(v):
    return assessments(v).select("doc_id", F.array_join(G.validate_assessment(DIMENSIONS), ",").alias("violations"))


@query("validate_contacts", "SELECT doc_id, CASE WHEN length(recommended_angle) >= 8 THEN 'Mary Byrne' ELSE 'fallback' END AS name FROM $assessments")
def _(v):
    rows = assessments(v)
    fallback = F.transform("contacts", lambda c: c.withField("name", F.lit("fallback")))
    return rows.select("doc_id", F.get(G.validate_contacts(F.col("contacts"), fallback, NOT_A_NAME), 0)["name"].alias("name"))


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '([a-z]{{5,}})', 1)), lambda x: NOT list_contains([%s], x))" % ", ".join(f"'{w}'" for w in STOPWORDS)


@query("check_email", rf"""SELECT conv_id, turn, concat_ws(',', CASE WHEN w < 25 THEN 'too_short' END, CASE WHEN w > 180 THEN 'too_long' END,
      {", ".join(f"CASE WHEN contains(lower(subject) || chr(10) || lower(body), '{p}') THEN 'banned:{p}' END" for p in L.BANNED_PHRASES)},
      {", ".join(f"CASE WHEN contains(lower(body), '{p}') THEN 'competitor:{p}' END" for p in COMPETITORS)},
      CASE WHEN regexp_matches(subject || chr(10) || body, '{L.PLACEHOLDERS}') THEN 'placeholder' END, CASE WHEN regexp_matches(body, '{L.GENERIC_PITCH}') THEN 'generic_pitch' END,
      CASE WHEN len(g) > 0 AND NOT list_has_any(g, t) THEN 'ungrounded' END) AS issues
    FROM (SELECT *, len(regexp_extract_all(body, '([A-Za-z''’]+)', 1)) AS w, {TOKENS.format('grounding')} AS g, {TOKENS.format('body')} AS t FROM $outbox) x""")
def _(v):
    return v.outbox.select("conv_id", "turn", F.array_join(G.check_email("subject", "body", "grounding", COMPETITORS, STOPWORDS), ",").alias("issues"))
