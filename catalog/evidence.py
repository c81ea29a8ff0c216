"""Evidence from pages and search hits."""

from pyspark.sql import functions as F

from catalog.lists import INBOXES, NOT_A_NAME
from catalog.registry import query
from firmloom import lexicons as L
from firmloom.operators import evidence as W

STRIP = "|".join(rf"<{t}\b[^>]*>.*?</{t}[^>]*>" for t in ("script", "style", "noscript", "svg", "head"))


def page_text_sql(html: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({html}, '(?is){STRIP}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '[\s\x{{00A0}}]+', ' ', 'g'), '[^\x{{0020}}-\x{{007E}}\x{{00A0}}-\x{{00FF}}]', '', 'g'))"""


@query("page_text", f"""SELECT page_id, nullif(t, '') AS page_text FROM (SELECT page_id, {page_text_sql('html')} AS t FROM $pages) x""")
def _(v):
    return v.pages.select("page_id", W.page_text("html", decode=False).alias("page_text"))


NAMED = "map([" + ", ".join(f"'{n}'" for n in W.NAMED) + "], [" + ", ".join(f"chr({ord(c)})" if c else "''" for c in W.NAMED.values()) + "])"
HEXADECIMAL = "list_reduce(list_prepend(0, list_transform(string_split(lower(x[4:-2]), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, b: a * 16 + b)"


@query("page_text_decoded", rf"""
    WITH stripped AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is){STRIP}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM $pages),
    codes AS (SELECT page_id, string_split_regex(t, '{W.ENTITY}') AS between, regexp_extract_all(t, '{W.ENTITY}') AS found FROM stripped),
    numbers AS (SELECT *, list_transform(found, lambda x: CASE WHEN x[2] <> '#' THEN -1 WHEN lower(x[3]) = 'x' THEN {HEXADECIMAL} ELSE CAST(x[3:-2] AS INT) END) AS n FROM codes),
    texts AS (SELECT page_id, between, list_transform(found, lambda x, i: CASE WHEN x[2] <> '#' THEN coalesce({NAMED}[x[2:-2]], x)
        WHEN n[i] BETWEEN 1 AND 255 THEN chr(CAST(n[i] AS INT)) ELSE '' END) AS found FROM numbers),
    joined AS (SELECT page_id, array_to_string(list_transform(between, lambda b, i: b || coalesce(found[i], '')), '') AS t FROM texts)
    SELECT page_id, nullif(trim(regexp_replace(regexp_replace(t, '[\s\x{{00A0}}]+', ' ', 'g'), '[^\x{{0020}}-\x{{007E}}\x{{00A0}}-\x{{00FF}}]', '', 'g')), '') AS page_text
    FROM joined""")
def _(v):
    return v.pages.select("page_id", W.page_text("html").alias("page_text"))


@query("bot_challenge", f"""SELECT page_id, status IN (403, 503) AND (contains(lower(server), '{L.CHALLENGE_CDN}')
    OR {" OR ".join(f"contains(lower(html), '{m}')" for m in L.CHALLENGE_MARKERS)}) AS challenged FROM $served_pages""")
def _(v):
    return v.served_pages.select("page_id", W.is_bot_challenge("status", "server", "html").alias("challenged"))


# The invented pages link to invented words, so the link words are parameters here.
LINK_WORDS = "(?i)(the|and|die|que|los)"
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""


PEOPLE_LINKS = rf"""
    WITH anchors AS (
      SELECT page_id, url, host, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS label,
             unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS position FROM $served_pages),
    links AS (SELECT *, trim(split_part(href, '#', 1)) AS h, trim(regexp_replace(regexp_replace(label, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM anchors),
    resolved AS (SELECT *, CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '/') AND NOT starts_with(h, '//')
                        THEN split_part(url, '/', 1) || '//' || split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1) || h END AS link FROM links),
    wanted AS (SELECT page_id, link, min(position) AS position FROM resolved
               WHERE link IS NOT NULL AND regexp_replace(lower(split_part(split_part(split_part(link, '/', 3), '?', 1), '#', 1)), '^www\.', '') = regexp_replace(host, '^www\.', '')
                 AND regexp_replace(link, '/$', '') <> regexp_replace(split_part(url, '#', 1), '/$', '')
                 AND regexp_matches(regexp_replace(link, '^[A-Za-z]+://[^/]*', '') || ' ' || words, '{LINK_WORDS}') GROUP BY page_id, link)
    SELECT page_id, link, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n FROM wanted) x"""


@query("people_links", PEOPLE_LINKS)
def _(v):
    return W.people_links(v.served_pages, ["page_id"], LINK_WORDS).select("page_id", "link", "place")


@query("people_probes", rf"""
    WITH sites AS (SELECT company_id, arg_min(url, rank) AS url, arg_min(page_id, rank) AS page_id FROM $hits WHERE rank < 1000000 GROUP BY company_id),
    linked AS (SELECT s.company_id, l.place, l.link AS probe FROM sites s JOIN ({PEOPLE_LINKS}) l ON l.page_id = s.page_id),
    paths AS (SELECT unnest([{", ".join(f"'{p}'" for p in L.PEOPLE_PATHS)}]) AS path, unnest(range({len(L.PEOPLE_PATHS)})) AS place),
    usual AS (SELECT company_id, 1000 + place AS place, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || path AS probe FROM sites, paths),
    firsts AS (SELECT company_id, probe, min(place) AS place FROM (SELECT * FROM linked UNION ALL SELECT company_id, place, probe FROM usual) x GROUP BY ALL),
    probes AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.company_id = firsts.company_id AND split_part(s.url, '?', 2) <> ''
               AND probe = regexp_extract(s.url, '^([A-Za-z]+://[^/?#]+)', 1) || '/team'))
    SELECT company_id, probe, CAST(row_number() OVER (PARTITION BY company_id ORDER BY place, probe) AS INTEGER) AS place FROM probes""")
def _(v):
    sites = v.hits.filter("rank < 1000000").groupBy("company_id").agg(F.min_by("url", "rank").alias("url"), F.min_by("page_id", "rank").alias("page_id"))
    pages = sites.select("company_id", "page_id").join(v.served_pages.select("page_id", "url", "html"), "page_id")
    links = W.people_links(pages, ["company_id"], LINK_WORDS)
    team = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1), F.lit("/team"))
    fetched = sites.filter(F.split_part("url", F.lit("?"), F.lit(2)) != "").select("company_id", team.alias("url"))
    return W.people_probes(sites, links, fetched).select("company_id", "probe", "place")


@query("select_people_pages", rf"""
    WITH texts AS (SELECT split_part(host, '.', 2) AS company_id, page_id AS place, url, {page_text_sql('html')} AS text FROM $served_pages),
    readable AS (SELECT * FROM texts WHERE text <> ''),
    marked AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\b({"|".join(L.ROLE_WORDS)})s?\b') OR regexp_matches(text, '{L.EMAIL}') OR regexp_matches(text, '{L.PHONE}') THEN 0
                     WHEN contains(lower(url), 'contact') THEN 1 ELSE 2 END AS kind,
               row_number() OVER (PARTITION BY company_id, text ORDER BY place, url) AS copy FROM readable),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY company_id, kind ORDER BY place, url) AS n FROM marked WHERE copy = 1),
    chosen AS (SELECT *, max(CASE WHEN kind < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY company_id) AS any_kept FROM firsts),
    kept AS (SELECT * FROM chosen WHERE kind = 0 OR (kind = 1 AND n = 1) OR (kind = 2 AND n = 1 AND any_kept = 0))
    SELECT company_id, url, text FROM kept""")
def _(v):
    probed = v.served_pages.select(
        F.split_part("host", F.lit("."), F.lit(2)).alias("company_id"), F.col("page_id").alias("place"), "url",
        W.page_text("html", decode=False).alias("text"))
    return W.select_people_pages(probed).select("company_id", "url", "text")


ANCHORED = """SELECT d.doc_id, CASE WHEN d.source IN ('src1', 'src2') THEN d.text || ' ' || c.registered_address WHEN d.lang = 'de' THEN 'No ' || c.cro_number || d.text
      ELSE d.text END AS page, CASE WHEN d.source = 'src2' THEN 'A1' ELSE substring(c.registered_address, length(c.registered_address) - 7, 8) END AS eircode, c.cro_number, c.cbi_reference, c.registered_address
      FROM $documents d JOIN $companies c ON c.id = 'C' || CAST(d.doc_id AS STRING)"""


@query("identity_anchor", rf"""SELECT doc_id, (length(sq) = 7 AND contains(regexp_replace(body, '\s+', '', 'g'), sq))
      OR (length(cro_number) >= 5 AND contains(body, lower(cro_number)))
      OR (length(coalesce(cbi_reference, '')) >= 5 AND contains(body, lower(coalesce(cbi_reference, ''))))
      OR (length(trim(split_part(registered_address, ',', 1))) >= 8 AND contains(body, lower(trim(split_part(registered_address, ',', 1))))) AS anchored
    FROM (SELECT *, lower(page) AS body, lower(replace(eircode, ' ', '')) AS sq FROM ({ANCHORED}) a) b""")
def _(v):
    rows = v.spark.sql(ANCHORED.replace("$documents", "{documents}").replace("$companies", "{companies}"), documents=v.documents, companies=v.companies)
    return rows.select("doc_id", W.identity_anchor(F.col("page"), {a: F.col(a) for a in W.ANCHORS}).alias("anchored"))


def _candidates(v):
    """Result pages with their text and their firm's names and anchors."""
    capped = W.cap_candidates(v.hits)
    names = v.hits.groupBy("company_id").agg(
        F.first("legal_name").alias("legal_name"), F.min("trading_name").alias("trading_name"))
    served = v.served_pages.select("url", "status", "server", "html")
    none = F.lit(None).cast("string")
    return capped.join(served, "url").join(names, "company_id").withColumns({
        "text": W.page_text("html"), "eircode": none, "cro_number": none, "cbi_reference": none, "registered_address": none})


@query("site_match_score")
def _(v):
    return W.site_match_score(_candidates(v)).select("company_id", "url", "site_score")


@query("best_site")
def _(v):
    return W.best_site(W.site_match_score(_candidates(v), sector_words=["the", "die", "que", "los"])).select("company_id", "url", "site_score")


@query("blocked_candidates")
def _(v):
    return W.blocked_candidates(_candidates(v)).select("company_id", F.array_join("blocked", " ").alias("blocked"))


SOCIAL = " OR ".join(f"contains(lower(url), '{m}')" for m, _ in L.SOCIAL_HOSTS)


@query("cap_candidates", f"""
    WITH firsts AS (SELECT company_id, url, arg_min(title, (query_no, rank)) AS title, min((query_no, rank)) AS seen_at FROM $hits WHERE NOT ({SOCIAL}) GROUP BY company_id, url)
    SELECT company_id, CAST(n AS INTEGER) AS place, title, url FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seen_at, url) AS n FROM firsts) x""")
def _(v):
    return W.cap_candidates(v.hits).select("company_id", "place", "title", "url")


SQUASH = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("social_links", f"""
    WITH p AS (SELECT *, CASE {" ".join(f"WHEN contains(lower(url), '{m}') THEN '{n}'" for m, n in L.SOCIAL_HOSTS)} END AS platform,
               {SQUASH.format("url || ' ' || title")} AS hay, {SQUASH.format("split_part(trim(legal_name), ' ', 1)")} AS a, {SQUASH.format("split_part(trim(trading_name), ' ', 1)")} AS b FROM $hits)
    SELECT company_id, platform, arg_min(url, (query_no, rank, url)) AS url FROM p
    WHERE platform IS NOT NULL AND ((length(a) >= 4 AND contains(hay, a)) OR (length(b) >= 4 AND contains(hay, b))) GROUP BY company_id, platform""")
def _(v):
    return W.social_links(v.hits).select("company_id", F.explode("social_links").alias("platform", "url"))


@query("linkedin_hits", """SELECT company_id, CAST(n AS INTEGER) AS place, title || ' ' || url AS hit FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY query_no, rank, url) AS n FROM $hits WHERE contains(lower(url), 'linkedin.com')) x""")
def _(v):
    return W.linkedin_hits(v.hits)


QUOTED = "'\"' || {} || '\"'"


@query("search_queries", f"""SELECT id, array_to_string(list_filter([{QUOTED.format('trading_name')} || ' insurance broker', {QUOTED.format('legal_name')} || ' insurance',
      {QUOTED.format('legal_name')} || ' ' || cro_number, {QUOTED.format('legal_name')} || ' ' || cbi_reference, legal_name || ' ' || county, legal_name || ' ' || trim(string_split(registered_address, ',')[-2])], lambda x: x IS NOT NULL), '|') AS queries
    FROM $companies""")
def _(v):
    return v.companies.select("id", F.array_join(W.search_queries(), "|").alias("queries"))


TRADING = "CASE WHEN c_acctbal > 3000 THEN replace(c_name, '#', '') || '.ie' WHEN c_acctbal > 1000 THEN 'Al.com' WHEN c_acctbal > 0 THEN c_mktsegment || '.com one two' END"


@query("domain_guesses", f"""SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN 'https://www.' || lower(replace(c_name, '#', '')) || '.ie https://' || lower(replace(c_name, '#', '')) || '.ie' ELSE '' END AS guesses
    FROM $customer""")
def _(v):
    return v.customer.select("c_custkey", F.array_join(W.domain_guesses(F.expr(TRADING)), " ").alias("guesses"))


TLD = "CASE " + " ".join(f"WHEN contains(host, '{t}') THEN '{t}'" for t in L.PLAUSIBLE_TLDS) + " END"
CORE = f"regexp_replace(split_part(host, {TLD}, 1), '[^a-z0-9-]', '', 'g')"


@query("guessed_sites", f"""
    WITH placed AS (SELECT page_id, host, 'https://' || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || {CORE} || {TLD} AS url, html FROM $served_pages),
    texts AS (SELECT host, page_id, url, nullif({page_text_sql('html')}, '') AS text FROM placed),
    firms AS (SELECT DISTINCT host AS company_id FROM $served_pages WHERE length({CORE}) >= 3),
    found AS (SELECT company_id, page_id, t.url, text, CASE WHEN t.url LIKE 'https://www.%' THEN 0 ELSE 1 END AS guess
              FROM firms f JOIN texts t ON t.host = f.company_id WHERE text IS NOT NULL)
    SELECT company_id, arg_min(page_id, (guess, page_id)) AS page_id, arg_min(url, (guess, page_id)) AS url, min(guess) AS guess FROM found GROUP BY company_id""")
def _(v):
    tld = F.coalesce(*[F.when(F.col("host").contains(t), F.lit(t)) for t in L.PLAUSIBLE_TLDS])
    root = F.concat(F.regexp_replace(F.split_part("host", tld, F.lit(1)), "[^a-z0-9-]", ""), tld)
    www = F.when(F.col("page_id") % 2 == 0, "www.").otherwise("")
    # Several pages share a guessed address here; the first of them counts.
    pages = v.served_pages.select("page_id", F.concat(F.lit("https://"), www, root).alias("url"), "html")
    firms = v.served_pages.select(F.col("host").alias("company_id"), F.upper("host").alias("trading_name")).distinct()
    one = pages.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), F.struct(W.page_text("html").isNull(), "page_id")).alias("p"))
    return W.guessed_sites(firms, one.select("url", "p.page_id", "p.html")).select("company_id", "page_id", "url", F.col("guess"))


@query("site_document", f"""
    WITH main AS (SELECT page_id, url, split_part(split_part(html, '<title>', 2), '</title>', 1) AS title, html FROM $pages),
    extra AS (SELECT 1 AS place, page_id, url || html AS text FROM $pages UNION ALL SELECT 0, page_id, html || url FROM $pages WHERE url LIKE 'https%'),
    parts AS (SELECT page_id, string_agg(chr(10) || '{W.PAGE_SEPARATOR}' || chr(10) || text, '' ORDER BY place) AS tail FROM extra GROUP BY page_id)
    SELECT m.page_id, '[' || title || '](' || url || ')' || chr(10) || html || tail AS website_text FROM main m JOIN parts p ON p.page_id = m.page_id""")
def _(v):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    main = v.pages.select(F.col("page_id").alias("company_id"), title.alias("title"), "url", F.col("html").alias("text"))
    extra = v.pages.select(F.col("page_id").alias("company_id"), F.lit(1).alias("place"), F.concat("url", "html").alias("text")).unionByName(
        v.pages.filter("url like 'https%'").select(F.col("page_id").alias("company_id"), F.lit(0).alias("place"), F.concat("html", "url").alias("text")))
    return W.site_document(main, extra).select(F.col("company_id").alias("page_id"), "website_text")


SITE_TEXT = f"""SELECT doc_id, lang, source, n_chars, CASE lang WHEN 'en' THEN '[T](https://www.Firm' || CAST(doc_id AS STRING) || '.ie/x)' || chr(10) || text || chr(10) || '{W.PAGE_SEPARATOR}' || chr(10) || source
      WHEN 'fr' THEN text WHEN 'de' THEN '' END AS site FROM $documents"""


def _site_text(v):
    return v.spark.sql(SITE_TEXT.replace("$documents", "{documents}"), documents=v.documents)


CHANNEL = f"CASE WHEN regexp_matches(site, '{L.EMAIL}') THEN 'email' WHEN regexp_matches(site, '{L.PHONE}') THEN 'phone' WHEN regexp_matches(site, '{L.FORM_WORDS}') THEN 'form_only' ELSE 'none' END"


@query("digital_presence", f"""SELECT doc_id, lang = 'en' AS has_website, CASE WHEN lang = 'en' THEN 'firm' || CAST(doc_id AS VARCHAR) || '.ie' END AS domain,
      CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS pages_crawled, CASE WHEN coalesce(site, '') = '' THEN 'none' ELSE channel END AS contact_channel,
      CASE WHEN lang = 'en' AND channel = 'form_only' THEN 'Website reachable, contact form only' WHEN lang = 'en' THEN 'Website crawled' WHEN lang = 'fr' THEN NULL
           WHEN lang = 'de' THEN 'Website could not be read, access blocked: ' || source ELSE 'No verified website' END AS notes
    FROM (SELECT *, {CHANNEL} AS channel FROM ({SITE_TEXT}) s) x""")
def _(v):
    blocked = F.when(F.col("lang") == "de", F.array("source"))
    p = W.digital_presence("site", blocked=blocked)
    return _site_text(v).select("doc_id", p.alias("p")).select(
        "doc_id", "p.has_website", "p.domain", "p.pages_crawled", "p.contact_channel", "p.notes")


PERSON = "([A-Z][A-Za-z''-]+(?: [A-Z][A-Za-z''-]+){1,3})"
ROLE = "((?i:" + "|".join(L.ROLE_WORDS) + "))"
BEFORE, AFTER = rf"{PERSON}\s*[,:–-]\s*{ROLE}\b", rf"\b{ROLE}\s*[,:–-]\s*{PERSON}"


@query("extract_contacts", rf"""
    WITH texts AS (SELECT doc_id, text || ' Mary Byrne, Director. Sean O''Neill - Partner. mary.byrne@firm.ie info@firm.ie ' || source || '@firm.ie' AS t
                   FROM $documents),
    pairs AS (SELECT doc_id, list_zip(regexp_extract_all(t, '{BEFORE}', 1) || regexp_extract_all(t, '{AFTER}', 2),
                                      regexp_extract_all(t, '{BEFORE}', 2) || regexp_extract_all(t, '{AFTER}', 1)) AS p,
                     list_transform(regexp_extract_all(t, '{L.EMAIL}'), lambda e: lower(e)) AS e FROM texts),
    people AS (SELECT doc_id, p[i][1] AS name, min(i) AS spot, arg_min(p[i][2], i) AS role
               FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pairs) GROUP BY doc_id, p[i][1]),
    tokens AS (SELECT doc_id, name, role, spot, unnest(string_split(lower(name), ' ')) AS token FROM people),
    emails AS (SELECT doc_id, e[i] AS email, split_part(e[i], '@', 1) AS local, min(i) AS spot
               FROM (SELECT doc_id, e, unnest(range(1, len(e) + 1)) AS i FROM pairs) GROUP BY ALL),
    owners AS (SELECT doc_id, email, arg_min(name, t.spot) AS name, arg_min(role, t.spot) AS role
               FROM emails JOIN tokens t USING (doc_id) WHERE length(token) >= 3 AND contains(local, token) GROUP BY doc_id, email),
    mailed AS (
      SELECT doc_id, e.spot, e.email, o.name AS own, o.role,
             translate(local, '._-', '') IN ({", ".join(f"'{i}'" for i in INBOXES)}) AS generic,
             array_to_string(list_transform(string_split(regexp_replace(local, '[._-]+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS guess
      FROM emails e LEFT JOIN owners o USING (doc_id, email)),
    listed AS (
      SELECT doc_id, 0 AS part, spot, CASE WHEN generic THEN 'General enquiries' ELSE coalesce(own, guess) END AS name,
             CASE WHEN generic THEN 'Office inbox' ELSE role END AS role, email,
             CASE WHEN generic THEN 'channel' WHEN own IS NOT NULL THEN 'person' ELSE 'inferred' END AS detail FROM mailed),
    every AS (
      SELECT * FROM listed UNION ALL
      SELECT doc_id, 1, spot, name, role, NULL, 'person' FROM people p
      WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.doc_id = p.doc_id AND l.name = p.name))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, spot) - 1 AS INTEGER) AS position, name, role, email, detail FROM every""")
def _(v):
    text = F.concat(F.col("text"), F.lit(" Mary Byrne, Director. Sean O'Neill - Partner. mary.byrne@firm.ie info@firm.ie "), F.col("source"), F.lit("@firm.ie"))
    rows = v.documents.select("doc_id", text.alias("text"))
    return W.find_contacts(rows, ["doc_id"], "text", INBOXES).select("doc_id", "position", "name", "role", "email", "detail")


PEOPLE = """SELECT source AS company_id, doc_id AS position,
      CASE lang WHEN 'en' THEN 'Mary Byrne' WHEN 'fr' THEN 'Our Team' WHEN 'de' THEN 'Person Number' ELSE 'x' END AS name,
      CASE WHEN lang = 'fr' THEN CASE WHEN n_chars % 2 = 0 THEN 'Info@a.ie' ELSE 'office@a.ie' END WHEN lang = 'es' THEN NULL ELSE 'mary@a.ie' END AS email FROM $documents"""


@query("sanitise_contacts", f"""
    WITH p AS (SELECT *, CASE WHEN name IN ('Mary Byrne', 'Person Number') THEN 'person' WHEN name = 'Our Team' THEN 'inbox' ELSE 'dropped' END AS kind,
               CASE WHEN name = 'Our Team' THEN lower(email) WHEN name = 'x' THEN '#' || CAST(position AS VARCHAR) ELSE lower(name) END AS identity FROM ({PEOPLE}) x),
    n AS (SELECT *, row_number() OVER (PARTITION BY company_id, kind, identity ORDER BY position) AS k FROM p)
    SELECT company_id, position, CASE WHEN kind = 'inbox' THEN 'General enquiries' ELSE name END AS name_out,
           CASE WHEN kind = 'dropped' OR k > 1 THEN 'dropped' WHEN kind = 'inbox' THEN 'relabelled' ELSE 'kept' END AS verdict,
           CASE WHEN kind = 'dropped' THEN 'not a plausible person' WHEN k > 1 THEN 'duplicate' END AS reason FROM n""")
def _(v):
    people = v.spark.sql(PEOPLE.replace("$documents", "{documents}"), documents=v.documents)
    return W.sanitise_contacts(people, NOT_A_NAME, INBOXES).select("company_id", "position", "name_out", "verdict", "reason")


PRESENCE = """SELECT c.*, c.cro_status = 'Normal' AS has_site, CASE WHEN c.cro_status = 'Normal' THEN 'site-' || c.id END AS domain,
      CASE WHEN c.trading_name IS NULL THEN 'none' ELSE 'email' END AS channel,
      CASE WHEN c.cro_status = 'Normal' THEN 'Our director: a@b.ie' WHEN c.cro_status = '' THEN 'plain text' END AS site FROM $companies c"""


def _presence(v):
    rows = v.spark.sql(PRESENCE.replace("$companies", "{companies}"), companies=v.companies)
    p = F.struct(F.col("has_site").alias("has_website"), "domain", F.col("channel").alias("contact_channel"), F.lit("n").alias("notes"))
    contacts = F.when(F.col("channel") == "email", F.array(F.struct(F.col("legal_name").alias("name")))).otherwise(
        F.array().cast("array<struct<name:string>>"))
    return rows.withColumns({"presence": p, "contacts": contacts})


FACTS = [
    ("coalesce(cro_number, '') <> ''", "'Registry number ' || cro_number", "Registry number"),
    ("lower(coalesce(cro_status, '')) = 'normal'", "'Active on the registry'", "Active registry status"),
    ("cbi_reference IS NOT NULL", "'Regulator reference ' || cbi_reference", "Regulator reference"),
    ("incorporation_date IS NOT NULL", "'Incorporated ' || strftime(TRY_CAST(incorporation_date AS DATE), '%-d %b %Y')", "Incorporation date"),
    ("last_annual_return IS NOT NULL", "'Annual return ' || strftime(TRY_CAST(last_annual_return AS DATE), '%-d %b %Y')", "Annual return"),
    ("coalesce(has_site, false)", "'Website ' || coalesce(domain, '')", "Verified website"),
    ("channel IN ('email', 'phone')", "'Contact by ' || channel", "Direct contact channel"),
    ("channel = 'email'", "'1 contacts'", "Named contacts"),
]


@query("research_coverage", f"""SELECT id,
      concat_ws('; ', {", ".join(f"CASE WHEN {t} THEN {yes} END" for t, yes, _ in FACTS)}) AS verified,
      concat_ws('; ', {", ".join(f"CASE WHEN NOT ({t}) THEN '{gap}' END" for t, _, gap in FACTS)}) AS missing FROM ({PRESENCE}) x""")
def _(v):
    rows = _presence(v)
    c = W.research_coverage(F.col("presence"), F.col("contacts"))
    return rows.select("id", F.array_join(c["verified"], "; ").alias("verified"), F.array_join(c["missing"], "; ").alias("missing"))


@query("research_confidence", """SELECT id, CAST(least(100, 20 + CASE WHEN coalesce(cro_number, '') <> '' THEN 10 ELSE 0 END + CASE WHEN lower(coalesce(cro_status, '')) = 'normal' THEN 5 ELSE 0 END
      + CASE WHEN cbi_reference IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN trading_name IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN site IS NOT NULL THEN 25 ELSE 0 END
      + CASE WHEN domain IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN site LIKE '%director%' THEN 15 ELSE 0 END
      + CASE WHEN last_annual_return IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN incorporation_date IS NOT NULL THEN 5 ELSE 0 END) AS INTEGER) AS confidence FROM (""" + PRESENCE + ") x")
def _(v):
    rows = _presence(v)
    listed = F.when(F.col("trading_name").isNotNull(), F.array(F.lit("a"), F.lit("b")))
    return rows.select("id", W.research_confidence(F.col("presence"), F.col("site"), listed).alias("confidence"))


@query("sources_reviewed", f"""SELECT page_id, '{"|".join(L.REGISTRY_SOURCES)}' || CASE WHEN url LIKE 'https%' THEN '|website:' || regexp_replace(host, '^www\\.', '') ELSE '' END
      || '|search:' || regexp_replace(host, '^www\\.', '') || '|search:' || CASE WHEN url LIKE '%?%' THEN title ELSE 'x' || CAST(page_id AS VARCHAR) END AS sources
    FROM (SELECT *, split_part(split_part(html, '<title>', 2), '</title>', 1) AS title FROM $served_pages) x""")
def _(v):
    title = F.split_part(F.split_part("html", F.lit("<title>"), F.lit(2)), F.lit("</title>"), F.lit(1))
    second = F.when(F.col("url").like("%?%"), "").otherwise(F.concat(F.lit("x"), F.col("page_id").cast("string")))
    hits = F.array(F.struct(title.alias("title"), F.col("url")), F.struct(title.alias("title"), second.alias("url")))
    site = F.when(F.col("url").like("https%"), F.regexp_replace("host", r"^www\.", ""))
    return v.served_pages.select("page_id", F.array_join(W.sources_reviewed(site, hits), "|").alias("sources"))


@query("reconcile_presence", f"""SELECT doc_id, coalesce(has_website, false) AND NOT wrong AS has_website, CASE WHEN NOT (wrong AND has_website) THEN 'd' || source END AS domain,
      CASE WHEN wrong AND has_website THEN 'Website found does not appear to be the firm''s' ELSE presence_notes END AS notes
    FROM (SELECT *, regexp_matches(executive_summary || ' ' || CASE WHEN lang = 'fr' THEN 'different business' ELSE 'fine' END, '{L.RECONCILE_MISMATCH}') AS wrong FROM $assessments) x""")
def _(v):
    p = F.struct("has_website", F.concat(F.lit("d"), "source").alias("domain"), F.col("presence_notes").alias("notes"))
    avoid = F.when(F.col("lang") == "fr", "different business").otherwise("fine")
    fixed = W.reconcile_presence(p, F.col("executive_summary"), avoid, F.lit(None).cast("string"))
    return v.assessments.select("doc_id", fixed.alias("p")).select("doc_id", "p.has_website", "p.domain", "p.notes")


@query("evidence_context", rf"""SELECT c.id, concat_ws(chr(10), 'Legal name: ' || legal_name, 'Trading name: ' || nullif(trading_name, ''), 'Registry number: ' || cro_number,
      'Registry status: ' || nullif(cro_status, ''), 'Regulator reference: ' || cbi_reference, 'County: ' || county,
      'Incorporated: ' || strftime(TRY_CAST(incorporation_date AS DATE), '%-d %b %Y'), 'Authorisations: Insurance distributor; Mortgage intermediary',
      CASE WHEN coalesce(trim(site), '') <> '' THEN 'Website:' || chr(10) || trim(site, ' ') WHEN source = 'src1' THEN 'Website: exists but blocked automated reading (a.ie)'
           ELSE 'Website: none verified' END,
      'Search results:' || chr(10) || '- ' || source || chr(10) || '- ' || legal_name) AS context
    FROM $companies c JOIN ({SITE_TEXT}) s ON c.id = 'C' || CAST(s.doc_id AS VARCHAR)""")
def _(v):
    firms = v.companies.join(_site_text(v).select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"), "site", "source"), "id")
    block = W.evidence_context(
        F.col("site"), F.array("source", "legal_name"), F.array().cast("array<string>"),
        F.when(F.col("source") == "src1", F.array(F.lit("a.ie"))), F.array(F.lit("insurance"), F.lit("mortgage")))
    return firms.select("id", block.alias("context"))


@query("outreach_inputs", """
    WITH best AS (SELECT doc_id, source, lang, executive_summary AS summary, recommended_angle AS angle, 'Firm ' || CAST(doc_id AS VARCHAR) AS firm,
                         CASE WHEN n_chars > 500 THEN 'a-' || source WHEN lang IN ('en', 'fr') THEN 'b' WHEN lang <> 'de' THEN 'c' END AS name FROM $assessments),
    told AS (SELECT *, concat_ws(', ', name, 'Director') AS recipient FROM best)
    SELECT doc_id, recipient, 3 AS contact_count, source AS reference_points, concat_ws(' ', firm, summary, source, source) AS grounding,
           concat_ws(chr(10), 'To: ' || recipient, 'Firm: ' || firm, 'Angle: ' || angle, CASE WHEN summary <> '' THEN 'Summary: ' || summary END) AS context
    FROM told""")
def _(v):
    from catalog.leads import contact_arrays
    from firmloom.operators.leads import rank_contacts

    firms = contact_arrays(v).join(v.assessments.select("doc_id", "executive_summary", "recommended_angle"), "doc_id").withColumn(
        "legal_name", F.concat(F.lit("Firm "), F.col("doc_id").cast("string")))
    with_role = F.transform(rank_contacts(F.col("contacts")), lambda c: c.withField("role", F.lit("Director")))
    narrative = F.struct(
        "executive_summary", "recommended_angle", F.lit(None).cast("array<string>").alias("reference_points"),
        F.array("source").alias("reference"), F.array().cast("array<string>").alias("avoid"), F.array("lang").alias("discovery"))
    firms = firms.withColumns({"ranked": with_role, "narrative": narrative})
    out = W.outreach_inputs(F.col("ranked"), F.col("narrative"), F.array("source"), F.get("ranked", 0))
    return firms.select("doc_id", out.alias("o")).select(
        "doc_id", "o.recipient", "o.contact_count", "o.context", F.array_join("o.reference_points", "|").alias("reference_points"), "o.grounding")
