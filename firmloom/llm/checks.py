"""DuckDB SQL that gives the rows of the queries, from the definitions and not by their methods."""

from functools import reduce

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)

_WORDS = "regexp_matches(hit, '(?i)example|placeholder|changeme|your_?key|xxxx|0123456789|abcdefgh')"


def _matches(kind: str, place: int, pattern: str, keep: str, source: str = "texts") -> str:
    """Rows doc, kind, place, start, text of one pattern's kept matches."""
    return f"""
        SELECT doc, '{kind}' AS kind, {place} AS place, m[i] AS hit,
               list_sum(list_transform(g[1:i], lambda x: length(x))) +
               coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos
        FROM (SELECT doc, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {source}))
        WHERE {keep}"""


OP2 = f"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
    {_matches("assign", 0, _ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN}', 2)) >= 6")}
    UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", "length(m[i]) >= 20")}
    UNION ALL {_matches("hex", 2, "[0-9a-f]+", "length(m[i]) >= 24")}),
runs AS ({_matches("run", 9, "[A-Za-z0-9+/_-]+", "length(m[i]) >= 20")}),
named AS (SELECT *, {_WORDS} AS named FROM runs),
within AS (SELECT struct_pack(doc := doc, pos := pos) AS doc, hit AS t FROM named WHERE named),
parts AS ({_matches("part", 9, "[A-Za-z0-9+]+", "length(m[i]) >= 20", "within")}),
pieces AS (
    SELECT doc, pos, hit, true AS hexadecimal FROM ({_matches("run", 9, "[0-9A-Fa-f]+", "length(m[i]) >= 20")})
    UNION ALL SELECT doc, pos, hit, false FROM named WHERE NOT named AND NOT regexp_full_match(hit, '[0-9A-Fa-f]+')
    UNION ALL SELECT doc.doc, doc.pos + pos, hit, false FROM parts WHERE NOT regexp_full_match(hit, '[0-9A-Fa-f]+')),
candidates AS (
    SELECT doc, pos, hit, hexadecimal FROM pieces
    WHERE NOT regexp_matches(hit, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
      AND regexp_matches(hit, '[0-9]') AND NOT regexp_full_match(hit, '[0-9+/_-]*') AND NOT {_WORDS}),
windows AS (SELECT *, unnest(range(1, length(hit) - 18)) AS i FROM candidates),
letters AS (SELECT doc, pos, hexadecimal, i, unnest(string_split(substr(hit, i, 20), '')) AS c FROM windows),
counts AS (SELECT doc, pos, hexadecimal, i, count(*) AS n FROM letters GROUP BY doc, pos, hexadecimal, i, c),
bits AS (SELECT doc, pos, hexadecimal, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM counts GROUP BY doc, pos, hexadecimal, i),
hot AS (
    SELECT doc, pos, hexadecimal, min(i) AS first, max(i) AS last FROM bits
    WHERE h >= CASE WHEN hexadecimal THEN 3.0 ELSE 3.75 END - 1e-9 GROUP BY doc, pos, hexadecimal),
spans AS (
    SELECT doc, kind, place, pos AS start, pos + length(hit) AS stop FROM base
    UNION ALL
    SELECT doc, CASE WHEN hexadecimal THEN 'entropy_hex' ELSE 'entropy_base64' END, CASE WHEN hexadecimal THEN 3 ELSE 4 END,
           pos + first - 1, pos + last + 19 FROM hot),
joined AS (
    SELECT doc, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
           string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place, stop)
               FILTER (place < 3) AS base,
           string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place, stop) AS every
    FROM spans GROUP BY doc)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM texts LEFT JOIN joined USING (doc)
"""

OP3 = f"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
    FROM words),
flat AS (SELECT doc, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc AS x, b.doc AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc <> b.doc
    GROUP BY a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(doc_id) AS m FROM reach JOIN sets ON y = doc GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN least ON x = doc
"""

OP4 = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS b FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(b) AS text_sha256
FROM texts WINDOW best AS (PARTITION BY b ORDER BY length(t) DESC, doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to, url
FROM p LEFT JOIN g USING (d)
"""


def _crc_steps(n: int, bits: int) -> int:
    """The CRC-32 register after `bits` zero bits."""
    for _ in range(bits):
        n = n >> 1 ^ 3988292384 if n & 1 else n >> 1
    return n


def _crc_back(n: int, bits: int) -> int:
    """The register that becomes `n` after `bits` zero bits."""
    for _ in range(bits):
        n = (n ^ 3988292384) << 1 | 1 if n >> 31 else n << 1
    return n


# Texts are cut into pieces of 256 bytes, so that the register runs over many pieces at once. The four
# bytes before the text set the register to its start value; zero bytes before them change nothing.
_START = _crc_back(4294967295, 32).to_bytes(4, "little").hex().upper()
_NIBBLE = [_crc_steps(n, 4) for n in range(16)]
_SHIFTED = [[_crc_steps(n << 4 * k, 2048) for n in range(16)] for k in range(8)]
_JOIN = reduce(lambda sql, k: f"xor({sql}, {_SHIFTED[k]}[((c >> {4 * k}) & 15) + 1])", range(1, 8), f"{_SHIFTED[0]}[(c & 15) + 1]")


OP6 = f"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, strlen(coalesce(text, '')) + 1 AS size,
           '{_START}' || hex(encode(coalesce(text, ''))) AS h FROM documents),
padded AS (SELECT row, lpad(h, CAST(ceil(length(h) / 512) * 512 AS INT), '0') AS h FROM texts),
pieces AS (SELECT row, p, substr(h, 512 * p + 1, 512) AS h FROM (SELECT row, h, unnest(range(length(h) // 512)) AS p FROM padded)),
registers AS (
    SELECT row, p, list_reduce(list_prepend(0::BIGINT, list_transform(range(512), lambda i:
        CAST(instr('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1 AS BIGINT))),
        lambda c, i: xor(c >> 4, {_NIBBLE}[xor(c, i) % 16 + 1])) AS r FROM pieces),
sums AS (
    SELECT row, xor(4294967295, list_reduce(list_prepend(0::BIGINT, list(r ORDER BY p)), lambda c, r: xor(r, {_JOIN}))) AS text_crc32
    FROM registers GROUP BY row),
draws AS (
    SELECT row, s, -ln((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(md5(doc_id || ':' || s), 1, 13), ''),
        lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, b: a * 16 + b) + 0.5) / 4503599627370496.0) AS cost
    FROM texts, range(17) shards(s)),
won AS (
    SELECT row, CAST(arg_min(s, cost) FILTER (s < 16) AS INT) AS shard, CAST(arg_min(s, cost) AS INT) AS grown_shard FROM draws GROUP BY row)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM texts JOIN sums USING (row) JOIN won USING (row)
"""

OP7 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, w, least(len(w), 10) AS size FROM (
        SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
places AS (
    SELECT row, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
        SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM items) sizes WHERE len(w) >= size)),
found AS (SELECT row, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.g = v.g),
hit AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM found) GROUP BY row),
named AS (
    SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

OP8 = """
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
    SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
filled AS (
    SELECT *, 2 * source_size / weight AS ratio, sum(weight) OVER () - sum(weight) OVER (ORDER BY 2 * source_size / weight, source) + weight AS open,
           (1.5::DOUBLE * sum(source_size) OVER () - (sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source) - 2 * source_size)) AS free
    FROM ranked),
level AS (SELECT arg_min(free / open, (ratio, source)) FILTER (ratio > free / open) AS l FROM filled),
targets AS (
    SELECT source, source_size, CASE WHEN ratio > l THEN weight * l ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM filled, level),
queue AS (
    SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size, row ROWS UNBOUNDED PRECEDING) AS upto
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
    SELECT row, doc_id, draw, round, size, (CAST(round * source_size + upto AS BIGINT)) / target AS finish
    FROM queue, range(2) rounds(round) WHERE size > 0),
ordered AS (SELECT row, size, sum(size) OVER (ORDER BY finish, draw, doc_id, row, round ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT row, sum(size) AS words FROM ordered WHERE total <= (SELECT sum(target) FROM targets) GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken FROM queue LEFT JOIN taken USING (row)
"""

# Terms of both tables, cut as in the operator; a NULL text has none.
_TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH terms AS (
    SELECT doc, doc_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS w FROM documents)),
counts AS (SELECT doc, doc_id, t, count(*) AS tf FROM terms GROUP BY doc, doc_id, t),
sizes AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, corpus GROUP BY t, docs),
items AS (
    SELECT item, item_id, unnest(w) AS t FROM (
        SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS w FROM benchmark)),
scores AS (
    SELECT item, item_id, doc, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
    FROM items JOIN weights USING (t) JOIN counts USING (t) JOIN sizes USING (doc), corpus GROUP BY item, item_id, doc, doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

OP13 = """
WITH rows AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, r.row, r.vec_id, a.label = r.label AS same,
           CAST(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.row <> r.row AND a.vec_id % 100 = 0),
near AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row) AS place
    FROM near p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 5
"""

CHECKS = {
    "op2_secret_scan": OP2, "op3_ngram_jaccard_join": OP3, "op4_exact_dedup": OP4, "op5_warc_transactions": OP5,
    "op6_rendezvous_sharding": OP6, "op7_benchmark_decontamination": OP7, "op8_weighted_mix": OP8,
    "op12_lexical_search": OP12, "op13_hard_negatives": OP13,
}
