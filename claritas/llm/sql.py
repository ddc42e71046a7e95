"""SQL twins, for DuckDB."""

# Shared SQL: words of a text, A-Z lower-cased.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

BLANK_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(reach.y), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id, n.n
"""


def _spans(kind: int, pattern: str, value: str, keep: str) -> str:
    """Rows (doc_id, source, kind, start, stop, value) of one kind: matches, and the gaps between them."""
    return f"""
SELECT doc_id, source, {kind} AS kind, p + len(g) AS start, p + len(g) + len(m) AS stop, {value} AS value FROM (
  SELECT doc_id, source, ms[i] AS m, gs[i] AS g, list_sum(list_transform(gs[1:i - 1], lambda x: len(x))) AS pg,
         coalesce(list_sum(list_transform(gs[1:i - 1], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS p
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms, string_split_regex(coalesce(text, ''), '{pattern}') AS gs FROM documents)))
WHERE {keep}"""


KEY = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
KEY_VALUE = r"""regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)"""
NAMES = "['assign', 'access', 'hex', 'token', 'pem'][kind + 1] || ':' || start || ':' || stop"

KNOWN = "^(sk_live_|rk_live_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|AIza|npm_|hf_)"
SHAPED = f"""regexp_matches(m, '[0-9]') AND NOT regexp_full_match(m, '[0-9a-f]{{32,}}') AND (regexp_matches(m, '{KNOWN}')
  OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND NOT regexp_matches(m, '(^|[/_=-])[A-Z]?[a-z]{{2,}}([/_=-]|$)')))"""

OP7_SQL = f"""
WITH spans AS ({_spans(0, KEY, KEY_VALUE, f"len({KEY_VALUE}) >= 8")}
UNION ALL {_spans(1, "AKIA[A-Z0-9]{12,}", "m", "true")}
UNION ALL {_spans(2, "[0-9a-f]{32,}", "m", "true")}
UNION ALL {_spans(3, "[A-Za-z0-9+/_=-]{20,}", "m", SHAPED)}
UNION ALL {_spans(4, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "m", "true")}),
kept AS (SELECT * FROM spans s WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop)),
owners AS (SELECT value, count(DISTINCT coalesce(source, '?')) AS n, count(DISTINCT doc_id) AS copies FROM kept GROUP BY value),
judged AS (SELECT kept.*, n <= 2 AND copies <= 20 * n AS live FROM kept JOIN owners USING (value)),
each AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({NAMES}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg({NAMES}, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN each USING (doc_id)
"""


def crc32_sql(column: str) -> str:
    """CRC-32 (IEEE) of an integer's decimal text, bit by bit over its bytes."""
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    byte = "list_reduce(list_prepend(CAST(xor(c, x) AS BIGINT), [CAST(k AS BIGINT) for k in range(8)]), lambda v, k: " + step.format("v") + ")"
    codes = f"[CAST(ascii(ch) AS BIGINT) for ch in string_split(CAST({column} AS VARCHAR), '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: {byte}), 4294967295)"


def discount_sql(name: str, source: str, column: str) -> str:
    return f"""{name}_n AS (SELECT count(*) FILTER ({column} = 1) AS n1, count(*) FILTER ({column} = 2) AS n2, count(*) FILTER ({column} = 3) AS n3, count(*) FILTER ({column} = 4) AS n4 FROM {source}),
{name} AS (SELECT CASE WHEN n1 * n2 = 0 THEN 0.5::DOUBLE ELSE least(1, greatest(0.05, 1 - 2 * y * n2 / n1)) END AS d1,
                  CASE WHEN n1 * n2 = 0 THEN 0.5::DOUBLE ELSE least(2, greatest(0.05, 2 - 3 * y * n3 / n2)) END AS d2,
                  CASE WHEN n1 * n2 = 0 THEN 0.5::DOUBLE WHEN n3 = 0 THEN 1.5 ELSE least(3, greatest(0.05, 3 - 4 * y * n4 / n3)) END AS d3
           FROM (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM {name}_n))"""


OP9_SQL = f"""
WITH w AS (SELECT doc_id, {crc32_sql('doc_id')} % 5 = 1 AS held_out, list_append({BLANK_WORDS}, '</s> ') AS w FROM documents),
t AS (SELECT doc_id, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN '<s> ' ELSE w[i - 1] END AS u
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
starts AS (SELECT count(*) AS d FROM w WHERE NOT held_out),
b AS (SELECT u, w, count(*) AS b FROM t WHERE NOT held_out GROUP BY u, w),
k AS (SELECT w, count(*) AS k FROM b GROUP BY w),
{discount_sql('hi', 'b', 'b')},
{discount_sql('lo', 'k', 'k')},
mass AS (SELECT u, sum(CASE WHEN b = 1 THEN d1 WHEN b = 2 THEN d2 ELSE d3 END) AS mass FROM b, hi GROUP BY u),
low AS (SELECT sum(k)::DOUBLE AS total, sum(CASE WHEN k = 1 THEN d1 WHEN k = 2 THEN d2 ELSE d3 END) AS freed FROM k, lo),
p AS (SELECT t.doc_id, coalesce(c.c, 0) AS c,
        (coalesce(k.k - CASE WHEN k.k = 1 THEN lo.d1 WHEN k.k = 2 THEN lo.d2 ELSE lo.d3 END, 0) + low.freed / (size.v + 1)) / low.total AS q,
        CASE WHEN t.u = '<s> ' THEN starts.d ELSE coalesce(cu.c, 0) END AS cu, coalesce(mass.mass, 0) AS mass,
        coalesce(b.b - CASE WHEN b.b = 1 THEN hi.d1 WHEN b.b = 2 THEN hi.d2 ELSE hi.d3 END, 0) AS kept
      FROM t LEFT JOIN c ON c.w = t.w LEFT JOIN k ON k.w = t.w LEFT JOIN b ON b.u = t.u AND b.w = t.w
      LEFT JOIN c cu ON cu.w = t.u LEFT JOIN mass ON mass.u = t.u, hi, lo, low, size, starts)
SELECT w.doc_id, w.held_out, count(*) AS n_tokens, count(*) FILTER (p.c > 0) AS n_known, any_value(size.n) AS train_tokens,
       round(sum(log10((p.c + 0.5) / (size.n + 0.5 * (size.v + 1)))), 6) AS base_score,
       round(sum(log10(CASE WHEN cu = 0 THEN q ELSE kept / cu + mass / cu * q END)), 6) AS score
FROM w JOIN p USING (doc_id), size GROUP BY w.doc_id, w.held_out
"""

# For the form of the given pages: one article of h1 and p blocks, text references &amp; and &quot; only.
OP10_SQL = r"""
WITH blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>'),
  lambda b: trim(regexp_replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM pages),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


# Rendered as op12 writes it: control strings get one more backslash, other roles are named after "=".
CHAT_TEXT = r"""regexp_replace(regexp_replace(coalesce(text, ''), '#(\\*)## (System|User|Assistant|Tool|=|\?)', '#\\\1## \2', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g')"""
CHAT_ROLE = r"""CASE WHEN role IS NULL THEN '?' WHEN role IN ('system', 'user', 'assistant', 'tool') THEN upper(role[1]) || role[2:]
  ELSE '=' || replace(replace(replace(role, '\', '\0'), ':', '\1'), '<', '\2') END"""

OP12_SQL = rf"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
written AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, '### ' || {CHAT_ROLE} || ': ' || {CHAT_TEXT} || '</turn>' || chr(10) AS piece FROM rows),
placed AS (SELECT *, sum(length(piece)) OVER w AS stop, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w = 0 AS ends FROM written
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, piece ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY stop)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY stop) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR ends) AS n_examples,
  CAST(sum(stop) FILTER (role = 'assistant' OR ends) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""

OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
    s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
