"""Corpus metrics over (source, reference, prediction)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.functions import text
from claritas.operators import bertscore, bootstrap, ngrams, readability, subsequence, suite
from claritas.operators.trials import mean_std
from claritas.plans import fixtures as fx
from claritas.plans.queries_columns import half_up
from claritas.plans.registry import SQL, query, table
from claritas.plans.stem_sql import stems_sql
from claritas.session import written

BY = ["split", "task", "system"]


def _rounded(df, *keys):
    """Six decimals; nine first, so that sums in another order fall on the same side of a half."""
    return df.select(*keys, *[F.round(F.round(c, 9), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def _systems(spark, folder):
    return fx.systems(spark, folder).select("pair_id", *BY, "src", "ref", "pred")


# --- SQL twins of the tokenisers and of the gram counts -------------------------------------------

EDGE = rf"'^{text.WHITE}+|{text.WHITE}+\z'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {EDGE}, '', 'g')"


def _ascii(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _13a(c: str, lower: bool = False) -> str:
    c = f"replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for old, new in text.ENTITIES:
        c = f"replace({c}, '{old}', '{new}')"
    c = f"' ' || {'lower(' + c + ')' if lower else c} || ' '"
    for pattern, parts in text.SPLITS_13A:
        new = "".join(f"\\{p}" if isinstance(p, int) else p for p in parts)
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"regexp_extract_all({c}, '{text.NOT_WHITE}')"


def _stemmed(source: str, keys: str) -> str:
    """`sides` (keys, t) from the token lists `t` of `source`, every token replaced by its stem."""
    return f"""unfolded AS (SELECT {keys}, unnest(t) AS t, generate_subscripts(t, 1) AS place FROM {source}),
{stems_sql("SELECT t FROM unfolded")},
folded AS (SELECT {keys}, list(coalesce(w, t) ORDER BY place) AS t FROM unfolded LEFT JOIN stems ON word = t GROUP BY ALL)"""


def _counts(tokens: dict[str, str], orders, stems: bool = False) -> str:
    sides = " UNION ALL ".join(f"SELECT pair_id, split, task, system, '{s}' AS side, {t} AS t FROM systems" for s, t in tokens.items())
    if stems:
        sides = f"{sides}),\n{_stemmed('plain', 'pair_id, split, task, system, side')}, sides AS (SELECT * FROM folded"
    counts = ", ".join(f"count(*) FILTER (side = '{s}') AS c_{s}" for s in tokens)
    return f"""{fx.SYSTEMS}, {"plain" if stems else "sides"} AS ({sides}),
orders AS (SELECT unnest({list(orders)}) AS n),
grams AS (SELECT pair_id, split, task, system, side, n,
    unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram FROM sides, orders),
counted AS (SELECT pair_id, split, task, system, n, gram, {counts} FROM grams GROUP BY ALL),
counts AS (SELECT * FROM counted UNION ALL SELECT pair_id, split, task, system, n, NULL, {", ".join("0" for _ in tokens)} FROM systems, orders)"""


ROUGE_COUNTS = _counts({"pred": _ascii("pred"), "ref": _ascii("ref")}, (1, 2))
BLEU_COUNTS = _counts({"pred": _13a(_strip("pred")), "ref": _13a(_strip("ref"))}, ngrams.ORDERS)
SARI_COUNTS = _counts({s: _13a(_strip(s), True) for s in ("src", "pred", "ref")}, ngrams.ORDERS)



def _rouge_pairs(counts: str) -> str:
    return f"""{counts}, sums AS (SELECT pair_id, split, task, system, n, sum(least(c_pred, c_ref))::DOUBLE AS hits, sum(c_pred) AS n_pred, sum(c_ref) AS n_ref FROM counts GROUP BY ALL),
pairs_f AS (SELECT *, coalesce(2 * hits / nullif(n_pred + n_ref, 0), 0) AS f FROM sums)"""


ROUGE_PAIRS = _rouge_pairs(ROUGE_COUNTS)
STEM_PAIRS = _rouge_pairs(_counts({"pred": _ascii("pred"), "ref": _ascii("ref")}, (1, 2), stems=True))
ROUGE_MEANS = "SELECT split, task, system, round(avg(f) FILTER (n = 1) * 100, 6) AS rouge1, round(avg(f) FILTER (n = 2) * 100, 6) AS rouge2 FROM pairs_f GROUP BY ALL"


@query(
    "m1_rouge_n",
    f"""WITH {ROUGE_PAIRS} SELECT split, task, system, round(avg(f) FILTER (n = 1) * 100, 6) AS rouge1, round(avg(f) FILTER (n = 2) * 100, 6) AS rouge2
        FROM pairs_f GROUP BY ALL""",
)
def m1(spark, folder):
    return _rounded(ngrams.rouge(_systems(spark, folder), BY, stems=False), *BY)


@query(
    "m1_rouge_n_pairs",
    f"""WITH {ROUGE_PAIRS} SELECT pair_id, split, task, system, n, hits::BIGINT AS hits, n_pred::BIGINT AS n_pred, n_ref::BIGINT AS n_ref, {half_up("f", 6)} AS f FROM pairs_f""",
)
def m1_pairs(spark, folder):
    return _rounded(ngrams.rouge_pairs(_systems(spark, folder), BY, stems=False), "pair_id", *BY, "n")


REPLICATES = 200
WEIGHT = " + ".join(f"CAST(digits >= '{t}' AS INTEGER)" for t in bootstrap.thresholds())


def _bootstrap_sql(rows: str, value: str, metric: str, source: str) -> str:
    """Percentiles of Poisson resamples of `value` over (split, task, system) and `metric`, with the library's hash weights."""
    return f"""WITH {rows},
hashed AS (SELECT split, task, system, {metric} AS metric, {value} AS v, b, md5('1:' || pair_id || ':' || b) AS h FROM {source}, (SELECT unnest(range({REPLICATES // bootstrap.PER_HASH})) AS b)),
drawn AS (SELECT split, task, system, metric, v, b * {bootstrap.PER_HASH} + k AS replicate, substr(h, CAST(4 * k + 1 AS INTEGER), 4) AS digits
          FROM hashed, (SELECT unnest(range({bootstrap.PER_HASH})) AS k)),
means AS (SELECT split, task, system, metric, replicate, sum(({WEIGHT}) * v) / nullif(sum({WEIGHT}), 0) AS mean FROM drawn WHERE v IS NOT NULL GROUP BY ALL),
parts AS (SELECT split, task, system, metric, quantile_cont(mean, [0.025, 0.5, 0.975]) AS q FROM means GROUP BY ALL),
plain AS (SELECT split, task, system, metric, count(*) AS n, avg(v) AS mean FROM hashed WHERE b = 0 GROUP BY ALL)
SELECT split, task, system, metric, n, round(mean * 100, 6) AS mean, round(q[1] * 100, 6) AS low, round(q[2] * 100, 6) AS mid, round(q[3] * 100, 6) AS high
FROM plain JOIN parts USING (split, task, system, metric)"""


def _bootstrapped(pairs):
    out = bootstrap.bootstrap(pairs, [*BY, "metric"], ["pair_id"], "f", replicates=REPLICATES, seed=1)
    return _rounded(out.select(*BY, "metric", "n", *[(F.col(c) * 100).alias(c) for c in ("mean", "low", "mid", "high")]), *BY, "metric")


@query("m1_rouge_bootstrap", _bootstrap_sql(ROUGE_PAIRS, "f", "'rouge' || n", "pairs_f"))
def m1_bootstrap(spark, folder):
    pairs = ngrams.rouge_pairs(_systems(spark, folder), BY, stems=False)
    return _bootstrapped(pairs.withColumn("metric", F.concat(F.lit("rouge"), F.col("n").cast("string"))))


@query("m1_rouge_n_stems", f"WITH {STEM_PAIRS} {ROUGE_MEANS}")
def m1_stems(spark, folder):
    return _rounded(ngrams.rouge(_systems(spark, folder), BY), *BY)


# The LCS table row by row: a row is the running maximum of what lies above and of the matches.
def _lcs(texts: str, keys: list[str]) -> str:
    """`lcs` (keys, i, best): row i of the table of the token lists r and p of `t`, which `texts` makes."""
    same = " AND ".join(f"t.{k} = lcs.{k}" for k in keys)
    return f"""WITH RECURSIVE {fx.SYSTEMS},
{texts},
lcs AS (
  SELECT {", ".join(keys)}, 0 AS i, list_transform(p, lambda x: 0) AS best FROM t
  UNION ALL
  SELECT {", ".join(keys)}, i, list_transform(range(1, len(cell) + 1), lambda j: list_max(cell[1:j])) AS best FROM (
    SELECT {", ".join(f"t.{k}" for k in keys)}, i + 1 AS i,
           list_transform(range(1, len(p) + 1), lambda j: greatest(best[j], CASE WHEN p[j] = r[i + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE 0 END)) AS cell
    FROM lcs JOIN t ON {same} WHERE i < len(r)))"""


WORDS = "t AS (SELECT pair_id, split, task, system, regexp_extract_all(lower(ref), '[a-z0-9]+') AS r, regexp_extract_all(lower(pred), '[a-z0-9]+') AS p FROM systems)"
STEMS = f"""plain AS (SELECT pair_id, system, 'r' AS side, {_ascii("ref")} AS t FROM systems UNION ALL SELECT pair_id, system, 'p', {_ascii("pred")} FROM systems),
{_stemmed("plain", "pair_id, system, side")},
t AS (SELECT systems.pair_id, split, task, systems.system, coalesce(a.t, []) AS r, coalesce(b.t, []) AS p FROM systems
      LEFT JOIN folded a ON a.pair_id = systems.pair_id AND a.system = systems.system AND a.side = 'r'
      LEFT JOIN folded b ON b.pair_id = systems.pair_id AND b.system = systems.system AND b.side = 'p')"""
L_SCORES = """f AS (SELECT split, task, t.system, coalesce(best[len(p)], 0) AS hits, len(p) AS n_pred, len(r) AS n_ref
      FROM t JOIN lcs ON lcs.pair_id = t.pair_id AND lcs.system = t.system AND i = len(r))"""
LCS = f"{_lcs(WORDS, ['pair_id', 'system'])},\n{L_SCORES}"
STEM_LCS = f"{_lcs(STEMS, ['pair_id', 'system'])},\n{L_SCORES}"
F_MEAN = "avg(coalesce(2.0::DOUBLE * hits / nullif(n_pred + n_ref, 0), 0)) * 100"


@query("m2_rouge_l", f"{STEM_LCS} SELECT split, task, system, round({F_MEAN}, 6) AS rougeL FROM f GROUP BY ALL")
def m2(spark, folder):
    return _rounded(subsequence.rouge_l(_systems(spark, folder), BY), *BY)


@query(
    "m2_rouge_l_words",
    f"""{LCS} SELECT split, task, system, round(avg(coalesce(2.0::DOUBLE * hits / nullif(n_pred + n_ref, 0), 0)) * 100, 6) AS rougeL FROM f GROUP BY ALL""",
)
def m2_words(spark, folder):
    return _rounded(subsequence.rouge_l(_systems(spark, folder), BY, stems=False), *BY)


@query(
    "m2_rouge_l_bootstrap",
    _bootstrap_sql(LCS.removeprefix("WITH ").replace("SELECT split, task, t.system, coalesce", "SELECT t.pair_id, split, task, t.system, coalesce"), "coalesce(2.0::DOUBLE * hits / nullif(n_pred + n_ref, 0), 0)", "'rougeL'", "f"),
)
def m2_bootstrap(spark, folder):
    pairs = subsequence.rouge_l_pairs(_systems(spark, folder), BY, stems=False)
    return _bootstrapped(pairs.withColumn("metric", F.lit("rougeL")))


# Sentences of both sides; of every pair of sentences one subsequence is walked back, going up in the
# reference on a tie. A token counts as often as its places are covered, but not above its number in the prediction.
KEYS = ["pair_id", "system", "rn", "pn"]
SENTENCES = f"""split_ AS (SELECT pair_id, system, 'r' AS side, regexp_extract_all(ref, '{text.SENTENCE}') AS ss FROM systems
  UNION ALL SELECT pair_id, system, 'p', regexp_extract_all(pred, '{text.SENTENCE}') FROM systems),
each_ AS (SELECT pair_id, system, side, unnest(ss) AS s, generate_subscripts(ss, 1) AS sn FROM split_),
plain AS (SELECT pair_id, system, side, sn, {_ascii("s")} AS t FROM each_),
{_stemmed("plain", "pair_id, system, side, sn")},
t AS (SELECT a.pair_id, a.system, a.sn AS rn, b.sn AS pn, a.t AS r, b.t AS p FROM folded a JOIN folded b ON a.pair_id = b.pair_id AND a.system = b.system AND a.side = 'r' AND b.side = 'p')"""
MEETS = " AND ".join(f"{{a}}.{k} = {{b}}.{k}" for k in KEYS)
LSUM = f"""{_lcs(SENTENCES, KEYS)},
walk AS (
  SELECT {", ".join(KEYS)}, len(r) AS i, len(p) AS j, false AS hit FROM t
  UNION ALL
  SELECT {", ".join(f"walk.{k}" for k in KEYS)},
         CASE WHEN r[walk.i] = p[j] OR here.best[j] = coalesce(above.best[j], 0) THEN walk.i - 1 ELSE walk.i END,
         CASE WHEN r[walk.i] = p[j] OR here.best[j] <> coalesce(above.best[j], 0) THEN j - 1 ELSE j END,
         r[walk.i] = p[j]
  FROM walk JOIN t ON {MEETS.format(a="walk", b="t")} JOIN lcs here ON {MEETS.format(a="walk", b="here")} AND here.i = walk.i
    JOIN lcs above ON {MEETS.format(a="walk", b="above")} AND above.i = walk.i - 1
  WHERE walk.i > 0 AND j > 0),
covered AS (SELECT DISTINCT pair_id, system, rn, i + 1 AS i FROM walk WHERE hit),
hit_tokens AS (SELECT c.pair_id, c.system, f.t[c.i] AS token, count(*) AS n FROM covered c JOIN folded f ON f.pair_id = c.pair_id AND f.system = c.system AND f.side = 'r' AND f.sn = c.rn GROUP BY ALL),
said AS (SELECT pair_id, system, side, unnest(t) AS token FROM folded),
sizes AS (SELECT pair_id, system, count(*) FILTER (side = 'p') AS n_pred, count(*) FILTER (side = 'r') AS n_ref FROM said GROUP BY ALL),
pred_tokens AS (SELECT pair_id, system, token, count(*) AS n FROM said WHERE side = 'p' GROUP BY ALL),
hits AS (SELECT h.pair_id, h.system, sum(least(h.n, q.n)) AS hits FROM hit_tokens h JOIN pred_tokens q ON q.pair_id = h.pair_id AND q.system = h.system AND q.token = h.token GROUP BY ALL),
f AS (SELECT split, task, systems.system, coalesce(hits, 0) AS hits, coalesce(n_pred, 0) AS n_pred, coalesce(n_ref, 0) AS n_ref FROM systems
  LEFT JOIN hits ON hits.pair_id = systems.pair_id AND hits.system = systems.system LEFT JOIN sizes ON sizes.pair_id = systems.pair_id AND sizes.system = systems.system)"""


@query("m3_rouge_lsum", f"{LSUM} SELECT split, task, system, round({F_MEAN}, 6) AS rougeLsum FROM f GROUP BY ALL")
def m3(spark, folder):
    return _rounded(subsequence.rouge_l(_systems(spark, folder), BY, summary=True), *BY)


CORRECT = ", ".join(f"sum(least(c_pred, c_ref)) FILTER (n = {n})::DOUBLE AS c{n}, sum(c_pred) FILTER (n = {n})::DOUBLE AS t{n}" for n in ngrams.ORDERS)
HALVINGS = {n: " * ".join(f"(CASE WHEN c{m} = 0 THEN 2 ELSE 1 END)" for m in range(1, n + 1)) for n in ngrams.ORDERS}
LOGS = " + ".join(
    f"ln(CASE WHEN c{n} = 0 THEN 100.0 / ({HALVINGS[n]} * nullif(t{n}, 0)) ELSE 100.0 * c{n} / nullif(t{n}, 0) END)" for n in ngrams.ORDERS
)


@query(
    "m4_bleu",
    f"""WITH {BLEU_COUNTS}, s AS (SELECT split, task, system, {CORRECT}, sum(c_ref) FILTER (n = 1)::DOUBLE AS r FROM counts GROUP BY ALL)
        SELECT split, task, system, round(CASE WHEN least(t1, t2, t3, t4) = 0 OR greatest(c1, c2, c3, c4) = 0 THEN 0
               ELSE (CASE WHEN t1 >= r THEN 1 ELSE exp(1 - r / t1) END) * exp(({LOGS}) / 4) END, 6) AS bleu FROM s""",
)
def m4(spark, folder):
    return _rounded(ngrams.bleu(_systems(spark, folder), BY), *BY)


@query(
    "m4_bleu_counts",
    f"""WITH {BLEU_COUNTS} SELECT split, task, system, {", ".join(f"sum(least(c_pred, c_ref)) FILTER (n = {n})::BIGINT AS correct_{n}, sum(c_pred) FILTER (n = {n})::BIGINT AS total_{n}" for n in ngrams.ORDERS)},
               sum(c_ref) FILTER (n = 1)::BIGINT AS ref_length FROM counts GROUP BY ALL""",
)
def m4_counts(spark, folder):
    return ngrams.bleu_counts(_systems(spark, folder), BY)


SARI_PAIRS = f"""{SARI_COUNTS},
g AS (SELECT *, least(c_src, c_pred) AS k, least(c_src, c_ref) AS ka, greatest(c_src - c_pred, 0) AS d FROM counts),
r AS (SELECT pair_id, split, task, system, n,
   coalesce(sum(least(k, c_ref) / nullif(k, 0)) / nullif(count(*) FILTER (k > 0), 0), 1) AS kp,
   coalesce(sum(least(k, c_ref)) / nullif(sum(ka), 0), 1) AS kr,
   coalesce(sum(greatest(d - c_ref, 0) / nullif(d, 0)) / nullif(count(*) FILTER (d > 0), 0), 1) AS dp,
   coalesce(count(*) FILTER (c_pred > 0 AND c_src = 0 AND c_ref > 0) / nullif(count(*) FILTER (c_pred > 0 AND c_src = 0), 0), 1) AS ap,
   coalesce(count(*) FILTER (c_pred > 0 AND c_src = 0 AND c_ref > 0) / nullif(count(*) FILTER (c_ref > 0 AND c_src = 0), 0), 1) AS ar
   FROM g GROUP BY ALL),
sari_pairs AS (SELECT pair_id, split, task, system, avg(coalesce(2 * kp * kr / nullif(kp + kr, 0), 0)) AS keep, avg(dp) AS delete,
   avg(coalesce(2 * ap * ar / nullif(ap + ar, 0), 0)) AS add FROM r GROUP BY ALL)"""


@query("m5_sari", f"WITH {SARI_PAIRS} SELECT split, task, system, round(avg((keep + delete + add) / 3) * 100, 6) AS sari FROM sari_pairs GROUP BY ALL")
def m5(spark, folder):
    return _rounded(ngrams.sari(_systems(spark, folder), BY), *BY)


@query("m5_sari_pairs", f"WITH {SARI_PAIRS} SELECT pair_id, split, task, system, {half_up("keep", 6)} AS keep, {half_up("delete", 6)} AS delete, {half_up("add", 6)} AS add FROM sari_pairs")
def m5_pairs(spark, folder):
    return _rounded(ngrams.sari_pairs(_systems(spark, folder), BY), "pair_id", *BY)


# --- BERTScore from vectors ------------------------------------------------------------------------

BASELINE = {"precision": 0.1, "recall": 0.12, "f1": 0.11}
TOKENS = """v AS (SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id // 10 % 2 = 0 THEN 'even' ELSE 'odd' END AS task, vec_id % 10 AS tok_pos,
   CASE WHEN vec_id % 2 = 0 THEN 'pred' ELSE 'ref' END AS side, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT p.pair_id, p.task, p.tok_pos AS p, r.tok_pos AS r, list_cosine_similarity(p.v, r.v) AS c FROM v p JOIN v r ON p.pair_id = r.pair_id AND p.side = 'pred' AND r.side = 'ref'),
best AS (SELECT pair_id, task, 'pred' AS side, p AS tok_pos, max(c) AS b FROM c GROUP BY ALL UNION ALL SELECT pair_id, task, 'ref', r, max(c) FROM c GROUP BY ALL),
pr AS (SELECT pair_id, task, avg(b) FILTER (side = 'pred') AS p, avg(b) FILTER (side = 'ref') AS r FROM best GROUP BY ALL),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM pr)"""


def _token_vectors(spark, folder):
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id div 10 AS pair_id",
        "CASE WHEN vec_id div 10 % 2 = 0 THEN 'even' ELSE 'odd' END AS task",
        "vec_id % 10 AS tok_pos",
        "CASE WHEN vec_id % 2 = 0 THEN 'pred' ELSE 'ref' END AS side",
        "embedding AS vec",
    )


@query(
    "m6_bertscore",
    f"""WITH {TOKENS} SELECT task, {", ".join(f"round(avg({c}) * 100, 6) AS bertscore_{n}, round(avg(({c} - {BASELINE[n]}) / (1 - {BASELINE[n]})) * 100, 6) AS bertscore_{n}_rescaled" for n, c in (("f1", "f"), ("recall", "r"), ("precision", "p")))}
        FROM f GROUP BY task""",
)
def m6(spark, folder):
    return _rounded(bertscore.bertscore(_token_vectors(spark, folder), ["task"], BASELINE), "task")


@query("m6_token_matches", f"WITH {TOKENS} SELECT pair_id, side, tok_pos, {half_up('b', 6)} AS best FROM best")
def m6_tokens(spark, folder):
    return _rounded(bertscore.token_best(_token_vectors(spark, folder), ["pair_id"]), "pair_id", "side", "tok_pos")


# --- readability, compression, novelty -----------------------------------------------------------------

STOP = fx.sql_list(readability.STOP_WORDS)


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _unigrams(c: str) -> str:
    folded = f"regexp_replace(translate(lower({c}), '{text.ACCENTED}', '{text.PLAIN}'), '\\p{{Mn}}', '', 'g')"
    words = f"regexp_extract_all({folded}, '{text.WORD}')"
    return f"list_distinct(list_filter({words}, lambda w: NOT regexp_matches(w, '{text.NUMBER}') AND NOT list_contains({STOP}, w)))"


ROWS = f"""rows AS (SELECT pair_id, split, task, system, {_n("s", text.WORD)} AS src_words, {_n("p", text.WORD)} AS words, {_n("p", text.SENTENCE)} AS sents,
   {_n("lower(p)", text.VOWELS)} AS syllables, {_n("p", text.LONG_WORD)} AS long_words, {_unigrams("pred")} AS said, {_unigrams("src")} AS given
   FROM (SELECT *, {_strip("pred")} AS p, {_strip("src")} AS s FROM systems)),
scores AS (SELECT pair_id, split, task, system, 207 - 1.015::DOUBLE * words / nullif(sents, 0) - 73.6::DOUBLE * syllables / nullif(words, 0) AS kmre,
   words / nullif(sents, 0) + 100.0::DOUBLE * long_words / nullif(words, 0) AS lix, 100 - words / nullif(src_words, 0) * 100.0::DOUBLE AS compression_ratio,
   coalesce(100.0::DOUBLE * len(list_filter(said, lambda w: NOT list_contains(given, w))) / nullif(len(said), 0), 0) AS novelty FROM rows)"""


def _readability(name: str, column: str):
    @query(name, f"WITH {fx.SYSTEMS}, {ROWS} SELECT split, task, system, round(avg({column}), 6) AS {column} FROM scores GROUP BY ALL")
    def run(spark, folder):
        return _rounded(readability.readability(_systems(spark, folder), BY).select(*BY, column), *BY)

    return run


_readability("m7_reading_ease", "kmre")
_readability("m8_lix", "lix")
_readability("m9_compression_ratio", "compression_ratio")
_readability("m10_novelty", "novelty")


@query(
    "m7_m10_documents",
    f"""WITH {fx.CORPUS}, systems AS (SELECT doc_id AS pair_id, split, task, source AS system, text AS src, text AS pred FROM corpus), {ROWS}
        SELECT pair_id, {", ".join(f"{half_up(c, 6)} AS {c}" for c in ("kmre", "lix", "compression_ratio", "novelty"))} FROM scores""",
)
def m_documents(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("src"), F.col("text").alias("pred"))
    scores = readability.row_scores(docs).select("pair_id", "kmre", "lix", "compression_ratio", "novelty")
    return _rounded(scores, "pair_id")


# --- composite, suite, merge ---------------------------------------------------------------------------

NAMED = {"click": "sari", "error": "rougeL", "view": "bertscore_f1"}


@query(
    "m11_srb",
    f"""WITH {fx.TRIALS}, m AS (SELECT run, CASE metric WHEN 'click' THEN 'sari' WHEN 'error' THEN 'rougeL' WHEN 'view' THEN 'bertscore_f1' END AS metric, avg(value) AS value
          FROM trials WHERE metric IN ('click', 'error', 'view') GROUP BY ALL),
        w AS (SELECT run, max(value) FILTER (metric = 'sari') AS a, max(value) FILTER (metric = 'rougeL') AS b, max(value) FILTER (metric = 'bertscore_f1') AS c FROM m GROUP BY run)
        SELECT run, metric, round(value, 6) AS value FROM m UNION ALL SELECT run, 'srb', round(3 / (1 / a + 1 / b + 1 / c), 6) FROM w""",
)
def m11(spark, folder):
    log = fx.trials(spark, folder, steps=False).where(F.col("metric").isin(list(NAMED)))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), F.col("metric"))
    metrics = mean_std(log.withColumn("metric", named), ["run", "metric"], "value", digits=None).select("run", "metric", F.col("mean").alias("value"))
    return suite.with_srb(metrics, ["run"]).withColumn("value", F.round("value", 6))


SENT_BYTES = 64 << 20  # of vectors in use, up to which every task gets them all


def _vectors_of(spark, folder, rows):
    """Token vectors of every pair: its words in order, each with one of the stored vectors, picked by its letters.

    Texts are spread by pair first; only the vectors in use are met, so they can be sent to the words and no
    word's vector crosses the network.
    """
    stored = table(spark, folder, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vec"))
    n_stored = stored.count()

    def ids(side):
        return F.transform(text.word_tokens(F.col(side)), lambda w: (F.ascii(w).cast("long") * 31 + F.length(w)) % n_stored)

    none = F.array().cast("array<bigint>")
    in_use = rows.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(ids(s), none) for s in ("pred", "ref")]))).alias("_id"))
    used = written(stored.join(in_use.distinct(), "_id", "left_semi"), "used-vectors")
    # by their size and not by that of their files: else one letter more in use would shuffle every word's vector
    if (used.agg(F.sum(F.size("vec") * 4 + 32)).first()[0] or 0) <= SENT_BYTES:
        used = F.broadcast(used)
    spread = rows.select("pair_id", *BY, "pred", "ref").repartition(ngrams.text_width(rows, ("pred", "ref")), "pair_id", *BY)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), ids(s).alias("ids")) for s in ("pred", "ref")])
    picked = spread.select("pair_id", *BY, F.inline(sides)).select("pair_id", *BY, "side", F.posexplode("ids").alias("tok_pos", "_id"))
    return picked.join(used, "_id").select("pair_id", *BY, "side", "tok_pos", "vec")


def _long_sql(select: str, metrics: list[str], by: str = "split, task, system") -> str:
    parts = ", ".join(f"('{m}', CAST({m} AS DOUBLE))" for m in metrics)
    return f"""SELECT {by}, metric, round(round(value, 9), 4) AS value
        FROM ({select}) AS wide, LATERAL (VALUES {parts}) AS named(metric, value)"""


SUITE_SQL = " UNION ALL ".join(
    [
        _long_sql(
            f"WITH {ROUGE_PAIRS} SELECT split, task, system, avg(f) FILTER (n = 1) * 100 AS rouge1, avg(f) FILTER (n = 2) * 100 AS rouge2 FROM pairs_f GROUP BY ALL",
            ["rouge1", "rouge2"],
        ),
        _long_sql(SQL["m4_bleu"].replace(", 6) AS bleu", ", 12) AS bleu"), ["bleu"]),
        _long_sql(SQL["m5_sari"].replace(", 6) AS sari", ", 12) AS sari"), ["sari"]),
        _long_sql(
            f"WITH {fx.SYSTEMS}, {ROWS} SELECT split, task, system, avg(kmre) AS kmre, avg(lix) AS lix, avg(compression_ratio) AS compression_ratio, avg(novelty) AS novelty, count(*) AS n_samples FROM scores GROUP BY ALL",
            ["kmre", "lix", "compression_ratio", "novelty", "n_samples"],
        ),
    ]
)


@query("m12_suite_without_subsequences", SUITE_SQL)
def m12_without(spark, folder):
    rows = written(_systems(spark, folder), "m12")
    table = suite.suite(rows, BY, stems=False, subsequences=False, digits=9)
    return table.withColumn("value", F.round("value", 4))


@query(
    "m12_suite_words",
    SUITE_SQL + " UNION ALL " + _long_sql(f"{LCS} SELECT split, task, system, avg(coalesce(2.0::DOUBLE * hits / nullif(n_pred + n_ref, 0), 0)) * 100 AS rougeL FROM f GROUP BY ALL", ["rougeL"]),
)
def m12_words(spark, folder):
    rows = written(_systems(spark, folder), "m12")
    table = suite.suite(rows, BY, stems=False, subsequences=("rougeL",), digits=9)
    return table.withColumn("value", F.round("value", 4))


def _suite_sql(by: str = "split, task, system") -> str:
    """Every text metric with stems; a coarser grouping reads the same per-pair scores."""
    means = f"SELECT {by}, avg(f) FILTER (n = 1) * 100 AS rouge1, avg(f) FILTER (n = 2) * 100 AS rouge2 FROM pairs_f GROUP BY ALL"
    rows = f"SELECT {by}, avg(kmre) AS kmre, avg(lix) AS lix, avg(compression_ratio) AS compression_ratio, avg(novelty) AS novelty, count(*) AS n_samples FROM scores GROUP BY ALL"
    parts = [
        (f"WITH {STEM_PAIRS} {means}", ["rouge1", "rouge2"]),
        (f"{STEM_LCS} SELECT {by}, {F_MEAN} AS rougeL FROM f GROUP BY ALL", ["rougeL"]),
        (f"{LSUM} SELECT {by}, {F_MEAN} AS rougeLsum FROM f GROUP BY ALL", ["rougeLsum"]),
        (SQL["m4_bleu"].replace(", 6) AS bleu", ", 12) AS bleu").replace(f"s AS (SELECT split, task, system, {CORRECT}", f"s AS (SELECT {by}, {CORRECT}").replace("SELECT split, task, system, round(CASE", f"SELECT {by}, round(CASE"), ["bleu"]),
        (f"WITH {SARI_PAIRS} SELECT {by}, avg((keep + delete + add) / 3) * 100 AS sari FROM sari_pairs GROUP BY ALL", ["sari"]),
        (f"WITH {fx.SYSTEMS}, {ROWS} {rows}", ["kmre", "lix", "compression_ratio", "novelty", "n_samples"]),
    ]
    return " UNION ALL ".join(_long_sql(select, names, by) for select, names in parts)


@query("m12_metric_suite", _suite_sql("system"))
def m12(spark, folder):
    rows = written(_systems(spark, folder), "m12")
    table = suite.suite(rows, ["system"], stems=True, digits=9)
    return table.withColumn("value", F.round("value", 4))


def _rescaled(name: str, value: str) -> str:
    return f"avg({value}) * 100 AS bertscore_{name}, avg(({value} - {BASELINE[name]}) / (1 - {BASELINE[name]})) * 100 AS bertscore_{name}_rescaled"


# Token vectors as `_vectors_of` picks them; a side without tokens scores 0.
PAIR_TOKENS = f"""sides_ AS (SELECT pair_id, split, task, system, 'pred' AS side, regexp_extract_all(pred, '{text.WORD}') AS w FROM systems
  UNION ALL SELECT pair_id, split, task, system, 'ref', regexp_extract_all(ref, '{text.WORD}') FROM systems),
words_ AS (SELECT pair_id, split, task, system, side, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS tok_pos FROM sides_),
picked AS (SELECT pair_id, split, task, system, side, tok_pos, (CAST(unicode(word) AS BIGINT) * 31 + length(word)) % (SELECT count(*) FROM embeddings) AS id FROM words_),
used AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IN (SELECT id FROM picked)),
pairs_of AS (SELECT DISTINCT p.pair_id, p.split, p.task, p.system, p.id AS p, r.id AS r FROM picked p JOIN picked r
  ON p.pair_id = r.pair_id AND p.system = r.system AND p.side = 'pred' AND r.side = 'ref'),
cosines AS (SELECT p, r, list_cosine_similarity(a.v, b.v) AS c FROM (SELECT DISTINCT p, r FROM pairs_of) JOIN used a ON a.id = p JOIN used b ON b.id = r),
best_p AS (SELECT pair_id, system, p AS id, max(c) AS b FROM pairs_of JOIN cosines USING (p, r) GROUP BY ALL),
best_r AS (SELECT pair_id, system, r AS id, max(c) AS b FROM pairs_of JOIN cosines USING (p, r) GROUP BY ALL),
pr AS (SELECT s.pair_id, s.split, s.task, s.system,
   coalesce((SELECT avg(b) FROM picked q JOIN best_p x ON x.pair_id = q.pair_id AND x.system = q.system AND x.id = q.id WHERE q.side = 'pred' AND q.pair_id = s.pair_id AND q.system = s.system), 0) AS p,
   coalesce((SELECT avg(b) FROM picked q JOIN best_r x ON x.pair_id = q.pair_id AND x.system = q.system AND x.id = q.id WHERE q.side = 'ref' AND q.pair_id = s.pair_id AND q.system = s.system), 0) AS r FROM systems s),
bert AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""
BERT_SQL = _long_sql(
    f"WITH {fx.SYSTEMS}, {PAIR_TOKENS} SELECT split, task, system, {_rescaled('f1', 'f')}, {_rescaled('recall', 'r')}, {_rescaled('precision', 'p')} FROM bert GROUP BY ALL",
    [f"bertscore_{n}{x}" for n in ("f1", "recall", "precision") for x in ("", "_rescaled")],
).replace("round(round(value, 9), 4)", "value")
M13_SQL = f"""WITH m AS ({_suite_sql().replace("round(round(value, 9), 4)", "value")} UNION ALL {BERT_SQL}),
w AS (SELECT split, task, system, max(value) FILTER (metric = 'sari') AS a, max(value) FILTER (metric = 'rougeL') AS b, max(value) FILTER (metric = 'bertscore_f1') AS c FROM m GROUP BY ALL),
every AS (SELECT split, task, system, metric, value FROM m UNION ALL
  SELECT split, task, system, 'srb', CASE WHEN least(a, b, c) <= 0 THEN 0 ELSE 3 / (1 / a + 1 / b + 1 / c) END FROM w)
SELECT split, task, system, metric, round(round(value, 9), 4) AS value, split || '_' || task || '_' || metric AS key FROM every"""


@query("m13_suite_per_task", M13_SQL)
def m13(spark, folder):
    rows = written(_systems(spark, folder), "m13")
    scores = suite.suite(rows, BY, tokens=_vectors_of(spark, folder, rows), baseline=BASELINE, digits=9)
    return suite.keyed(scores.withColumn("value", F.round("value", 4)))


@query(
    "u4_merge_metrics",
    f"""WITH {fx.SYSTEMS}, a AS (SELECT split, task, system, 'n_samples' AS metric, count(*)::DOUBLE AS value FROM systems GROUP BY ALL
          UNION ALL SELECT split, task, system, 'n_chars', sum(length(pred))::DOUBLE FROM systems GROUP BY ALL),
        b AS (SELECT split, task, system, 'n_samples' AS metric, count(*)::DOUBLE * 10 AS value FROM systems WHERE system <> 'copy' GROUP BY ALL)
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.split = b.split AND a.task = b.task AND a.system = b.system AND a.metric = b.metric)""",
)
def u4(spark, folder):
    rows = _systems(spark, folder)
    first = suite.long_form(
        rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.length("pred")).alias("n_chars")), BY
    )
    second = suite.long_form(rows.where("system <> 'copy'").groupBy(*BY).agg((F.count(F.lit(1)) * 10).alias("n_samples")), BY)
    return suite.merge(first, second, by=BY)


@query(
    "h4_own_metric",
    SUITE_SQL
    + f"""
       UNION ALL SELECT split, task, system, 'same_text' AS metric, round(avg(CASE WHEN pred = ref THEN 100.0 ELSE 0 END), 4) AS value
       FROM (WITH {fx.SYSTEMS} SELECT * FROM systems) GROUP BY ALL""",
)
def h4(spark, folder):
    def same_text(df, by):
        return df.groupBy(*by).agg((F.avg((F.col("pred") == F.col("ref")).cast("double")) * 100).alias("same_text"))

    # any function from pairs and keys to one row per group joins the suite
    rows = written(_systems(spark, folder), "h4")
    table = suite.suite(rows, BY, stems=False, subsequences=False, extra={"same_text": same_text}, digits=9)
    return table.withColumn("value", F.round("value", 4))
