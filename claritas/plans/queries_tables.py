"""Joins, aggregates, windows, sorts and mixes on trial logs, answer sheets and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.operators import corpus, human, mixing, pairing, quantiles, reshape, trials
from claritas.operators.suite import harmonic_mean
from claritas.plans import fixtures as fx
from claritas.plans.queries_columns import CRITERIA, SCORE, TYPES
from claritas.plans.registry import query, table

# --- joins -------------------------------------------------------------------------------------


@query("j1_generations_with_answers", "SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, folder, "labels"), "doc_id")


TEXTS = "texts AS (SELECT *, split AS test_set, conv_id * 1000 + turn AS input_id FROM systems)"


def _texts(spark, folder):
    rows = fx.systems(spark, folder)
    return rows.withColumn("test_set", F.col("split")).withColumn("input_id", F.col("conv_id") * 1000 + F.col("turn"))


def _drawn(seed: str, n: int, k: int) -> str:
    return f"""drawn AS (SELECT test_set, input_id, draw, (draw - 1) // {n} AS batch FROM (
         SELECT test_set, input_id, row_number() OVER (PARTITION BY test_set ORDER BY md5('{seed}:' || input_id), input_id) AS draw
         FROM (SELECT DISTINCT test_set, input_id FROM texts)) WHERE draw <= {n * k})"""


@query(
    "j2_drawn_inputs",
    f"""WITH {fx.SYSTEMS}, {TEXTS}, {_drawn("j2", 2, 3)} SELECT t.test_set, t.input_id, batch, system, md5(pred) AS value
        FROM texts t JOIN drawn d ON t.test_set = d.test_set AND t.input_id = d.input_id WHERE system IN ('copy', 'lead')""",
)
def j2(spark, folder):
    texts = _texts(spark, folder)
    batches = human.sample_batches(texts, 2, 3, "j2")
    models = ["('toy', 'copy', 'easyread')", "('toy', 'lead', 'easyread')"]
    return human.batch_rows(texts, batches, models).select("test_set", "input_id", "batch", "system", F.md5("pred").alias("value"))


@query(
    "j3_dimension_join",
    f"""WITH {fx.SHEETS}, {CRITERIA} SELECT theme, kind, count(*) AS n FROM sheets s JOIN criteria c ON s.criterion = c.criterion GROUP BY ALL""",
)
def j3(spark, folder):
    # the lookup has one row per criterion of the fixed list
    lookup = human.criteria_table(spark)
    return fx.sheets(spark, folder).join(F.broadcast(lookup), "criterion").groupBy("theme", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j5_missing_runs",
    """WITH models AS (SELECT DISTINCT 'm' || user_id % 4 AS model, user_id % 2 AS kind FROM events),
       methods AS (SELECT DISTINCT user_id % 2 AS kind, 'x' || user_id % 3 AS method, event_type AS tasks FROM events)
       SELECT model, method, tasks FROM models JOIN methods USING (kind)
       WHERE NOT EXISTS (SELECT 1 FROM events e WHERE 'm' || e.user_id % 4 = model AND 'x' || e.user_id % 3 = method AND e.event_type = tasks AND value > 230)""",
)
def j5(spark, folder):
    log = table(spark, folder, "events").selectExpr(
        "concat('m', user_id % 4) AS model", "user_id % 2 AS kind", "concat('x', user_id % 3) AS method", "event_type AS tasks", "value"
    )
    expected = trials.expected_runs(log.select("model", "kind").distinct(), log.select("kind", "method", "tasks").distinct())
    return trials.missing_runs(expected.drop("kind"), log.where("value > 230"), ["model", "method", "tasks"])


@query(
    "j8_positional_concat",
    f"""WITH {fx.SYSTEMS} SELECT pair_id, md5(src) AS inputs, md5(ref) AS labels, md5(max(CASE WHEN system = 'copy' THEN pred END)) AS copy,
               md5(max(CASE WHEN system = 'lead' THEN pred END)) AS lead FROM systems GROUP BY pair_id, src, ref""",
)
def j8(spark, folder):
    rows = fx.systems(spark, folder)
    base = fx.pairs(spark, folder).select("pair_id", F.md5("src").alias("inputs"), F.md5("ref").alias("labels"))
    outputs = {s: rows.where(F.col("system") == s).select("pair_id", F.md5("pred").alias("value")) for s in ("copy", "lead")}
    return pairing.beside(base, outputs, ["pair_id"], "value")


@query("j9_triples", f"WITH {fx.SYSTEMS} SELECT pair_id, md5(src) AS src, md5(ref) AS ref, md5(pred) AS pred FROM systems WHERE system = 'lead'")
def j9(spark, folder):
    pairs = fx.pairs(spark, folder)
    preds = fx.systems(spark, folder).where("system = 'lead'").select("pair_id", "pred")
    triples = pairing.align(pairs.select("pair_id", "src"), pairs.select("pair_id", "ref"), preds, ["pair_id"])
    return triples.select("pair_id", *[F.md5(c).alias(c) for c in ("src", "ref", "pred")])


@query("j10_turn_pairs", f"WITH {fx.PAIRS} SELECT conv_id, turn, pair_id, md5(src) AS src, md5(ref) AS ref FROM pairs")
def j10(spark, folder):
    # no assumption on the turn numbers: positions are counted first
    pairs = pairing.pair_turns(table(spark, folder, "conversations"), dense=False)
    return pairs.select("conv_id", "turn", "pair_id", F.md5("src").alias("src"), F.md5("ref").alias("ref"))


# --- aggregates --------------------------------------------------------------------------------


@query(
    "a1_mean_std",
    f"""WITH {fx.TRIALS} SELECT model, method, metric, count(*) AS n, round(round(avg(value), 9), 2) AS mean, round(round(stddev_samp(value), 9), 2) AS std
        FROM trials GROUP BY ALL""",
)
def a1(spark, folder):
    return trials.mean_std(fx.trials(spark, folder, steps=False), ["model", "method", "metric"], "value")


@query(
    "a1_mean_std_lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(round(avg(l_extendedprice), 9), 2) AS mean, round(round(stddev_samp(l_extendedprice), 9), 2) AS std FROM lineitem GROUP BY ALL",
)
def a1_lineitem(spark, folder):
    return trials.mean_std(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


DESCRIBED = """count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
  round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max"""


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query(
    "a2_fulfilment_summary",
    f"""WITH {fx.SHEETS}, {fx.SAMPLES}, rates AS (
          SELECT sample_id, annotator_id, avg(score) AS rate FROM (SELECT sample_id, annotator_id, {SCORE} AS score FROM sheets) GROUP BY ALL)
        SELECT model, test_set, {DESCRIBED.format(v="rate")} FROM rates JOIN samples USING (sample_id) GROUP BY ALL""",
)
def a2(spark, folder):
    rates = human.fulfilment(human.recode(fx.sheets(spark, folder)), ["sample_id", "annotator_id"])
    judged = fx.samples(spark, folder).join(rates, "sample_id")
    return _rounded(quantiles.describe(judged, ["model", "test_set"], "rate"), "model", "test_set")


@query("a2_describe_lineitem", f"SELECT l_returnflag, l_linestatus, {DESCRIBED.format(v='l_extendedprice')} FROM lineitem GROUP BY ALL")
def a2_lineitem(spark, folder):
    keys = ["l_returnflag", "l_linestatus"]
    return _rounded(quantiles.describe(table(spark, folder, "lineitem").select(*keys, "l_extendedprice"), keys, "l_extendedprice"), *keys)


@query(
    "a3_fulfilment_rate",
    f"""WITH {fx.SHEETS} SELECT sample_id, annotator_id, round(avg(score), 6) AS rate
        FROM (SELECT sample_id, annotator_id, {SCORE} AS score FROM sheets) GROUP BY ALL""",
)
def a3(spark, folder):
    return _rounded(human.fulfilment(human.recode(fx.sheets(spark, folder)), ["sample_id", "annotator_id"]), "sample_id", "annotator_id")


@query(
    "a4_corpus_mean",
    f"WITH {fx.SYSTEMS} SELECT system, round(avg(length(pred) / length(src)) * 100, 4) AS score FROM systems GROUP BY system",
)
def a4(spark, folder):
    share = F.try_divide(F.length("pred").cast("double"), F.length("src").cast("double"))
    return fx.systems(spark, folder).groupBy("system").agg(F.round(F.avg(share) * 100, 4).alias("score"))


@query("a5_counts", "SELECT lang, count(*) AS n_samples, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def a5(spark, folder):
    return table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("source").alias("n_sources"))


@query("a6_distinct", "SELECT DISTINCT lang, source FROM documents")
def a6(spark, folder):
    return table(spark, folder, "documents").select("lang", "source").distinct()


@query(
    "a7_first_per_group",
    f"""WITH {fx.SYSTEMS} SELECT split, turn, conv_id, system, md5(pred) AS pred FROM systems
        QUALIFY row_number() OVER (PARTITION BY split, turn ORDER BY conv_id, system) = 1""",
)
def a7(spark, folder):
    rows = fx.systems(spark, folder).select("split", "turn", "conv_id", "system", "pred")
    return trials.first_per(rows, ["split", "turn"], ["conv_id", "system"]).withColumn("pred", F.md5("pred"))


@query(
    "a8_harmonic_mean",
    f"""WITH {fx.TRIALS}, m AS (SELECT run, coalesce(avg(CASE WHEN metric = 'click' THEN value END), 0) AS a,
          coalesce(avg(CASE WHEN metric = 'view' THEN value END), 0) AS b, coalesce(avg(CASE WHEN metric = 'error' AND value > 100 THEN value END), 0) AS c FROM trials GROUP BY run)
        SELECT run, round(CASE WHEN least(a, b, c) <= 0 THEN 0 ELSE 3 / (1 / a + 1 / b + 1 / c) END, 6) AS srb FROM m""",
)
def a8(spark, folder):
    def mean(condition):
        return F.coalesce(F.avg(F.when(condition, F.col("value"))), F.lit(0.0))

    kind = F.col("metric")
    means = fx.trials(spark, folder, steps=False).groupBy("run").agg(
        mean(kind == "click").alias("a"), mean(kind == "view").alias("b"), mean((kind == "error") & (F.col("value") > 100)).alias("c")
    )
    return means.select("run", F.round(harmonic_mean(F.col("a"), F.col("b"), F.col("c")), 6).alias("srb"))


@query("a9_smallest_task", "SELECT min(n) AS n_min FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def a9(spark, folder):
    return corpus.smallest_task(table(spark, folder, "documents").withColumnRenamed("lang", "task"))


@query(
    "a10_last_write_wins",
    "SELECT user_id, event_type, max_by(value, ts) AS value FROM events GROUP BY ALL",
)
def a10(spark, folder):
    return trials.fold_last(table(spark, folder, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


NAN = "CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"
NUM = "CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END"


@query(
    "a11_column_arg_max",
    f"""SELECT event_type AS metric, event_id, v AS best FROM (SELECT *, {NUM} AS v FROM events) WHERE v IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY v DESC, event_id) = 1""",
)
def a11(spark, folder):
    rows = table(spark, folder, "events").selectExpr("event_type AS metric", "event_id", f"{NAN} AS v")
    return trials.arg_best(rows, ["metric"], ["event_id"], "v")


@query(
    "a12_arg_max_or_first",
    f"""SELECT user_id, event_type, event_id, v AS score FROM (SELECT *, CASE WHEN user_id % 10 = 0 THEN NULL ELSE {NUM} END AS v FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY v DESC NULLS LAST, event_id) = 1""",
)
def a12(spark, folder):
    rows = table(spark, folder, "events").selectExpr("user_id", "event_type", "event_id", f"CASE WHEN user_id % 10 = 0 THEN NULL ELSE {NUM} END AS score")
    return trials.best_or_first(rows, ["user_id", "event_type"], "score", "event_id")


@query(
    "a13_best_trial_all_steps",
    f"""WITH {fx.TRIALS} SELECT metric, run, step, value AS best FROM trials
        QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, run, step) = 1""",
)
def a13(spark, folder):
    return trials.arg_best(fx.trials(spark, folder), ["metric"], ["run", "step"], "value")


@query(
    "a13_best_trial_min",
    f"""WITH {fx.TRIALS} SELECT metric, run, step, value AS best FROM trials
        QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value, run, step) = 1""",
)
def a13_min(spark, folder):
    return trials.arg_best(fx.trials(spark, folder), ["metric"], ["run", "step"], "value", mode="min")


@query(
    "a14_pivot_criteria",
    f"""WITH {fx.ANNOT} SELECT sample_id, annotator_id, {", ".join(f"max(CASE WHEN criterion = '{c}' THEN answer END) AS {c}" for c in TYPES)}
        FROM answers GROUP BY sample_id, annotator_id""",
)
def a14(spark, folder):
    return reshape.widen(fx.answers(spark, folder), ["sample_id", "annotator_id"], "criterion", "answer", TYPES)


BOXES = """boxes AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM prices GROUP BY ALL),
fenced AS (SELECT p.*, q1, median, q3, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM prices p JOIN boxes USING (l_returnflag))"""
PRICES = "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 5 ELSE l_extendedprice END"


def _prices(spark, folder):
    return table(spark, folder, "lineitem").selectExpr("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", f"{PRICES} AS l_extendedprice")


@query(
    "a15_box_plot",
    f"""WITH prices AS (SELECT l_returnflag, {PRICES} AS l_extendedprice FROM lineitem), {BOXES}
        SELECT l_returnflag, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, min(l_extendedprice) FILTER (inside) AS whisker_low,
               max(l_extendedprice) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM fenced GROUP BY l_returnflag""",
)
def a15(spark, folder):
    rows = _prices(spark, folder).select("l_returnflag", "l_extendedprice")
    return _rounded(quantiles.box_summary(rows, ["l_returnflag"], "l_extendedprice"), "l_returnflag")


@query(
    "a15_outliers",
    f"""WITH prices AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, {PRICES} AS l_extendedprice FROM lineitem), {BOXES}
        SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM fenced WHERE NOT inside""",
)
def a15_outliers(spark, folder):
    return quantiles.outliers(_prices(spark, folder), ["l_returnflag"], "l_extendedprice")


@query(
    "a16_krippendorff",
    f"""WITH {fx.ANNOT}, x AS (SELECT criterion, sample_id, answer, count(*) AS x FROM answers GROUP BY ALL),
        m AS (SELECT criterion, sample_id, sum(x) AS m FROM x GROUP BY ALL HAVING sum(x) >= 2),
        o AS (SELECT a.criterion, a.answer AS c, b.answer AS k, sum(a.x * (b.x - CASE WHEN a.answer = b.answer THEN 1 ELSE 0 END) / (m - 1)) AS o
              FROM x a JOIN x b ON a.criterion = b.criterion AND a.sample_id = b.sample_id JOIN m ON m.criterion = a.criterion AND m.sample_id = a.sample_id GROUP BY ALL),
        n AS (SELECT criterion, c, sum(o) AS n_c FROM o GROUP BY ALL),
        t AS (SELECT criterion, sum(n_c) AS n FROM n GROUP BY ALL),
        e AS (SELECT a.criterion, sum(a.n_c * b.n_c) AS e FROM n a JOIN n b ON a.criterion = b.criterion AND a.c <> b.c GROUP BY ALL),
        d AS (SELECT criterion, sum(o) FILTER (c <> k) AS d FROM o GROUP BY ALL)
        SELECT criterion, round(1 - (n - 1) * d / e, 6) AS alpha FROM t JOIN e USING (criterion) JOIN d USING (criterion)""",
)
def a16(spark, folder):
    return _rounded(human.krippendorff(fx.answers(spark, folder), ["criterion"], ["sample_id"]), "criterion")


@query(
    "a16_krippendorff_spread",
    f"""WITH {fx.ANNOT}, kept AS (SELECT * FROM answers WHERE (sample_id + annotator_id) % 4 <> 0),
        x AS (SELECT criterion, sample_id, answer, count(*)::DOUBLE AS x FROM kept GROUP BY ALL),
        m AS (SELECT criterion, sample_id, sum(x) AS m FROM x GROUP BY ALL),
        good AS (SELECT x.criterion, x.sample_id, answer, x, m FROM x JOIN m ON m.criterion = x.criterion AND m.sample_id = x.sample_id WHERE m >= 2),
        items AS (SELECT DISTINCT criterion, sample_id FROM good),
        -- every item left out in turn, and none (item null): all sums anew
        runs AS (SELECT i.criterion, i.sample_id AS item, g.answer, sum(g.x) AS n_c, sum(g.x * (g.m - g.x) / (g.m - 1)) AS d
                 FROM (SELECT * FROM items UNION ALL SELECT DISTINCT criterion, NULL FROM items) i JOIN good g ON g.criterion = i.criterion AND (i.sample_id IS NULL OR g.sample_id <> i.sample_id) GROUP BY ALL),
        alphas AS (SELECT criterion, item, 1 - (sum(n_c) - 1) * sum(d) / nullif(sum(n_c) * sum(n_c) - sum(n_c * n_c), 0) AS alpha FROM runs GROUP BY ALL)
        SELECT criterion, round(max(alpha) FILTER (item IS NULL), 6) AS alpha,
               round(sqrt((count(item) - 1) * var_pop(alpha) FILTER (item IS NOT NULL)), 6) AS std_error, count(item) AS n_items,
               CAST((SELECT count(*) FROM m WHERE m.m < 2 AND m.criterion = alphas.criterion) AS BIGINT) AS n_left_out
        FROM alphas GROUP BY criterion""",
)
def a16_spread(spark, folder):
    kept = fx.answers(spark, folder).where("(sample_id + annotator_id) % 4 <> 0")  # unequal numbers of raters
    return _rounded(human.krippendorff_spread(kept, ["criterion"], ["sample_id"]), "criterion")


@query(
    "a16_fleiss",
    f"""WITH {fx.ANNOT}, x AS (SELECT criterion, sample_id, answer, count(*) AS x FROM answers GROUP BY ALL),
        m AS (SELECT criterion, sample_id, sum(x) AS m, sum(x * x) AS sq FROM x GROUP BY ALL HAVING sum(x) = 7),
        p AS (SELECT criterion, avg((sq - 7) / 42.0) AS p, count(*) AS n_items FROM m GROUP BY ALL),
        c AS (SELECT x.criterion, answer, sum(x) AS n_c FROM x JOIN m USING (criterion, sample_id) GROUP BY ALL),
        e AS (SELECT criterion, sum((n_c / t) * (n_c / t)) AS e FROM (SELECT *, sum(n_c) OVER (PARTITION BY criterion) AS t FROM c) GROUP BY ALL)
        SELECT criterion, n_items, round((p - e) / (1 - e), 6) AS kappa FROM p JOIN e USING (criterion)""",
)
def a16_fleiss(spark, folder):
    return _rounded(human.fleiss(fx.answers(spark, folder), ["criterion"], ["sample_id"], raters=7), "criterion")


@query(
    "a17_parameter_summary",
    f"""SELECT user_id, {", ".join(f"count(*) FILTER (event_type = '{c}') AS params_summary_{c}_total_params" for c in TYPES)} FROM events GROUP BY user_id""",
)
def a17(spark, folder):
    name = trials.parameter_names(F.initcap("event_type"), F.lit("Total Params"))
    names = [f"params_summary_{c}_total_params" for c in TYPES]
    long = table(spark, folder, "events").groupBy("user_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.widen(long, ["user_id"], "name", "n", names).na.fill(0)


@query(
    "a18_throughput",
    """WITH t AS (SELECT user_id, count(*) AS n_samples, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_steps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id)
       SELECT user_id, n_samples, n_steps, round(seconds, 6) AS seconds, round(n_samples / nullif(seconds, 0), 6) AS samples_per_second, round(n_steps / nullif(seconds, 0), 6) AS steps_per_second FROM t""",
)
def a18(spark, folder):
    return _rounded(trials.throughput(table(spark, folder, "events"), ["user_id"], "ts", "ts", 16), "user_id")


@query(
    "a19_robustness",
    f"""WITH {fx.TRIALS} SELECT model, method, k, metric, count(*) AS n, round(round(avg(value), 9), 6) AS mean, round(round(stddev_samp(value), 9), 6) AS std FROM trials GROUP BY ALL""",
)
def a19(spark, folder):
    return trials.mean_std(fx.trials(spark, folder, steps=False), ["model", "method", "k", "metric"], "value", digits=6)


@query(
    "a20_weighted_score",
    f"""WITH {fx.SHEETS}, {CRITERIA}, s AS (SELECT sample_id, annotator_id, {SCORE} AS score, weight FROM sheets LEFT JOIN weights USING (criterion))
        SELECT sample_id, annotator_id, round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 6) AS total FROM s GROUP BY ALL""",
)
def a20(spark, folder):
    scored = human.with_criteria(human.recode(fx.sheets(spark, folder)))
    return _rounded(human.weighted_score(scored, ["sample_id", "annotator_id"]), "sample_id", "annotator_id")


@query(
    "a21_aligned_lists",
    f"""WITH {fx.SYSTEMS}, r AS (SELECT system, conv_id * 1000 + turn AS pos, md5(src) AS src, md5(ref) AS ref, md5(pred) AS pred FROM systems)
        SELECT system, pos // 1000 AS chunk, array_to_string(list(src ORDER BY pos), ' ') AS inputs, array_to_string(list(ref ORDER BY pos), ' ') AS labels,
               array_to_string(list(pred ORDER BY pos), ' ') AS predictions FROM r GROUP BY ALL""",
)
def a21(spark, folder):
    rows = fx.systems(spark, folder).select(
        "system", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.md5("src").alias("inputs"), F.md5("ref").alias("labels"), F.md5("pred").alias("predictions")
    )
    lists = reshape.aligned_lists(rows, ["system"], "pos", ["inputs", "labels", "predictions"])
    return lists.select("system", "chunk", *[F.array_join(c, " ").alias(c) for c in ("inputs", "labels", "predictions")])


# --- mixes and windows -------------------------------------------------------------------------

ORDER = f"list_position({fx.sql_list(fx.TASKS)}, task)"
SIZES = "sizes AS (SELECT lang AS task, count(*) AS n, (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS n_min, (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS n_max FROM documents GROUP BY lang)"


def _mix(spark, folder, strategy):
    return mixing.mix(fx.corpus(spark, folder), fx.TASKS, strategy).select("doc_id", "task", "mix_pos")


@query("w1_balanced_mix", f"WITH {fx.CORPUS}, {SIZES} SELECT doc_id, task, ({ORDER} - 1) * n_min + pos AS mix_pos FROM corpus JOIN sizes USING (task) WHERE pos < n_min")
def w1(spark, folder):
    return _mix(spark, folder, "balanced")


@query("w2_first_exhausted_mix", f"WITH {fx.CORPUS}, {SIZES} SELECT doc_id, task, pos * 4 + {ORDER} - 1 AS mix_pos FROM corpus JOIN sizes USING (task) WHERE pos < n_min")
def w2(spark, folder):
    return _mix(spark, folder, "first_exhausted")


@query(
    "w3_all_exhausted_mix",
    f"""WITH {fx.CORPUS}, {SIZES}, rounds AS (SELECT task, n, unnest(range(n_max)) AS r FROM sizes)
        SELECT doc_id, c.task, r * 4 + list_position({fx.sql_list(fx.TASKS)}, c.task) - 1 AS mix_pos FROM rounds JOIN corpus c ON c.task = rounds.task AND c.pos = r % n""",
)
def w3(spark, folder):
    return _mix(spark, folder, "all_exhausted")


@query(
    "w10_best_and_second",
    """WITH m AS (SELECT user_id, event_type, round(max(value)) AS v FROM events GROUP BY ALL)
       SELECT user_id, event_type, v, CASE WHEN r <= 2 THEN CAST(r AS INT) END AS mark FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY v DESC) AS r FROM m)""",
)
def w10(spark, folder):
    best = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value")).alias("v"))
    return trials.mark_top_two(best, ["event_type"], "v")


@query(
    "w11_global_and_model_best",
    f"""WITH {fx.TRIALS}, m AS (SELECT model, method, k, metric, round(avg(value), 6) AS mean FROM trials GROUP BY ALL)
        SELECT model, method, k, metric, mean, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, method, k, model) = 1 AS best_overall,
               row_number() OVER (PARTITION BY metric, model ORDER BY mean DESC, method, k) = 1 AS best_in_model FROM m""",
)
def w11(spark, folder):
    means = fx.trials(spark, folder, steps=False).groupBy("model", "method", "k", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))
    return trials.mark_best(means, "metric", "model", "mean", ["method", "k", "model"])


@query(
    "w12_sample_batches",
    f"WITH {fx.SYSTEMS}, {TEXTS}, {_drawn('w12', 2, 4)} SELECT test_set, input_id, draw, batch FROM drawn",
)
def w12(spark, folder):
    return human.sample_batches(_texts(spark, folder), 2, 4, "w12").select("test_set", "input_id", "draw", "batch")


@query(
    "w13_one_random_row",
    f"""WITH {fx.SYSTEMS} SELECT split, system, pair_id, md5(pred) AS pred FROM systems
        QUALIFY row_number() OVER (PARTITION BY split, system ORDER BY md5('w13:' || pair_id), pair_id) = 1""",
)
def w13(spark, folder):
    rows = fx.systems(spark, folder).select("split", "system", "pair_id", F.md5("pred").alias("pred"))
    return human.one_random(rows, ["split", "system"], "w13", ["pair_id"])


@query(
    "w14_keep_best_checkpoints",
    f"""WITH {fx.TRIALS} SELECT run, step, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS INT) AS rank FROM trials) WHERE rank <= 3""",
)
def w14(spark, folder):
    return trials.keep_best(fx.trials(spark, folder), ["run"], "value", 3, ["step"]).select("run", "step", "value", "rank")


@query("w15_row_number_ids", f"WITH {fx.CORPUS} SELECT doc_id, task, split, split_pos AS input_id FROM corpus")
def w15(spark, folder):
    return fx.split_corpus(spark, folder).select("doc_id", "task", "split", F.col("pos").alias("input_id"))


# --- sorts -------------------------------------------------------------------------------------


@query("t1_best_row", f"SELECT event_id, user_id, v FROM (SELECT *, {NUM} AS v FROM events) ORDER BY v DESC NULLS LAST, event_id LIMIT 1")
def t1(spark, folder):
    rows = table(spark, folder, "events").selectExpr("event_id", "user_id", f"{NAN} AS v")
    return trials.best_row(rows, "v", ["event_id"])


@query(
    "t2_listed_order",
    f"""WITH {fx.TRIALS}, m AS (SELECT model, method, metric, count(*) AS n FROM trials GROUP BY ALL)
        SELECT model, method, metric, n, CAST(list_position(['m1', 'm0'], model) - 1 AS INT) AS model_order, CAST(nullif(list_position(['x2', 'x0'], method), 0) - 1 AS INT) AS method_order,
               CAST(list_position(['view', 'click'], metric) - 1 AS INT) AS metric_order FROM m WHERE metric IN ('view', 'click')""",
)
def t2(spark, folder):
    counts = fx.trials(spark, folder, steps=False).groupBy("model", "method", "metric").agg(F.count(F.lit(1)).alias("n"))
    out = trials.ordered(counts, "model", ["m1", "m0"], "model_order")
    out = trials.ordered(out, "method", ["x2", "x0"], "method_order")
    out = trials.ordered(out, "metric", ["view", "click"], "metric_order", keep_others=False)
    return out.orderBy("model_order", F.col("method_order").asc_nulls_last(), "metric_order")


@query("t3_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('t3:' || doc_id), doc_id) - 1 AS place FROM documents")
def t3(spark, folder):
    from claritas.operators.numbering import number_by_hash

    return number_by_hash(table(spark, folder, "documents").select("doc_id"), [], "t3", ["doc_id"], name="place")


@query(
    "t5_sorted_summary",
    f"WITH {fx.ANNOT} SELECT criterion, answer, count(*) AS n FROM answers GROUP BY ALL ORDER BY criterion, answer",
)
def t5(spark, folder):
    return fx.answers(spark, folder).groupBy("criterion", "answer").agg(F.count(F.lit(1)).alias("n")).orderBy("criterion", "answer")


@query(
    "h6_group_rates",
    f"WITH {fx.ANNOT} SELECT annotator_id, criterion, round(count(*) FILTER (answer = 'Oui') / count(*), 6) AS yes_share FROM answers GROUP BY ALL",
)
def h6(spark, folder):
    share = F.avg(F.when(F.col("answer") == "Oui", 1.0).otherwise(0.0))
    return fx.answers(spark, folder).groupBy("annotator_id", "criterion").agg(F.round(share, 6).alias("yes_share"))


@query(
    "h2_mix_by_name",
    f"WITH {fx.CORPUS}, {SIZES}, m AS (SELECT c.task, n_min FROM corpus c JOIN sizes USING (task) WHERE pos < n_min) SELECT task, count(*) AS n FROM m GROUP BY task",
)
def h2(spark, folder):
    mixed = fx.corpus(spark, folder).transform(lambda df: mixing.mix(df, fx.TASKS, "balanced"))
    return mixed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))


