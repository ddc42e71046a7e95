"""Projections, filters, scalar functions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.functions import fixed, text, token_arrays, vectors
from claritas.functions.text import ACCENTED, PLAIN
from claritas.operators import batches, corpus, human, mixing, reshape, trials
from claritas.operators.trials import mean_std
from claritas.plans import fixtures as fx
from claritas.plans.queries_sources import SPLIT
from claritas.plans.registry import query, table


def _docs(spark, folder):
    return table(spark, folder, "documents")


@query("p1_rename", "SELECT doc_id, md5(text) AS src, lang AS dst FROM documents")
def p1(spark, folder):
    return corpus.canonical(_docs(spark, folder).select("doc_id", "text", "lang"), {"text": "src", "lang": "dst"}).withColumn("src", F.md5("src"))


@query("p2_drop_columns", f"WITH {fx.ANNOT} SELECT sample_id, annotator_id, criterion, answer FROM answers")
def p2(spark, folder):
    rows = fx.answers(spark, folder).withColumn("Unnamed: 0", F.lit(0)).withColumn("Unnamed: 1", F.lit(1))
    return corpus.drop_matching(rows, "Unnamed")


@query(
    "p3_select_by_pattern",
    f"""WITH {fx.TRIALS} SELECT run, max(CASE WHEN metric = 'click' THEN value END) AS test_easyread_click,
               max(CASE WHEN metric = 'view' THEN value END) AS test_easyread_view
        FROM trials GROUP BY run""",
)
def p3(spark, folder):
    log = fx.trials(spark, folder, steps=False)
    names = {"test_easyread_click": "click", "test_easyread_view": "view", "eval_easyread_error": "error"}
    wide = log.groupBy("run").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for n, m in names.items()],
        F.max(F.to_json(F.struct("value"))).alias("test_easyread_texts"),
    )
    return corpus.matching(wide, r"test_easyread_(?!texts)", keep=("run",))


@query(
    "p4_clean_brackets",
    f"SELECT doc_id, md5(regexp_replace('a -LRB- ' || replace(text, ' the ', ' -LRB- the -RRB- '), '{fixed.BRACKET_TOKENS}', '', 'g')) AS cleaned FROM documents",
)
def p4(spark, folder):
    injected = F.concat(F.lit("a -LRB- "), F.replace("text", F.lit(" the "), F.lit(" -LRB- the -RRB- ")))
    return _docs(spark, folder).select("doc_id", F.md5(text.clean_brackets(injected)).alias("cleaned"))


@query(
    "p5_task_ids",
    """SELECT doc_id, lang AS task, CAST(list_position(['fr', 'en', 'de', 'es'], lang) - 1 AS INT) AS task_id,
              CASE lang WHEN 'fr' THEN 7 WHEN 'en' THEN 3 END AS mapped_id FROM documents""",
)
def p5(spark, folder):
    docs = _docs(spark, folder).select("doc_id", F.col("lang").alias("task"))
    listed = corpus.assign_task_ids(docs, tasks=fx.TASKS)
    mapped = corpus.assign_task_ids(listed.withColumnRenamed("task_id", "kept"), mapping={"fr": 7, "en": 3})
    return mapped.withColumnsRenamed({"task_id": "mapped_id"}).withColumnRenamed("kept", "task_id")


@query(
    "p6_tasks_per_split",
    f"""SELECT doc_id, lang AS task, {SPLIT} AS split FROM documents
        WHERE ({SPLIT} = 'train' AND lang IN ('en', 'fr')) OR ({SPLIT} = 'validation' AND lang = 'fr') OR ({SPLIT} = 'test' AND lang IN ('de', 'fr'))""",
)
def p6(spark, folder):
    docs = _docs(spark, folder).select("doc_id", F.col("lang").alias("task"), fx.pick(fx.SPLITS, F.col("doc_id") % 3).alias("split"))
    return corpus.select_tasks(docs, {"train": ["en", "fr"], "validation": ["fr"], "test": ["de", "fr"]})


@query("p7_first_rows", f"WITH {fx.CORPUS} SELECT doc_id, task, pos FROM corpus WHERE pos < 40")
def p7(spark, folder):
    return corpus.first_rows(fx.corpus(spark, folder), 40).select("doc_id", "task", "pos")


@query("p8_flags", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def p8(spark, folder):
    flagged = table(spark, folder, "labels").withColumn("flag", F.when(F.col("toxic") == 1, "TRUE").otherwise("FALSE"))
    return flagged.where(~F.col("flag").cast("boolean")).select("doc_id", "quality")


@query(
    "p9_file_predicates",
    """SELECT doc_id, source, source LIKE '%2%' AS is_control FROM documents
       WHERE source LIKE 'src1%' AND NOT (source LIKE '%14%' OR source LIKE '%17%')""",
)
def p9(spark, folder):
    name = F.col("source")
    denied = F.lit(False)
    for part in ("14", "17"):
        denied = denied | name.contains(part)
    kept = _docs(spark, folder).where(name.startswith("src1") & ~denied)
    return kept.select("doc_id", "source", name.contains("2").alias("is_control"))


@query(
    "p10_model_membership",
    f"WITH {fx.SYSTEMS} SELECT pair_id, system FROM systems WHERE system IN ('copy', 'lead')",
)
def p10(spark, folder):
    keyed = fx.systems(spark, folder).withColumn("key", text.model_key(F.col("model")))
    wanted = [("toy", "copy", "easyread"), ("toy", "lead", "easyread")]
    # a handful of literal keys is a filter, not a join
    rows = [F.struct(*[F.lit(v) for v in w]) for w in wanted]
    key = F.struct(F.col("key.model"), F.col("key.method"), F.col("key.train_tasks"))
    return keyed.where(key.isin(*rows)).select("pair_id", "system")


@query(
    "p11_sentinel_null",
    f"WITH {fx.ANNOT} SELECT sample_id, annotator_id, criterion, nullif(answer, 'Non Applicable') AS answer FROM answers",
)
def p11(spark, folder):
    return fx.answers(spark, folder).withColumn("answer", human.answer_or_null("answer"))


RULES = fx.sql_list(human.RULE_CODES)
SCORE = f"""CASE WHEN list_contains({RULES}, criterion) THEN
    CASE answer WHEN 'Oui' THEN 1 WHEN 'Non' THEN 0 WHEN 'Partiellement' THEN 1 END END"""


@query("p12_recode", f"WITH {fx.SHEETS} SELECT sample_id, annotator_id, criterion, {SCORE} AS score FROM sheets")
def p12(spark, folder):
    return human.recode(fx.sheets(spark, folder)).select("sample_id", "annotator_id", "criterion", "score")


CRITERIA = f"""criteria(criterion, theme, kind) AS (
  VALUES {fx.sql_values([(c, human.THEMES[c], human.TYPES[c]) for c in fixed.CRITERIA])}),
weights(criterion, weight) AS (VALUES {fx.sql_values(list(fixed.CRITERION_WEIGHTS.items()))})"""


@query(
    "p13_criteria_lookup",
    f"""WITH {fx.SHEETS}, {CRITERIA} SELECT sample_id, annotator_id, s.criterion, coalesce(theme, s.criterion) AS criteria_theme,
               coalesce(kind, s.criterion) AS criteria_type, weight
        FROM sheets s LEFT JOIN criteria c ON s.criterion = c.criterion LEFT JOIN weights w ON s.criterion = w.criterion""",
)
def p13(spark, folder):
    return human.with_criteria(fx.sheets(spark, folder)).drop("answer")


PREFIXES = ["test_easyread_politic", "test_easyread"]
KEYED = """CASE event_id % 3 WHEN 0 THEN 'test_easyread_' WHEN 1 THEN 'test_easyread_politic_' ELSE 'eval_' END || event_type"""


@query(
    "p14_metric_groups",
    f"""SELECT event_id, CASE WHEN name LIKE 'test\\_easyread\\_politic\\_%' ESCAPE '\\' THEN 'test_easyread_politic'
                     WHEN name LIKE 'test\\_easyread\\_%' ESCAPE '\\' THEN 'test_easyread' ELSE 'other' END AS grp,
               CASE WHEN name LIKE 'test%' THEN event_type ELSE name END AS short
        FROM (SELECT event_id, event_type, {KEYED} AS name FROM events)""",
)
def p14(spark, folder):
    named = table(spark, folder, "events").selectExpr("event_id", f"{KEYED} AS name")
    return named.withColumn("g", text.split_by_prefix(F.col("name"), PREFIXES)).selectExpr("event_id", "g.`group` AS grp", "g.short AS short")


@query(
    "p15_run_constants",
    f"WITH {fx.TRIALS} SELECT run, step, metric, 'm.x.easyread' AS expe, 'easyread' AS task, 'easyread+wikilarge' AS train_tasks FROM trials",
)
def p15(spark, folder):
    log = fx.trials(spark, folder).select("run", "step", "metric")
    return trials.with_constants(log, expe="m.x.easyread", task="easyread", train_tasks="easyread+wikilarge")


@query("p16_rename_part", f"WITH {fx.TRIALS} SELECT run, sum(value) AS loss_adapter, count(*) AS n_adapter FROM (SELECT run, round(value * 100)::BIGINT AS value FROM trials) GROUP BY run")
def p16(spark, folder):
    log = fx.trials(spark, folder, steps=False)
    cents = F.round(F.col("value") * 100).cast("long")
    wide = log.groupBy("run").agg(F.sum(cents).alias("loss_lora_easyread"), F.count(F.lit(1)).alias("n_lora_easyread"))
    return corpus.rename_part(wide, "lora_easyread", "adapter")


@query(
    "p17_other_criteria",
    f"WITH {fx.SHEETS}, {CRITERIA} SELECT sample_id, annotator_id, criterion FROM sheets WHERE criterion NOT IN (SELECT criterion FROM criteria WHERE kind = 'global quality')",
)
def p17(spark, folder):
    quality = fixed.CRITERIA_BY_THEME[fixed.QUALITY_THEME]
    rows = fx.sheets(spark, folder)
    return rows.where(~F.col("criterion").isin(quality)).select(*corpus.other_columns(rows, ["answer"]))


@query(
    "p18_same_config",
    """WITH t AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS c1, user_id % 3 AS c2 FROM events),
       best AS (SELECT c1, c2 FROM t ORDER BY value DESC, event_id LIMIT 1)
       SELECT t.event_id FROM t, best WHERE t.c1 IS NOT DISTINCT FROM best.c1 AND t.c2 IS NOT DISTINCT FROM best.c2""",
)
def p18(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "value", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS c1", "user_id % 3 AS c2"
    )
    return trials.same_config(rows, ["c1", "c2"], "value", "event_id").select("event_id")


@query(
    "p19_pseudonyms",
    f"""WITH {fx.ANNOT}, coded AS (SELECT a, 'coder_' || row_number() OVER (ORDER BY a) AS code FROM (SELECT DISTINCT CAST(annotator_id AS VARCHAR) AS a FROM answers))
        SELECT sample_id, code AS annotator_id, criterion, answer FROM answers JOIN coded ON a = CAST(annotator_id AS VARCHAR)""",
)
def p19(spark, folder):
    return human.pseudonyms(fx.answers(spark, folder), "annotator_id")


# --- scalar functions ------------------------------------------------------------------------


@query("f1_strip", r"SELECT doc_id, md5(regexp_replace(chr(10) || '  ' || text || chr(160) || chr(9), '^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+\z', '', 'g')) AS stripped FROM documents")
def f1(spark, folder):
    padded = F.concat(F.lit("\n  "), "text", F.lit(" \t"))
    return _docs(spark, folder).select("doc_id", F.md5(text.strip(padded)).alias("stripped"))


MARKED = """CASE turn % 3 WHEN 0 THEN 'before @@@' || text || '@@@ after @@@ rest' WHEN 1 THEN text || '@@@ open' ELSE text END"""


@query(
    "f4_marked_answer",
    f"""SELECT conv_id, turn, md5(CASE WHEN regexp_matches(m, '(?s)@@@(.*?)@@@') THEN regexp_extract(m, '(?s)@@@(.*?)@@@', 1) ELSE replace(m, '@@@', '') END) AS answer
        FROM (SELECT conv_id, turn, {MARKED} AS m FROM conversations)""",
)
def f4(spark, folder):
    rows = table(spark, folder, "conversations").selectExpr("conv_id", "turn", f"{MARKED} AS m")
    return rows.select("conv_id", "turn", F.md5(text.marked_answer(F.col("m"))).alias("answer"))


EDGE = r"'^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+\z'"


@query(
    "f5_chat_text",
    f"""WITH {fx.PAIRS} SELECT pair_id,
          md5(regexp_replace('### Input: ' || src || ' ### Output: ' || ref || ' </s>', {EDGE}, '', 'g')) AS training,
          md5(regexp_replace('### Input: ' || src || ' ### Output:', {EDGE}, '', 'g')) AS prompt FROM pairs""",
)
def f5(spark, folder):
    training = text.chat_text(text.pair_messages(F.col("src"), F.col("ref")), "</s>")
    prompt = text.chat_text(text.pair_messages(F.col("src")), "</s>", generation=True)
    return fx.pairs(spark, folder).select("pair_id", F.md5(training).alias("training"), F.md5(prompt).alias("prompt"))


@query(
    "f6_split_chat",
    f"""WITH {fx.PAIRS}, texts AS (SELECT pair_id, CASE WHEN turn % 4 = 3 THEN src ELSE '### Input: ' || src || ' ### Output: ' || ref || ' ### Output: again ' END AS t FROM pairs)
        SELECT pair_id, md5(regexp_replace(CASE WHEN instr(t, '### Output:') > 0 THEN substr(t, instr(t, '### Output:') + 11) ELSE t END, {EDGE}, '', 'g')) AS pred,
               md5(regexp_replace(replace(CASE WHEN instr(t, '### Output:') > 0 THEN substr(t, 1, instr(t, '### Output:') - 1) ELSE t END, '### Input:', ''), {EDGE}, '', 'g')) AS input
        FROM texts""",
)
def f6(spark, folder):
    whole = F.concat(F.lit("### Input: "), "src", F.lit(" ### Output: "), "ref", F.lit(" ### Output: again "))
    rows = fx.pairs(spark, folder).withColumn("t", F.when(F.col("turn") % 4 == 3, F.col("src")).otherwise(whole))
    return rows.select("pair_id", F.md5(text.chat_output(F.col("t"))).alias("pred"), F.md5(text.chat_input(F.col("t"))).alias("input"))


# token ids of a text: a number per word; words of three letters stand for ignored places
TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: CASE WHEN length(w) = 3 THEN -100 ELSE length(w) * 1000 + ascii(w) END)"


def _tokens(c="text"):
    return F.transform(
        text.word_tokens(F.col(c)), lambda w: F.when(F.length(w) == 3, F.lit(-100)).otherwise(F.length(w) * 1000 + F.ascii(w))
    )


@query(
    "f7_replace_ignored",
    f"SELECT doc_id, array_to_string(list_transform({TOKENS}, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ' ') AS tokens FROM documents",
)
def f7(spark, folder):
    replaced = token_arrays.replace_ignored(_tokens(), 0)
    return _docs(spark, folder).select("doc_id", F.array_join(replaced, " ").alias("tokens"))


@query(
    "f8_truncate",
    f"""SELECT doc_id, array_to_string(({TOKENS})[1:512], ' ') AS input_ids, array_to_string(({TOKENS})[1:256], ' ') AS labels FROM documents""",
)
def f8(spark, folder):
    rows = _docs(spark, folder).select("doc_id", _tokens().alias("t"))
    cut = batches.truncate_pairs(rows, "t", "t", 512, 256)
    return cut.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "labels")])


@query(
    "f9_pad_batches",
    f"""WITH t AS (SELECT pos, batch, t, max(len(t)) OVER (PARTITION BY batch) AS w FROM (
          SELECT doc_id AS pos, doc_id // 8 AS batch, {TOKENS} AS t FROM documents))
        SELECT pos, batch, array_to_string(t || list_transform(range(w - len(t)), lambda x: 0), ' ') AS right_ids,
               array_to_string(list_transform(range(w - len(t)), lambda x: 0) || t, ' ') AS left_ids,
               array_to_string(list_transform(range(w - len(t)), lambda x: 0) || list_transform(t, lambda x: 1), ' ') AS left_mask FROM t""",
)
def f9(spark, folder):
    rows = _docs(spark, folder).select(F.col("doc_id").alias("pos"), _tokens().alias("t"))
    right = batches.pad_batches(rows, "t", 8, 0).withColumnRenamed("input_ids", "right_ids").drop("attention_mask")
    both = batches.pad_batches(right, "t", 8, 0, side="left")
    return both.select(
        "pos",
        "batch",
        F.array_join("right_ids", " ").alias("right_ids"),
        F.array_join("input_ids", " ").alias("left_ids"),
        F.array_join("attention_mask", " ").alias("left_mask"),
    )


MARKER = [14711, 5688, 25]


@query(
    "f10_completion_labels",
    f"""WITH {fx.PAIRS}, t AS (SELECT pair_id, turn, {TOKENS.replace("(text", "(src")} AS s, {TOKENS.replace("(text", "(ref")} AS r FROM pairs)
        SELECT pair_id, array_to_string(CASE WHEN turn % 4 = 3 THEN list_transform(s, lambda x: -100)
                 ELSE list_transform(s || {MARKER}, lambda x: -100) || r END, ' ') AS labels FROM t""",
)
def f10(spark, folder):
    marker = F.array(*[F.lit(m) for m in MARKER])
    rows = fx.pairs(spark, folder)
    ids = F.when(F.col("turn") % 4 == 3, _tokens("src")).otherwise(F.concat(_tokens("src"), marker, _tokens("ref")))
    labels = token_arrays.completion_labels(F.col("ids"), MARKER)
    return rows.withColumn("ids", ids).select("pair_id", F.array_join(labels, " ").alias("labels"))


@query(
    "f11_fold_accents",
    f"SELECT doc_id, md5(regexp_replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '\\p{{Mn}}', '', 'g')) AS folded FROM documents",
)
def f11(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


@query(
    "f12_metric_keys",
    f"WITH {fx.TRIALS} SELECT run, step, 'test_' || model || '_' || metric AS key FROM trials",
)
def f12(spark, folder):
    return fx.trials(spark, folder).select("run", "step", text.metric_key(F.lit("test"), "model", "metric").alias("key"))


@query("f15_composed_names", "SELECT vec_id, (label % 3) || '-' || 'train' AS index_name, 'encoder+' || (label % 3) || '-train' AS builder FROM embeddings")
def f15(spark, folder):
    name = F.concat_ws("-", (F.col("label") % 3).cast("string"), F.lit("train"))
    return table(spark, folder, "embeddings").select("vec_id", name.alias("index_name"), F.concat_ws("+", F.lit("encoder"), name).alias("builder"))


@query(
    "f16_parse_model_key",
    f"""WITH {fx.SYSTEMS} SELECT pair_id, system, CASE WHEN system = 'oracle' THEN 'labels' ELSE 'toy' END AS model,
               CASE WHEN system <> 'oracle' THEN system END AS method, CASE WHEN system <> 'oracle' THEN 'easyread' END AS train_tasks FROM systems""",
)
def f16(spark, folder):
    rows = fx.systems(spark, folder).withColumn("m", F.when(F.col("system") == "oracle", "labels").otherwise(F.col("model")))
    return rows.select("pair_id", "system", text.model_key(F.col("m")).alias("k")).select("pair_id", "system", "k.*")


@query(
    "f17_normalise",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings),
       n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM v)
       SELECT vec_id, round(v[1] / len, 6) + 0.0 AS first, round(v[64] / len, 6) + 0.0 AS last, round(list_sum(list_transform(v, lambda x: (x / len) * (x / len))), 6) AS length FROM n""",
)
def f17(spark, folder):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = table(spark, folder, "embeddings").select("vec_id", vectors.normalise(tripled).alias("v"))
    return rows.select(
        "vec_id",
        (F.round(F.col("v")[0], 6) + 0.0).alias("first"),
        (F.round(F.col("v")[63], 6) + 0.0).alias("last"),
        F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length"),
    )


def half_up(value: str, digits: int = 4) -> str:
    """Rounding on the decimal text, halves up."""
    return f"CAST(round(CAST({value} AS DECIMAL(18, 9)), {digits}) AS DOUBLE)"


@query(
    "f19_round_last",
    f"WITH {fx.TRIALS} SELECT run, count(*) AS n, {half_up('avg(value)')} AS mean, {half_up('stddev_samp(value)')} AS std FROM trials GROUP BY run",
)
def f19(spark, folder):
    return mean_std(fx.trials(spark, folder, steps=False), ["run"], "value", digits=4)


@query("f21_last_name_part", "SELECT doc_id, split_part('eval.sheet.' || source, '.', 3) AS part, split_part(source || '_' || lang, '_', 2) AS tail FROM documents")
def f21(spark, folder):
    dotted = F.concat(F.lit("eval.sheet."), "source")
    return _docs(spark, folder).select("doc_id", text.last_part(dotted, ".").alias("part"), text.last_part(F.concat_ws("_", "source", "lang"), "_").alias("tail"))


@query(
    "f22_tolerant_json",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) END AS k FROM events""",
)
def f22(spark, folder):
    rows = table(spark, folder, "events").withColumn("p", F.when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props")))
    return rows.select("event_id", F.from_json("p", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query(
    "f23_dot_product",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
       SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def f23(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    shifted = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return rows.join(shifted, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("following")), 6).alias("similarity"))


@query(
    "f24_compression",
    f"""WITH {fx.SYSTEMS} SELECT pair_id, system, round(100 - len(regexp_extract_all(pred, '[\\p{{L}}\\p{{N}}]+')) / nullif(len(regexp_extract_all(src, '[\\p{{L}}\\p{{N}}]+')), 0) * 100.0, 6) AS ratio FROM systems""",
)
def f24(spark, folder):
    ratio = text.compression(F.size(text.word_tokens(F.col("src"))), F.size(text.word_tokens(F.col("pred"))))
    return fx.systems(spark, folder).select("pair_id", "system", F.round(ratio, 6).alias("ratio"))


# --- reshaping -------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "r1_melt",
    f"""WITH {fx.ANNOT}, ids AS (SELECT DISTINCT sample_id, annotator_id FROM answers)
        SELECT i.sample_id, i.annotator_id, t.criterion, a.answer FROM ids i, (SELECT unnest({fx.sql_list(TYPES)}) AS criterion) t
        LEFT JOIN answers a ON a.sample_id = i.sample_id AND a.annotator_id = i.annotator_id AND a.criterion = t.criterion""",
)
def r1(spark, folder):
    wide = reshape.widen(fx.answers(spark, folder), ["sample_id", "annotator_id"], "criterion", "answer", TYPES)
    return human.melt_answers(wide, ["sample_id", "annotator_id"], TYPES)


@query(
    "r2_lockstep_explode",
    f"WITH {fx.PAIRS} SELECT conv_id, turn, md5(src) AS input, md5(ref) AS label FROM pairs",
)
def r2(spark, folder):
    packed = reshape.aligned_lists(fx.pairs(spark, folder), ["conv_id"], "turn", ["turn", "src", "ref"])
    rows = reshape.explode_together(packed, ["turn", "src", "ref"])
    return rows.select("conv_id", "turn", F.md5("src").alias("input"), F.md5("ref").alias("label"))


@query(
    "r3_flatten",
    """SELECT event_id, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS "texts/props/k", event_type AS "texts/kind" FROM events""",
)
def r3(spark, folder):
    nested = table(spark, folder, "events").select(
        "event_id", F.struct(F.from_json("props", "k int").alias("props"), F.col("event_type").alias("kind")).alias("texts")
    )
    return reshape.flatten(nested)


@query(
    "r5_task_flags",
    f"""WITH {fx.TRIALS}, l AS (SELECT run, step, ['easyread', 'easyread+wikilarge', 'easyread+orangesum+wikilarge'][k + 1] AS tasks FROM trials)
        SELECT run, step, true AS has_easyread, tasks LIKE '%orangesum%' AS has_orangesum, tasks LIKE '%wikilarge%' AS has_wikilarge FROM l""",
)
def r5(spark, folder):
    listed = fx.pick(["easyread", "easyread+wikilarge", "easyread+orangesum+wikilarge"], F.col("k"))
    log = fx.trials(spark, folder).select("run", "step", listed.alias("tasks"))
    return log.withColumns(text.task_flags(F.col("tasks"), ["easyread", "orangesum", "wikilarge"])).drop("tasks")


@query(
    "r6_record_of_lists",
    f"""WITH {fx.PAIRS}, r AS (SELECT turn + conv_id * 1000 AS pos, length(src) AS a, length(ref) AS b FROM pairs)
        SELECT pos // 1000 AS chunk, array_to_string(list(a ORDER BY pos), ' ') AS src_len, array_to_string(list(b ORDER BY pos), ' ') AS ref_len FROM r GROUP BY 1""",
)
def r6(spark, folder):
    record = F.create_map(F.lit("src_len"), F.length("src"), F.lit("ref_len"), F.length("ref"))
    rows = fx.pairs(spark, folder).select((F.col("turn") + F.col("conv_id") * 1000).alias("pos"), record.alias("record"))
    lists = reshape.records_to_lists(rows, "pos", "record", ["src_len", "ref_len"])
    return lists.select("chunk", F.array_join("src_len", " ").alias("src_len"), F.array_join("ref_len", " ").alias("ref_len"))


# --- sets and mixes --------------------------------------------------------------------------


@query("u1_concatenate", f"""WITH {fx.CORPUS}, n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
        SELECT doc_id, task, pos + coalesce((SELECT sum(n) FROM n WHERE list_position({fx.sql_list(fx.TASKS)}, n.lang) < list_position({fx.sql_list(fx.TASKS)}, task)), 0)::BIGINT AS mix_pos FROM corpus""")
def u1(spark, folder):
    return mixing.mix(fx.corpus(spark, folder), fx.TASKS, "concatenate").select("doc_id", "task", "mix_pos")


@query(
    "u2_frame_union",
    f"""WITH {fx.SYSTEMS} SELECT system, pair_id, md5(pred) AS value, task FROM systems WHERE system <> 'oracle'
        UNION ALL SELECT 'labels', pair_id, md5(ref), NULL FROM pairs""",
)
def u2(spark, folder):
    outputs = fx.systems(spark, folder).where("system <> 'oracle'").select("system", "pair_id", F.md5("pred").alias("value"), "task")
    labels = fx.pairs(spark, folder).select(F.lit("labels").alias("system"), "pair_id", F.md5("ref").alias("value"))
    return corpus.union_all([outputs, labels])


@query(
    "u3_task_union",
    f"""SELECT source, array_to_string(list_sort(list_distinct(list(lang))), '+') AS tasks, count(DISTINCT lang) AS n_tasks FROM documents
        WHERE ({SPLIT} = 'train' AND lang IN ('en', 'fr')) OR ({SPLIT} <> 'train' AND lang IN ('fr', 'de')) GROUP BY source""",
)
def u3(spark, folder):
    docs = _docs(spark, folder).select("source", "lang", fx.pick(fx.SPLITS, F.col("doc_id") % 3).alias("split"))

    def listed(condition):
        return F.collect_set(F.when(condition, F.col("lang")))

    train = listed((F.col("split") == "train") & F.col("lang").isin("en", "fr"))
    validation = listed((F.col("split") == "validation") & F.col("lang").isin("fr", "de"))
    test = listed((F.col("split") == "test") & F.col("lang").isin("fr", "de"))
    # at most four languages per list
    tasks = docs.groupBy("source").agg(F.sort_array(corpus.task_union(train, validation, test)).alias("tasks"))
    return tasks.where(F.size("tasks") > 0).select("source", F.array_join("tasks", "+").alias("tasks"), F.size("tasks").cast("long").alias("n_tasks"))


@query(
    "u5_unigram_difference",
    f"""WITH {fx.SYSTEMS} SELECT pair_id, system, array_to_string(list_sort(list_distinct(list_filter(
          regexp_extract_all(lower(pred), '[a-z0-9]+'), lambda w: NOT list_contains(regexp_extract_all(lower(src), '[a-z0-9]+'), w)))), ' ') AS new_words FROM systems""",
)
def u5(spark, folder):
    rows = fx.systems(spark, folder)
    new = F.array_except(text.ascii_tokens(F.col("pred")), text.ascii_tokens(F.col("src")))
    return rows.select("pair_id", "system", F.array_join(F.array_sort(new), " ").alias("new_words"))
