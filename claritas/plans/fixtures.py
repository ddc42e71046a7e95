"""Derived tables that stand for corpora, trial logs and answer sheets, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritas.functions.fixed import CRITERIA
from claritas.functions.text import FIRST_SENTENCE, first_sentence
from claritas.operators.numbering import number_rows
from claritas.operators.pairing import pair_turns
from claritas.plans.registry import table

SPLITS = ["train", "validation", "test"]
ANSWERS = ["Oui", "Non", "Partiellement", "Non Applicable"]
CODES = [*CRITERIA, "X99"]  # the last code is in no theme


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# --- pairs: a user turn and the assistant turn that follows -------------------------------


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return pair_turns(turns, dense=True)


PAIRS = """turns AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
pairs AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS pair_id, text AS src, next_text AS ref
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""

# --- systems: three toy systems answering every pair --------------------------------------


def systems(spark: SparkSession, folder: str) -> DataFrame:
    named = F.explode(F.array(F.lit("copy"), F.lit("oracle"), F.lit("lead"))).alias("system")
    pred = F.when(F.col("system") == "copy", F.col("src")).when(F.col("system") == "oracle", F.col("ref"))
    return (
        pairs(spark, folder)
        .select("*", named)
        .withColumn("pred", pred.otherwise(first_sentence(F.col("src"))))
        .withColumn("task", F.when(F.col("conv_id") % 2 == 0, "easyread").otherwise("wikilarge"))
        .withColumn("split", F.when(F.col("conv_id") % 3 == 0, "validation").otherwise("test"))
        .withColumn("model", F.concat(F.lit("('toy', '"), F.col("system"), F.lit("', 'easyread')")))
    )


SYSTEMS = f"""{PAIRS},
systems AS (
  SELECT pair_id, conv_id, turn, system, src, ref,
         CASE system WHEN 'copy' THEN src WHEN 'oracle' THEN ref
              ELSE regexp_extract(src, '{FIRST_SENTENCE}') END AS pred,
         CASE WHEN conv_id % 2 = 0 THEN 'easyread' ELSE 'wikilarge' END AS task,
         CASE WHEN conv_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split,
         '(''toy'', ''' || system || ''', ''easyread'')' AS model
  FROM pairs, (VALUES ('copy'), ('oracle'), ('lead')) AS named(system))"""

# --- corpus: documents as a pair corpus, task = language ----------------------------------


def corpus(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    split = pick(SPLITS, F.col("doc_id") % 3)
    keys = docs.select("doc_id", F.col("lang").alias("task"), split.alias("split"), *columns)
    return number_rows(keys, ["task"], ["doc_id"])


def split_corpus(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """As `corpus`, with positions inside (task, split)."""
    docs = table(spark, folder, "documents")
    split = pick(SPLITS, F.col("doc_id") % 3)
    keys = docs.select("doc_id", F.col("lang").alias("task"), split.alias("split"), *columns)
    return number_rows(keys, ["task", "split"], ["doc_id"])


CORPUS = f"""corpus AS (
  SELECT *, lang AS task, {sql_list(SPLITS)}[CAST(doc_id % 3 AS INT) + 1] AS split,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
         row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY doc_id) - 1 AS split_pos
  FROM documents)"""
TASKS = ["fr", "en", "de", "es"]

# --- vectors: every stored vector asks, every stored vector can be found ----------------------


def knn_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_corpus(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vectors.select(F.col("vec_id").alias("item_id"), "embedding", pick(["a", "b", "c"], F.col("label") % 3).alias("task"))


def _knn(roles: str) -> str:
    return f"""vecs AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
found AS (
  SELECT q.vec_id AS query_id, c.vec_id AS item_id, ['a', 'b', 'c'][c.label % 3 + 1] AS task,
         round(list_dot_product(q.v, c.v), 9) AS similarity
  FROM vecs q JOIN vecs c ON {roles}),
shots AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, task ORDER BY similarity DESC, item_id) AS rank
  FROM found QUALIFY rank <= 3)"""


KNN = _knn("true")

# --- trials: events as a metric log --------------------------------------------------------


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def trials(spark: SparkSession, folder: str, steps: bool = True) -> DataFrame:
    events = table(spark, folder, "events")
    log = events.select(
        F.col("user_id").alias("run"),
        "event_id",
        "ts",
        F.col("event_type").alias("metric"),
        "value",
        (k_of() % 3).alias("k"),
        F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"),
        F.concat(F.lit("x"), F.col("user_id") % 3).alias("method"),
    )
    return number_rows(log, ["run"], ["ts", "event_id"], name="step", start=1) if steps else log


TRIALS = """trials AS (
  SELECT user_id AS run, event_id, ts, event_type AS metric, value,
         CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) % 3 AS k,
         'm' || (user_id % 2) AS model, 'x' || (user_id % 3) AS method,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
  FROM events)"""

# --- answers: events as criterion answers, the newest one counts ----------------------------


def newest_answers(answers: DataFrame) -> DataFrame:
    newest = F.max_by("answer", F.struct("ts", "event_id")).alias("answer")
    return answers.groupBy("sample_id", "annotator_id", "criterion").agg(newest)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Criterion = event type."""
    events = table(spark, folder, "events")
    return newest_answers(
        events.select(
            k_of().alias("sample_id"),
            (F.col("user_id") % 8).alias("annotator_id"),
            F.col("event_type").alias("criterion"),
            pick(ANSWERS, F.col("event_id") % 4).alias("answer"),
            "ts",
            "event_id",
        )
    )


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Criterion = one of the 36 codes, or a code that no theme lists."""
    events = table(spark, folder, "events")
    return newest_answers(
        events.select(
            k_of().alias("sample_id"),
            (F.col("user_id") % 8).alias("annotator_id"),
            pick(CODES, F.floor(F.col("event_id") / 4) % len(CODES)).alias("criterion"),
            pick(ANSWERS, F.col("event_id") % 4).alias("answer"),
            "ts",
            "event_id",
        )
    )


def _newest(name: str, criterion: str) -> str:
    return f"""{name} AS (
  SELECT sample_id, annotator_id, criterion, answer FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, annotator_id, criterion ORDER BY ts DESC, event_id DESC) AS rn
    FROM (SELECT CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS sample_id, user_id % 8 AS annotator_id,
                 {criterion} AS criterion, {sql_list(ANSWERS)}[CAST(event_id % 4 AS INT) + 1] AS answer, ts, event_id
          FROM events)) WHERE rn = 1)"""


ANNOT = _newest("answers", "event_type")
SHEETS = _newest("sheets", f"{sql_list(CODES)}[CAST((event_id // 4) % {len(CODES)} AS INT) + 1]")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """What the answer sheets judge: one row per sample id, with model and test set."""
    events = table(spark, folder, "events")
    ids = events.select(k_of().alias("sample_id")).distinct()
    return ids.withColumn("model", pick(["m0", "m1", "m2"], F.col("sample_id") % 3)).withColumn(
        "test_set", pick(["test_easyread", "test_politic"], F.col("sample_id") % 2)
    )


SAMPLES = """samples AS (
  SELECT DISTINCT sample_id, ['m0', 'm1', 'm2'][sample_id % 3 + 1] AS model,
         ['test_easyread', 'test_politic'][sample_id % 2 + 1] AS test_set
  FROM (SELECT CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS sample_id FROM events))"""

# --- lookups ---------------------------------------------------------------------------------


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
