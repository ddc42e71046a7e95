"""Retrieval of examples, their order, and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.functions import prompts, text
from claritas.functions.hooks import encode, generate
from claritas.operators import retrieval, shots, trials
from claritas.plans import fixtures as fx
from claritas.plans.queries_columns import half_up
from claritas.plans.registry import query, table

K = 3
TASKS = ["c", "a"]  # task b is retrieved too, but not listed


def _found(spark, folder, k=K):
    return retrieval.top_k(fx.knn_queries(spark, folder), fx.knn_corpus(spark, folder), k)


def _retrieved(spark, folder):
    return shots.retrieval_order(_found(spark, folder), TASKS)


RETRIEVED = f"""{fx.KNN},
retrieved AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(list_position(['c', 'a'], task), 0), 9), task, rank) AS retrieved FROM shots)"""
COLUMNS = "query_id, item_id, task, CAST(shot AS INT) AS shot"


def _ordered(name: str, method: str, order: str, extra: str = ""):
    @query(name, f"WITH {RETRIEVED}{extra} SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS shot FROM {'turned' if extra else 'retrieved'})")
    def run(spark, folder):
        ordered = shots.order_shots(_retrieved(spark, folder), method, TASKS, seed=name)
        return ordered.select("query_id", "item_id", "task", "shot")

    return run


@query("j6_inner_product_search", f"WITH {fx.KNN} SELECT query_id, item_id, task, {half_up('similarity', 6)} AS similarity, CAST(rank AS INT) AS rank FROM shots")
def j6(spark, folder):
    return _found(spark, folder).withColumn("similarity", F.round("similarity", 6))


@query("w4_top_k_per_task", f"WITH {fx.KNN} SELECT query_id, task, CAST(rank AS INT) AS rank, item_id FROM shots WHERE rank <= 2")
def w4(spark, folder):
    return _found(spark, folder, k=2).select("query_id", "task", "rank", "item_id")


@query("j6_search_summary", f"WITH {fx.KNN} SELECT count(*) AS n, round(sum(similarity), 6) AS similarity, sum(item_id)::BIGINT AS items FROM shots")
def j6_summary(spark, folder):
    return _found(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 6).alias("similarity"), F.sum("item_id").alias("items")
    )


@query(
    "j7_neighbours_of_stored_rows",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
       s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 9) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id)
       SELECT query_id, item_id, {half_up("similarity", 6)} AS similarity, CAST(rank AS INT) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
)
def j7(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return retrieval.neighbours(vectors, 5).withColumn("similarity", F.round("similarity", 6))


ORDERINGS = ["sort_similarity_ascending", "alternating_tasks", "successive_tasks"]


@query(
    "j4_parameter_sweep",
    f"""WITH {fx.KNN} SELECT query_id, item_id, task, CAST(rank AS INT) AS rank, g.k, o.ordering, CAST(r.repeat AS INT) AS repeat
        FROM shots JOIN (VALUES (1), (2), (3)) g(k) ON rank <= g.k, (SELECT unnest({fx.sql_list(ORDERINGS)}) AS ordering) o, (SELECT unnest(range(1, 6)) AS repeat) r""",
)
def j4(spark, folder):
    # the largest k is searched once; every grid point keeps its share
    found = _found(spark, folder, k=3).drop("similarity")
    swept = trials.grid(found, {"k": [1, 2, 3], "ordering": ORDERINGS}, repeats=5)
    return swept.where(F.col("rank") <= F.col("k"))


_ordered("w5_alternating_tasks", "alternating_tasks", "turn, place, retrieved", """,
turned AS (SELECT *, row_number() OVER (PARTITION BY query_id, task ORDER BY retrieved) AS turn, coalesce(nullif(list_position(['c', 'a'], task), 0), 9) AS place FROM retrieved)""")
_ordered("w6_successive_tasks", "successive_tasks", "coalesce(nullif(list_position(['c', 'a'], task), 0), 9), retrieved")
_ordered("w7_similarity_ascending", "sort_similarity_ascending", "similarity, retrieved")
_ordered("w7_similarity_descending", "sort_similarity_descending", "similarity DESC, retrieved")
_ordered("w8_shuffle", "shuffle", "md5('w8_shuffle:' || query_id || ':' || item_id), retrieved")


@query(
    "w9_example_numbers",
    f"WITH {RETRIEVED} SELECT query_id, item_id, CAST(row_number() OVER w AS INT) AS number, CAST(row_number() OVER w - 1 AS INT) AS early_number FROM retrieved WINDOW w AS (PARTITION BY query_id ORDER BY similarity, retrieved)",
)
def w9(spark, folder):
    ordered = shots.order_shots(_retrieved(spark, folder), "sort_similarity_ascending")
    return ordered.select("query_id", "item_id", F.col("shot").alias("number"), (F.col("shot") - 1).alias("early_number"))


NAMES = {"a": "FALC", "c": "Simplification"}


@query(
    "f18_task_names",
    f"WITH {RETRIEVED} SELECT query_id, item_id, CASE task WHEN 'a' THEN 'FALC' WHEN 'c' THEN 'Simplification' ELSE task END AS task, 'Simplification+FALC' AS task_order FROM retrieved",
)
def f18(spark, folder):
    renamed = shots.rename_tasks(_retrieved(spark, folder), NAMES).select("query_id", "item_id", "task")
    return renamed.withColumn("task_order", F.lit("+".join(shots.renamed_order(["c", "a", "c"], NAMES))))


CONTENT = """content AS (SELECT r.query_id, r.task, d.text AS src, d.source AS dst,
  row_number() OVER (PARTITION BY r.query_id ORDER BY similarity, retrieved) AS shot FROM retrieved r
  LEFT JOIN documents d ON d.doc_id = r.item_id % (SELECT count(*) FROM documents))"""
NAMED = "CASE task WHEN 'a' THEN 'FALC' WHEN 'c' THEN 'Simplification' ELSE task END"
SHOT = f"'### Exemple ' || shot || chr(10) || 'Tâche: ' || {NAMED} || chr(10) || 'Entrée: ' || src || chr(10) || 'Sortie: @@@' || dst || '@@@'"


def _shot_texts(spark, folder):
    documents = table(spark, folder, "documents")
    docs = documents.select(F.col("doc_id"), F.col("text").alias("src"), F.col("source").alias("dst"))
    # there may be more vectors than documents: the texts are used in turn
    found = _retrieved(spark, folder).withColumn("doc_id", F.col("item_id") % documents.count())
    content = shots.with_content(found, docs, ["doc_id"], ["src", "dst"]).drop("doc_id")
    ordered = shots.rename_tasks(shots.order_shots(content, "sort_similarity_ascending"), NAMES)
    return ordered.withColumn("shot_text", shots.shot_text(F.col("shot"), F.col("task"), F.col("src"), F.col("dst")))


@query(
    "f2_render_shots",
    f"WITH {RETRIEVED}, {CONTENT} SELECT query_id, md5(string_agg({SHOT}, chr(10) ORDER BY shot)) AS shots FROM content GROUP BY query_id",
)
def f2(spark, folder):
    return shots.render_shots(_shot_texts(spark, folder)).withColumn("shots", F.md5("shots"))


@query(
    "f2_render_early_shots",
    f"""WITH {RETRIEVED}, {CONTENT} SELECT query_id, md5(string_agg('Exemple ' || (shot - 1) || chr(10) || 'Texte original :' || chr(10) || '"' || src || '"' || chr(10)
          || 'Traduction en texte facile à lire et à comprendre :' || chr(10) || '@@@' || dst || '@@@' || chr(10) || chr(10), '' ORDER BY shot)) AS shots FROM content GROUP BY query_id""",
)
def f2_early(spark, folder):
    rows = _shot_texts(spark, folder)
    early = shots.early_shot_text(F.col("shot") - 1, F.col("src"), F.col("dst"))
    return shots.render_shots(rows.withColumn("shot_text", early), separator="").withColumn("shots", F.md5("shots"))


def _sql_prompt(template: str) -> str:
    return fx.sql_text(template)


@query(
    "f3_render_prompts",
    f"""SELECT doc_id, md5({_sql_prompt(prompts.ZERO_SHOT.system)}) AS zero_system, md5(text) AS zero_user, md5({_sql_prompt(prompts.STEP_BY_STEP.system)}) AS steps_system,
               md5(replace({_sql_prompt(prompts.FEW_SHOT.system)}, '{{shots}}', source)) AS few_system,
               md5(replace({_sql_prompt(prompts.EARLY.system)}, '{{shots}}', source)) AS early_system,
               md5(replace({_sql_prompt(prompts.EARLY_WITH_NEGATIVE.system)}, '{{shots}}', source)) AS negative_system,
               md5('Tâche: ' || CASE lang WHEN 'fr' THEN 'FALC' ELSE lang END || chr(10) || 'Entrée: ' || text || chr(10) || 'Sortie: ') AS few_user FROM documents""",
)
def f3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("input"), F.col("lang").alias("task"), F.col("source").alias("shots"))
    named = {"zero": prompts.ZERO_SHOT, "steps": prompts.STEP_BY_STEP, "few": prompts.FEW_SHOT, "early": prompts.EARLY, "negative": prompts.EARLY_WITH_NEGATIVE}
    for name, template in named.items():
        docs = prompts.render_prompt(docs, template, {"fr": "FALC"})
        docs = docs.withColumnsRenamed({"system_prompt": f"{name}_system", "user_prompt": f"{name}_user"})
    kept = ["zero_system", "zero_user", "steps_system", "few_system", "few_user", "early_system", "negative_system"]
    return docs.select("doc_id", *[F.md5(c).alias(c) for c in kept])


@query(
    "h5_prompt_manager",
    f"""SELECT doc_id, md5({_sql_prompt(prompts.ZERO_SHOT.system)}) AS system_prompt, md5(upper(lang) || ': ' || text) AS user_prompt FROM documents""",
)
def h5(spark, folder):
    own = prompts.Template(prompts.ZERO_SHOT.system, "{task}: {input}")
    prompts.register_manager("titled", lambda df: prompts.render_prompt(df.withColumn("task", F.upper("task")), own))
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("input"), F.col("lang").alias("task"))
    out = prompts.with_manager(docs, "titled")
    return out.select("doc_id", F.md5("system_prompt").alias("system_prompt"), F.md5("user_prompt").alias("user_prompt"))


def _echo():
    """Stand-in for a model: repeats the user prompt between marks."""
    return lambda system, user: f"note @@@{user}@@@"


@query("h3_generate_with_hook", "SELECT doc_id, md5(text) AS answer FROM documents")
def h3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("input"), F.col("lang").alias("task"))
    out = generate(prompts.render_prompt(docs, prompts.STEP_BY_STEP), _echo, ["doc_id"])
    return out.select("doc_id", F.md5(text.marked_answer(F.col("output"))).alias("answer"))


def _lengths():
    """Stand-in for an encoder: two numbers per text."""
    return lambda texts: [[float(len(t.encode("utf-8"))), float(t.count(" "))] for t in texts]


@query("h3_encode_with_hook", "SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS n_bytes, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_blanks FROM documents")
def h3_encode(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = encode(docs, _lengths, "text", ["doc_id"])
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("n_bytes"), F.col("embedding")[1].cast("double").alias("n_blanks"))


@query("h7_one_row_many_shots", f"WITH {fx.KNN} SELECT query_id, count(*) AS n_shots, count(DISTINCT task) AS n_tasks FROM shots GROUP BY query_id")
def h7(spark, folder):
    return _found(spark, folder).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_shots"), F.countDistinct("task").alias("n_tasks"))
