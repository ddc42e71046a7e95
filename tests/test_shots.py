import random

import pytest
from pyspark.sql import functions as F

from claritas.functions import fixed, prompts
from claritas.operators import shots

ORDER = ["summarization", "translation", "classification"]
BASE = [
    ("A", 0.9, "translation"),
    ("B", 0.7, "summarization"),
    ("C", 0.8, "translation"),
    ("D", 0.6, "classification"),
    ("E", 0.5, None),
]


def _frame(spark, rows, query=1):
    data = [(query, c, i, s, t, i + 1) for i, (c, s, t) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id int, content string, item_id int, similarity double, task string, retrieved int")


def _order(df, method, tasks=ORDER, **options):
    rows = shots.order_shots(df, method, tasks, **options).orderBy("query_id", "shot").collect()
    return "".join(r.content for r in rows)


@pytest.mark.parametrize(
    "method, want",
    [
        ("sort_similarity_ascending", "EDBCA"),
        ("sort_similarity_descending", "ACBDE"),
        ("alternating_tasks", "BADCE"),
        ("successive_tasks", "BACDE"),
    ],
)
def test_orders(spark, method, want):
    assert _order(_frame(spark, BASE), method) == want


def test_unknown_task_goes_last(spark):
    rows = [*BASE, ("F", 0.4, "extra_task")]
    assert _order(_frame(spark, rows), "successive_tasks") == "BACDEF"
    # an unlisted task takes its turns after the listed ones
    assert _order(_frame(spark, rows), "alternating_tasks") == "BADFCE"


def test_shuffle_is_a_seeded_permutation(spark):
    df = _frame(spark, BASE)
    one = _order(df, "shuffle", seed=4)
    assert sorted(one) == list("ABCDE") and one == _order(df.repartition(3), "shuffle", seed=4)
    assert len({_order(df, "shuffle", seed=s) for s in range(6)}) > 1


def test_ties_keep_the_retrieved_order(spark):
    rows = [("A", 0.5, "x"), ("B", 0.5, "x"), ("C", 0.9, "x")]
    assert _order(_frame(spark, rows), "sort_similarity_ascending") == "ABC"
    assert _order(_frame(spark, rows), "sort_similarity_descending") == "CAB"


def test_alternating_is_a_round_robin(spark):
    rnd, frames, want = random.Random(8), [], {}
    for query in range(30):
        rows = [(chr(65 + i), rnd.random(), rnd.choice([*ORDER, None])) for i in range(rnd.randint(1, 9))]
        frames.append(_frame(spark, rows, query))
        queues = {t: [c for c, _, x in rows if x == t] for t in ORDER}
        out = []
        while any(queues.values()):
            out += [queues[t].pop(0) for t in ORDER if queues[t]]
        want[query] = "".join(out + [c for c, _, t in rows if t is None])
    df = frames[0]
    for f in frames[1:]:
        df = df.union(f)
    ordered = shots.order_shots(df, "alternating_tasks", ORDER)
    got = ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("shot", "content"))).alias("s"))
    assert {r.query_id: "".join(x.content for x in r.s) for r in got.collect()} == want


def test_method_errors(spark):
    with pytest.raises(ValueError):
        shots.order_shots(_frame(spark, BASE), "other")
    with pytest.raises(ValueError):
        shots.order_shots(_frame(spark, BASE), "successive_tasks", None)


def test_rename_keeps_unknown_and_drops_repeats(spark):
    got = shots.rename_tasks(_frame(spark, BASE), {"translation": "T"}).orderBy("item_id").collect()
    assert [r.task for r in got] == ["T", "summarization", "T", "classification", None]
    assert shots.renamed_order(["a", "b", "c"], {"a": "X", "c": "X"}) == ["X", "b"]


def test_render_shots(spark):
    df = _frame(spark, [("A", 0.1, "FALC"), ("B", 0.2, None)]).withColumn("shot", F.col("retrieved"))
    text = shots.shot_text(F.col("shot"), F.col("task"), F.col("content"), F.lit("y"))
    got = shots.render_shots(df.withColumn("shot_text", text)).first().shots
    assert got == (
        "### Exemple 1\nTâche: FALC\nEntrée: A\nSortie: @@@y@@@\n### Exemple 2\nTâche: None\nEntrée: B\nSortie: @@@y@@@"
    )


def test_prompts(spark):
    df = spark.createDataFrame([("in {task}", "fr", "S {shots}")], "input string, task string, shots string")
    row = prompts.render_prompt(df, prompts.FEW_SHOT, {"fr": "FALC"}).first()
    assert row.user_prompt == "Tâche: FALC\nEntrée: in {task}\nSortie: "
    assert "S {shots}\nMaintenant" in row.system_prompt
    assert "saut de ligne.Entoure ta réponse" in row.system_prompt
    assert row.system_prompt.count("\n- ") == len(fixed.GUIDELINES) == 27
    plain = prompts.with_manager(df, "zero_shot").first()
    assert plain.user_prompt == "in {task}" and plain.system_prompt.endswith("en français.")
    with pytest.raises(KeyError):
        prompts.with_manager(df, "none")
