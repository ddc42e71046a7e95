import itertools

import pytest

from claritas.operators import corpus, mixing

TASKS = ["t1", "t2", "t3"]


def _pairs(spark, sizes):
    rows = [(t, i, f"{t}-{i}") for t, n in zip(TASKS, sizes) for i in range(n)]
    return spark.createDataFrame(rows, "task string, pos long, src string")


def _mixed(spark, sizes, strategy):
    rows = mixing.mix(_pairs(spark, sizes), TASKS, strategy).orderBy("mix_pos").collect()
    assert [r.mix_pos for r in rows] == list(range(len(rows)))
    return [r.src for r in rows]


@pytest.mark.parametrize("strategy, n", [("balanced", 30), ("concatenate", 39), ("first_exhausted", 30), ("all_exhausted", 48)])
def test_sizes(spark, strategy, n):
    assert len(_mixed(spark, (10, 13, 16), strategy)) == n


def test_orders(spark):
    assert _mixed(spark, (2, 3, 4), "balanced") == ["t1-0", "t1-1", "t2-0", "t2-1", "t3-0", "t3-1"]
    assert _mixed(spark, (2, 3, 4), "first_exhausted") == ["t1-0", "t2-0", "t3-0", "t1-1", "t2-1", "t3-1"]
    assert _mixed(spark, (1, 2, 1), "concatenate") == ["t1-0", "t2-0", "t2-1", "t3-0"]


@pytest.mark.parametrize("sizes, chunk", [((2, 3, 5), 4096), ((1, 7, 40), 4), ((1, 1, 100), 7)])
def test_all_exhausted_wraps_around(spark, monkeypatch, sizes, chunk):
    monkeypatch.setattr(mixing, "ROUNDS_PER_ROW", chunk)
    want = [f"{t}-{r % n}" for r in range(max(sizes)) for t, n in zip(TASKS, sizes)]
    assert _mixed(spark, sizes, "all_exhausted") == want


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        mixing.mix(_pairs(spark, (1, 1, 1)), TASKS, "other")


def test_task_ids_follow_the_list_and_unmapped_is_null(spark):
    df = _pairs(spark, (1, 1, 1))
    listed = {r.task: r.task_id for r in corpus.assign_task_ids(df, tasks=["t3", "t1"]).collect()}
    assert listed == {"t3": 0, "t1": 1, "t2": None}
    mapped = {r.task: r.task_id for r in corpus.assign_task_ids(df, mapping={"t2": 9}).collect()}
    assert mapped == {"t1": None, "t2": 9, "t3": None}


def test_select_tasks_is_per_split(spark):
    rows = list(itertools.product(["train", "test"], ["a", "b"]))
    df = spark.createDataFrame(rows, "split string, task string")
    kept = corpus.select_tasks(df, {"train": ["a"], "test": ["a", "b"], "validation": []}).collect()
    assert sorted((r.split, r.task) for r in kept) == [("test", "a"), ("test", "b"), ("train", "a")]


def test_task_union_keeps_first_mention():
    assert corpus.all_tasks(["b", "a"], ["a", "c"], ["b"]) == ["b", "a", "c"]
