import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claritas.operators import quantiles
from claritas.operators.numbering import number_by_hash, number_rows, running_total, with_next
from claritas.operators.quantiles import box_summary, describe, outliers, percentiles
from claritas.operators.text_order import borders_of, text_borders, text_bucket


def _frame(n=3000, seed=3):
    rnd = random.Random(seed)
    # one group holds most rows and one order value is very frequent
    return pd.DataFrame(
        {
            "g": ["hot" if rnd.random() < 0.7 else rnd.choice("ab") for _ in range(n)],
            "v": [5.0 if rnd.random() < 0.4 else float(rnd.randint(-50, 50)) for _ in range(n)],
            "id": rnd.sample(range(10 * n), n),
            "w": [rnd.randint(0, 4) for _ in range(n)],
        }
    )


@pytest.fixture(params=["few", "many"])
def counts(request, monkeypatch):
    """Both ways of the exact statistics: ranked by a window, or cut into buckets."""
    if request.param == "many":
        monkeypatch.setattr(quantiles, "FEW_COUNTS", 0)


@pytest.mark.parametrize("buckets", [2, 16, 97])
def test_number_rows_with_hot_group_and_frequent_value(spark, buckets):
    pdf = _frame()
    got = number_rows(spark.createDataFrame(pdf), ["g"], ["v", "id"], buckets=buckets).toPandas()
    want = pdf.sort_values(["g", "v", "id"])
    want["pos"] = want.groupby("g").cumcount()
    key = ["g", "id"]
    pd.testing.assert_frame_equal(
        got.sort_values(key)[["g", "id", "pos"]].reset_index(drop=True),
        want.sort_values(key)[["g", "id", "pos"]].reset_index(drop=True),
        check_dtype=False,
    )


def test_frequent_value_is_split_by_the_second_key(spark):
    # nearly all rows share the first key: no bucket may hold them all
    pdf = pd.DataFrame({"v": [1.0] * 4000 + [2.0] * 10, "id": range(4010)})
    df = running_total(spark.createDataFrame(pdf), [], ["v", "id"], buckets=16)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "_sub" in plan and "_tie" in plan
    got = df.toPandas().sort_values("id")
    assert got["running"].tolist() == list(range(1, 4011))


def test_running_total_of_weights_and_null_order(spark):
    pdf = _frame(500)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("v")))
    got = running_total(df, ["g"], ["v", "id"], weight="w", name="upto").toPandas()
    want = df.toPandas().sort_values(["g", "v", "id"], na_position="first")
    want["upto"] = want.groupby("g")["w"].cumsum()
    assert dict(zip(got["id"], got["upto"])) == dict(zip(want["id"], want["upto"]))


def test_number_by_hash_is_a_repeatable_permutation(spark):
    df = spark.range(1000)
    one = number_by_hash(df, [], "seed", ["id"]).toPandas()
    two = number_by_hash(df.repartition(7), [], "seed", ["id"]).toPandas()
    other = number_by_hash(df, [], "else", ["id"]).toPandas()
    assert sorted(one["pos"]) == list(range(1000))
    order = dict(zip(one["id"], one["pos"]))
    assert order == dict(zip(two["id"], two["pos"])) and order != dict(zip(other["id"], other["pos"]))


def test_with_next_skips_gaps(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 7, "b"), (1, 9, "c"), (2, 5, "x")], "c int, t int, s string")
    got = {(r.c, r.t): r.next_s for r in with_next(df, ["c"], "t", ["s"]).collect()}
    assert got == {(1, 0): "b", (1, 7): "c"}


def test_percentiles_match_numpy(spark, counts):
    pdf = _frame(1500)
    got = percentiles(spark.createDataFrame(pdf), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["p10", "p50", "p99"]].astype(float), np.quantile(part["v"], [0.1, 0.5, 0.99]))


def test_percentiles_of_everything(spark, counts):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    row = percentiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (row.a, row.b, row.c) == (1.75, 3.0, 5.5)


def test_describe_matches_pandas(spark, counts):
    pdf = _frame(900)
    pdf.loc[pdf.index % 10 == 0, "v"] = float("nan")
    got = describe(spark.createDataFrame(pdf), ["g"], "v").toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].describe()
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_describe_of_one_row_has_no_deviation(spark, counts):
    row = describe(spark.createDataFrame([("a", 2.0)], "g string, v double"), ["g"], "v").first()
    assert row.n == 1 and row.std is None and row.median == 2.0


def test_box_plot_numbers(spark, counts):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    row = box_summary(df, ["g"], "v").first()
    assert (row.q1, row.median, row.q3) == (2.25, 3.5, 4.75)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 5.0, 1)
    assert [r.v for r in outliers(df, ["g"], "v").collect()] == [100.0]


def test_null_groups_are_groups(spark, counts):
    rows = [("a", 1, 5.0), (None, 2, 7.0), (None, 1, None), ("b", 1, None), ("a", 2, 9.0), ("c", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r["g"], r["k"]): r["pos"] for r in number_rows(df, ["g"], ["k"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, (None, 1): 0, (None, 2): 1, ("b", 1): 0, ("c", 1): 0}
    table = {r["g"]: r for r in quantiles.describe(df, ["g"], "v").collect()}
    assert {g: (r["n"], r["mean"], r["max"]) for g, r in table.items()} == {"a": (2, 7.0, 9.0), None: (1, 7.0, 7.0), "b": (0, None, None), "c": (0, None, None)}
    assert {r["g"]: r["m"] for r in quantiles.percentiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": 7.0, None: 7.0, "b": None, "c": None}
    boxes = {r["g"]: (r["median"], r["whisker_high"], r["n_outliers"]) for r in quantiles.box_summary(df, ["g"], "v").collect()}
    assert boxes == {"a": (7.0, 9.0, 0), None: (7.0, 7.0, 0), "b": (None, None, 0), "c": (None, None, 0)}
    wide = spark.createDataFrame([(None, float(k)) for k in range(20)] + [(None, 1e6)], "g string, v double")
    assert [r["v"] for r in quantiles.outliers(wide, ["g"], "v").collect()] == [1e6]


def test_texts_of_two_families_spread_over_buckets(spark):
    rows = [(f"{family}_{'x' * 300}_{k:09d}",) for family in ("annotator", "expert") for k in range(10_000)] + [(None,)]
    df = spark.createDataFrame(rows, "name string").repartition(5)
    borders, frequent = text_borders(df, "name", 64)
    sizes = [r["count"] for r in df.where("name IS NOT NULL").groupBy(text_bucket(F.col("name"), borders).alias("b")).count().collect()]
    assert not frequent and len(sizes) == 64 and max(sizes) < 3 * 20_000 / 64
    got = sorted((r["name"] or "", r["pos"]) for r in number_rows(df, [], ["name"], buckets=64).collect())
    assert [p for _, p in got] == list(range(20_001))
    with pytest.raises(TypeError):
        number_rows(spark.createDataFrame([([1],)], "a array<int>"), [], ["a"])


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_texts_order_by_bytes(spark, buckets):
    rnd = random.Random(buckets)
    texts = ["".join(rnd.choice("ab\0éÿ漢😀 \uffff") for _ in range(rnd.randint(0, 6))) for _ in range(900)] + ["hot"] * 800
    rows = [(t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t string, id int")
    got = {r["id"]: r["pos"] for r in number_rows(df, [], ["t", "id"], buckets=buckets).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0].encode(), r[1])))}


def test_frequent_text_is_split_by_a_second_text(spark):
    rows = [("same", f"k{k:05d}") for k in range(4_000)] + [("other", "x"), ("tame", None), (None, "y"), (None, None)]
    df = spark.createDataFrame(rows, "t string, u string")
    out = running_total(df, [], ["t", "u"], buckets=16)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "_sub" in plan
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or ""))
    assert {(r["t"], r["u"]): r["running"] for r in out.collect()} == {r: i + 1 for i, r in enumerate(want)}


def test_borders_are_short_and_ascending():
    sample = [f"{'long common start ' * 20}{k}" for k in range(200)]
    borders, _ = borders_of(sample, 8)
    assert borders == sorted(borders) and len(borders) == 7
    assert borders_of([], 8) == ([], []) and borders_of([""] * 50, 8) == (["\0"], [""])
    assert borders_of(["a", "b"] * 100, 4)[1] in (["a", "b"], ["b"], ["a"])


def test_raw_rows_stay_in_place(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "double(id) AS v")
    plan = quantiles.outliers(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
