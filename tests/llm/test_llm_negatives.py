"""Hard negatives: the whole result against brute force, and bounds that never lose a pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claritas.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, scale=256, every=100, positives=5, most=5):
    """rows: (vec_id, vector, label)."""
    good = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == y][:positives]:
            kept = [s for s in scored if s[2] != y and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:most]
            out += [(i, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(kept, 1)]
    return sorted(out)


def found(spark, rows, chosen=None, **how):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0 if chosen is None else chosen, **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n, width=32, centres=6):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((centres, width)) * np.repeat(draw.standard_normal((centres, 4)) * 2, width // 4, axis=1)
    return [(int(k), [float(x) for x in (middle[k % centres] + 0.3 * draw.standard_normal(width)).astype(np.float32)], int(draw.integers(0, 3))) for k in range(n)]


def test_given_table_equals_brute_force(spark):
    from claritas.llm.queries import QUERIES

    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = QUERIES["op13_segment_negatives"](spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_anchors_change_nothing(spark, block):
    rows = clustered(1, 700)
    assert found(spark, rows, block=block) == brute(rows)


def test_bounds_skip_pairs_but_lose_none(spark):
    rows = clustered(2, 2_000, centres=12)
    table = negatives.stored(spark.createDataFrame(rows, SCHEMA), 256.0)
    got, work = negatives.mine(table, F.col("id") % 100 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)
    done = {r["scan"]: (r.met, r.opened) for r in work.collect()}
    assert done["negatives"][0] > 2 * done["negatives"][1] > 0


def test_bounds_hold():
    draw = np.random.default_rng(7)
    x = draw.integers(-500, 500, (60, 24)) + draw.integers(-400, 400, (60, 1))
    side = negatives.Side(np.arange(60), np.zeros(60), x, negatives.summaries(x.astype(float)).astype(np.float32))
    exact = x @ x.T
    for least, most in [(-np.inf, np.inf), (exact.mean(), np.inf), (-np.inf, 0.0), (1e6, 2e6)]:
        alive = negatives.bounded(side, side, np.ones((60, 60), bool), np.full(60, least), np.full(60, most))
        assert alive[(exact >= least) & (exact <= most)].all()


def test_awkward_rows(spark):
    rows = clustered(3, 250, width=16)
    rows += [(300, None, 1), (400, [], 1), (500, [None] * 16, 1), (600, [float("nan")] * 16, 1), (700, [float("inf")] + [0.0] * 15, 1), (None, [1.0] * 16, 1), (800, [1.0] * 16, None)]
    rows += [(900, [0.5, 0.25], 1), (901, [0.5, 0.5], 1), (902, [0.5, 0.375], 2), (-100, [0.0] * 16, 1), (1000, [1.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_one_vector_held_by_most_rows(spark):
    same = [0.5, -0.5, 0.25, 1.0]
    rows = [(k, same, k % 3) for k in range(1_000)] + [(k, [1.0, 0.0, 0.0, 0.5], 1) for k in range(2_000, 2_050)]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_each_take_a_place(spark):
    rows = [(100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.7], 2), (2, [0.75, 0.7], 2)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_clashing_names(spark):
    rows = clustered(4, 210, width=8)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS id", "'b' AS x", "1 AS width", "2 AS anchor", "3 AS score")
    assert negatives.hard_negatives(df, F.col("id") % 100 == 0).count() == len(brute(rows))


def test_wide_numbers(spark):
    draw = np.random.default_rng(9).integers(-(2**27), 2**27, (220, 4))
    rows = [(k, [float(x) for x in v], k % 2) for k, v in enumerate(draw)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0, scale=2.0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows, scale=2)
    with pytest.raises(Exception, match="do not fit a long"):
        negatives.hard_negatives(df, F.col("id") % 100 == 0, scale=2.0**10).count()
