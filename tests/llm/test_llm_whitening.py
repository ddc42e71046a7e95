"""Whitening: exact sums, eigenpairs against a plain solver, awkward rows."""

import math

import numpy as np
import pytest

from claritas.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, scale, shift, k):
    x = np.array([[math.floor(scale * c) + shift for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s)
    cov = np.array((centred.T @ centred).tolist(), float) / n**3
    values, found = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return n, (centred**2).sum(1), values[order], found[:, order], (centred.astype(float) / n), np.trace(cov)


def check(rows, vectors, scale=1024.0, shift=100_000, k=8):
    """rows: (vec_id, component) -> row; vectors: vec_id -> list of doubles."""
    ids = sorted(vectors)
    n, deviation, values, found, centred, trace = brute([vectors[i] for i in ids], scale, shift, k)
    for at, i in enumerate(ids):
        for c in range(len(values)):
            r = rows[i, c + 1]
            assert r.n == n and int(r.deviation) == deviation[at]
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(centred[at] @ found[:, c]) / values[c] ** 0.5, rel=1e-6, abs=1e-6)
            assert r.identity_error < 1e-9
    white = np.array([[rows[i, c + 1].whitened for c in range(len(values))] for i in ids])
    assert np.abs(white.T @ white / n - np.eye(len(values))).max() < 1e-6
    assert len(rows) == len(ids) * len(values)


def whitened(spark, rows, k=8, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(df, components=k, **how)
    return [r for r in whitening.whiten(df, model, ["vec_id"]).collect()]


def test_given_table_matches_plain_solver(spark):
    from claritas.llm.queries import QUERIES

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").collect()}
    check(rows, {r.vec_id: list(r.embedding) for r in df.collect()})


def test_awkward_rows(spark):
    draw = np.random.default_rng(3).standard_normal((40, 12)).astype(np.float32) * 3
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(draw)]
    bad = [(100, None, 1), (101, [], 1), (102, [None] * 12, 1), (103, [float("nan")] + [1.0] * 11, 1), (104, [float("inf")] * 12, 1), (105, [1.0, 2.0], 1), (106, [1.0] * 11 + [None], 1)]
    got = whitened(spark, rows + bad, scale=1024.0, shift=100_000)
    check({(r.vec_id, r.component): r for r in got}, {r[0]: r[1] for r in rows})


def test_repeated_rows_null_ids_and_few_dimensions(spark):
    rows = [(1, [1.0, 0.0, 2.0], 1), (1, [1.0, 0.0, 2.0], 1), (None, [0.0, 5.0, 1.0], None), (4, [3.0, 3.0, 3.5], 2), (5, [-1.0, 3.0, 0.5], 2)]
    got = whitened(spark, rows, scale=4.0)
    assert len(got) == 15 and sum(r.vec_id is None for r in got) == 3 and {r.n for r in got} == {5}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(spark, rows) == []


def test_rank_one_has_one_component(spark):
    got = whitened(spark, [(k, [float(k), 2.0 * k, -float(k)], 0) for k in range(9)])
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_wide_integers_stay_exact(spark):
    draw = np.random.default_rng(5).integers(-(2**40), 2**40, (30, 4))
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(draw)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    model = whitening.fit(df, components=4, scale=8.0)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df, model, ["vec_id"]).collect()}
    check(got, {r[0]: r[1] for r in rows}, 8.0, 0, 4)


def test_too_large_for_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.fit(spark.createDataFrame([(1, [1e30], 0)], SCHEMA), scale=1024.0)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 2.5], 0), (3, [0.0, 2.25], 0)], SCHEMA).selectExpr("*", "'x' AS component", "1 AS n", "2 AS v", "3 AS _vector")
    model = whitening.fit(df, scale=16.0)
    assert whitening.whiten(df, model, ["vec_id"]).count() == 6
    with pytest.raises(ValueError):
        whitening.whiten(df, model, ["vec_id", "component"])


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 0], [1, 1, 1, 1, 1], [1e6, 1, 1e-3, 0, 0], [2, 2 - 1e-13, 1, 1, -1], [0, 0, 0, 0, 0], [-1, -2, -3, -4, -5]])
def test_counts_and_eigenpairs(values):
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((5, 5)))[0]
    a = turn @ np.diag(np.array(values, float)) @ turn.T
    a = (a + a.T) / 2
    size = np.abs(a).max() + 1e-300
    got, found = whitening.leading(a, 5)
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-12 * size * 10)
    assert np.abs(found.T @ found - np.eye(5)).max() < 1e-12
    assert np.abs(a @ found - found * got).max() < 1e-11 * size * 10
    for shift in [-2.5, -0.5, 0.5, 1.5, 2.5, 1e5]:
        assert whitening.above(a, shift) == sum(v > shift for v in values)


def test_counts_of_matrices_without_a_diagonal():
    a = np.array([[0.0, 1, 2], [1, 0, 3], [2, 3, 0]])
    assert whitening.above(a, 0.0) == int((np.linalg.eigvalsh(a) > 0).sum())
    wide = np.random.default_rng(1).standard_normal((60, 60))
    wide = wide + wide.T
    assert [whitening.above(wide, s) for s in (-5.0, 0.0, 5.0)] == [int((np.linalg.eigvalsh(wide) > s).sum()) for s in (-5.0, 0.0, 5.0)]


@pytest.mark.parametrize("seed", range(12))
def test_eigenpairs_of_deficient_and_repeated_data(seed):
    rng = np.random.default_rng(seed)
    d, m = int(rng.integers(3, 40)), int(rng.integers(2, 90))
    x = rng.standard_normal((m, d)) * 1000
    x[:, : d // 2] = x[:, d // 2 : d // 2 * 2]  # eigenvalues of zero next to the leading ones
    x = np.repeat(x[: max(2, m // 10)], 10, 0) if seed % 3 == 0 else x
    c = x - x.mean(0)
    a = c.T @ c / len(c)
    k, size = min(8, d), np.abs(a).sum(1).max()
    got, found = whitening.leading(a, k)
    assert np.abs(got - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() < 1e-11 * size
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-10 and np.abs(a @ found - found * got).max() < 1e-11 * size
