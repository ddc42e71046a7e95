import math
import random
from itertools import combinations

import numpy as np
import pytest

from claritas.llm import jaccard as J
from claritas.llm.components import components
from tests.llm.helpers import blank, docs_of, prose


def sets_of(text, n):
    w = blank(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    s = [(i, sets_of(t, n)) for i, t in rows]
    up = {i: i for i, _ in s if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations([r for r in s if r[0] is not None and r[1]], 2):
        if den * len(x & y) >= num * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return sorted([(i, len(x), None if i is None else root(i)) for i, x in s], key=str)


def edited(text, k, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def rows_of():
    r = random.Random(5)
    rows, passage = [], prose(99, 60)
    for f in range(12):
        text = prose(1000 + f, r.choice([5, 9, 30, 80, 200, 700]), 5000)
        for c in range(r.randrange(1, 9)):
            rows.append(edited(text, r.randrange(0, 1 + len(text.split()) // 25), 31 * f + c))
    rows += [prose(k, 90, 5000) + " " + passage for k in range(40)]  # one common passage, unrelated texts
    rows += [edited(prose(4242, 150, 5000), 4, k) for k in range(60)]  # a large family of near copies
    rows += [None, "", " \n", "one", "ONE", "one two", "one two three", "a b c d", "a b c d e", prose(1, 9000, 9), prose(1, 9000, 9)]
    r.shuffle(rows)
    return [*[(k * 3, t) for k, t in enumerate(rows)], (None, prose(4242, 150, 5000)), (7, "one two"), (7, "quite another text"), (8, "quite another text")]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_components_match_brute_force(spark, n, num, den):
    rows = rows_of()
    got = J.similar(docs_of(spark, rows, extra="n code root"), n, num, den).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(rows, n, num, den)


def test_blocks_and_flushes_give_the_same(spark, monkeypatch):
    for name, value in (("BLOCK_SHINGLES", 900), ("FLUSH", 300), ("BUCKET_ENTRIES", 50), ("FREQUENT_IN_TASK", 3), ("FREQUENT", 3), ("SMALL_GROUP", 2), ("MEET", 3)):
        monkeypatch.setattr(J, name, value)
    rows = rows_of()
    got = J.similar(docs_of(spark, rows).repartition(6), 4, 85, 100).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(rows, 4, 85, 100)


def test_linked_sets_share_a_range_code_whatever_is_frequent():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(7, 500))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(3))
        drop = int(r.integers(0, math.floor(0.15 / 1.85 * 2 * len(x)) + 1))
        a = int(r.integers(0, drop + 1))
        y = np.unique(np.concatenate([r.permutation(x)[a:], r.integers(0, 1 << 62, drop - a).astype(np.uint64)]))
        common = np.sort(r.permutation(np.concatenate([x, y]))[: int(r.integers(0, 2 * n))])
        inter = len(np.intersect1d(x, y))
        if 100 * inter < 85 * (len(x) + len(y) - inter) or inter == len(x) == len(y):
            continue
        levels = J.Levels(85, 100, max(len(x), len(y)))
        codes = [set(J.range_codes(s, np.array([0, len(s)]), common, levels)[1].tolist()) for s in (x, y)]
        meet = min(int(levels.meet[level]) for level, _ in levels.of(np.array([min(len(x), len(y)), max(len(x), len(y))])))
        assert len(codes[0] & codes[1]) >= meet


def test_keep_one(spark):
    rows = rows_of()
    docs = docs_of(spark, rows, extra="place doc component_id")
    kept = J.keep_one(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    ids = sorted([r["doc_id"] for r in kept.collect()], key=str)
    assert ids == sorted({i for i, _, c in brute(rows, 4, 85, 100) if i == c} | {None}, key=str)
    assert J.keep_one(docs_of(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    pairs = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000), (7, 7), (500, 501), (501, 500)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
