import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from claritas.llm import quality as Q
from claritas.llm import words as W
from tests.llm.helpers import blank, docs_of, prose


def corpus(n=240):
    rows, labels = [], []
    for k in range(n):
        text = prose(k, 40 + k % 60, 300)
        good = k % 5 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split()) if k % 2 else " ".join([text.split()[0]] * 40)
        rows.append((k, text))
        labels.append((k, int(good)))
    return rows, labels


def plain_indicators(text):
    w = blank(text)
    out = {("g", x) for x in w} | {("g", *p) for p in zip(w, w[1:])}
    for k in Q.RUNS:
        if any(len(set(w[i : i + k])) == 1 for i in range(len(w) - k + 1)):
            out.add(("run", k))
    return out


def test_indicators_are_distinct_grams_and_runs():
    texts = ["a a b", None, "x", "z z z z z z z z", "q " * 3, prose(3, 50)]
    words = next(W.word_slices(pa.array(texts), W.BLANK))
    doc, feature = Q.indicators(words)
    counts = np.bincount(doc, minlength=len(texts))
    assert counts.tolist() == [len(plain_indicators(t)) for t in texts]
    assert sorted(set(zip(doc.tolist(), feature.tolist()))) == list(zip(doc.tolist(), feature.tolist()))


def test_dual_descent_reaches_the_optimum():
    r = random.Random(2)
    rows = [np.array(sorted(r.sample(range(40), 6))) for _ in range(80)]
    y = np.array([int(x[0] < 4) for x in rows])
    ratio, cost = np.linspace(-1, 2, 40), np.ones(80)
    weight, bias = Q.dual_descent(rows, y, ratio, cost, epochs=400)
    x = np.zeros((80, 41))
    for i, v in enumerate(rows):
        x[i, v] = ratio[v] / np.linalg.norm(ratio[v])
    x[:, 40] = 1
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()

    best = np.append(weight, bias)
    noise = np.random.default_rng(0)
    assert all(loss(best) <= loss(best + 0.02 * noise.standard_normal(41)) + 1e-6 for _ in range(300))


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = docs_of(spark, rows, extra="score y")
    table = spark.createDataFrame([*labels, (3, 1), (3, None), (None, 0), (99999, 1)], "doc_id bigint, quality int")
    model = Q.fit_quality(docs, table)
    got = Q.score(docs, model, ["doc_id", "lang"], name="p").collect()
    held = {r["doc_id"]: r["p"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert len(got) == len(rows) and all(0 <= r["p"] <= 1 for r in got)
    right = [(p >= 0.7) == (dict(labels)[i] == 1) for i, p in held.items()]
    assert sum(right) / len(right) > 0.95
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", Q.held_out(docs["doc_id"]).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and 150 < kept.count() < 230
    again = Q.score(docs, Q.fit_quality(docs.repartition(7), table), ["doc_id"]).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: pytest.approx(r["p"]) for r in got}


def test_few_labels_and_awkward_texts(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, " \n"), (3, "x" * 70_000), (None, "a b"), (4, "word " * 30_000)])
    for labels in ([], [(1, 1)], [(1, 1), (4, 0), (3, 1)]):
        model = Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        scores = [r["score"] for r in Q.score(docs, model).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert Q.score(docs_of(spark, []), model).collect() == []
    with pytest.raises(ValueError):
        Q.score(docs, model, ["text"], name="text")


@pytest.mark.parametrize("least", [1, 4])
def test_fit_and_score_against_plain_python(spark, least):
    rows, labels = corpus()
    rows += [(1000, "rare words ### here"), (1001, ""), (1002, None)]
    labels += [(1000, 0), (1001, 0), (1002, 1)]
    docs, y = docs_of(spark, rows), dict(labels)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = Q.fit(Q.labelled(docs, table), least=least)

    def features(text):
        return Q.indicators(next(W.word_slices(pa.array([text], pa.string()), W.BLANK)))[1]

    counts = np.zeros((2, Q.SIZE))
    for i, text in rows:
        counts[y[i], features(text)] += 1
    smooth = counts + 1
    ratio = np.log((smooth[1] / smooth[1].sum()) / (smooth[0] / smooth[0].sum()))
    ratio[counts.sum(0) < least] = 0
    assert np.allclose(model.ratio, ratio)
    # the whole sample is drawn here, so the optimum of the hinge loss is known up to the descent's tolerance
    order = sorted((y[i], features(t).astype(np.uint32).tobytes()) for i, t in rows)
    vectors, sign = [np.frombuffer(b, np.int32) for _, b in order], np.array([k for k, _ in order])
    share = np.minimum(1.0, Q.SAMPLE / np.bincount(sign))
    weight, bias, slope, offset = Q.fit_sample(vectors, sign, ratio, share, 1.0)
    assert np.allclose(model.weight, weight) and (model.bias, model.slope, model.offset) == pytest.approx((bias, slope, offset))
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model, ["doc_id"]).collect()}
    for i, text in rows:
        at = features(text)
        norm = max(np.linalg.norm(ratio[at]), 1e-9)
        z = slope * (sum(ratio[k] * weight[k] for k in at) / norm + bias) + offset
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_labels_beyond_the_shipped_size_are_shuffled(spark, monkeypatch):
    rows, labels = corpus(60)
    docs, table = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    before = sorted(map(tuple, Q.labelled(docs, table).collect()))
    monkeypatch.setattr(Q, "SHIPPED_BYTES", 0)
    assert sorted(map(tuple, Q.labelled(docs, table).collect())) == before
