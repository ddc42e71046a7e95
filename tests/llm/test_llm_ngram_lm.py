import math
from collections import Counter

import pytest

from claritas.llm import ngram_lm as M
from tests.llm.helpers import blank, docs_of, prose


def discounts(n):
    if not n[1] or not n[2]:
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [min(max(x, 0.05 if k else 0), k) for k, x in enumerate(d)]


class Plain:
    def __init__(self, texts):
        self.c, self.b, self.starts = Counter(), Counter(), len(texts)
        for t in texts:
            w = [*blank(t), None]
            self.c.update(w)
            self.b.update(zip(["", *w], w))
        self.k = Counter(w for _, w in self.b)
        self.n, self.v, self.total = sum(self.c.values()), len(self.c), sum(self.k.values())
        self.d, self.low = discounts(Counter(self.b.values())), discounts(Counter(self.k.values()))
        self.mass = Counter()
        for (u, _), c in self.b.items():
            self.mass[u] += self.d[min(c, 3)]
        freed = sum(self.low[min(c, 3)] for c in self.k.values())
        self.floor = (freed / self.total if self.total else 1) / (self.v + 1)

    def p(self, u, w):
        k, seen = self.k[w], self.starts if u == "" else self.c[u]
        q = (max(k - self.low[min(k, 3)], 0) / self.total if self.total else 0) + self.floor
        c = self.b[u, w]
        return max(c - self.d[min(c, 3)], 0) / seen + self.mass[u] / seen * q if seen else q

    def score(self, text):
        w = [*blank(text), None]
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), pytest.approx(base), pytest.approx(sum(math.log10(self.p(u, x)) for u, x in zip(["", *w], w)))


TEST = [(1, "the w1 of"), (2, None), (3, ""), (4, prose(5, 300)), (5, "never seen words"), (5, "The THE the the"), (None, prose(2, 20000, 50)), (6, "\x0b x")]


@pytest.mark.parametrize("size", [0, 1, 60])
def test_scores_match_plain_model(spark, monkeypatch, size):
    if size == 60:
        monkeypatch.setattr(M, "FLUSH", 500)
        monkeypatch.setattr(M, "FREQUENT_CONTEXTS", 4)
    train = [(k, prose(k, 20 + k, 90) + (" the of the" if k % 3 else "")) for k in range(size)] + ([(900, None), (901, "")] if size else [])
    plain = Plain([t for _, t in train])
    model = M.fit(docs_of(spark, train))
    assert (model.total, len(model.vocabulary)) == (plain.n, plain.v)
    got = M.score(docs_of(spark, TEST, extra="score n_tokens"), model, ["doc_id", "text"]).collect()
    assert len(got) == len(TEST)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == plain.score(r["text"])


def test_probabilities_of_a_context_sum_to_one(spark):
    plain = Plain([prose(k, 50, 40) for k in range(30)])
    for u in ["", *list(plain.c)[:5], "unknown"]:
        assert sum(plain.p(u, w) for w in plain.c) + plain.p(u, "unseen") == pytest.approx(1)
    model = M.fit(docs_of(spark, [(k, prose(k, 50, 40)) for k in range(30)]))
    assert model.floor == pytest.approx(plain.floor) and model.discount.tolist() == pytest.approx(plain.d)


def test_files_need_a_mounted_folder():
    with pytest.raises(ValueError):
        M.local_folder("hdfs://name/folder")
    assert M.local_folder("file:///tmp/a%20b") == "/tmp/a b"
