import hashlib
from collections import Counter

import numpy as np

from claritas.llm import fingerprints as P
from tests.llm.helpers import blank, docs_of, prose


def bag(text):
    w = blank(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def generalised(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


ROWS = [(5 * k, prose(k, 3 + 29 * k % 170, 2000)) for k in range(80)]
ROWS += [(1, None), (2, ""), (3, " "), (4, "é𝄞 x"), (6, "one"), (7, "rep " * 400), (8, "rep " * 300), (-9, prose(3, 90)), (400, prose(3, 90)), (10**15, "last"), (12, "z" * 50_000)]


def test_rows_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 900)
    ordered = sorted(ROWS)
    got = {r["doc_id"]: r for r in P.compare_next(docs_of(spark, ROWS, extra="part ahead").repartition(7)).collect()}
    assert len(got) == len(ROWS)
    same, error = {}, []
    for k, (i, t) in enumerate(ordered):
        r, t, nxt = got[i], t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + nxt[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        error.append(r["near_edited"] - generalised(t, new))
        assert abs(r["near_next"] - generalised(t, nxt)) < 0.25
    assert abs(np.mean(error)) < 0.04 and np.std(error) < 0.09


def test_collision_rate_is_generalised_jaccard():
    sampler = P.Sampler(1024)
    base = "a b c d e f g h i j k l m n o p q r s t"
    for other in (base + " " + base, base + " x y z", " ".join(base.split()[:12]) + " 1 2 3 4 5 6", base + " a b c d e" * 6):
        a, b = sampler.prints([base, other])
        assert abs(P.likeness(a, b) - generalised(base, other)) < 0.06


def test_nulls_repeated_ids_and_small_tables(spark):
    assert P.compare_next(docs_of(spark, [])).collect() == []
    one = P.compare_next(docs_of(spark, [(1, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = [(None, "x y"), (None, "a"), (1, "b"), (1, "b"), (1, None), (2, "")]
    got = P.compare_next(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got) == [0, 0, 1, 1, 1, 3]
    assert P.fingerprint(docs_of(spark, rows), ["doc_id", "text"]).where("text = 'b'").select("fingerprint").distinct().count() == 1
