import hashlib

import pytest

from claritas.llm import decontamination as D
from tests.llm.helpers import alnum, docs_of, prose


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = alnum(text), set(), set()
        for item, t in items:
            w = alnum(t)
            if item is None or not w:
                continue
            size = min(n, len(w))
            grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, prose(7, 25)), (10, prose(8, 10)), (2, "Short item, here"), (3, ""), (4, None), (None, prose(9, 30)), (2, prose(11, 12)), (5, "été")]
ROWS = [
    (1, prose(1, 40) + " " + "".join(c.upper() if c.isascii() else c for c in prose(7, 25)) + "! " + prose(2, 10)),
    (2, "a short ITEM here; short item here"),
    (3, None),
    (4, ""),
    (5, prose(9, 30)),
    (6, " ".join(prose(7, 25).split()[3:12])),
    (7, prose(3, 6000) + " " + prose(8, 10) + " " + prose(4, 6000)),
    (7, "été, là"),
    (8, prose(11, 12)),
    (8, prose(11, 12)),
    (None, "short item here"),
]


def found(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.report(D.matches(docs_of(spark, rows), bench, ["doc_id"]))
    return sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()], key=str)


def test_matches_brute_force(spark):
    assert found(spark, ROWS, ITEMS) == brute(ROWS, ITEMS)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, ROWS, []) == brute(ROWS, [])


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [r for k, r in enumerate(ROWS) if r[0] is not None and r[0] not in [x[0] for x in ROWS[:k]]]
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 7)
    assert found(spark, rows, ITEMS) == brute(rows, ITEMS)


@pytest.mark.parametrize("block", [250_000, 9])
def test_removal(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    docs, bench = docs_of(spark, ROWS, extra="item_id spans"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    dirty = {str(r[:1]) + str(r[5]) for r in brute(ROWS, ITEMS)}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    clean = [(i, t) for (i, t) in ROWS if not brute([(i, t)], ITEMS)[0][5]]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(clean, key=str) and dirty
    cut = D.decontaminate(docs, bench, remove="spans").collect()
    assert len(cut) == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in cut if r["doc_id"] in (1, 2, 5)}
    assert texts[5] == prose(9, 30) and texts[2].split() == ["a"]
    assert texts[1] == prose(1, 40) + " ! " + prose(2, 10)


@pytest.mark.parametrize("block", [250_000, 7, 2])
def test_repeated_ids_keep_their_rows_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    items = [(1, prose(7, 12)), (2, "Short item, here"), (3, "été là"), (4, "other short item")]
    rows = [(7, prose(7, 12)), (7, prose(8, 12)), (8, "short item here"), (8, "short item here"), (9, "été là x"), (9, "nothing in here"), (None, "short item here"), (None, None), (None, "other short item"), (None, "a short item")]
    assert found(spark, rows, items) == brute(rows, items)
