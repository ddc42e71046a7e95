import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claritas.llm import suffix_merge as S
from tests.llm.helpers import docs_of, prose


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(length):
    r = random.Random(11)
    passage = [prose(900 + k, 400, 4000)[: length + d] for k, d in enumerate((0, -1, 1, 37, 5 * length))]
    rows = [prose(k, r.randrange(1, 500), 4000) for k in range(30)]
    rows += [prose(100 + k, r.randrange(20, 90), 4000) + r.choice(passage) + prose(300 + k, 40, 4000) for k in range(40)]
    base = prose(77, 700, 4000)
    for k in range(12):  # near copies: one edit each
        at = r.randrange(len(base))
        rows.append(base[:at] + r.choice(["X", "é𝄞", ""]) + base[at + r.randrange(3) :])
    rows += ["ab" * 900, "ab" * 300, "z" * (length + 1), "é" * length, "\x00" * (2 * length) + "q", base, base, None, "", "short", passage[0] + "\x00" + passage[3]]
    return [(k, t) for k, t in enumerate(rows)] + [(None, passage[2]), (3, rows[3])]


def result(spark, rows, length, **more):
    got = S.dedup(docs_of(spark, rows, extra="n_bytes result"), ["doc_id"], length, **more).collect()
    return sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got], key=str)


@pytest.mark.parametrize("length", [400, 64])
def test_matches_brute_force(spark, length):
    rows = rows_of(length)
    assert result(spark, rows, length) == brute(rows, length)


def test_heavy_keys_small_pieces_and_flushes(spark, monkeypatch):
    for name, value in (("PIECE", 900), ("FLUSH_KEYS", 40), ("FLUSH_BYTES", 5000), ("BATCH_SPANS", 5)):
        monkeypatch.setattr(S, name, value)
    rows = rows_of(120)
    assert result(spark, rows, 120, heavy=3) == brute(rows, 120)


def test_empty_table_and_texts_that_are_left(spark):
    assert result(spark, [], 400) == []
    assert result(spark, [(1, None)], 400) == brute([(1, None)], 400)
    text = prose(5, 200)
    out = S.dedup(docs_of(spark, [(1, "A " + text), (2, "B " + text), (3, "C")]), ["doc_id"], digest=False).collect()
    assert {r["doc_id"]: r["kept_text"] for r in out} == {1: "A", 2: "B", 3: "C"}


def test_anchor_windows_cover_every_start_once():
    raw = np.frombuffer((prose(3, 900) + "ab" * 700).encode(), np.uint8)
    spot = S.Spot(raw, np.array([0, 500, len(raw)]), 400)
    starts = np.concatenate([np.arange(f, e + 1) for f, e in zip(spot.first, spot.last)])
    assert starts.tolist() == [*range(0, 101), *range(500, len(raw) - 399)]
    assert ((spot.at >= spot.last) & (spot.at + S.GRAM <= spot.first + 400)).all()
    assert [p[1] for p in S.pieces(pa.array(["x" * (3 * S.PIECE)]), 400)] == [0, S.PIECE, 2 * S.PIECE]


def test_no_task_gathers_more_spans_of_a_key_than_the_bound(spark, monkeypatch):
    refine, bound = S.refine, 6

    def watched(head, body, length):
        most = np.unique(head["key"], return_counts=True)[1].max()
        if most > bound:
            raise ValueError(f"{most} spans of one key meet")
        return refine(head, body, length)

    monkeypatch.setattr(S, "refine", watched)
    passage = prose(900, 80, 4000)[:140]
    rows = [(k, f"{prose(100 + k, 30, 4000)} {k:03d}{passage}{(k * 7) % 60:03d} {prose(300 + k, 30, 4000)}") for k in range(60)]
    assert result(spark, rows, 120, heavy=bound) == brute(rows, 120)
