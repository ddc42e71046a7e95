import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claritas.llm import mixing
from tests.llm.helpers import blank, docs_of, prose

SHARES = (3, 1, 2)


def targets(sizes, ratio=1.5, cap=2.0):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: SHARES[k % 3] for k, s in enumerate(names)}
    total, out, free = ratio * sum(sizes.values()), {}, set(names)
    while free:
        rest, weight = total - sum(out.values()), sum(share[s] for s in free)
        over = [s for s in free if rest * share[s] / weight > cap * sizes[s]]
        if not over:
            out.update({s: rest * share[s] / weight for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
    return out


ROWS = [(k, prose(k, 5 + 37 * k % 211), f"s{k % 7 if k % 3 else 0}") for k in range(120)]
ROWS += [(500, None, "s1"), (501, "", "s2"), (502, "\t \x0b", None), (503, prose(9, 50), None), (504, "x", "zero"), (504, "x", "zero"), (None, prose(3, 9), "é"), (505, "", "empty"), (506, prose(77, 30_000), "big")]


def taken(spark, rows, **more):
    return mixing.mix(docs_of(spark, rows), ["doc_id", "source", "text"], **more).collect()


def test_targets_and_budgets(spark):
    got = taken(spark, ROWS)
    assert len(got) == len(ROWS)
    sizes, sums = Counter(), Counter()
    for i, t, s in ROWS:
        sizes[s] += len(blank(t))
    want = targets(sizes)
    for r in got:
        assert r["size"] == len(blank(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(sums[s] - want[s]) <= 0.5
    # complete epochs come before the fraction: every document has its epochs in full, one at most is cut
    for s in sizes:
        epochs = round(want[s]) // sizes[s] if sizes[s] else 0
        part = [r["taken"] - epochs * r["size"] for r in got if r["source"] == s]
        assert all(0 <= p for p in part) and sum(0 < p < r["size"] for p, r in zip(part, [r for r in got if r["source"] == s])) <= 1


def test_reruns_and_layout_agree(spark):
    first = sorted([(str(r["doc_id"]), str(r["text"]), r["taken"]) for r in taken(spark, ROWS)])
    again = mixing.mix(docs_of(spark, ROWS[::-1]).repartition(5), ["doc_id", "source", "text"]).collect()
    assert first == sorted((str(r["doc_id"]), str(r["text"]), r["taken"]) for r in again)


def test_weight_orders_the_choice(spark):
    rows = [(k, "a b c d", "only") for k in range(4000)]
    docs = docs_of(spark, rows).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = mixing.mix(docs, ["doc_id"], weight=F.col("w"), ratio=0.3).where("taken > 0").collect()
    even = sum(r["doc_id"] % 2 == 0 for r in got)
    assert len(got) == 1200 and 3 < even / (len(got) - even) < 5


def test_choice_is_a_prefix_of_the_sorted_keys(spark):
    docs = docs_of(spark, ROWS)
    keyed = mixing._keyed(docs, mixing.text_quality(F.col("text")), ["doc_id"]).collect()
    got = Counter()
    for r in taken(spark, ROWS):
        got[r["source"], r["doc_id"], r["size"]] += r["taken"]
    sizes = Counter()
    for r in keyed:
        sizes[r["_source"]] += r["size"]
    want = Counter()
    for s, target in targets(sizes).items():
        mine = sorted((r for r in keyed if r["_source"] == s), key=lambda r: (r["_v"], r["_id"] is None, r["_id"] or 0, r["_tie"]))
        budget = int(target + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for r in mine:
            part = min(r["size"], rest)
            rest -= part
            want[s, r["_id"], r["size"]] += epochs * r["size"] + part
    assert got == want


@pytest.mark.parametrize("weight", [0.05, 0.001, 1.0, 1000.0])
def test_keys_do_not_collapse_and_buckets_stay_small(spark, weight):
    docs = docs_of(spark, [(k, "a b", "hot") for k in range(20_000)])
    keys = [r["_v"] for r in mixing._keyed(docs, F.lit(weight), ["doc_id"]).select("_v").collect()]
    assert len(set(keys)) == len(keys) and all(0 < v < math.inf for v in keys)
    mean = sum(keys) / len(keys)
    assert mean == pytest.approx(1 / weight, rel=0.05)  # exponential with that rate
    cuts = math.ceil(20_000 / (math.e * 625))  # as for eight shuffle partitions
    fullest = max(Counter(math.floor(math.log(v) * cuts) for v in keys).values())
    assert fullest < 1.3 * 625


def test_empty_and_clashing_names(spark):
    assert mixing.mix(docs_of(spark, []), ["doc_id"]).collect() == []
    docs = docs_of(spark, ROWS[:9], extra="size taken _kept _source")
    out = mixing.mix(docs, docs.columns)
    assert len(out.collect()) == 9 and dict(out.dtypes)["taken"] == "bigint" and "_source" in out.columns
