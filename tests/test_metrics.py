"""Metric jobs against small brute-force versions of their definitions."""

import hashlib
import math
import random
import re
import statistics
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claritas.functions.stem import stem
from claritas.operators import bootstrap, ngrams, pair_scores, readability, subsequence, suite

WORDS = "the cat sat on a mat and saw two dogs run far away . ! , it's 3.5".split()


def _pairs(n=40, seed=2):
    rnd = random.Random(seed)

    def text():
        return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 25)))

    rows = [(f"p{i}", "g" if i % 3 else "h", text(), text(), text()) for i in range(n)]
    rows += [("same", "g", "a b c d e", "the cat sat on a mat", "the cat sat on a mat"), ("empty", "h", "", "", "")]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, system string, src string, ref string, pred string")


def _grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def _ascii(text):
    return re.findall("[a-z0-9]+", text.lower())


def _f(hits, n_pred, n_ref):
    return 2 * hits / (n_pred + n_ref) if hits else 0.0


def _13a(text):
    text = f" {text.strip()} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def test_rouge_n(spark):
    rows = _pairs()
    got = {(r.pair_id, r.n): r.f for r in ngrams.rouge_pairs(_frame(spark, rows), ["system"], stems=False).collect()}
    assert len(got) == 2 * len(rows)
    for pid, _, _, ref, pred in rows:
        for n in (1, 2):
            p, r = _grams(_ascii(pred), n), _grams(_ascii(ref), n)
            want = _f(sum((p & r).values()), sum(p.values()), sum(r.values()))
            assert got[pid, n] == pytest.approx(want)


def test_rouge_with_stems_counts_word_forms_as_equal(spark):
    rows = [("x", "g", "", "running dogs", "runs dog"), ("y", "g", "", "the runner", "a running")]
    got = {(r.pair_id, r.n): r.hits for r in ngrams.rouge_pairs(_frame(spark, rows), ["system"], orders=(1,)).collect()}
    # "runs" has four letters and is stemmed, "dog" has three and stays
    assert got["x", 1] == 2 and got["y", 1] == 0


def test_bleu(spark):
    rows = _pairs()
    got = {r.system: r.bleu for r in ngrams.bleu(_frame(spark, rows), ["system"]).collect()}
    for system in ("g", "h"):
        correct, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
        for _, s, _, ref, pred in rows:
            if s == system:
                p, r = _13a(pred), _13a(ref)
                sys_len, ref_len = sys_len + len(p), ref_len + len(r)
                for n in range(4):
                    a, b = _grams(p, n + 1), _grams(r, n + 1)
                    correct[n] += sum((a & b).values())
                    total[n] += sum(a.values())
        smooth, logs = 1.0, 0.0
        for c, t in zip(correct, total):
            if c == 0:
                smooth *= 2
            logs += math.log(100 * c / t if c else 100 / (smooth * t))
        want = min(1.0, math.exp(1 - ref_len / sys_len)) * math.exp(logs / 4)
        assert got[system] == pytest.approx(want)


def test_bleu_edges(spark):
    rows = [("a", "same", "", "one two three four five", "one two three four five"), ("b", "short", "", "a b", "a b"), ("c", "none", "", "a b c d", "w x y z")]
    got = {r.system: r.bleu for r in ngrams.bleu(_frame(spark, rows), ["system"]).collect()}
    assert got["same"] == pytest.approx(100) and got["short"] == 0 and got["none"] == 0


def _sari(src, ref, pred):
    def ratio(a, b):
        return a / b if b else 1.0

    def f1(p, r):
        return 2 * p * r / (p + r) if p + r else 0.0

    keep = delete = add = 0.0
    for n in range(1, 5):
        s, r, c = (_grams(_13a(t.lower()), n) for t in (src, ref, pred))
        k, a = s & c, s & r
        good = k & r
        keep += f1(ratio(sum(good[g] / k[g] for g in k), len(k)), ratio(sum(good.values()), sum(a.values())))
        d = s - c
        delete += ratio(sum((d - r)[g] / d[g] for g in d), len(d))
        new, wanted = set(c) - set(s), set(r) - set(s)
        add += f1(ratio(len(new & set(r)), len(new)), ratio(len(new & set(r)), len(wanted)))
    return keep / 4, delete / 4, add / 4


def test_sari(spark):
    rows = _pairs()
    got = {r.pair_id: (r.keep, r.delete, r.add) for r in ngrams.sari_pairs(_frame(spark, rows), ["system"]).collect()}
    for pid, _, src, ref, pred in rows:
        assert got[pid] == pytest.approx(_sari(src, ref, pred))


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


def _walk(a, b):
    table, i, j, found = _lcs(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def test_subsequence_helpers_match_the_table():
    rnd = random.Random(1)
    for _ in range(400):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        assert subsequence.lcs_size(a, b) == _lcs(a, b)[-1][-1]
        assert subsequence.lcs_positions(a, b) == _walk(a, b)


@pytest.mark.parametrize("block", [1, 3, 5, 64])
def test_blocks_of_the_table_change_nothing(block):
    rnd = random.Random(block)
    for _ in range(150):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 20))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 20))]
        assert subsequence.lcs_size(a, b, block) == _lcs(a, b)[-1][-1]
        assert subsequence.lcs_positions(a, b, block=block) == _walk(a, b)


def test_long_lists_stay_small():
    rnd = random.Random(4)
    a, b = ([rnd.randrange(3_000) for _ in range(n)] for n in (30_000, 20_000))
    tracemalloc.start()
    found = subsequence.lcs_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == subsequence.lcs_size(a, b)
    # one integer of 30,000 bits per token of b would be 75 MB, and as much again for the places of 3,000 tokens
    assert peak < 30 << 20


def test_fold_equals_the_table(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(120):
        words = [f"t{i}" for i in range(rnd.choice([1, 4, 200]))]
        a, b = ([rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 61, 62, 63, 125, 190]))] for _ in "ab")
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: r.n for r in df.select("k", subsequence.folded_size(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: _lcs(a, b)[-1][-1] for k, a, b in rows}


def test_rouge_l_leaves_the_jvm_only_for_long_pairs(spark):
    rows = _pairs()
    df = _frame(spark, rows)
    plain = subsequence.rouge_l_pairs(df, ["system"], stems=False)
    mixed = subsequence.rouge_l_pairs(df, ["system"], stems=False, fold_limit=3)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(plain) and "Python" in plan(mixed)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, mixed.collect()))


def test_bootstrap_against_plain_python(spark):
    rnd = random.Random(5)
    rows = [(f"p{k}", rnd.choice("gh"), rnd.random() if k % 7 else None) for k in range(60)] + [("q", None, 0.5), ("r", "none", None)]
    df = spark.createDataFrame(rows, "pair_id string, system string, value double")
    got = {r.system: r for r in bootstrap.bootstrap(df, ["system"], ["pair_id"], replicates=40, seed=3).collect()}
    edges = [int(t, 16) for t in bootstrap.thresholds()]
    for group in {r[1] for r in rows}:
        mine = [(p, v) for p, g, v in rows if g == group and v is not None]
        means = []
        for k in range(40):
            digest = lambda p: hashlib.md5(f"3:{p}:{k // 8}".encode()).hexdigest()  # noqa: B023, E731
            weights = [sum(int(digest(p)[4 * (k % 8) : 4 * (k % 8) + 4], 16) >= e for e in edges) for p, _ in mine]
            if sum(weights):
                means.append(sum(w * v for w, (_, v) in zip(weights, mine)) / sum(weights))
        assert got[group].n == len(mine)
        if not mine:
            assert (got[group].mean, got[group].low, got[group].mid, got[group].high) == (None,) * 4
            continue
        assert got[group].mean == pytest.approx(statistics.fmean(v for _, v in mine))
        assert [got[group].low, got[group].mid, got[group].high] == pytest.approx(list(np.percentile(means, [2.5, 50, 97.5])))
    with pytest.raises(ValueError):
        bootstrap.bootstrap(df, ["system"], ["pair_id"], replicates=12)


def test_bootstrap_weights_are_poisson():
    edges = [int(t, 16) / 65_536 for t in bootstrap.thresholds()]
    assert edges[:3] == pytest.approx([math.exp(-1), 2 * math.exp(-1), 2.5 * math.exp(-1)], abs=1e-5)
    assert sum(1 - e for e in edges) == pytest.approx(1.0, abs=1e-3)


def test_mid_lies_near_the_mean_and_inside_the_interval(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(k, rnd.gauss(0.4, 0.1)) for k in range(2_000)], "pair_id int, value double")
    (r,) = bootstrap.bootstrap(df, [], ["pair_id"], replicates=400).collect()
    assert r.low < r.mean < r.high and abs(r.mid - r.mean) < 0.0005
    assert (r.high - r.low) == pytest.approx(2 * 1.96 * 0.1 / 2_000**0.5, rel=0.25)


def test_rouge_l(spark):
    rows = _pairs()
    got = {r.pair_id: r for r in subsequence.rouge_l_pairs(_frame(spark, rows), ["system"], stems=False).collect()}
    for pid, _, _, ref, pred in rows:
        a, b = _ascii(ref), _ascii(pred)
        assert got[pid].f == pytest.approx(_f(_lcs(a, b)[-1][-1], len(b), len(a)))


@pytest.mark.parametrize("stems", [False, True])
def test_rouge_lsum(spark, stems):
    rows = _pairs()
    got = {r.pair_id: r for r in subsequence.rouge_l_pairs(_frame(spark, rows), ["system"], stems, summary=True).collect()}
    for pid, _, _, ref, pred in rows:
        cut = [[_ascii(s) for s in re.split("[.!?]+", t) if re.search(r"\w", s)] for t in (ref, pred)]
        if stems:
            cut = [[[stem(t) if len(t) > 3 else t for t in s] for s in side] for side in cut]
        left, hits = [Counter(t for s in side for t in s) for side in cut], 0
        for sentence in cut[0]:
            for i in sorted(set().union(*[_walk(sentence, o) for o in cut[1]])):
                t = sentence[i]
                if left[0][t] > 0 and left[1][t] > 0:
                    left[0][t] -= 1
                    left[1][t] -= 1
                    hits += 1
        assert got[pid].hits == hits
        assert (got[pid].n_ref, got[pid].n_pred) == tuple(sum(map(len, side)) for side in cut)


def test_readability_by_hand(spark):
    df = _frame(spark, [("a", "g", "one two three four five six seven eight", "", "Le chat mange. Magnifiques souris !")])
    row = readability.row_scores(df).first()
    # 5 words, 2 sentences; vowel groups: le chat mange ma gni fi ques sou ris
    assert row.kmre == pytest.approx(207 - 1.015 * 2.5 - 73.6 * 10 / 5)
    assert row.lix == pytest.approx(2.5 + 100 * 1 / 5)
    assert row.compression_ratio == pytest.approx(100 - 5 / 8 * 100)
    empty = readability.row_scores(_frame(spark, [("b", "g", "", "", "")])).first()
    assert (empty.kmre, empty.lix, empty.compression_ratio, empty.novelty) == (None, None, None, 0.0)


def test_novelty(spark):
    rows = [("a", "g", "Le chat dort", "", "le CHÂT mange 12 souris"), ("b", "g", "x y", "", "x y"), ("c", "g", "x", "", "le la")]
    got = {r.pair_id: r.novelty for r in readability.row_scores(_frame(spark, rows)).collect()}
    assert got == {"a": pytest.approx(200 / 3), "b": 0.0, "c": 0.0}


def test_suite_properties(spark):
    rows = [(f"p{i}", "oracle", "some other source text here", t, t) for i, t in enumerate(["the cat sat on a mat. it ran", "two dogs run far away now"])]
    rows += [(f"p{i}", "copy", t, "a reference", t) for i, t in enumerate(["the cat sat", "two dogs"])]
    table = suite.suite(_frame(spark, rows), ["system"])
    got = {(r.system, r.metric): r.value for r in table.collect()}
    for name in ("rouge1", "rouge2", "rougeL", "rougeLsum", "bleu"):
        assert got["oracle", name] == 100.0
    assert got["copy", "novelty"] == 0.0 and got["copy", "compression_ratio"] == 0.0
    assert got["copy", "n_samples"] == 2
    assert {m for s, m in got if s == "copy"} == {m for s, m in got if s == "oracle"}


@pytest.mark.parametrize("stems", [False, True])
def test_suite_equals_the_single_metrics(spark, stems):
    df = _frame(spark, _pairs(60, 9))
    got = {(r.system, r.metric): r.value for r in suite.suite(df, ["system"], stems=stems, digits=9).collect()}
    singles = [
        ngrams.rouge(df, ["system"], stems=stems),
        subsequence.rouge_l(df, ["system"], stems=stems),
        subsequence.rouge_l(df, ["system"], stems=stems, summary=True),
        ngrams.bleu(df, ["system"]),
        ngrams.sari(df, ["system"]),
        readability.readability(df, ["system"]),
        df.groupBy("system").agg(F.count(F.lit(1)).alias("n_samples")),
    ]
    want = {(r.system, r.metric): r.value for job in singles for r in suite.long_form(job, ["system"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_suite_shuffles_the_texts_once(spark):
    df = _frame(spark, _pairs(20))
    plan = suite.suite(df, ["system"], stems=False, subsequences=("rougeL",))._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" in line]
    assert len(texts) == 1 and plan.count("Exchange") == 2 and "Python" not in plan


def test_srb_and_merge(spark):
    rows = [("g", "sari", 40.0), ("g", "rougeL", 30.0), ("g", "bertscore_f1", 60.0), ("h", "sari", 0.0), ("h", "rougeL", 1.0), ("h", "bertscore_f1", 1.0)]
    df = spark.createDataFrame(rows, "system string, metric string, value double")
    got = {(r.system, r.metric): r.value for r in suite.with_srb(df, ["system"]).collect()}
    assert got["g", "srb"] == pytest.approx(40.0) and got["h", "srb"] == 0.0 and len(got) == 8
    later = spark.createDataFrame([("g", "sari", 1.0)], "system string, metric string, value double")
    merged = {(r.system, r.metric): r.value for r in suite.merge(df, later, by=["system"]).collect()}
    assert merged["g", "sari"] == 1.0 and merged["g", "rougeL"] == 30.0


@pytest.mark.parametrize(
    "word, want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("electrical", "electr"),
        ("replacement", "replac"), ("adoption", "adopt"), ("controll", "control"), ("generalizations", "gener"), ("dying", "die"), ("news", "news"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("again", [False, True])
def test_gram_classes_count_every_gram(spark, again):
    rnd = random.Random(5)
    rows = [tuple([i] + [[rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))] for _ in range(3)]) for i in range(60)]
    rows += [(100, None, ["a"], ["a", "a"]), (101, list("abc"), list("bcd"), list("cde"))]
    df = spark.createDataFrame(rows, "i int, src array<string>, pred array<string>, ref array<string>")
    lists = {s: F.col(s) for s in ("src", "pred", "ref")}
    got = {r.i: r.c for r in df.select("i", ngrams.gram_classes(lists, F.lit(again)).alias("c")).collect()}
    for i, *texts in rows:
        counts = [Counter(t or []) for t in texts]
        once = [g for g in set().union(*counts) if max(c[g] for c in counts) == 1 and not again]
        classes = Counter(sum(bit for bit, c in zip((1, 2, 4), counts) if c[g]) for g in once)
        assert {r.sides: r.times for r in got[i] if r.times} == classes
        for bit, c in zip((1, 2, 4), counts):
            listed = Counter(g for r in got[i] if r.sides == bit and not r.times for g in r.list)
            assert listed == Counter({g: n for g, n in c.items() if g not in once})


def test_suite_adds_up_rows_of_one_pair(spark):
    parts = [("p", "g", "the cat", "a dog sat", "the dog"), ("p", "g", "the dog sat", "a cat", "a dog a"), ("q", "g", "x", "y", "x")]
    got = {(r.pair_id, r.tag, r.n): (r.hits, r.n_pred, r.n_ref) for r in pair_scores.pair_sums(_frame(spark, parts), ["system"], False, [], ()).collect()}
    assert got["p", "rouge", 1] == (3, 5, 5) and got["p", "bleu", 2] == (1, 3, 3) and got["q", "bleu", 1] == (0, 1, 1)


def test_text_decides_the_number_of_partitions(spark, monkeypatch):
    df = _frame(spark, _pairs())
    assert ngrams.text_width(df, ("src", "ref", "pred")) == 8
    monkeypatch.setattr(ngrams, "TEXT_BYTES", 100)
    assert ngrams.text_width(df, ("src", "ref", "pred")) > 20
