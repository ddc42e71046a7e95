import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from claritas.functions import fixed
from claritas.operators import human, reshape, trials


def _long(spark, rows):
    return spark.createDataFrame(rows, "sample_id int, annotator_id string, criterion string, answer string")


def test_recode_and_rate(spark):
    rows = [
        (1, "a", "CI3", "Oui"), (1, "a", "CI4", "Non"), (1, "a", "CPM1", "Partiellement"),
        (1, "a", "I1", "Non Applicable"), (1, "a", "CA1", "Très bon"), (1, "a", "CA5", "Oui"), (1, "a", "CI5", None),
    ]
    scored = human.recode(_long(spark, rows))
    assert {r.criterion: r.score for r in scored.collect()} == {
        "CI3": 1, "CI4": 0, "CPM1": 1, "I1": None, "CA1": None, "CA5": None, "CI5": None,
    }
    assert human.fulfilment(scored, ["sample_id"]).first().rate == pytest.approx(2 / 3)
    total = human.weighted_score(human.with_criteria(scored), ["sample_id"]).first().total
    assert total == pytest.approx((2 + 6) / (2 + 6 + 6))


def test_criteria_lookup_keeps_unknown_codes(spark):
    got = {r.criterion: (r.criteria_theme, r.criteria_type, r.weight) for r in human.with_criteria(_long(spark, [(1, "a", "CPM2", "Oui"), (1, "a", "ZZ", "Oui"), (1, "a", "CA1", "Bon")])).collect()}
    assert got == {"CPM2": ("Choix des mots", "ETR", 6), "ZZ": ("ZZ", "ZZ", None), "CA1": ("Qualité globales", "global quality", None)}


def test_fixed_criteria_are_consistent():
    assert sorted(fixed.CRITERIA) == sorted(human.THEMES) and len(fixed.CRITERIA) == 36
    assert sorted(fixed.CRITERION_WEIGHTS) == sorted(human.RULE_CODES) and len(human.RULE_CODES) == 28


def test_melt_keeps_null_and_widen_reverses_it(spark):
    wide = spark.createDataFrame([(1, "Oui", None), (2, None, "Non")], "sample_id int, CI3 string, CI4 string")
    long = human.melt_answers(wide, ["sample_id"], ["CI3", "CI4"])
    assert long.count() == 4
    back = reshape.widen(long, ["sample_id"], "criterion", "answer", ["CI3", "CI4"])
    assert sorted(back.collect()) == sorted(wide.collect())


def test_sampling_deals_distinct_inputs(spark):
    rows = [(t, i, m) for t in ("x", "y") for i in range(30) for m in ("m1", "m2")]
    df = spark.createDataFrame(rows, "test_set string, input_id int, model string")
    batches = human.sample_batches(df, 3, 4, "s")
    got = batches.collect()
    for test_set in ("x", "y"):
        drawn = [r for r in got if r.test_set == test_set]
        assert len({r.input_id for r in drawn}) == 12
        assert sorted(r.batch for r in drawn) == sorted(b for b in range(4) for _ in range(3))
    assert sorted(got) == sorted(human.sample_batches(df.repartition(5), 3, 4, "s").collect())
    assert human.batch_rows(df, batches, ["m1"]).count() == 24


def test_too_few_inputs_fail(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)], "test_set string, input_id int")
    with pytest.raises(Exception, match="too few inputs in x"):
        human.sample_batches(df, 3, 2, "s").collect()


def _alpha(units):
    units = [u for u in units if len(u) >= 2]
    o = {}
    for u in units:
        for i, j in itertools.permutations(range(len(u)), 2):
            o[u[i], u[j]] = o.get((u[i], u[j]), 0) + 1 / (len(u) - 1)
    totals = {}
    for (c, _), v in o.items():
        totals[c] = totals.get(c, 0) + v
    n = sum(totals.values())
    seen = sum(v for (c, k), v in o.items() if c != k)
    expected = sum(a * b for (c, a), (k, b) in itertools.permutations(totals.items(), 2))
    return 1 - (n - 1) * seen / expected


def test_agreement(spark):
    units = [["a", "a", "b"], ["b", "b", "b"], ["a", "c", "c"], ["a", "a", "a"], ["b"]]
    rows = [(i, str(j), "q", answer) for i, u in enumerate(units) for j, answer in enumerate(u)]
    df = _long(spark, rows)
    got = human.krippendorff(df, ["criterion"], ["sample_id"]).first().alpha
    assert got == pytest.approx(_alpha(units))
    full = [u for u in units if len(u) == 3]
    shares = [sum(u.count(c) for u in full) / 12 for c in "abc"]
    p_bar = sum((sum(u.count(c) ** 2 for c in "abc") - 3) / 6 for u in full) / len(full)
    chance = sum(s * s for s in shares)
    row = human.fleiss(df, ["criterion"], ["sample_id"], raters=3).first()
    assert row.kappa == pytest.approx((p_bar - chance) / (1 - chance)) and row.n_items == 4


def test_pseudonyms(spark):
    df = _long(spark, [(1, "zoe", "q", "x"), (2, "ann", "q", "x"), (3, "ann", "q", "x"), (4, "annika", "q", "x")])
    got = {r.sample_id: r.annotator_id for r in human.pseudonyms(df, "annotator_id").collect()}
    assert got == {1: "coder_3", 2: "coder_1", 3: "coder_1", 4: "coder_2"}
    given = human.pseudonyms(df, "annotator_id", names={"zoe": "z"}).orderBy("sample_id").collect()
    assert [r.annotator_id for r in given] == ["z", "ann", "ann", "annika"]


def _paired_alpha(items):
    """Nominal alpha from lists of answers, pair by pair."""
    pairs, n_c = [], {}
    for answers in items:
        for i, a in enumerate(answers):
            n_c[a] = n_c.get(a, 0) + 1
            pairs += [(a != b) / (len(answers) - 1) for j, b in enumerate(answers) if i != j]
    n = sum(n_c.values())
    expected = sum(x * y for a, x in n_c.items() for b, y in n_c.items() if a != b)
    return 1 - (n - 1) * sum(pairs) / expected if expected else None


def test_agreement_jackknife_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, k, rnd.choice("aab" if g == "x" else "abc")) for g in ("x", None) for k in range(25) for _ in range(rnd.randint(1, 6))]
    rows += [("same", 1, "a"), ("same", 1, "a"), ("same", 2, "b"), ("one", 1, "a"), ("one", 1, "b"), ("lonely", 1, "a"), ("x", 99, None)]
    df = spark.createDataFrame(rows, "g string, item int, answer string")
    got = {r.g: r for r in human.krippendorff_spread(df, ["g"], ["item"]).collect()}
    for g in {r[0] for r in rows}:
        items = {}
        for h, k, a in rows:
            if h == g and a is not None:
                items.setdefault(k, []).append(a)
        good = {k: v for k, v in items.items() if len(v) >= 2}
        alphas = [_paired_alpha([v for j, v in good.items() if j != k]) for k in good]
        want = _paired_alpha(good.values())
        assert (got[g].n_items, got[g].n_left_out) == (len(good), len(items) - len(good))
        assert got[g].alpha == (None if want is None else pytest.approx(want))
        if len(good) > 1 and None not in alphas:
            mean = sum(alphas) / len(alphas)
            assert got[g].std_error == pytest.approx(math.sqrt((len(good) - 1) / len(good) * sum((a - mean) ** 2 for a in alphas)))
        else:
            assert got[g].std_error is None
    everything = human.krippendorff_spread(df.where("g = 'x'"), [], ["item"]).first()
    assert everything.alpha == pytest.approx(got["x"].alpha) and everything.std_error == pytest.approx(got["x"].std_error)


def test_widen_refuses_unlisted_names(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3)], "id int, name string, v int")
    assert reshape.widen(df, ["id"], "name", "v", ["a", "b"]).first().asDict() == {"id": 1, "a": 2, "b": 3}
    for bad in ("c", None):
        more = df.unionByName(spark.createDataFrame([(1, bad, 4)], df.schema))
        with pytest.raises(Exception, match=f"name not listed: {bad or 'null'}"):
            reshape.widen(more, ["id"], "name", "v", ["a", "b"]).collect()


def test_explode_together_wants_equal_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [3], ["c"])], "k int, x array<int>, y array<string>")
    got = reshape.explode_together(df, ["x", "y"]).orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.x, r.y) for r in got] == [(1, 0, 1, "a"), (1, 1, 2, "b"), (2, 0, 3, "c")]
    bad = spark.createDataFrame([(1, [1, 2], ["a"])], "k int, x array<int>, y array<string>")
    with pytest.raises(Exception, match="arrays differ in length"):
        reshape.explode_together(bad, ["x", "y"]).collect()


def test_aligned_lists_keep_every_row_in_chunks(spark):
    df = spark.range(25).select(F.lit("g").alias("g"), F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    rows = reshape.aligned_lists(df, ["g"], "pos", ["v"], chunk=10).orderBy("chunk").collect()
    assert [len(r.v) for r in rows] == [10, 10, 5]
    assert [x for r in rows for x in r.v] == [2 * i for i in range(25)]


def test_records_need_every_key(spark):
    df = spark.createDataFrame([(0, {"a": 1, "b": 2}), (1, {"a": 3})], "pos long, record map<string,int>")
    with pytest.raises(Exception, match="record lacks b"):
        reshape.records_to_lists(df, "pos", "record", ["a", "b"]).collect()


# --- trial tables ------------------------------------------------------------------------------


def _trials(spark):
    rows = [(0, "m1", "x", 1.0), (1, "m1", "y", float("nan")), (2, "m2", "x", 3.0), (3, "m2", "y", 3.0), (4, "m2", None, None)]
    return spark.createDataFrame(rows, "pos int, model string, config string, score double")


def test_nan_never_wins(spark):
    assert trials.arg_best(_trials(spark), [], ["pos"], "score").first().pos == 2
    assert trials.arg_best(_trials(spark), [], ["pos"], "score", mode="min").first().pos == 0
    assert trials.best_row(_trials(spark), "score", ["pos"]).first().pos == 2


def test_best_or_first_falls_back(spark):
    rows = [("a", 0, None), ("a", 1, float("nan")), ("b", 0, 1.0), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, pos int, score double")
    assert {r.g: r.pos for r in trials.best_or_first(df, ["g"], "score", "pos").collect()} == {"a": 0, "b": 1}


def test_same_config_counts_null_as_equal(spark):
    rows = [(0, None, 1, 9.0), (1, None, 1, 2.0), (2, "x", 1, 3.0), (3, None, 2, 4.0)]
    df = spark.createDataFrame(rows, "pos int, a string, b int, score double")
    assert sorted(r.pos for r in trials.same_config(df, ["a", "b"], "score", "pos").collect()) == [0, 1]


def test_marks(spark):
    marked = {r.pos: r.mark for r in trials.mark_top_two(_trials(spark).withColumn("k", F.lit(1)), ["k"], "score").collect()}
    assert marked == {0: 2, 1: None, 2: 1, 3: 1, 4: None}
    flags = {r.pos: (r.best_overall, r.best_in_model) for r in trials.mark_best(_trials(spark).withColumn("k", F.lit(1)), "k", "model", "score", ["pos"]).collect()}
    assert flags == {0: (False, True), 1: (False, False), 2: (True, True), 3: (False, False), 4: (False, False)}


def test_grid_attaches_every_point(spark):
    got = trials.grid(spark.range(2), {"k": [1, 2, 3], "o": ["a", "b"]}, repeats=5)
    assert got.count() == got.distinct().count() == 2 * 3 * 2 * 5


def test_mean_std_of_one_row(spark):
    row = trials.mean_std(_trials(spark).where("pos = 0"), ["model"], "score").first()
    assert (row.n, row["mean"], row.std) == (1, 1.0, None)
