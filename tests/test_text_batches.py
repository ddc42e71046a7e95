"""Vectorised text metrics and token matching against plain definitions and the DataFrame functions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claritas.functions.text import WHITE_CHARACTERS, ascii_tokens, replaced_13a, strip, tokens_13a
from claritas.operators import arrow_groups, bertscore, ngrams, pair_scores, subsequence, suite, text_batches
from claritas.operators.readability import STOP_WORDS
from claritas.plans import queries_metrics
from claritas.session import written

WORDS = "running runs run cats cat the a flies dogs, happily. 3.5 5- ..5 1,, É!x &amp; <skipped> it's -\n".split(" ")
SCHEMA = "pair_id string, task string, system string, src string, ref string, pred string"


def _texts(n=40, seed=1, words=(0, 30)):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(*words))) for _ in range(n)]


def _rows(n=30):
    texts = iter(_texts(3 * n))
    rows = [(f"p{i}", "u" if i % 2 else "v", "s", next(texts), next(texts), next(texts)) for i in range(n)]
    # one text is equal, one missing, two rows share their pair, keys are null
    rows += [("same", "u", "s", "a b", "The cats run. They run.", "The cats run. They run."), ("empty", "u", "s", "", "", "")]
    rows += [("p0", "v", "s", "more running words", "cats run. And a dog", "a cat ran. a dog"), (None, None, "s", "x y", "x running", "runs x")]
    return rows + [(None, None, "s", "x", "x y z", "z"), ("p1", None, "s", "x", "x y z", "z")]


def _found(tokens, n):
    out = [[] for _ in range(n)]
    for i, word in zip(tokens.text, tokens.strings().to_pylist()):
        out[i].append(word.decode())
    return out


def _plain_13a(text):
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return [t for t in re.split(f"[{re.escape(WHITE_CHARACTERS)}]+", re.sub(r"([0-9])(-)", r"\1 \2 ", text)) if t]


def test_tokens_of_bytes_equal_the_patterns():
    rnd = random.Random(4)
    alphabet = "ab19.,.,--'\"!&/\\ é€　 \u0085\xa0   ٣😀Â\x1c\t"
    for _ in range(150):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 40))]
        raw, offsets = text_batches.text_bytes(pa.array([None, *texts], pa.string()).slice(1))
        assert _found(text_batches.words_13a(raw, offsets), len(texts)) == [_plain_13a(t) for t in texts]
        assert _found(text_batches.ascii_words(raw, offsets), len(texts)) == [re.findall("[a-z0-9]+", t) for t in texts]


def test_tokens_of_bytes_equal_the_columns(spark):
    texts = [*_texts(60), "3..5 a..5 1,2 1,,2 x.", "5- -5 --", None, "", "İK ΣΑΣ.Α"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clean = {lower: replaced_13a(strip(F.col("t")), lower) for lower in (False, True)}
    rows = df.select(F.lower("t"), *clean.values(), ascii_tokens(F.col("t")), *[tokens_13a(strip(F.col("t")), x) for x in clean]).collect()
    for find, text, want in ((text_batches.ascii_words, 0, 3), (text_batches.words_13a, 1, 4), (text_batches.words_13a, 2, 5)):
        raw, offsets = text_batches.text_bytes(pa.array([r[text] for r in rows], pa.string()))
        assert _found(find(raw, offsets), len(rows)) == [r[want] or [] for r in rows]


def test_rows_of_batches_equal_the_counted_grams(spark, monkeypatch):
    monkeypatch.setattr(text_batches, "SLICE_BYTES", 700)
    df = spark.createDataFrame(_rows(), SCHEMA)
    by, both = ["task", "system"], ("rougeL", "rougeLsum")
    want = {(r.pair_id, r.task): r.asDict() for r in pair_scores._rows_of_sums(df, by, STOP_WORDS, both, True).collect()}
    got = {(r.pair_id, r.task): r.asDict() for r in pair_scores._rows_of_batches(df, by, STOP_WORDS, both).collect()}
    assert got.keys() == want.keys() and len(got) == len(_rows()) - 2
    for k, row in want.items():
        assert got[k] == {c: pytest.approx(v, abs=1e-12) if isinstance(v, float) else v for c, v in row.items()}


def test_missing_texts_are_empty(spark):
    rows = [("a", "t", "s", "x y", None, "x y"), ("b", "t", "s", None, "x y", "x"), ("c", "t", "s", "x", "x y", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.pair_id: r.asDict() for r in pair_scores._rows_of_sums(df, ["task", "system"], STOP_WORDS, (), True).collect()}
    got = {r.pair_id: r.asDict() for r in pair_scores._rows_of_batches(df, ["task", "system"], STOP_WORDS, ("rougeL", "rougeLsum")).collect()}
    for k, row in want.items():
        assert {c: got[k][c] for c in row} == {c: pytest.approx(v) if isinstance(v, float) else v for c, v in row.items()}
    assert got["a"]["rougeL"] == 0.0 and got["c"]["rougeLsum"] == 0.0 and got["b"]["rougeL"] == pytest.approx(2 / 3)


def test_stemmed_suite_unfolds_no_grams_and_no_vectors_are_packed(spark):
    df = spark.createDataFrame(_rows(5), SCHEMA)
    plan = suite.suite(df, ["system"], stems=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "gram" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    tokens = spark.createDataFrame([(1, "pred", 0, [1.0]), (1, "ref", 0, [1.0])], "pair_id int, side string, tok_pos int, vec array<double>")
    plan = bertscore.token_best(tokens, ["pair_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and "Join" not in plan


def _sentences(rnd, longest, kinds):
    return [[rnd.randint(0, kinds) for _ in range(rnd.randint(1, longest))] for _ in range(rnd.choice([0, 1, 2, 6]))]


def _flat(documents):
    tokens = [(t, i, k) for i, d in enumerate(documents) for k, s in enumerate(d) for t in s]
    return tuple(np.array([t[c] for t in tokens], np.int64) for c in range(3))


@pytest.mark.parametrize("longest, meetings", [(9, 1 << 16), (30, 5), (140, 1 << 16)])
def test_union_of_many_rows_equals_one_by_one(monkeypatch, longest, meetings):
    monkeypatch.setattr(subsequence, "MEETINGS", meetings)
    rnd = random.Random(longest)
    for _ in range(25):
        kinds, n = rnd.choice([2, 5, 20]), rnd.randint(1, 8)
        ref, pred = [_sentences(rnd, longest, kinds) for _ in range(n)], [_sentences(rnd, longest, kinds) for _ in range(n)]
        got = subsequence.union_hits_of_rows(_flat(ref), _flat(pred), n)
        assert got.tolist() == [subsequence.union_hits(r, p) for r, p in zip(ref, pred)]


def _table_positions(a, b):
    """The walk over the full table, ties upwards."""
    size = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1, j + 1] = size[i, j] + 1 if x == y else max(size[i, j + 1], size[i + 1, j])
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif size[i - 1, j] == size[i, j]:
            i -= 1
        else:
            j -= 1
    return found, size[-1, -1]


@pytest.mark.parametrize("block", [3, 64, 1024])
def test_walk_by_bits_equals_the_table(block):
    rnd = random.Random(block)
    for _ in range(60):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        found, size = _table_positions(a, b)
        assert subsequence.lcs_positions(a, b, block=block) == found and subsequence.lcs_size(a, b, block) == size


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_groups_span_batches_and_files(limit):
    rnd = random.Random(8)
    sizes = [rnd.choice([1, 2, 3, 17]) for _ in range(40)]
    group = np.repeat(np.arange(40), sizes)
    first = np.append(True, np.diff(group) > 0)
    table = pa.table({"g": group, "_first": first})
    for size in (1, 4, 1000):
        parts = list(arrow_groups.whole_groups(iter(table.to_batches(max_chunksize=size)), limit))
        assert pa.concat_tables(parts).equals(table)
        assert all(p.column("_first")[0].as_py() for p in parts)


def _matched(rows):
    """Greedy matching in plain Python: {(pair, side, tok_pos): best}."""
    best = {}
    for pair, side, pos, vec in rows:
        for pair_2, side_2, _, vec_2 in rows:
            if pair == pair_2 and side != side_2 and pair is not None:
                size = math.hypot(*vec) * math.hypot(*vec_2) or 1.0
                cosine = sum(x * y for x, y in zip(vec, vec_2)) / size
                best[pair, side, pos] = max(cosine, best.get((pair, side, pos), -2.0))
    return best


@pytest.mark.parametrize("chunk, held", [(512, 1 << 20), (2, 1 << 20), (3, 0)])
def test_token_best_with_repeats_nulls_and_files(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(bertscore, "CHUNK", chunk)
    monkeypatch.setattr(bertscore, "HELD_BYTES", held)
    rng, rows = np.random.default_rng(3), []
    for pair in (0, 1, 2, None):
        rows += [(pair, s, i % 5, [0.0] * 3 if i == 4 else rng.normal(size=3).tolist()) for s, n in (("pred", 7), ("ref", 6)) for i in range(n)]
    rows += [(1, "ref", None, [1.0, 0.0, 0.0]), (5, "ref", 0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "pair_id int, side string, tok_pos int, vec array<double>").repartition(5)
    got = {(r.pair_id, r.side, r.tok_pos): r.best for r in bertscore.token_best(df, ["pair_id"]).collect()}
    want = _matched(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    pairs = {r.pair_id: r.recall for r in bertscore.bertscore_pairs(df, ["pair_id"]).collect()}
    for pair in (0, 1, 2):
        assert pairs[pair] == pytest.approx(np.mean([v for (p, s, _), v in want.items() if p == pair and s == "ref"]))
    assert pairs[5] == 0.0 and pairs[None] == 0.0


def test_uneven_token_vectors_are_an_error(spark):
    rows = [(1, "pred", 0, [1.0, 2.0]), (1, "ref", 0, [1.0]), (1, "ref", 1, None)]
    df = spark.createDataFrame(rows, "pair_id int, side string, tok_pos int, vec array<double>")
    with pytest.raises(Exception, match="different lengths"):
        bertscore.token_best(df, ["pair_id"]).collect()


def test_vectors_in_use_are_sent_whatever_the_join_threshold(spark):
    rows = written(queries_metrics._systems(spark, "/root/testdata/sf0.001"), "rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        tokens = queries_metrics._vectors_of(spark, "/root/testdata/sf0.001", rows)
        plan = tokens._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stems_are_kept_by_process():
    stems = ngrams.token_stemmer()
    assert stems(["running", "cat", "cats"]) == ["run", "cat", "cat"] and ngrams.token_stemmer()(["running"]) == ["run"]
