import re

import pytest
from pyspark.sql import functions as F

from claritas.functions import text, token_arrays, vectors
from claritas.operators.batches import pad_batches


@pytest.fixture
def one(spark):
    def evaluate(column, **values):
        names = list(values)
        df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
        return df.select(column.alias("x")).first().x

    return evaluate


def _chat(one, src, dst=None, **options):
    messages = text.pair_messages(F.col("a"), None if dst is None else F.col("b"))
    values = {"a": src} if dst is None else {"a": src, "b": dst}
    return one(text.chat_text(messages, "</s>", **options), **values)


def test_chat_text(one):
    assert _chat(one, "Hello you.", "Hi.") == "### Input: Hello you. ### Output: Hi. </s>"
    assert _chat(one, "Hello you.") == "### Input: Hello you."
    assert _chat(one, "Hello you.", generation=True) == "### Input: Hello you. ### Output:"
    # the generation suffix repeats per message
    assert _chat(one, "a", "b", generation=True) == "### Input: a ### Output: ### Output: b </s> ### Output:"


@pytest.mark.parametrize(
    "whole, pred, given",
    [
        ("### Input: a b ### Output: c ### Output: d ", "c ### Output: d", "a b"),
        ("no marks at all", "no marks at all", "no marks at all"),
        ("### Output:", "", ""),
        ("x ### Input: y", "x ### Input: y", "x  y"),
    ],
)
def test_split_chat(one, whole, pred, given):
    assert one(text.chat_output(F.col("t")), t=whole) == pred
    assert one(text.chat_input(F.col("t")), t=whole) == given


@pytest.mark.parametrize(
    "raw, want",
    [("x @@@a\nb@@@ y @@@c@@@", "a\nb"), ("@@@open", "open"), ("none", "none"), ("@@@@@@", ""), ("a@@@@b", "a@b")],
)
def test_marked_answer(one, raw, want):
    assert one(text.marked_answer(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw", ["a -LRB- b -RRB- c", "x\n-LRB-y", "RRB", "plain", "é-LRB-\u0085z", "--LRB--"])
def test_clean_brackets_is_the_pattern(one, raw):
    assert one(text.clean_brackets(F.col("t")), t=raw) == re.sub(r"-?.?LRB.?-?|-?.?RRB.?-?", "", raw)


@pytest.mark.parametrize("raw", [" a ", " \t x ", "\x1c\x1fy\x85", "", "   ", "​z​", "a\n"])
def test_strip_is_unicode_strip(one, raw):
    assert one(text.strip(F.col("t")), t=raw) == raw.strip()


def test_fold_accents(one):
    assert one(text.fold_accents(F.col("t")), t="Éléphant Ça ÎLE ñ ŠÑ") == "elephant ca ile n sn"


def test_tokens_13a(one):
    got = one(text.tokens_13a(F.col("t")), t='Hello, "world"! It\'s 3.5 &amp; 1,000-fold.\nNext-\nline a.b')
    assert got == ["Hello", ",", '"', "world", '"', "!", "It's", "3.5", "&", "1,000", "-", "fold", ".", "Nextline", "a", ".", "b"]


def test_ascii_tokens_split_at_accents(one):
    assert one(text.ascii_tokens(F.col("t")), t="L'Été 2024, naïf") == ["l", "t", "2024", "na", "f"]


def test_sentences(one):
    assert one(F.size(text.sentences(F.col("t"))), t="One. Two!? ... three") == 3
    assert one(F.size(text.sentences(F.col("t"))), t="...") == 0


def test_model_key(one):
    row = one(text.model_key(F.col("t")), t="('m', 'lora', 'a+b')")
    assert (row.model, row.method, row.train_tasks) == ("m", "lora", "a+b")
    row = one(text.model_key(F.col("t")), t="labels")
    assert (row.model, row.method) == ("labels", None)


def test_longest_prefix_wins(one):
    prefixes = ["test_a", "test_a_b"]
    got = [tuple(one(text.split_by_prefix(F.col("t"), prefixes), t=t)) for t in ("test_a_b_x", "test_a_x", "test_ab", "y")]
    assert got == [("test_a_b", "x"), ("test_a", "x"), ("other", "test_ab"), ("other", "y")]


def test_token_arrays(one):
    assert one(token_arrays.replace_ignored(F.col("t"), 0), t=[1, -100, 2]) == [1, 0, 2]
    assert one(token_arrays.truncate(F.col("t"), 2), t=[1, 2, 3]) == [1, 2]
    marker = [7, 8]
    label = token_arrays.completion_labels(F.col("t"), marker)
    assert one(label, t=[1, 7, 8, 2, 7, 8, 3]) == [-100, -100, -100, 2, 7, 8, 3]
    assert one(label, t=[1, 7, 9]) == [-100] * 3
    assert one(label, t=[7]) == [-100]
    padded = token_arrays.completion_labels(F.col("t"), marker, pad_id=0)
    assert one(padded, t=[7, 8, 5, 0]) == [-100, -100, 5, -100]


def test_pad_batches(spark):
    rows = [(0, [1]), (1, [1, 2, 3]), (2, [4]), (3, [5, 6])]
    df = spark.createDataFrame(rows, "pos long, t array<int>")
    right = {r.pos: (r.input_ids, r.attention_mask) for r in pad_batches(df, "t", 2, 0).collect()}
    assert right[0] == ([1, 0, 0], [1, 0, 0]) and right[2] == ([4, 0], [1, 0])
    left = {r.pos: (r.input_ids, r.attention_mask) for r in pad_batches(df, "t", 2, 9, side="left").collect()}
    assert left[0] == ([9, 9, 1], [0, 0, 1]) and left[3] == ([5, 6], [1, 1])


def test_vectors(one):
    assert one(vectors.normalise(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(vectors.normalise(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
