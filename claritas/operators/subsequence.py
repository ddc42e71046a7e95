"""ROUGE-L and ROUGE-Lsum: longest common subsequences, bit-parallel.

Pairs are spread by id once, as for the n-gram metrics; long pairs then meet no full task. Without stems
the length of a subsequence is a fold in DataFrame functions (`folded_size`), except for pairs whose
shorter text is beyond a measured length; stems, positions and those pairs use Python in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.functions.text import ASCII_WORD, ascii_tokens, find_all, sentences
from claritas.operators.ngrams import f_score, token_stemmer
from claritas.session import shuffle_width


BLOCK = 1024  # tokens of a table block
WORD_BITS = 62  # of a long, so that a sum with its carry never overflows
FOLD_LIMIT = 16 * WORD_BITS  # tokens of the shorter text up to which a fold beats Python


class Places:
    """A token list cut into blocks; per block and token, the bits of its places in the block.

    A block's bits are bounded by its length, so the whole takes memory in proportion to the list.
    """

    def __init__(self, a, block: int = BLOCK):
        self.a, self.block, self.where = a, block, []
        for start in range(0, len(a), block):
            where: dict = {}
            for i, token in enumerate(a[start : start + block]):
                where[token] = where.get(token, 0) | (1 << i)
            self.where.append(where)

    def size(self, r: int) -> int:
        return min(self.block, len(self.a) - r * self.block)


def _steps(where: dict, size: int, b, carries) -> Iterator[tuple[int, int]]:
    """(state, carry) per token of b: bit i of the state is 0 where row i of the LCS table grows by one.

    The row-wise recurrence of Hyyro (2004): a column of a block of rows is a single integer. The sum
    hands a carry to the next block of rows; `carries` are those of the block before.
    """
    mask = (1 << size) - 1
    state = mask
    for token, carry in zip(b, carries):
        hit = state & where.get(token, 0)
        total = state + hit + carry
        carry = total >> size
        state = (total & mask) | (state - hit)
        yield state, carry


def lcs_size(a, b, block: int = BLOCK) -> int:
    """Keeps one block of rows and a byte per token of the shorter list."""
    if a == b:
        return len(a)
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    places, carries, found = Places(a, block), bytes(len(b)), 0
    if len(places.where) == 1:
        mask = state = (1 << len(a)) - 1
        for hit in map(places.where[0].get, b):
            if hit:
                hit &= state
                state = ((state + hit) & mask) | (state - hit)
        return len(a) - state.bit_count()
    for r, where in enumerate(places.where):
        size = places.size(r)
        handed, last = bytearray(len(b)), (1 << size) - 1
        for j, (last, carry) in enumerate(_steps(where, size, b, carries)):
            handed[j] = carry
        carries = handed
        found += size - last.bit_count()
    return found


def lcs_positions(a, b, places: Places | None = None, block: int = BLOCK) -> set[int]:
    """Positions in `a` of one longest common subsequence; on a tie the walk goes up in `a`.

    A first pass keeps only the carries between blocks of rows (a bit per token of b and block); the walk
    back computes the columns of one block at a time: len(b) integers of `block` bits.
    """
    places = Places(a, block) if places is None else places
    block, rows, found = places.block, [np.packbits(np.zeros(len(b), np.uint8))], set()
    for r, where in enumerate(places.where[:-1]):
        carries = np.unpackbits(rows[-1], count=len(b)).tolist()
        rows.append(np.packbits(np.fromiter((c for _, c in _steps(where, places.size(r), b, carries)), np.uint8, len(b))))
    i, j = len(a), len(b)
    for r in range(len(places.where) - 1, -1, -1):
        if not j:
            break
        start = r * block
        carries = np.unpackbits(rows[r], count=len(b))[:j].tolist()
        columns = [state for state, _ in _steps(places.where[r], places.size(r), b[:j], carries)]
        while i > start and j:
            # the next row up that holds this token or where its column grows
            hit = places.where[r].get(b[j - 1], 0)
            up = ((hit | ~columns[j - 1]) & ((1 << (i - start)) - 1)).bit_length()
            i = start + up
            if up:
                if hit >> (up - 1) & 1:
                    i -= 1
                    found.add(i)
                j -= 1
    return found


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once however often the body reads it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


def _own(placed: Column, starts: Column, start: Column, k: Column) -> Column:
    """The places of one token; `placed` is sorted by token and a token's places begin at `start`."""
    return F.slice(placed, start + 1, F.coalesce(F.get(starts, k + 1), F.size(placed)) - start)


def _masks(placed: Column, starts: Column) -> Column:
    """Map from token to the bits of its places, where all fit one long."""

    def entry(start: Column, k: Column) -> Column:
        bits = F.aggregate(_own(placed, starts, start, k), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(_shifted(x["i"])))
        return F.struct(F.get(placed, start)["t"].alias("key"), bits.alias("value"))

    return F.map_from_entries(F.transform(starts, entry))


def _word_masks(placed: Column, starts: Column, words: Column) -> Column:
    """The same in several longs of WORD_BITS bits."""

    def entry(start: Column, k: Column) -> Column:
        def bits(w: Column) -> Column:
            inside = lambda x: F.floor(x["i"] / WORD_BITS) == w
            return F.aggregate(_own(placed, starts, start, k), F.lit(0).cast("bigint"), lambda acc, x: F.when(inside(x), acc.bitwiseOR(_shifted(x["i"] % WORD_BITS))).otherwise(acc))

        return F.struct(F.get(placed, start)["t"].alias("key"), F.transform(F.sequence(F.lit(0), words - 1), bits).alias("value"))

    return F.map_from_entries(F.transform(starts, entry))


FULL = (1 << WORD_BITS) - 1


def _word_step(state: Column, mask: Column) -> Column:
    hit = state.bitwiseAND(mask)
    return (state + hit).bitwiseAND(F.lit(FULL)).bitwiseOR(state - hit)


def _step(state: Column, masks: Column) -> Column:
    """The next state: words from low to high, each handing its carry on."""
    pairs = F.zip_with(state, masks, lambda x, y: F.struct(x.alias("x"), x.bitwiseAND(y).alias("hit")))
    empty = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array_append(F.array(), F.lit(0).cast("bigint")).alias("out"))

    def word(acc: Column, w: Column) -> Column:
        done = lambda total: F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.array_append(acc["out"], total.bitwiseAND(F.lit(FULL)).bitwiseOR(w["x"] - w["hit"])).alias("out"))
        return _let(w["x"] + w["hit"] + acc["carry"], done)

    return F.aggregate(pairs, empty, word, lambda acc: F.slice(acc["out"], F.lit(2), F.size(acc["out"])))


def folded_size(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, in DataFrame functions.

    The shorter one becomes bit words; tokens of the longer one that it does not hold change nothing.
    """
    swap = F.size(a) > F.size(b)
    sides = F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long"))

    def with_sides(two: Column) -> Column:
        words = F.ceil(F.size(two["short"]) / WORD_BITS).cast("int")
        placed = F.array_sort(F.transform(two["short"], lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def seen(where: Column) -> Column:
            return F.filter(F.transform(two["long"], lambda t: F.try_element_at(where, t)), lambda m: m.isNotNull())

        def by_word(where: Column) -> Column:
            return F.lit(WORD_BITS) - F.bit_count(F.aggregate(seen(where), F.lit(FULL), _word_step))

        def by_words(where: Column) -> Column:
            zeros = lambda last: F.size(last) * WORD_BITS - F.aggregate(last, F.lit(0), lambda acc, w: acc + F.bit_count(w))
            return _let(F.aggregate(seen(where), F.array_repeat(F.lit(FULL), words), _step), zeros)

        def with_placed(p: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: (k == 0) | (F.get(p, k)["t"] != F.get(p, k - 1)["t"]))
            return _let(starts, lambda at: F.when(words == 1, _let(_masks(p, at), by_word)).otherwise(_let(_word_masks(p, at, words), by_words)))

        return _let(placed, with_placed)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).when(a == b, F.size(a)).otherwise(_let(sides, with_sides)).cast("bigint")


def union_hits(ref: list, pred: list) -> int:
    """Tokens of the reference sentences covered by any prediction sentence, clipped on both sides."""
    left_ref = Counter(t for s in ref for t in s)
    left_pred = Counter(t for s in pred for t in s)
    hits = 0
    for sentence in ref:
        places = Places(sentence)
        covered = set().union(*(lcs_positions(sentence, other, places) for other in pred)) if len(pred) else set()
        for token in (sentence[i] for i in sorted(covered)):
            if left_ref[token] > 0 and left_pred[token] > 0:
                left_ref[token] -= 1
                left_pred[token] -= 1
                hits += 1
    return hits


def _found_bits(a: np.ndarray, size: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`lcs_positions` of many short lists at a time, as bits of integers.

    Columns of `a` hold `size` tokens from the top in a height of 16, 32 or 64, columns of `b` theirs down to
    the last row; the rest is filled with numbers that meet nothing.
    """
    width = len(a)
    match = np.zeros(b.shape, f"u{width // 8}")
    for i, token in enumerate(a):
        match |= (token == b) * match.dtype.type(1 << i)
    full = np.array(-1).astype(match.dtype)
    states, state = np.empty_like(match), np.full(b.shape[1], full)
    for j, here in enumerate(match):
        hit = state & here
        state = states[j] = (state + hit) | (state - hit)
    low, found = full >> (width - size).astype(match.dtype), np.zeros_like(state)
    for here, column in zip(match[::-1], states[::-1]):
        up = (here | ~column) & low
        step = 1
        while step < width:
            up |= up >> step
            step *= 2
        hit = here & (up ^ (up >> 1))
        found |= hit
        low = np.where(hit != 0, up >> 1, up)
    return found


class Sentences:
    """Runs of tokens with one row and sentence number; `tokens` numbers equal tokens alike."""

    def __init__(self, tokens: np.ndarray, row: np.ndarray, sentence: np.ndarray):
        self.tokens, self.row_of_token = tokens.astype(np.int32), row
        first = np.append(True, (np.diff(row) != 0) | (np.diff(sentence) != 0))[: len(row)]
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(row))[: len(self.start)]
        self.size, self.row = self.end - self.start, row[self.start]

    def padded(self, which: np.ndarray, width: int, right: bool) -> np.ndarray:
        places = np.arange(width)[:, None]
        at = (self.end[which] - width if right else self.start[which]) + places
        size = self.size[which]
        inside = places >= width - size if right else places < size
        return np.where(inside, self.tokens[np.clip(at, 0, len(self.tokens) - 1)], -2 if right else -1)

    def list(self, i: int) -> list[int]:
        return self.tokens[self.start[i] : self.end[i]].tolist()


MEETINGS = 1 << 16  # sentence pairs at a time
CELLS = 1 << 21  # token pairs at a time


def _cover(ref: Sentences, pred: Sentences, i: np.ndarray, j: np.ndarray, covered: np.ndarray) -> None:
    """Mark the tokens of the reference sentences `i` that the prediction sentences `j` cover."""
    wide = ref.size[i] > 64
    last = None
    for x, y in zip(i[wide], j[wide]):  # in the order of x
        if x != last:
            a, last = ref.list(x), x
            places = Places(a)
        covered[ref.start[x] + np.array([*lcs_positions(a, pred.list(y), places)], np.int64)] = True
    i, j = i[~wide], j[~wide]
    width, steps = (np.maximum(16, 1 << np.ceil(np.log2(size)).astype(np.int64)) for size in (ref.size[i], pred.size[j]))
    kind = width * (1 << 32) + steps
    for k in np.unique(kind):
        w, s = int(k >> 32), int(k & 0xFFFFFFFF)
        these = np.flatnonzero(kind == k)
        tile = max(1, CELLS // (w * s))
        for t in (these[x : x + tile] for x in range(0, len(these), tile)):
            found = _found_bits(ref.padded(i[t], w, False), ref.size[i[t]], pred.padded(j[t], min(s, int(pred.size[j[t]].max())), True))
            p, place = np.nonzero(np.unpackbits(found.astype(found.dtype.newbyteorder("<")).view(np.uint8).reshape(len(t), -1), axis=1, bitorder="little"))
            covered[ref.start[i[t]][p] + place] = True


def union_hits_of_rows(ref: tuple[np.ndarray, np.ndarray, np.ndarray], pred: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int) -> np.ndarray:
    """`union_hits` of every row; both sides are (token, row, sentence), a number each per token in order."""
    ref, pred = Sentences(*ref), Sentences(*pred)
    covered = np.zeros(len(ref.tokens), bool)
    begin, end = (np.searchsorted(pred.row, ref.row, side) for side in ("left", "right"))
    count = end - begin
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, total[at] + MEETINGS, "right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        j = np.arange(len(i)) - np.repeat(total[at:to] - total[at], count[at:to]) + begin[i]
        _cover(ref, pred, i, j, covered)
        at = to
    width = int(max(ref.tokens.max(initial=0), pred.tokens.max(initial=0))) + 1
    rows = np.concatenate([ref.row_of_token, pred.row_of_token])
    code = pd.factorize(rows * width + np.concatenate([ref.tokens, pred.tokens]))[0]
    size = int(code.max(initial=-1)) + 1
    row_of_code = np.zeros(size, np.int64)
    row_of_code[code] = rows
    clipped = np.minimum(np.bincount(code[: len(covered)][covered], minlength=size), np.bincount(code[len(covered) :], minlength=size))
    return np.bincount(row_of_code, weights=clipped, minlength=n_rows).astype(np.int64)


def _lcs_udf(stems: bool):
    @F.pandas_udf(T.LongType())
    def lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        prepare = token_stemmer() if stems else list
        for ref, pred in batches:
            yield pd.Series([lcs_size(prepare(r.split()), prepare(p.split())) for r, p in zip(ref, pred)], dtype="int64")

    return lcs


def _union_udf(stems: bool):
    @F.pandas_udf(T.LongType())
    def union(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        prepare = token_stemmer() if stems else list

        def tokens(text: str) -> list[list[str]]:
            return [prepare(line.split()) for line in text.split("\n")]

        for ref, pred in batches:
            yield pd.Series([union_hits(tokens(r), tokens(p)) for r, p in zip(ref, pred)], dtype="int64")

    return union


def _token_text(c: Column) -> Column:
    return F.array_join(ascii_tokens(c), " ")


def hits_column(longest: int, stems: bool, summary: bool, fold_limit: int = FOLD_LIMIT) -> Column:
    """Hits of the columns `ref` and `pred`; `longest` is the token count of the longest shorter text."""
    if not (stems or summary or longest > fold_limit):
        return folded_size(ascii_tokens(F.col("ref")), ascii_tokens(F.col("pred")))
    return (_union_udf if summary else _lcs_udf)(stems)(*[_side_text(s, summary) for s in ("ref", "pred")])


def sizes_columns(summary: bool) -> list[Column]:
    """Tokens of the prediction and of the reference, as the hits count them."""
    return [F.size(find_all(_side_text(s, summary), ASCII_WORD)) for s in ("pred", "ref")]


def longest_shorter(df: DataFrame) -> int:
    shorter = F.least(*[F.regexp_count(F.lower(s), F.lit(ASCII_WORD)) for s in ("ref", "pred")])
    return df.agg(F.max(shorter)).first()[0] or 0


def _side_text(side: str, summary: bool) -> Column:
    c = F.col(side)
    return F.array_join(F.transform(sentences(c), _token_text), "\n") if summary else _token_text(c)


def _hits_by_udf(pairs: DataFrame, keys: list[str], stems: bool, summary: bool) -> DataFrame:
    work = pairs.select(*keys, *[_side_text(s, summary).alias(f"_{s}") for s in ("ref", "pred")])
    hits = (_union_udf if summary else _lcs_udf)(stems)("_ref", "_pred")
    sizes = [F.size(find_all(F.col(f"_{s}"), ASCII_WORD)) for s in ("pred", "ref")]
    return work.select(*keys, hits.alias("hits"), sizes[0].alias("n_pred"), sizes[1].alias("n_ref"))


def _hits_by_fold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    work = pairs.select(*keys, *[ascii_tokens(F.col(s)).alias(f"_{s}") for s in ("ref", "pred")])
    return work.select(*keys, folded_size(F.col("_ref"), F.col("_pred")).alias("hits"), F.size("_pred").alias("n_pred"), F.size("_ref").alias("n_ref"))


def rouge_l_pairs(df: DataFrame, by: list[str], stems: bool = True, summary: bool = False, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Hits, totals and F per pair; `summary` takes the union over sentences.

    Without stems and `summary`, pairs whose shorter text has at most `fold_limit` tokens stay in the JVM;
    the largest is measured first, and a Python branch is added only where one is longer.
    """
    keys = ["pair_id", *by]
    # Scoring costs far more than moving the text once, so pairs are spread evenly first.
    spread = df.select(*keys, "ref", "pred").repartition(shuffle_width(df.sparkSession), *keys)
    if stems or summary:
        counted = _hits_by_udf(spread, keys, stems, summary)
    else:
        shorter = F.least(*[F.regexp_count(F.lower(s), F.lit(ASCII_WORD)) for s in ("ref", "pred")])
        if longest_shorter(df) <= fold_limit:
            counted = _hits_by_fold(spread, keys)
        else:
            short = _hits_by_fold(spread.where(shorter <= fold_limit), keys)
            counted = short.unionByName(_hits_by_udf(spread.where(shorter > fold_limit), keys, stems, summary))
    return counted.withColumn("f", f_score(F.col("hits"), F.col("n_pred"), F.col("n_ref")))


def rouge_l(df: DataFrame, by: list[str], stems: bool = True, summary: bool = False) -> DataFrame:
    name = "rougeLsum" if summary else "rougeL"
    return rouge_l_pairs(df, by, stems, summary).groupBy(*by).agg((F.avg("f") * 100).alias(name))
