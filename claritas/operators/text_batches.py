"""Text metrics of many pairs at a time in Arrow batches: tokens, n-gram counts, longest common subsequences.

Texts stay bytes. Tokens are found by tables of byte classes, numbered by a dictionary, and an n-gram is the
number of its first n-1 tokens with the last one's, so counting is arithmetic on whole columns. Memory grows with
the text of a slice (SLICE_BYTES, or one pair if that is longer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from claritas.operators import subsequence
from claritas.operators.arrow_groups import firsts, whole_groups
from claritas.operators.ngrams import ORDERS, token_stemmer

SLICE_BYTES = 1 << 20
TEXTS = ("rouge_pred", "rouge_ref", "bleu_pred", "bleu_ref", "sari_src", "sari_pred", "sari_ref")
SRC, PRED, REF = range(3)


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


ALNUM = _bytes("abcdefghijklmnopqrstuvwxyz0123456789")
DIGIT = _bytes("0123456789")
MARK = _bytes(".!?")
DOT = _bytes(".,")
PUNCTUATION = _bytes("{|}~[\\]^_`!\"#$%&()*+:;<=>?@/")  # each is a token of its own
BLANK = _bytes("\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f ")
LEAD = np.zeros(256, bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of the wider white space


class Tokens:
    """Tokens of the texts of a column: byte places, and the text each stands in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.raw, self.start, self.end = raw, start, end
        self.text = np.searchsorted(offsets, start, "right") - 1
        self.n_texts = len(offsets) - 1

    def strings(self) -> pa.Array:
        size = self.end - self.start
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        data = self.raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _borders(offsets: np.ndarray, size: int) -> np.ndarray:
    """Where a text begins, by byte (one more for the end)."""
    at = np.zeros(size + 1, bool)
    at[offsets] = True
    return at


def _cut(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, split: np.ndarray) -> Tokens:
    """Runs of `inside`, cut where `split` (by byte, before it) is true."""
    left = split.copy()
    left[1:] |= ~inside
    right = split[1:].copy()
    right[:-1] |= ~inside[1:]
    if len(right):
        right[-1] = True
    return Tokens(raw, offsets, np.flatnonzero(inside & left[:-1]), np.flatnonzero(inside & right) + 1)


def ascii_words(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of a-z and 0-9, as `ascii_tokens` finds them in lower-case text."""
    return _cut(raw, offsets, ALNUM[raw], _borders(offsets, len(raw)))


def _white(raw: np.ndarray) -> np.ndarray:
    white = BLANK[raw]
    lead = np.flatnonzero(LEAD[raw])
    if len(lead):
        padded = np.append(raw, np.zeros(2, np.uint8))
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        thin = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (thin | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        for hit, n in ((two, 2), (three, 3)):
            for i in range(n):
                white[lead[hit] + i] = True
    return white


def words_13a(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens that the patterns of `SPLITS_13A` leave, one after the other, in a text with its replacements made.

    Between points and commas there is always a cut. A run of them stays with a digit before it only as a single
    one between digits, and with a digit behind it only where the patterns, which take two characters at a
    time, have no partner left for its last one.
    """
    n = len(raw)
    white, split = _white(raw), _borders(offsets, n)
    text_start = split.copy()
    digit = np.append(DIGIT[raw], False)  # the last one stands for both ends of the whole
    alone = PUNCTUATION[raw]
    minus = np.flatnonzero(raw == ord("-"))
    alone[minus[digit[minus - 1] & ~text_start[minus]]] = True
    split[:-1] |= alone
    split[1:] |= alone
    at = np.flatnonzero(DOT[raw])
    if len(at):
        first = np.append(True, (np.diff(at) > 1) | text_start[at[1:]])
        begin = at[first]
        length = np.diff(np.append(np.flatnonzero(first), len(at)))
        after = begin + length
        digit_before = digit[begin - 1] & ~text_start[begin]
        digit_behind = digit[after] & ~text_start[after]
        split[at[~first]] = True
        split[begin[~(digit_before & digit_behind & (length == 1))]] = True
        split[after[~(digit_behind & (digit_before == (length % 2 == 1)))]] = True
    return _cut(raw, offsets, ~white, split)


def numbered(*tokens: Tokens, stems: Callable[[list[str]], list[str]] | None = None) -> list[np.ndarray]:
    """A number per token, equal for equal tokens (or equal stems) of all columns."""
    strings = pa.chunked_array([t.strings() for t in tokens], pa.large_binary()).combine_chunks().dictionary_encode()
    codes = strings.indices.to_numpy().astype(np.int64)
    if stems is not None:
        words = [w.decode() for w in strings.dictionary.to_pylist()]
        codes = pd.factorize(np.array(stems(words), dtype=object))[0].astype(np.int64)[codes] if words else codes
    return np.split(codes, np.cumsum([len(t.start) for t in tokens])[:-1])


def gram_counts(sides: dict[int, tuple[Tokens, np.ndarray]], pair: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, pair of each gram, its count on every side); `pair` numbers the pair of each row, whose texts add up."""
    token = np.concatenate([codes for _, codes in sides.values()])
    side = np.concatenate([np.full(len(codes), s) for s, (_, codes) in sides.items()])
    row = np.concatenate([t.text for t, _ in sides.values()])
    of_pair, text = pair[row], row * 3 + side
    width = int(token.max(initial=0)) + 1
    at, code = np.arange(len(token)), of_pair
    for n in range(1, max(orders) + 1):
        if n > 1:
            keep = at < len(token) - (n - 1)
            keep[keep] = text[at[keep]] == text[at[keep] + n - 1]
            at, code = at[keep], code[keep]
        code = pd.factorize(code * width + token[at + n - 1])[0]
        if n in orders:
            size = int(code.max(initial=-1)) + 1
            pairs = np.zeros(size, np.int64)
            pairs[code] = of_pair[at]
            yield n, pairs, np.bincount(side[at] * size + code, minlength=3 * size).reshape(3, size)


def _ratio(top: np.ndarray, bottom: np.ndarray, empty: float) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), empty), where=bottom != 0)


def _harmonic(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    return _ratio(2 * p * r, p + r, 0.0)


def f_scores(hits: np.ndarray, n_pred: np.ndarray, n_ref: np.ndarray) -> np.ndarray:
    """As `ngrams.f_score`."""
    return _harmonic(_ratio(hits.astype(float), n_pred, 0.0), _ratio(hits.astype(float), n_ref, 0.0))


def sari_of(pairs: np.ndarray, counts: np.ndarray, n_pairs: int) -> np.ndarray:
    """Mean of keep, delete and add score of one order, as `ngrams.sari_sums` and `ngrams.sari_parts` have them."""
    s, c, r = counts

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(pairs, weights=values, minlength=n_pairs)

    kept, gone = np.minimum(s, c), np.maximum(s - c, 0)
    kept_good, gone_good = np.minimum(kept, r), np.maximum(gone - r, 0)
    new, new_all = (c > 0) & (s == 0), (r > 0) & (s == 0)
    none = np.zeros(len(s))
    keep_p = _ratio(total(np.divide(kept_good, kept, out=none.copy(), where=kept > 0)), total(kept > 0), 1.0)
    keep_r = _ratio(total(kept_good), total(np.minimum(s, r)), 1.0)
    del_p = _ratio(total(np.divide(gone_good, gone, out=none.copy(), where=gone > 0)), total(gone > 0), 1.0)
    found = total(new & (r > 0))
    return (_harmonic(keep_p, keep_r) + del_p + _harmonic(_ratio(found, total(new), 1.0), _ratio(found, total(new_all), 1.0))) / 3


def _largest(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, starts) if len(values) else values


def slice_scores(table: pa.Table, stems: Callable[[list[str]], list[str]], wanted: list[str]) -> dict[str, np.ndarray]:
    """Scores of the pairs of a table of whole pairs."""
    starts = firsts(table)
    n_rows, n_pairs = table.num_rows, len(starts)
    pair = np.repeat(np.arange(n_pairs), np.diff(np.append(starts, n_rows)))
    texts = {name: text_bytes(table.column(name).combine_chunks()) for name in TEXTS}
    out: dict[str, np.ndarray] = {}

    def sums(pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(pairs, weights=values, minlength=n_pairs).astype(np.int64)

    pred, ref = (ascii_words(*texts[f"rouge_{s}"]) for s in ("pred", "ref"))
    codes = dict(zip((PRED, REF), numbered(pred, ref, stems=stems)))
    for n, pairs, counts in gram_counts({PRED: (pred, codes[PRED]), REF: (ref, codes[REF])}, pair, (1, 2)):
        out[f"rouge{n}"] = f_scores(*(sums(pairs, c) for c in (np.minimum(counts[PRED], counts[REF]), counts[PRED], counts[REF])))
    sizes = [np.bincount(t.text, minlength=n_rows) for t in (pred, ref)]
    bounds = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    if "rougeL" in wanted:
        lists = codes[REF].tolist(), codes[PRED].tolist()
        (p, r) = (b.tolist() for b in bounds)
        hits = [subsequence.lcs_size(lists[0][r[i] : r[i + 1]], lists[1][p[i] : p[i + 1]]) for i in range(n_rows)]
        out["rougeL"] = _largest(f_scores(np.array(hits, np.int64), *sizes), starts)
    if "rougeLsum" in wanted:
        sentence = [np.cumsum(MARK[t.raw])[t.start] if len(t.start) else t.start for t in (ref, pred)]
        hits = subsequence.union_hits_of_rows((codes[REF], ref.text, sentence[0]), (codes[PRED], pred.text, sentence[1]), n_rows)
        out["rougeLsum"] = _largest(f_scores(hits, *sizes), starts)
    pred, ref = (words_13a(*texts[f"bleu_{s}"]) for s in ("pred", "ref"))
    code_pred, code_ref = numbered(pred, ref)
    for n, pairs, counts in gram_counts({PRED: (pred, code_pred), REF: (ref, code_ref)}, pair, ORDERS):
        out[f"correct_{n}"], out[f"total_{n}"] = sums(pairs, np.minimum(counts[PRED], counts[REF])), sums(pairs, counts[PRED])
        if n == 1:
            out["ref_length"] = sums(pairs, counts[REF])
    sides = [words_13a(*texts[f"sari_{s}"]) for s in ("src", "pred", "ref")]
    numbers = numbered(*sides)
    parts = [sari_of(pairs, counts, n_pairs) for _, pairs, counts in gram_counts(dict(enumerate(zip(sides, numbers))), pair, ORDERS)]
    out["sari"] = sum(parts) / len(ORDERS)
    return out


def slices(table: pa.Table, limit: int) -> Iterator[pa.Table]:
    """Runs of whole pairs with about `limit` bytes of text."""
    table = table.combine_chunks()
    size = sum(np.diff(text_bytes(table.column(name).combine_chunks())[1]) for name in TEXTS)
    starts, total = firsts(table), np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < table.num_rows:
        later = starts[starts > at]
        fitting = later[total[later] <= total[at] + limit]
        end = int(fitting[-1] if len(fitting) else later[0] if len(later) else table.num_rows)
        if total[-1] <= total[at] + limit:
            end = table.num_rows
        yield table.slice(at, end - at)
        at = end


def scorer(keys: list[str], measures: tuple[str, ...], scores: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: one row per pair with its key, `measures` (columns of which the largest of a pair counts) and `scores`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = token_stemmer()
        for table in whole_groups(batches):
            for part in slices(table, SLICE_BYTES):
                found, starts = slice_scores(part, stems, scores), firsts(part)
                columns = [part.column(k).combine_chunks().take(pa.array(starts)) for k in keys]
                for m in measures:
                    values = part.column(m).to_numpy()  # null becomes NaN, which fmax leaves out
                    columns.append(pa.array(np.fmax.reduceat(values, starts), pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found[name]) for name in scores]], [*keys, *measures, *scores])

    return score
