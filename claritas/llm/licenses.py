"""License scan by template-markup matching.

A template (license_templates.py) is compiled to an automaton over words: mandatory words are single
steps, an optional region may be stepped over, a replaceable region takes any words up to its bound, or any
number of words on one looping state; such a run ends where the wording after the loop is first complete. A
template matches where the automaton accepts a run of words, so mandatory wording must match exactly.
The pairs of words that a match can start with are hashed; a vectorised pass over all words finds
places with such a pair, and only there the automata run, each at most as far as its longest run. Base
phrases are found by the same pass and compared word by word.

`score` is the share of the text's words inside a phrase or an accepted run.
Nulls: a null or empty text has no words, no labels and score 0. Repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.llm.license_templates import PHRASES, TEMPLATES

MARKS = re.compile(r"\[\[|\]\]|\{\{(?:\d+|\*)\}\}")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(LOWER))


class Automaton:
    """States are integers; `step[s]` maps a word to the next state, None stands for any word; `free[s]` are empty steps."""

    def __init__(self, template: str):
        self.step: list[dict] = [{}]
        self.free: list[list[int]] = [[]]
        self.longest = 0  # without what loops take
        self.loops: set[int] = set()
        last, opened, at = 0, [], 0
        for mark in [*MARKS.finditer(template), None]:
            for word in split_words(template[at : mark.start() if mark else len(template)]):
                last = self._add(last, word)
            if mark is None:
                break
            at = mark.end()
            if mark[0] == "[[":
                opened.append(last)
            elif mark[0] == "]]":
                start, end = opened.pop(), self._new()
                self.free[last].append(end)
                self.free[start].append(end)
                last = end
            elif mark[0] == "{{*}}":
                loop = self._new()
                self.free[last].append(loop)
                self.step[loop][None] = [loop]
                self.loops.add(loop)
                last = loop
            else:
                start = last
                for _ in range(int(mark[0][2:-2])):
                    nxt = self._add(last, None)
                    self.free[start].append(nxt)
                    last = nxt
        if opened:
            raise ValueError("an optional region is not closed")
        self.accept = last

    def _new(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def _add(self, last: int, word: bytes | None) -> int:
        new = self._new()
        self.step[last].setdefault(word, []).append(new)
        self.longest += 1
        return new

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def after(self, states: set[int], word: bytes | None) -> set[int]:
        """States after one word; with None: after any word."""
        out: set[int] = set()
        for s in states:
            for w, nxt in self.step[s].items():
                if word is None or w is None or w == word:
                    out.update(nxt)
        return self.closed(out)

    def heads(self) -> set[tuple]:
        """Pairs of words that an accepted run can start with; None stands for any word."""
        out, start = set(), self.closed({0})
        for s in start:
            for first, nxt in self.step[s].items():
                for t in self.closed(set(nxt)):
                    out.update((first, second) for second in self.step[t])
        return out

    def longest_run(self, words: Iterable[bytes], at: int = 0, dead: dict[int, int] | None = None) -> int:
        """Words of the longest accepted run from the first word on; 0: none. After the first accepted run no loop goes on.

        `dead`, of one text: places from which on a loop is known to lead nowhere; `at` is the place of the first word.
        """
        states, best, entered = self.closed({0}), 0, {}
        dead = {} if dead is None else dead
        for i, word in enumerate(words):
            states = self.after(states, word)
            for s in states & self.loops:
                if s not in entered and at + i >= dead.get(s, at + i + 1):
                    states.discard(s)
                else:
                    entered.setdefault(s, at + i)
            if best:
                states -= self.loops
            if not states:
                break
            if self.accept in states:
                best = i + 1
                states = states - self.loops
        if not best:
            for s, place in entered.items():
                dead[s] = min(place, dead.get(s, place))
        return best


def _code(words: list[bytes]) -> np.uint64:
    """The code that `words.grams` gives these words."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    return W.grams(W.words_of(raw, np.array([0, len(raw)])), len(words))[1][0]


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(split_words(p), label) for p, label in phrases.items()]
        self.by_size = {n: [(_code(p), b" ".join(p), label) for p, label in self.phrases if len(p) == n] for n in sorted({len(p) for p, _ in self.phrases})}
        self.automata = [(label, Automaton(t)) for label, each in templates.items() for t in each]
        pairs: dict[np.uint64, list[int]] = {}
        firsts: dict[np.uint64, list[int]] = {}
        for k, (_, a) in enumerate(self.automata):
            for first, second in a.heads():
                if first is None:
                    raise ValueError(f"{self.automata[k][0]}: a template must not start with a replaceable region")
                where = firsts if second is None else pairs
                code = _code([first] if second is None else [first, second])
                where.setdefault(code, [])
                if k not in where[code]:
                    where[code].append(k)
        self.heads = {1: firsts, 2: pairs}

    def scan(self, words: W.Words) -> list[tuple[list[int], set[str], set[str], list[tuple[int, int, str]]]]:
        """Per text: starts of base phrases, base labels, labels of templates, runs (first word, length, label)."""
        out = [([], set(), set(), []) for _ in range(words.n_docs)]
        offsets = words.offsets()
        for n, each in self.by_size.items():
            at, code = W.grams(words, n)
            for want, phrase, label in each:
                for i in at[code == want].tolist():
                    if b" ".join(words.word(j) for j in range(i, i + n)) == phrase:
                        d = int(words.doc[i])
                        out[d][0].append(i - int(offsets[d]))
                        out[d][1].add(label)
                        out[d][3].append((i - int(offsets[d]), n, ""))
        tried: set[tuple[int, int]] = set()
        dead: dict[tuple[int, int], dict[int, int]] = {}
        past: dict[tuple[int, int], int] = {}  # end of the last run with a loop: its inside is not tried again
        for n, heads in self.heads.items():
            if not heads:
                continue
            at, code = W.grams(words, n)
            known = np.sort(np.array(list(heads), np.uint64))
            spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
            for i, c in zip(at[known[spot] == code].tolist(), code[known[spot] == code]):
                d = int(words.doc[i])
                for k in heads[c]:
                    label, automaton = self.automata[k]
                    if (i, k) in tried:
                        continue
                    tried.add((i, k))
                    end = int(offsets[d + 1]) if automaton.loops else min(int(offsets[d + 1]), i + automaton.longest)
                    if i < past.get((d, k), 0):
                        continue
                    run = automaton.longest_run((words.word(j) for j in range(i, end)), i, dead.setdefault((d, k), {}) if automaton.loops else None)
                    if run and automaton.loops:
                        past[d, k] = i + run
                    if run:
                        out[d][2].add(label)
                        out[d][3].append((i - int(offsets[d]), run, label))
        return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("label", pa.string())]))
    for batch in batches:
        for words in W.word_slices(batch.column(batch.num_columns - 1)):
            found, many = scanner.scan(words), words.counts()
            kept = [batch.column(k).slice(words.first, words.n_docs) for k in range(batch.num_columns - 1)]
            score = []
            for (_, _, _, runs), n in zip(found, many):
                covered, last = 0, 0
                for a, b in sorted((first, first + size) for first, size, _ in runs):
                    covered, last = covered + max(0, b - max(a, last)), max(last, b)
                score.append(covered / n if n else 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(many, pa.int64()),
                    pa.array([len(f[0]) for f in found], pa.int64()),
                    pa.array([min(f[0]) if f[0] else None for f in found], pa.int64()),
                    pa.array([max(f[0]) if f[0] else None for f in found], pa.int64()),
                    pa.array([",".join(sorted(f[1])) for f in found], pa.string()),
                    pa.array([",".join(sorted(f[1] | f[2])) for f in found], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[{"first": a, "n": n, "label": label} for a, n, label in sorted(f[3]) if label] for f in found], run_type),
                ],
                [*batch.schema.names[:-1], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs"],
            )


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, then n_words, n_base, first_word, last_word, base_labels, labels, score and runs
    (accepted runs of templates: first word, words, label). `keep` must not name an output."""
    kinds = dict(docs.dtypes)
    outputs = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, runs array<struct<first: bigint, n: bigint, label: string>>"
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], outputs])
    return docs.select(*keep, F.col("text").cast("string").alias(W.free("_text", keep))).mapInArrow(_scan, schema)
