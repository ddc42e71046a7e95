import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from claritas.llm import words as W
from tests.llm.helpers import alnum, blank

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é𝄞 \t\n-_\x00\x0b\x1c\x7f\x80|", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_of_slices(texts, limit):
    for kind, plain in ((W.ALNUM, alnum), (W.BLANK, blank)):
        got, codes = [], {}
        for words in W.word_slices(pa.array(texts, pa.string()), kind, limit):
            at = words.offsets()
            for d in range(words.n_docs):
                own = [words.word(i) for i in range(at[d], at[d + 1])]
                got.append([w.decode() for w in own])
                for w, c in zip(own, words.code[at[d] : at[d + 1]]):
                    assert codes.setdefault(w, c) == c
        assert got == [plain(t) for t in texts]
        assert len(set(codes.values())) == len(codes)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles_are_told_apart(texts, n):
    seen = {}
    for words in W.word_slices(pa.array(texts, pa.string()), W.BLANK):
        doc, code = W.shingles(words, n)
        plain = [(d, tuple(w[i : i + n])) for d, w in enumerate(map(blank, texts[words.first : words.first + words.n_docs])) for i in range(max(1, len(w) - n + 1)) if w]
        assert sorted(doc.tolist()) == sorted(d for d, _ in plain)
        assert len(set(zip(doc.tolist(), code.tolist()))) == len(set(plain))
        seen.update({g: 1 for _, g in plain})


def test_null_chunks_and_slices():
    column = pa.chunked_array([pa.array(["a b", None]), pa.array(["", "c"])]).slice(1, 3)
    assert [w.counts().tolist() for w in W.word_slices(column)] == [[0, 0, 1]]
    assert list(W.word_slices(pa.array([], pa.string()))) == []
    assert W.free("text", ["TEXT", "_text"]) == "__text"
