"""Porter stemmer (Porter 1980, with the widely used later additions) for the ROUGE variant with stems."""

from __future__ import annotations

# Irregular forms and suffix rules of the algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


_KINDS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxyz0123456789"})


def _shape(word: str) -> str:
    """c/v pattern; y is a vowel after a consonant."""
    shape = word.translate(_KINDS)
    if "y" in word:
        kinds = list(shape)
        for i, letter in enumerate(word):
            if letter == "y" and i > 0 and kinds[i - 1] == "c":
                kinds[i] = "v"
        shape = "".join(kinds)
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """consonant-vowel-consonant at the end, the last not w, x or y (or a two-letter vowel-consonant word)."""
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or shape == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural_and_past(w: str) -> str:
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
        if w.endswith(suffix):
            break
    return w


def _replace_first(w: str, rules: list[tuple[str, str]]) -> str:
    """Longest matching suffix decides; it is replaced when the rest has a measure above 0."""
    hits = [r for r in rules if w.endswith(r[0])]
    if not hits:
        return w
    suffix, new = max(hits, key=lambda r: len(r[0]))
    stem = w[: -len(suffix)]
    return stem + new if _measure(stem) > 0 else w


def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        before = w
        w = _replace_first(w, STEP_2)
        if before.endswith("alli") and w != before:
            w = _replace_first(w, STEP_2)
    w = _replace_first(w, STEP_3)
    hits = [s for s in STEP_4 if w.endswith(s)]
    if hits:
        suffix = max(hits, key=len)
        rest = w[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            w = rest
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
