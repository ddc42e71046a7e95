"""The stemmer as SQL: one common table per step over the distinct tokens, from the same fixed rules."""

from __future__ import annotations

from claritas.functions import stem as rules


def _shape(w: str) -> str:
    """V and C for vowels and consonants; y is a vowel after a consonant."""
    kinds = f"regexp_replace(regexp_replace(translate({w}, 'aeiou', 'VVVVV'), '[a-xz0-9]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):  # runs of y, from the left
        kinds = f"replace(replace({kinds}, 'Cy', 'CV'), 'Vy', 'VC')"
    return kinds


def _measure(w: str) -> str:
    return f"(len({_shape(w)}) - len(replace({_shape(w)}, 'VC', ''))) // 2"


def _cut(w: str, n: str | int) -> str:
    return f"left({w}, len({w}) - {n})"


def _short_end(w: str) -> str:
    return f"(({_shape(w)} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {_shape(w)} = 'VC')"


def _longest(suffixes: list[tuple[str, str]]) -> tuple[str, str]:
    """The longest suffix that `w` ends with, and what replaces it."""
    ordered = sorted(suffixes, key=lambda r: -len(r[0]))
    found = " ".join(f"WHEN w LIKE '%{s}' THEN '{s}'" for s, _ in ordered)
    new = " ".join(f"WHEN w LIKE '%{s}' THEN '{n}'" for s, n in ordered)
    return f"CASE {found} END", f"CASE {new} END"


def _replaced(name: str, source: str, suffixes: list[tuple[str, str]], where: str = "true") -> str:
    found, new = _longest(suffixes)
    rest = _cut("w", "len(s)")
    return f"""{name}_s AS (SELECT *, CASE WHEN {where} THEN {found} END AS s, {new} AS new FROM {source}),
{name} AS (SELECT * EXCLUDE (s, new, w), CASE WHEN s IS NULL THEN w WHEN {_measure(rest)} > 0 THEN {rest} || new ELSE w END AS w FROM {name}_s)"""


def stems_sql(tokens: str) -> str:
    """Common tables that end in `stems` (word, w); `tokens` is a query of the tokens `t`. Short ones stay."""
    ordered = sorted(rules.STEP_4, key=lambda s: -len(s))
    fourth = "CASE " + " ".join(f"WHEN w LIKE '%{s}' THEN '{s}'" for s in ordered) + " END"
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.IRREGULAR.items())
    return f"""words AS (SELECT DISTINCT t AS word, t AS w FROM ({tokens}) WHERE len(t) > 3),
plural AS (SELECT word, CASE WHEN w LIKE '%ies' THEN CASE WHEN len(w) = 4 THEN {_cut("w", 1)} ELSE {_cut("w", 2)} END
  WHEN w LIKE '%sses' THEN {_cut("w", 2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_cut("w", 1)} ELSE w END AS w FROM words),
past_s AS (SELECT *, CASE WHEN w LIKE '%ied' OR w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' THEN {_cut("w", 2)} WHEN w LIKE '%ing' THEN {_cut("w", 3)} END AS s FROM plural),
past AS (SELECT word, CASE WHEN w LIKE '%ied' THEN CASE WHEN len(w) = 4 THEN {_cut("w", 1)} ELSE {_cut("w", 2)} END
  WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_cut("w", 3))} > 0 THEN {_cut("w", 1)} ELSE w END
  WHEN s IS NULL OR {_shape("s")} NOT LIKE '%V%' THEN w
  WHEN s LIKE '%at' OR s LIKE '%bl' OR s LIKE '%iz' THEN s || 'e'
  WHEN len(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND {_shape("s")} LIKE '%C' THEN CASE WHEN right(s, 1) IN ('l', 's', 'z') THEN s ELSE {_cut("s", 1)} END
  WHEN {_measure("s")} = 1 AND {_short_end("s")} THEN s || 'e' ELSE s END AS w FROM past_s),
ending AS (SELECT word, CASE WHEN w LIKE '%y' AND len(w) > 2 AND {_shape(_cut("w", 1))} LIKE '%C' THEN {_cut("w", 1)} || 'i' ELSE w END AS w FROM past),
marked AS (SELECT *, w AS before FROM ending),
{_replaced("second", "marked", rules.STEP_2, "w NOT LIKE '%logi'")},
{_replaced("twice", "second", rules.STEP_2, "before LIKE '%alli' AND w <> before")},
logi AS (SELECT word, CASE WHEN before LIKE '%logi' AND {_measure(_cut("before", 3))} > 0 THEN {_cut("before", 1)} ELSE w END AS w FROM twice),
{_replaced("third", "logi", rules.STEP_3)},
fourth_s AS (SELECT *, {fourth} AS s FROM third),
fourth AS (SELECT word, CASE WHEN s IS NOT NULL AND {_measure(_cut("w", "len(s)"))} > 1 AND (s <> 'ion' OR right({_cut("w", "len(s)")}, 1) IN ('s', 't')) THEN {_cut("w", "len(s)")} ELSE w END AS w FROM fourth_s),
last_e AS (SELECT word, CASE WHEN w LIKE '%e' AND ({_measure(_cut("w", 1))} > 1 OR ({_measure(_cut("w", 1))} = 1 AND NOT {_short_end(_cut("w", 1))})) THEN {_cut("w", 1)} ELSE w END AS w FROM fourth),
last_l AS (SELECT word, CASE WHEN w LIKE '%ll' AND {_measure(_cut("w", 1))} > 1 THEN {_cut("w", 1)} ELSE w END AS w FROM last_e),
stems AS (SELECT word, CASE word {irregular} ELSE w END AS w FROM last_l)"""
