import itertools
import re

import numpy as np

from claritas.llm import licenses as L
from claritas.llm.license_templates import PHRASES, TEMPLATES
from tests.llm.helpers import alnum, docs_of, prose


def base(text):
    w, places, labels = alnum(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = TEMPLATES["mit-text"][0].replace("[[(including the next paragraph)]]", "").replace("{{12}}", "THE AUTHORS OR COPYRIGHT HOLDERS")
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "x y. This work is licensed under the GNU General Public License, version 3"),
    (3, "apache license apache license; CC-BY 4.0"),
    (4, "Licensed under CC BY-NC 4.0.\n" + prose(1, 300)),
    (5, None),
    (6, ""),
    (7, "no licence"),
    (8, prose(3, 20_000) + " Released under the MIT License " + prose(4, 9000)),
    (9, MIT),
    (10, MIT.replace("substantial", "essential")),
    (11, "the mit\nlicense"),
    (11, "the mit\nlicense"),
    (None, "ＭＩＴ license mit"),
]


def test_base_columns_and_labels(spark):
    got = L.scan(docs_of(spark, ROWS, extra="runs"), ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[1]["labels"] == "apache,apache-2.0" and by[1]["score"] == 1.0
    assert by[2]["labels"] == "gpl,gpl-3.0" and by[4]["labels"] == "cc-by,cc-by-nc-4.0" and by[8]["labels"] == "mit,mit-notice"
    assert by[9]["labels"] == "mit-text" and by[10]["labels"] == "" and by[9]["score"] == 1.0
    assert L.scan(docs_of(spark, []), ["doc_id"]).collect() == []


def test_automaton_against_regular_expressions():
    for markup, pattern in (
        ("a [[b]] c", "a (b )?c "),
        ("a [[b [[c]]]] {{2}} d", r"a (b (c )?)?(\w+ ){0,2}d "),
        ("a {{1}} [[x]] b [[a b]]", r"a (\w+ )?(x )?b (a b )?"),
    ):
        automaton, wanted = L.Automaton(markup), re.compile(pattern)
        for n in range(1, 6):
            for words in itertools.product("abcdx", repeat=n):
                text = "".join(f"{w} " for w in words)
                longest = max((k for k in range(1, n + 1) if wanted.fullmatch("".join(f"{w} " for w in words[:k]))), default=0)
                assert automaton.longest_run([w.encode() for w in words]) == longest, (markup, text)


def test_every_template_accepts_its_own_wording():
    for label, each in TEMPLATES.items():
        for t in each:
            automaton = L.Automaton(t)
            words = L.split_words(re.sub(r"\{\{\d+\}\}", "", t.replace("[[", " ").replace("]]", " ")))
            assert automaton.longest_run(words) == len(words), label
            assert automaton.longest_run(L.split_words(re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", "", t))) > 0


def labels_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    (_, _, labels, runs), = L.Scanner().scan(L.W.words_of(raw, np.array([0, len(raw)])))
    return labels, runs


def test_licences_to_their_end():
    holder = " ".join(f"holder{k}" for k in range(40))
    filled = {label: TEMPLATES[label][0].replace("{{*}}", holder).replace("[[", "").replace("]]", "") for label in ("bsd-2-clause", "bsd-3-clause", "isc", "mit-text", "unlicense", "agpl-3.0", "mpl-2.0")}
    for label, text in filled.items():
        assert labels_of(f"x {text} y")[0] == {label}
    for label in ("bsd-2-clause", "bsd-3-clause", "isc"):
        assert labels_of(filled[label].rsplit(" ", 8)[0])[0] == set()
    assert labels_of(filled["bsd-2-clause"].replace("THIS SOFTWARE IS", "4. No warranty at all. THIS SOFTWARE IS"))[0] == set()


def test_loop_ends_at_the_first_complete_wording():
    text = TEMPLATES["mit-text"][0].replace("[[(including the next paragraph)]]", "").replace("{{*}}", "THE AUTHORS")
    n = len(L.split_words(text))
    assert labels_of(f"{text} between {text}")[1] == [(0, n, "mit-text"), (n + 1, n, "mit-text")]
    opening = text[: text.index("BE LIABLE")]
    assert labels_of(opening * 3)[1] == [] and [r[0] for r in labels_of(opening * 2 + text)[1]] == [0]


def test_loop_against_regular_expressions():
    automaton, wanted = L.Automaton("a {{*}} b [[c]] d [[a]]"), re.compile(r"a (\w+ )*?b (c )?d ")
    for n in range(1, 7):
        for words in itertools.product("abcdx", repeat=n):
            text = "".join(f"{w} " for w in words)
            found = wanted.match(text)
            first = len(found[0].split()) if found else 0
            run = first + (bool(first) and words[first : first + 1] == ("a",))
            assert automaton.longest_run([w.encode() for w in words]) == run, text


def test_gpl_notices_tell_their_versions_apart():
    start = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    by, end = "as published by the Free Software Foundation", "This program is distributed in the hope that it will be useful"
    for text, labels in ((f"{start} version 2 {by}. {end}", {"gpl-2.0-only"}), (f"{start} {by}; version 2 of the License. {end}", {"gpl-2.0-only"}), (f"{start} version 2 only", {"gpl-2.0-only"}),
                         (f"{start} {by}; either version 2 of the License, or (at your option) any later version. {end}", {"gpl-2.0"}), (f"{start} {by}. {end}", set()),
                         (f"{start} {by}; version 2 of the License, or (at your option) any later version. {end}", set())):
        assert labels_of(text)[0] == labels, text
