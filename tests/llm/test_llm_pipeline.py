import re

import corpus_pipeline as C
from claritas.llm import decontamination, quality
from claritas.llm.queries import QUERIES
from tests.llm.helpers import blank, docs_of, prose
from tests.llm.test_llm_decontamination import brute as contaminated
from tests.llm.test_llm_jaccard import brute as components
from tests.llm.test_llm_mixing import targets


def test_stages_against_brute_force(spark, tmp_path):
    rows = [(k, prose(k, 30 + k % 90, 3000), f"s{k % 4}") for k in range(150)]
    rows += [(200 + k, " ".join(w + "###" for w in prose(500 + k, 60, 30).split()), "s1") for k in range(60)]
    rows += [(300, prose(7, 37, 3000) + " tail", "s0"), (301, prose(9, 400, 3000), None), (302, prose(9, 400, 3000), "s2")]
    rows += [(303, prose(20, 50) + " " + prose(900, 12) + " " + prose(21, 50), "s1"), (304, prose(33, 80, 3000) + " password = 'hunter2hunter2' " + prose(34, 30, 3000), "s3")]
    rows += [(305, None, "s0"), (306, "", "s0"), (307, "short", None), (308, prose(11, 15_000, 3000), "s1")]
    docs = docs_of(spark, rows, extra="score size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("###" not in (t or ""))) for i, t, _ in rows if i % 3]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, prose(900, 12))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for name, stage in C.STAGES:
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, folder)
        if name != C.STAGES[-1][0]:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{re.sub(' ', '_', name)}")
        now = spark.read.parquet(f"{tmp_path}/{re.sub(' ', '_', name)}")
        after = [tuple(r) for r in now.collect()]
        texts = [(r[0], r[1]) for r in before]
        if name == "quality classifier":
            gone = {r[0] for r in before} - {r[0] for r in after}
            junk = {i for i, t, _ in rows if "###" in (t or "")}
            assert gone >= junk and len(gone - junk) <= 3
        elif name == "n-gram Jaccard join":
            assert sorted(r[0] for r in after) == [i for i, _, c in sorted(components(texts, 5, 80, 100)) if i == c]
        elif name == "benchmark decontamination":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in contaminated(texts, items) if not r[5])
            assert 303 not in {r[0] for r in after}
        elif name == "secret scans":
            changed = [(a, b) for a, b in zip(sorted(before), sorted(after)) if a != b]
            assert len(before) == len(after) and [a[0] for a, _ in changed] == [304] and "hunter2" not in changed[0][1][1]
        else:
            sizes: dict = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len(blank(r[1]))
            taken: dict = {}
            for r in now.collect():
                taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            assert all(abs(taken.get(s, 0) - t) <= 0.5 for s, t in targets(sizes).items())
    assert sorted(map(str, C.run(spark, folder).collect())) == sorted(map(str, now.collect()))


def test_contract():
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None and "pipeline" in QUERIES
    assert all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11))
    assert decontamination and quality
