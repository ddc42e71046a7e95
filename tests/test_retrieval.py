import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from claritas.operators import bertscore, retrieval


def _vectors(seed=1, n=60, width=8):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, width)).astype(np.float32)
    if n > 14:
        matrix[10:14] = matrix[9]  # equal items: the smaller id must win
    return matrix


def _frames(spark):
    items, queries = _vectors(), _vectors(2, 7)
    corpus = spark.createDataFrame([(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(items)], "item_id long, embedding array<float>, task string")
    asked = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    return asked, corpus, queries.astype(float), items.astype(float)


def _brute(queries, items, k):
    want = set()
    for q, vector in enumerate(queries):
        for t, task in enumerate("abc"):
            scored = sorted((-round(float(vector @ items[i]), 9), i) for i in range(t, len(items), 3))
            want |= {(100 + q, task, i, r + 1) for r, (_, i) in enumerate(scored[:k])}
    return want


def _got(df):
    return {(r.query_id, r.task, r.item_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("way", ["queries", "corpus", "blocks"])
def test_three_ways_are_exact(spark, monkeypatch, way, k):
    asked, corpus, queries, items = _frames(spark)
    row = 8 * (8 + 2)
    limit = {"queries": 1 << 20, "corpus": 30 * row, "blocks": 2 * row}[way]
    if way == "corpus":
        # more queries than fit, fewer items than fit
        asked = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("query_id", F.col("query_id") + F.col("copy") * 1000).drop("copy")
        limit = 65 * row
    got = _got(retrieval.top_k(asked, corpus, k, limit=limit))
    want = _brute(queries, items, k)
    if way == "corpus":
        want = {(q + 1000 * c, *rest) for q, *rest in want for c in range(10)}
    assert got == want


def test_block_cells_cover_every_pair(spark, monkeypatch):
    asked, corpus, queries, items = _frames(spark)
    found = retrieval._meet_blocks(asked, corpus, 4, False, 4096, 1)
    ranked = retrieval.top_rows(found, ["query_id", "task"], [F.col("similarity").desc(), F.col("item_id")], 4)
    assert _got(ranked) == _brute(queries, items, 4)
    monkeypatch.setattr(retrieval, "MIN_BLOCK", 5)
    found = retrieval._meet_blocks(asked, corpus, 4, False, 8, 1)
    ranked = retrieval.top_rows(found, ["query_id", "task"], [F.col("similarity").desc(), F.col("item_id")], 4)
    assert _got(ranked) == _brute(queries, items, 4)


def _clusters(spark, n=4_000, width=16, centres=20):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(centres, width)) * 4
    items = middle[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, width))
    queries = middle[rng.integers(0, centres, 60)] + 0.1 * rng.normal(size=(60, width))
    corpus = spark.createDataFrame([(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(items)], "item_id long, embedding array<double>, task string")
    asked = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    return asked, corpus, queries, items


def test_blocks_below_the_threshold_are_never_multiplied(spark):
    _, corpus, queries, items = _clusters(spark)
    local = corpus.toPandas()
    pilot = retrieval.Pilot.of(local.iloc[::5])
    least = pilot.least(np.arange(60), queries, 3, False)
    asked = retrieval.Asked(np.arange(100, 160), queries, {t: least[:, i] for i, t in enumerate(pilot.tasks)})
    search = retrieval.Search(asked, 3, False)
    for block in retrieval.blocks_of(local, pilot.centres):
        search.add(block)
    got = search.found()
    ranked = {(q, t, i) for q, t, i in zip(got["query_id"], got["task"], got["item_id"])}
    assert ranked == {(q, t, i) for q, t, i, _ in _brute(queries, items, 3)}
    assert search.opened < 0.2 * search.met


@pytest.mark.parametrize("way", ["queries", "corpus", "blocks"])
def test_little_below_the_threshold_leaves_a_task(spark, monkeypatch, way):
    monkeypatch.setattr(retrieval, "MIN_BLOCK", 150)
    asked, corpus, queries, items = _clusters(spark)
    row = 8 * (16 + 2)
    if way == "corpus":
        monkeypatch.setattr(retrieval, "_ship_queries", None)
    limit = {"queries": 1 << 20, "corpus": 4_000 * row, "blocks": 20 * row}[way]
    if way == "corpus":
        asked = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("query_id", F.col("query_id") + F.col("copy") * 1000).drop("copy")
    found = retrieval.candidates(asked, corpus.repartition(8), 3, limit=limit).where("query_id < 1000")
    assert found.count() <= 60 * 3 * 3 * 2  # eight tasks could each give out 540 rows
    ranked = retrieval.top_rows(found, ["query_id", "task"], [F.col("similarity").desc(), F.col("item_id")], 3)
    assert _got(ranked) == _brute(queries, items, 3)


def test_block_pairs_out_of_reach_are_not_copied(spark):
    asked, corpus, queries, items = _clusters(spark)
    local = corpus.toPandas()
    pilot = retrieval.Pilot.of(local)
    with_least = retrieval._with_least(asked, pilot, 3, False, 16)
    q, n_q = retrieval._placed(with_least, "query_id", pilot.centres, 50)
    c, n_c = retrieval._placed(corpus, "item_id", pilot.centres, 100)
    assert retrieval.block_pairs(q, c, n_c, True).count() < 0.3 * n_q * n_c
    assert retrieval.block_pairs(q, c, n_c, False).count() == q.select("_block").distinct().count() * n_c


@pytest.mark.parametrize("way", ["queries", "corpus"])
def test_a_task_holds_one_share_of_what_is_shipped(spark, monkeypatch, way):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 8)
    asked, corpus, queries, items = _frames(spark)
    row = 8 * (8 + 2)
    monkeypatch.setattr(retrieval, "SHARE", {"queries": 2 * (row + 3 * (8 + 16 * 4)), "corpus": 20 * row}[way])
    if way == "corpus":
        monkeypatch.setattr(retrieval, "_ship_queries", None)
        asked = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("query_id", F.col("query_id") + F.col("copy") * 1000).drop("copy")
    found = retrieval.candidates(asked, corpus, 4, limit={"queries": 1 << 20, "corpus": 65 * row}[way])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") >= 3  # seven queries by two, sixty items by twenty
    ranked = retrieval.top_rows(found, ["query_id", "task"], [F.col("similarity").desc(), F.col("item_id")], 4)
    want = _brute(queries, items, 4)
    assert _got(ranked) == (want if way == "queries" else {(q + 1000 * c, *rest) for q, *rest in want for c in range(10)})


def test_a_product_stands_in_tiles_and_results_leave_in_parts():
    rng = np.random.default_rng(3)
    items, queries = rng.normal(size=(2_048, 32)).astype(np.float32), rng.normal(size=(20_000, 32)).astype(np.float32)
    asked, block = retrieval.Asked(np.arange(20_000), queries), retrieval.Block("a", np.arange(2_048), items)
    search = retrieval.Search(asked, 3, False)
    tracemalloc.start()
    try:
        search.add(block)
        rows = [len(part) for part in search.parts()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(rows) == 60_000 and max(rows) <= retrieval.PART
    assert peak < 48 << 20  # one product of 2,048 x 2,048 alone takes 32 MB
    got = search.found().head(300)
    want = np.lexsort((np.arange(2_048), -np.round(queries[7].astype(float) @ items.astype(float).T, 9)))[:3]
    assert got[got["query_id"] == 7]["item_id"].tolist() == want.tolist()


def test_a_task_without_items(spark):
    asked, corpus, queries, items = _frames(spark)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")  # most pieces of the stored file hold no row group
    try:
        assert _got(retrieval.top_k(asked, corpus.coalesce(1), 3)) == _brute(queries, items, 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_null_tasks_and_tasks_outside_the_pilot(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PILOT", 10)
    items, queries = _vectors(3, 200), _vectors(4, 5)
    tasks = [None if i % 7 == 0 else "rare" if i == 150 else "often" for i in range(200)]
    corpus = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(items, tasks))], "item_id long, embedding array<float>, task string")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    want = set()
    for q, v in enumerate(queries.astype(float)):
        for t in set(tasks):
            scored = sorted((-round(float(v @ items[i].astype(float)), 9), i) for i in range(200) if tasks[i] == t)
            want |= {(q, t, i, r + 1) for r, (_, i) in enumerate(scored[:4])}
    for limit in (1 << 20, 8 * 10):
        assert _got(retrieval.top_k(asked, corpus, 4, limit=limit)) == want


def test_neighbours_never_return_the_row_itself(spark):
    items = _vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, embedding array<float>")
    rows = retrieval.neighbours(df, 3).collect()
    assert len(rows) == 3 * len(items) and all(r.query_id != r.item_id for r in rows)
    # equal vectors keep the order of their ids
    scores = np.round(items.astype(float) @ items[12].astype(float), 9)
    want = sorted((-scores[i], i) for i in range(len(items)) if i != 12)[:3]
    assert [r.item_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 12] == [i for _, i in want]


def test_no_queries(spark):
    asked, corpus, *_ = _frames(spark)
    assert retrieval.top_k(asked.where("false"), corpus, 3).count() == 0


def test_index_gaps(spark):
    rows, vectors = spark.range(0, 5).withColumnRenamed("id", "pos"), spark.range(2, 7).withColumnRenamed("id", "pos")
    got = {(r.pos, r.missing) for r in retrieval.index_gaps(rows, vectors, ["pos"]).collect()}
    assert got == {(0, "vector"), (1, "vector"), (5, "row"), (6, "row")}


@pytest.mark.parametrize("chunk", [512, 3])
def test_bertscore_matches_greedy_matching(spark, monkeypatch, chunk):
    monkeypatch.setattr(bertscore, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for pair in range(4):
        sides = {s: rng.normal(size=(n, 6)) for s, n in (("pred", 3 + pair), ("ref", 8 - pair))}
        for s, m in sides.items():
            rows += [(pair, "x", s, i, v.tolist()) for i, v in enumerate(m)]
        unit = {s: m / np.linalg.norm(m, axis=1, keepdims=True) for s, m in sides.items()}
        cosine = unit["pred"] @ unit["ref"].T
        p, r = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
        want[pair] = (p, r, 2 * p * r / (p + r))
    rows.append((9, "x", "pred", 0, [1.0] * 6))  # no reference tokens
    want[9] = (0.0, 0.0, 0.0)
    df = spark.createDataFrame(rows, "pair_id int, task string, side string, tok_pos int, vec array<double>")
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in bertscore.bertscore_pairs(df, ["pair_id", "task"]).collect()}
    assert got.keys() == want.keys()
    for pair in want:
        np.testing.assert_allclose(got[pair], want[pair], atol=1e-9)


def test_null_or_uneven_vectors_are_an_error(spark):
    schema = "item_id long, embedding array<double>, task string"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    for bad in (None, [1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(ValueError):
            retrieval.top_k(queries, spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, bad, "a")], schema), 1)
    assert retrieval.top_k(queries.limit(0), spark.createDataFrame([(1, [1.0, 0.0], "a")], schema), 1).count() == 0


def test_vectors_are_made_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(k):
        runs.add(1)
        return [float(k), 1.0]

    queries = spark.range(5).select(F.col("id").alias("query_id"), encode("id").alias("embedding"))
    corpus = spark.createDataFrame([(k, [1.0, float(k)], "a") for k in range(9)], "item_id long, embedding array<double>, task string")
    assert retrieval.top_k(queries, corpus, 2).count() == 10 and runs.value == 5
