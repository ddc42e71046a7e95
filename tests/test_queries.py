"""Every registered query against its SQL on the smallest tables, and what its plan may hold."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as contract
from claritas.operators.corpus import select_tasks
from claritas.plans import queries_metrics
from claritas.session import written
from claritas.sources.corpora import snapshot

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()
# Python by nature: hooks, matrix products, the stemmer, positions of subsequences.
HOOKS = (
    "h3_", "j4_", "j6_", "j7_", "w4_", "w5_", "w6_", "w7_", "w8_", "w9_", "f2_", "f18_", "h7_", "m6_",
    "m1_rouge_n_stems", "m2_rouge_l", "m3_", "m12_metric_suite", "m13_",
)
JVM_ONLY = ("m2_rouge_l_words", "m2_rouge_l_bootstrap", "m12_suite_words")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def _sorted(rows, columns):
    cells = [tuple(_plain(r[c]) for c in columns) for r in rows]
    return sorted(cells, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = _sorted([r.asDict() for r in df.collect()], columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in SQL:
        assert rows
        return
    if not name.startswith(HOOKS) or name in JVM_ONLY:
        assert not re.search("ArrowEvalPython|BatchEvalPython|InPandas", plan)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert rows == _sorted([dict(zip(names, r)) for r in cursor.fetchall()], columns)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["p8_flags"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan
    plan = QUERIES["q3_missing_metrics"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,60.0)" in plan


def test_task_choice_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", "x"), ("b", "test", "y")], "task string, split string, src string")
    stored = snapshot(df, str(tmp_path / "pairs"))
    chosen = select_tasks(stored, {"train": ["a"]})
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "task" in filters and "split" in filters and chosen.count() == 1


def test_grams_stay_in_the_partitioning_of_their_pair(spark):
    plan = QUERIES["m1_rouge_n_pairs"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(pair_id", plan)) == 1
    assert "gram" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_token_vectors_do_not_cross_the_network(spark):
    rows = written(queries_metrics._systems(spark, FOLDER), "rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # below the stored vectors, above those in use
    try:
        plan = queries_metrics._vectors_of(spark, FOLDER, rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(_id" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = QUERIES["w14_keep_best_checkpoints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
