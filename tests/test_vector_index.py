"""The vector index: only new and changed rows are encoded, vanished ones go, broken runs do not count."""

import pytest
from pyspark.sql import functions as F

from claritas.sources import vector_index


def _rows(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in texts.items()], "pos long, text string")


def _encoder(spark, seen):
    """Vectors of one number, the length of the text; `seen` counts the encoded rows."""

    @F.udf("array<double>")
    def vector(text):
        seen.add(1)
        return [float(len(text or "")), 1.0]

    return lambda df: df.withColumn("embedding", vector("text"))


def _live(spark, path, version=None):
    return {r.pos: (r.embedding[0], r.segment) for r in vector_index.vectors(spark, path, version).collect()}


def test_only_new_and_changed_rows_are_encoded(spark, tmp_path):
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    encode = _encoder(spark, seen)
    first = {k: "x" * k for k in range(1, 11)} | {11: None}
    done = vector_index.refresh(_rows(spark, first), path, ["pos"], encode)
    assert (done.version, done.kept, done.encoded, done.gone) == (1, 0, 11, 0) and seen.value == 11
    second = {k: t for k, t in first.items() if k not in (3, 4)} | {5: "changed text", 20: "new", 11: ""}
    done = vector_index.refresh(_rows(spark, second), path, ["pos"], encode)
    assert (done.version, done.kept, done.encoded, done.gone) == (2, 7, 3, 2) and seen.value == 14
    assert _live(spark, path) == {k: (float(len(t or "")), 2 if k in (5, 11, 20) else 1) for k, t in second.items()}
    assert set(_live(spark, path, 1)) == set(first)  # the older version can still be read
    again = vector_index.refresh(_rows(spark, second), path, ["pos"], encode)
    assert (again.version, again.encoded, again.gone) == (2, 0, 0) and seen.value == 14
    last = vector_index.refresh(_rows(spark, {1: "x"}), path, ["pos"], encode)
    assert (last.version, last.kept, last.encoded, last.gone) == (3, 1, 0, 9) and set(_live(spark, path)) == {1}


def test_a_run_that_breaks_leaves_the_version_before(spark, tmp_path):
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    vector_index.refresh(_rows(spark, {1: "a", 2: "bb"}), path, ["pos"], _encoder(spark, seen))

    def broken(df):
        return df.withColumn("embedding", F.raise_error(F.lit("encoder is down")).cast("array<double>"))

    with pytest.raises(Exception, match="encoder is down"):
        vector_index.refresh(_rows(spark, {1: "a", 2: "other"}), path, ["pos"], broken)
    assert vector_index.current_version(spark, path) == 1 and set(_live(spark, path)) == {1, 2}
    # vectors were written, but the run ended before its row count: the next run writes them anew
    _encoder(spark, seen)(_rows(spark, {9: "half"}).withColumn("row_hash", F.lit("h"))).drop("text").write.parquet(f"{path}/vectors/segment=2", mode="overwrite")
    vector_index.refresh(_rows(spark, {1: "a", 2: "other"}), path, ["pos"], _encoder(spark, seen))
    assert _live(spark, path) == {1: (1.0, 1), 2: (5.0, 2)}


def test_hash_tells_nulls_and_columns_apart(spark):
    rows = [(None, "a"), ("a", None), ("", "a"), ("a", ""), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(vector_index.row_hash(["x", "y"]).alias("h")).distinct().count() == 5


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        vector_index.vectors(spark, path)
    seen = spark.sparkContext.accumulator(0)
    done = vector_index.refresh(_rows(spark, {}), path, ["pos"], _encoder(spark, seen))
    assert (done.version, done.encoded) == (1, 0) and _live(spark, path) == {}
