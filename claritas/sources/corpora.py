"""Readers for pair corpora and the registry of named corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritas.operators.corpus import canonical, clean, union_all

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
TEXT_PAIR = {"original": "src", "falc": "dst"}
CSV_PAIR = {"original": "src", "simple": "dst"}
SUMMARY_PAIR = {"text": "src", "summary": "dst"}

Loader = Callable[[SparkSession, str], DataFrame]
LOADERS: dict[str, Loader] = {}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def read_split(spark: SparkSession, path: str, fmt: str, columns: dict[str, str] | None) -> DataFrame:
    if not path:
        raise ValueError("a corpus needs a location")
    reader = spark.read
    if columns and fmt == "json":
        reader = reader.schema(_schema(columns))
    if fmt == "csv":
        return reader.options(**CSV_OPTIONS).csv(path)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def load_pairs(
    spark: SparkSession,
    splits: dict[str, str],
    fmt: str,
    rename: dict[str, str],
    drop: tuple[str, ...] = (),
    columns: dict[str, str] | None = None,
    cleaned: bool = False,
) -> DataFrame:
    """One file or folder per split to (split, src, dst, further columns)."""
    frames = []
    for split, path in splits.items():
        df = canonical(read_split(spark, path, fmt, columns), rename, drop)
        frames.append(df.withColumn("split", F.lit(split)))
    pairs = union_all(frames)
    return clean(pairs, ["src", "dst"]) if cleaned else pairs


def load_json_corpus(spark: SparkSession, splits: dict[str, str], **options) -> DataFrame:
    return load_pairs(spark, splits, "json", TEXT_PAIR, **options)


def load_test_only_corpus(spark: SparkSession, test: str, **options) -> DataFrame:
    return load_pairs(spark, {"test": test}, "json", TEXT_PAIR, drop=("id",), **options)


def load_csv_corpus(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    return load_pairs(spark, splits, "csv", CSV_PAIR, drop=("simple1",), cleaned=True)


def load_summary_corpus(spark: SparkSession, splits: dict[str, str], fmt: str = "parquet") -> DataFrame:
    return load_pairs(spark, splits, fmt, SUMMARY_PAIR)


def register_corpus(name: str, loader: Loader) -> None:
    LOADERS[name] = loader


def load_tasks(spark: SparkSession, location: str, tasks: list[str]) -> DataFrame:
    """Union of the named corpora with a `task` column; an unknown name is an error."""
    unknown = [t for t in tasks if t not in LOADERS]
    if unknown:
        raise KeyError(f"unknown corpora {unknown}; known: {sorted(LOADERS)}")
    return union_all([LOADERS[t](spark, location).withColumn("task", F.lit(t)) for t in tasks])


def snapshot(df: DataFrame, path: str, by: tuple[str, ...] = ("task", "split")) -> DataFrame:
    """Write once, partitioned, and read back from there."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True, rows: int | None = None) -> DataFrame:
    """The complete snapshot at `path`, of `rows` rows if a number is given; otherwise, or without
    `use_cache`, build and write it. Its row count is written beside it last, so a broken write never counts."""
    if use_cache and _complete(spark, path, rows):
        return spark.read.parquet(path)
    out = snapshot(build(), path)
    spark.range(1).select(F.lit(out.count()).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}.rows")
    return out


def _complete(spark: SparkSession, path: str, rows: int | None) -> bool:
    try:
        written = spark.read.schema("n long").parquet(f"{path}.rows").first()
        return written is not None and spark.read.parquet(path).count() == written["n"] and rows in (None, written["n"])
    except AnalysisException:
        return False


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and the text of malformed lines."""
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select(F.col("value").alias("line"))


def first_two_columns(spark: SparkSession, path: str) -> DataFrame:
    """The first two CSV columns as `value` and `simple`."""
    df = spark.read.options(**CSV_OPTIONS).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:2]]).toDF("value", "simple")


def write_ordered(df: DataFrame, path: str, pos: str = "pos") -> None:
    """JSON rows in order of `pos`, which stays a column so that readers can restore the order."""
    df.orderBy(pos).write.json(path)


def read_ordered(spark: SparkSession, path: str, schema: str, pos: str = "pos") -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(pos)


def source_name(folders: bool = False):
    """Name of the file a row comes from, or of the folder that the file lies in."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if folders else F.col("_metadata.file_name")


def count_lines(spark: SparkSession, path: str, name_part: str = "test", folders: bool = False) -> DataFrame:
    """Lines of the files whose name (or, with `folders`, whose folder's name) holds `name_part`."""
    lines = spark.read.text(path).select(source_name(folders).alias("file"))
    return lines.where(F.col("file").contains(name_part)).agg(F.count(F.lit(1)).alias("n_lines"))
