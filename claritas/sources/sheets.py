"""Answer sheets and annotator samples: CSV scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritas.functions.text import last_part
from claritas.operators.corpus import drop_matching, union_all
from claritas.operators.human import melt_answers
from claritas.operators.reshape import widen
from claritas.session import written
from claritas.sources.corpora import CSV_OPTIONS, source_name


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with key columns first; cells may hold newlines."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def file_part(separator: str = ".", folders: bool = False):
    """Last part of the file's (or folder's) name without its ending, lower case."""
    name = F.regexp_replace(source_name(folders), r"\.csv$", "")
    return F.lower(last_part(name, separator))


def read_all_sheets(spark: SparkSession, paths: list[str], separator: str = ".", folders: bool = False) -> DataFrame:
    """Sheets of many annotators as one frame.

    Files may differ in index columns, so every path is read by its own header; index
    columns without a name are dropped and missing ones are null.
    """
    frames = []
    for path in paths:
        df = spark.read.options(**CSV_OPTIONS).csv(path)
        named = df.select("*", file_part(separator, folders).alias("file_annotator"))
        frames.append(drop_matching(named, r"Unnamed|^_c\d+$"))
    return union_all(frames)


LEDGER = "path string, file string, n_rows long, reason string"


def scan_sheets(spark: SparkSession, paths: list[str], required: list[str], separator: str = ".", folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """`read_all_sheets` that survives bad files, and a ledger (path, file, n_rows, reason) of all files.

    A file counts as bad, and gives no rows, if a row has more or fewer cells than its header or if its
    header lacks a `required` column; a path that cannot be opened has a line without a file. `reason` is
    null for good files. Files are read once: rows are stored with what is wrong with them.
    """
    frames, unread, opened = [], [], []
    for path in paths:
        try:
            columns = spark.read.options(**CSV_OPTIONS).csv(path).columns
        except AnalysisException as error:
            unread.append((path, None, 0, (error.getCondition() or "UNREADABLE").split(".")[0]))
            continue
        lacking = [c for c in required if c not in columns]
        opened.append((path, "no header" if not columns else f"lacks {', '.join(lacking)}" if lacking else None))
        if not columns:
            continue
        header = ", ".join([*[f"`{c}` string" for c in columns], "_bad string"])
        df = spark.read.options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").schema(header).csv(path)
        named = df.select(
            "*",
            file_part(separator, folders).alias("file_annotator"),
            F.lit(path).alias("_path"),
            F.col("_metadata.file_path").alias("_file"),
            F.lit(opened[-1][1]).cast("string").alias("_lacking"),
        )
        frames.append(drop_matching(named, r"Unnamed|^_c\d+$"))
    if not frames:
        empty = [(path, None, 0, reason) for path, reason in opened]
        return spark.createDataFrame([], "file_annotator string"), spark.createDataFrame([*empty, *unread], LEDGER)
    rows = written(union_all(frames), "sheets")
    ragged = F.count("_bad")
    reason = F.coalesce(F.max("_lacking"), F.when(ragged > 0, F.concat(ragged.cast("string"), F.lit(" rows of another length"))))
    files = rows.groupBy("_path", "_file").agg(F.count(F.lit(1)).alias("n_rows"), reason.alias("reason"))
    # a path whose files hold a header only has a line as well
    read = spark.createDataFrame(opened, "path string, lacking string").join(files, F.col("path") == F.col("_path"), "left")
    read = read.select("path", F.col("_file").alias("file"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("reason", "lacking").alias("reason"))
    ledger = read.unionByName(spark.createDataFrame(unread, LEDGER))
    good = files.where("reason IS NULL").select("_file")
    return rows.join(good, "_file", "left_semi").drop("_bad", "_path", "_file", "_lacking"), ledger


def sheet_records(rows: DataFrame, criteria: list[str], flag: str = "skip") -> DataFrame:
    """Long sheet rows to one record per (sample, annotator), without rows flagged 'do not evaluate'."""
    kept = rows.where(~F.col(flag).cast("boolean"))
    return widen(kept, ["sample_id", "annotator_id"], "criterion", "answer", criteria)


def long_sheets(sheets: DataFrame, ids: list[str], criteria: list[str]) -> DataFrame:
    return melt_answers(sheets, ids, [c for c in criteria if c in sheets.columns])


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """CSV files with header, one folder per key instead of one file each."""
    df.write.options(header=True, quote='"', escape='"', quoteAll=True).partitionBy(*by).csv(path)
