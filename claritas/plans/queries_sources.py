"""Scans and sinks: each query writes the given table in the format at hand and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.functions.fixed import BRACKET_TOKENS
from claritas.operators.corpus import assign_positions, split_counts, test_files_first
from claritas.operators.retrieval import index_gaps
from claritas.plans import fixtures as fx
from claritas.plans.registry import query, table
from claritas.session import scratch_path
from claritas.sources import corpora, logs, sheets, vector_index

SPLIT = f"{fx.sql_list(fx.SPLITS)}[CAST(doc_id % 3 AS INT) + 1]"


def _documents(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.withColumn("split", fx.pick(fx.SPLITS, F.col("doc_id") % 3)).withColumn(
        "note", F.concat_ws(" ", "source", "lang")
    )


def _digests(df, *keys):
    return df.select(*keys, F.md5("src").alias("src_md5"), F.md5("dst").alias("dst_md5"))


def _split_files(spark, df, fmt, name):
    path = scratch_path(spark, name)
    writer = df.write.partitionBy("split")
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', quoteAll=True)
    writer.format(fmt).save(path)
    return {s: f"{path}/split={s}" for s in fx.SPLITS}


@query(
    "s1_json_splits",
    f"SELECT doc_id, {SPLIT} AS split, md5(text) AS src_md5, md5(source || ' ' || lang) AS dst_md5 FROM documents",
)
def s1(spark, folder):
    staged = _documents(spark, folder).selectExpr("doc_id", "text AS original", "note AS falc", "split")
    paths = _split_files(spark, staged, "json", "s1")
    columns = {"doc_id": "bigint", "original": "string", "falc": "string"}
    return _digests(corpora.load_json_corpus(spark, paths, columns=columns), "doc_id", "split")


INJECTED = "replace(text, ' the ', ' -LRB- the -RRB- ')"


@query(
    "s2_csv_splits",
    f"""SELECT {SPLIT} AS split, md5(regexp_replace({INJECTED}, '{BRACKET_TOKENS}', '', 'g')) AS src_md5,
               md5(regexp_replace('LRB ' || source || ' -RRB-', '{BRACKET_TOKENS}', '', 'g')) AS dst_md5
        FROM documents""",
)
def s2(spark, folder):
    docs = _documents(spark, folder)
    original = F.replace("text", F.lit(" the "), F.lit(" -LRB- the -RRB- ")).alias("original")
    simple = F.concat(F.lit("LRB "), "source", F.lit(" -RRB-")).alias("simple")
    staged = docs.select(original, simple, F.col("lang").alias("simple1"), "split")
    loaded = corpora.load_csv_corpus(spark, _split_files(spark, staged, "csv", "s2"))
    return _digests(loaded, "split")


@query("s3_test_only", "SELECT 'test' AS split, md5(text) AS src_md5, md5('easy ' || text) AS dst_md5 FROM benchmark")
def s3(spark, folder):
    path = scratch_path(spark, "s3")
    items = table(spark, folder, "benchmark")
    items.select(F.col("item_id").alias("id"), F.col("text").alias("original"), F.concat(F.lit("easy "), "text").alias("falc")).write.json(path)
    columns = {"id": "bigint", "original": "string", "falc": "string"}
    loaded = corpora.load_test_only_corpus(spark, path, columns=columns)
    assert "id" not in loaded.columns
    return _digests(loaded, "split")


@query(
    "s4_summary_corpus",
    f"WITH {fx.PAIRS} SELECT 'train' AS split, pair_id, md5(src) AS src_md5, md5(ref) AS dst_md5 FROM pairs",
)
def s4(spark, folder):
    path = scratch_path(spark, "s4")
    fx.pairs(spark, folder).selectExpr("pair_id", "src AS text", "ref AS summary").write.parquet(path)
    return _digests(corpora.load_summary_corpus(spark, {"train": path}), "split", "pair_id")


def _by_language(lang):
    def load(spark, folder):
        docs = _documents(spark, folder).where(F.col("lang") == lang)
        return docs.selectExpr("doc_id", "split", "text AS src", "note AS dst")

    return load


for _lang in ("fr", "de", "es", "en"):
    corpora.register_corpus(f"documents_{_lang}", _by_language(_lang))


@query(
    "s5_corpus_registry",
    f"""SELECT doc_id, 'documents_' || lang AS task, {SPLIT} AS split, md5(text) AS src_md5, md5(source || ' ' || lang) AS dst_md5
        FROM documents WHERE lang IN ('fr', 'en')""",
)
def s5(spark, folder):
    return _digests(corpora.load_tasks(spark, folder, ["documents_fr", "documents_en"]), "doc_id", "task", "split")


@query("s6_snapshot", f"SELECT lang AS task, {SPLIT} AS split, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def s6(spark, folder):
    path = scratch_path(spark, "s6")

    def build():
        return _documents(spark, folder).selectExpr("lang AS task", "split", "doc_id", "text AS src", "n_chars")

    rows = _documents(spark, folder).count()
    corpora.cached(spark, path, build, rows=rows)
    again = corpora.cached(spark, path, build, rows=rows)
    return again.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


BROKEN = "CASE WHEN event_id % 7 = 0 THEN '{\"k\": ' ELSE props END"


@query(
    "s7_json_lines",
    f"""SELECT k, n, bad FROM (
          SELECT CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS k, count(*) AS n, 0 AS bad
          FROM events WHERE event_id % 7 <> 0 GROUP BY 1
          UNION ALL SELECT NULL, count(*), 1 FROM events WHERE event_id % 7 = 0)""",
)
def s7(spark, folder):
    path = scratch_path(spark, "s7")
    table(spark, folder, "events").selectExpr(f"{BROKEN} AS value").write.text(path)
    good, bad = corpora.read_json_lines(spark, path, "k int")
    counted = good.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("bad", F.lit(0))
    rejected = bad.agg(F.count(F.lit(1)).alias("n")).withColumn("bad", F.lit(1))
    return counted.unionByName(rejected, allowMissingColumns=True)


@query("s8_first_two_columns", "SELECT CAST(doc_id AS VARCHAR) AS value, md5(text) AS simple FROM documents")
def s8(spark, folder):
    path = scratch_path(spark, "s8")
    staged = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    staged.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    return corpora.first_two_columns(spark, path).withColumn("simple", F.md5("simple"))


@query("s9_ordered_json", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, md5(text) AS text_md5 FROM documents")
def s9(spark, folder):
    path = scratch_path(spark, "s9")
    numbered = assign_positions(table(spark, folder, "documents").select("doc_id", "text"), [], ["doc_id"])
    corpora.write_ordered(numbered, path)
    back = corpora.read_ordered(spark, path, "pos bigint, doc_id bigint, text string")
    return back.select("pos", "doc_id", F.md5("text").alias("text_md5"))


@query(
    "s10_keyed_csv",
    f"""WITH {fx.SYSTEMS} SELECT row_number() OVER (ORDER BY conv_id, turn, system) - 1 AS id, model, split AS test_set, turn AS input_id, md5(pred || chr(10) || src) AS value_md5
        FROM systems""",
)
def s10(spark, folder):
    path = scratch_path(spark, "s10")
    rows = fx.systems(spark, folder).withColumn("value", F.concat_ws("\n", "pred", "src"))
    numbered = assign_positions(rows, [], ["conv_id", "turn", "system"]).selectExpr("pos AS id", "model", "split AS test_set", "turn AS input_id", "value")
    numbered.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    back = sheets.read_keyed(spark, path, "id bigint, model string, test_set string, input_id bigint, value string")
    return back.select("id", "model", "test_set", "input_id", F.md5("value").alias("value_md5"))


@query("s11_csv_sink", f"WITH {fx.ANNOT} SELECT sample_id, annotator_id, criterion, answer FROM answers")
def s11(spark, folder):
    path = scratch_path(spark, "s11")
    sheets.write_by(fx.answers(spark, folder), path, "annotator_id")
    schema = "sample_id int, criterion string, answer string, annotator_id bigint"
    return sheets.read_keyed(spark, path, schema)


@query(
    "s12_many_sheets",
    f"""WITH {fx.ANNOT} SELECT sample_id, criterion, answer, CASE WHEN annotator_id % 2 = 1 THEN 'odd' ELSE 'even' END AS file_annotator,
               CASE WHEN annotator_id % 2 = 1 THEN annotator_id END AS extra FROM answers""",
)
def s12(spark, folder):
    path = scratch_path(spark, "s12")
    rows = fx.answers(spark, folder)
    for name, rest, extra in (("odd", 1, True), ("even", 0, False)):
        part = rows.where(F.col("annotator_id") % 2 == rest)
        part = part.withColumnRenamed("annotator_id", "extra") if extra else part.drop("annotator_id")
        # an index column without a name, as spreadsheets export it
        part = part.select(F.lit(0).alias("Unnamed: 0"), "*")
        part.withColumn("name", F.lit(name)).write.options(header=True, quoteAll=True).partitionBy("name").csv(f"{path}/{name}")
    # Spark names the files itself; the folders stand for the annotators' files
    named = sheets.read_all_sheets(spark, [f"{path}/odd/name=odd", f"{path}/even/name=even"], separator="=", folders=True)
    return named.select(
        F.col("sample_id").cast("int").alias("sample_id"), "criterion", "answer", "file_annotator", F.col("extra").cast("bigint").alias("extra")
    )


def _sheet_files(spark, folder):
    """Sheets of two annotators, one with a ragged row, one without the sample column, and a path that is not there."""
    path = scratch_path(spark, "s12-files")
    rows = fx.answers(spark, folder)
    for name, rest in (("odd", 1), ("even", 0)):
        part = rows.where(F.col("annotator_id") % 2 == rest).select("sample_id", "criterion", "answer")
        part.coalesce(1).write.options(header=True, quoteAll=True).csv(f"{path}/name={name}")
    lines = rows.select(F.concat_ws(",", "sample_id", "criterion", F.lit('"a"')).alias("line"))
    ragged = spark.range(1).select(F.explode(F.array(F.lit("sample_id,criterion,answer"), F.lit('1,click,"Oui"'), F.lit('2,click,"Non",extra'))).alias("line"))
    ragged.coalesce(1).write.text(f"{path}/name=ragged")
    spark.range(1).select(F.lit("other,columns").alias("line")).unionByName(lines.where("line LIKE '1,%'")).coalesce(1).write.text(f"{path}/name=other")
    return [f"{path}/name={n}" for n in ("odd", "even", "ragged", "other", "missing")]


@query("s12_tolerant_scan", f"WITH {fx.ANNOT} SELECT sample_id, criterion, answer, CASE WHEN annotator_id % 2 = 1 THEN 'odd' ELSE 'even' END AS file_annotator FROM answers")
def s12_tolerant(spark, folder):
    found, _ = sheets.scan_sheets(spark, _sheet_files(spark, folder), ["sample_id"], separator="=", folders=True)
    return found.select(F.col("sample_id").cast("int").alias("sample_id"), "criterion", "answer", "file_annotator")


@query(
    "s12_sheet_ledger",
    f"""WITH {fx.ANNOT} SELECT CASE WHEN annotator_id % 2 = 1 THEN 'odd' ELSE 'even' END AS name, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS reason FROM answers GROUP BY ALL
        UNION ALL SELECT 'ragged', 2, '1 rows of another length' UNION ALL SELECT 'missing', 0, 'PATH_NOT_FOUND'
        UNION ALL SELECT 'other', count(*), 'lacks sample_id' FROM answers WHERE CAST(sample_id AS VARCHAR) = '1'""",
)
def s12_ledger(spark, folder):
    _, ledger = sheets.scan_sheets(spark, _sheet_files(spark, folder), ["sample_id"], separator="=", folders=True)
    return ledger.select(F.element_at(F.split("path", "="), -1).alias("name"), "n_rows", "reason")


@query(
    "s13_prediction_sink",
    f"WITH {fx.SYSTEMS} SELECT pair_id, system, split, task, turn AS step, md5(pred) AS pred_md5 FROM systems",
)
def s13(spark, folder):
    path = scratch_path(spark, "s13")
    rows = fx.systems(spark, folder).selectExpr("pair_id", "system", "pred", "ref", "src", "split", "task", "turn AS step")
    logs.write_predictions(rows, path)
    schema = "pair_id string, system string, pred string, step bigint, split string, task string"
    back = spark.read.schema(schema).json(path)
    return back.select("pair_id", "system", "split", "task", "step", F.md5("pred").alias("pred_md5"))


@query(
    "s14_trial_logs",
    """SELECT 'trial_' || user_id % 40 AS trial_id, event_id AS iteration, event_type AS metric, round(value, 6) AS value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id DESC) = 1""",
)
def s14(spark, folder):
    path = scratch_path(spark, "s14")
    rows = table(spark, folder, "events").withColumn("folder", F.concat(F.lit("trial_"), F.col("user_id") % 40))
    rows.selectExpr("event_id AS iteration", "event_type AS metric", "value", "folder").repartition("folder").write.option("header", True).partitionBy("folder").csv(path)
    log = logs.read_progress(spark, path, "iteration bigint, metric string, value double, folder string")
    log = log.withColumn("trial_id", F.regexp_replace("trial_id", "^folder=", "")).drop("folder")
    return logs.last_iterations(log).select("trial_id", "iteration", "metric", F.round("value", 6).alias("value"))


@query("s15_count_test_lines", f"SELECT count(*) AS n_lines FROM documents WHERE {SPLIT} = 'test'")
def s15(spark, folder):
    path = scratch_path(spark, "s15")
    docs = _documents(spark, folder)
    # Split folders stand for split files.
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value"), "split").write.partitionBy("split").text(path)
    return corpora.count_lines(spark, path, "split=test", folders=True)


@query(
    "s16_embedding_snapshot",
    """SELECT vec_id AS pos, 'vector' AS missing FROM embeddings WHERE vec_id % 11 = 0
       UNION ALL SELECT vec_id AS pos, 'row' AS missing FROM embeddings WHERE vec_id % 13 = 0 AND vec_id % 11 <> 0""",
)
def s16(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", (F.col("label") % 3).alias("task"))
    stored = corpora.snapshot(vectors.where("pos % 11 <> 0"), scratch_path(spark, "s16"), by=("task",))
    rows = vectors.where("pos % 13 <> 0 OR pos % 11 = 0")
    return index_gaps(rows, stored, ["pos"])


@query(
    "s16_incremental_index",
    """SELECT vec_id AS pos, CAST(CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 2 ELSE 1 END AS INTEGER) AS run,
              CASE WHEN vec_id % 7 = 0 THEN 'new ' ELSE 'old ' END || label AS content, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS size
       FROM embeddings WHERE vec_id % 13 <> 0""",
)
def s16_incremental(spark, folder):
    stored = table(spark, folder, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", "label")
    path = scratch_path(spark, "s16-index")

    def rows(changed):
        text = F.concat(F.when(changed, "new ").otherwise("old "), F.col("label").cast("string"))
        return stored.select("pos", text.alias("content"))

    def encode(df):
        return df.join(stored.select("pos", "embedding"), "pos")

    vector_index.refresh(rows(F.lit(False)).where("pos % 11 <> 0"), path, ["pos"], encode)
    # a seventh of the rows changes, a thirteenth goes, an eleventh is new: only these are encoded
    second = rows(F.col("pos") % 7 == 0).where("pos % 13 <> 0")
    vector_index.refresh(second, path, ["pos"], encode)
    size = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    live = vector_index.vectors(spark, path).select("pos", F.col("segment").cast("int").alias("run"), F.round(size, 6).alias("size"))
    return live.join(second, "pos").select("pos", "run", "content", "size")


@query(
    "s17_sheet_records",
    f"""WITH {fx.ANNOT}, kept AS (SELECT * FROM answers WHERE NOT (sample_id % 5 = 0 AND criterion = 'error'))
        SELECT sample_id, annotator_id, {", ".join(f"max(CASE WHEN criterion = '{c}' THEN answer END) AS {c}" for c in ("click", "error", "purchase", "signup", "view"))}
        FROM kept GROUP BY sample_id, annotator_id""",
)
def s17(spark, folder):
    rows = fx.answers(spark, folder)
    flag = F.when((F.col("sample_id") % 5 == 0) & (F.col("criterion") == "error"), "TRUE").otherwise("FALSE")
    return sheets.sheet_records(rows.withColumn("skip", flag), ["click", "error", "purchase", "signup", "view"])


@query(
    "q1_row_counts",
    "SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM labels) AS n_right, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS equal",
)
def q1(spark, folder):
    from claritas.operators.checks import row_counts

    return row_counts(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "q2_split_counts",
    f"SELECT lang AS task, {SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL",
)
def q2(spark, folder):
    from claritas.operators.checks import require_columns

    docs = _documents(spark, folder).selectExpr("lang AS task", "split", "text AS src", "note AS dst")
    return split_counts(require_columns(docs, ["task", "split", "src", "dst"]))


@query(
    "q3_missing_metrics",
    """SELECT DISTINCT e.user_id AS run, t.event_type AS metric FROM events e, (SELECT DISTINCT event_type FROM events) t
       WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = t.event_type AND x.value >= 60)""",
)
def q3(spark, folder):
    from claritas.operators.checks import missing_metrics

    log = fx.trials(spark, folder, steps=False)
    runs = log.select("run").distinct()
    expected = runs.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in ("click", "error", "purchase", "signup", "view")])))
    return missing_metrics(expected, log.where("value >= 60"), ["run", "metric"])


@query(
    "t4_test_files_first",
    "SELECT doc_id, source, CASE WHEN source LIKE '%1%' THEN 'test_' || source ELSE source END AS file, CASE WHEN source LIKE '%1%' THEN 0 ELSE 1 END AS scan_group FROM documents",
)
def t4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    file = F.when(F.col("source").contains("1"), F.concat(F.lit("test_"), "source")).otherwise(F.col("source"))
    return test_files_first(docs.withColumn("file", file), "file", "doc_id")


@query(
    "h1_own_corpus_loader",
    "SELECT item_id, 'benchmark_easy' AS task, 'test' AS split, md5(text) AS src_md5, md5('easy ' || text) AS dst_md5 FROM benchmark",
)
def h1(spark, folder):
    def load(session, location):
        items = table(session, location, "benchmark")
        return items.select("item_id", F.lit("test").alias("split"), F.col("text").alias("src"), F.concat(F.lit("easy "), "text").alias("dst"))

    corpora.register_corpus("benchmark_easy", load)
    return _digests(corpora.load_tasks(spark, folder, ["benchmark_easy"]), "item_id", "task", "split")
