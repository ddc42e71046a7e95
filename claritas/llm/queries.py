"""The registered queries: each applies its operator to the whole table with production parameters."""

from pyspark.sql import functions as F

import corpus_pipeline
from claritas.llm import chat, decontamination, fingerprints, jaccard, licenses, mixing, negatives, ngram_lm, quality, secrets, suffix_merge, whitening, wrappers
from claritas.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from claritas.llm.sql import OP1_SQL, OP6_SQL, OP7_SQL, OP9_SQL, OP10_SQL, OP12_SQL, OP13_SQL

@query("op1_decontamination", OP1_SQL)
def op1(spark, folder):
    found = decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"], n=10)
    return decontamination.report(found)


@query("op2_quality")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_mixing")
def op3(spark, folder):
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), ["doc_id"])


@query("op4_licenses")
def op4(spark, folder):
    return licenses.scan(table(spark, folder, "documents"), ["doc_id"]).drop("runs")


@query("op5_suffix_merge")
def op5(spark, folder):
    return suffix_merge.dedup(table(spark, folder, "documents"), ["doc_id"], length=400)


@query("op6_jaccard_join", OP6_SQL)
def op6(spark, folder):
    return jaccard.similar(table(spark, folder, "documents"), n=4, num=85, den=100)


@query("op7_secrets", OP7_SQL)
def op7(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


@query("op8_fingerprints")
def op8(spark, folder):
    return fingerprints.compare_next(table(spark, folder, "documents"))


@query("op9_kneser_ney", OP9_SQL)
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))
    model = ngram_lm.fit(docs.where("NOT held_out"))
    scored = ngram_lm.score(docs, model, ["doc_id", "held_out"])
    rounded = {c: F.round(c, 6) for c in ("base_score", "score")}  # sums of logarithms: their last digits follow the order of adding
    return scored.withColumns(rounded).withColumn("train_tokens", F.lit(model.total).cast("bigint"))


@query("op10_html_wrappers", OP10_SQL)
def op10(spark, folder):
    return wrappers.extract(table(spark, folder, "pages"), ["page_id", "url"])


@query("op11_whitening")
def op11(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = whitening.fit(rows, components=8, scale=1024.0, shift=100_000)
    return whitening.whiten(rows, model, ["vec_id"]).withColumn("deviation", F.col("deviation").cast("bigint"))


@query("op12_chat_prefixes", OP12_SQL)
def op12(spark, folder):
    talks = chat.planted(table(spark, folder, "conversations"), r"\### Assistant: </turn> ok")
    return chat.digest(chat.examples(talks))


@query("op13_segment_negatives", OP13_SQL)
def op13(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0, scale=256.0, positives=5, negatives=5, num=80, den=100)


@query("pipeline")
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
