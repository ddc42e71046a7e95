"""Queries of this subpackage: a Spark callable and, where SQL can say it, the same result as SQL text."""

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
