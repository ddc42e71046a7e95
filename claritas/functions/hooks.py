"""Plug a user's model, encoder or tokenizer into a job. No model is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def apply_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """`make()` runs once per Python worker task and returns a function from batch to batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(scan, schema)


def generate(df: DataFrame, make: Callable[[], Callable[[str, str], str]], keys: list[str]) -> DataFrame:
    """`make()` gives (system_prompt, user_prompt) -> text; the result column is `output`."""

    def build():
        model = make()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            out = [model(s, u) for s, u in zip(batch["system_prompt"], batch["user_prompt"])]
            return batch[keys].assign(output=out)

        return run

    picked = df.select(*keys, "system_prompt", "user_prompt")
    kinds = dict(picked.dtypes)
    return apply_model(picked, build, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "output string"]))


def encode(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], text: str, keys: list[str]) -> DataFrame:
    """`make()` gives texts -> vectors; the result column is `embedding`."""

    def build():
        model = make()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            return batch[keys].assign(embedding=list(model(batch[text].tolist())))

        return run

    picked = df.select(*keys, text)
    kinds = dict(picked.dtypes)
    return apply_model(picked, build, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "embedding array<float>"]))
