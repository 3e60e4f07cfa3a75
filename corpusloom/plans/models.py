"""Model calls as tables: requests meet cached responses; only what is missing goes to a provider.

A provider takes a list of payloads and returns as many answers. It's built once per task by a factory, so models load
on first use; with the answers written to the cache, a rerun asks for nothing twice. Answers are checked by the
predicates of the other modules before they count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, payload) without a response, each key once."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def ask(requests: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32) -> DataFrame:
    """key and response of every request."""

    def run(batches: Iterator[pa.RecordBatch]):
        provider = None
        for rows in batches:
            provider = provider or factory()
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(provider(part.column(1).to_pylist()), pa.string())], ["key", "response"])

    return requests.select(F.col("key").cast("string"), F.col("payload").cast("string")).mapInArrow(run, "key string, response string")


def answered(requests: DataFrame, cache: DataFrame, factory, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """Requests with their responses, and the new cache rows to append."""
    fresh = ask(missing(requests, cache), factory, batch)
    return requests.join(cache.select("key", "response").unionByName(fresh), "key", "left"), fresh


def within_budget(requests: DataFrame, cache: DataFrame, doc: str, pos: str, budget: int) -> DataFrame:
    """Adds state: cached, asked or over_budget; per document the first `budget` uncached requests are asked."""
    known = requests.join(cache.select("key", F.lit(True).alias("_hit")), "key", "left")
    place = F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).over(Window.partitionBy(doc).orderBy(pos))
    return known.withColumn("state", F.when(F.col("_hit"), "cached").when(place <= budget, "asked").otherwise("over_budget")).drop("_hit")


def stale(rows: DataFrame, model: str, vector: str = "embedding", by: str = "embedding_model") -> DataFrame:
    """Rows without a vector, or with another model's."""
    return rows.where(F.col(vector).isNull() | ~F.col(by).eqNullSafe(F.lit(model)))


def embed(texts: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """key and embedding of every text (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        model = None
        for rows in batches:
            model = model or factory()
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(part.column(1).to_pylist()), pa.list_(pa.float32()))], ["key", "embedding"])

    return texts.select(F.col("key").cast("string"), F.col("text").cast("string")).mapInArrow(run, "key string, embedding array<float>")
