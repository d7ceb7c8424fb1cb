"""Reciprocal rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K = 60


def fuse(lists: list[DataFrame], k: int = K, top: int = 20) -> DataFrame:
    """query_id, chunk_key, score, rank, found_by of ranked lists (query_id, chunk_key, rank): sum of 1 / (k + rank).

    found_by names list and rank, in the order of the lists; ties go to what the first list ranks first, then the second.
    A list has a chunk once for a query.
    """
    every = None
    for i, hits in enumerate(lists):
        part = hits.select("query_id", "chunk_key", F.col("rank").alias(f"rank_{i}"))
        every = part if every is None else every.join(part, ["query_id", "chunk_key"], "full_outer")
    at = F.filter(F.array(*(F.struct(F.lit(i).alias("method"), F.col(f"rank_{i}").alias("rank")) for i in range(len(lists)))), lambda x: x["rank"].isNotNull())
    score = F.aggregate("at", F.lit(0.0), lambda s, x: s + 1 / (k + x["rank"]))
    grouped = every.select("query_id", "chunk_key", at.alias("at")).withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.col("at")[0], "chunk_key")
    names = F.transform("at", lambda x: F.concat(F.lit("method_"), x["method"], F.lit("@"), x["rank"]))
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "chunk_key", "score", "rank", names.alias("found_by"))


class Reranker(Protocol):
    """What a cross-encoder has to offer: loaded once in each worker, called with pairs."""

    def load(self) -> object: ...

    def score(self, model: object, queries: list[str], texts: list[str]) -> list[float]: ...


class CrossEncoderReranker:
    """Adapter for an optional library; it has to be on the executors."""

    def __init__(self, name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
        self.name = name

    def load(self) -> object:
        from sentence_transformers import CrossEncoder

        return CrossEncoder(self.name)

    def score(self, model: object, queries: list[str], texts: list[str]) -> list[float]:
        return [float(x) for x in model.predict(list(zip(queries, texts)))]


def rerank(hits: DataFrame, reranker: Reranker | None = None, top: int = 5) -> DataFrame:
    """hits (query_id, query, chunk_key, text, rank, ...) with rerank_score, original_rank and new ranks; ties keep their order.

    Without a reranker the share of the query's tokens that the text has stands in.
    """
    if reranker is None:
        asked = F.array_distinct(T.tokens(F.col("query")))
        score = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, T.tokens(F.col("text")))), F.size(asked)), F.lit(0.0))
    else:

        @F.pandas_udf("double")
        def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = reranker.load()
            for q, t in pairs:
                yield pd.Series(reranker.score(model, q.tolist(), t.tolist()))

        score = run("query", "text")
    scored = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "original_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "original_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def moved(reranked: DataFrame) -> DataFrame:
    """query_id, moved, total: how many hits changed their rank."""
    return reranked.groupBy("query_id").agg(F.count_if(F.col("original_rank") != F.col("rank")).alias("moved"), F.count(F.lit(1)).alias("total"))
