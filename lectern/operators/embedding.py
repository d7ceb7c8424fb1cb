"""Embedding of texts behind one interface, and a deterministic stand-in that needs no model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import let, runs
from ..functions import text as T
from ..functions.vectors import bucket, dot, normalized


class Embedder(Protocol):
    """What a model has to offer: loaded once in each worker, called with lists of texts."""

    name: str
    dim: int

    def load(self) -> object: ...

    def encode(self, model: object, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, embedder: Embedder, text_column: str = "text", prefix: str = "", normalize: bool = True, batch_size: int = 32) -> DataFrame:
    """rows with `vector`; a prefix goes before each text; vectors have length 1 if asked for."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for batch in texts:
            values = [prefix + (t or "") for t in batch]
            yield pd.Series([v for i in range(0, len(values), batch_size) for v in embedder.encode(model, values[i : i + batch_size])], dtype=object)

    v = run(text_column)
    return rows.withColumn("vector", normalized(v).cast("array<float>") if normalize else v)


class SentenceTransformerEmbedder:
    """Adapter for an optional library; it has to be on the executors."""

    def __init__(self, name: str = "all-MiniLM-L6-v2", dim: int = 384):
        self.name, self.dim = name, dim

    def load(self) -> object:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(self.name)

    def encode(self, model: object, texts: list[str]) -> list[list[float]]:
        return model.encode(texts).astype("float32").tolist()


def hash_embed(rows: DataFrame, key: list[str], dim: int = 64, text_column: str = "text") -> DataFrame:
    """key, vector: hashed bag of tokens, of length 1. A stand-in without knowledge of meaning, for tests and offline use.

    Each row by itself, also of those that share a key.
    """
    places = F.sort_array(F.transform(T.tokens(F.coalesce(F.col(text_column), F.lit(""))), lambda t: bucket(t, dim)))
    n = let(runs(places), lambda r: F.map_from_entries(F.transform(r, lambda x: F.struct(x["value"], x["n"].cast("double")))))
    raw = let(n, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    return rows.select(*key, normalized(raw).alias("vector"))


def neighbour_similarity(vectors: DataFrame, by: str, order: str) -> DataFrame:
    """vectors with sim: product with the vector before, null for the first."""
    return vectors.withColumn("sim", dot(F.lag("vector").over(Window.partitionBy(by).orderBy(order)), F.col("vector")))
