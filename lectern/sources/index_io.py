"""Saved indexes: chunk vectors, postings and lengths as Parquet, and a small table that says what they are of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import sparse

CONFIG = "model_name string, dim int, num_chunks long, fingerprint string"


@dataclass
class Index:
    chunks: DataFrame  # chunk_key, text, section, vector
    sparse: sparse.SparseIndex
    model_name: str
    dim: int


def save(index: Index, path: str, fingerprint: str = "") -> None:
    spark = index.chunks.sparkSession
    index.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    index.sparse.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.sparse.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    n = spark.read.parquet(f"{path}/chunks").count()
    config = spark.createDataFrame([(index.model_name, index.dim, n, fingerprint)], CONFIG)
    config.coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load(spark: SparkSession, path: str, dim: int | None = None) -> Index:
    """A dimension other than the expected one raises."""
    config = spark.read.schema(CONFIG).json(f"{path}/config").first()
    if dim is not None and dim != config["dim"]:
        raise ValueError(f"the index has vectors of {config['dim']} dimensions, not {dim}")
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    return Index(read("chunks"), sparse.of_parts(read("postings"), read("lengths")), config["model_name"], config["dim"])


def fingerprint(docs: DataFrame) -> str:
    """Of all rows, in any order; equal rows count each. Columns are told apart by place, nulls by a mark of their own."""
    columns = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    total = lambda *first: F.sum(F.xxhash64(*first, *columns).cast("decimal(38,0)"))
    r = docs.agg(F.count(F.lit(1)).alias("n"), total().alias("x"), total(F.lit(1)).alias("y")).first()
    return f"{r['n']}-{r['x'] or 0}-{r['y'] or 0}"


def added(index: Index, chunks: DataFrame) -> Index:
    """The index with more chunks (chunk_key, text, section, vector), whose keys are new; document frequencies and lengths are
    those of all."""
    if chunks.where(F.size("vector") != index.dim).count():
        raise ValueError(f"the index has vectors of {index.dim} dimensions")
    more = sparse.index(chunks)
    both = sparse.of_parts(index.sparse.postings.unionByName(more.postings), index.sparse.lengths.unionByName(more.lengths))
    return Index(index.chunks.unionByName(chunks.select(*index.chunks.columns)), both, index.model_name, index.dim)


def append(spark: SparkSession, path: str, chunks: DataFrame, fingerprint: str = "") -> Index:
    """Adds chunks to a saved index; only theirs are written. The config, written last, has the number of all."""
    old = load(spark, path)
    n, part = added(old, chunks).chunks.count(), sparse.index(chunks)
    chunks.select(*old.chunks.columns).write.mode("append").parquet(f"{path}/chunks")
    part.postings.write.mode("append").parquet(f"{path}/postings")
    part.lengths.write.mode("append").parquet(f"{path}/lengths")
    config = spark.createDataFrame([(old.model_name, old.dim, n, fingerprint)], CONFIG)
    config.coalesce(1).write.mode("overwrite").json(f"{path}/config")
    return load(spark, path)


def open_or_build(spark: SparkSession, path: str, docs: DataFrame, build: Callable[[DataFrame], Index]) -> Index:
    """The saved index if it is of these documents; otherwise it is built and saved."""
    mark = fingerprint(docs)
    try:
        config = spark.read.schema("fingerprint string").json(f"{path}/config").first()
    except AnalysisException:
        config = None
    if config is None or config["fingerprint"] != mark:
        save(build(docs), path, mark)
    return load(spark, path)
