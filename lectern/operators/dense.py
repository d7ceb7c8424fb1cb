"""Exact dense search: inner products of query vectors with all chunk vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
SHARD_ROWS = 32768  # vectors that a task holds
BLOCK_ROWS = 256  # queries that meet them at a time


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shards: int | None = None) -> DataFrame:
    """query_id, chunk_key, score, rank of (chunk_key, vector) and (query_id, vector): the k largest inner products.

    Vectors are dealt into shards of about SHARD_ROWS; the queries go to each, the shard keeps its own k best, and the shards'
    results are merged by rank. Scores are compared after rounding to 6 places; ties go to the smaller key. All vectors have
    one dimension; null ones take no part.
    """
    n = shards or max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // SHARD_ROWS))
    side = vectors.where("vector IS NOT NULL").select(F.pmod(F.xxhash64("chunk_key"), F.lit(n)).cast("int").alias("shard"), F.col("chunk_key").cast("long"), F.col("vector").cast("array<double>"))
    asked = queries.where("vector IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    out = pa.schema([("query_id", pa.int64()), ("chunk_key", pa.int64()), ("score", pa.float64())])

    def best(side, asked):
        if not side.num_rows or not asked.num_rows:
            return out.empty_table()
        stack = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        keys = side.column("chunk_key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, matrix = keys[order], stack(side)[order]
        ids, q = asked.column("query_id").to_numpy(), stack(asked)
        parts: list[tuple] = []
        for at in range(0, len(ids), BLOCK_ROWS):
            scores = np.round(q[at : at + BLOCK_ROWS] @ matrix.T, DIGITS)
            for own, s in zip(ids[at : at + BLOCK_ROWS], scores):
                among = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                top = among[np.argsort(-s[among], kind="stable")[:k]]  # keys ascend, so ties keep the smaller
                parts.append((np.repeat(own, len(top)), keys[top], s[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=out)

    found = side.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(best, "query_id long, chunk_key long, score double")
    return ranked(found, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stats(vectors: DataFrame, model_name: str) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("num_vectors"), F.count_distinct("chunk_key").alias("num_chunks"), F.max(F.size("vector")).alias("dim")).withColumn("model", F.lit(model_name))
