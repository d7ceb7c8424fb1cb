"""Incremental indexing: new chunks arrive as a stream, postings and lengths grow by appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sparse


def append(batch: DataFrame, path: str, batch_id: int) -> None:
    """A batch's postings and lengths, in folders of its own: a repeated batch writes over itself."""
    part = sparse.index(batch)
    part.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
    part.lengths.write.mode("overwrite").parquet(f"{path}/lengths/batch={batch_id}")


def ingest(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Indexes a stream of (chunk_key, text) until it is stopped; with what is there now if triggered so."""
    writer = chunks.writeStream.foreachBatch(lambda df, i: append(df, path, i)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def opened(spark: SparkSession, path: str) -> sparse.SparseIndex:
    """The index over all batches so far. Document frequencies and mean lengths are sums over the parts, never means of means.
    A chunk that came again with a later batch counts with its last version."""
    lengths = spark.read.parquet(f"{path}/lengths")
    last = lengths.groupBy("chunk_key").agg(F.max("batch").alias("batch"))
    keep = lambda part: spark.read.parquet(f"{path}/{part}").join(last, ["chunk_key", "batch"], "left_semi").drop("batch")
    return sparse.of_parts(keep("postings"), keep("lengths"))
