"""Tables of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL = 256 << 20


def table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """The table. spread: rows of a small one, which may lie in a single row group, are dealt out to all cores, for work that
    costs more than moving them; a table of more than SMALL bytes is read as it lies."""
    rows = spark.read.parquet(path)
    if spread and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows
