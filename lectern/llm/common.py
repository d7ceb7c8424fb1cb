"""Shared folder, written intermediate tables, and the Python path of the executors."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = str(Path(__file__).resolve().parents[2])
_own_folder: list[str] = []
_paths: dict[SparkSession, list[str]] = {}
_owned: dict[tuple[SparkSession, str], list[str]] = {}


def ready(spark: SparkSession) -> None:
    """Lets Python workers of this session import the package that the driver uses, and bounds the batches they get by
    bytes, since a batch of 10 000 long texts takes much memory on both sides. A limit that the user has set stays."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_LIMIT):
        spark.conf.set(BATCH_LIMIT, "4m")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir. Only a session without a cluster may leave it unset, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return _own_folder[0]


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _paths.setdefault(spark, []).append(path)
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all tables of written() of this session. Results that are not yet written or collected still need theirs."""
    for path in _paths.pop(spark, []):
        delete(spark, path)
    for key in [k for k in _owned if k[0] is spark]:
        del _owned[key]


@contextlib.contextmanager
def owned_by(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables of written() that are made inside belong to the owner, until release()."""
    before = len(_paths.get(spark, []))
    yield
    _owned.setdefault((spark, owner), []).extend(_paths.get(spark, [])[before:])


def release(spark: SparkSession, owner: str, reader: DataFrame | None = None) -> None:
    """Deletes the owner's tables, but for those that the reader is yet to read."""
    paths = _owned.get((spark, owner), [])
    if not paths:
        return
    files = reader.inputFiles() if reader is not None else []
    read = {p for p in paths if any(p.rpartition("/")[2] in f for f in files)}
    for p in set(paths) - read:
        delete(spark, p)
        _paths[spark].remove(p)
    _owned[spark, owner] = sorted(read)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later read needs."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "written_path", None)
        if path and path in _paths.get(spark, []):
            delete(spark, path)
            _paths[spark].remove(path)
            for owned in _owned.values():
                if path in owned:
                    owned.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_held: list = []


def lean() -> None:
    """For Python workers, at the start of a task: gives back what earlier tasks of other operators left in this process.

    Workers outlive their tasks, so caches worth keeping between tasks of one operator would add up over a pipeline.
    """
    import ctypes
    import gc

    for cache in _held:
        cache.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept_between_tasks(cache: dict) -> dict:
    """A worker's cache that lean() empties."""
    _held.append(cache)
    return cache


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def whole(name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
