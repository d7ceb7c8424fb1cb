"""Documents packed into compressed chunks.

Operators that meet the texts more than once deal them to chunks once: a chunk is small enough for one task, the same
row always goes to the same chunk, and what other tasks found out about a document reaches it by its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HOLD_BYTES = 12 << 20
TYPES = "chunk int, blob binary"


def _spark_hash(x: int) -> int:
    """Spark's hash of an int column: 32-bit Murmur3, seed 42."""
    m = 0xFFFFFFFF
    turn = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    h = 42 ^ (turn(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m)
    h = (turn(h, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@cache
def labels(n: int) -> tuple[int, ...]:
    """n numbers that Spark deals to n different partitions: the first that goes to each."""
    out: dict[int, int] = {}
    x = 0
    while len(out) < n:
        out.setdefault(_spark_hash(x) % n, x)
        x += 1
    return tuple(out[i] for i in range(n))


def chunk_of(hashed: Column, n: int) -> Column:
    return F.element_at(F.lit(list(labels(n))), (F.pmod(hashed, F.lit(n)) + 1).cast("int"))


def _blob(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs.combine_chunks())
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def opened(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    """The documents of a chunk (doc_id, text), one packed part after the other."""
    d = zstandard.ZstdDecompressor()
    for blob in blobs:
        yield pa.ipc.open_stream(d.decompress(blob.as_py())).read_all()


def packed(docs: DataFrame, n: int, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, blob), dealt by chunk into n partitions. Null texts are empty ones; extra: other columns to keep. A row's chunk
    follows from its id and text, so rows without an id, or of one id, are spread over all chunks."""

    def pack(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.argsort(t.column("chunk").to_numpy(), kind="stable")))
            chunk = t.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a])], pa.int32()), pa.array([_blob(t.drop_columns("chunk").slice(a, b - a))], pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # parts of a batch, should its texts be long
                step = max(1, min(batch.num_rows - at, int(batch.num_rows * HOLD_BYTES / max(1, batch.nbytes))))
                part = batch.slice(at, step)
                at += step
                held.append(part)
                size += step * batch.nbytes // max(1, batch.num_rows)
                if size >= HOLD_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    dealt = chunk_of(F.xxhash64(F.col(id_column).cast("long"), common.whole(text_column)), n)
    rows = docs.select(dealt.alias("chunk"), F.col(id_column).cast("long").alias("doc_id"), common.whole(text_column).alias("text"), *(F.col(f"`{c}`") for c in extra))
    return rows.mapInArrow(pack, TYPES).repartition(n, "chunk")
