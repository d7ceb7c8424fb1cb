"""Sequence packing: shortest pack first over the histogram of piece lengths.

The histogram has at most `capacity` lengths, whatever the corpus, so the placement itself is a small computation on the
driver. It fixes, for each length, which ranks go to which run of sequences; the pieces then find their place by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenizing import encoder

END_ID = 1


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset).

    Longest lengths come first. Each goes to the packs with the most free space, one piece to each, while one has room;
    what is left opens new packs, each filled with as many pieces of that length as fit. All packs alike are one
    pattern: a run of sequence numbers with a count, split when only a part of it gets a piece. Each step adds one
    pattern by a split and two by opening at most, so there are no more than 3 x capacity patterns at a time.
    """
    free: dict[int, list[list[int]]] = {}
    order: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(space: int, first: int, count: int) -> None:
        if not space:
            return
        if space not in free:
            free[space] = []
            insort(order, space)
        runs = free[space]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += count
        else:
            runs.append([first, count])

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = histogram[length], 0
        while left and order and order[-1] >= length:
            space = order[-1]
            runs = free[space]
            first, count = runs[-1]
            n = min(left, count)
            if n == count:
                runs.pop()
                if not runs:
                    del free[space]
                    order.pop()
            else:
                runs[-1] = [first + n, count - n]
            out.append((length, rank, n, first, capacity - space))
            put(space - length, first, n)
            left, rank = left - n, rank + n
        each = capacity // length
        for depth, packs in ((each, left // each), (left % each, 1)):
            if depth and packs:
                for i in range(depth):
                    out.append((length, rank, packs, sequences, i * length))
                    rank += packs
                put(capacity - depth * length, sequences, packs)
                sequences += packs
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut every `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens[, ids]."""
    ids_field = [pa.field("ids", pa.binary())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), *ids_field])
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer_path, True)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part) if with_ids else (doc, start, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), common.whole(text_column).alias("text")).mapInArrow(cut, types)


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut with sequence_id and offset. cut is read twice and should be a written table.

    A piece's rank among those of its length: pieces are dealt into buckets by id, ranked in their bucket, and moved up by
    the number of pieces of that length in the buckets before. No task gets all pieces of a frequent length.
    """
    spark = cut.sparkSession
    n = common.partitions(spark)
    dealt = cut.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    counts = dealt.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("count_"))
    before = counts.select("length", "bucket_", (F.sum("count_").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("count_")).alias("before_"))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    placed = sorted(shortest_pack_first(histogram, capacity))
    slots = spark.sparkContext.broadcast(np.asarray(placed, dtype=np.int64).reshape(-1, 5))
    ranked = dealt.withColumn("row_", F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket_"]).withColumn("rank_", F.col("row_") - 1 + F.col("before_")).drop("row_", "before_", "bucket_")
    columns = [c for c in ranked.columns if c != "rank_"]

    def assign(batches):
        s = slots.value
        keys = s[:, 0] * (1 << 44) + s[:, 1] if len(s) else None
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank_")).to_numpy(zero_copy_only=False)
            if len(length):
                at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
                sequence, offset = s[at, 3] + rank - s[at, 1], s[at, 4]
            else:
                sequence = offset = np.zeros(0, np.int64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    types = ", ".join(f"`{c}` {dict(ranked.dtypes)[c]}" for c in columns)
    order = ["doc_id", "start", *[c for c in cut.columns if c not in ("doc_id", "start")], "sequence_id", "offset"]
    return ranked.mapInArrow(assign, f"{types}, sequence_id long, offset long").select(*order)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False, **columns: str) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` ids.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset. A null or empty text
    is the end id alone; a null id is kept as null; repeated rows are packed each for itself, ties in any order among
    equal rows; an empty table gives no rows; other columns are not looked at.
    """
    return place(common.written(pieces(docs, tokenizer_path, capacity, with_ids=with_ids, **columns)), capacity)
