"""Token ids as files of raw payloads, each with a minimal perfect hash index from document key to place.

A file row is a shard: the little-endian unsigned 32-bit ids of a run of documents in ascending key order, and an index
over exactly these documents. The index is hash-and-displace: a key's bucket holds a displacement that sends the keys of
the bucket to free slots of a table with one slot for each document. A slot stores a fingerprint of its key, and the
offset and length of its ids, so a lookup reads one displacement and one slot, and a foreign key is told by its
fingerprint (wrong once in 2^32). Shards are ordinary Parquet rows: any store that Spark writes to can hold them, and a
lost task's shards are written anew by the task that replaces it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import encoder

END_ID = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOAD = 2  # keys in a bucket, on average: fewer make a larger index, more take many tries for the last free slots
_FIELDS = [("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_nulls", pa.int64()), ("keys", pa.binary()), ("displacements", pa.binary()), ("fingerprints", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())]
SCHEMA = "part int, seq int, start_in_part long, n_docs long, n_ids long, n_nulls long, keys binary, displacements binary, fingerprints binary, offsets binary, lengths binary, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def key_hashes(keys: np.ndarray, repeats: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Of (key, how many equal keys stand before it in the shard, whether it is null)."""
    with np.errstate(over="ignore"):
        return _mix(_mix(keys.astype(np.int64).view(np.uint64) + _ODD) + repeats.astype(np.uint64) * _ODD + nulls.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit hashes."""

    def __init__(self, n: int, displacements: np.ndarray):
        self.n, self.displacements = n, displacements

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, (n + _LOAD - 1) // _LOAD)
        home = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        ends = np.cumsum(sizes)
        displacements, taken = np.zeros(buckets, np.int32), bytearray(n)
        by_size = np.argsort(-sizes, kind="stable")
        several = int(np.count_nonzero(sizes > 1))
        own = hashes[order].tolist()
        for b, end, size in zip(by_size[:several].tolist(), ends[by_size[:several]].tolist(), sizes[by_size[:several]].tolist()):
            displacements[b] = cls._displace(own[end - size : end], taken, n)
        single = by_size[several : np.count_nonzero(sizes)]
        displacements[single] = -1 - np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)[: len(single)]
        return cls(n, displacements)

    @staticmethod
    def _displace(own: list[int], taken: bytearray, n: int) -> int:
        """The first displacement that sends all of a bucket's hashes to different free slots, which are then taken."""
        d, all_ones = 0, (1 << 64) - 1
        while True:
            d += 1
            slots = []
            for h in own:
                x = h + d * 0x9E3779B97F4A7C15 & all_ones
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & all_ones
                x = (x ^ x >> 27) * 0x94D049BB133111EB & all_ones
                slot = (x ^ x >> 31) % n
                if taken[slot] or slot in slots:
                    break
                slots.append(slot)
            else:
                for slot in slots:
                    taken[slot] = 1
                return d

    @staticmethod
    def _slots(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(hashes + displacement.astype(np.uint64) * _ODD) % np.uint64(n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -1 - d, self._slots(hashes, np.maximum(d, 0), self.n))


def _repeats(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """keys in order: for each, the equal ones before it."""
    n = len(keys)
    new = np.ones(n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - first


def shard(part: int, seq: int, start: int, keys: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
    nulls = np.array([k is None for k in keys])
    key = np.array([0 if k is None else k for k in keys], np.int64)
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]]).astype("<u4")
    hashes = key_hashes(key, _repeats(key, nulls), nulls)
    index = PerfectHash.build(hashes)
    slots = index.slots(hashes)
    marks, at, size = (np.empty(len(keys), "<u4") for _ in range(3))
    marks[slots], at[slots], size[slots] = (hashes >> np.uint64(32)).astype("<u4"), offsets, lengths
    values = [part, seq, start, len(keys), int(lengths.sum(dtype=np.int64)), int(nulls.sum()), key.astype("<i8").tobytes(), index.displacements.astype("<i4").tobytes(), marks.tobytes(), at.tobytes(), size.tobytes(), b"".join(ids)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS)], schema=pa.schema(_FIELDS))


class Shard:
    """Keyed access to one row of the files."""

    def __init__(self, row: dict):
        self.row = row
        self.index = PerfectHash(row["n_docs"], np.frombuffer(row["displacements"], "<i4"))
        self.marks, self.at, self.size = (np.frombuffer(row[k], "<u4") for k in ("fingerprints", "offsets", "lengths"))
        self.payload = memoryview(row["payload"])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in payload order, and which of them are null."""
        keys = np.frombuffer(self.row["keys"], "<i8")
        return keys, np.arange(len(keys)) < self.row["n_nulls"]

    def owners(self, offsets: np.ndarray) -> np.ndarray:
        """The places, in payload order, of the documents whose ids begin at these offsets."""
        return np.searchsorted(np.sort(self.at), offsets)

    def find(self, keys: np.ndarray, repeats: np.ndarray | None = None, nulls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is here by its fingerprint, offset and length of its ids."""
        none = np.zeros(len(keys), np.int64)
        hashes = key_hashes(keys, none if repeats is None else repeats, none if nulls is None else nulls)
        slots = self.index.slots(hashes)
        return self.marks[slots] == (hashes >> np.uint64(32)).astype(np.uint32), self.at[slots].astype(np.int64), self.size[slots].astype(np.int64)

    def ids(self, offset: int, length: int) -> memoryview:
        return self.payload[4 * offset : 4 * (offset + length)]


def write(docs: DataFrame, path: str, tokenizer_path: str, shard_ids: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes whole texts, each with the end id after it, into files at `path` in ascending key order.

    A null text is an empty one; null keys come first; documents that share a key stand in the order of their texts'
    hashes and each has its entry; an empty table writes no shard; other columns are not looked at. A shard takes
    documents until it holds `shard_ids` ids; a longer document has a shard of its own.
    """
    spark = docs.sparkSession
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def build(batches):
        enc, part = encoder(tokenizer_path, False), TaskContext.get().partitionId()
        keys, ids, seq, start, held = [], [], 0, 0, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = enc.encode(text.as_py()) + end
                if keys and held + len(x) // 4 > shard_ids:
                    yield shard(part, seq, start, keys, ids)
                    keys, ids, seq, start, held = [], [], seq + 1, start + held, 0
                keys.append(key)
                ids.append(x)
                held += len(x) // 4
        if keys:
            yield shard(part, seq, start, keys, ids)

    rows = docs.select(F.col(id_column).cast("long").alias("key"), common.whole(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(common.partitions(spark), "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    ordered.mapInArrow(build, SCHEMA).write.option("compression", "zstd").parquet(path)


def _starts(files: DataFrame) -> dict[int, int]:
    """Ids before each partition of the writing job; one number for each."""
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    out, before = {}, 0
    for part, n in totals:
        out[part], before = before, before + n
    return out


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files, found through its shard's index: doc_id, start, n_tokens, ids_crc32[, ids]."""
    files = spark.read.schema(SCHEMA).parquet(path)
    starts = spark.sparkContext.broadcast(_starts(files))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                keys, nulls = s.keys()
                found, at, size = s.find(keys, _repeats(keys, nulls), nulls)
                if not found.all():
                    raise ValueError(f"shard {row['part']}/{row['seq']} does not find its own keys")
                parts = [bytes(s.ids(a, n)) for a, n in zip(at.tolist(), size.tolist())]
                base = starts.value[row["part"]] + row["start_in_part"]
                columns = [pa.array(keys, pa.int64(), mask=nulls), pa.array(at + base), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if with_ids else []), schema=pa.schema(fields))

    return files.mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """key, ids: of all documents of the given keys, also of those that share a key.

    Keys meet only the shards whose range of keys covers them, which they find by two binary searches: among the stretches of the
    writing job's partitions, then among the shards of theirs. What a fingerprint finds is compared with the stored key.
    Null keys find nothing, repeated ones count once, and a key that no document has gives no row.
    """
    first = np.dtype("<i8").itemsize
    files = spark.read.schema(SCHEMA).parquet(path).where(F.col("n_docs") > F.col("n_nulls"))

    def bounds(batches):
        for batch in batches:
            t = batch.to_pydict()
            own = [np.frombuffer(k[first * n :], "<i8") for k, n in zip(t["keys"], t["n_nulls"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(x[0]) for x in own], pa.int64()), pa.array([int(x[-1]) for x in own], pa.int64())], names=["part", "seq", "low", "high"])

    ranges = files.select("part", "seq", "keys", "n_nulls").mapInArrow(bounds, "part int, seq int, low long, high long")
    by_part = ranges.groupBy("part").agg(F.min("low").alias("part_low"), F.max("high").alias("part_high"))
    edges = np.array(sorted((r["part"], r["part_low"], r["part_high"]) for r in by_part.collect()), np.int64).reshape(-1, 3)  # one for each partition of the writing job
    edges = spark.sparkContext.broadcast(edges)
    wanted = keys.where(F.col(key_column).isNotNull()).select(F.col(key_column).cast("long").alias("key")).distinct()

    def covered(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a key, number of a range) of all ranges that cover a key; ranges in order."""
        a, b = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
        n = np.maximum(b - a, 0)
        of = np.repeat(np.arange(len(keys)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)

    def to_parts(batches):
        e = edges.value
        for batch in batches:
            k = batch.column(0).to_numpy()
            of, at = covered(k, e[:, 1], e[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(k[of]), pa.array(e[at, 0].astype(np.int32))], names=["key", "part"])

    def to_shards(asked, own):
        own = own.sort_by("seq")
        k = asked.column("key").to_numpy()
        of, at = covered(k, own.column("low").to_numpy(), own.column("high").to_numpy())
        part, seq = (own.column(c).to_numpy()[at].astype(np.int32) for c in ("part", "seq"))
        return pa.table({"key": pa.array(k[of], pa.int64()), "part": pa.array(part), "seq": pa.array(seq)})

    homes = wanted.mapInArrow(to_parts, "key long, part int")
    placed = homes.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(to_shards, "key long, part int, seq int")

    def get(rows, asked):
        found_keys, ids = [], []
        if rows.num_rows and asked.num_rows:
            s, k = Shard(rows.to_pylist()[0]), asked.column("key").to_numpy()
            stored, nulls = s.keys()
            repeat = 0
            while len(k):  # the next document of a key, while there is one
                found, at, size = s.find(k, np.full(len(k), repeat))
                owner = s.owners(at)
                found &= (stored[owner] == k) & ~nulls[owner]
                k, repeat = k[found], repeat + 1
                found_keys += k.tolist()
                ids += [bytes(s.ids(a, n)) for a, n in zip(at[found].tolist(), size[found].tolist())]
        return pa.table({"key": pa.array(found_keys, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return files.groupBy("part", "seq").cogroup(placed.groupBy("part", "seq")).applyInArrow(get, "key long, ids binary")


def store(docs: DataFrame, tokenizer_path: str, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Writes the files, by default to the shared folder, and reads them back."""
    spark = docs.sparkSession
    path = path or f"{common.shared_folder(spark)}/lectern-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path)
    return read(spark, path, with_ids)
