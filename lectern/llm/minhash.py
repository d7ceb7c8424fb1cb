"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Each document's shingles are hashed once and fall into bins; a bin's smallest value is one entry of the signature, and an
empty bin takes the value of a full one that its own sequence of probes finds. Bands of entries are bucket keys. In a
bucket every document is a candidate with the smallest one only, which bounds the pairs by the rows. A star can miss a
link between two of its leaves, so a bucket whose documents are still in different components after that is gone through
exactly: in blocks of bounded size, two at a time, an index over the shingles of one block counts what each document of
the other shares with it, and only links that join two components leave the task, never pairs. All links are confirmed on
full shingle sets, of the texts themselves; documents of the same words, by a digest of these words, have the same set and
are one before that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textblock
from .links import components

BINS, ROWS = 128, 4  # 32 bands of 4: a pair of similarity 0.75 is missed 5 times in a million
BLOCK = 1024  # documents of a bucket that a task holds at a time, twice
_SEED = np.uint64(0x2545F4914F6CDD1D)


def shingle_words(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The set that similarity is defined on."""
    words = text.encode().lower().split()  # of bytes: A-Z alone
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def _probes(bins: int, tries: int) -> np.ndarray:
    """For each empty bin the bins to try, in order: the same for all documents, independent between bins."""
    with np.errstate(over="ignore"):
        x = np.arange(bins, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(tries, dtype=np.uint64)[:, None] + np.uint64(1)) * _SEED
    return (textblock.mix(x) % np.uint64(bins)).astype(np.int64)


_PROBES = _probes(BINS, 4096)


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x BINS entries from shingle hashes and their documents; a document without shingles has none that count."""
    none = np.uint64((1 << 64) - 1)
    sig = np.full((n, BINS), none)
    where = doc * BINS + (hashes >> np.uint64(57)).astype(np.int64)
    np.minimum.at(sig.reshape(-1), where, hashes & np.uint64((1 << 57) - 1))
    full = sig != none
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(len(_PROBES)):
        if not len(row):
            return sig
        source = _PROBES[t][bin_]
        hit = full[row, source]
        sig[row[hit], bin_[hit]] = sig[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    sig[row, bin_] = sig[row, np.argmax(full[row], axis=1)]  # no probe found a full bin
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    n = len(sig)
    with np.errstate(over="ignore"):
        x = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64) * _SEED, (n, BINS // ROWS)).copy()
        for j in range(ROWS):
            x = textblock.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(n, -1, ROWS)[:, :, j])
    return x.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (128-bit digest of the words themselves), keys: of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sketch(batches):
        common.lean()
        for batch in batches:
            ids = batch.column(0)
            for at, w in textblock.blocks(batch.column(1), lower=True):
                n = len(w.offsets) - 1
                words = w.hashes()
                where, h = w.windows(size, words)
                doc = w.text[where]
                short = np.flatnonzero((w.counts > 0) & (w.counts < size))
                if len(short):  # the whole sequence, told from others by its length
                    with np.errstate(over="ignore"):
                        own = [textblock.mix(np.array([sum(int(x) * pow(31, j + 1, 1 << 64) for j, x in enumerate(words[w.first[d] : w.first[d + 1]])) + int(w.counts[d]) & ((1 << 64) - 1)], np.uint64)) for d in short]
                    doc, h = np.concatenate([doc, short]), np.concatenate([h, *own])
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                counts = np.bincount(doc, minlength=n)
                texts = (w.data[a:b].tobytes() for a, b in zip(w.offsets[:-1], w.offsets[1:]))  # lower-cased
                marks = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if c else None for c, t in zip(counts.tolist(), texts)]
                keys = band_keys(signatures(doc, h, n))
                full = counts > 0
                offsets = np.concatenate([[0], np.cumsum(full * keys.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(counts), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1)))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, fingerprint binary, keys array<long>")


def _shut(docs: DataFrame) -> DataFrame:
    def shut(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t.as_py().encode()) for t in batch.column(1)], pa.binary())], names=["doc_id", "shut"])

    return docs.select("doc_id", "text").mapInArrow(shut, "doc_id long, shut binary")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of which 100 * intersection >= percent * union on full sets. texts: doc_id, shut."""

    def confirm(batches):
        common.lean()
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, last, hub = [], [], None, set()
            for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                if tx is not last and tx != last:
                    last, hub = tx, shingle_words(z.decompress(tx).decode(), size)
                other = shingle_words(z.decompress(ty).decode(), size)
                both = len(hub & other)
                if both and 100 * both >= percent * (len(hub) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("shut").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("shut").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


class _Groups:
    """Joins of documents into components as links are found."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _within(docs: list[int], labels: list[int], texts: list[str], sides: list[bool], size: int, percent: int) -> list[tuple[int, int]]:
    """Links between different components: of all documents with each other, or, with sides, across them only."""
    data, offsets = textblock.raw(pa.array(texts, pa.large_string()))
    w = textblock.Words(data, offsets, lower=True)
    where, h = w.windows(size, w.hashes())
    cut = np.searchsorted(where, w.first)
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    n = np.array([len(x) for x in sets])
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], of[order]
    both = any(sides)
    side = np.array(sides)
    groups, full, out = _Groups(), {}, []
    label = np.array(labels)

    def set_of(i: int) -> set:
        if i not in full:
            full[i] = shingle_words(texts[i], size)
        return full[i]

    for i, own in enumerate(sets):
        if both and not side[i]:
            continue
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = high - low
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        shared = np.bincount(owner[np.repeat(low, counts) + step], minlength=len(sets))
        good = (shared > 0) & (100 * shared >= percent * (n[i] + n - shared)) & (label != label[i])
        good &= ~side if both else np.arange(len(sets)) > i
        for j in np.flatnonzero(good).tolist():
            if groups.find(labels[i]) == groups.find(labels[j]):
                continue
            x, y = set_of(i), set_of(j)
            k = len(x & y)
            if k and 100 * k >= percent * (len(x) + len(y) - k):
                groups.join(labels[i], labels[j])
                out.append((docs[i], docs[j]))
    return out


def links_within(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links that join the components (c) of the documents of each bucket of open_ (key, doc_id, c).

    Texts of fewer than `size` words are one shingle and equal only to themselves, so they have no part in this.
    """
    n = common.partitions(open_.sparkSession)
    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    once = sizes.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = open_.join(once, "key").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).cast("int"))
    # block i meets block j >= i once; each document goes wherever its block does
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("side"), "doc_id", "c")
    rows = rows.join(texts, "doc_id").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches):
        common.lean()
        z = zstandard.ZstdDecompressor()
        at, docs, labels, shut, sides = None, [], [], [], []

        def found():
            across = at[1] != at[2]
            if len(docs) < 2 or len(set(labels)) < 2 or across and len(set(sides)) < 2:
                return []
            return _within(docs, labels, [z.decompress(x).decode() for x in shut], sides if across else [False] * len(docs), size, percent)

        for batch in batches:
            links = []
            for key, i, j, side, doc, c, text in zip(*(batch.column(batch.schema.get_field_index(f)).to_pylist() for f in ("key", "i", "j", "side", "doc_id", "c", "shut"))):
                if at != (key, i, j):
                    if at is not None:
                        links += found()
                    at, docs, labels, shut, sides = (key, i, j), [], [], [], []
                docs.append(doc)
                labels.append(c)
                shut.append(text)
                sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
        if at is not None:
            links = found()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Links hold between documents whose sets of `size`-word shingles (of the whole word sequence, if shorter; words with A-Z
    lower-cased) have 100 * intersection >= percent * union. component_id is the smallest id that links reach, kept tells
    whether it is the row's own. Null and empty texts have no shingle and no link. A row without an id has no component
    and is kept. Rows that share an id are one document of several texts: a link to any of them counts. A text of any length is
    taken whole. An empty table gives no rows; other columns are not looked at.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.whole(text_column).alias("text"))
    sets = common.written(sketches(base, size))
    known = sets.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull())
    classes = known.groupBy("n_shingles", "fingerprint").agg(F.min("doc_id").alias("rep"))
    first = known.join(classes.select("n_shingles", "fingerprint", F.col("rep").alias("doc_id")), ["doc_id", "n_shingles", "fingerprint"], "left_semi")
    entries = first.select(F.explode("keys").alias("key"), "doc_id", F.col("n_shingles").alias("n")).distinct()
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("key")
    active = common.written(entries.join(crowded, "key"))
    texts = common.written(_shut(base).join(active.select("doc_id").distinct(), "doc_id", "left_semi"))
    same = known.join(classes, ["n_shingles", "fingerprint"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    hubs = active.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("hub"))
    near = active.join(hubs, "key").where(f"doc_id > hub.doc_id and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    links = common.written(linked(near.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), texts, size, percent))
    found = common.written(components(links))
    label = active.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = label.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    open_ = common.written(label.join(mixed, "key"))
    more = common.written(links_within(open_, texts, size, percent))
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what the links came to, in fewer rounds
    found = common.written(components(stars.unionAll(more).unionAll(same)))
    common.forget(texts, active, open_)
    out = sets.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
