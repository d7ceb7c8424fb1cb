"""Removal of word runs that an earlier document already has, by compaction of a de Bruijn graph of word windows.

A window of k consecutive words is an edge, from the node of its first k-1 words to that of its last k-1. Documents lie in
chunks, and what chunks know of each other comes from joins in buckets of hashes:

1. Seeds. The smallest hash of the short windows inside an edge is the edge's seed; neighbouring edges mostly have the
   same one, so seeds are few. Only edges whose seed stands in two places enter the graph: the others cannot repeat.
2. Degrees. Buckets add up how often each edge and each node occurs in the corpus. A node that occurs exactly as often as
   the edge into it and the edge out of it has no other edge on either side, and no text begins or ends there: its
   in-degree and its out-degree are 1.
3. Compaction. Repeated edges joined by such nodes are one nonbranching path. All documents that have one of its edges
   have the whole path, so a document's path is the graph's path, and one row of the path joins the others by its first
   edge and its number of edges.
4. Verification. A row carries the digest of the words at its coordinates. A span counts as the source's only if the digests
   at both coordinates agree; paths of equal hashes and different words are compared word by word, window by window. So
   no hash of an edge or node decides about a word, and equal hashes of different windows lose none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import chunks, common, textblock

CHUNKS = 2  # for each shuffle partition: smaller ones take less memory, more of them more rows between the joins
SEED_WORDS = 5
BITS = 56  # of the hashes of edges and nodes; equal ones cost time, not results
SEED_BITS = 48
NO_ID = np.iinfo(np.int64).max
_PATHS = "chunk int, first long, n_edges int, digest binary, doc long, start int, most long, rows array<int>, starts array<int>, words binary"
_SPANS = "chunk int, rows array<int>, starts array<int>, n_edges int, source long, source_start int"


def _shut(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(blob: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob.as_py())


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers by byte significance: the high zeros of small numbers compress away."""
    return _shut(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(blob: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(_open(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


def _differences(x: np.ndarray) -> np.ndarray:
    out = x.astype(np.uint64, copy=True)
    out[1:] -= x[:-1].astype(np.uint64)
    return out


def _sorted_numbers(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _bounds(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n equal ranges of numbers of so many bits begins in the sorted keys."""
    cuts = [min((1 << 64) - 1, -(-(i << bits) // n)) for i in range(n)]
    return np.append(np.searchsorted(keys, np.array(cuts, np.uint64)), len(keys))


class Chunk:
    """The documents of a chunk in order of (id, text); a null id counts as larger than any other."""

    def __init__(self, blobs: pa.ChunkedArray):
        parts = list(chunks.opened(blobs))
        t = pa.concat_tables(parts).combine_chunks() if parts else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        del parts
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))
        self.table = t
        self.ids = t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64())
        self.order = pa.compute.fill_null(self.ids, NO_ID).to_numpy(zero_copy_only=False)
        texts = t.column("text").cast(pa.large_string())
        self.texts = texts.combine_chunks() if t.num_rows else pa.array([], pa.large_string())


class Graph:
    """Edges and nodes of a chunk, each at the place of its first word among all words of the chunk."""

    def __init__(self, chunk: Chunk, k: int, bits: int = BITS, seeds: bool = False):
        kinds = {"row": np.int32, "place": np.int32, "edge": np.uint64, "node": np.uint64, "has": bool, "seed": np.uint64}
        held: dict[str, list] = {name: [] for name in kinds}
        size = min(SEED_WORDS, max(1, k // 2))
        for at, w in textblock.blocks(chunk.texts):
            words = w.hashes()
            n = len(words)

            def full(windows: tuple[np.ndarray, np.ndarray], none: int = 0, n: int = n) -> np.ndarray:
                out = np.full(n, none, np.uint64)
                out[windows[0]] = windows[1]
                return out

            edges = w.windows(k, words)
            has = np.zeros(n, bool)
            has[edges[0]] = True
            held["row"].append((w.text + at).astype(np.int32))
            held["place"].append((np.arange(n) - w.first[w.text]).astype(np.int32))
            held["has"].append(has)
            # an edge's key is even, a node's odd
            held["edge"].append(full(edges) >> np.uint64(64 - bits) << np.uint64(1))
            held["node"].append(full(w.windows(k - 1, words)) >> np.uint64(64 - bits) << np.uint64(1) | np.uint64(1))
            if seeds:
                short = full(w.windows(size, words), (1 << 64) - 1)
                least = short.copy()
                for j in range(1, k - size + 1):
                    np.minimum(least[:-j], short[j:], out=least[:-j])
                held["seed"].append(least >> np.uint64(64 - SEED_BITS))
        for name, kind in kinds.items():
            setattr(self, name, np.concatenate(held[name]) if held[name] else np.zeros(0, kind))
            held[name].clear()

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds, which of them stand in several places here, and of each edge the number of its seed."""
        at = np.flatnonzero(self.has)
        keys, of = np.unique(self.seed[at], return_inverse=True)
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (self.row[at[1:]] != self.row[at[:-1]])
        return keys, np.bincount(of[new], minlength=len(keys)) > 1, of

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the edges at chosen places and the nodes beside them: distinct keys, how often each occurs, and where nodes are."""
        beside = chosen.copy()
        beside[1:] |= chosen[:-1]
        keys, counts = np.unique(np.concatenate([self.edge[chosen], self.node[beside]]), return_counts=True)
        return keys, counts, beside


def paths(texts: DataFrame, n: int, k: int, bits: int = BITS) -> DataFrame:
    """Nonbranching paths of repeated edges, one row for each different one of a chunk: chunk, first (edge), n_edges, digest
    (of the words), doc and start (the first place in the chunk), most (the largest document), rows and starts (all places), words."""
    label = chunks.labels(n)
    number = {b: i for i, b in enumerate(label)}

    def rows(chunk: int, keys: np.ndarray, space: int, **more: np.ndarray) -> dict:
        to = _bounds(keys, space, n)
        full = [b for b in range(n) if to[b + 1] > to[b]]
        out = {"chunk": pa.array([chunk] * len(full), pa.int32()), "bucket": pa.array([label[b] for b in full], pa.int32())}
        out["keys"] = pa.array([_planes(_differences(keys[to[b] : to[b + 1]])) for b in full], pa.binary())
        return out | {name: pa.array([_planes(x[to[b] : to[b + 1]]) for b in full], pa.binary()) for name, x in more.items()}

    def ask_seeds(key, group):
        common.lean()
        g = Graph(Chunk(group.column("blob")), k, bits, seeds=True)
        return pa.table(rows(key[0].as_py(), g.seeds()[0], SEED_BITS))

    def joined(group) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """What the chunks sent to a bucket: the sizes of their arrays, and all keys in order, with where each new one begins."""
        sent = [_sorted_numbers(x) for x in group.column("keys")]
        sizes = [len(x) for x in sent]
        keys = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return sizes, order, first, np.diff(np.append(first, len(keys)))

    def answer_seeds(key, group):
        common.lean()
        sizes, order, first, count = joined(group)
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(count > 1, count)
        parts = np.split(shared, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": group.column("chunk").cast(pa.int32()), "bucket": group.column("bucket").cast(pa.int32()), "elsewhere": pa.array([_shut(np.packbits(x).tobytes()) for x in parts], pa.binary())})

    def ask_counts(group, answers):
        common.lean()
        none = {"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("keys", "counts", "note")}}
        if not group.num_rows:
            return pa.table(none)
        chunk = group.column("chunk")[0].as_py()
        g = Graph(Chunk(group.column("blob")), k, bits, seeds=True)
        seeds, several, of = g.seeds()
        to = _bounds(seeds, SEED_BITS, n)
        for b, mask in zip(map(number.get, answers.column("bucket").to_pylist()), answers.column("elsewhere")):
            several[to[b] : to[b + 1]] |= np.unpackbits(np.frombuffer(_open(mask), np.uint8), count=to[b + 1] - to[b]).astype(bool)
        chosen = np.zeros(len(g.has), bool)
        chosen[np.flatnonzero(g.has)] = several[of]
        if not chosen.any():
            return pa.table(none)
        keys, counts, _ = g.keys(chosen)
        out = rows(chunk, keys, bits + 1, counts=counts)
        # which edges were asked for comes back with the answers
        out["note"] = pa.array([_shut(np.packbits(chosen).tobytes()), *[None] * (len(out["chunk"]) - 1)], pa.binary())
        return pa.table(out)

    def answer_counts(key, group):
        common.lean()
        sizes, order, first, count = joined(group)
        own = np.concatenate([_numbers(x) for x in group.column("counts")])
        total = np.empty(len(order), np.uint64)
        total[order] = np.repeat(np.add.reduceat(own[order], first), count)
        parts = np.split(total - own, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": group.column("chunk").cast(pa.int32()), "bucket": group.column("bucket").cast(pa.int32()), "others": pa.array(map(_planes, parts), pa.binary()), "note": group.column("note").cast(pa.binary())})

    schema = to_arrow_schema(StructType.fromDDL(_PATHS))

    def compact(group, answers):
        common.lean()
        if not group.num_rows or not answers.num_rows:
            return schema.empty_table()
        c = Chunk(group.column("blob"))
        g = Graph(c, k, bits)
        note = next(x for x in answers.column("note") if x.is_valid)
        chosen = np.unpackbits(np.frombuffer(_open(note), np.uint8), count=len(g.has)).astype(bool)
        keys, counts, beside = g.keys(chosen)
        to = _bounds(keys, bits + 1, n)
        counts = counts.astype(np.uint64)
        for b, others in zip(map(number.get, answers.column("bucket").to_pylist()), answers.column("others")):
            counts[to[b] : to[b + 1]] += _numbers(others)
        of_edge, of_node = np.zeros(len(g.has), np.uint64), np.zeros(len(g.has), np.uint64)
        of_edge[chosen] = counts[np.searchsorted(keys, g.edge[chosen])]
        of_node[beside] = counts[np.searchsorted(keys, g.node[beside])]
        repeated = of_edge > 1
        follows = np.zeros(len(g.has), bool)
        follows[1:] = repeated[1:] & repeated[:-1] & (g.row[1:] == g.row[:-1]) & (of_edge[1:] == of_edge[:-1]) & (of_node[1:] == of_edge[1:])
        first = np.flatnonzero(repeated & ~follows)
        last = np.flatnonzero(repeated & ~np.append(follows[1:], False))
        found: dict[tuple, list] = {}
        held, words = -1, []
        for a, m, r, p in zip(first.tolist(), (last - first + 1).tolist(), g.row[first].tolist(), g.place[first].tolist()):
            if r != held:
                held, words = r, c.texts[r].as_py().encode().split()
            path = b" ".join(words[p : p + m + k - 1])
            digest = hashlib.blake2b(path, digest_size=16).digest()
            row = found.get((m, digest))
            if row is None:
                found[m, digest] = [int(g.edge[a]), m, digest, int(c.order[r]), p, int(c.order[r]), [r], [p], path]
            else:  # places come in order of their documents
                row[5] = int(c.order[r])
                row[6].append(r)
                row[7].append(p)
        chunk = group.column("chunk")[0].as_py()
        cols = [[chunk] * len(found), *zip(*found.values())] if found else [[] for _ in schema]
        return pa.table([pa.array(v, f.type) for v, f in zip(cols, schema)], schema=schema)

    seeds = texts.groupBy("chunk").applyInArrow(ask_seeds, "chunk int, bucket int, keys binary")
    elsewhere = seeds.groupBy("bucket").applyInArrow(answer_seeds, "chunk int, bucket int, elsewhere binary")
    asked = texts.groupBy("chunk").cogroup(elsewhere.groupBy("chunk")).applyInArrow(ask_counts, "chunk int, bucket int, keys binary, counts binary, note binary")
    counted = asked.groupBy("bucket").applyInArrow(answer_counts, "chunk int, bucket int, others binary, note binary")
    return texts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(compact, _PATHS)


class _Sources:
    """Paths of equal hashes, in order of (document, start): for each the runs of its windows and where they lie first."""

    def __init__(self, k: int):
        self.k = k
        self.of: dict[bytes, list[tuple[int, int, int, int]]] = {}
        self.only: bytes = b""  # the words of the first, as long as all have its digest
        self.first: dict[tuple, tuple[int, int]] = {}

    def runs(self, digest: bytes, words: pa.Scalar, n_edges: int, doc: int, start: int) -> list[tuple[int, int, int, int]]:
        """(first edge, edges, document, start) of the source of each run."""
        if digest in self.of:
            return self.of[digest]
        words = words.as_py()
        if not self.of:
            self.only = words
            self.of[digest] = [(0, n_edges, doc, start)]
            return self.of[digest]
        if len(self.of) == 1:
            (_, m, d, s) = next(iter(self.of.values()))[0]
            for j, window in enumerate(self._windows(self.only, m)):
                self.first.setdefault(window, (d, s + j))
        out: list[tuple[int, int, int, int]] = []
        for j, window in enumerate(self._windows(words, n_edges)):
            d, s = self.first.setdefault(window, (doc, start + j))
            if out and out[-1][2] == d and out[-1][3] + out[-1][1] == s:
                out[-1] = (out[-1][0], out[-1][1] + 1, d, out[-1][3])
            else:
                out.append((j, 1, d, s))
        self.of[digest] = out
        return out

    def _windows(self, words: bytes, n_edges: int) -> list[tuple]:
        w = words.split()
        return [tuple(w[j : j + self.k]) for j in range(n_edges)]


def sourced(found: DataFrame, n: int, k: int) -> DataFrame:
    """chunk, rows, starts, n_edges, source, source_start: the runs of paths that an earlier document has, with the first place of each.

    A path's rows, one for each chunk that has it, come in order of their documents, so the first is the source of all later ones
    and none has to be held.
    """
    schema = to_arrow_schema(StructType.fromDDL(_SPANS))

    def resolve(batches):
        common.lean()
        at, sources = None, None
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            names = ("chunk", "first", "n_edges", "digest", "doc", "start", "most")
            each = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))
            rows, starts, words = (batch.column(batch.schema.get_field_index(c)) for c in ("rows", "starts", "words"))
            for i, (chunk, first, n_edges, digest, doc, start, most) in enumerate(each):
                if at != (first, n_edges):
                    at, sources = (first, n_edges), _Sources(k)
                for edge, edges, source, source_start in sources.runs(digest, words[i], n_edges, doc, start):
                    if source < most:
                        for col, v in zip(cols, (chunk, rows[i].as_py(), [s + edge for s in starts[i].as_py()], edges, source, source_start)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema)], schema=schema)

    return found.repartition(n, "first", "n_edges").sortWithinPartitions("first", "n_edges", "doc", "start").mapInArrow(resolve, _SPANS)


def _of_rows(c: Chunk, spans: pa.Table) -> dict[int, list[tuple[int, int, int, int]]]:
    """row: (start, edges, source, source_start) of each run that an earlier document has."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for rows, starts, m, source, at in zip(*(spans.column(x).to_pylist() for x in ("rows", "starts", "n_edges", "source", "source_start"))):
        for r, s in zip(rows, starts):
            if c.order[r] > source:
                out.setdefault(r, []).append((s, m, source, at))
    return out


def _gone(words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words the runs (first word, end) cover."""
    step = np.zeros(words + 1, np.int32)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


def _graph(docs: DataFrame, k: int, bits: int, extra: tuple[str, ...], columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Texts in chunks, and the runs of their windows that earlier documents have."""
    if k < 2:
        raise ValueError("a window has two words at least")
    n = CHUNKS * common.partitions(docs.sparkSession)
    texts = chunks.packed(docs, n, extra=extra, **columns)
    return texts, sourced(paths(texts, n, k, bits), n, k)


def repeated_spans(docs: DataFrame, k: int = 13, bits: int = BITS, **columns: str) -> DataFrame:
    """doc_id, start, n_words, source, source_start: runs of words that a document with a smaller id has too, each with the
    first document that has it and the place there, in words. Runs of one document follow each other and overlap by k - 1
    words where a path ends. Nulls, short texts and equal ids as in without_repeats."""
    texts, spans = _graph(docs, k, bits, (), columns)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])

    def show(group, spans):
        common.lean()
        if not group.num_rows:
            return schema.empty_table()
        c = Chunk(group.column("blob"))
        out = [(c.ids[r].as_py(), s, m + k - 1, source, at) for r, runs in _of_rows(c, spans).items() for s, m, source, at in runs]
        return pa.table([pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(show, "doc_id long, start long, n_words long, source long, source_start long")


def without_repeats(docs: DataFrame, k: int = 13, with_text: bool = False, extra: tuple[str, ...] = (), bits: int = BITS, **columns: str) -> DataFrame:
    """Removes each word covered by a window of k words (two at least) that also starts in a document with a smaller id.

    One row for each input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and, if asked for,
    text: the text without the removed words and what stands between them, otherwise as it was; `extra` names columns of the
    input to keep beside these. A null or empty text, or one of fewer than k words, loses nothing; a null id counts as
    larger than all others and is no source; rows that share an id are no source for each other; a text of any length is
    taken whole; an empty table gives no rows; other columns are not looked at. `bits`: of the hashes, 62 at most; results are the same
    for any number.
    """
    texts, spans = _graph(docs, k, bits, extra, columns)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if with_text else [])]
    schema = pa.schema(fields)
    kept_types = [docs.schema[c] for c in extra]
    kept_schema = to_arrow_schema(StructType(kept_types))

    def remove(group, spans):
        common.lean()
        cols: list[list] = [[] for _ in fields]
        others = kept_schema.empty_table()
        if group.num_rows:
            c = Chunk(group.column("blob"))
            others = c.table.select(list(extra)).cast(kept_schema)
            of = _of_rows(c, spans)
            for r, (doc, text) in enumerate(zip(c.ids.to_pylist(), c.texts)):
                raw = text.as_py().encode()
                words = raw.split()
                gone = _gone(len(words), [(a, a + m + k - 1) for a, m, _, _ in of[r]]) if r in of else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                row = [doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()]
                if with_text:
                    row.append(text.as_py() if gone is None else _cut(raw, gone).decode())
                for col, v in zip(cols, row):
                    col.append(v)
        t = pa.table([pa.array(v, f.type) for v, f in zip(cols, schema)], schema=schema)
        for name in extra:
            t = t.append_column(kept_schema.field(name), others.column(name))
        return t

    types = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
    types = StructType([*types.fields, *kept_types])
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(remove, types)


def _cut(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without runs of removed words; what stood before such a run and after it stays, but for one of the spaces."""
    w = textblock.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        out.append(raw[at : w.starts[a]])
        at = int(w.ends[b - 1]) if b >= len(w.starts) else int(w.starts[b])
    out.append(raw[at:])
    return b"".join(out)
