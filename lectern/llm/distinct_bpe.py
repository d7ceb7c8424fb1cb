"""Byte-level BPE of whole texts by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are split into pre-tokens where they lie. A chunk keeps the position of each pre-token, and sends each distinct one
once to the bucket of its hash; the bucket encodes each distinct word of the corpus once; the ids come back to the chunks
that asked for them, where every text is put together again by position. A word in a third of all texts is sent once by
each chunk, not once for each occurrence.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import chunks, common

_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Pieces:
    """Texts cut at single spaces between characters that are no white space; no pre-token crosses such a place.

    firsts: how texts begin; rest: all other pieces, without the space before them.
    """

    @staticmethod
    def _clean(piece: str) -> bool:
        return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()

    def __init__(self, tables: list[pa.Table]):
        self.firsts: set[str] = set()
        self.rest: set[str] = set()
        for t in tables:
            for text in t.column("text"):
                first, *rest = text.as_py().split(" ")
                self.firsts.add(first)
                self.rest.update(rest)
        self.odd = {p for p in self.rest if not self._clean(p)}
        if self.odd or not all(map(self._clean, self.firsts)):
            self.firsts, self.rest = set(), set()
            for t in tables:
                for text in t.column("text"):
                    first, *rest = self.cut(text.as_py())
                    self.firsts.add(first)
                    self.rest.update(rest)

    def cut(self, text: str) -> list[str]:
        pieces = text.split(" ")
        if len(pieces) > 1 and (not self._clean(pieces[0]) or self.odd and not self.odd.isdisjoint(pieces)):
            return _SPACE.split(text)
        return pieces


@cache
def unsettled(pattern: str) -> str:
    """Characters that tiktoken and the library used here for splitting put into different classes of the pattern, since they
    know different versions of Unicode. tiktoken shows its classes when a class is all of the pattern."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out: set[str] = set()
    for class_ in set(re.findall(r"\\p\{\w+\}|\\[sdw]", pattern)):
        own = tiktoken.Encoding("class", pat_str=class_, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out |= set(bytes(own.encode_ordinary(every)).decode()) ^ set(regex.findall(class_, every))
    return "".join(sorted(out))


def _splitter(pattern: str, whole: str):
    """Pre-tokens of a piece, as bytes; a piece with a character of `whole` stays one, for tiktoken to split."""
    import regex

    find = regex.compile(pattern).findall
    settled = frozenset(whole).isdisjoint  # a class of so many characters of high planes is slow as a pattern

    def split(piece: str) -> list[bytes]:
        if piece.isascii():
            if piece[1:].isalpha() and piece[0] == " ":  # the pattern takes it whole
                return [piece.encode()]
        elif not settled(piece):
            return [piece.encode()]
        return [m.encode() for m in find(piece)]

    return split


def ranks_of(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_loaded: dict[tuple, tuple] = common.kept_between_tasks({})


def _codec(path: str, pattern: str):
    """tiktoken's encoder and the token-byte table, once for each Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        ranks = ranks_of(path)
        table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            table[i] = b
        _loaded[path, pattern] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table)
    return _loaded[path, pattern]


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pa.array(map(len, words), pa.int32()).to_numpy().tobytes() + b"".join(words))


def _unpack(blob: bytes, n: int, width: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = (4 * n + width * np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends)]


def _by_bucket(words: set[bytes], n: int) -> dict[int, list[bytes]]:
    """Sorted words of each bucket, which compress better so."""
    label = chunks.labels(n)
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(label[zlib.crc32(w) % n], []).append(w)
    for ws in out.values():
        ws.sort()
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, **columns: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]: ids of every whole text, and of their decoding.

    A null or empty text has no ids (hashes of nothing); a null id is kept; rows that share an id are encoded each for
    itself; a text of any length is taken whole; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    texts, whole = chunks.packed(docs, n, **columns), unsettled(pattern)

    def ask(key, group):
        common.lean()
        split, words = _splitter(pattern, whole), set()
        pieces = Pieces(list(chunks.opened(group.column("blob"))))
        for p in pieces.firsts:
            words.update(split(p))
        for p in pieces.rest:
            words.update(split(" " + p))
        buckets = _by_bucket(words, n)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(buckets), pa.int32()), "bucket": pa.array(list(buckets), pa.int32()), "n": pa.array([len(w) for w in buckets.values()], pa.int32()), "words": pa.array([_pack_words(w) for w in buckets.values()], pa.binary())})

    def answer(key, group):
        enc, _ = _codec(ranks_path, pattern)
        asked = [_unpack(w.as_py(), k.as_py(), 1) for w, k in zip(group.column("words"), group.column("n"))]
        ids = {w: np.asarray(enc.encode_ordinary(w.decode()), "<u4").tobytes() for w in set().union(*asked)}
        z = zstandard.ZstdCompressor(level=1)
        out = []
        for words in asked:
            own = [ids[w] for w in words]
            out.append(z.compress(np.asarray([len(x) // 4 for x in own], "<i4").tobytes() + b"".join(own)))
        return pa.table({"chunk": group.column("chunk"), "n": group.column("n"), "words": group.column("words"), "ids": pa.array(out, pa.binary())})

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.binary())] if with_ids else [])]

    def assemble(group, answers):
        _, table = _codec(ranks_path, pattern)
        split = _splitter(pattern, whole)
        of: dict[bytes, bytes] = {}
        for k, words, ids in zip(answers.column("n").to_pylist(), answers.column("words").to_pylist(), answers.column("ids").to_pylist()):
            of.update(zip(_unpack(words, k, 1), _unpack(ids, k, 4), strict=True))
        tables = list(chunks.opened(group.column("blob")))
        pieces = Pieces(tables)
        joined = lambda p: b"".join([of[w] for w in split(p)])
        firsts = {p: joined(p) for p in pieces.firsts}
        rest = {p: joined(" " + p) for p in pieces.rest}
        del of
        rows: list[tuple] = []
        for t in tables:
            for doc, text in zip(t.column("doc_id").to_pylist(), t.column("text")):
                first, *more = pieces.cut(text.as_py())
                ids = b"".join([firsts[first], *map(rest.__getitem__, more)])
                numbers = np.frombuffer(ids, "<u4")
                back = hashlib.sha256(b"".join(map(table.__getitem__, numbers.tolist()))).hexdigest()
                rows.append((doc, len(numbers), hashlib.sha256(ids).hexdigest(), back, ids)[: len(fields)])
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)] if rows else [pa.array([], t) for _, t in fields], schema=pa.schema(fields))

    asked = texts.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, n int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk int, n int, words binary, ids binary")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, out)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids as little-endian unsigned 32-bit): ids joined with the token-byte table.

    The table is the vocabulary, of fixed size whatever the corpus, and each worker loads it. Bytes that are no UTF-8 are
    shown as replacement characters; null ids give a null text.
    """

    def back(batches):
        table: dict[int, bytes] = {i: b for b, i in ranks_of(ranks_path).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")
