"""Chunks of documents: fixed windows, paragraphs and sentences, sections; statistics and comparisons of strategies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot

_PERIOD = re.compile(r"\.\s+")
_GAP = re.compile(r"\n\s*\n")


def windows(text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of windows that end at a space where they can. end may lie past the text in the last ones.

    A window whose only space lies within the overlap could not move on; the next one then begins at its end.
    """
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(" ", at, end)
            end = space if space > at else end
        piece = text[at:end].strip()
        if piece:
            out.append((piece, at, end))
        at = end - overlap if end - overlap > at else end
    return out


def python_sentences(text: str, in_a_row: bool = True) -> list[str]:
    """As functions.text.sentences, for folds that run in Python anyway."""
    parts = _PERIOD.split(text)
    out, held = [], []
    for i, part in enumerate(parts):
        held.append(part)
        words = part.split()
        if i + 1 < len(parts):
            after_another = len(held) > 1 and len(words) == 1
            if words and words[-1].lower().rstrip(".") in T.ABBREVIATIONS and (in_a_row or not after_another):
                continue
            out.append(". ".join(held).strip() + ".")
            held = []
    out.append(". ".join(held).strip())
    return [s for s in out if s]


def _packed(sentences: list[str], limit: int) -> Iterator[str]:
    group: list[str] = []
    length = 0
    for s in sentences:
        if group and length + len(s) > limit:
            yield " ".join(group)
            group, length = [], 0
        group.append(s)
        length += len(s) + 1
    if group:
        yield " ".join(group)


def passages(text: str, most: int, least: int, in_a_row: bool = True) -> list[tuple[str, str]]:
    """(text, boundary): paragraphs; short ones joined to the passage before if it has room, long ones packed by sentences.

    in_a_row: as in functions.text.sentences."""
    out: list[tuple[str, str]] = []
    for p in filter(None, (x.strip() for x in _GAP.split(text))):
        if len(p) > most:
            out.extend((x, "sentence") for x in _packed(python_sentences(p, in_a_row), most))
        elif len(p) < least and out and len(out[-1][0]) + 2 + len(p) <= most:
            out[-1] = (f"{out[-1][0]}\n\n{p}", "merged_paragraph")
        else:
            out.append((p, "paragraph"))
    return out


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_id, text, char_start, char_end of (doc_id, text)."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf("array<struct<text:string,char_start:int,char_end:int>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [dict(zip(("text", "char_start", "char_end"), w)) for w in windows(t, size, overlap)] if t else [])

    rows = docs.select("doc_id", F.posexplode(cut("text")).alias("chunk_id", "c"))
    return rows.select("doc_id", "chunk_id", "c.text", "c.char_start", "c.char_end")


def semantic(docs: DataFrame, most: int = 1500, least: int = 100, keep: tuple[str, ...] = ("doc_id",), in_a_row: bool = True) -> DataFrame:
    """keep, chunk_id, text, boundary of (keep, text). in_a_row: as in functions.text.sentences."""

    @F.pandas_udf("array<struct<text:string,boundary:string>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [dict(zip(("text", "boundary"), p)) for p in passages(t, most, least, in_a_row)] if t else [])

    rows = docs.select(*keep, F.posexplode(cut("text")).alias("chunk_id", "c"))
    return rows.select(*keep, "chunk_id", "c.text", "c.boundary")


def merged(chunks: DataFrame, most: int = 1500, threshold: float = 0.8) -> DataFrame:
    """doc_id, chunk_id, text, boundary, merge_sim of (doc_id, chunk_id, text, boundary, vector): a chunk joins the one before if
    the vectors of both, as they were, are similar and the joined text has room.

    Similarities have 12 places, so that the order of adding does not tell whether one reaches the threshold; merge_sim has 3,
    half to even.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    sims = chunks.withColumn("sim", F.round(dot(F.lag("vector").over(order), F.col("vector")), 12))
    rows = sims.select("doc_id", "chunk_id", "text", "boundary", "sim", F.bround("sim", 3).alias("shown"))
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.int32()), ("text", pa.string()), ("boundary", pa.string()), ("merge_sim", pa.float64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents one after the other, each in the order of its chunks; the chunk that may still grow is held."""
        held: list = []
        for batch in batches:
            out = []
            for doc, _, t, b, sim, shown in zip(*(c.to_pylist() for c in batch.columns)):
                same = bool(held) and held[0] == doc
                if same and sim is not None and sim >= threshold and held[5] + len(t) <= most:
                    held[2].append(t)
                    held[3:] = ["semantic_merge", shown, held[5] + 2 + len(t)]
                    continue
                if held:
                    out.append(held)
                held = [doc, held[1] + 1 if same else 0, [t], b, None, len(t)]
            yield packed(out)
        if held:
            yield packed([held])

    def packed(out: list[list]) -> pa.RecordBatch:
        rows = [(doc, i, "\n\n".join(ts), b, sim) for doc, i, ts, b, sim, _ in out]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    # the window has brought each document to one partition
    return rows.sortWithinPartitions("doc_id", "chunk_id").mapInArrow(fold, "doc_id long, chunk_id int, text string, boundary string, merge_sim double")


def hierarchical(sections: DataFrame, most: int = 1500, least: int = 100, with_header: bool = True) -> DataFrame:
    """doc_id, chunk_id, text, boundary, section, section_level, page_start, page_end of sections (doc_id, section_idx, title,
    level, content[, page_start, page_end]). The header is added after sizing. chunk_id counts through the document."""
    pages = [c if c in sections.columns else F.lit(None).cast("int").alias(c) for c in ("page_start", "page_end")]
    rows = sections.where(T.strip(F.col("content")) != "").select("doc_id", "section_idx", "title", "level", *pages, F.col("content").alias("text"))
    cut = semantic(rows, most, least, ("doc_id", "section_idx", "title", "level", "page_start", "page_end"))
    text = F.concat(F.lit("[Section: "), "title", F.lit("]\n"), "text") if with_header else F.col("text")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_idx", "chunk_id")) - 1
    return cut.select("doc_id", number.alias("chunk_id"), text.alias("text"), "boundary", F.col("title").alias("section"), F.col("level").alias("section_level"), "page_start", "page_end")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != ""))


def stats(chunks: DataFrame, by: str = "strategy") -> DataFrame:
    size, words = F.length("text"), n_words(F.col("text"))
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(size).alias("total_chars"),
        F.sum(words).alias("total_words"),
        F.bround(F.avg(size)).cast("long").alias("avg_chars"),
        F.bround(F.avg(words)).cast("long").alias("avg_words"),
        F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"),
        F.bround(F.stddev_pop(size)).cast("long").alias("std_chars"),
    )


def compared(strategies: dict[str, DataFrame]) -> DataFrame:
    """strategy, metric, value: the statistics of several strategies, one row for each."""
    every = None
    for name, chunks in strategies.items():
        part = chunks.select(F.lit(name).alias("strategy"), "text")
        every = part if every is None else every.unionByName(part)
    metrics = ("count", "total_chars", "total_words", "avg_chars", "avg_words", "min_chars", "max_chars", "std_chars")
    return stats(every).unpivot("strategy", list(metrics), "metric", "value")


def samples(chunks: DataFrame, at: int = 2, by: str = "strategy") -> DataFrame:
    """Of each strategy the chunk with number min(at, last). No task sees more than the first at + 1 of each other one."""
    order = Window.partitionBy(by).orderBy("doc_id", "chunk_id")
    first = chunks.withColumn("i", F.row_number().over(order)).where(F.col("i") <= at + 1)
    return first.withColumn("n", F.max("i").over(Window.partitionBy(by))).where("i = n").drop("i", "n")


def broken_boundaries(fixed_chunks: DataFrame, semantic_chunks: DataFrame) -> DataFrame:
    """Of each document the first fixed chunk, other than the last, that ends within a sentence, how the next one begins, and
    the first semantic chunk that has its first 50 characters."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    open_ = fixed_chunks.withColumn("next_text", F.lead("text").over(order)).where(F.col("next_text").isNotNull() & ~F.col("text").rlike(r"""[.!?:)"']\z"""))
    first = open_.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "text", "next_text"), "chunk_id").alias("f"))
    probe = F.substring(F.col("f.text"), 1, 50)
    hits = first.join(semantic_chunks.select("doc_id", F.col("chunk_id").alias("sem_id"), F.col("text").alias("sem_text")), "doc_id").where(F.col("sem_text").contains(probe)).groupBy("doc_id").agg(F.min("sem_id").alias("semantic_id"))
    return first.join(hits, "doc_id", "left").select("doc_id", F.col("f.chunk_id").alias("fixed_id"), F.right(F.col("f.text"), F.lit(80)).alias("ends_with"), F.substring("f.next_text", 1, 80).alias("next_begins"), "semantic_id")
