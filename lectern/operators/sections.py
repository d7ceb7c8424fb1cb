"""Section headings, sections of a document, and the pages that they stand on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NEAR = 10
#: How a heading line looks.
NUMBERED = r"^(\d+(?:\.\d+)*)\s+([A-Z][^\n]{2,80})$"
ROMAN = r"^((?:I{1,3}|IV|VI{0,3}|IX|X{0,3}))\.\s+([A-Z][^\n]{2,80})$"
CAPITALS = r"^([A-Z][A-Z\s]{4,60})$"
ABSTRACT = r"^(Abstract|ABSTRACT)\s*$"
_KINDS = [(re.compile(p, re.MULTILINE), kind) for p, kind in ((NUMBERED, "number"), (ROMAN, "number"), (CAPITALS, "capitals"), (ABSTRACT, "abstract"))]

MARKER = "array<struct<title:string,level:int,start:int>>"


def headings(text: str) -> list[tuple[str, int, int]]:
    """(title, level, start) in order. Of headings that begin within NEAR characters of the last one kept, the longer title stays."""

    def read(match: re.Match, kind: str) -> tuple[str, int, int]:
        if kind == "abstract":
            return "Abstract", 1, match.start()
        if kind == "capitals":
            return match[1].strip().title(), 1, match.start()
        return f"{match[1]} {match[2].strip()}", match[1].count(".") + 1, match.start()

    every = (read(m, kind) for pattern, kind in _KINDS for m in pattern.finditer(text))
    kept: list[tuple[str, int, int]] = []
    for mark in sorted((m for m in every if len(m[0]) >= 3), key=lambda m: m[2]):
        if not kept or mark[2] - kept[-1][2] >= NEAR:
            kept.append(mark)
        elif len(mark[0]) > len(kept[-1][0]):
            kept[-1] = mark
    return kept


def section_markers(text: str) -> Column:
    @F.pandas_udf(MARKER)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [dict(zip(("title", "level", "start"), m)) for m in headings(t)] if t else [])

    return find(text)


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text, page_lengths, n_pages of (doc_id, page_no, text): running lines dropped, pages joined and cleaned."""
    bare = pages.withColumn("text", T.without_running_lines(F.coalesce("text", F.lit(""))))
    grouped = bare.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    return grouped.select("doc_id", T.cleaned(F.array_join(texts, "\n\n")).alias("text"), F.transform(texts, F.length).alias("page_lengths"), F.size("p").alias("n_pages"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_idx, title, level, content, start, end of (doc_id, text): one section 'Full Document' where no heading is.

    A section reaches to the next heading; its content begins after the first line break in it. Text before the first
    heading belongs to none.
    """
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("m", section_markers("text"))
    n = F.size("m")
    bounds = F.transform("m", lambda x, i: F.struct(i.alias("section_idx"), x["title"].alias("title"), x["level"].alias("level"), x["start"].alias("start"), F.when(i + 1 < n, F.get("m", i + 1)["start"]).otherwise(F.length("text")).alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("section_idx"), F.lit("Full Document").alias("title"), F.lit(1).alias("level"), F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = marked.select("doc_id", "text", (n == 0).alias("bare"), F.inline(F.when(n == 0, whole).otherwise(bounds)))
    body = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    cut = F.locate("\n", body)
    content = F.when(F.col("bare"), F.col("text")).otherwise(T.strip(F.when(cut > 0, F.substring(body, cut + 1, F.length(body))).otherwise(body)))
    return rows.select("doc_id", "section_idx", "title", "level", content.alias("content"), "start", "end", "bare")


def with_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """found with page_start and page_end, from the page lengths before cleaning (an estimate, since offsets are after it)."""
    # position at which each page ends, pages being two characters apart; once for each document
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("page_lengths"), F.lit(1))), lambda i: F.aggregate(F.slice("page_lengths", F.lit(1), i), F.lit(-2), lambda a, x: a + x + 2))
    rows = found.join(pages.select("doc_id", "n_pages", ends.alias("ends")), "doc_id", "left")
    first = lambda at: F.array_position(F.transform("ends", lambda e: e >= F.col(at)), F.lit(True)).cast("int")
    bare = F.col("bare")
    # a page counts as the first only if the walk gets to it
    last = F.when(first("end") > 0, first("end")).otherwise(F.col("n_pages"))
    start = F.when((first("start") > 0) & (first("start") <= last), first("start")).otherwise(0)
    return rows.select(*found.columns, F.when(bare, 1).otherwise(start).alias("page_start"), F.when(bare, F.col("n_pages")).otherwise(last).alias("page_end"))


def named(found: DataFrame, part: str) -> DataFrame:
    """Each document's first section whose title contains `part`, in any case."""
    hits = found.where(F.lower("title").contains(part.lower()))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_idx"))).where("r = 1").drop("r")


def outline(found: DataFrame) -> DataFrame:
    """doc_id, text: all sections with their titles as headings."""
    block = F.concat(F.expr("repeat('#', level)"), F.lit(" "), "title", F.lit("\n\n"), "content")
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", block.alias("block")))).alias("b"))
    return grouped.select("doc_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"))
