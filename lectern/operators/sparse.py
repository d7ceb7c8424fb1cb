"""BM25 over an inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import let, runs
from ..functions import text as T
from .dense import ranked

K1, B = 1.5, 0.75


@dataclass
class SparseIndex:
    """postings (term, chunk_key, tf, dl), lengths (chunk_key, dl), terms (term, df), corpus (n_docs, total_len)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame


def index(chunks: DataFrame) -> SparseIndex:
    """Of (chunk_key, text). Chunks without a token count in the corpus but have no postings.

    A chunk's tokens are counted in its own row, from their sorted list, so building the index moves nothing.
    """
    tokens = T.tokens(F.coalesce("text", F.lit("")))
    lengths = chunks.select("chunk_key", F.size(tokens).cast("long").alias("dl"))
    own = let(tokens, lambda t: F.transform(runs(F.sort_array(t)), lambda r: F.struct(r["value"].alias("term"), r["n"].cast("long").alias("tf"), F.size(t).cast("long").alias("dl"))))
    postings = chunks.select("chunk_key", F.inline(own)).select("term", "chunk_key", "tf", "dl")
    return of_parts(postings, lengths)


def of_parts(postings: DataFrame, lengths: DataFrame) -> SparseIndex:
    """Document frequencies and corpus sums belong to what is there; both parts can grow by appending."""
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    return SparseIndex(postings, lengths, terms, corpus)


def scores(ix: SparseIndex, queries: DataFrame) -> DataFrame:
    """query_id, chunk_key, score for each chunk that shares a term; a term counts as often as the query has it.

    Terms of the queries choose their postings by a semi-join; frequencies are needed for these terms alone, and a posting
    has its chunk's length with it. The one-row corpus table is broadcast. An index that is searched often should be saved
    first: otherwise each search reads the texts three times.
    """
    asked = queries.select("query_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    postings = ix.postings.join(asked.select("term").distinct(), "term", "left_semi")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = F.broadcast(ix.corpus)
    weights = asked.join(terms, "term").join(corpus).select("query_id", "term", (F.col("times") * idf).alias("w"))
    # what depends on the chunk alone is worked out before the queries multiply the rows
    dampened = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n_docs") / F.col("total_len")))
    parts = postings.join(corpus).select("term", "chunk_key", dampened.alias("part"))
    return parts.join(weights, "term").groupBy("query_id", "chunk_key").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))


def search(ix: SparseIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_key, score, rank; ties go to the smaller key."""
    return ranked(scores(ix, queries), k)
