"""Retrieval and question answering as whole plans."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, evaluation, fusion, generation, sparse


@dataclass
class HybridRetriever:
    """Dense and sparse search, fused by rank, and reranked if there is a reranker or `stand_in` is set. Chunks without a vector
    are found by their words."""

    chunks: DataFrame  # chunk_key, chunk_id, section, text, vector
    index: sparse.SparseIndex
    reranker: fusion.Reranker | None = None
    stand_in: bool = False
    dense_top_k: int = 20
    sparse_top_k: int = 20
    fusion_top_n: int = 20
    final_top_k: int = 5

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """query_id, chunk_key, chunk_id, section, text, score, rank, found_by[, rerank_score, original_rank] of (query_id, text, vector)."""
        k = top_k or self.final_top_k
        near = dense.search(self.chunks.where("vector IS NOT NULL"), queries, self.dense_top_k)
        words = sparse.search(self.index, queries, self.sparse_top_k)
        rerank = self.reranker is not None or self.stand_in
        fused = fusion.fuse([near, words], top=self.fusion_top_n if rerank else k)
        full = fused.join(self.chunks.drop("vector"), "chunk_key")
        if not rerank:
            return full
        asked = full.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        return fusion.rerank(asked, self.reranker, k).drop("query")


def answer(queries: DataFrame, hits: DataFrame, backend: generation.Backend, max_tokens: int = 4000) -> DataFrame:
    """Checked answers to (query_id, text) from their hits. A query without hits gets the fixed refusal, which claims nothing
    and so is faithful; one whose hits are all too long is asked without context."""
    block = generation.context(generation.fitting(hits, max_tokens))
    prompts = queries.select("query_id", F.col("text").alias("query")).join(block, "query_id", "left").withColumn("chunks_provided", F.coalesce("chunks_provided", F.array().cast("array<bigint>")))
    said, bare = generation.checked(generation.answers(prompts, backend)), F.col("context").isNull()
    return said.withColumn("uncited", F.when(bare, F.array().cast("array<string>")).otherwise(F.col("uncited"))).withColumn("faithful", bare | F.col("faithful"))


def evaluate(cases: DataFrame, retriever: HybridRetriever, backends: dict[str, generation.Backend], k: int = 5) -> DataFrame:
    """Scores of all cases (query_id, text, vector, expected_sections, answer_type) by model, and elapsed_seconds.

    Retrieval is done once for all models; its time counts for each, as if the model had been evaluated alone. Cases are a
    test set, so their hits and scores are kept in the session until the result is dropped.
    """
    began = time.perf_counter()
    hits = retriever.search(cases, k).persist()
    found = evaluation.retrieval_scores(cases, hits, k).persist()
    found.count()
    searched, out = time.perf_counter() - began, None
    for name, backend in backends.items():
        began = time.perf_counter()
        said = evaluation.answer_scores(cases, answer(cases, hits, backend)).persist()
        said.count()
        took = searched + time.perf_counter() - began
        part = found.join(said, "query_id").withColumn("model", F.lit(name)).withColumn("elapsed_seconds", F.lit(took))
        out = part if out is None else out.unionByName(part)
    hits.unpersist()
    return out
