"""Command line: python -m lectern.cli QUERY [--dir TABLES], ask, evaluate, or models."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries
from .operators import embedding, evaluation, generation, sparse
from .plans import retriever
from .sources import testset


def _session() -> SparkSession:
    return SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _ask(spark: SparkSession, folder: str, backend: generation.Backend) -> None:
    """Questions from standard input over the documents of a folder; 'quit' ends, 'switch NAME' changes the model, 'models' lists them."""
    chunks = queries._chunks(spark, folder)
    chunks = chunks.join(embedding.hash_embed(chunks, ["chunk_key"]), "chunk_key").persist()
    search = retriever.HybridRetriever(chunks, sparse.index(chunks), stand_in=True)
    for line in map(str.strip, sys.stdin):
        if line in ("quit", "exit", "q"):
            return
        if line == "models":
            generation.presets(spark).show(truncate=False)
        elif line.startswith("switch "):
            backend = generation.preset(line.removeprefix("switch ").strip())
        elif line:
            asked = spark.createDataFrame([(0, line)], "query_id long, text string")
            asked = asked.join(embedding.hash_embed(asked, ["query_id"]), "query_id")
            said = retriever.answer(asked, search.search(asked), backend)
            said.select("answer").show(truncate=False)
            generation.summary(said).select("summary").show(truncate=False)


def _evaluate(spark: SparkSession, folder: str, backends: dict[str, generation.Backend], test_set: str | None, verbose: bool) -> None:
    """A test set (the built-in one by default) over the documents of a folder: metrics side by side, the best model of each, and
    the worst cases of each model."""
    chunks = queries._chunks(spark, folder)
    chunks = chunks.join(embedding.hash_embed(chunks, ["chunk_key"]), "chunk_key").persist()
    cases = testset.read(spark, test_set) if test_set else testset.built_in(spark)
    cases = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"), "expected_sections", "answer_type")
    cases = cases.join(embedding.hash_embed(cases, ["query_id"]), "query_id")
    scores = retriever.evaluate(cases, retriever.HybridRetriever(chunks, sparse.index(chunks), stand_in=True), backends)
    summary = evaluation.summary(scores)
    table = evaluation.compared(evaluation.rounded(summary)).groupBy("metric").pivot("model", list(backends)).agg(F.first("value"))
    table.show(truncate=False)
    evaluation.winners(summary, list(backends)).show(truncate=False)
    if verbose:
        evaluation.worst(scores).join(cases.select("query_id", "text", "expected_sections"), "query_id").orderBy("model", "place").show(truncate=80)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    parser.add_argument("what", choices=[*queries.QUERIES, "ask", "evaluate", "models"])
    parser.add_argument("--dir", default="/root/testdata/sf0.001")
    parser.add_argument("--model", action="append", default=[], help="a preset, several for evaluate; the offline stand-in by default")
    parser.add_argument("--test-set", help="a JSON file of cases, for evaluate")
    parser.add_argument("--quiet", action="store_true", help="no single cases")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    options = parser.parse_args(args)
    backends = {m: generation.preset(m) for m in options.model} or {"extractive": generation.backend("extractive")}
    spark = _session()
    if options.what == "models":
        generation.presets(spark).show(truncate=False)
    elif options.what == "ask":
        _ask(spark, options.dir, next(iter(backends.values())))
    elif options.what == "evaluate":
        _evaluate(spark, options.dir, backends, options.test_set, not options.quiet)
    else:
        queries.QUERIES[options.what](spark, options.dir).show(options.rows, truncate=80)


if __name__ == "__main__":
    main()
