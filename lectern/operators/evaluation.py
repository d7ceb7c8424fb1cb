"""Scores of retrieval and answers, their means by model, and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Metrics of a summary and whether more is better.
METRICS = {"avg_recall": True, "avg_mrr": True, "avg_precision": True, "citation_rate": True, "faithfulness_rate": True, "no_answer_accuracy": True, "elapsed_seconds": False}


def sections_match(a: Column, b: Column) -> Column:
    """Either holds the other, in any case. An empty name matches all."""
    x, y = T.strip(F.lower(a)), T.strip(F.lower(b))
    return x.contains(y) | y.contains(x)


def retrieval_scores(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, mrr, precision, k of cases (query_id, expected_sections) and hits (query_id, section, rank).

    Without expected sections recall is 1 and the others 0. precision is of what was retrieved, be it fewer than k.
    A query's hits are k at most, so the comparison stays within its own row.
    """
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("section", F.lit("")).alias("section")))).alias("h"))
    rows = cases.join(top, "query_id", "left")
    h = F.coalesce("h", F.array().cast("array<struct<rank:int,section:string>>"))
    expected = F.coalesce("expected_sections", F.array().cast("array<string>"))
    relevant = F.filter(h, lambda x: F.exists(expected, lambda e: sections_match(x["section"], e)))
    found = F.filter(expected, lambda e: F.exists(h, lambda x: sections_match(x["section"], e)))
    rows = rows.select("query_id", F.size(expected).alias("e"), F.size(h).alias("n"), F.size(relevant).alias("r"), F.size(found).alias("f"), F.get(relevant, F.lit(0))["rank"].alias("first"))
    any_ = F.col("e") > 0
    return rows.select(
        "query_id",
        F.when(any_, F.try_divide("f", "e")).otherwise(1.0).alias("recall"),
        F.when(any_, F.coalesce(1 / F.col("first"), F.lit(0.0))).otherwise(0.0).alias("mrr"),
        F.when(any_, F.coalesce(F.try_divide("r", "n"), F.lit(0.0))).otherwise(0.0).alias("precision"),
        F.lit(k).alias("k"),
    )


def answer_scores(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, answer_type, has_citations, citation_count, faithful, no_answer_correct, answer_length."""
    rows = cases.select("query_id", "answer_type").join(answers, "query_id")
    right = F.when(F.col("answer_type") == "unanswerable", F.col("no_answer")).otherwise(~F.col("no_answer"))
    return rows.select("query_id", "answer_type", (F.col("n_citations") > 0).alias("has_citations"), F.col("n_citations").alias("citation_count"), "faithful", right.alias("no_answer_correct"), F.length("answer").alias("answer_length"))


def summary(scores: DataFrame) -> DataFrame:
    """One row for each model of (model, answer_type, recall, mrr, precision, has_citations, faithful, no_answer_correct[, elapsed_seconds]).

    Citation and faithfulness rates are of answerable cases, all else of all. What has no cases is 0.
    """
    answerable = F.col("answer_type") != "unanswerable"
    rate = lambda c, where=None: F.coalesce(F.avg(F.col(c).cast("double") if where is None else F.when(where, F.col(c).cast("double"))), F.lit(0.0))
    elapsed = F.max("elapsed_seconds") if "elapsed_seconds" in scores.columns else F.lit(0.0)
    return scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("test_cases"),
        rate("recall").alias("avg_recall"),
        rate("mrr").alias("avg_mrr"),
        rate("precision").alias("avg_precision"),
        rate("has_citations", answerable).alias("citation_rate"),
        rate("faithful", answerable).alias("faithfulness_rate"),
        rate("no_answer_correct").alias("no_answer_accuracy"),
        F.coalesce(elapsed, F.lit(0.0)).cast("double").alias("elapsed_seconds"),
    )


def compared(summaries: DataFrame) -> DataFrame:
    """model, metric, value."""
    return summaries.unpivot("model", list(METRICS), "metric", "value")


def rounded(summaries: DataFrame) -> DataFrame:
    """Summaries as they are shown: metrics to 3 places, seconds to 1."""
    return summaries.select("model", "test_cases", *(F.round(c, 1 if c == "elapsed_seconds" else 3).alias(c) for c in METRICS))


def winners(summaries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """metric, model, value: the best model of each metric after rounding; ties go to the first in `order`, then by name."""
    rows = compared(rounded(summaries))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("model")), F.lit(0)) if order else F.lit(0)
    less = [m for m, more in METRICS.items() if not more]
    better = F.when(F.col("metric").isin(*less), F.col("value")).otherwise(-F.col("value"))
    return rows.groupBy("metric").agg(F.min_by(F.struct("model", "value"), F.struct(better.alias("b"), place.alias("p"), "model")).alias("w")).select("metric", "w.model", "w.value")


def worst(scores: DataFrame, n: int = 3) -> DataFrame:
    """The n cases of lowest recall of each model, if it is below 1."""
    order = Window.partitionBy("model").orderBy("recall", "query_id")
    return scores.withColumn("place", F.row_number().over(order)).where((F.col("place") <= n) & (F.col("recall") < 1))


def side_by_side(dense: DataFrame, sparse: DataFrame, n: int = 5) -> DataFrame:
    """query_id, rank, dense_key, dense_score, sparse_key, sparse_score: two result lists next to each other."""
    part = lambda hits, name: hits.where(F.col("rank") <= n).select("query_id", "rank", F.col("chunk_key").alias(f"{name}_key"), F.col("score").alias(f"{name}_score"))
    return part(dense, "dense").join(part(sparse, "sparse"), ["query_id", "rank"], "full_outer")


def overlap(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """query_id, shared: chunks that both lists have among their first n; queries of either list."""
    top = lambda hits: hits.where(F.col("rank") <= n).select("query_id", "chunk_key")
    counts = top(a).distinct().unionAll(top(b).distinct()).groupBy("query_id", "chunk_key").agg(F.count(F.lit(1)).alias("lists"))
    return counts.groupBy("query_id").agg(F.count_if(F.col("lists") == 2).alias("shared"))


def section_lists(methods: dict[str, DataFrame]) -> DataFrame:
    """method, query_id, sections: the first 25 characters of each hit's section, by rank."""
    out = None
    for name, hits in methods.items():
        part = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.coalesce("section", F.lit("?")), 1, 25).alias("s")))).alias("x"))
        part = part.select(F.lit(name).alias("method"), "query_id", F.transform("x", lambda e: e["s"]).alias("sections"))
        out = part if out is None else out.unionAll(part)
    return out
