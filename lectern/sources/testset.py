"""Sets of evaluation cases as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "question string, expected_answer string, expected_sections array<string>, answer_type string, difficulty string, tags array<string>"
SET = f"name string, paper string, description string, cases array<struct<{', '.join(x.replace(' ', ':', 1) for x in CASE.split(', '))}>>"

_ABOUT = [
    ("What does a chunk keep about its section?", "Title, level and pages", ["Chunking"], "factual", "easy"),
    ("How many characters overlap between fixed windows by default?", "200", ["Chunking"], "factual", "easy"),
    ("Which constant does rank fusion use?", "60", ["Fusion"], "factual", "easy"),
    ("What is k1 in BM25 here?", "1.5", ["Sparse Retrieval"], "factual", "easy"),
    ("How many tokens may a context have?", "4000", ["Generation"], "factual", "easy"),
    ("Why are ranks fused and not scores?", "Scores of different methods have different scales", ["Fusion"], "conceptual", "medium"),
    ("Why are short paragraphs merged?", "They carry too little meaning alone", ["Chunking"], "conceptual", "medium"),
    ("How does reranking change the results?", "It scores each pair of query and text", ["Reranking", "Fusion"], "conceptual", "medium"),
    ("Why is a refusal right for some questions?", "The context holds no answer", ["Evaluation"], "conceptual", "medium"),
    ("What happens to a window without a late space?", "The next one begins at its end", ["Chunking"], "factual", "hard"),
    ("Which sentences count as uncited?", "Those of 20 characters and more without a citation", ["Citations"], "factual", "hard"),
    ("Who won the 1930 football world cup?", "", [], "unanswerable", "easy"),
    ("What is the price of the engine?", "", [], "unanswerable", "easy"),
]


DEMO = [
    (0, "how are distant parts of a text related to each other", "semantic"),
    (1, "BM25 k1 b idf", "keyword"),
    (2, "what is rank fusion and why is it used", "mixed"),
    (3, "section on chunk sizes and overlap", "structural"),
]


def built_in(spark: SparkSession) -> DataFrame:
    """Thirteen cases about this engine."""
    return spark.createDataFrame([(i, *c, [c[3], c[4]]) for i, c in enumerate(_ABOUT)], f"case_id long, {CASE}")


def demo_queries(spark: SparkSession) -> DataFrame:
    """Four queries, each of a kind that another way of searching is good at."""
    return spark.createDataFrame(DEMO, "query_id long, text string, note string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """case_id and the cases of a set. A key that no case has raises; a missing description is ''."""
    raw = spark.read.option("wholetext", True).text(path).first()["value"]  # one small file
    known = {x.split(" ")[0] for x in CASE.split(", ")}
    if unknown := {k for c in json.loads(raw)["cases"] for k in c} - known:
        raise TypeError(f"unknown keys in cases: {', '.join(sorted(unknown))}")
    sets = spark.read.schema(SET).option("multiLine", True).json(path)
    return sets.select("name", "paper", F.coalesce("description", F.lit("")).alias("description"), F.posexplode("cases").alias("case_id", "c")).select(F.col("case_id").cast("long"), "c.*", "name", "paper", "description")


def write(cases: DataFrame, path: str, name: str, paper: str = "", description: str = "") -> None:
    columns = [x.split(" ")[0] for x in CASE.split(", ")]
    rows = cases.agg(F.array_sort(F.collect_list(F.struct("case_id", *columns))).alias("c"))
    one = rows.select(F.lit(name).alias("name"), F.lit(paper).alias("paper"), F.lit(description).alias("description"), F.transform("c", lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("cases"))
    one.coalesce(1).write.mode("overwrite").json(path)


def chosen(cases: DataFrame, answer_type: str | None = None, difficulty: str | None = None) -> DataFrame:
    out = cases if answer_type is None else cases.where(F.col("answer_type") == answer_type)
    return out if difficulty is None else out.where(F.col("difficulty") == difficulty)
