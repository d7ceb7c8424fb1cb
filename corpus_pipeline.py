"""The training-data pipeline: quality rules, near-dedup, substring dedup, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; n_chars follows the text. The quality rules and
near-dedup decide on each row by itself, whether it has an id, shares one or has none. Null ids and texts, repeated rows,
texts of any length and empty tables go through as the operators' docstrings say; other columns of the input are left out.

A stage's tables in the shared folder are deleted when a later stage begins, whose docs are written by then; docs that
still read them keep them.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, minhash, packing, pii, quality, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@contextlib.contextmanager
def _stage(spark: SparkSession, docs: DataFrame, name: str) -> Iterator[None]:
    common.ready(spark)
    for earlier, _ in STAGES[: [n for n, _ in STAGES].index(name)]:
        common.release(spark, earlier, docs)
    with common.owned_by(spark, name):
        yield


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row, a number for each row, in order of doc_id and rows without one last; written, so that it stays the same."""
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("at"))  # parts a common id when rows are dealt by range
    return common.written(rows.sort(F.asc_nulls_last("doc_id"), "at").drop("at").withColumn("row", F.monotonically_increasing_id()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base rules or lies outside its language's perplexity band go."""
    with _stage(spark, docs, "quality rules"):
        judged = quality.judged(docs.withColumn("given_lang", F.col("lang")), extra=("text", "given_lang", "source", "n_chars"))
    return judged.where("kept").select("doc_id", "text", F.col("given_lang").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate rows one with the smallest id stays, or one without an id if none has one."""
    with _stage(spark, docs, "near-dedup"):
        rows = _numbered(docs)
        gone = minhash.near_duplicates(rows, id_column="row").where("NOT kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words and more that a document with a smaller id has too are cut out of the text."""
    with _stage(spark, docs, "substring dedup"):
        cut = substring.without_repeats(docs, with_text=True, extra=("lang", "source"))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by surrogates."""
    with _stage(spark, docs, "pii surrogates"):
        new = pii.replaced(docs.select(*COLUMNS))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 2048 ids: one row for each piece."""
    import public_tokenizers

    with _stage(spark, docs, "packing"):
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("pii surrogates", pii_surrogates),
    ("packing", pack_sequences),
]

#: Tokenizing and the language model are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:  # what the stage has read is in its own output
            common.delete(spark, f"{folder}/{number - 1}")
    for name, _ in STAGES:
        common.release(spark, name)
    return docs
