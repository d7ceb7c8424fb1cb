"""Pages of PDF files, documents, and HTML pages as sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = "doc_id string, page_no int, text string, n_pages int, metadata map<string,string>"


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_no, text, n_pages, metadata of PDF files. Needs a PDF library on the executors, which is optional."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches):
        import pandas as pd

        try:
            import fitz
        except ImportError as e:
            raise ImportError("reading PDF files needs PyMuPDF on the executors") from e
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    meta = {k: (doc.metadata or {}).get(k) or "" for k in ("title", "author", "subject", "creator", "keywords")}
                    rows += [(path, i + 1, page.get_text("text"), len(doc), meta) for i, page in enumerate(doc)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "n_pages", "metadata"])

    return files.mapInPandas(pages, PAGE)


def with_titles(docs: DataFrame, title_column: str | None = None) -> DataFrame:
    """docs with `title`: the given one, or the first long line of the text that begins with no digit."""
    own = T.title_of(F.col("text"))
    return docs.withColumn("title", F.coalesce(F.nullif(F.col(title_column), F.lit("")), own) if title_column else own)


def html_sections(pages: DataFrame) -> DataFrame:
    """doc_id, section_idx, title, level, content of (doc_id, html): the heading as title, paragraphs as content."""
    bare = lambda x: F.regexp_replace(x, "<[^>]+>", "")
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), bare)
    title = bare(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select("doc_id", F.lit(0).alias("section_idx"), title.alias("title"), F.lit(1).alias("level"), F.array_join(paragraphs, "\n\n").alias("content"))
