import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, sections
from lectern.sources import documents, index_io, testset
from lectern.operators import sparse

HEADINGS = """front matter is dropped
ABSTRACT
We do things.
1. Introduction
no heading above
2 Background
About it.
2.1 Sub Part
More.
3
Model Arch
Deep.
IV. Experiments
Runs.
XI. None
. Foo bar
RELATED WORK
End."""


def test_headings():
    got = [(t, n) for t, n, _ in sections.headings(HEADINGS)]
    assert got == [("Abstract", 1), ("2 Background", 1), ("2.1 Sub Part", 2), ("3 Model Arch", 1), ("IV Experiments", 1), (" Foo bar", 1), ("Related Work", 1)]


def test_near_headings_keep_the_longer():
    assert [t for t, _, _ in sections.headings("1 Abcd\n2 Efghijk\nx")] == ["2 Efghijk"]
    assert [t for t, _, _ in sections.headings("1 Abcd efg\n2 Efg\nx")] == ["1 Abcd efg", "2 Efg"]


def test_sections(spark):
    df = spark.createDataFrame([(1, HEADINGS), (2, "no headings\nat all"), (3, None), (4, "2 Last Heading")], "doc_id long, text string")
    rows = sections.sections(df).orderBy("doc_id", "section_idx").collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [(r["title"], r["content"]) for r in first[:3]] == [("Abstract", "We do things.\n1. Introduction\nno heading above"), ("2 Background", "About it."), ("2.1 Sub Part", "More.")]
    assert [(r["title"], r["level"], r["content"]) for r in rows if r["doc_id"] > 1] == [("Full Document", 1, "no headings\nat all"), ("Full Document", 1, ""), ("2 Last Heading", 1, "2 Last Heading")]
    assert [r["title"] for r in sections.named(sections.sections(df), "rel").collect()] == ["Related Work"]
    text = {r["doc_id"]: r["text"] for r in sections.outline(sections.sections(df)).collect()}
    assert "## 2.1 Sub Part\n\nMore.\n\n# 3 Model Arch" in text[1]


def walk(lengths, start, end):
    at = first = 0
    for i, n in enumerate(lengths):
        if at + n >= start and not first:
            first = i + 1
        if at + n >= end:
            return first, i + 1
        at += n + 2
    return first, len(lengths)


def test_pages(spark):
    pages = [(1, 1, "Preprint\nSome title here\n2 First Part\n" + "a " * 30), (1, 2, "Page 2\n" + "b " * 40 + "\n3 Second Part\nx"), (1, 3, "tail " * 10 + "\n3 of 9"), (2, 1, "plain")]
    docs = sections.joined_pages(spark.createDataFrame(pages, "doc_id long, page_no int, text string"))
    lengths = {r["doc_id"]: r["page_lengths"] for r in docs.collect()}
    rows = sections.with_pages(sections.sections(docs), docs).collect()
    for r in rows:
        want = (1, 1) if r["bare"] else walk(lengths[r["doc_id"]], r["start"], r["end"])
        assert (r["page_start"], r["page_end"]) == want
    assert {r["title"] for r in rows} == {"2 First Part", "3 Second Part", "Full Document"}


@pytest.mark.parametrize("n", [0, 1, 800, 801, 900, 1000, 1001, 5000])
def test_windows_cover_the_text(n):
    text = "".join("x" if i % 7 else " " for i in range(n))
    got = chunking.windows(text, 1000, 200)
    assert all(text[a:b].strip() == t for t, a, b in got)
    assert all(b - 200 == a2 for (_, _, b), (_, a2, _) in zip(got, got[1:]))
    if n == 900:
        assert [(a, b) for _, a, b in got] == [(0, 1000), (800, 1800)]


def test_windows_end():
    text = "y" * 1500 + " " + "z" * 4000
    got = chunking.windows(text, 1000, 200)
    assert got[-1][2] >= len(text) and len(got) < 12
    assert chunking.windows("a" * 100 + " " + "b" * 3000, 1000, 200)[-1][2] >= 3101


def test_fixed(spark):
    df = spark.createDataFrame([(1, "a b " * 400), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.fixed(df, 100, 20).where("doc_id = 1").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and chunking.fixed(df).where("doc_id > 1").count() == 0
    with pytest.raises(ValueError):
        chunking.fixed(df, 100, 100)


def test_passages():
    first, short, full, long = "s" * 20, "t" * 30, "u" * 1490, "Word one. " * 200
    got = chunking.passages("\n\n".join([first, short, full, short, long, short]), 1500, 100)
    assert got[0] == (f"{first}\n\n{short}", "merged_paragraph") and got[1] == (full, "paragraph") and got[2] == (short, "paragraph")
    assert all(b == "sentence" and len(t) <= 1500 for t, b in got[3:-1]) and got[-1][1] == "merged_paragraph" and got[-1][0].endswith(short)
    assert chunking.passages("v" * 3000, 1500, 100) == [("v" * 3000, "sentence")]


def test_merged(spark):
    rows = [(1, 0, "a", "paragraph", [1.0, 0.0]), (1, 1, "b", "paragraph", [0.9, 0.1]), (1, 2, "c", "paragraph", [0.0, 1.0]), (1, 3, "d" * 20, "paragraph", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, boundary string, vector array<double>")
    got = [tuple(r)[1:] for r in chunking.merged(df, 20).orderBy("chunk_id").collect()]
    assert got == [(0, "a\n\nb", "semantic_merge", 0.9), (1, "c", "paragraph", None), (2, "d" * 20, "paragraph", None)]


def test_merged_at_the_threshold(spark):
    # eight times 0.1, one after the other, is 0.8 less the last bit; the others lie half way between two of three places
    pairs = {1: ([0.1] * 8, [1.0] * 8), 2: ([0.8015], [1.0]), 3: ([0.8025], [1.0]), 4: ([0.7999], [1.0])}
    rows = [(doc, i, "ab"[i], "paragraph", v) for doc, p in pairs.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, boundary string, vector array<double>")
    got = chunking.merged(df, 20, 0.8).orderBy("doc_id", "chunk_id").collect()
    assert [(r["doc_id"], r["text"], r["merge_sim"]) for r in got] == [(1, "a\n\nb", 0.8), (2, "a\n\nb", 0.802), (3, "a\n\nb", 0.802), (4, "a", None), (4, "b", None)]


def test_merged_over_batches(spark):
    """A chunk that grows through several batches, documents that begin within one, one without a number."""
    sizes = {1: 5, 2: 1, 3: 4, None: 3}
    rows = [(doc, i, f"{doc}.{i}", "paragraph", [1.0, 0.0]) for doc, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, boundary string, vector array<double>").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = {(r["doc_id"], r["chunk_id"]): r["text"].split("\n\n") for r in chunking.merged(df, 15).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {(1, 0): ["1.0", "1.1", "1.2"], (1, 1): ["1.3", "1.4"], (2, 0): ["2.0"], (3, 0): ["3.0", "3.1", "3.2"], (3, 1): ["3.3"], (None, 0): ["None.0", "None.1"], (None, 1): ["None.2"]}


def test_hierarchical(spark):
    df = spark.createDataFrame([(1, 0, "A", 1, "x" * 200, 1, 2), (1, 1, "Blank", 1, "  ", 2, 2), (1, 2, "B", 2, "y" * 150 + "\n\n" + "z" * 150, 2, 3)], "doc_id long, section_idx int, title string, level int, content string, page_start int, page_end int")
    rows = chunking.hierarchical(df).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["section"], r["section_level"], r["page_end"]) for r in rows] == [(0, "A", 1, 2), (1, "B", 2, 3), (2, "B", 2, 3)]
    assert rows[0]["text"].startswith("[Section: A]\nxxx")


def test_stats(spark):
    df = spark.createDataFrame([("s", "a b"), ("s", "abcd")], "strategy string, text string")
    assert chunking.stats(df).first().asDict() == {"strategy": "s", "count": 2, "total_chars": 7, "total_words": 3, "avg_chars": 4, "avg_words": 2, "min_chars": 3, "max_chars": 4, "std_chars": 0}


def test_samples(spark):
    df = spark.createDataFrame([("a", 1, i, str(i)) for i in range(5)] + [("b", 1, 0, "x")], "strategy string, doc_id long, chunk_id int, text string")
    assert {(r["strategy"], r["text"]) for r in chunking.samples(df).collect()} == {("a", "2"), ("b", "x")}


def test_test_set(spark, tmp_path):
    cases = testset.built_in(spark)
    assert cases.count() == 13 and testset.chosen(cases, "unanswerable").count() == 2 and testset.chosen(cases, difficulty="hard").count() == 2
    path = f"file://{tmp_path}/set"
    testset.write(cases, path, "own")
    back = testset.read(spark, path)
    assert back.count() == 13 and back.first()["description"] == ""
    assert {r["question"] for r in back.collect()} == {r["question"] for r in cases.collect()}
    (tmp_path / "bad.json").write_text('{"name": "n", "paper": "p", "cases": [{"question": "q", "wrong": 1}]}')
    with pytest.raises(TypeError):
        testset.read(spark, f"file://{tmp_path}/bad.json")


def test_index_files(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red fox", "A", [1.0, 0.0]), (2, "blue fox", "B", [0.0, 1.0])], "chunk_key long, text string, section string, vector array<double>")
    built = []

    def build(docs):
        built.append(1)
        return index_io.Index(docs, sparse.index(docs), "given", 2)

    path = f"file://{tmp_path}/index"
    for _ in range(2):
        ix = index_io.open_or_build(spark, path, chunks, build)
    assert len(built) == 1 and ix.dim == 2 and ix.chunks.count() == 2
    asked = spark.createDataFrame([(0, "blue")], "query_id long, text string")
    assert [r["chunk_key"] for r in sparse.search(ix.sparse, asked).collect()] == [2]
    index_io.open_or_build(spark, path, chunks.withColumn("text", F.upper("text")), build)
    assert len(built) == 2
    with pytest.raises(ValueError):
        index_io.load(spark, path, 3)


def test_index_grows(spark, tmp_path):
    schema = "chunk_key long, text string, section string, vector array<double>"
    rows = [(1, "red fox", "A", [1.0, 0.0]), (2, "blue fox", "B", [0.0, 1.0]), (3, "blue blue sky", "C", [0.6, 0.8]), (4, "red sky", "C", [0.8, 0.6])]
    asked = spark.createDataFrame([(0, "blue sky")], "query_id long, text string")
    whole, first, more = (spark.createDataFrame(r, schema) for r in (rows, rows[:2], rows[2:]))
    made = lambda df: index_io.Index(df, sparse.index(df), "given", 2)
    want = {tuple(r) for r in sparse.search(made(whole).sparse, asked).collect()}
    grown = index_io.added(made(first), more)
    assert {tuple(r) for r in sparse.search(grown.sparse, asked).collect()} == want and grown.chunks.count() == 4
    path = f"file://{tmp_path}/index"
    index_io.save(made(first), path)
    saved = index_io.append(spark, path, more)
    assert {tuple(r) for r in sparse.search(saved.sparse, asked).collect()} == want and saved.chunks.count() == 4
    assert spark.read.json(f"{path}/config").first()["num_chunks"] == 4
    with pytest.raises(ValueError):
        index_io.append(spark, path, spark.createDataFrame([(9, "x", "D", [1.0])], schema))


def test_fingerprint(spark):
    mark = lambda *rows: index_io.fingerprint(spark.createDataFrame(list(rows), "a string, b string"))
    assert mark(("x", "y"), ("z", "w")) == mark(("z", "w"), ("x", "y"))
    assert len({mark(("x", "y"), ("x", "y")), mark(("z", "w"), ("z", "w")), mark(("x", "y")), mark((None, "x")), mark(("x", None)), mark(("", "x"))}) == 6


def test_html(spark):
    df = spark.createDataFrame([(1, "<html><h1 class=x>The <b>Title</b></h1><p>one</p>\n<p>two <i>x</i></p></html>"), (2, "nothing")], "doc_id long, html string")
    assert [(r["title"], r["content"]) for r in documents.html_sections(df).orderBy("doc_id").collect()] == [("The Title", "one\n\ntwo x"), ("", "")]


def test_pdf_needs_a_library(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="PyMuPDF"):
        documents.read_pdf_pages(spark, f"file://{tmp_path}/a.pdf").collect()
