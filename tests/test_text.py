import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T


def run(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip(spark):
    values = ["  a ", "\xa0a　", "\x1ca\n", "", " ", "a b", "\n\ta\r\n", " a\x85", "a\n"]
    assert run(spark, T.strip, values) == [v.strip() for v in values]


def test_running_lines(spark):
    lines = ["12", "12a", "Page 3 of it", "3 of 12", "Proceedings of", "arXiv:1", "Vol. 3", "Preprint.", "Under review as", "Smith et al.", "Élan et al. 2", " 7 ", "", "text", "page" + " 3" + "x" * 150]
    assert run(spark, T.is_running_line, lines) == [True, False, True, True, True, True, True, True, True, True, True, True, False, False, False]
    page = "\n".join(["3", "title", "Page 3", "body", "7", "end", "Preprint"])
    assert run(spark, T.without_running_lines, [page, "3", "a"]) == ["title\nPage 3\nbody\n7\nend", "", "a"]


def test_cleaned(spark):
    values = ["a-\nb-\nc", "é-\né", "ﬁrst ﬂow oﬀ eﬃx raﬄe", "a—b–c “d” ‘e’ f’s", "x\na\nb\ny", "a\n\n\n\nb", "\xa0 pad\t", "- \nx"]
    assert run(spark, T.cleaned, values) == ["ab-\nc", "éé", "first flow off effix raffle", "a--b-c \"d\" 'e' f's", "x\nb\ny", "a\n\nb", "pad", "- \nx"]


def test_tokens(spark):
    assert run(spark, T.tokens, ["Été 28.4 v1.0.2 a x-y BLEU 3. 5.", "", "été"]) == [["28.4", "v1.0.2", "bleu"], [], []]


def test_paragraphs(spark):
    assert run(spark, T.paragraphs, ["a\n\n b\n \t\n\nc\nd\n\n", "", "one"]) == [["a", "b", "c\nd"], [], ["one"]]


def split_model(text):
    """Sentences by a walk over the pieces."""
    out, held = [], ""
    parts = re.split(r"\.\s+", text)
    for n, part in enumerate(parts, 1):
        held = held + ". " + part if held else part
        words = part.split()
        if n == len(parts):
            out.append(held.strip())
        elif not (words and words[-1].lower().rstrip(".") in T.ABBREVIATIONS):
            out.append(held.strip() + ".")
            held = ""
    return [s for s in out if s]


SENTENCES = ["See Fig. 3 now. Then (Fig. 4) e.g. this. Smith et al. said. End", "A? B! C.", "Dr. Mr. X. Y", "etc.. next. z", "a. . b", "", "One.", "x vs. y.\nz", "Prof.  A.  B. ", ". a", "al. al. al. x"]


def test_sentences(spark):
    assert run(spark, T.sentences, SENTENCES) == [split_model(s) for s in SENTENCES]


@pytest.mark.parametrize("seed", range(3))
def test_sentences_at_random(spark, seed):
    import random

    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "Dr", "fig", "et al", ". ", ".", " ", "\n", ".. ", "B", "? "]) for _ in range(25)) for _ in range(150)]
    assert run(spark, T.sentences, texts) == [split_model(t) for t in texts]


def test_title(spark):
    assert run(spark, T.title_of, ["short\n3 begins with a digit\n  A proper title  \nnext line is long", "none", "12345678901"]) == ["A proper title", "", ""]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aB. \nDrfigal")), max_size=40))
def test_python_sentences(text):
    from lectern.operators.chunking import python_sentences

    assert python_sentences(text) == split_model(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["al", "Dr", "x", ".", ". ", " ", "\n", ".. "]), max_size=14).map("".join))
def test_python_sentences_one_by_one(text):
    from lectern.operators.chunking import python_sentences

    held = re.sub(rf"(^|\s)({'|'.join(T.ABBREVIATIONS)})(\.*|\s+)\.\s+", "\\1\\2\\3.\x01", text, flags=re.I)
    parts = re.split(r"\.\s+", held)
    want = [p.replace("\x01", " ").strip() + "." * (i < len(parts)) for i, p in enumerate(parts, 1)]
    assert [" ".join(s.split()) for s in python_sentences(text, False)] == [" ".join(s.split()) for s in want if s]
