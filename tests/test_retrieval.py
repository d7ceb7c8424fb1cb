import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dense, embedding, evaluation, fusion, generation, sparse
from lectern.plans import retriever
from lectern.streaming import ingest


def bm25_model(docs, query):
    import re

    tok = lambda s: [t for t in re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", s.lower()) if len(t) > 1]
    split = {k: tok(t or "") for k, t in docs}
    n, avg = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(t for ts in split.values() for t in set(ts))
    out = {}
    for k, ts in split.items():
        tf = Counter(ts)
        s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in tok(query) if tf[t])
        if s > 0:
            out[k] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    rng = random.Random(1)
    words = ["fox", "dog", "red", "28.4", "v1.0.2", "x", "blue", "sky"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(40, None), (41, ""), (42, "red red"), (43, "red red")]
    asked = [(0, "red fox"), (1, "red red blue"), (2, "unknown"), (3, "x"), (4, "28.4 sky"), (5, None)]
    ix = sparse.index(spark.createDataFrame(docs, "chunk_key long, text string"))
    got = defaultdict(list)
    for r in sparse.search(ix, spark.createDataFrame(asked, "query_id long, text string"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_key"], r["score"]))
    for q, text in asked:
        want = bm25_model(docs, text or "")[:10]
        assert [k for k, _ in got[q]] == [k for k, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


def test_dense(spark):
    rng = random.Random(2)
    v = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)]
    got = dense.search(spark.createDataFrame(v, "chunk_key long, vector array<float>"), spark.createDataFrame(v[:7], "query_id long, vector array<float>"), 6, shards=3)
    for q, x in v[:7]:
        want = sorted(((-sum(a * b for a, b in zip(x, y)), k) for k, y in v))[:6]
        assert [(-r["score"], r["chunk_key"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert dense.search(got.limit(0).select("chunk_key", F.lit(None).cast("array<float>").alias("vector")), spark.createDataFrame(v[:1], "query_id long, vector array<float>")).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in embedding.hash_embed(df, ["id"], 16).collect()}
    twice = embedding.hash_embed(df.withColumn("id", F.lit(1)), ["id"], 16).collect()
    assert sorted(r["vector"] for r in twice) == sorted(got.values())
    assert math.isclose(sum(x * x for x in got[1]), 1) and set(got[2]) == set(got[3]) == {0.0} and len(got[1]) == 16

    class Lengths:
        name, dim = "lengths", 2

        def load(self):
            return 3.0

        def encode(self, model, texts):
            return [[len(t), model] for t in texts]

    vectors = {r["id"]: r["vector"] for r in embedding.embed(df, Lengths(), prefix="q: ", normalize=False, batch_size=2).collect()}
    assert vectors == {1: [14.0, 3.0], 2: [3.0, 3.0], 3: [3.0, 3.0]}


def hits(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "query_id long, chunk_key long, rank int")


def test_fusion(spark):
    got = fusion.fuse([hits(spark, [(1, 1), (2, 2), (3, 5)]), hits(spark, [(2, 1), (1, 3)])]).orderBy("rank").collect()
    assert [(r["chunk_key"], round(r["score"], 5), r["found_by"]) for r in got] == [(2, 0.03252, ["method_0@2", "method_1@1"]), (1, 0.03227, ["method_0@1", "method_1@3"]), (3, 0.01538, ["method_0@5"])]
    tie = fusion.fuse([hits(spark, [(5, 1)]), hits(spark, [(4, 1)])], top=1).collect()
    assert [r["chunk_key"] for r in tie] == [5]


def test_rerank(spark):
    rows = [(0, "red fox", i, t, i) for i, t in enumerate(["blue", "red dog", "a red fox", None, "fox red"], 1)]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_key long, text string, rank int")
    got = fusion.rerank(df, None, 3).orderBy("rank").collect()
    assert [(r["chunk_key"], r["rerank_score"], r["original_rank"]) for r in got] == [(3, 1.0, 3), (5, 1.0, 5), (2, 0.5, 2)]
    assert fusion.moved(fusion.rerank(df, None, 3)).first()["moved"] == 3

    class Longest:
        def load(self):
            return None

        def score(self, model, queries, texts):
            return [float(len(t or "")) for t in texts]

    assert [r["chunk_key"] for r in fusion.rerank(df, Longest(), 2).orderBy("rank").collect()] == [3, 2]


def test_context(spark):
    rows = [(0, 7, "A", "[Section: A]\naaaa", 1), (0, 8, None, "b" * 30, 2), (0, 9, "C", "c", 3), (1, 5, "D", "d" * 100, 1)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, section string, text string, rank int")
    assert [r["chunk_id"] for r in generation.trimmed(df, 10).collect()] == [7]
    got = {r["query_id"]: r for r in generation.context(generation.trimmed(df, 12)).collect()}
    assert got[0]["context"] == "--- Chunk [7] | Section: A ---\naaaa\n\n--- Chunk [8] | Section: Unknown ---\n" + "b" * 30 + "\n\n--- Chunk [9] | Section: C ---\nc"
    assert list(got) == [0] and got[0]["chunks_provided"] == [7, 8, 9]


ANSWERS = [
    ("A first claim stands here [1]. Another of them follows it [2].", True, 2, 0),
    ("Both of them say the same thing [1, 2].", False, 2, 0),
    ("A range is not read as a citation [1-3].", False, 0, 0),
    ("Nobody gave this chunk to the model [99].", False, 1, 1),
    ("A long sentence without any citation at all. Short one.", False, 0, 0),
    ("The context does not say what it is about, really.", True, 0, 0),
    ("It is after the period, as some do. [1]", False, 1, 0),
    ("", True, 0, 0),
]


def test_citations(spark):
    df = spark.createDataFrame([(i, a, [1, 2, 3, 3]) for i, (a, *_) in enumerate(ANSWERS)], "query_id long, answer string, chunks_provided array<long>")
    got = {r["query_id"]: r for r in generation.checked(df).collect()}
    assert [(got[i]["faithful"], got[i]["n_citations"], got[i]["n_invalid"]) for i in range(len(ANSWERS))] == [x[1:] for x in ANSWERS]
    assert got[0]["chunks_used"] == [1, 2] and got[0]["chunks_unused"] == [3, 3] and got[4]["chunks_unused"] == [1, 2, 3, 3]
    assert [i for i in got if got[i]["no_answer"]] == [5]
    marks = generation.citations(df).where("query_id = 1").orderBy("nth").collect()
    assert [(r["position"], r["chunk_id"], r["claim"], r["valid"]) for r in marks] == [(32, 1, "Both of them say the same thing", True), (32, 2, "Both of them say the same thing", True)]
    long = spark.createDataFrame([(0, "x" * 200 + " y [1]", [1])], "query_id long, answer string, chunks_provided array<long>")
    assert generation.citations(long).first()["claim"] == "x" * 77 + " y"
    assert "citations: 2" in {r["query_id"]: r["summary"] for r in generation.summary(generation.checked(df)).collect()}[0].split("\n")


def test_backends():
    for url, name in (("https://openrouter.ai/api/v1", "openrouter"), ("https://api.z.ai/v1", "z.ai"), ("https://api.together.xyz/v1", "together"), (None, "openai")):
        assert generation.backend("openai", "m", base_url=url).name == name
    assert generation.preset("qwen").model == "qwen2.5" and len(generation.PRESETS) == 10
    with pytest.raises(ValueError):
        generation.backend("unknown")


def test_scores(spark):
    cases = spark.createDataFrame([(0, ["Intro", "6.1 Machine Transl"], "factual"), (1, [], "unanswerable"), (2, ["Nowhere"], "factual"), (3, ["Any"], "factual"), (4, ["x"], "factual")], "query_id long, expected_sections array<string>, answer_type string")
    found = spark.createDataFrame([(0, "Other", 1), (0, "6.1 Machine Translation", 2), (0, "INTRO ", 3), (0, "Intro", 6), (1, "z", 1), (2, "q", 1), (3, None, 1)], "query_id long, section string, rank int")
    got = {r["query_id"]: (r["recall"], r["mrr"], r["precision"]) for r in evaluation.retrieval_scores(cases, found).collect()}
    assert got == {0: (1.0, 0.5, pytest.approx(2 / 3)), 1: (1.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0), 4: (0.0, 0.0, 0.0)}


def test_summary(spark):
    rows = [("b", 0, "factual", 1.0, 0.5, 0.2, True, True, True), ("b", 1, "unanswerable", 1.0, 0.0, 0.0, False, False, False), ("a", 0, "factual", 0.5, 0.5, 0.4, False, True, True), ("a", 1, "unanswerable", 0.0, 0.0, 0.0, False, False, True), ("c", 0, "unanswerable", 0.0, 0.0, 0.0, True, True, True)]
    df = spark.createDataFrame(rows, "model string, query_id long, answer_type string, recall double, mrr double, precision double, has_citations boolean, faithful boolean, no_answer_correct boolean")
    s = evaluation.summary(df)
    got = {r["model"]: r for r in s.collect()}
    assert (got["b"]["avg_recall"], got["b"]["citation_rate"], got["b"]["no_answer_accuracy"], got["c"]["citation_rate"]) == (1.0, 1.0, 0.5, 0.0)
    best = {r["metric"]: r["model"] for r in evaluation.winners(s, ["b", "a", "c"]).collect()}
    assert best["avg_recall"] == "b" and best["avg_mrr"] == "b" and best["elapsed_seconds"] == "b" and best["no_answer_accuracy"] == "a"
    assert [(r["model"], r["query_id"]) for r in evaluation.worst(df, 1).orderBy("model").collect()] == [("a", 1), ("c", 0)]


def test_comparisons(spark):
    a = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.8), (1, 9, 1, 0.5)], "query_id long, chunk_key long, rank int, score double")
    b = spark.createDataFrame([(0, 2, 1, 7.0)], "query_id long, chunk_key long, rank int, score double")
    assert {(r["query_id"], r["shared"]) for r in evaluation.overlap(a, b).collect()} == {(0, 1), (1, 0)}
    assert {tuple(r) for r in evaluation.side_by_side(a, b).collect()} == {(0, 1, 1, 0.9, 2, 7.0), (0, 2, 2, 0.8, None, None), (1, 1, 9, 0.5, None, None)}


def test_whole_plan(spark):
    chunks = spark.createDataFrame([(i, i, s, t) for i, (s, t) in enumerate([("Foxes", "The red fox jumps over dogs. It is quick."), ("Sky", "The sky is blue today."), ("Sea", "Blue sea under the blue sky.")])], "chunk_key long, chunk_id long, section string, text string")
    chunks = chunks.join(embedding.hash_embed(chunks, ["chunk_key"]), "chunk_key")
    cases = spark.createDataFrame([(0, "red fox", ["Foxes"], "factual"), (1, "blue sky", ["sky"], "factual"), (2, "zzz qqq", [], "unanswerable")], "query_id long, text string, expected_sections array<string>, answer_type string")
    cases = cases.join(embedding.hash_embed(cases, ["query_id"]), "query_id")
    for stand_in in (False, True):
        r = retriever.HybridRetriever(chunks, sparse.index(chunks), stand_in=stand_in)
        top = {x["query_id"]: x["section"] for x in r.search(cases, 2).where("rank = 1").collect()}
        assert top[0] == "Foxes" and top[1] in ("Sky", "Sea")
    scores = retriever.evaluate(cases, r, {"one": generation.backend("extractive"), "two": generation.backend("extractive")})
    s = {x["model"]: x for x in evaluation.summary(scores).collect()}
    assert s["one"]["elapsed_seconds"] > 0 and s["two"]["elapsed_seconds"] > 0
    assert s["one"]["avg_recall"] == 1.0 and s["one"]["citation_rate"] == 1.0 and s["one"]["test_cases"] == 3 and s["two"]["avg_mrr"] == s["one"]["avg_mrr"]
    none = retriever.answer(cases, r.search(cases).where("false"), generation.backend("extractive")).collect()
    assert all(x["no_answer"] and x["faithful"] and not x["uncited"] and x["answer"] == generation.NO_CONTEXT for x in none) and len(none) == 3
    long = retriever.answer(cases, r.search(cases), generation.backend("extractive"), max_tokens=1)
    assert all(x["usage"] and x["answer"].startswith("The provided context") and x["chunks_provided"] == [] for x in long.collect())
    lines = generation.summary(long).first()["summary"].split("\n")
    assert lines[0].startswith("query: ") and lines[1] == "answered by: extractive" and lines[-1].startswith("tokens: ")
    half = chunks.withColumn("vector", F.when(F.col("chunk_key") != 0, F.col("vector")))
    assert {x["chunk_key"] for x in retriever.HybridRetriever(half, sparse.index(half)).search(cases).where("query_id = 0").collect()} >= {0}


def test_long_repetitions(spark):
    """Patterns that repeat groups need no stack for it, and blanks no time."""
    n = 300_000
    rows = [(0, "1" + ".1" * n + " x"), (1, "[1" + ", 1" * n + "]"), (2, "a" + " " * n + "b" + "\n" * n)]
    df = spark.createDataFrame([(i, i, "s", t) for i, t in rows], "chunk_key long, chunk_id long, section string, text string")
    assert {r["chunk_key"]: r["dl"] for r in sparse.index(df).lengths.collect()} == {0: 1, 1: 0, 2: 0}
    said = df.select(F.col("chunk_key").alias("query_id"), F.col("text").alias("answer"), F.array(F.lit(1).cast("long")).alias("chunks_provided"))
    assert {r["query_id"]: r["n_citations"] for r in generation.checked(said).collect()} == {0: 0, 1: n + 1, 2: 0}
    assert [r["n"] for r in df.select(F.length(T.cleaned(F.col("text"))).alias("n")).orderBy("chunk_key").collect()][2] == n + 2


def test_streaming(spark, tmp_path):
    rows = [(i, f"red fox number {i} {'blue' * (i % 2)}") for i in range(30)]
    src = f"file://{tmp_path}/in"
    schema = "chunk_key long, text string"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark.readStream.schema(schema).parquet(src), f"file://{tmp_path}/ix", f"file://{tmp_path}/cp").awaitTermination()
    asked = spark.createDataFrame([(0, "blue fox"), (1, "number 17")], "query_id long, text string")
    whole = sparse.search(sparse.index(spark.createDataFrame(rows, schema)), asked)
    assert {tuple(r) for r in sparse.search(ingest.opened(spark, f"file://{tmp_path}/ix"), asked).collect()} == {tuple(r) for r in whole.collect()}


def test_command_line(spark, capsys):
    from lectern import cli

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the synthetic tables")
    cli.main(["evaluate", "--dir", "/root/testdata/sf0.001"])
    out = capsys.readouterr().out
    assert "avg_recall" in out and "elapsed_seconds" in out and "extractive" in out
    cli.main(["dense_topk", "--rows", "3"])
    assert "chunk_key" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
