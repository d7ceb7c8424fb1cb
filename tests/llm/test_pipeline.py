"""The pipeline, stage by stage, against brute-force versions on made documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_text_operators import brute_base, brute_components, brute_substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(60, 120)) for _ in range(60)]
    shared = prose(40)
    texts += [texts[0], texts[1] + " tail", f"{prose(50)}\n{shared} {prose(50)}", f"{shared}\n{prose(60)}", prose(5), "same words again and again " * 20]
    texts += [f"{prose(40)} write to ada.12@mail.example.com or +1 (017) 555-7713 {prose(40)}", f"{prose(40)} ada.12@mail.example.com {prose(40)}", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def steps(spark, made, tmp_path_factory):
    """Each stage's input and output."""
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{made}/documents.parquet")
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, made).write.parquet(f"file://{folder}/{i}")
        after = spark.read.parquet(f"file://{folder}/{i}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns(steps):
    for name, (_, _, columns) in list(steps.items())[:-1]:
        assert tuple(columns) == corpus_pipeline.COLUMNS, name


def test_quality_rules(steps):
    before, after, _ = steps["quality rules"]
    fails = lambda t: brute_base(t)[0] < 20 or 100 * brute_base(t)[4] > 30 * brute_base(t)[0]
    assert {tuple(r) for r in after} == {tuple(r) for r in before if not fails(r["text"] or "")}  # no text here lies outside the band


def test_near_dedup(steps):
    before, after, _ = steps["near-dedup"]
    kept = {d for d, _, _, k in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 75) if k}
    assert {tuple(r) for r in after} == {tuple(r) for r in before if r["doc_id"] in kept} and len(kept) == len(before) - 2


def test_substring_dedup(steps):
    before, after, _ = steps["substring dedup"]
    want = Counter((d, h) for d, _, _, h in brute_substring([(r["doc_id"], r["text"]) for r in before], 13))
    assert Counter((r["doc_id"], hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest()) for r in after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after) and sum(r["text"] != b["text"] for r, b in zip(sorted(after), sorted(before))) == 1
    assert {(r["doc_id"], r["lang"], r["source"]) for r in after} == {(r["doc_id"], r["lang"], r["source"]) for r in before}


def test_surrogates(steps):
    before, after, _ = steps["pii surrogates"]
    old = {r["doc_id"]: r for r in before}
    changed = [r for r in after if r["text"] != old[r["doc_id"]]["text"]]
    assert len(after) == len(before) and len(changed) == 2 and all(r["n_chars"] == len(r["text"]) for r in after)
    assert not any("ada.12@" in r["text"] or "555-7713" in r["text"] for r in after)
    assert len({m for r in changed for m in re.findall(r"\S+@\S+", r["text"])}) == 1


def test_packing(steps):
    before, after, _ = steps["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    assert {r["doc_id"]: r["doc_tokens"] for r in after} == lengths
    assert sum(r["length"] for r in after) == sum(lengths.values())
    ends = Counter()
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and np.mean(list(ends.values())) > 1500


def test_run(spark, made, steps):
    got = corpus_pipeline.run(spark, made).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, steps["packing"][1]))


def test_empty(spark, made, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, made).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert docs.count() == 0


def test_rows_decide_for_themselves(spark, made, tmp_path):
    """Rows without an id, or of one id: a bad one takes no other with it, and of copies one stays."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) for _ in range(60)]
    ids = [*range(40), *[None] * 10, *[99] * 10]
    rows = [(i, t, None if n % 7 == 0 else "en", f"s{n}", len(t)) for n, (i, t) in enumerate(zip(ids, texts))]
    short = [(None, "", "en", "x", 0), (99, "too short", "en", "x", 9)]
    copies = [(None, texts[45], "en", "copy", len(texts[45])), (99, texts[55], "en", "copy", len(texts[55])), (None, texts[5], "en", "copy", len(texts[5]))]
    docs = spark.createDataFrame([*copies, *rows, *short], SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    stages["quality rules"](spark, docs, made).write.parquet(f"file://{tmp_path}/0")
    after = spark.read.parquet(f"file://{tmp_path}/0")
    assert Counter(map(tuple, after.collect())) == Counter([*rows, *copies])
    last = [tuple(r) for r in stages["near-dedup"](spark, after, made).collect()]
    assert Counter((r[0], r[1]) for r in last) == Counter((r[0], r[1]) for r in rows)


def test_odd_inputs(spark, made, tmp_path):
    """Nulls in every column, repeated rows, a very long text and extra columns of clashing names, through all stages."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 120)), ["en", None][i % 2], [None, "s"][i % 3 > 0], None) for i in range(200)]
    rows += [(500, prose(40_000), "en", "long", 7), rows[3]] + [(None, prose(70), None, None, None)] * 2 + [(None, None, None, None, None), (600, None, "en", "x", 0), (601, "", "en", "x", 0)]
    extra = ", row string, chunk string, key string, found string, n_entities string, given_lang string, component_id string, extra_0 string"
    docs = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], SCHEMA + extra).repartition(3)
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, made).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS or name == "packing"
        counts.append(docs.count())
    assert counts[:4] == [len(rows) - 3, *[len(rows) - 5] * 3]  # without text; without copies
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {(i, t) for i, t, *_ in rows if t}
    assert docs.agg({"length": "sum"}).first()[0] == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in texts)
    assert docs.where("doc_id = 500").agg({"length": "max"}).first()[0] == 2048
