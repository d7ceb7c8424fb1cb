"""Quality rules: counts of whole texts, and bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model over bytes of UTF-8, order 5, with one set of counts for each language.
Tasks count the n-grams of their documents, Spark adds the counts up and derives all lower orders, discounts and
probabilities by aggregations and joins; no context has more than 256 continuations, so no key is hot. For scoring,
texts are packed into parts, each part's distinct n-grams meet the model in hash buckets by exact language and code, and
their values come back to the part. The model is as large as the corpus makes it and is never gathered; a task holds a
bucket of it, or what one part uses.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import chunks, common, textblock

ORDER = 5
BUCKET_ROWS = 1 << 17
MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, nll double"
WINDOW = 8
NO_LANGUAGE = "und"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)  # ASCII signs: a word of these alone is not one of the language
_MARKS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_BLANK = textblock._SPACE


def _languages(column: pa.Array) -> list[str]:
    return [x if x is not None else NO_LANGUAGE for x in column.to_pylist()]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte the n-gram that ends with it, as a number; texts begin with ORDER - 1 zero bytes. And where texts begin."""
    pad, n = ORDER - 1, len(offsets) - 1
    padded = np.zeros(len(data) + pad * n, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * pad, np.diff(offsets))
    padded[place] = data
    codes = np.zeros(len(data), np.int64)
    for j in range(ORDER):
        codes <<= 8
        codes |= padded[place - (ORDER - 1 - j)]
    return codes, offsets


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return c[first], np.add.reduceat(n, first)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, code, c: all n-grams of highest order of all texts."""

    def count(batches):
        common.lean()
        held: dict[str, tuple[list, list]] = {}

        def rows(lang):
            codes, counts = _added(*held[lang])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "c"])

        for batch in batches:
            langs = np.array(_languages(batch.column(0)), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, w in textblock.blocks(texts):
                    codes, counts = np.unique(ngrams(w.data, w.offsets)[0], return_counts=True)
                    if len(codes):
                        own = held.setdefault(lang, ([], []))
                        own[0].append(codes)
                        own[1].append(counts)
                        if sum(map(len, own[0])) > 2_000_000:
                            merged = _added(*own)
                            held[lang] = ([merged[0]], [merged[1]])
                            if len(merged[0]) > 1_500_000:  # nothing is lost: Spark adds up what a task sends twice
                                yield rows(lang)
                                del held[lang]
        for lang in sorted(held):
            yield rows(lang)

    return docs.select("lang", "text").mapInArrow(count, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def _by_language(rows: DataFrame, facts: DataFrame, spread: str) -> DataFrame:
    """rows with what facts (one row for each language) says. A language of most rows is spread over all tasks."""
    n = common.partitions(rows.sparkSession)
    salted = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt_"))
    return rows.withColumn("salt_", F.pmod(F.hash(spread), F.lit(n))).join(salted, ["lang", "salt_"], "left").drop("salt_")


def _discounted(level: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """lang, code, c, p: interpolated modified Kneser-Ney probabilities of one order from its (adjusted) counts."""
    tally = level.groupBy("lang").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        d = i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.when(d.between(0, i), d).otherwise(F.lit(i / 2))  # also where a count is 0

    discounts = tally.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    context = Window.partitionBy("lang", "context")
    rows = _by_language(level, discounts, "code").withColumn("context", F.shiftright("code", 8))
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("d", d).withColumn("total", F.sum("c").over(context)).withColumn("spare", F.sum("d").over(context))
    own = (F.col("c") - F.col("d")) / F.col("total")
    share = F.col("spare") / F.col("total")
    if lower is None:
        return rows.select("lang", "code", "c", (own + share / 256).alias("p"))
    suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
    below = lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("q"))
    return rows.withColumn("suffix", suffix).join(below, ["lang", "suffix"]).select("lang", "code", "c", (own + share * F.col("q")).alias("p"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, code, c, p of the highest order. Lower orders count the different bytes before an n-gram."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("c")))
    p = None
    for order, level in enumerate(reversed(levels), 1):
        p = _discounted(level, order, p)
    return p


def _mixed(lang: str, codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textblock.mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(lang.encode())) * np.uint64(0xC2B2AE3D27D4EB4F))


def _bucket(lang: str, codes: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(lang, codes) % np.uint64(n)).astype(np.int32)


def _shut(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _sorted_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64))


class Scores:
    """Log probabilities of the n-grams of one language that a part of the corpus has, by exact code.

    A table of four places for each n-gram or more finds most at once; those that another one displaced are searched for.
    """

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(8, (4 * len(codes)).bit_length()))
        self.place = np.zeros(1 << int(64 - self.shift), np.int32)
        self.place[_mixed("", self.codes) >> self.shift] = np.arange(len(codes))

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        at = self.place[_mixed("", codes) >> self.shift]
        other = np.flatnonzero(self.codes[at] != codes)
        at[other] = np.minimum(np.searchsorted(self.codes, codes[other]), len(self.codes) - 1)
        if (self.codes[at[other]] != codes[other]).any():
            raise ValueError("an n-gram of the text is not in the model")  # the input changed while it was read
        return self.values[at]


def parts(docs: DataFrame, n: int) -> DataFrame:
    """part, blob: the rows of docs in packed parts of about HOLD_BYTES, as they come, dealt into n partitions. No id or
    language decides where a row goes, so none is hot."""

    def pack(batches):
        held: list[pa.RecordBatch] = []
        size, part = 0, TaskContext.get().partitionId() << 32

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([chunks._blob(pa.Table.from_batches(held))], pa.binary())], names=["part", "blob"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # parts of a batch, should its texts be long
                step = max(1, min(batch.num_rows - at, int(batch.num_rows * chunks.HOLD_BYTES / max(1, batch.nbytes))))
                held.append(batch.slice(at, step))
                at += step
                size += step * batch.nbytes // max(1, batch.num_rows)
                if size >= chunks.HOLD_BYTES:
                    yield flush()
                    held.clear()
                    size, part = 0, part + 1
        if held:
            yield flush()

    return docs.mapInArrow(pack, "part long, blob binary").repartition(n, "part")


def looked_up(texts: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """part, lang, codes, logps: for each part of texts its distinct n-grams with their log probabilities, in n buckets.

    A part sends each bucket its codes as one array for each language; the bucket, which holds the model's n-grams of the
    same hashes, sends them back with their values.
    """

    def ask(batches):
        common.lean()
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                for t in chunks.opened([blob]):
                    langs = np.array(_languages(t.column("lang")), object)
                    for lang in sorted(set(langs)):
                        found = [np.unique(ngrams(w.data, w.offsets)[0]) for _, w in textblock.blocks(t.column("text").filter(pa.array(langs == lang)))]
                        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                        of = _bucket(lang, codes, n)
                        order = np.argsort(of, kind="stable")
                        codes, of = codes[order], of[order]
                        cuts = np.flatnonzero(np.diff(of)) + 1
                        rows += [(int(of[a]), part, lang, _shut(np.diff(codes[a:b], prepend=0))) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]) if b > a]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.binary()))], names=["bucket", "part", "lang", "codes"])

    def deal(batches):
        for batch in batches:
            langs, codes = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            out = np.zeros(len(codes), np.int32)
            for lang in set(langs):
                out[langs == lang] = _bucket(lang, codes[langs == lang], n)
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["bucket", *batch.schema.names])

    def answer(asked, known):
        langs = np.array(known.column("lang").to_pylist(), object)
        codes, logps = known.column("code").to_numpy(), known.column("logp").to_numpy()
        of = {}
        for lang in set(langs):
            order = np.flatnonzero(langs == lang)
            order = order[np.argsort(codes[order])]
            of[lang] = codes[order], logps[order].astype(np.float32)
        out = []
        for lang, blob in zip(asked.column("lang").to_pylist(), asked.column("codes")):
            own, values = of[lang]
            c = _sorted_codes(blob.as_py())
            at = np.minimum(np.searchsorted(own, c), len(own) - 1)
            if (own[at] != c).any():
                raise ValueError("an n-gram of the text is not in the model")
            out.append(_shut(values[at]))
        return pa.table([asked.column("part").combine_chunks(), asked.column("lang").combine_chunks(), asked.column("codes").combine_chunks(), pa.array(out, pa.binary())], names=["part", "lang", "codes", "logps"])

    asked = texts.mapInArrow(ask, "bucket int, part long, lang string, codes binary")
    known = model.select("lang", "code", F.log("p").alias("logp")).mapInArrow(deal, "bucket int, lang string, code long, logp double")
    return asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "part long, lang string, codes binary, logps binary")


def _repeated(words: list[bytes], window: int) -> int:
    """Words in windows that occur twice or more."""
    runs = list(zip(*(words[i:] for i in range(window))))
    often = Counter(runs)
    step = np.zeros(len(words) + 1, np.int32)
    for i, r in enumerate(runs):
        if often[r] > 1:
            step[i] += 1
            step[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def measured(docs: DataFrame, model: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks (words of signs
    alone), nll (-log p of the text, for each other word), and the columns of docs that extra names."""
    n = common.partitions(docs.sparkSession)
    texts = parts(docs.select("doc_id", "lang", "text", *(F.col(f"`{c}`").alias(f"extra_{i}") for i, c in enumerate(extra) if c != "text")), n)
    # so many buckets that one holds a bounded share of the model, and parts send them arrays worth sending
    scores = looked_up(texts, model, max(-(-model.count() // BUCKET_ROWS), -(-n // 8)))
    types = StructType([*StructType.fromDDL(MEASURES).fields, *(StructField(c, docs.schema[c].dataType) for c in extra)])
    schema = to_arrow_schema(types)

    def measure(part, scores):
        common.lean()
        held: dict[str, tuple[list, list]] = {}
        z = zstandard.ZstdDecompressor()
        for lang, codes, logps in zip(*(scores.column(c).to_pylist() for c in ("lang", "codes", "logps"))):
            own = held.setdefault(lang, ([], []))
            own[0].append(_sorted_codes(codes))
            own[1].append(np.frombuffer(z.decompress(logps), np.float32))
        lm = {lang: Scores(*map(np.concatenate, own)) for lang, own in held.items()}
        out = []
        for t in chunks.opened(part.column("blob")):
            langs = _languages(t.column("lang"))
            for at, w in textblock.blocks(t.column("text")):
                n = len(w.offsets) - 1
                total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
                chars = total(~(_CONTINUED[w.data] | _BLANK[w.data]))
                symbols = total(_SYMBOLS[w.data])
                where, h = w.windows(WINDOW, w.hashes())
                edges = np.searchsorted(where, w.first)
                lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for d in range(n):
                    text = w.data[w.offsets[d] : w.offsets[d + 1]].tobytes()
                    own = text.split(b"\n")
                    if len(own) > 1:
                        own = [x for x in own if x.strip()]
                        lines[d] = len(own) - len(set(own))
                    h_d = np.sort(h[edges[d] : edges[d + 1]])
                    if len(h_d) > 1 and (h_d[1:] == h_d[:-1]).any():
                        repeats[d] = _repeated(text.split(), WINDOW)
                codes, _ = ngrams(w.data, w.offsets)
                sizes = np.diff(w.offsets)
                logp = np.zeros(len(codes))
                of_text = np.array(langs[at : at + n], object)
                for lang in set(of_text):
                    mine = np.repeat(of_text == lang, sizes)
                    if mine.any():
                        logp[mine] = lm[lang].look_up(codes[mine])
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logp)])[w.offsets])
                signs = np.concatenate([[0], np.cumsum(_MARKS[w.data])])
                alone = np.concatenate([[0], np.cumsum(signs[w.ends] - signs[w.starts] == w.ends - w.starts)])
                marks = np.diff(alone[w.first])
                nll = np.where(w.counts > 0, -sums / np.maximum(w.counts - marks, 1), 0.0)
                cols = [t.column("doc_id").slice(at, n), pa.array(langs[at : at + n], pa.string()), pa.array(w.counts), pa.array(chars), pa.array(symbols), pa.array(lines), pa.array(repeats), pa.array(marks), pa.array(np.round(nll, 6))]
                out.append(pa.table(cols + [t.column("text" if c == "text" else f"extra_{i}").slice(at, n) for i, c in enumerate(extra)], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return texts.groupBy("part").cogroup(scores.groupBy("part")).applyInArrow(measure, types)


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
STEP = 1000  # bins of nll in a unit


def bands(rows: DataFrame) -> DataFrame:
    """lang, middle, deviation: median of nll and median distance from it (as of a normal distribution), from a histogram
    of all rows that pass the base rules. A language's bins are added up by STEP first, and only those of the step that holds its
    median are put in order, so no task gets all bins of a language."""

    def median(hist: DataFrame, value: str) -> DataFrame:
        bins = hist.withColumn("step", F.floor(F.col(value) / STEP))
        below = Window.partitionBy("lang").orderBy("step")
        steps = bins.groupBy("lang", "step").agg(F.sum("n").alias("m"))
        steps = steps.withColumn("run", F.sum("m").over(below)).withColumn("all", F.sum("m").over(Window.partitionBy("lang")))
        at = steps.where("2 * run >= all AND 2 * (run - m) < all").select("lang", "step", (F.col("run") - F.col("m")).alias("before"), "all")
        inside = bins.join(at, ["lang", "step"]).withColumn("run", F.col("before") + F.sum("n").over(Window.partitionBy("lang").orderBy(value)))
        return inside.where("2 * run >= all").groupBy("lang").agg(F.min(value).alias("median"))

    hist = rows.where(f"NOT {BASE_FAILED}").groupBy("lang", F.round(F.col("nll") * STEP).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = median(hist, "bin")
    away = hist.join(middle, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    spread = median(away, "away").withColumnRenamed("median", "deviation")
    return middle.join(spread, "lang").select("lang", (F.col("median") / STEP).alias("middle"), (F.col("deviation") * 1.4826 / STEP).alias("deviation"))


def judged(docs: DataFrame, upper: float = 6.0, lower: float = 8.0, least: float = 0.2, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, perplexity,
    and the columns of docs that extra names (other names than these; "text" is the text, null as empty), of the same row.

    The model is counted on all given texts, each language by itself; a null language is one of its own. A text that passes
    the base rules is kept if its perplexity (of a word; words of ASCII signs alone, such as bars between cells, add to the
    text's -log p but are not counted, so that they cannot make junk look likely) lies in its language's band: from `lower` deviations (at least
    `least`) under the median to `upper` ones over it, on the scale of logarithms. A mean over few words scatters more, so
    the band is wider by sqrt(1 + 64 / words). Null and empty texts have no words
    and fail the base rules; a text of any length is taken whole; null ids stay null; repeated rows are judged each for itself; an
    empty table gives no rows; other columns are not looked at.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), common.whole(text_column).alias("text"), *(F.col(f"`{c}`") for c in extra if c != "text"))
    counts = common.written(count_ngrams(base))
    model = common.written(kneser_ney(counts))
    common.forget(counts)
    rows = common.written(measured(base, model, extra))
    common.forget(model)
    reach = F.greatest(F.lit(least), F.col("deviation")) * F.sqrt(1 + F.lit(64.0) / F.greatest(F.col("n_words") - F.col("n_marks"), F.lit(1)))
    away = F.col("nll") - F.col("middle")
    inside = F.coalesce(away.between(-lower * reach, upper * reach), F.lit(True))
    out = _by_language(rows, bands(rows), "doc_id").withColumn("base_failed", F.expr(BASE_FAILED))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", F.exp("nll").alias("perplexity"), *(F.col(f"`{c}`") for c in extra))
