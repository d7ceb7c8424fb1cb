"""Context for an answer, prompts, answer backends, and what an answer's citations say about it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHARS_PER_TOKEN = 4
UNKNOWN = "Unknown"
NO_CONTEXT = "No context chunks were retrieved. Cannot answer."
#: Phrases of a refusal, for the whole answer and for a sentence of it.
NO_ANSWER = ("does not contain sufficient information", "context does not", "cannot answer", "not mentioned in the provided", "no information about")
REFUSALS = ("context does not", "not enough information", "cannot answer", "not mentioned", "no information")
SYSTEM = (
    "Answer from the numbered chunks below and from nothing else. Put the number of the chunk that supports a statement in "
    "square brackets after it, like [2]. If the chunks are not enough, write that the provided context does not contain "
    "sufficient information, and what is missing. Where chunks disagree, say so and cite both. Be brief."
)


def fitting(hits: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """hits with fits: whether a hit stands, in order of rank, before the first that overflows the budget of 4 characters a token."""
    run = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("fits", run <= max_tokens * CHARS_PER_TOKEN)


def trimmed(hits: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """The hits of each query, in order of rank, up to the first that overflows the budget."""
    return fitting(hits, max_tokens).where("fits").drop("fits")


def context(hits: DataFrame) -> DataFrame:
    """query_id, context, chunks_provided of hits (query_id, chunk_id, section, text, rank[, fits]): without section headers, numbered.
    Hits that do not fit are left out; a query that has no others gets an empty context."""
    bare = T.strip(F.regexp_replace("text", r"\A\[Section:[^\]]+\]\n?", ""))
    block = F.concat(F.lit("--- Chunk ["), F.col("chunk_id").cast("string"), F.lit("] | Section: "), F.coalesce("section", F.lit(UNKNOWN)), F.lit(" ---\n"), bare)
    one = F.struct("rank", block.alias("block"), "chunk_id")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), one) if "fits" in hits.columns else one)).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n").alias("context"), F.transform("r", lambda x: x["chunk_id"].cast("long")).alias("chunks_provided"))


def message(query: Column, block: Column) -> Column:
    return F.concat(F.lit("Chunks:\n\n"), block, F.lit("\n\n---\n\nQuestion: "), query, F.lit("\n\nAnswer from the chunks only, with [N] after each statement."))


def citations(answers: DataFrame) -> DataFrame:
    """query_id, position, nth, chunk_id, claim, valid of (query_id, answer, chunks_provided): one row for each number in [N] or [N, M].

    claim is what stands in the 80 characters before the bracket.
    """
    mark = r"\[\d+(?:\s*,\s*\d+)*+\]"
    rows = answers.withColumn("m", F.regexp_extract_all("answer", F.lit(mark), F.lit(0))).where(F.size("m") > 0).withColumn("g", F.split("answer", mark, -1))
    rows = rows.select("query_id", "answer", "chunks_provided", "g", F.col("m").alias("all"), F.posexplode("m").alias("i", "mark"))
    long = lambda a: F.aggregate(F.transform(a, F.length), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("position", long(F.slice("g", F.lit(1), F.col("i") + 1)) + long(F.slice("all", F.lit(1), F.col("i"))))
    before = F.substring(F.col("answer"), F.greatest(F.lit(1), F.col("position") - 79), F.least(F.lit(80), F.col("position")))
    ids = F.transform(F.split(F.regexp_replace("mark", r"[\[\]\s]", ""), ","), lambda x: x.cast("long"))
    out = rows.select("query_id", F.col("position").cast("long"), T.strip(before).alias("claim"), "chunks_provided", F.posexplode(ids).alias("nth", "chunk_id"))
    return out.select("query_id", "position", "nth", "chunk_id", "claim", F.array_contains("chunks_provided", F.col("chunk_id")).alias("valid"))


def uncited(answer: Column) -> Column:
    """Sentences of 20 characters and more that are no refusal and have no [N]. A list like [1, 2] is no [N] here."""
    parts = F.transform(F.split(answer, r"(?U)(?<=[.!?])\s+", -1), T.strip)
    refusal = lambda s: F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(F.lower(s), p))
    return F.filter(parts, lambda s: (F.length(s) >= 20) & ~refusal(s) & ~s.rlike(r"\[\d+\]"))


def is_no_answer(answer: Column) -> Column:
    return F.exists(F.array(*map(F.lit, NO_ANSWER)), lambda p: F.contains(F.lower(answer), p))


def checked(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, chunks_provided) with citations, chunks_used, chunks_unused, n_citations, n_invalid, uncited, faithful, no_answer."""
    found = citations(answers).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_citations"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("chunk_id")))).alias("used"),
        F.count_distinct("chunk_id").alias("n_chunks_cited"),
    )
    rows = answers.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    used = F.coalesce("used", F.array().cast("array<bigint>"))
    rows = rows.select(*answers.columns, zero("n_citations"), zero("n_invalid"), zero("n_chunks_cited"), used.alias("chunks_used"), uncited(F.col("answer")).alias("uncited"))
    return rows.select(
        "*",
        F.filter("chunks_provided", lambda x: ~F.array_contains("chunks_used", x)).alias("chunks_unused"),
        ((F.col("n_invalid") == 0) & (F.size("uncited") == 0)).alias("faithful"),
        is_no_answer(F.col("answer")).alias("no_answer"),
    )


class Backend(Protocol):
    """What answers a prompt: connected once in each worker; returns a text and token counts."""

    name: str

    def connect(self) -> object: ...

    def call(self, client: object, system: str, user: str) -> tuple[str, dict[str, int]]: ...


class ExtractiveBackend:
    """Offline stand-in: the first sentence of the first chunk, cited; or a refusal."""

    name = "extractive"

    def connect(self) -> object:
        return None

    def call(self, client: object, system: str, user: str) -> tuple[str, dict[str, int]]:
        import re

        m = re.search(r"--- Chunk \[(\d+)\][^\n]*---\n(.+?)(?:\.\s|\n|$)", user)
        answer = f"{m[2].strip().rstrip('.')} [{m[1]}]." if m else "The provided context does not contain sufficient information."
        return answer, {"input_tokens": len(user) // CHARS_PER_TOKEN, "output_tokens": len(answer) // CHARS_PER_TOKEN}


@dataclass
class MessagesBackend:
    """Adapter for an optional SDK with a messages interface."""

    model: str
    max_tokens: int = 1024
    temperature: float = 0.0
    name: str = "claude"

    def connect(self) -> object:
        import anthropic

        if not os.environ.get("ANTHROPIC_API_KEY"):
            raise ValueError("no key: set ANTHROPIC_API_KEY")
        return anthropic.Anthropic()

    def call(self, client: object, system: str, user: str) -> tuple[str, dict[str, int]]:
        r = client.messages.create(model=self.model, max_tokens=self.max_tokens, temperature=self.temperature, system=system, messages=[{"role": "user", "content": user}])
        return r.content[0].text, {"input_tokens": r.usage.input_tokens, "output_tokens": r.usage.output_tokens}


@dataclass
class ChatCompletionsBackend:
    """Adapter for an optional SDK with a chat completions interface, at any address that speaks it."""

    model: str
    max_tokens: int = 1024
    temperature: float = 0.0
    base_url: str | None = None
    api_key: str | None = field(default=None, repr=False)

    #: What an address contains, which is the name of its service too, and the variables that may hold a key.
    SERVICES = ("openrouter", "deepseek", "z.ai", "together")
    KEYS = ("OPENAI_API_KEY", "OPENROUTER_API_KEY", "DEEPSEEK_API_KEY", "ZAI_API_KEY")

    @property
    def name(self) -> str:
        return next((s for s in self.SERVICES if s in (self.base_url or "")), "openai")

    def connect(self) -> object:
        import openai

        own = self.name.replace(".", "").upper() + "_API_KEY"  # the service's own comes first
        key = self.api_key or next(filter(None, map(os.environ.get, (own, *self.KEYS))), None)
        if not key:
            raise ValueError(f"no key: set one of {', '.join(dict.fromkeys((own, *self.KEYS)))}")
        return openai.OpenAI(api_key=key, base_url=self.base_url)

    def call(self, client: object, system: str, user: str) -> tuple[str, dict[str, int]]:
        r = client.chat.completions.create(model=self.model, max_tokens=self.max_tokens, temperature=self.temperature, messages=[{"role": "system", "content": system}, {"role": "user", "content": user}])
        return r.choices[0].message.content, {"input_tokens": r.usage.prompt_tokens, "output_tokens": r.usage.completion_tokens} if r.usage else {}


@dataclass
class LocalBackend:
    """Adapter for a model server on the worker's own machine."""

    model: str
    max_tokens: int = 1024
    temperature: float = 0.0
    address: str = "http://localhost:11434/api/chat"
    name: str = "ollama"

    def connect(self) -> object:
        return None

    def call(self, client: object, system: str, user: str) -> tuple[str, dict[str, int]]:
        import json
        import urllib.request

        body = {"model": self.model, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        with urllib.request.urlopen(urllib.request.Request(self.address, json.dumps(body).encode(), {"Content-Type": "application/json"})) as r:
            got = json.load(r)
        return got["message"]["content"], {"input_tokens": got.get("prompt_eval_count", 0), "output_tokens": got.get("eval_count", 0)}


#: Names for models and where they are served.
PRESETS = {
    "claude": ("claude", "claude-sonnet-4-20250514", None),
    "claude-haiku": ("claude", "claude-haiku-4-5-20251001", None),
    "claude-opus": ("claude", "claude-opus-4-6", None),
    "glm5": ("openai", "zai/glm-5", "https://openrouter.ai/api/v1"),
    "deepseek": ("openai", "deepseek-chat", "https://api.deepseek.com/v1"),
    "gpt4o": ("openai", "gpt-4o", None),
    "gpt4o-mini": ("openai", "gpt-4o-mini", None),
    "llama3": ("ollama", "llama3.1", None),
    "mistral": ("ollama", "mistral", None),
    "qwen": ("ollama", "qwen2.5", None),
}


def backend(provider: str, model: str = "", max_tokens: int = 1024, temperature: float = 0.0, base_url: str | None = None, api_key: str | None = None) -> Backend:
    makers = {
        "extractive": ExtractiveBackend,
        "claude": lambda: MessagesBackend(model, max_tokens, temperature),
        "openai": lambda: ChatCompletionsBackend(model, max_tokens, temperature, base_url, api_key),
        "ollama": lambda: LocalBackend(model, max_tokens, temperature),
    }
    if provider not in makers:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(makers)}")
    return makers[provider]()


def preset(name: str, **options) -> Backend:
    provider, model, url = PRESETS[name]
    return backend(provider, model, base_url=url, **options)


def presets(spark) -> DataFrame:
    return spark.createDataFrame([(n, *p) for n, p in PRESETS.items()], "preset string, provider string, model string, base_url string")


def answers(prompts: DataFrame, to: Backend) -> DataFrame:
    """prompts (query_id, query, context, chunks_provided) with answer, usage, provider, model: one call for each row with a
    context, be it an empty one; a null context says that nothing was retrieved, and gets the fixed refusal."""

    @F.pandas_udf("struct<answer:string,usage:map<string,int>>")
    def ask(users: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, none = None, (NO_CONTEXT, None)
        for batch in users:
            if client is None and batch.notna().any():
                client = to.connect()
            yield pd.DataFrame([none if u is None else to.call(client, SYSTEM, u) for u in batch], columns=["answer", "usage"])

    said = prompts.withColumn("r", ask(message(F.col("query"), F.col("context"))))
    return said.select(*prompts.columns, "r.answer", "r.usage", F.lit(to.name).alias("provider"), F.lit(getattr(to, "model", "")).alias("model"))


def summary(rows: DataFrame) -> DataFrame:
    """query_id, summary: lines on each checked answer: the query, who answered, its citations and chunks, and tokens if known."""
    for c, kind in (("query", "string"), ("provider", "string"), ("model", "string"), ("usage", "map<string,int>")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    n = lambda c: F.size(c).cast("string")
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    tokens = lambda c: F.coalesce(F.try_element_at("usage", F.lit(c)).cast("string"), F.lit("?"))
    lines = [
        F.concat(F.lit("query: "), "query"),
        F.concat(F.lit("answered by: "), "provider", F.when(F.col("model") != "", F.concat(F.lit(" / "), "model")).otherwise("")),
        F.concat(F.lit("faithful: "), yes("faithful")),
        F.concat(F.lit("no answer: "), yes("no_answer")),
        F.concat(F.lit("chunks: "), n("chunks_provided"), F.lit(" provided, "), n("chunks_used"), F.lit(" used, "), n("chunks_unused"), F.lit(" unused")),
        F.concat(F.lit("citations: "), F.col("n_citations").cast("string")),
        F.when(F.size("usage") > 0, F.concat(F.lit("tokens: "), tokens("input_tokens"), F.lit(" in, "), tokens("output_tokens"), F.lit(" out"))),
    ]
    return rows.select("query_id", F.concat_ws("\n", *lines).alias("summary"))
