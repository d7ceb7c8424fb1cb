"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are (1) runs of 16 and more of the characters that keys are written in, with a digit among them; (2) what a name like
password, secret, token or key is set to with = or :, of 6 characters and more, up to white space or a quotation mark; (3)
blocks of a private key. Nothing else is looked at: a password without such a name before it is no candidate.

The forest looks at a candidate's length, its characters and the transitions between kinds of them, how much of it words
cover, the path it was found in and the words beside it. It is trained on labelled findings; none come with the corpus, so
`labelled_findings` makes a bounded number of them, LABELLED by default, from rules: keys, tokens and passwords of common formats
where such stand, and the things that scanners take for them (checksums, revisions, identifiers, numbers, placeholders, code).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

LABELLED = 8000
BESIDE = 80  # characters kept on each side
_IN = "A-Za-z0-9+/_=-"
LONG = rf"(?<![{_IN}])(?=[A-Za-z+/_=-]*+[0-9])[{_IN}]{{16,}}+"
_NAMES = "passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential"
ASSIGNED = rf"(?i:{_NAMES})s?[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"'`]?(?P<value>[^\s\"'`]{{6,}}+)"
BLOCK = r"-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----)?"
#: No text without one of these has a candidate.
HINT = rf"(?i)[0-9]|{_NAMES}|-----BEGIN"
#: Words that say a secret follows, and words that say it is something else.
TELLS = r"(?i)(?:token|secret|passw|passphrase|pwd|api.?key|access.?key|key_id|credential|auth|private|bearer)"
DENIES = r"(?i)(?:commit|sha-?[0-9]*|checksum|hash|digest|uuid|guid|md5|revision|version|etag|trace|order|serial|example|sample|placeholder|\bid\b)"
PATHS = r"(?i)(?:test|example|sample|mock|fixture|docs?|readme|vendor|lock)"
DICTIONARY = "access account admin auth bucket build change changeme class client config content create data default demo dummy enter environ example factory fake false file get handler header here home index insert item java key lib list main manager method mock module name none node null object optional page password path placeholder private prod project public replace request required response root sample secret self server service set some src str string table test this token true type undefined update user value version your".split()
FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "variety", "words", "is_hex", "is_number", "is_uuid", "has_prefix", "is_code", "assigned", "tells_before", "denies_before", "tells_after", "denies_after", "in_tests"]


def found_in(text: str) -> list[tuple[int, str]]:
    """(start, candidate) of a text in order; of candidates that overlap the one that begins first, or is longer, stays."""
    if "-----BEGIN" in text:
        spans = [m.span() for m in _BLOCK.finditer(text)]
    else:
        spans = []
    spans += [m.span() for m in _LONG.finditer(text)]
    if _NAME.search(text):
        spans += [m.span("value") for m in _ASSIGNED.finditer(text)]
    out, end = [], 0
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, text[a:b]))
            end = b
    return out


_BLOCK, _LONG, _ASSIGNED, _NAME = (re.compile(p) for p in (BLOCK, LONG, ASSIGNED, f"(?i:{_NAMES})"))


def candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs' other columns with start, candidate, before, after: one row for each candidate, with up to BESIDE characters beside it."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    own = ("start", "candidate", "before", "after")
    others = [c for c in docs.columns if c != text_column and c not in own]
    types = StructType([*(docs.schema[c] for c in others), *StructType.fromDDL("start long, candidate string, before string, after string").fields])

    def find(batches):
        for batch in batches:
            row, cols = [], [[], [], [], []]
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                t = x.as_py()
                for start, candidate in found_in(t):
                    row.append(i)
                    end = start + len(candidate)
                    for col, v in zip(cols, (start, candidate, t[max(0, start - BESIDE) : start], t[end : end + BESIDE])):
                        col.append(v)
            at = pa.array(row, pa.int64())
            kept = [batch.column(i).take(at) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[*others, *own])

    return docs.where(text.rlike(HINT)).select(*(F.col(f"`{c}`") for c in others), text.alias("text_")).mapInArrow(find, types)


def features(found: DataFrame, path_column: str) -> DataFrame:
    """The columns of FEATURES beside those of found (candidate, before, after and a path)."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    near_before = F.regexp_extract("before", r"((?:[^\s]++\s*+){0,3}+)$", 1)
    near_after = F.regexp_extract("after", r"^((?:\s*+[^\s]++){0,3}+)", 1)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    columns: dict[str, Column] = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "transitions": share(change),
        "variety": F.size(F.array_distinct(F.split(F.substring(c, 1, 1024), ""))) / F.least(n, F.lit(64.0)),
        "words": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "is_hex": yes(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "is_number": yes(c.rlike("^[0-9+=/_-]+$")),
        "is_uuid": yes(c.rlike("(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "has_prefix": yes(c.rlike("^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|pk[-_]|xox[abp]-|AIza|eyJ|-----BEGIN)")),
        "is_code": yes(c.rlike(r"[(\[{]|\.[A-Za-z_]+|^[$<%]")),
        "assigned": yes(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "tells_before": yes(near_before.rlike(TELLS)),
        "denies_before": yes(near_before.rlike(DENIES)),
        "tells_after": yes(near_after.rlike(TELLS)),
        "denies_after": yes(near_after.rlike(DENIES)),
        "in_tests": yes(F.col(f"`{path_column}`").cast("string").rlike(PATHS)),
    }
    return found.select("*", *(x.alias(k) for k, x in columns.items()))


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = 7) -> DataFrame:
    """candidate, before, after, path, label: n made findings, as many true as false."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), "id"), 512)
    rows = spark.range(n).withColumn("h", h).withColumn("kind", F.conv(F.substring("h", 1, 6), 16, 10).cast("long"))
    hex_ = lambda size: F.substring("h", 17, size)
    base = lambda size: F.substring(F.regexp_replace(F.base64(F.unhex(F.substring("h", 20, 100))), "[+/=]", "x"), 1, size)
    pick = lambda at, *options: F.element_at(F.array(*map(F.lit, options)), (F.conv(F.substring("h", at, 4), 16, 10).cast("int") % len(options) + 1).cast("int"))
    filler = pick(7, "", "the value of ", "please use ", "in this file ", "und hier ", "see also ", "le code ")
    after = pick(11, "\n", " and so on", '" ;', "", '"\n', " for the service")
    true = [
        (hex_(40), F.concat(filler, pick(3, 'token = "', "token: ", 'auth_token="', "secret = ", 'api_key = "'))),
        (hex_(32), F.concat(filler, pick(3, 'api_key = "', "apikey: ", 'secret="', 'access_key = "'))),
        (F.concat(F.lit("AKIA"), F.upper(base(16))), F.concat(filler, pick(3, "aws_access_key_id = ", "key_id: ", "", "with "))),
        (F.concat(F.lit("ghp_"), base(36)), F.concat(filler, pick(3, "GITHUB_TOKEN=", "token ", "", "https://"))),
        (base(40), F.concat(filler, pick(3, "aws_secret_access_key = ", 'secret: "', "private_key=", "password: "))),
        (F.concat(F.lit("sk_live_"), base(24)), F.concat(filler, pick(3, "stripe ", "key: ", "", 'token="'))),
        (F.concat(pick(15, "S", "x", "Kq", "m_"), base(6), pick(19, "!", "$", "@", "#x"), F.substring("h", 70, 3)), F.concat(filler, pick(3, "password = ", 'password="', "pwd: ", 'passwd = "'))),
        (F.translate(base(20), "0123456789", "qwertyuiop"), F.concat(filler, pick(3, "secret: ", 'api_key = "', "access_key=", 'token = "'))),
        (F.concat(F.lit("-----BEGIN "), pick(15, "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----\n"), base(64), F.lit("\n"), base(50)), F.concat(filler, pick(3, "", "\n", 'key = "', "private_key: "))),
    ]
    false = [
        (hex_(40), F.concat(filler, pick(3, "commit ", "revision: ", "sha1 = ", "checksum: "))),
        (hex_(64), F.concat(filler, pick(3, "sha256:", "digest: ", "hash = ", "etag "))),
        (F.concat_ws("-", F.substring("h", 9, 8), F.substring("h", 20, 4), F.substring("h", 30, 4), F.substring("h", 40, 4), F.substring("h", 50, 12)), F.concat(filler, pick(3, "uuid: ", "id = ", "trace ", ""))),
        (F.translate(F.substring("h", 30, 16), "abcdef", "123456"), F.concat(filler, pick(3, "", "number ", "order ", "call "))),
        (F.concat(pick(15, "your_api_key_here_", "EXAMPLE_TOKEN_", "replace-this-secret-", "changeme_password_", "dummy_access_key_"), F.substring("h", 60, 3), F.lit("1")), F.concat(filler, pick(3, 'token = "', "api_key: ", 'password="', "secret = "))),
        (F.concat(pick(15, "src/main/java/module", "lib/service/handler", "home/user/project", "get_user_list_by_"), F.conv(F.substring("h", 60, 2), 16, 10), pick(19, "/index", "/config", "_factory", "/test")), F.concat(filler, pick(3, "import ", "path: ", "", "see "))),
        (F.concat(pick(15, "updateUserContent", "createRequestManager", "TableIndexFactory", "getServerConfig"), F.conv(F.substring("h", 60, 2), 16, 10), pick(19, "Handler", "Service", "List", "Value")), F.concat(filler, pick(3, "class ", "call ", "", "token "))),
        (F.concat(pick(15, "os.environ[", "request.headers.get(", "self.config.", "getenv(", "${"), pick(19, "name", "TOKEN", "token_value", "settings"), pick(23, "]", ")", "", "}")), F.concat(filler, pick(3, "password = ", "secret: ", "token=", "api_key = "))),
        (pick(15, "required", "string", "changeme", "optional,", "undefined", "password", "default_value", "your-secret-here", "placeholder", "null,null"), F.concat(filler, pick(3, "password: ", 'secret = "', "token: ", 'api_key="'))),
    ]
    chosen = lambda options, part: F.element_at(F.array(*(o[part] for o in options)), (F.col("kind") % len(options) + 1).cast("int"))
    is_true = F.col("id") % 2 == 0
    return rows.select(
        F.when(is_true, chosen(true, 0)).otherwise(chosen(false, 0)).alias("candidate"),
        F.when(is_true, chosen(true, 1)).otherwise(chosen(false, 1)).alias("before"),
        after.alias("after"),
        pick(23, "src/app.py", "config/prod.env", "web/page", "notes.txt", "src12", "tests/test_app.py").alias("path"),
        is_true.cast("double").alias("label"),
    )


def trained(labelled: DataFrame, path_column: str = "path", trees: int = 40, depth: int = 8, seed: int = 11) -> PipelineModel:
    """The forest on labelled findings (candidate, before, after, a path, label). Their number bounds what training takes."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features_").transform(features(labelled, path_column))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features_", probabilityCol="votes_", rawPredictionCol="raw_", predictionCol="verdict_", numTrees=trees, maxDepth=depth, seed=seed)
    return PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features_"), forest.fit(rows)])


def scan(docs: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """doc_id, start, candidate, probability, is_secret: every candidate of every whole text, with the forest's verdict.

    start is in characters from 0. Null and empty texts have no candidates; a text of any length is scanned whole, in time in
    proportion to it; a null path says nothing; null ids stay null; repeated rows are scanned each for itself; an empty table
    gives no rows; other columns are not looked at.
    """
    model = model or trained(labelled_findings(docs.sparkSession))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(path_column).cast("string").alias("path"), common.whole(text_column).alias("text"))
    scored = model.transform(features(candidates(base), "path")).withColumn("probability", F.round(vector_to_array("votes_")[1], 6))
    return scored.select("doc_id", "start", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))
