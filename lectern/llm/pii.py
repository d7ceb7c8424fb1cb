"""Surrogates for personal data. DataFrame functions only.

Entities are found by one pattern, over whole texts, once. Each distinct entity of the corpus gets one surrogate, made from
a keyed hash of its type and canonical form, so the same entity is the same surrogate everywhere, however it is written:
digits are filled into the layout of each mention, names keep their title, and a family name alone gets what it got beside
its given name. Surrogates are checked against each other and against all entities of the corpus; where two meet, the
smallest entity keeps the surrogate and the others are hashed anew, until all differ. A format may have fewer surrogates than
the corpus has entities of it, so from the third try on surrogates are longer, by a digit or letter with each try: the tries
end, and only entities of crowded formats lose their exact length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
PHONE = rf"{_EDGE}\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{1,4}}{_END}|{_EDGE}\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_END}"
SSN = rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}"
IBAN = rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{3,7}}(?: [A-Z0-9]{{1,3}})?){_END}"
CARD = rf"{_EDGE}(?:[0-9]{{4}}[ -]){{3}}[0-9]{{4}}{_END}|{_EDGE}[0-9]{{13,19}}{_END}"
#: Titles that tell a person, by gender.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "г-н", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа", "госпожа")}
_TITLE = "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
#: A name, without the ending of a possessive.
_NAME = r"\p{Lu}(?:\p{L}|['-](?!s(?!\p{L}))\p{L})++"
PERSON = rf"{_EDGE}(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"
ENTITY = "|".join((EMAIL, IP, PHONE, SSN, IBAN, CARD, PERSON))
#: No entity is without one of these.
HINT = rf"[@0-9]|(?:{_TITLE})\.? \p{{Lu}}"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke la le li lo ma me mi mo na ne no pa ra re ro sa se ta te".split(), "cyrillic": "ба ве го да де жа за зо ка ко ла ле ли ло ма ме ми мо на не но па ра ре ро са се со та те ти то".split()}
_ENDINGS = {("m", "latin"): "n", ("f", "latin"): "lia", ("m", "cyrillic"): "н", ("f", "cyrillic"): "я", ("family", "latin"): "ston", ("family", "cyrillic"): "ко"}
#: First choices for given names.
_GIVEN = {
    ("m", "latin"): "adam boris carlos daniel erik felix georg hugo ivan jonas kevin lucas martin noah oscar paul".split(),
    ("f", "latin"): "anna berta clara diana emma frida greta helena irene julia karin laura maria nora olga paula".split(),
    ("m", "cyrillic"): "антон борис виктор денис егор иван кирилл максим никита олег павел роман сергей тимур фёдор юрий".split(),
    ("f", "cyrillic"): "алина белла вера галина дарья елена жанна зоя ирина клара лидия мария нина ольга полина софья".split(),
}


def _byte(i: Column | int) -> Column:
    """The i-th byte of the hash in column `digest` (64 bytes, then again from the first)."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(F.col("digest"), (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(options: list[str], value: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (value % len(options) + 1).cast("int"))


def _letter(alphabet: str, value: Column) -> Column:
    return F.substring(F.lit(alphabet), (value % len(alphabet) + 1).cast("int"), F.lit(1))


def _drawn(letters: Column, value: Column) -> Column:
    return F.substring(letters, (value % F.length(letters) + 1).cast("int"), F.lit(1))


def _same_shape(text: Column) -> Column:
    """Digits for digits, letters for letters of the same script; anything else stays. Scripts other than Latin, Cyrillic and
    Greek take their letters from the text itself."""
    others = F.regexp_replace(text, r"[\P{L}\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]", "")

    def put(ch: Column, i: Column) -> Column:
        v = _byte(i)
        out = F.when(ch.rlike("[0-9]"), (v % 10).cast("string"))
        for script, alphabet in (("Latin", _LATIN), ("Cyrillic", _CYRILLIC), ("Greek", _GREEK)):
            out = out.when(ch.rlike(rf"^\p{{Is{script}}}$") & ch.rlike(r"^\p{L}$"), _letter(alphabet, v))
        return out.when(ch.rlike(r"^\p{L}$"), _drawn(others, v)).otherwise(ch)

    return F.array_join(F.transform(F.split(text, ""), put), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check, modulo 10: 0 for a valid number."""
    n = F.length(digits)

    def value(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10


def _like_card(canonical: Column, more: Column) -> Column:
    """A number that passes Luhn's check if and only if the original does."""
    n = F.length(canonical)
    body = F.concat(F.substring(_same_shape(canonical), F.lit(1), n - 1), more)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.concat(body, F.when(_luhn(canonical) == 0, check).otherwise((check + 1 + _byte(63) % 9) % 10).cast("string"))


def _remainder(iban: Column) -> Column:
    """Of an IBAN's number modulo 97: 1 for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(r: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), r * 10 + ch.cast("int")).otherwise(r * 100 + F.ascii(ch) - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _like_iban(canonical: Column, more: Column) -> Column:
    """A number of the same country that is valid if and only if the original is."""
    land = F.substring(canonical, 1, 2)
    body = F.concat(F.upper(F.substring(_same_shape(F.lower(canonical)), F.lit(5), F.length(canonical))), more)
    right = 98 - _remainder(F.concat(land, F.lit("00"), body))
    wrong = (right - 1 + _byte(63) % 96) % 97 + 2
    check = F.when(_remainder(canonical) == 1, right).otherwise(wrong)
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), body)


def _name(kind: str, script: str, attempt: int) -> Column:
    if script == "other":  # letters of the name itself, which are of its script whichever that is
        if attempt > 1:  # it may have too few
            return _name(kind, "latin", attempt)
        own = F.regexp_replace("canonical", r"\P{L}", "")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.length(own) + 1 + attempt), lambda i: _drawn(own, _byte(i))), "")
    if attempt == 0 and kind != "family":
        return _one_of(_GIVEN[kind, script], _byte(0))
    syllables = _SYLLABLES[script]
    return F.concat(*(_one_of(syllables, _byte(i)) for i in range(3 if attempt < 3 else 5 + attempt)), F.lit(_ENDINGS[kind, script]))


def _surrogate(attempt: int) -> Column:
    """Canonical form of the surrogate, from type, canonical and digest."""
    c, kind = F.col("canonical"), F.col("type")
    local = F.substring_index(c, "@", 1)
    more = F.concat(F.lit(""), *((_byte(50 + i) % 10).cast("string") for i in range(attempt - 1)))
    out = F.when(kind == "email", F.concat(_same_shape(local), F.lit("@"), F.array_join(F.array(*(_letter(_LATIN, _byte(i)) for i in range(40, 50))), ""), F.lit(".example")))
    if attempt < 3:
        out = out.when(kind == "ip", F.concat_ws(".", _byte(0) % 223 + 1, _byte(1), _byte(2), _byte(3) % 254 + 1))
    else:  # of the longer kind, in the range that is set aside for examples
        out = out.when(kind == "ip", F.concat_ws(":", F.lit("2001:db8"), *(F.substring("digest", 1 + 4 * i, 4) for i in range(6))))
    out = out.when(kind == "phone", F.concat(F.substring(c, 1, 1), F.substring(_same_shape(c), F.lit(2), F.length(c)), more))
    out = out.when(kind == "iban", _like_iban(c, more)).when(kind == "card", _like_card(c, more)).when(kind == "ssn", F.concat(_same_shape(c), more))
    for g in ("m", "f", "family"):
        for script in ("latin", "cyrillic", "other"):
            out = out.when(kind == f"{g}_{script}", _name(g, script, attempt))
    return out


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mentions(surfaces: DataFrame) -> DataFrame:
    """surface, type and entities (array of type, canonical) of distinct mentions."""
    s = F.col("surface")
    whole = lambda p: s.rlike(f"^(?:{p})$")
    kind = F.when(s.contains("@"), "email").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(PHONE), "phone").when(whole(IBAN), "iban").when(whole(CARD), "card").otherwise("person")
    words = F.split(s, " ")
    script = F.when(s.rlike(r"\p{IsCyrillic}\P{L}*$"), "cyrillic").when(s.rlike(r"\p{IsLatin}\P{L}*$"), "latin").otherwise("other")
    gender = F.when(F.regexp_replace(words[0], r"\.$", "").isin(*TITLES["m"]), "m").otherwise("f")
    one = lambda t, c: F.struct(t.alias("type"), c.alias("canonical"))
    family = one(F.concat(F.lit("family_"), script), F.lower(F.element_at(words, -1)))
    person = F.when(F.size(words) == 3, F.array(one(F.concat_ws("_", gender, script), F.lower(words[1])), family)).otherwise(F.array(family))
    canonical = F.when(kind == "email", F.lower(s)).when(kind.isin("phone", "card", "ssn"), _only_digits(s)).when(kind == "iban", F.replace(s, F.lit(" "))).otherwise(s)
    return surfaces.select("surface", kind.alias("type"), F.when(kind == "person", person).otherwise(F.array(one(kind, canonical))).alias("entities"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, canonical, surrogate of distinct entities: surrogates all different, none of them an entity.

    A round keeps what no other entity has and settles the smallest of those that want the same. From the third on
    surrogates grow, so their number does by ten with each round, and the rounds end.
    """
    entities = common.written(entities)
    left, done, attempt = entities, None, 0
    while True:
        digest = F.sha2(F.concat_ws("|", F.lit(key), "type", F.lit(str(attempt)), "canonical"), 512)
        tried = left.withColumn("digest", digest).withColumn("surrogate", _surrogate(attempt)).select("type", "canonical", "surrogate")
        free = tried.groupBy("type", "surrogate").agg(F.min("canonical").alias("canonical"))
        free = free.join(entities.withColumnRenamed("canonical", "surrogate"), ["type", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        free = free.select("type", "canonical", F.lit(True).alias("free"))
        round_ = common.written(tried.join(free, ["type", "canonical"], "left"))
        settled = round_.where("free").drop("free")
        done = settled if done is None else done.unionAll(settled)
        left = round_.where("free IS NULL").select("type", "canonical")
        if left.isEmpty():
            return done
        attempt += 1


def _filled(surface: Column, new: Column, kept: str = "[^0-9]") -> Column:
    """The layout of a mention (characters of `kept`) with other digits; those it has no room for stand at the end."""

    def put(ch: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), kept, ""))
        return F.when(ch.rlike(kept), ch).otherwise(F.substring(new, nth, F.lit(1)))

    room = F.length(F.regexp_replace(surface, kept, ""))
    return F.concat(F.array_join(F.transform(F.split(surface, ""), put), ""), F.substring(new, room + 1, F.length(new)))


def _replacement() -> Column:
    """From surface, type and surrogates (in the order of the mention's entities)."""
    s, kind, first = F.col("surface"), F.col("type"), F.col("surrogates")[0]
    names = F.array_join(F.transform("surrogates", lambda x: F.initcap(x)), " ")
    cased = F.when(F.upper(s) == s, F.upper(first)).otherwise(first)
    return F.when(kind == "person", F.concat(F.substring_index(s, " ", 1), F.lit(" "), names)).when(kind == "email", cased).when(kind.isin("phone", "card", "ssn"), _filled(s, first)).when(kind == "iban", _filled(s, first, " ")).otherwise(first)


def replacements(surfaces: DataFrame, key: str) -> DataFrame:
    """surface, replacement of distinct mentions."""
    known = common.written(mentions(surfaces))
    each = known.select("surface", F.col("type").alias("kind"), F.posexplode("entities").alias("nth", "entity")).select("surface", "kind", "nth", "entity.type", "entity.canonical")
    made = surrogates(each.select("type", "canonical").distinct(), key)
    joined = each.join(made, ["type", "canonical"]).groupBy("surface", "kind").agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("parts"))
    return joined.select("surface", F.col("kind").alias("type"), F.transform("parts", lambda p: p["surrogate"]).alias("surrogates")).select("surface", _replacement().alias("replacement"))


def replaced(docs: DataFrame, key: str = "lectern", text_column: str = "text") -> DataFrame:
    """docs with every entity of the text replaced, and n_entities.

    Null and empty texts stay as they are, with no entities; a text or entity of any length is taken whole; rows of equal text get
    equal results; no row is lost or added;
    an empty table stays empty; other columns stay, but for one that is called n_entities, which is replaced. `key` is the
    secret that makes surrogates unguessable, and alike between runs.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    columns = [c for c in docs.columns if c != "n_entities"]
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text_column]
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)
    # the other columns travel under one name, so theirs cannot clash with those used here
    rows = docs.select(F.struct(F.lit(0).alias("c"), *others).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    marked = common.written(rows.withColumn("found", F.coalesce(found, none)))
    some = marked.where(F.size("found") > 0).withColumn("key", F.sha2("text", 256))
    lists = some.select("key", "found").dropDuplicates(["key"])
    table = replacements(lists.select(F.explode("found").alias("surface")).distinct(), key)
    put = lists.select("key", F.posexplode("found").alias("at", "surface")).join(table, "surface").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "replacement"))).alias("put"))
    gaps = F.split(text, ENTITY, -1)
    new = F.array_join(F.zip_with(gaps, F.concat(F.transform("put", lambda x: x["replacement"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    def whole(part: DataFrame, value: Column) -> DataFrame:
        return part.select(*(value.alias(c) if c == text_column else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)), F.size("found").cast("long").alias("n_entities"))

    return whole(marked.where(F.size("found") == 0), text).unionAll(whole(some.join(put, "key"), new))
