"""Made documents that hold what operators have to cope with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, chunk int, found_ string, component string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [prose(rng.randint(25, 120)) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "CHANGED"
        near.append(" ".join(w))
    shared = prose(30)
    mixed = [f"{prose(15)}\n{shared}\n{prose(12)}" for _ in range(4)]
    odd = [None, "", "   \n\t ", "one", "one two three", "One TWO three", "x " * 300, prose(9000), "a\x0bb\x0cc\rd e f g h i j k l m n o p q", "日本語 テキスト " * 12, "é́ ß ﬁ " * 10]
    return [*base, *near, *base[:5], base[0], base[0], *mixed, *odd, base[3].upper()]


def documents(spark, extra=()):
    rows = [(i, t, [None, "en", "de"][i % 3], f"src{i % 4}", None, "x", 1, "y", "z") for i, t in enumerate([*texts(), *extra])]
    rows += [rows[2], rows[2], (None, "text of no id " * 8, None, None, None, None, None, None, None)]  # repeated rows, and one without an id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
