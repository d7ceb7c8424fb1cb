"""Column functions on vectors: arrays of numbers, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))))


def bucket(token: Column, dim: int) -> Column:
    """The place of a token in a hashed bag of words: the first 32 bits of its MD5, modulo dim."""
    if 256 % dim == 0:  # their last byte tells
        digit = lambda h, at: let(F.ascii(F.substring(h, at, 1)), lambda a: a - F.when(a > 57, 87).otherwise(48))
        return let(F.md5(token), lambda h: (digit(h, 7) * 16 + digit(h, 8)) % dim)
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")
