"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, also where a lambda in body needs it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(values: Column) -> Column:
    """value and n (its number) of each different value of a sorted array."""

    def cut(v: Column) -> Column:
        edge = lambda i: (i == 0) | (i == F.size(v)) | (F.get(v, i) != F.get(v, i - 1))
        return let(F.filter(F.sequence(F.lit(0), F.size(v)), edge), lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, j: F.struct(F.get(v, a).alias("value"), (F.get(e, j + 1) - a).alias("n"))))

    return let(values, cut)
