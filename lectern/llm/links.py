"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b) the smallest node that it reaches.

    Each round links the larger neighbours of a node to its smallest neighbour, then its smaller ones; the number of links
    never grows past the first round's, and the rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder, so that a lost executor costs no earlier round.
    """
    links = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = _mark(links)
    while seen[0]:
        both = links.select("v", "u").unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v").select("u", "m").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = common.written(floor.select("v", F.col("m").alias("u")).unionAll(small).distinct())
        mark = _mark(new)
        common.forget(links)
        links = new
        if mark == seen:
            break
        seen = mark
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(links.select(F.col("u"), F.col("u")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
