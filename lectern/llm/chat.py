"""Cumulative-snapshot collapse of logged conversations, and rendering. DataFrame functions only.

A chat client that logs the whole history with every request leaves each conversation many times over, as prefixes of the
last one. The rolling hash of a prefix is the exclusive or of two 64-bit hashes of (position, role, text) over its turns.
Conversations whose whole hash is the hash of a prefix of a longer one, or of an equal one with a smaller id, go by an
anti-join with the prefix table. Equal conversations and equal prefixes are aggregated first: what a third of all
conversations share is one row there. Positions and prefixes are counted within blocks of turn numbers and moved up by the blocks before, so a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 256
PART = 64


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n, role, text, h1, h2: each turn with its position, the length of its conversation, and the hash of
    the conversation up to it. Turns stand in order of (turn, role, text), nulls first."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("n"))
    placed = rows.withColumn("row", F.count(F.lit(1)).over(inner)).join(sizes, ["conv_id", "block"])
    placed = placed.withColumn("pos", F.col("start") + F.col("row")).drop("start", "row")
    hashed = placed.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64("text", "pos", F.lit("second"), "role"))
    hashed = common.written(hashed)
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    at = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    starts = sums.select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(before), none).alias("s1"), F.coalesce(F.bit_xor("b2").over(before), none).alias("s2"))
    rolled = hashed.withColumn("r1", F.bit_xor("h1").over(at)).withColumn("r2", F.bit_xor("h2").over(at)).join(starts, ["conv_id", "block"])
    return rolled.select("conv_id", "pos", "n", "role", "text", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("h2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id: of conversations that are no proper prefix of another, and of equal ones the smallest id.

    Both sides of the anti-join are aggregated first, so a conversation logged very often is one row on either.
    """
    full = rolled.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = rolled.where("pos < n").select("pos", "h1", "h2").distinct()
    return full.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def rendered_turn(role: str, text: str) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.col(text), F.lit("<|im_end|>\n"))


def collapsed(turns: DataFrame) -> DataFrame:
    """The conversations that stay, rendered: conv_id, part, n_turns, text.

    Turns without a conversation id belong to none and are left out; null roles and texts are empty ones; turns that share a
    number follow each other by role and text, repeated ones each count; an empty table gives no rows; other columns are
    not looked at. A conversation comes in parts of PART turns, numbered from 0, so that no row grows without bound; its
    text is theirs, one after the other.
    """
    rolled = common.written(prefixes(turns))
    kept = rolled.join(maximal(rolled), "conv_id")
    lines = kept.select("conv_id", F.floor((F.col("pos") - 1) / PART).alias("part"), "n", F.struct("pos", rendered_turn("role", "text").alias("line")).alias("turn"))
    parts = lines.groupBy("conv_id", "part").agg(F.max("n").alias("n_turns"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"))
