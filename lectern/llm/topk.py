"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of bounded size and queries into blocks; each block meets each shard in one task. A shard
sorts its vectors once in every dimension. For a query the lists are walked from the end that its component favours, all
to the same depth; every vector seen is scored in full; the sum of the query's products at that depth bounds whatever has
not been seen, and the walk stops when it cannot beat the kth score so far. The shards' results, k for each query, are
merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16384
BLOCK_ROWS = 1024
SCALE = 1024


def quantized(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v, times: floor(SCALE * x) of each component, and how many rows are alike; without rows whose id or vector is null
    or holds a null or non-finite component."""
    v = F.col(vector_column).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(F.coalesce(whole, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v"))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(a), width), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(a)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _width(column: pa.ChunkedArray) -> int:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return int(np.diff(a.offsets.to_numpy()).max(initial=0))


class Lists:
    """A shard's vectors in order of each dimension, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.copies = None if copies is None else copies[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(self.vectors, self.order.T, axis=0).T.copy()
        self.floats = self.vectors.astype(np.float64)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact; by floats while every sum is a whole number that they hold."""
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def place(self, id_: int, vector: np.ndarray) -> int:
        """Where the first copy of a row is, or -1."""
        a, b = np.searchsorted(self.ids, [id_, id_ + 1])
        at = a + np.flatnonzero((self.copies[a:b] == 0) & (self.vectors[a:b] == vector).all(axis=1))
        return int(at[0]) if len(at) else -1

    def top(self, query: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best other than the row at `own`, ties to the smaller id, and the depth walked."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while depth < n:
            to = min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[up, n - to : n - depth]] = True  # the next entries of each list
            now[self.order[down, depth:to]] = True
            if not len(up) and not len(down):
                now[:], to = True, n
            new = np.flatnonzero(now & ~seen)
            seen |= now
            new = new[new != own]
            found, scores = np.concatenate([found, new]), np.concatenate([scores, self.scores(new, query)])
            if len(found) > k:  # only what can be among the best is ordered
                some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[some], scores[some]
            best = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
            bound = int(query[up] @ self.value[up, n - to]) + int(query[down] @ self.value[down, to - 1])
            depth, step = to, step * 2
            # an unseen vector may tie with the kth and have the smaller id
            if seen.all() or len(scores) == k and bound < scores[-1]:
                break
        return self.ids[found], scores, depth


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k highest scores among all other rows.

    Ties go to the smaller id. Shorter vectors count as ending in zeros. Rows that share an id are vectors of their own, as
    candidates and as queries: a query's own row alone is left out, and each such query has its k results under the id. Of
    rows alike in id and vector, more than k + 1 cannot be told from k + 1 and travel as so many. Fewer rows than k give all
    of them; an empty table gives no rows; other columns are not looked at. Components times SCALE must stay below 2^31 in
    size / the square root of the dimension.
    """
    alike = quantized(vectors, id_column, vector_column)
    rows = alike.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("times", F.lit(k + 1)).cast("int") - 1)))
    count = rows.select(F.count(F.lit(1)).alias("n"), F.count_if((F.col("id") % every == 0) & (F.col("copy") == 0)).alias("q")).first()
    shards, blocks = max(1, -(-count["n"] // shard_rows)), max(1, -(-count["q"] // block_rows))
    deal = lambda n, *of: F.pmod(F.xxhash64("id", "v", *of), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select(deal(shards, "copy").alias("shard"), every_one(blocks).alias("block"), "id", "v", "copy")
    # queries of one id are told apart by two hashes of their vectors
    marks = F.xxhash64("v").alias("mark"), F.xxhash64(F.lit(1), "v").alias("mark2")
    asked = alike.where(F.col("id") % every == 0).select(every_one(shards).alias("shard"), deal(blocks, F.lit(2)).alias("block"), "id", "v", "times", *marks)
    out = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("mark2", pa.int64()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(side, queries):
        cols: list[list] = [[] for _ in out]
        if side.num_rows and queries.num_rows:
            width = max(_width(side.column("v")), _width(queries.column("v")))
            lists = Lists(side.column("id").to_numpy(), _matrix(side.column("v"), width), side.column("copy").to_numpy())
            of = zip(*(queries.column(c).to_pylist() for c in ("id", "mark", "mark2", "times")))
            for (q, mark, mark2, times), v in zip(of, _matrix(queries.column("v"), width)):
                ids, scores, _ = lists.top(v, lists.place(q, v), k)
                for col, x in zip(cols, (*([c] * len(ids) for c in (q, mark, mark2, times)), ids.tolist(), scores.tolist())):
                    col.extend(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    types = "query_id long, mark long, mark2 long, times long, vec_id long, score long"
    found = sides.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, types)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mark", "mark2").orderBy(F.desc("score"), "vec_id")))
    best = ranked.where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time_")).drop("time_")
