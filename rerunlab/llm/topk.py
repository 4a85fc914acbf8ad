"""Exact top-k inner products by no-random-access aggregation.

Vectors are dealt into blocks. In a block every dimension has one sorted list. The lists
are read in order from the end where a query's contributions are largest (both ends, for
queries of either sign), a stretch of each list at a time. Each vector has a lower bound
(what was read, plus the least its unread lists can add) and an upper one (plus the
contributions those lists have come down to); a vector's length comes with its entries,
and what is left of it bounds what is unread as well. Vectors whose upper bound is below
the k-th lower bound cannot qualify and are passed over from then on. Reading goes on until
all vectors that may qualify were met in every list, so at the end their scores are whole;
no entry is looked up out of turn. Their best k go on to the merge over blocks. The bounds
of many queries, which share the order of reading, are matrix products.

Components are floor(scale * x) with x as double, so scores are whole numbers.
Defined results: vectors that are null or hold null or non-finite components take no
part, as query or candidate. Vectors of other lengths than the query's are not
compared. Candidates with the query's own id are left out; repeated rows of others
each take a rank. Ties go to the smaller id. Fewer than k candidates give them all.
Scores must stay below 2**53 in absolute value; a larger bound raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, with_row_id

BLOCK, QUERY_BLOCK = 8192, 4096
#: A list is read in so many stretches; so many queries are taken at once.
STRETCHES, TOGETHER = 4, 64


class Lists:
    """The sorted lists of one block of vectors, as each vector's place in every list
    (ascending) and the lists' values; entries come with their vector's length."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.values, self.ids = values, ids
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Ids and scores of the k best for each query, ties to the smaller id, and how many
        entries of each list were read for it."""
        n, out = len(self.ids), [(np.zeros(0, np.int64), np.zeros(0), 0)] * len(queries)
        if not n:
            return out
        asked, some = np.arange(len(queries)), np.arange(n)  # queries not settled, vectors that may qualify for one
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        total, live = np.zeros((len(queries), n)), self.ids != own[:, None]
        slack = 1e-3 + 1e-5 * (np.abs(queries) @ np.abs(self.sorted[[0, -1]]).max(axis=0))[:, None]  # of the bounds' rounding
        values, place, read, stretch = self.values.T, self.place.T, 0, max(1, -(-n // STRETCHES))
        while len(asked):
            to = min(n, read + stretch)
            new = (place >= n - to) & (place < n - read), (place < to) & (place >= read)
            total += up @ np.where(new[0], values, 0) + down @ np.where(new[1], values, 0)
            read = to
            unread = (place < n - read).astype(np.float32), (place >= read).astype(np.float32)

            def over(a, b, unread=unread):  # sums over unread entries, from weights of either sign
                return a.astype(np.float32) @ unread[0] + b.astype(np.float32) @ unread[1]

            square = over(up**2, down**2)
            least = over(up * self.sorted[0], down * self.sorted[-1])
            most = over(up * self.sorted[n - read], down * self.sorted[read - 1])
            rest = (values**2).astype(np.float32)
            left = (up > 0).astype(np.float32) @ (rest * unread[0]) + (down < 0).astype(np.float32) @ (rest * unread[1])
            reach = np.sqrt(square * left) * (1 + 1e-5) + slack
            low = np.where(live, total + np.maximum(least - slack, -reach), -np.inf)
            if len(some) > k:
                bar = np.partition(low, len(some) - k, axis=1)[:, len(some) - k, None]
                live &= total + np.minimum(most + slack, reach) >= bar
            settled = ~(live & (square > 0)).any(axis=1)
            for i in np.flatnonzero(settled):
                ids, scores = self.ids[some[live[i]]], total[i, live[i]]
                best = np.lexsort((ids, -scores))[:k]
                out[asked[i]] = ids[best], scores[best], read
            go, keep = ~settled, live[~settled].any(axis=0)
            asked, up, down, slack, some = asked[go], up[go], down[go], slack[go], some[keep]
            total, live, values, place = total[go][:, keep], live[go][:, keep], values[:, keep], place[:, keep]
        return out


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in schema]
        if vectors.num_rows and queries.num_rows:
            values, asked = _matrix(vectors, "v"), _matrix(queries, "v")
            largest = np.abs(values).max(initial=0) * np.abs(asked).max(initial=0) * values.shape[1]
            if largest >= 2**53:
                raise ValueError("components too large for exact scores")
            lists = Lists(values, vectors.column("id").to_numpy())
            own, rows = queries.column("id").to_numpy(), queries.column("rid").to_numpy()
            for at in range(0, len(asked), TOGETHER):
                part = slice(at, at + TOGETHER)
                for i, (ids, scores, _) in enumerate(lists.top(asked[part], own[part], k), at):
                    for column, x in zip(out, (np.full(len(ids), own[i]), np.full(len(ids), rows[i]), ids, scores.astype(np.int64)), strict=True):
                        column.append(x)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], schema)

    return run


def quantised(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """id, rid, d, v for the vectors that take part."""
    x = F.col(column)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = with_row_id(vectors.select(F.col(key).cast("long").alias("id"), x.alias(column)), "rid").where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("double"))
    return rows.select("id", "rid", F.size(column).alias("d"), v.alias("v")).where("d > 0")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query against every vector, block by block."""
    left = Table(quantised(vectors, key, column, scale)).df
    right = Table(quantised(queries, key, column, scale)).df
    cells = max(1, -(-left.count() // BLOCK))
    groups = max(1, -(-right.count() // QUERY_BLOCK))
    a = left.withColumn("cell", F.pmod("rid", F.lit(cells)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = right.withColumn("part", F.pmod("rid", F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    keys = ["d", "cell", "part"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search(k), "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
