"""Draws over whole units without a row for each draw.

Rows of a unit meet in one task once, whatever the number of draws; the draws of
``special.uniform`` are made there by numpy (``functions.hashing``), so they are those a
row for each draw would get. A task keeps a block of units and a chunk of draws, and gives
one row of sums for each draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing

#: Rows of whole units worked on together, and numbers in a chunk of draws over some of them.
BLOCK, CHUNK = 65_536, 1 << 15
#: Units whose statistics one task holds in a bootstrap, and groups of draws there.
TILE, GROUPS = 1 << 22, 32

SUMS = "b int, concordance double, pairs long, mixed_units long"


def together(df: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of a unit in one task, in as many tasks as the session's shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of some whole units; a unit begins where ``_at`` is 1."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append({n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)})
        rows += batch.num_rows
        if rows >= BLOCK:
            starts = np.flatnonzero(held[-1]["_at"] == 1)
            if len(starts):  # the last unit may go on in the next batch
                cut, last = starts[-1], held.pop()
                whole = [*held, {n: x[:cut] for n, x in last.items()}]
                held = [{n: x[cut:] for n, x in last.items()}]
                rows = len(held[0]["_at"])
                yield {n: np.concatenate([w[n] for w in whole]) for n in held[0]}
    if held:
        yield {n: np.concatenate([w[n] for w in held]) for n in held[0]}


def _by_shape(block: dict[str, np.ndarray], shape: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """Row numbers of units with equally many rows (and an equal ``shape``), a row a unit."""
    at = block["_at"]
    if not len(at):
        return
    starts = np.flatnonzero(at == 1)
    sizes = np.diff(np.append(starts, len(at)))
    key = sizes if shape is None else sizes * (1 << 32) + shape(block, starts)
    order = np.argsort(key, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        yield starts[group][:, None] + np.arange(sizes[group[0]])


def _chunks(index: np.ndarray, draws: int, per: int = CHUNK) -> Iterator[tuple[np.ndarray, int, int]]:
    """Units and draws (from, to) whose product stays near ``per`` numbers."""
    units = max(1, per // index.shape[1])
    for i in range(0, len(index), units):
        part = index[i : i + units]
        step = max(1, per // part.size)
        for b in range(0, draws, step):
            yield part, b, min(draws, b + step)


def concordance(rank: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Pairs of a positive above a negative, ties half, along the last axis."""
    n = rank.shape[-1]
    if n <= 6:
        out = np.zeros(rank.shape[:-1])
        for i in range(n):
            for j in range(n):
                if i != j:
                    out += positive[..., i] & negative[..., j] & (rank[..., i] > rank[..., j])
                    out += 0.5 * (positive[..., i] & negative[..., j] & (rank[..., i] == rank[..., j]))
        return out
    order = np.argsort(rank, axis=-1)
    r, p, q = (np.take_along_axis(x, order, -1) for x in (rank, positive, negative))
    upto = np.cumsum(q, axis=-1, dtype=np.int64)
    new = np.ones(r.shape, bool)
    new[..., 1:] = r[..., 1:] != r[..., :-1]
    below = np.maximum.accumulate(np.where(new, upto - q, 0), axis=-1)
    last = np.ones(r.shape, bool)
    last[..., :-1] = new[..., 1:]
    through = np.minimum.accumulate(np.where(last, upto, np.iinfo(np.int64).max)[..., ::-1], axis=-1)[..., ::-1]
    return np.where(p, below + through, 0).sum(axis=-1) / 2


class Totals:
    def __init__(self, draws: int):
        self.c, self.pairs, self.mixed = np.zeros(draws), np.zeros(draws, np.int64), np.zeros(draws, np.int64)

    def add(self, b: int, e: int, c: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Concordance, positives and negatives of units (rows) in draws b to e (columns)."""
        both = (p > 0) & (n > 0)
        self.c[b:e] += np.where(both, c, 0).sum(axis=0)
        self.pairs[b:e] += np.where(both, p * n, 0).sum(axis=0)
        self.mixed[b:e] += both.sum(axis=0)

    def rows(self) -> pa.RecordBatch:
        b = np.arange(1, len(self.c) + 1, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (b, self.c, self.pairs, self.mixed)], names=["b", "concordance", "pairs", "mixed_units"])


def _places(h: np.ndarray, b: int, e: int, seed: int) -> np.ndarray:
    """For units (M, r) the runs in the order of their draws' hashes: (M, e - b, r); equal
    hashes stay in the order of runs."""
    draw = np.arange(b + 1, e + 1)[None, :, None]
    bits = hashing.with_int(hashing.with_int(h[:, None, :], draw), seed) >> np.uint64(12)
    return np.argsort(bits, axis=-1, kind="stable")


def _ranked(df: DataFrame, unit: list[str], run: str, y: str, score: str) -> DataFrame:
    """_at (place of the run in its unit), _h (its hash), _r (rank of its score in the unit,
    0 without one), _y (its label, -1 without one), rows of a unit together and in order."""
    rows = together(df.select(*unit, F.col(run).alias("_run"), F.col(y).alias("_label"), F.col(score).alias("_score")), unit)
    w = Window.partitionBy(*unit)
    ranked = rows.withColumn("_r", F.when(F.col("_score").isNull(), 0).otherwise(F.rank().over(w.orderBy("_score"))))
    placed = ranked.withColumn("_at", F.row_number().over(w.orderBy("_run")))
    return placed.select("_at", F.xxhash64("_run").alias("_h"), F.col("_r").cast("int"), F.coalesce(F.col("_label").cast("int"), F.lit(-1)).cast("int").alias("_y"))


def _summed(rows: DataFrame, work: Callable, draws: int) -> DataFrame:
    """b, auroc, pairs, mixed_units from the sums of all tasks."""
    sums = rows.mapInArrow(work, SUMS).groupBy("b").agg(F.sum("concordance").alias("c"), F.sum("pairs").alias("pairs"), F.sum("mixed_units").alias("mixed_units")).where("mixed_units > 0")
    return sums.select("b", F.try_divide("c", F.col("pairs").cast("double")).alias("auroc"), "pairs", "mixed_units")


def _own(block: dict[str, np.ndarray], index: np.ndarray):
    return block["_h"].view(np.uint64)[index], block["_r"][index], block["_y"][index]


def permuted_within(df: DataFrame, unit: list[str], run: str, draws: int, y: str = "y", score: str = "s", seed: int = 0) -> DataFrame:
    """Within AUROC for each draw of labels dealt anew inside each mixed unit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals(draws)
        for block in _blocks(batches):
            for index in _by_shape(block):
                h, rank, label = _own(block, index)
                fails = np.where(label > 0, label, 0).sum(axis=1)
                mixed = (fails > 0) & (fails < index.shape[1])
                known = rank > 0
                # ties half: the mean rank of the scores among those known
                order = np.argsort(np.where(known, rank, np.iinfo(np.int32).max), axis=1, kind="stable")
                r = np.take_along_axis(rank, order, 1)
                place = np.broadcast_to(np.arange(1.0, index.shape[1] + 1), r.shape)
                new = np.ones(r.shape, bool)
                new[:, 1:] = r[:, 1:] != r[:, :-1]
                first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
                end = np.ones(r.shape, bool)
                end[:, :-1] = new[:, 1:]
                last = np.minimum.accumulate(np.where(end, place, np.inf)[:, ::-1], axis=1)[:, ::-1]
                mean = np.empty(r.shape)
                np.put_along_axis(mean, order, (first + last) / 2, 1)
                for part, b, e in _chunks(np.flatnonzero(mixed)[:, None] + np.zeros(index.shape[1], np.int64), draws, 8 * CHUNK):
                    u = part[:, 0]
                    at = _places(h[u], b, e, seed)
                    dealt = (np.arange(index.shape[1]) < fails[u][:, None])[:, None, :]
                    positive = dealt & np.take_along_axis(np.broadcast_to(known[u][:, None, :], at.shape), at, -1)
                    p = positive.sum(axis=-1)
                    n = known[u].sum(axis=1)[:, None] - p
                    total.add(b, e, np.where(positive, np.take_along_axis(np.broadcast_to(mean[u][:, None, :], at.shape), at, -1), 0).sum(axis=-1) - p * (p + 1) / 2, p, n)
        yield total.rows()

    return _summed(_ranked(df, unit, run, y, score), work, draws)


def subsampled_within(df: DataFrame, unit: list[str], run: str, keep: int, draws: int, y: str = "y", score: str = "s", seed: int = 0) -> DataFrame:
    """Within AUROC for each draw of ``keep`` runs of every unit that has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals(draws)
        for block in _blocks(batches):
            for index in _by_shape(block):
                if index.shape[1] < keep:
                    continue
                for part, b, e in _chunks(index, draws, 8 * CHUNK):
                    h, rank, label = _own(block, part)
                    at = _places(h, b, e, seed)[..., :keep]
                    r, l = (np.take_along_axis(np.broadcast_to(x[:, None, :], (len(part), e - b, part.shape[1])), at, -1) for x in (rank, label))
                    positive, negative = (l == 1) & (r > 0), (l == 0) & (r > 0)
                    total.add(b, e, concordance(r, positive, negative), positive.sum(axis=-1), negative.sum(axis=-1))
        yield total.rows()

    return _summed(_ranked(df, unit, run, y, score), work, draws)


def synthetic_within(df: DataFrame, unit: list[str], run: str, shifts: list[tuple[float, int]], draws: int, y: str = "y") -> DataFrame:
    """i, b, auroc: within AUROC of unit normals, shifted for failures, for each (shift, seed)
    and draw. Runs of a unit are compared pair by pair, in large units by sorting."""
    step = draws * len(shifts)

    def scores(h: np.ndarray, label: np.ndarray, shift: float, seed: int) -> np.ndarray:
        tmp = np.empty_like(h)
        u = hashing.unit_interval(hashing.with_int(h, seed, tmp=tmp))
        v = hashing.unit_interval(hashing.with_int(h, seed + 1_000_003, tmp=tmp))
        np.log(u, out=u)
        u *= -2
        np.sqrt(u, out=u)
        v *= 2 * math.pi
        np.cos(v, out=v)
        u *= v
        u += shift * label
        return u

    def shape(block: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(block["_y"].astype(np.int64), starts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals(step)
        for block in _blocks(batches):
            for index in _by_shape(block, shape):
                label = block["_y"][index]
                p = int(label[0].sum())
                n = index.shape[1] - p
                if not p or not n:
                    continue
                index = np.take_along_axis(index, np.argsort(-label, axis=1, kind="stable"), 1)  # failures first
                total.pairs += len(index) * p * n
                total.mixed += len(index)
                for part, b, e in _chunks(index, draws):
                    seen = block["_h"].view(np.uint64)[part].T[:, :, None]
                    h = hashing.with_int(seen, np.arange(b + 1, e + 1))
                    for i, (shift, seed) in enumerate(shifts):
                        s = scores(h, np.zeros(1), shift, seed)
                        s[:p] += shift
                        total.c[i * draws + b : i * draws + e] += compared(s, p)
        yield total.rows()

    rows = together(df.where(F.col(y).isNotNull()).select(*unit, F.col(run).alias("_run"), F.col(y).cast("int").alias("_y")), unit)
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*unit).orderBy("_run"))).select("_at", F.xxhash64("_run").alias("_h"), "_y")
    within = _summed(placed, work, step)
    return within.select(F.floor((F.col("b") - 1) / draws).cast("int").alias("i"), (F.pmod(F.col("b") - 1, F.lit(draws)) + 1).alias("b"), "auroc")


def compared(s: np.ndarray, p: int) -> np.ndarray:
    """For scores (runs, units, draws), the first ``p`` runs positive: concordance of each draw."""
    n = len(s) - p
    if p * n > 12 * len(s):
        x = np.moveaxis(s, 0, -1)
        positive = np.broadcast_to(np.arange(len(s)) < p, x.shape)
        return concordance(x, positive, ~positive).sum(axis=0)
    above, equal = np.zeros(s.shape[1:], np.int16), np.zeros(s.shape[1:], bool)
    for i in range(p):
        for j in range(p, p + n):
            above += s[i] > s[j]
            equal |= s[i] == s[j]
    out = above.sum(axis=0, dtype=np.int64).astype(float)
    if equal.any():
        out += 0.5 * sum((s[i] == s[j]).sum(axis=0) for i in range(p) for j in range(p, p + n))
    return out


def drawn_sums(units: DataFrame, unit: list[str], values: list[str], draws: int, seed: int = 0) -> DataFrame:
    """b and the sum of each of ``values`` over as many units as there are, drawn with
    replacement: draw b's pick ``id`` is the unit in place floor(uniform(id, b) * n) in key
    order. Units are packed where ranges of keys bring them; a tile of at most TILE units and
    some draws is one task, which makes the picks and looks up those that fall into it, so no
    row is made for a pick and no task holds more than a tile."""
    width = len(values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = pa.StructArray.from_arrays([batch.column(i)[:1] for i in range(len(unit))], names=unit)
                x = np.stack([batch.column(len(unit) + i).to_numpy(zero_copy_only=False) for i in range(width)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([first, pa.array([batch.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["first", "size", "v"])

    rows = units.select(*unit, *(F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)))
    keys = rows.select(F.struct(*unit).alias("first")).schema["first"].dataType.simpleString()
    shuffles = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartitionByRange(shuffles, *unit).sortWithinPartitions(*unit).mapInArrow(pack, f"first {keys}, size long, v binary")
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.select(F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(every).alias("n"), "size", "v")
    groups = min(GROUPS, draws)
    tiles = placed.withColumn("tile", F.floor(F.col("start") / TILE)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def look_up(key, table):
        g, n = int(key[1].as_py()), table["n"][0].as_py()
        parts = sorted(zip(table["start"].to_pylist(), table["size"].to_pylist(), table["v"].to_pylist(), strict=True))
        low = parts[0][0]
        x = np.concatenate([np.frombuffer(v, np.float64).reshape(width, size) for _, size, v in parts], axis=1)
        mine = np.arange(g, draws, groups, dtype=np.int32)
        sums = np.zeros((width, len(mine)))
        for i in range(0, n, CHUNK):
            h = hashing.of_long(np.arange(i, min(n, i + CHUNK)))
            for k, b in enumerate(mine):
                at = (hashing.unit_interval(hashing.with_int(hashing.with_int(h, b), seed)) * n).astype(np.int64) - low
                if x.shape[1] < n:
                    at = at[(at >= 0) & (at < x.shape[1])]
                for w in range(width):
                    sums[w, k] += x[w][at].sum()
        return pa.table([pa.array(mine), *(pa.array(s) for s in sums)], names=["b", *(f"_v{i}" for i in range(width))])

    found = tiles.groupBy("tile", "g").applyInArrow(look_up, ", ".join(["b int", *(f"_v{i} double" for i in range(width))]))
    return found.groupBy("b").agg(*(F.sum(f"_v{i}").alias(v) for i, v in enumerate(values)))
