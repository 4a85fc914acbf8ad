"""Ranking metrics over repeated runs: pooled and within-unit AUROC and what splits them.

A run has a unit, a label (1: failure) and a score. Every metric works on a histogram
of (unit, score), combined before the shuffle; pairs are never made. Ties count one
half. A metric without a pair is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Estimated bytes up to which a running sum is simply sorted; past it rows are counted.
SMALL = 32 << 20
#: Above so many distinct scores, over all or in one group, a running sum is cut into ranges.
ONE_TASK = 2_000_000
RANGES = 256


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mid_rank(df: DataFrame, score: str, by: list[str], out: str = "mid_rank") -> DataFrame:
    """Average rank of each row among the rows of its group."""
    ordered = Window.partitionBy(*by).orderBy(score)
    tied = Window.partitionBy(*by, score)
    return df.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0))


def quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours. Past ONE_TASK values only those near
    each quantile (a RANGES-th of all on both sides) are sorted, after those below were counted;
    all are where an estimate misses its place."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    n = rows.count()
    if not n:
        return [None] * len(qs)
    near: list[tuple] = [(None, None)] * len(qs)
    if n > ONE_TASK:
        wide = [x for q in qs for x in (max(0.0, q - 1 / RANGES), min(1.0, q + 1 / RANGES))]
        e = rows.agg(F.percentile_approx("_v", F.array(*(F.lit(x) for x in wide)), 10_000)).first()[0]
        near = [(e[2 * i] if wide[2 * i] > 0 else None, e[2 * i + 1] if wide[2 * i + 1] < 1 else None) for i in range(len(qs))]
    below = rows.agg(*(F.lit(0) if low is None else F.sum((F.col("_v") < low).cast("long")) for low, _ in near)).first()
    out = []
    for q, (low, high), start in zip(qs, near, below, strict=True):
        at = q * (n - 1)
        places = sorted({math.floor(at), math.ceil(at)})
        found = _in_places(rows, places, low, high, start)
        if len(found) < len(places):
            found = _in_places(rows, places, None, None, 0)
        a, b = found[places[0]], found[places[-1]]
        out.append(float(a) if a == b else (places[1] - at) * a + (at - places[0]) * b)
    return out


def _in_places(rows: DataFrame, places: list[int], low, high, start: int) -> dict[int, float]:
    """Values at ``places`` of the sorted rows, of which ``start`` lie below ``low``."""
    part = rows if low is None else rows.where(F.col("_v") >= low)
    part = part if high is None else part.where(F.col("_v") <= high)
    upto = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = part.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", upto + start)
    hit = counts.withColumn("_i", F.explode(F.array(*(F.lit(i) for i in places)))).where("_i < _upto AND _i >= _upto - _n")
    return {r["_i"]: r["_v"] for r in hit.collect()}


def histogram(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Positives ``p`` and negatives ``n`` for each group and score."""
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n")
    )


def below(hist: DataFrame, by: list[str], value: str = "n", out: str = "below") -> DataFrame:
    """Exclusive running sum of ``value`` over scores in each group, or over all scores.

    Small inputs are sorted in place. In large ones, groups with over ONE_TASK scores (or
    the whole, without groups) are cut into RANGES by their own quantiles: each range is
    summed by itself and starts from the totals of those before it. The groups found to
    be that large, and their cuts, stay in the plan; nothing comes to the driver."""
    if estimated_bytes(hist) <= SMALL:
        return _sorted_sum(hist, by, value, out)
    keys = by or ["_all"]
    rows = hist if by else hist.withColumn("_all", F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > ONE_TASK).select(*keys)
    wanted = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = rows.join(sizes, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_s", wanted, 10_000).alias("_cuts"))
    ranged = rows.join(cuts, keys, "left").withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_s"))), F.lit(-1)))
    local = _sorted_sum(ranged, [*keys, "_range"], value, out)
    totals = ranged.where("_range >= 0").groupBy(*keys, "_range").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    done = local.join(starts, [*keys, "_range"], "left").withColumn(out, F.col(out) + F.coalesce("_start", F.lit(0)))
    return done.select(*hist.columns, out)


def _sorted_sum(hist: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn(out, F.coalesce(F.sum(value).over(over), F.lit(0)))


def hot_cuts(df: DataFrame, by: list[str], y: str, score: str) -> list[tuple]:
    """Groups with about ONE_TASK distinct scores and more, with the edges of RANGES ranges of
    each: at most rows / ONE_TASK groups of RANGES numbers come to the driver. Rows are
    counted first, which moves one number for each group; mostly no group is left."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    n = F.count(F.lit(1))
    large = rows.groupBy(*by).agg(n.alias("_n")).where(F.col("_n") > ONE_TASK).select(*by).collect()
    if not large:
        return []
    found = rows
    if by:
        match = [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]
        keys = df.sparkSession.createDataFrame([tuple(r) for r in large], df.select(*by).schema).select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)))
        found = rows.join(F.broadcast(keys), match, "left_semi")
    wanted = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cut = found.groupBy(*by).agg(F.percentile_approx(score, wanted, 10_000).alias("_cuts"), F.approx_count_distinct(score, 0.02).alias("_d"))
    return [tuple(r)[:-1] for r in cut.where(F.col("_d") > 0.9 * ONE_TASK).collect()]


def _concordance(hist: DataFrame, by: list[str], hot: list[tuple]) -> DataFrame:
    """For each group of a histogram: p, n, concordance. Ranges of the groups in ``hot`` are
    summed apart, then every range adds its positives times the negatives of those before."""
    above = F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0)))
    if not hot:
        return _sorted_sum(hist, by, "n", "below").groupBy(*by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), above.alias("concordance"))
    at = F.size(F.filter("_cuts", lambda c: c <= F.col("_s")))
    if by:
        schema = T.StructType([*(T.StructField(f"_k{i}", hist.schema[b].dataType) for i, b in enumerate(by)), T.StructField("_cuts", T.ArrayType(hist.schema["_s"].dataType))])
        cuts = hist.sparkSession.createDataFrame(hot, schema)
        ranged = hist.join(F.broadcast(cuts), [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], "left").withColumn("_range", F.coalesce(at, F.lit(-1))).drop("_cuts", *(f"_k{i}" for i in range(len(by))))
    else:
        ranged = hist.withColumn("_cuts", F.array(*(F.lit(c) for c in hot[0][0])).cast(T.ArrayType(hist.schema["_s"].dataType))).withColumn("_range", at).drop("_cuts")
    keys = [*by, "_range"]
    local = _sorted_sum(ranged, keys, "n", "below").groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), above.alias("c"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    started = local.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return started.groupBy(*by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("c") + F.col("p") * F.col("_start")).alias("concordance"))


def _cuts_where_large(hist: DataFrame, df: DataFrame, by: list[str], y: str, score: str) -> list[tuple]:
    return [] if estimated_bytes(hist) <= SMALL else hot_cuts(df, by, y, score)


def pair_sums(df: DataFrame, by: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """For each group: positives p, negatives n, concordance (ties half) as double."""
    hist = histogram(df, by, y, score)
    return _concordance(hist, by, _cuts_where_large(hist, df, by, y, score))


def pooled(df: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "s") -> DataFrame:
    """Pooled AUROC over all runs, or over those of each value of ``by``."""
    by = by or []
    sums = pair_sums(df, by, y, score)
    return sums.select(*by, ratio(F.col("concordance"), F.col("p") * F.col("n")).alias("auroc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def pooled_by_rank(df: DataFrame, y: str = "y", score: str = "s") -> DataFrame:
    """Pooled AUROC from average ranks: (R - P (P + 1) / 2) / (P N) with R the sum of the
    positives' ranks among all runs. The ranks follow from how many runs have each score."""
    h = histogram(df, [], y, score).withColumn("both", F.col("p") + F.col("n"))
    ranked = below(h, [], "both").withColumn("rank", F.col("below") + (F.col("both") + 1) / F.lit(2.0))
    sums = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(ratio(F.col("r") - p * (p + 1) / F.lit(2.0), p * n).alias("auroc"), "positives", "negatives")


def pooled_sampled(df: DataFrame, pairs: int, key: str, y: str = "y", score: str = "s", seed: int = 0) -> DataFrame:
    """Pooled AUROC over about ``pairs`` random pairs: positives and negatives meet where
    their hashes fall into one of so many buckets that this many pairs do. The exact
    form costs less; this one exists for comparison with sampled figures."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    p, n = rows.agg(F.sum(F.col(y).cast("long")), F.sum(1 - F.col(y).cast("long"))).first()
    buckets = max(1, (p or 0) * (n or 0) // max(1, pairs))
    b = F.pmod(F.xxhash64(F.col(key), F.col(y), F.lit(seed)), F.lit(buckets))
    a = rows.where(F.col(y) == 1).select(b.alias("_b"), F.col(score).alias("_p"))
    o = rows.where(F.col(y) == 0).select(b.alias("_b"), F.col(score).alias("_n"))
    hit = F.when(F.col("_p") > F.col("_n"), 1.0).when(F.col("_p") == F.col("_n"), 0.5).otherwise(0.0)
    return a.join(o, "_b").agg(F.avg(hit).alias("auroc"), F.count(F.lit(1)).alias("pairs"))


def unit_auroc(df: DataFrame, unit: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """p, n, concordance and AUROC of every unit that has both labels."""
    return pair_sums(df, unit, y, score).where("p > 0 AND n > 0").withColumn("auroc", ratio(F.col("concordance"), F.col("p") * F.col("n")))


def within(df: DataFrame, unit: list[str], by: list[str] | None = None, y: str = "y", score: str = "s") -> DataFrame:
    """Pair-weighted within-unit AUROC, its pairs and its mixed units."""
    by = by or []
    u = unit_auroc(df, [*by, *unit], y, score)
    return u.groupBy(*by).agg(
        ratio(F.sum("concordance"), F.sum(F.col("p") * F.col("n"))).alias("auroc"),
        F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).alias("pairs"),
        F.count(F.lit(1)).alias("mixed_units"),
    )


def within_macro(df: DataFrame, unit: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """Every mixed unit counts alike."""
    return unit_auroc(df, unit, y, score).agg(F.avg("auroc").alias("auroc"), F.count(F.lit(1)).alias("mixed_units"))


def within_deployment(df: DataFrame, unit: list[str], task: str, y: str = "y", score: str = "s") -> DataFrame:
    """Mean over a task's units, then over tasks."""
    tasks = unit_auroc(df, unit, y, score).groupBy(task).agg(F.avg("auroc").alias("a"))
    return tasks.agg(F.avg("a").alias("auroc"), F.count(F.lit(1)).alias("tasks"))


def decomposition(df: DataFrame, unit: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """A_pool = w * A_within + (1 - w) * A_cross, from histograms by score and by unit and score."""
    total = pair_sums(df, [], y, score).select(F.col("p").alias("P"), F.col("n").alias("N"), F.col("concordance").alias("C"))
    inner = pair_sums(df, unit, y, score).withColumnRenamed("concordance", "c")
    inside = inner.agg(F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).alias("n_within"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("c_within"))
    pairs, w = F.col("P") * F.col("N"), F.col("n_within")
    return total.crossJoin(inside).select(  # two single rows
        ratio(F.col("C"), pairs).alias("a_pool"),
        ratio(F.col("c_within"), w).alias("a_within"),
        ratio(F.col("C") - F.col("c_within"), pairs - w).alias("a_cross"),
        ratio(w, pairs).alias("w"),
        w.cast("long").alias("n_within"),
        (pairs - w).cast("long").alias("n_cross"),
    )


def demeaned(df: DataFrame, unit: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """Scores less their unit's mean, mixed units alone, pooled. Differences are rounded
    at 1e-9 so that equal ones tie."""
    w = Window.partitionBy(*unit)
    mixed = df.withColumn("_lo", F.min(y).over(w)).withColumn("_hi", F.max(y).over(w)).where("_lo < _hi")
    return pooled(mixed.withColumn("_d", F.round(F.col(score) - F.avg(score).over(w), 9)), y=y, score="_d")


def concordance_continuous(df: DataFrame, unit: list[str], outcome: str, score: str = "s") -> DataFrame:
    """Over ordered pairs of a unit with outcome_i > outcome_j: how often the first has
    the smaller score (a score predicts failure). Units hold few runs by design."""
    a = df.select(*unit, F.col(outcome).alias("_oa"), F.col(score).alias("_sa"))
    b = df.select(*unit, F.col(outcome).alias("_ob"), F.col(score).alias("_sb"))
    pairs = a.join(b, unit).where("_oa > _ob")
    hit = F.when(F.col("_sa") < F.col("_sb"), 1.0).when(F.col("_sa") == F.col("_sb"), 0.5).otherwise(0.0)
    return pairs.agg(F.avg(hit).alias("concordance"), F.count(F.lit(1)).alias("pairs"))


def fold_aggregate(df: DataFrame, fold: str, unit: list[str], y: str = "y", score: str = "s") -> DataFrame:
    """Numerators and denominators summed over folds and divided once; pooled AUROC by
    fold with mean and sample deviation."""
    w = within(df, [fold, *unit], None, y, score).select(F.col("auroc").alias("within"), "pairs", "mixed_units")
    p = pooled(df, [fold], y, score).agg(F.avg("auroc").alias("pooled_mean"), F.stddev_samp("auroc").alias("pooled_sd"), F.count(F.lit(1)).alias("folds"))
    return w.crossJoin(p)
