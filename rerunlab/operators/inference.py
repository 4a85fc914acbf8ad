"""Resampling and tests. Randomness is a hash of keys and a seed, so results do not
depend on partitions or retries. Statistics of units are resampled from one row for
each unit, never from runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import normal_quantile, normal_survival_udf, uniform
from . import auroc, resample

PI2 = 2 * math.pi


def gaussian(*keys: Column, seed: int = 0) -> Column:
    """A standard normal number from two hashes (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(F.lit(PI2) * uniform(*keys, seed=seed + 1_000_003))


def _poisson(u: Column) -> Column:
    """Poisson(1) by inversion; past 8 the mass is under 1e-6."""
    total, term, out = 0.0, math.exp(-1), F.lit(8)
    cuts = []
    for k in range(8):
        total += term
        cuts.append((k, total))
        term /= k + 1
    for k, c in reversed(cuts):
        out = F.when(u < c, k).otherwise(out)
    return out


def bootstrap_weights(units: DataFrame, unit: list[str], draws: int, seed: int = 0) -> DataFrame:
    """Every unit with its multiplicity ``m`` in each draw ``b``, where each is Poisson(1):
    no join, and units leave their places for no task."""
    rows = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.withColumn("m", _poisson(uniform(*(F.col(c) for c in unit), F.col("b"), seed=seed))).where("m > 0")


def interval(draws: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """2.5 and 97.5 percentiles, only where more than 20 draws are defined."""
    n = F.count(value)
    return draws.groupBy(*(by or [])).agg(
        n.alias("draws"),
        F.when(n > 20, F.percentile(value, 0.025)).alias("low"),
        F.when(n > 20, F.percentile(value, 0.975)).alias("high"),
        F.when(n > 20, F.percentile(F.abs(F.col(value) - 0.5), 0.95)).alias("bound"),
    )


def bootstrap_within(df: DataFrame, unit: list[str], draws: int = 200, seed: int = 0, exact: bool = True) -> DataFrame:
    """b, auroc: within AUROC of units drawn again. A unit drawn twice is two units."""
    u = auroc.unit_auroc(df, unit).select(*unit, "concordance", (F.col("p") * F.col("n")).alias("pairs"))
    if exact:
        w = resample.drawn_sums(u, unit, ["concordance", "pairs"], draws, seed)
    else:
        w = bootstrap_weights(u, unit, draws, seed).groupBy("b").agg(F.sum(F.col("m") * F.col("concordance")).alias("concordance"), F.sum(F.col("m") * F.col("pairs")).alias("pairs"))
    return w.select("b", auroc.ratio(F.col("concordance"), F.col("pairs")).alias("auroc"))


def bootstrap_icc(units: DataFrame, unit: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """b, icc: the between share of run variance, units drawn again."""
    u = units.select(*unit, F.col("r").alias("R"), F.col("s").alias("S"), (F.col("s") * F.col("s") / F.col("r")).alias("Q"))
    t = resample.drawn_sums(u, unit, ["R", "S", "Q"], draws, seed)
    mu = F.col("S") / F.col("R")
    return t.select("b", auroc.ratio(F.col("Q") / F.col("R") - mu * mu, mu * (1 - mu)).alias("icc"))


def permuted_labels(df: DataFrame, unit: list[str], run: str, draws: int, y: str = "y", seed: int = 0) -> DataFrame:
    """Rows of mixed units for each draw ``b``, labels dealt anew inside each unit."""
    w = Window.partitionBy(*unit)
    rows = df.withColumn("_p", F.sum(y).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where("_p > 0 AND _p < _n")
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = Window.partitionBy(*unit, "b").orderBy(uniform(F.col(run), F.col("b"), seed=seed), run)
    return rows.withColumn(y, (F.row_number().over(order) <= F.col("_p")).cast("int")).drop("_p", "_n")


def permutation_test(df: DataFrame, unit: list[str], run: str, draws: int = 100, seed: int = 0) -> DataFrame:
    """Observed within AUROC, its null's spread, and the two-sided p around one half."""
    null = resample.permuted_within(df, unit, run, draws, seed=seed)
    seen = auroc.within(df, unit).select(F.col("auroc").alias("observed"), "pairs", "mixed_units")
    far = (F.abs(F.col("auroc") - 0.5) >= F.abs(F.col("observed") - 0.5)).cast("int")
    return null.select("auroc").crossJoin(F.broadcast(seen)).groupBy("observed", "pairs", "mixed_units").agg(F.stddev_pop("auroc").alias("null_sd"), ((1 + F.sum(far)) / (draws + 1)).alias("p_value"))


def shuffled_order(df: DataFrame, unit: list[str], run: str, draws: int, seed: int = 0) -> DataFrame:
    """Runs of each unit in another order for each draw: column ``place``."""
    rows = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*unit, "b").orderBy(uniform(F.col(run), F.col("b"), seed=seed), run)))


def autocorrelation_test(df: DataFrame, unit: list[str], run: str, draws: int = 50, seed: int = 0) -> DataFrame:
    """Lag-1 autocorrelation against shuffled orders, two-sided around the null's mean."""
    def lagged(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        x = rows.withColumn("_x", F.col("y") - F.avg("y").over(w)).withColumn("_l", F.lag("_x").over(w.orderBy(order)))
        return x.groupBy(*(k for k in keys if k == "b")).agg(F.try_divide(F.sum(F.col("_x") * F.col("_l")), F.sum(F.col("_x") * F.col("_x"))).alias("r"))

    null = lagged(shuffled_order(df, unit, run, draws, seed), [*unit, "b"], "place")
    centre = null.agg(F.avg("r").alias("centre"))
    seen = lagged(df, unit, run).withColumnRenamed("r", "observed").crossJoin(centre)
    far = (F.abs(F.col("r") - F.col("centre")) >= F.abs(F.col("observed") - F.col("centre"))).cast("int")
    return null.crossJoin(F.broadcast(seen)).groupBy("observed", "centre").agg(((1 + F.sum(far)) / (draws + 1)).alias("p_value"))


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = auroc.mid_rank(df.withColumn("_all", F.lit(0)), c, ["_all"], f"rank_{c}").drop("_all")
    return df


def correlations(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Pearson, Spearman, Spearman given ``z``, and the share of it that ``z`` explains."""
    r = ranks(df, [x, y, z])
    c = r.agg(F.corr(x, y).alias("pearson"), F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"), F.corr(f"rank_{x}", f"rank_{z}").alias("_xz"), F.corr(f"rank_{y}", f"rank_{z}").alias("_yz"))
    partial = F.try_divide(F.col("spearman") - F.col("_xz") * F.col("_yz"), F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz"))))
    return c.select("pearson", "spearman", partial.alias("partial"), F.try_divide(F.col("spearman") - partial, F.col("spearman")).alias("attenuation"))


def one_sample_tests(df: DataFrame, x: str, centre: float = 0.0) -> DataFrame:
    """t, sign z and Wilcoxon signed-rank z of ``x`` against ``centre``, with normal p values."""
    d = df.where(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.lit(centre))
    t = d.agg((F.avg("_d") / (F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)).cast("double")))).alias("t"), F.count(F.lit(1)).alias("n"))
    nz = d.where("_d <> 0").withColumn("_a", F.abs("_d")).withColumn("_all", F.lit(0))
    ranked = auroc.mid_rank(nz, "_a", ["_all"], "_r")
    m = F.count(F.lit(1)).cast("double")
    plus = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(F.lit(0.0)))
    w = ranked.agg(((plus - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24)).alias("wilcoxon_z"), ((F.sum((F.col("_d") > 0).cast("int")) - m / 2) / F.sqrt(m / 4)).alias("sign_z"))
    out = t.crossJoin(w)
    return out.select("n", "t", "sign_z", "wilcoxon_z")


def with_p_values(tests: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        tests = tests.withColumn(f"p_{c}", 2 * normal_survival_udf(F.abs(F.col(c))))
    return tests


def synthetic_scores(df: DataFrame, run: str, target: float, y: str = "y", seed: int = 0, *more: str) -> DataFrame:
    """Scores whose within AUROC is ``target`` in expectation: unit normals, shifted by sqrt(2) Phi^-1(target) for failures."""
    shift = math.sqrt(2) * normal_quantile(target)
    return df.withColumn("s", gaussian(F.col(run), *(F.col(c) for c in more), seed=seed) + shift * F.col(y))


def power(df: DataFrame, unit: list[str], run: str, targets: list[float], draws: int, null_sd: float, seed: int = 0) -> DataFrame:
    """Share of draws whose within AUROC lies over 1.96 null deviations from one half."""
    shifts = [(math.sqrt(2) * normal_quantile(t), seed + i) for i, t in enumerate(targets)]
    drawn = resample.synthetic_within(df, unit, run, shifts, draws)
    named = F.array(*(F.lit(t) for t in targets))[F.col("i")].alias("target")
    return drawn.groupBy(named).agg(F.avg((F.abs(F.col("auroc") - 0.5) > 1.96 * null_sd).cast("double")).alias("power"), F.avg("auroc").alias("achieved")).select("power", "achieved", "target")


def subsample_runs(df: DataFrame, unit: list[str], run: str, r: int, draws: int, seed: int = 0) -> DataFrame:
    """r runs of each unit that has them, without replacement, for each draw ``b``."""
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*unit))).where(F.col("_n") >= r).drop("_n")
    placed = shuffled_order(rows, unit, run, draws, seed)
    return placed.where(F.col("place") <= r).drop("place")


def split_half(df: DataFrame, task: str, model: str, y: str = "y", draws: int = 20, seed: int = 0) -> DataFrame:
    """Capability of each model on two hash-drawn halves of the tasks, correlated over models, for each draw."""
    rows = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    side = uniform(F.col(task), F.col("b"), seed=seed) < 0.5
    m = rows.groupBy("b", model).agg(F.avg(F.when(side, 1 - F.col(y))).alias("first"), F.avg(F.when(~side, 1 - F.col(y))).alias("second"))
    return m.groupBy("b").agg(F.corr("first", "second").alias("r"), F.count(F.lit(1)).alias("models"))


def matched_subsample(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of every group as the smallest has, those that hash lowest."""
    least = df.groupBy(group).count().agg(F.min("count").alias("_least"))
    placed = df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)))
    return placed.crossJoin(F.broadcast(least)).where("_k <= _least").drop("_k", "_least")


def corrupted(df: DataFrame, run: str, rate: float, y: str = "y", seed: int = 0) -> DataFrame:
    """Labels flipped at a rate."""
    return df.withColumn(y, F.when(uniform(F.col(run), seed=seed) < rate, 1 - F.col(y)).otherwise(F.col(y)))


def noise_to_reach(df: DataFrame, unit: list[str], run: str, observed: float, seed: int = 0, rounds: int = 18) -> float:
    """The rate at which labels must be flipped for the within-unit AUROC of ``s`` to fall
    to ``observed``."""
    return -bisected(lambda x: auroc.within(corrupted(df, run, -x, seed=seed), unit).first()["auroc"], observed, -0.5, 0.0, rounds)


def noise_share(observed: Column, target: Column) -> Column:
    """The label noise that would bring ``target`` down to ``observed``."""
    return 1 - F.try_divide(observed - 0.5, target - 0.5)


def bisected(measure, target: float, low: float, high: float, rounds: int = 18) -> float:
    """The number between ``low`` and ``high`` at which ``measure``, which grows with it,
    comes to ``target``. Each round is a query that gives one number."""
    for _ in range(rounds):
        mid = (low + high) / 2
        got = measure(mid)
        low, high = (mid, high) if got is None or got < target else (low, mid)
    return (low + high) / 2


def monitor_scores(df: DataFrame, unit: list[str], run: str, kind: str, strength: float, weight: float = 2.0, spread: float = 0.6, seed: int = 0) -> DataFrame:
    """Synthetic monitors with a separation of ``strength`` between labels in a unit. A: free
    of unit means. B: plus ``weight`` times the unit's failure rate transferred from
    elsewhere (column ``rate``, never the unit's own labels). D: noise that grows with that
    rate, by ``spread`` for each standard deviation over units, at least a fifth; free of unit means."""
    noise, signal = gaussian(F.col(run), seed=seed), F.lit(float(strength)) * (F.col("y") - 0.5)
    if kind == "B":
        return df.withColumn("s", noise + signal + float(weight) * F.coalesce("rate", F.lit(0.5)))
    if kind == "D":
        over = df.groupBy(*unit).agg(F.avg("rate").alias("_r")).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_sd"))
        z = F.coalesce((F.col("rate") - F.col("_m")) / (F.col("_sd") + 1e-9), F.lit(0.0))
        x = df.crossJoin(F.broadcast(over)).withColumn("_x", signal + noise * F.greatest(1 + spread * z, F.lit(0.2))).drop("_m", "_sd")  # one row
    elif kind == "A":
        x = df.withColumn("_x", noise + signal)
    else:
        raise ValueError(f"unknown monitor: {kind}")
    return x.withColumn("s", F.col("_x") - F.avg("_x").over(Window.partitionBy(*unit))).drop("_x")


def separation(df: DataFrame, unit: list[str], run: str, kind: str, target: float, seed: int = 0, rounds: int = 18, **how) -> float:
    """The strength at which a synthetic monitor achieves the within-unit AUROC ``target``."""
    base = math.sqrt(2.0) * normal_quantile(target)
    return bisected(lambda x: auroc.within(monitor_scores(df, unit, run, kind, x, seed=seed, **how), unit).first()["auroc"], target, 0.5 * base, 5 * base, rounds)


def content_permuted(df: DataFrame, unit: list[str], run: str, column: str, seed: int = 0) -> DataFrame:
    """``column`` dealt anew among the runs of each unit."""
    w = Window.partitionBy(*unit)
    a = df.withColumn("_i", F.row_number().over(w.orderBy(run)))
    b = df.select(*unit, F.col(column).alias("_c"), F.row_number().over(w.orderBy(uniform(F.col(run), seed=seed), run)).alias("_i"))
    return a.join(b, [*unit, "_i"]).withColumn(column, F.col("_c")).drop("_i", "_c")


def weighted_slope(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares slope and its standard error from sums."""
    t = df.agg(F.sum(w).alias("W"), F.sum(F.col(w) * F.col(x)).alias("X"), F.sum(F.col(w) * F.col(y)).alias("Y"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("XX"), F.sum(F.col(w) * F.col(x) * F.col(y)).alias("XY"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("YY"), F.count(F.lit(1)).alias("n"))
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("W") for a, b, c in (("XX", "X", "X"), ("XY", "X", "Y"), ("YY", "Y", "Y")))
    slope = F.try_divide(sxy, sxx)
    return t.select(slope.alias("slope"), F.sqrt(F.try_divide((syy - slope * sxy) / (F.col("n") - 2), sxx)).alias("se"))


