"""What an outcome table alone tells: ceilings, same-unit weight, null spread, variance
shares. Everything follows from runs r and failures s of each unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import beta_mean_difference_udf
from ..functions.sums import exact_sum
from .auroc import below, pooled, ratio
from .auroc import quantiles as exact_quantiles

D = F.lit


def unit_table(df: DataFrame, unit: list[str], y: str = "y") -> DataFrame:
    """r runs and s failures of each unit."""
    return df.where(F.col(y).isNotNull()).groupBy(*unit).agg(F.count(F.lit(1)).alias("r"), F.sum(F.col(y).cast("long")).alias("s"))


def ceiling(units: DataFrame) -> DataFrame:
    """The AUROC of a score that knows every unit's failure rate and nothing else."""
    rates = units.groupBy(ratio(F.col("s"), F.col("r")).alias("_s")).agg(F.sum("s").alias("p"), F.sum(F.col("r") - F.col("s")).alias("n"))
    return below(rates, []).agg(ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / D(2.0))), F.sum("p") * F.sum("n")).alias("ceiling"))


def gini_ceiling(units: DataFrame) -> DataFrame:
    """Run-weighted mean difference of rates, and 0.5 + MD / (4 mu (1 - mu))."""
    rates = units.groupBy(ratio(F.col("s"), F.col("r")).alias("_s")).agg(F.sum("r").alias("w"), F.sum("s").alias("fails"))
    w = below(below(rates, [], "w", "w_below"), [], "fails", "q_below")
    sums = w.agg(F.sum("w").alias("W"), F.sum("fails").alias("S"), F.sum(F.col("w") * (F.col("_s") * F.col("w_below") - F.col("q_below"))).alias("half"))
    md = 2.0 * F.col("half") / (F.col("W") * F.col("W"))
    mu = F.col("S") / F.col("W")
    return sums.select(md.alias("mean_difference"), (D(0.5) + ratio(md, 4 * mu * (1 - mu))).alias("ceiling_md"))


def same_unit_weight(units: DataFrame) -> DataFrame:
    ok = F.col("r") - F.col("s")
    return units.agg(ratio(F.sum(F.col("s") * ok), F.sum("s") * F.sum(ok)).alias("w"), F.sum(F.col("s") * ok).alias("pairs"))


def leave_one_out(df: DataFrame, unit: list[str], y: str = "y", out: str = "loo") -> DataFrame:
    """Failure rate of a run's other runs; the overall mean where it has none."""
    w = Window.partitionBy(*unit)
    mean = df.agg(F.avg(y).alias("_mean"))
    rows = df.withColumn("_r", F.count(F.lit(1)).over(w)).withColumn("_sum", F.sum(y).over(w))
    one = F.try_divide((F.col("_sum") - F.col(y)).cast("double"), (F.col("_r") - 1).cast("double"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce(one, F.col("_mean"))).drop("_r", "_sum", "_mean")


def leave_one_out_auroc(df: DataFrame, unit: list[str], y: str = "y") -> DataFrame:
    return pooled(leave_one_out(df, unit, y), y=y, score="loo")


def null_sd(units: DataFrame) -> DataFrame:
    """Standard deviation of within AUROC under no signal and no ties, and the smallest
    effect found with 80% power."""
    p, n = F.col("s"), F.col("r") - F.col("s")
    mixed = units.where((p > 0) & (n > 0))
    sd = F.sqrt(F.sum(p * n * (p + n + 1) / D(12.0))) / F.sum(p * n)
    return mixed.agg(sd.alias("null_sd"), (0.5 + 2.80 * sd).alias("mde"), F.sum(p * n).alias("pairs"), F.count(D(1)).alias("mixed_units"))


def null_sd_ties(hist: DataFrame, unit: list[str]) -> DataFrame:
    """The same with the Mann-Whitney tie correction; ``hist``: p and n by unit and score."""
    t = F.col("p") + F.col("n")
    u = hist.groupBy(*unit).agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(t * t * t - t).cast("double").alias("T")).where("P > 0 AND N > 0")
    m = F.col("P") + F.col("N")
    var = F.col("P") * F.col("N") / D(12.0) * (m + 1 - F.col("T") / (m * (m - 1)))
    return u.agg((F.sqrt(F.sum(var)) / F.sum(F.col("P") * F.col("N"))).alias("null_sd"))


def _choose_ratio(k: Column, n: Column, r: int) -> Column:
    """C(k, r) / C(n, r) as a product."""
    out = D(1.0)
    for i in range(r):
        out = out * F.greatest(k - i, D(0)) / (n - i).cast("double")
    return out


def standardised_mixedness(units: DataFrame, r: int = 3) -> DataFrame:
    """Chance that r of a unit's runs, drawn without replacement, show both outcomes."""
    enough = units.where(F.col("r") >= r)
    m = 1.0 - _choose_ratio(F.col("s"), F.col("r"), r) - _choose_ratio(F.col("r") - F.col("s"), F.col("r"), r)
    return enough.agg(F.avg(m).alias("mixedness"), F.count(D(1)).alias("units"))


def raw_mixedness(units: DataFrame) -> DataFrame:
    return units.agg(F.avg(F.when((F.col("s") > 0) & (F.col("s") < F.col("r")), 1.0).otherwise(0.0)).alias("mixed_fraction"))


def icc_naive(units: DataFrame) -> DataFrame:
    """Between-unit share of the variance over runs."""
    t = units.agg(F.sum("r").alias("R"), F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("r")).alias("Q"))
    mu = F.col("S") / F.col("R")
    return t.select(ratio(F.col("Q") / F.col("R") - mu * mu, mu * (1 - mu)).alias("icc"))


def icc_anova(units: DataFrame) -> DataFrame:
    """One-way random-effects ICC for unequal group sizes."""
    t = units.agg(F.count(D(1)).alias("K"), F.sum("r").alias("R"), F.sum("s").alias("S"), F.sum(F.col("r") * F.col("r")).alias("R2"), F.sum(F.col("s") * F.col("s") / F.col("r")).alias("Q"))
    between = F.try_divide(F.col("Q") - F.col("S") * F.col("S") / F.col("R"), (F.col("K") - 1).cast("double"))
    inside = F.try_divide(F.col("S") - F.col("Q"), (F.col("R") - F.col("K")).cast("double"))
    n0 = F.try_divide(F.col("R") - F.col("R2") / F.col("R"), (F.col("K") - 1).cast("double"))
    x = t.select(between.alias("msb"), inside.alias("msw"), n0.alias("n0"))
    return x.select(F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw")).alias("icc"))


def icc_moments(units: DataFrame) -> DataFrame:
    """1 - mean within-unit variance / mu (1 - mu), by unit and by run; units of 2 runs or more."""
    v = F.when(F.col("r") > 1, F.col("s") * (F.col("r") - F.col("s")) / (F.col("r") * (F.col("r") - 1)).cast("double"))
    t = units.agg(F.sum("s").alias("S"), F.sum("r").alias("R"), F.avg(v).alias("vu"), F.sum(v * F.col("r")).alias("vr"), F.sum(F.when(v.isNotNull(), F.col("r"))).alias("rr"))
    mu = F.col("S") / F.col("R")
    return t.select((1 - ratio(F.col("vu"), mu * (1 - mu))).alias("icc_units"), (1 - ratio(F.col("vr") / F.col("rr"), mu * (1 - mu))).alias("icc_runs"))


def shrunk(units: DataFrame) -> DataFrame:
    """Rates drawn to the mean: (s + a) / (r + a + b), a + b from the spread of rates."""
    q = F.col("s") / F.col("r")
    sampling = F.when(F.col("r") > 1, q * (1 - q) / (F.col("r") - 1)).otherwise(D(0.0))
    g = units.agg(F.avg(q).alias("_mu"), F.var_pop(q).alias("_var"), F.avg(sampling).alias("_noise"))
    spread = F.greatest(F.col("_var") - F.col("_noise"), D(1e-6))
    kappa = F.greatest(F.col("_mu") * (1 - F.col("_mu")) / spread - 1, D(1e-3))
    prior = g.select("_mu", kappa.alias("_kappa"))
    return units.crossJoin(F.broadcast(prior)).withColumn("q", (F.col("s") + F.col("_mu") * F.col("_kappa")) / (F.col("r") + F.col("_kappa"))).drop("_mu", "_kappa")


def posterior_weighted(units: DataFrame, per_unit: DataFrame, unit: list[str]) -> DataFrame:
    """Unit AUROCs weighted by 2q(1-q); units without both outcomes count as one half."""
    w = 2 * F.col("q") * (1 - F.col("q"))
    rows = shrunk(units).join(per_unit.select(*unit, "auroc"), unit, "left")
    return rows.agg(ratio(F.sum(w * F.coalesce("auroc", D(0.5))), F.sum(w)).alias("auroc"), F.count(D(1)).alias("units"))


def proper_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    clipped = F.greatest(F.least(F.col(p), D(1 - 1e-6)), D(1e-6))
    loss = -(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))
    return df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(loss).alias("log_loss"))


def finite_r(units: DataFrame) -> DataFrame:
    """Leave-one-out AUROC that the rates and repeats alone predict. A run of a unit with
    rate q and r runs scores k / (r - 1) with k ~ Binomial(r - 1, q); pairs of one unit
    always count against it. Units are counted by (r, s), so the work depends on the
    number of kinds of unit."""
    kinds = units.where("r > 1").groupBy("r", "s").agg(F.count(D(1)).alias("m"))
    q = F.col("s") / F.col("r")
    rows = kinds.withColumn("k", F.explode(F.sequence(D(0), (F.col("r") - 1).cast("int"))))
    n, k = F.col("r") - 1, F.col("k")
    log_choose = F.aggregate(F.sequence(D(1), F.greatest(k, D(1))), D(0.0), lambda a, i: a + F.when(i <= k, F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).otherwise(D(0.0)))
    sure = F.when(q == 0, (k == 0).cast("double")).when(q == 1, (k == n).cast("double"))
    pmf = F.coalesce(sure, F.exp(log_choose + k * F.log(q) + (n - k) * F.log(1 - q)))
    mass = rows.select(F.round(k / n, 10).alias("_s"), (F.col("m") * F.col("s") * pmf).alias("p"), (F.col("m") * (F.col("r") - F.col("s")) * pmf).alias("n"))
    h = below(mass.groupBy("_s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [])
    same = kinds.agg(F.sum(F.col("m") * F.col("s") * (F.col("r") - F.col("s"))).alias("same"))
    t = h.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / D(2.0))).alias("c"), F.sum("p").alias("P"), F.sum("n").alias("N")).crossJoin(same)
    return t.select(ratio(F.col("c") - F.col("same") / D(2.0), F.col("P") * F.col("N")).alias("auroc"))


def operating_curve(df: DataFrame, quantiles: list[float], y: str = "y", score: str = "s", cost: str = "cost") -> DataFrame:
    """Stopping runs that score at or above a quantile of the successes' scores: what is
    kept, successes lost, failures caught and cost saved."""
    edges = exact_quantiles(df.where(F.col(y) == 0), score, quantiles)
    cuts = df.sparkSession.range(1).select(F.array(*(D(e).cast("double") for e in edges)).alias("t"))
    rows = cuts.select(F.explode(F.arrays_zip(F.array(*(D(q) for q in quantiles)).alias("quantile"), F.col("t").alias("threshold"))).alias("z"))
    rows = rows.select(F.col("z").getField("quantile").alias("quantile"), F.col("z").getField("threshold").alias("threshold"))
    stop = F.col(score) >= F.col("threshold")
    out = df.crossJoin(F.broadcast(rows)).groupBy("quantile", "threshold").agg(
        F.avg((~stop).cast("double")).alias("retention"),
        (F.sum((stop & (F.col(y) == 0)).cast("double")) / F.sum(1 - F.col(y))).alias("false_abort"),
        (F.sum((stop & (F.col(y) == 1)).cast("double")) / F.sum(y)).alias("recall"),
        (F.sum(F.when(stop, F.col(cost)).otherwise(D(0.0))) / F.sum(cost)).alias("compute_saved"),
    )
    return out.select("quantile", *(F.round(c, 9).alias(c) for c in ("threshold", "retention", "false_abort", "recall")), F.round("compute_saved", 6).alias("compute_saved"))


def priority(df: DataFrame, task: str = "task", y: str = "y", cost: str = "cost") -> DataFrame:
    """Tasks ranked by smoothed success rate for their mean cost; ties by task. Costs are summed
    exactly: else equal means differ in their last bits, and with them the order."""
    t = df.groupBy(task).agg(F.try_divide(exact_sum(F.col(cost)), F.count(cost).cast("double")).alias("mean_cost"), ((F.sum(1 - F.col(y)) + 0.5) / (F.count(D(1)) + 1)).alias("rate"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(D(0)).orderBy(F.desc(F.col("rate") / F.col("mean_cost")), task)))


def beta_moments(units: DataFrame) -> DataFrame:
    """Beta(a, b) with the mean and variance of the units' success rates."""
    rate = 1 - F.col("s") / F.col("r")
    m = units.agg(F.avg(rate).alias("m1"), F.var_pop(rate).alias("v"))
    size = F.greatest(F.try_divide(F.col("m1") * (1 - F.col("m1")), F.col("v")) - 1, D(1e-3))
    return m.select("m1", "v", (F.col("m1") * size).alias("alpha"), ((1 - F.col("m1")) * size).alias("beta"))


def beta_ceiling(fit: DataFrame) -> DataFrame:
    """``beta_moments`` with the difficulty-only ceiling 0.5 + MD / (4 m (1 - m)) of the fitted Beta."""
    md = beta_mean_difference_udf("alpha", "beta")
    return fit.withColumn("ceiling", D(0.5) + F.try_divide(md, 4 * F.col("m1") * (1 - F.col("m1"))))


def pseudo_counts(df: DataFrame, task: str, success: str, weight: float) -> DataFrame:
    """Beta pseudo-counts of each task from another table's runs."""
    return df.groupBy(task).agg((1 + weight * F.sum(success)).alias("alpha"), (1 + weight * (F.count(D(1)) - F.sum(success))).alias("beta"))


def decile_calibration(df: DataFrame, score: str, y: str, least: int = 20) -> DataFrame:
    """Failure rate by decile of the score; the base rate where a bin has few runs."""
    cuts = exact_quantiles(df, score, [i / 10 for i in range(1, 10)])
    edges = df.agg(F.avg(y).alias("_base")).withColumn("_e", F.array(*(D(c).cast("double") for c in cuts)))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col(score))))
    return rows.groupBy("bin").agg(F.count(D(1)).alias("n"), F.when(F.count(D(1)) >= least, F.avg(y)).otherwise(F.max("_base")).alias("rate"))


def apply_null_policy(df: DataFrame, y: str, policy: str) -> DataFrame:
    """``drop`` leaves out runs without an outcome, ``fail`` counts them as failures."""
    if policy not in ("drop", "fail"):
        raise ValueError(f"unknown null policy: {policy}")
    out = df.where(F.col(y).isNotNull()) if policy == "drop" else df.withColumn(y, F.coalesce(F.col(y), D(1)))
    return out.withColumn("policy", D(policy))
