"""Trajectories: steps, prefixes, a first-order transition model and what it finds surprising.

A step table has run columns, ``step`` from 1, ``act``, ``obs`` and ``err``. A model is
one set of transition probabilities for each value of ``fold``, fitted on training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INIT, FLOOR, SURPRISING = "<init>", 1e-4, 3.0


def sessions(messages: DataFrame, run: list[str], order: str, is_agent: Column, text: str, error: Column) -> DataFrame:
    """Messages folded into steps: an agent's message opens one, what follows adds to its
    length and sets its error flag, the last one winning. Messages before the first are left out."""
    w = Window.partitionBy(*run).orderBy(order)
    rows = messages.withColumn("_agent", is_agent.cast("int")).withColumn("_error", error).withColumn("step", F.sum("_agent").over(w))
    other = F.col("_agent") == 0
    return rows.where("step > 0").groupBy(*run, "step").agg(
        F.max(F.when(~other, F.col(text))).alias("said"),
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("obs_len"),
        F.coalesce(F.max_by(F.when(other, F.col("_error")), F.when(other, F.col(order))), F.lit(0)).alias("err"),
    )


def prefix_turns(steps: DataFrame, k: int) -> DataFrame:
    return steps.where(F.col("step") <= k)


def prefix_fraction(steps: DataFrame, run: list[str], fraction: float) -> DataFrame:
    """max(1, round half even of n * fraction) steps."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*run))
    last = F.greatest(F.lit(1.0), F.bround(F.col("_n") * F.lit(float(fraction)), 0))
    return steps.withColumn("_n", n).where(F.col("step") <= last).drop("_n")


def prefix_budget(steps: DataFrame, run: list[str], size: str, budget: float) -> DataFrame:
    """Steps up to the one that crosses the budget."""
    w = Window.partitionBy(*run).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0.0))).where(F.col("_before") < budget).drop("_before")


def with_state(steps: DataFrame, run: list[str]) -> DataFrame:
    """The activity before each step."""
    return steps.withColumn("state", F.coalesce(F.lag("act").over(Window.partitionBy(*run).orderBy("step")), F.lit(INIT)))


def transition_model(steps: DataFrame, run: list[str], fold: list[str] | None = None) -> DataFrame:
    """state, act, n, p. An edge seen once is dropped unless it is its state's only one;
    if that leaves a state without edges, all of them stay."""
    fold = fold or []
    n = with_state(steps, run).groupBy(*fold, "state", "act").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*fold, "state")
    marked = n.withColumn("_keep", (F.col("n") >= 2) | (F.count(F.lit(1)).over(w) == 1))
    chosen = marked.withColumn("_any", F.max("_keep").over(w)).where("_keep OR NOT _any")
    return chosen.withColumn("p", F.col("n") / F.sum("n").over(w)).select(*fold, "state", "act", "n", "p")


def surprise(steps: DataFrame, run: list[str], model: DataFrame, fold: list[str] | None = None) -> DataFrame:
    """-ln p of every step; edges the model lacks cost -ln FLOOR. The model has one row
    for each pair of activities: its size is the alphabet's, not the corpus's."""
    fold = fold or []
    joined = with_state(steps, run).join(F.broadcast(model.select(*fold, "state", "act", "p")), [*fold, "state", "act"], "left")
    return joined.withColumn("surprise", -F.log(F.greatest(F.coalesce("p", F.lit(FLOOR)), F.lit(FLOOR)))).drop("p")


def surprise_features(scored: DataFrame, run: list[str]) -> DataFrame:
    """Fourteen scalars of a run."""
    s, x = F.col("step"), F.col("surprise")
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    rows = scored.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*run)))
    g = rows.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("act").alias("unique"),
        F.avg(x).alias("mean_surprise"),
        F.max(x).alias("max_surprise"),
        F.stddev_pop(x).alias("std_surprise"),
        F.avg((x > SURPRISING).cast("double")).alias("share_surprising"),
        F.avg(F.when(s <= half, x)).alias("_first"),
        F.avg(F.when(s > half, x)).alias("_second"),
        F.max_by(x, s).alias("last_surprise"),
        F.min_by(x, s).alias("_start"),
        F.avg("obs").alias("mean_obs"),
        F.max("obs").alias("max_obs"),
        F.avg("err").alias("error_rate"),
        F.sum("err").alias("errors"),
    )
    return g.select(
        *run, "n", "unique", (1 - F.col("unique") / F.col("n")).alias("repetition"), "mean_surprise", "max_surprise", "std_surprise", "share_surprising",
        F.coalesce(F.abs(F.col("_first") - F.col("_second")), F.lit(0.0)).alias("drift"), "last_surprise",
        F.coalesce(F.try_divide(F.col("last_surprise") - F.col("_start"), (F.col("n") - 1).cast("double")), F.lit(0.0)).alias("mean_step"),
        F.exp(-F.col("max_surprise")).alias("least_likely"), "mean_obs", "max_obs", "error_rate", F.col("errors").cast("long").alias("errors"),
    )


def visit_shares(steps: DataFrame, run: list[str]) -> DataFrame:
    """Share of each activity in its run."""
    n = steps.groupBy(*run, "act").agg(F.count(F.lit(1)).alias("_c"))
    return n.withColumn("share", F.col("_c") / F.sum("_c").over(Window.partitionBy(*run))).drop("_c")


def known_shares(shares: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Shares of the activities the alphabet knows; others contribute nothing."""
    return shares.join(F.broadcast(alphabet), "act", "left_semi")


def js_dispersion(shares: DataFrame, unit: list[str], run: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of each two runs of a unit: run_a, run_b, js."""
    packed = shares.groupBy(*unit, *run).agg(F.map_from_entries(F.collect_list(F.struct("act", "share"))).alias("m"))
    key = F.struct(*run)
    a, b = packed.select(*unit, key.alias("run_a"), F.col("m").alias("ma")), packed.select(*unit, key.alias("run_b"), F.col("m").alias("mb"))
    pairs = a.join(b, unit).where("run_a < run_b")
    acts = F.array_union(F.map_keys("ma"), F.map_keys("mb"))

    def part(own: Column, other: Column) -> Column:
        def add(total, act):
            p = F.coalesce(F.try_element_at(own, act), F.lit(0.0))
            q = F.coalesce(F.try_element_at(other, act), F.lit(0.0))
            return total + F.when(p > 0, 0.5 * p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

        return F.aggregate(acts, F.lit(0.0), add)

    return pairs.withColumn("js", F.greatest(part(F.col("ma"), F.col("mb")) + part(F.col("mb"), F.col("ma")), F.lit(0.0))).drop("ma", "mb")


def repeatability(df: DataFrame, unit: list[str], columns: list[str]) -> DataFrame:
    """Between-unit variance of unit means over between plus within, on z-scores; the mean over descriptors of at least two runs a unit."""
    w = Window.partitionBy(*unit)
    whole = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = df.crossJoin(F.broadcast(whole)).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    for c in columns:
        z = z.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)))
    means = z.groupBy(*unit).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns))
    parts = [F.try_divide(F.var_pop(f"m_{c}"), F.var_pop(f"m_{c}") + F.avg(f"v_{c}")).alias(c) for c in columns]
    return means.agg(*parts)


def autocorrelation(df: DataFrame, unit: list[str], order: str, y: str = "y", lag: int = 1) -> DataFrame:
    """Demeaned lag products over demeaned squares, pooled over units."""
    w = Window.partitionBy(*unit)
    x = df.withColumn("_x", F.col(y) - F.avg(y).over(w))
    x = x.withColumn("_b", F.lag("_x", lag).over(w.orderBy(order)))
    return x.agg(F.try_divide(F.sum(F.col("_x") * F.col("_b")), F.sum(F.col("_x") * F.col("_x"))).alias("autocorrelation"), F.count("_b").alias("pairs"))


def runs_test(df: DataFrame, unit: list[str], order: str, y: str = "y") -> DataFrame:
    """Wald-Wolfowitz z of each mixed unit, combined by Stouffer."""
    w = Window.partitionBy(*unit).orderBy(order)
    turn = (F.col(y) != F.lag(y).over(w)).cast("int")
    u = df.withColumn("_t", turn).groupBy(*unit).agg((1 + F.coalesce(F.sum("_t"), F.lit(0))).alias("runs"), F.sum(y).cast("double").alias("a"), F.sum(1 - F.col(y)).cast("double").alias("b")).where("a > 0 AND b > 0")
    n = F.col("a") + F.col("b")
    mean = 2 * F.col("a") * F.col("b") / n + 1
    var = 2 * F.col("a") * F.col("b") * (2 * F.col("a") * F.col("b") - n) / (n * n * (n - 1))
    z = u.withColumn("z", F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)))
    return z.agg((F.sum("z") / F.sqrt(F.count("z").cast("double"))).alias("stouffer"), F.count("z").alias("units"))


def half_difference(df: DataFrame, unit: list[str], order: str, y: str = "y") -> DataFrame:
    """Rate of the first n // 2 runs less that of the others."""
    w = Window.partitionBy(*unit)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    return rows.groupBy(*unit).agg((F.avg(F.when(first, F.col(y))) - F.avg(F.when(~first, F.col(y)))).alias("difference"))


def running_cost(steps: DataFrame, run: list[str], size: str, recorded: Column) -> DataFrame:
    """Running size, scaled so that a run ends at its recorded cost."""
    w = Window.partitionBy(*run)
    upto = w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("cum", F.coalesce(F.try_divide(F.sum(size).over(upto), F.sum(size).over(w)), F.lit(0.0)) * recorded)


def holm(df: DataFrame, p: str = "p", *ties: str) -> DataFrame:
    """Step-down adjusted p values."""
    w = Window.partitionBy(F.lit(0))
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(p, *ties)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    adjusted = F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p))
    return rows.withColumn("adjusted", F.max(adjusted).over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m")
