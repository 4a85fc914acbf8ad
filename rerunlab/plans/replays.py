"""Queries of replayed policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import beta_survival_udf
from ..operators import outcome, predict, replay
from ..operators import relational as rel
from ..registry import register
from .bindings import PART_RUNS, part_runs, rounded, table

TRIALS = 10


def runs(spark, d):
    """All recorded runs: tasks are suppliers by their number's last two digits, one run in
    five succeeds, turns are the quantity, and the score lies between 0 and 1."""
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("cost"), (F.col("l_discount") * 10).alias("s"), F.col("l_quantity").cast("int").alias("steps"), F.col("l_linestatus").alias("status"))
    return l.withColumn("task", F.pmod("supplier", F.lit(100))).withColumn("y", F.when((F.col("unit") + F.col("supplier")) % 5 == 0, 0).otherwise(1))


def transferred(r, weight=0.5):
    """Prior counts from the other outcome table."""
    return outcome.pseudo_counts(r.withColumn("win", (F.col("status") == "F").cast("int")), "task", "win", weight)


def half(spark, d, part):
    return rel.split_half(runs(spark, d), "task", 7).where(F.col("part") == part)


def budgets(b):
    """The cost of one and of three runs of every task."""
    one = float(b.where("index = 0").agg(F.sum("mean_cost")).first()[0])
    return [one, 3 * one]


def summary(rows):
    return rows.groupBy("policy", "budget").agg(F.avg("solved").alias("solved"), F.avg("spent").alias("spent"), F.avg("pulls").alias("pulls"), F.avg("aborted").alias("aborted"), F.count(F.lit(1)).alias("trials"))


def policy_query(name, policies):
    def f(spark, d):
        r = half(spark, d, "eval")
        b = replay.bench(r, transferred(r)).cache()
        return summary(replay.trials(b, spark, policies, budgets(b), TRIALS))

    register(name)(f)


policy_query("b01_round_robin", ["round_robin"])
policy_query("b02_static_ranking", ["static"])
policy_query("b03_thompson", ["cold", "warm"])
policy_query("b04_greedy_oracle", ["greedy", "oracle"])
policy_query("b08_give_up", ["warm", "warm_cost", "give_up"])


@register("b05_abort")
def b05(spark, d):
    """Runs with a score past 0.8 are stopped after turn 5 and charged up to it."""
    b = replay.bench(half(spark, d, "eval")).cache()
    x = budgets(b)
    return summary(replay.trials(b, spark, ["round_robin", "abort"], x, TRIALS, thresholds={("abort", v): 0.8 for v in x}))


@register("b06_hybrid_tuned")
def b06(spark, d):
    """Thresholds chosen on the tuning tasks, used on the others."""
    t, e = half(spark, d, "tune"), half(spark, d, "eval")
    tune, b = replay.bench(t, transferred(t)).cache(), replay.bench(e, transferred(e)).cache()
    x = budgets(b)
    cuts = replay.tuned_thresholds(tune, spark, ["abort", "hybrid"], x, TRIALS)
    return summary(replay.trials(b, spark, ["warm", "abort", "hybrid"], x, TRIALS, thresholds=cuts))


@register("b07_turn_cap")
def b07(spark, d):
    """The cap is the median length of the tuning tasks' successful runs."""
    cap = int(half(spark, d, "tune").where("y = 0").agg(F.percentile_approx("steps", 0.5, 100_000)).first()[0])
    e = half(spark, d, "eval")
    b = replay.bench(e, transferred(e), cap=cap).cache()
    return summary(replay.trials(b, spark, ["round_robin", "capped", "capped_curve", "warm", "warm_capped"], budgets(b), TRIALS, cap=cap))


@register("b09_routed")
def b09(spark, d):
    """Routing on the score of the run drawn, and abort past the calibrated break-even."""
    r = half(spark, d, "eval")
    b = replay.bench(r, transferred(r)).cache()
    return summary(replay.trials(b, spark, ["cold", "routed", "routed_pure", "routed_prior", "fair_abort"], budgets(b), TRIALS, calibration=replay.calibration(r)))


@register("b15_prior_weights")
def b15(spark, d):
    """Thompson sampling on tasks without a history, under priors from difficulty as predicted
    from the task's features and vector by a model of the other tasks, of three weights, beside
    no prior, the transferred one and the true rates."""
    r = runs(spark, d)
    tasks = r.groupBy("task").agg(F.avg(1 - F.col("y")).alias("rate"), F.avg("unit").alias("unit"), F.avg("supplier").alias("supplier"))
    mean = predict.mean_pool(table(spark, d, "embeddings").withColumn("task", F.pmod("vec_id", F.lit(100))), ["task"], "embedding")
    rows = tasks.join(mean, "task").select("task", "rate", "unit", "supplier", "embedding").collect()  # a row a task, as every trial holds
    x = [f"x{i}" for i in range(max((len(r["embedding"]) for r in rows), default=0))]
    tasks = spark.createDataFrame([(r["task"], r["rate"], r["unit"], r["supplier"], *r["embedding"]) for r in rows], ", ".join(["task long", *(f"{c} double" for c in ("rate", "unit", "supplier", *x))]))
    known = rel.split_half(tasks, "task", 7)
    model = predict.ridge(["unit", "supplier", *x], "rate")(known.where("part = 'tune'").drop("part"))
    predicted = model(known.where("part = 'eval'").drop("part")).select("task", "rate", F.least(F.greatest("score", F.lit(0.01)), F.lit(0.99)).alias("q")).cache()
    e, out = half(spark, d, "eval"), None
    priors = {f"predicted {w}": predicted.select("task", (1 + w * F.col("q")).alias("alpha"), (1 + w * (1 - F.col("q"))).alias("beta")) for w in (0.25, 1.0, 4.0)}
    priors |= {"none": None, "transferred": transferred(e, 1.0), "true": predicted.select("task", (1 + 50 * F.col("rate")).alias("alpha"), (1 + 50 * (1 - F.col("rate"))).alias("beta"))}
    numbered = replay.bench(e).cache()
    for name, prior in priors.items():
        b = replay.with_priors(numbered, prior)
        rows = summary(replay.trials(b, spark, ["warm"], budgets(b)[:1], TRIALS)).withColumn("prior", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out




@register("p16_give_up_predicate")
def p16(spark, d):
    """Tasks whose chance of more than a tenth has fallen under one in twenty."""
    t = runs(spark, d).groupBy("task").agg((1 + F.sum(1 - F.col("y"))).cast("double").alias("a"), (1 + F.sum("y")).cast("double").alias("b"))
    return t.withColumn("sf", beta_survival_udf(F.lit(0.1), "a", "b")).withColumn("give_up", F.col("sf") < 0.05)


STORED = "t AS (SELECT CASE status WHEN 'F' THEN 'base' ELSE 'other' END AS policy, unit % 50 AS trial, sum(y) AS solved FROM runs GROUP BY 1, 2)"


@register("b10_paired_interval", f"WITH {PART_RUNS}, {STORED}, x AS (SELECT a.policy, a.solved - b.solved AS d FROM t a JOIN t b ON a.trial = b.trial WHERE a.policy = 'other' AND b.policy = 'base') SELECT policy, round(avg(d), 8) AS difference, round(quantile_cont(d, 0.025), 8) AS low, round(quantile_cont(d, 0.975), 8) AS high, count(*) AS trials FROM x GROUP BY policy")
def b10(spark, d):
    t = part_runs(spark, d).groupBy(F.when(F.col("status") == "F", "base").otherwise("other").alias("policy"), (F.col("unit") % 50).alias("trial")).agg(F.sum("y").alias("solved"))
    return rounded(replay.paired(t, "base", []), 8)


@register(
    "b11_budget_to_reach",
    f"WITH {PART_RUNS}, c AS (SELECT status AS policy, unit % 50 AS trial, unit, sum(cost) AS c, sum(y) AS y FROM runs GROUP BY 1, 2, 3), k AS (SELECT policy, trial, sum(c) OVER w AS spent, sum(y) OVER w AS solved FROM c WINDOW w AS (PARTITION BY policy, trial ORDER BY unit ROWS UNBOUNDED PRECEDING)), f AS (SELECT policy, trial, min(spent) AS first_at FROM k WHERE solved >= 5 GROUP BY policy, trial), o AS (SELECT policy, CASE WHEN count(*) >= 25 THEN avg(first_at) END AS budget, count(*) AS reached FROM f GROUP BY policy) SELECT o.policy, round(o.budget, 2) AS budget, o.reached, round(1 - o.budget / r.budget, 7) AS saving FROM o, o r WHERE r.policy = 'F'",
)
def b11(spark, d):
    from pyspark.sql.window import Window

    c = part_runs(spark, d).groupBy(F.col("status").alias("policy"), (F.col("unit") % 50).alias("trial"), "unit").agg(F.sum("cost").alias("c"), F.sum("y").alias("y"))
    w = Window.partitionBy("policy", "trial").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    curve = c.select("policy", "trial", F.sum("c").over(w).alias("spent"), F.sum("y").over(w).alias("solved"))
    return replay.budget_to_reach(curve, 5, 50, "F").select("policy", F.round("budget", 2).alias("budget"), "reached", F.round("saving", 7).alias("saving"))


@register("b11r_replayed_budget")
def b11r(spark, d):
    r = half(spark, d, "eval")
    b = replay.bench(r, transferred(r)).cache()
    curve = replay.spending_curve(b, ["round_robin", "static", "warm"], budgets(b)[1], TRIALS)
    return replay.budget_to_reach(curve, 2, TRIALS, "round_robin")


@register("b14_crossing_level", f"WITH {PART_RUNS}, l AS (SELECT status AS cell, s AS level, avg(y) - 0.33::DOUBLE AS low FROM runs GROUP BY status, s) SELECT cell, min(CASE WHEN low > 0 THEN level END) AS crossing FROM l GROUP BY cell")
def b14(spark, d):
    levels = part_runs(spark, d).groupBy(F.col("status").alias("cell"), F.col("s").alias("level")).agg((F.avg("y") - 0.33).alias("low"))
    return replay.crossing(levels, ["cell"])
