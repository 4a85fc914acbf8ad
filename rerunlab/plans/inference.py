"""Queries of resampling and tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import auroc, outcome
from ..operators import inference as inf
from ..registry import register
from .bindings import ORDER_RUNS, PART_RUNS, order_runs, part_runs, rounded


@register("i01_unit_bootstrap")
def i01(spark, d):
    return inf.interval(inf.bootstrap_within(order_runs(spark, d), ["unit"], 200), "auroc")


@register("i02_model_bootstrap")
def i02(spark, d):
    """Units are the cells of model and task; whole tasks are drawn."""
    runs = order_runs(spark, d)
    u = auroc.unit_auroc(runs, ["unit", "model"]).groupBy("unit").agg(F.sum("concordance").alias("c"), F.sum(F.col("p") * F.col("n")).alias("pairs"))
    w = inf.bootstrap_weights(u, ["unit"], 200)
    draws = w.groupBy("b").agg(auroc.ratio(F.sum(F.col("m") * F.col("c")), F.sum(F.col("m") * F.col("pairs"))).alias("auroc"))
    return inf.interval(draws, "auroc")


@register("i03_icc_bootstrap")
def i03(spark, d):
    units = outcome.unit_table(order_runs(spark, d), ["unit"])
    return inf.interval(inf.bootstrap_icc(units, ["unit"], 200), "icc").drop("bound")


@register("i04_permutation_test")
def i04(spark, d):
    return inf.permutation_test(order_runs(spark, d), ["unit"], "run", 50)


@register("i05_fold_permutation_test")
def i05(spark, d):
    runs = order_runs(spark, d).withColumn("fold", F.col("unit") % 5)
    return inf.permutation_test(runs, ["fold", "unit"], "run", 50, seed=3)


@register("i06_order_permutation")
def i06(spark, d):
    return inf.autocorrelation_test(order_runs(spark, d), ["unit"], "run", 30)


@register("i07_capability_permutation")
def i07(spark, d):
    """Spearman of capability and within AUROC over models, models' labels dealt anew."""
    runs = order_runs(spark, d).withColumn("model", F.concat_ws("-", "model", (F.col("unit") % 4).cast("string")))
    m = runs.groupBy("model").agg(F.avg(1 - F.col("y")).alias("capability")).join(auroc.pooled(runs, ["model"]).select("model", "auroc"), "model")
    r = inf.ranks(m, ["capability", "auroc"]).withColumn("all", F.lit(0))
    seen = r.agg(F.corr("rank_capability", "rank_auroc").alias("observed"))
    shuffled = inf.content_permuted(inf.shuffled_order(r, ["all"], "model", 100).drop("place"), ["all", "b"], "model", "rank_auroc", 5)
    null = shuffled.groupBy("b").agg(F.corr("rank_capability", "rank_auroc").alias("r"))
    return null.crossJoin(seen).groupBy("observed").agg(((1 + F.sum((F.abs("r") >= F.abs("observed")).cast("int"))) / 101).alias("p_value"))


@register("i08_holm_cells", f"WITH {ORDER_RUNS}, p AS (SELECT unit % 12 AS cell, avg(y) / 20 AS p FROM runs GROUP BY unit % 12), i AS (SELECT *, row_number() OVER (ORDER BY p, cell) - 1 AS i, count(*) OVER () AS m FROM p) SELECT cell, round(p, 9) AS p, round(max(least(1.0::DOUBLE, (m - i) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM i")
def i08(spark, d):
    from ..operators.steps import holm

    p = order_runs(spark, d).groupBy((F.col("unit") % 12).alias("cell")).agg((F.avg("y") / 20).alias("p"))
    return rounded(holm(p, "p", "cell"))


@register("i09_power")
def i09(spark, d):
    """Detection rate by target; the null deviation is the closed form's."""
    runs = order_runs(spark, d)
    sd = outcome.null_sd(outcome.unit_table(runs, ["unit"])).first()["null_sd"]
    return inf.power(runs, ["unit"], "run", [0.5, 0.55, 0.6, 0.7], 2000, sd)


@register("i10_equivalence_bound")
def i10(spark, d):
    return inf.interval(inf.bootstrap_within(order_runs(spark, d), ["unit"], 200, seed=11), "auroc").select("draws", "bound")


@register("i12_repeat_drift")
def i12(spark, d):
    """Within AUROC when every unit keeps r runs."""
    runs, out = order_runs(spark, d), None
    for r in (2, 3, 5):
        rows = inf.resample.subsampled_within(runs, ["unit"], "run", r, 10, seed=r).agg(F.avg("auroc").alias("auroc"), F.avg("mixed_units").alias("mixed_units")).withColumn("r", F.lit(r))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "i13_correlations",
    f"""WITH {PART_RUNS}, m AS (SELECT unit, avg(y) AS x, avg(s) AS y, avg(cost) AS z FROM runs GROUP BY unit), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rz FROM (SELECT unit, round(x, 9) AS x, round(y, 9) AS y, round(z, 5) AS z FROM m)),
    c AS (SELECT corr(x, y) AS p, corr(rx, ry) AS s, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r), q AS (SELECT *, (s - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS pa FROM c) SELECT round(p, 7) AS pearson, round(s, 7) AS spearman, round(pa, 7) AS partial, round((s - pa) / s, 4) AS attenuation FROM q""",
)
def i13(spark, d):
    m = part_runs(spark, d).groupBy("unit").agg(F.round(F.avg("y"), 9).alias("x"), F.round(F.avg("s"), 9).alias("y"), F.round(F.avg("cost"), 5).alias("z"))
    c = inf.correlations(m, "x", "y", "z")
    return c.select(*(F.round(n, 7).alias(n) for n in ("pearson", "spearman", "partial")), F.round("attenuation", 4).alias("attenuation"))


@register(
    "i14_one_sample_tests",
    f"""WITH {ORDER_RUNS}, x AS (SELECT round(avg(y) - 0.45::DOUBLE, 9) AS d FROM runs GROUP BY unit), t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) AS n FROM x),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM x WHERE d <> 0), w AS (SELECT (sum(CASE WHEN d > 0 THEN rk ELSE 0 END) - count(*) * (count(*) + 1) / 4.0::DOUBLE) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0::DOUBLE) AS wz, (sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) - count(*) / 2.0::DOUBLE) / sqrt(count(*) / 4.0::DOUBLE) AS sz FROM r)
    SELECT n, round(t, 7) AS t, round(sz, 7) AS sign_z, round(wz, 7) AS wilcoxon_z FROM t, w""",
)
def i14(spark, d):
    u = order_runs(spark, d).groupBy("unit").agg(F.round(F.avg("y") - 0.45, 9).alias("d"))
    return rounded(inf.one_sample_tests(u, "d"), 7)


@register("i14p_p_values")
def i14p(spark, d):
    u = order_runs(spark, d).groupBy("unit").agg((F.avg("y") - 0.45).alias("d"))
    return inf.with_p_values(inf.one_sample_tests(u, "d"), ["t", "sign_z", "wilcoxon_z"])


@register("i15_split_half")
def i15(spark, d):
    return inf.split_half(order_runs(spark, d), "unit", "model")


@register("i16_matched_subsample", f"WITH {ORDER_RUNS}, c AS (SELECT model, count(*) AS n FROM runs GROUP BY model) SELECT model, (SELECT min(n) FROM c) AS runs FROM c")
def i16(spark, d):
    return inf.matched_subsample(order_runs(spark, d), "model", "run").groupBy("model").agg(F.count(F.lit(1)).alias("runs"))


@register("i17_noise_share", f"WITH {ORDER_RUNS}, m AS (SELECT model, avg(y) AS q FROM runs GROUP BY model) SELECT model, round(1 - (q - 0.5::DOUBLE) / (0.7::DOUBLE - 0.5::DOUBLE), 8) AS alpha FROM m")
def i17(spark, d):
    m = order_runs(spark, d).groupBy("model").agg(F.avg("y").alias("q"))
    return rounded(m.select("model", inf.noise_share(F.col("q"), F.lit(0.7)).alias("alpha")), 8)


@register("i17c_corrupted_labels")
def i17c(spark, d):
    """A perfect score against labels flipped at four rates."""
    runs, out = order_runs(spark, d).withColumn("s", F.col("y").cast("double")), None
    for rate in (0.0, 0.1, 0.2, 0.4):
        a = auroc.within(inf.corrupted(runs, "run", rate), ["unit"]).withColumn("rate", F.lit(rate))
        out = a if out is None else out.unionByName(a)
    return out


@register("i17b_noise_to_reach")
def i17b(spark, d):
    """The label noise that would bring monitors of three true strengths down to 0.53."""
    runs, out = inf.resample.together(order_runs(spark, d), ["unit"]).cache(), []  # no round moves a run
    for true in (0.55, 0.6, 0.7):
        m = inf.monitor_scores(runs, ["unit"], "run", "A", inf.separation(runs, ["unit"], "run", "A", true, rounds=8), seed=0)
        out.append((true, inf.noise_to_reach(m, ["unit"], "run", 0.53, rounds=8)))
    return spark.createDataFrame(out, "target double, noise double")


@register("i18_synthetic_monitors")
def i18(spark, d):
    """What three monitor families achieve at a target of 0.7; difficulty is the failure rate
    of other models' runs of the unit."""
    runs = inf.resample.together(order_runs(spark, d), ["unit"])  # no round moves a run
    own = Window.partitionBy("unit", "model")
    whole = Window.partitionBy("unit")
    others = F.try_divide((F.sum("y").over(whole) - F.sum("y").over(own)).cast("double"), F.count("y").over(whole) - F.count("y").over(own))
    runs, out = runs.withColumn("rate", others).cache(), None
    for kind in "ABD":
        strength = inf.separation(runs, ["unit"], "run", kind, 0.7, seed=ord(kind), rounds=10)
        m = inf.monitor_scores(runs, ["unit"], "run", kind, strength, seed=ord(kind))
        a = auroc.decomposition(m, ["unit"]).withColumn("family", F.lit(kind)).withColumn("strength", F.lit(strength))
        out = a if out is None else out.unionByName(a)
    return out


@register("i19_content_permuted")
def i19(spark, d):
    """A label-as-score monitor before and after its scores are dealt anew in each unit."""
    runs = order_runs(spark, d).withColumn("s", F.col("y").cast("double"))
    a = auroc.within(runs, ["unit"]).withColumn("content", F.lit("own"))
    return a.unionByName(auroc.within(inf.content_permuted(runs, ["unit"], "run", "s"), ["unit"]).withColumn("content", F.lit("permuted")))


@register("e12_weighted_slope", f"WITH {PART_RUNS}, m AS (SELECT supplier, avg(s) AS x, avg(y) AS y, count(*)::DOUBLE AS w FROM runs GROUP BY supplier), t AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM m), u AS (SELECT sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) ** 2) AS syy, any_value(n) AS n FROM m, t) SELECT round(sxy / sxx, 6) AS slope, round(sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx), 6) AS se FROM u")
def e12(spark, d):
    m = part_runs(spark, d).groupBy("supplier").agg(F.avg("s").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    return rounded(inf.weighted_slope(m, "x", "y", "w"), 6)
