"""Queries of the outcome-table family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import auroc, outcome
from ..registry import register
from .bindings import ORDER_RUNS, PART_RUNS, order_runs, part_runs, rounded, table

UNITS = "units AS (SELECT unit, count(*) AS r, CAST(sum(y) AS BIGINT) AS s FROM runs GROUP BY unit)"
O = f"WITH {ORDER_RUNS}, {UNITS}"


def units(spark, d):
    return outcome.unit_table(order_runs(spark, d), ["unit"])


@register("a01_unit_table", f"{O} SELECT * FROM units")
def a01(spark, d):
    return units(spark, d)


@register("a12_difficulty_ceiling", f"{O}, q AS (SELECT s / r::DOUBLE AS q, sum(s) AS p, sum(r - s) AS n FROM units GROUP BY 1) SELECT round(sum(CASE WHEN a.q > b.q THEN a.p * b.n WHEN a.q = b.q THEN 0.5::DOUBLE * a.p * b.n ELSE 0 END)::DOUBLE / sum(a.p * b.n)::DOUBLE, 9) AS ceiling FROM q a, q b")
def a12(spark, d):
    return rounded(outcome.ceiling(units(spark, d)))


@register(
    "a13_gini_ceiling",
    f"{O}, q AS (SELECT s / r::DOUBLE AS q, sum(r)::DOUBLE AS w FROM units GROUP BY 1), m AS (SELECT sum(a.w * b.w * abs(a.q - b.q)) / sum(a.w * b.w) AS md FROM q a, q b), u AS (SELECT sum(s)::DOUBLE / sum(r) AS mu FROM units) SELECT round(md, 9) AS mean_difference, round(0.5::DOUBLE + md / (4 * mu * (1 - mu)), 9) AS ceiling_md FROM m, u",
)
def a13(spark, d):
    return rounded(outcome.gini_ceiling(units(spark, d)))


@register("a14_same_unit_weight", f"{O} SELECT round(sum(s * (r - s))::DOUBLE / (sum(s) * sum(r - s))::DOUBLE, 9) AS w, CAST(sum(s * (r - s)) AS BIGINT) AS pairs FROM units")
def a14(spark, d):
    return rounded(outcome.same_unit_weight(units(spark, d)))


LOO = "loo AS (SELECT run, y, CASE WHEN count(*) OVER w > 1 THEN (sum(y) OVER w - y)::DOUBLE / (count(*) OVER w - 1) ELSE (SELECT avg(y) FROM runs) END AS s FROM runs WINDOW w AS (PARTITION BY unit))"


@register("a15_leave_one_out", f"WITH {ORDER_RUNS}, {LOO} SELECT run, round(s, 9) AS loo FROM loo")
def a15(spark, d):
    return rounded(outcome.leave_one_out(order_runs(spark, d), ["unit"]).select("run", "loo"))


@register("a16_leave_one_out_auroc", f"WITH {ORDER_RUNS}, {LOO}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM loo) SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 9) AS auroc, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM k")
def a16(spark, d):
    return rounded(outcome.leave_one_out_auroc(order_runs(spark, d), ["unit"]))


@register(
    "a17_finite_r_loo",
    f"""{O}, kd AS (SELECT r, s, count(*)::DOUBLE AS m FROM units WHERE r > 1 GROUP BY r, s), g AS (SELECT kd.*, k.k FROM kd, (SELECT unnest(range(0, 200)) AS k) k WHERE k.k <= r - 1),
    p AS (SELECT *, CASE WHEN s = 0 THEN (k = 0)::INT::DOUBLE WHEN s = r THEN (k = r - 1)::INT::DOUBLE ELSE exp(lgamma(r) - lgamma(k + 1) - lgamma(r - k) + k * ln(s / r::DOUBLE) + (r - 1 - k) * ln(1 - s / r::DOUBLE)) END AS f FROM g),
    h AS (SELECT round(k / (r - 1)::DOUBLE, 10) AS x, sum(m * s * f) AS p, sum(m * (r - s) * f) AS n FROM p GROUP BY 1),
    b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h), t AS (SELECT sum(p * (below + n / 2)) AS c, sum(p) AS pp, sum(n) AS nn FROM b), sm AS (SELECT sum(m * s * (r - s)) AS same FROM kd)
    SELECT round((c - same / 2) / (pp * nn), 8) AS auroc FROM t, sm""",
)
def a17(spark, d):
    """Predicted leave-one-out AUROC from the units' rates and repeats."""
    return rounded(outcome.finite_r(units(spark, d)), 8)


NULL = "SELECT round(sqrt(sum(s * (r - s) * (r + 1) / 12.0::DOUBLE)) / sum(s * (r - s)), 9) AS null_sd, round(0.5::DOUBLE + 2.80::DOUBLE * sqrt(sum(s * (r - s) * (r + 1) / 12.0::DOUBLE)) / sum(s * (r - s)), 9) AS mde, CAST(sum(s * (r - s)) AS BIGINT) AS pairs, count(*) AS mixed_units FROM units WHERE s > 0 AND s < r"


@register("a18_null_sd", f"{O} {NULL}")
def a18(spark, d):
    return rounded(outcome.null_sd(units(spark, d)))


@register("a19_minimum_detectable", f"WITH {PART_RUNS}, {UNITS} {NULL}")
def a19(spark, d):
    return rounded(outcome.null_sd(outcome.unit_table(part_runs(spark, d), ["unit"])))


@register(
    "a18t_null_sd_ties",
    f"WITH {PART_RUNS}, h AS (SELECT unit, s, sum(y) AS p, sum(1 - y) AS n, count(*) AS t FROM runs GROUP BY unit, s), u AS (SELECT unit, sum(p)::DOUBLE AS p, sum(n)::DOUBLE AS n, sum(t)::DOUBLE AS m, sum(t * t * t - t)::DOUBLE AS tt FROM h GROUP BY unit HAVING sum(p) > 0 AND sum(n) > 0) SELECT round(sqrt(sum(p * n / 12 * (m + 1 - tt / (m * (m - 1))))) / sum(p * n), 9) AS null_sd FROM u",
)
def a18t(spark, d):
    return rounded(outcome.null_sd_ties(auroc.histogram(part_runs(spark, d), ["unit"], "y", "s").withColumnRenamed("_s", "s"), ["unit"]))


@register("a20_standardised_mixedness", f"{O}, m AS (SELECT 1.0::DOUBLE - (CASE WHEN s >= 3 THEN s * (s - 1) * (s - 2) ELSE 0 END + CASE WHEN r - s >= 3 THEN (r - s) * (r - s - 1) * (r - s - 2) ELSE 0 END)::DOUBLE / (r * (r - 1) * (r - 2)) AS m FROM units WHERE r >= 3) SELECT round(avg(m), 9) AS mixedness, count(*) AS units FROM m")
def a20(spark, d):
    return rounded(outcome.standardised_mixedness(units(spark, d), 3))


@register("a21_raw_mixedness", f"{O} SELECT round(avg(CASE WHEN s > 0 AND s < r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS mixed_fraction FROM units")
def a21(spark, d):
    return rounded(outcome.raw_mixedness(units(spark, d)))


@register("a22_icc_naive", f"WITH {ORDER_RUNS}, m AS (SELECT y, avg(y) OVER (PARTITION BY unit) AS q FROM runs) SELECT round(var_pop(q) / var_pop(y), 9) AS icc FROM m")
def a22(spark, d):
    return rounded(outcome.icc_naive(units(spark, d)))


@register(
    "a23_icc_anova",
    f"WITH {ORDER_RUNS}, m AS (SELECT unit, y, avg(y) OVER (PARTITION BY unit) AS q, avg(y) OVER () AS mu FROM runs), k AS (SELECT count(DISTINCT unit) AS k, count(*) AS n, sum((q - mu) ** 2) AS ssb, sum((y - q) ** 2) AS ssw FROM m), c AS (SELECT sum(r * r)::DOUBLE AS r2 FROM (SELECT count(*) AS r FROM runs GROUP BY unit)), x AS (SELECT ssb / (k - 1) AS msb, ssw / (n - k) AS msw, (n - r2 / n) / (k - 1) AS n0 FROM k, c) SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 9) AS icc FROM x",
)
def a23(spark, d):
    return rounded(outcome.icc_anova(units(spark, d)))


@register(
    "a24_icc_moments",
    f"{O}, v AS (SELECT r, s * (r - s) / (r * (r - 1))::DOUBLE AS v FROM units WHERE r > 1), m AS (SELECT sum(s)::DOUBLE / sum(r) AS mu FROM units) SELECT round(1 - avg(v) / any_value(mu * (1 - mu)), 9) AS icc_units, round(1 - sum(v * r) / sum(r) / any_value(mu * (1 - mu)), 9) AS icc_runs FROM v, m",
)
def a24(spark, d):
    return rounded(outcome.icc_moments(units(spark, d)))


SHRUNK = "g AS (SELECT avg(s / r::DOUBLE) AS mu, var_pop(s / r::DOUBLE) AS v, avg(CASE WHEN r > 1 THEN (s / r::DOUBLE) * (1 - s / r::DOUBLE) / (r - 1) ELSE 0.0::DOUBLE END) AS e FROM units), k AS (SELECT mu, greatest(mu * (1 - mu) / greatest(v - e, 1e-6::DOUBLE) - 1, 1e-3::DOUBLE) AS k FROM g), shrunk AS (SELECT unit, (s + mu * k) / (r + k) AS q FROM units, k)"


@register("a25_beta_shrinkage", f"{O}, {SHRUNK} SELECT unit, round(q, 9) AS q FROM shrunk")
def a25(spark, d):
    return rounded(outcome.shrunk(units(spark, d)).select("unit", "q"))


@register(
    "a26_posterior_weighting",
    f"{O}, {SHRUNK}, p AS (SELECT a.unit, avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM runs a JOIN runs b ON a.unit = b.unit WHERE a.y = 1 AND b.y = 0 GROUP BY a.unit) SELECT round(sum(2 * q * (1 - q) * coalesce(a, 0.5::DOUBLE)) / sum(2 * q * (1 - q)), 9) AS auroc, count(*) AS units FROM shrunk LEFT JOIN p ON shrunk.unit = p.unit",
)
def a26(spark, d):
    runs = order_runs(spark, d)
    return rounded(outcome.posterior_weighted(units(spark, d), auroc.unit_auroc(runs, ["unit"]), ["unit"]))


@register("a27_proper_scores", f"WITH {ORDER_RUNS}, {LOO}, c AS (SELECT y, s, greatest(least(s, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS p FROM loo) SELECT round(avg((s - y) ** 2), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss FROM c")
def a27(spark, d):
    return rounded(outcome.proper_scores(outcome.leave_one_out(order_runs(spark, d), ["unit"]), "y", "loo"))


@register(
    "a33_operating_curve",
    f"""WITH {PART_RUNS}, q AS (SELECT u.q, t.thr FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) u(q), LATERAL (SELECT quantile_cont(s, u.q) AS thr FROM runs WHERE y = 0) t)
    SELECT q AS quantile, round(thr, 9) AS threshold, round(avg(CASE WHEN s < thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS retention, round(sum(CASE WHEN y = 0 AND s >= thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / sum(1 - y), 9) AS false_abort,
    round(sum(CASE WHEN y = 1 AND s >= thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / sum(y), 9) AS recall, round(sum(CASE WHEN s >= thr THEN cost ELSE 0 END) / sum(cost), 6) AS compute_saved FROM runs, q GROUP BY q, thr""".replace(
        "u(q), LATERAL (SELECT quantile_cont(s, u.q) AS thr FROM runs WHERE y = 0) t", "u(q), (SELECT quantile_cont(s, 0.5) AS a, quantile_cont(s, 0.8) AS b, quantile_cont(s, 0.9) AS c, quantile_cont(s, 0.95) AS e FROM runs WHERE y = 0) z"
    ).replace("t.thr", "CASE u.q WHEN 0.5 THEN a WHEN 0.8 THEN b WHEN 0.9 THEN c ELSE e END AS thr"),
)
def a33(spark, d):
    return outcome.operating_curve(part_runs(spark, d), [0.5, 0.8, 0.9, 0.95])


@register("a34_quantiles", f"WITH {ORDER_RUNS} SELECT model, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.9), 6) AS q90 FROM runs GROUP BY model")
def a34(spark, d):
    return rounded(order_runs(spark, d).groupBy("model").agg(*(F.percentile("s", q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.9))), 6)


@register("a35_cost_and_rank", f"WITH {PART_RUNS}, t AS (SELECT supplier AS task, avg(cost) AS mean_cost, (sum(1 - y) + 0.5::DOUBLE) / (count(*) + 1) AS rate FROM runs GROUP BY supplier) SELECT task, round(mean_cost, 4) AS mean_cost, round(rate, 9) AS rate, CAST(row_number() OVER (ORDER BY rate / mean_cost DESC, task) AS INTEGER) AS place FROM t")
def a35(spark, d):
    ranked = outcome.priority(part_runs(spark, d).withColumn("task", F.col("supplier")))
    return ranked.select("task", F.round("mean_cost", 4).alias("mean_cost"), F.round("rate", 9).alias("rate"), "place")


@register("a36_length_caps", f"WITH {PART_RUNS} SELECT CAST(floor(quantile_cont(cost, 0.5)) AS INTEGER) AS cap50, CAST(floor(quantile_cont(cost, 0.75)) AS INTEGER) AS cap75, CAST(floor(quantile_cont(cost, 0.9)) AS INTEGER) AS cap90 FROM runs WHERE y = 0")
def a36(spark, d):
    caps = auroc.quantiles(part_runs(spark, d).where("y = 0"), "cost", [0.5, 0.75, 0.9])
    return spark.range(1).select(*(F.lit(c).cast("int").alias(f"cap{n}") for n, c in zip((50, 75, 90), caps, strict=True)))


@register("a37_short_success_share", "SELECT round(avg(CASE WHEN l_quantity <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS short_share FROM lineitem WHERE l_returnflag <> 'R'")
def a37(spark, d):
    runs = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return rounded(runs.agg(F.avg((F.col("l_quantity") <= 10).cast("double")).alias("short_share")))


@register("a38_distinct_counts", f"WITH {ORDER_RUNS} SELECT count(*) AS runs, count(DISTINCT unit) AS units, count(DISTINCT model) AS models, count(DISTINCT (unit, model)) AS cells FROM runs")
def a38(spark, d):
    return order_runs(spark, d).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("unit").alias("units"), F.countDistinct("model").alias("models"), F.countDistinct("unit", "model").alias("cells"))


@register("a39_beta_fit", f"{O}, m AS (SELECT avg(1 - s / r::DOUBLE) AS m1, var_pop(1 - s / r::DOUBLE) AS v FROM units), z AS (SELECT m1, v, greatest(m1 * (1 - m1) / v - 1, 1e-3::DOUBLE) AS size FROM m) SELECT round(m1, 6) AS m1, round(v, 6) AS v, round(m1 * size, 6) AS alpha, round((1 - m1) * size, 6) AS beta FROM z")
def a39(spark, d):
    """Beta parameters from the first moments of repeated success, and their ceiling."""
    return rounded(outcome.beta_moments(units(spark, d)), 6)


@register("a39c_beta_ceiling")
def a39c(spark, d):
    return outcome.beta_ceiling(outcome.beta_moments(units(spark, d)))


@register("a40_pseudo_counts", f"WITH {PART_RUNS}, b AS (SELECT unit, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM runs GROUP BY unit) SELECT unit, 1 + 0.5::DOUBLE * s AS alpha, 1 + 0.5::DOUBLE * (n - s) AS beta FROM b")
def a40(spark, d):
    other = part_runs(spark, d).withColumn("success", (F.col("status") == "F").cast("int"))
    return outcome.pseudo_counts(other, "unit", "success", 0.5)


@register(
    "a41_decile_calibration",
    f"WITH {ORDER_RUNS}, e AS (SELECT quantile_cont(s, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM runs), b AS (SELECT CAST(len(list_filter(e, lambda x: x <= s)) AS INTEGER) AS bin, y FROM runs, e), m AS (SELECT avg(y) AS base FROM runs) SELECT bin, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN avg(y) ELSE any_value(base) END, 9) AS rate FROM b, m GROUP BY bin",
)
def a41(spark, d):
    return rounded(outcome.decile_calibration(order_runs(spark, d), "s", "y"))


@register("p08_null_policy", "WITH z AS (SELECT o_custkey AS unit, nullif(o_orderpriority, '5-LOW') AS m, o_orderstatus AS st FROM orders) SELECT 'drop' AS policy, count(*) AS runs, CAST(sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM z WHERE m IS NOT NULL UNION ALL SELECT 'fail', count(*), CAST(sum(CASE WHEN m IS NULL OR st = 'F' THEN 1 ELSE 0 END) AS BIGINT) FROM z")
def p08(spark, d):
    """Runs without a score: dropped, or counted as failures."""
    runs = table(spark, d, "orders").select(F.when(F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull(), (F.col("o_orderstatus") == "F").cast("int")).alias("y"))
    return outcome.apply_null_policy(runs, "y", "drop").unionByName(outcome.apply_null_policy(runs, "y", "fail")).groupBy("policy").agg(F.count(F.lit(1)).alias("runs"), F.sum("y").alias("failures"))
