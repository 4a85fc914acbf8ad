"""Queries of the AUROC family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import auroc
from ..registry import register
from .bindings import ORDER_RUNS, PART_RUNS, order_runs, part_runs, rounded

PAIRS = "pairs AS (SELECT a.unit, CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c FROM runs a JOIN runs b ON a.unit = b.unit WHERE a.y = 1 AND b.y = 0)"
PER_UNIT = "per_unit AS (SELECT unit, sum(c) AS num, count(*) AS den, avg(c) AS a FROM pairs GROUP BY unit)"
RANKED = "ranked AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM runs)"
POOL = "pool AS (SELECT sum(y) AS P, sum(1 - y) AS N, sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE AS U FROM ranked)"


@register("a02_pooled_auroc", f"WITH {PART_RUNS}, {RANKED}, {POOL} SELECT round(U / (P * N)::DOUBLE, 9) AS auroc, CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives FROM pool")
def a02(spark, d):
    return rounded(auroc.pooled(part_runs(spark, d)))


@register("a02r_pooled_auroc_ranks", f"WITH {ORDER_RUNS}, {RANKED}, {POOL} SELECT round(U / (P * N)::DOUBLE, 9) AS auroc, CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives FROM pool")
def a02r(spark, d):
    return rounded(auroc.pooled_by_rank(order_runs(spark, d)))


@register("a02s_pooled_auroc_sampled")
def a02s(spark, d):
    return auroc.pooled_sampled(order_runs(spark, d), 200_000, "run")


@register("a03_within_auroc", f"WITH {PART_RUNS}, {PAIRS}, {PER_UNIT} SELECT round(sum(num) / sum(den), 9) AS auroc, CAST(sum(den) AS BIGINT) AS pairs, count(*) AS mixed_units FROM per_unit")
def a03(spark, d):
    return rounded(auroc.within(part_runs(spark, d), ["unit"]))


@register("j05_same_unit_pairs", f"WITH {ORDER_RUNS}, {PAIRS} SELECT unit, count(*) AS pairs, round(sum(c), 6) AS concordance FROM pairs GROUP BY unit")
def j05(spark, d):
    u = auroc.unit_auroc(order_runs(spark, d), ["unit"])
    return rounded(u.select("unit", (F.col("p") * F.col("n")).alias("pairs"), "concordance"), 6)


@register("a04_within_macro", f"WITH {ORDER_RUNS}, {PAIRS}, {PER_UNIT} SELECT round(avg(a), 9) AS auroc, count(*) AS mixed_units FROM per_unit")
def a04(spark, d):
    return rounded(auroc.within_macro(order_runs(spark, d), ["unit"]))


@register(
    "a05_within_deployment",
    f"WITH {ORDER_RUNS}, p AS (SELECT a.unit, a.model, avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM runs a JOIN runs b ON a.unit = b.unit AND a.model = b.model WHERE a.y = 1 AND b.y = 0 GROUP BY a.unit, a.model), t AS (SELECT unit, avg(a) AS a FROM p GROUP BY unit) SELECT round(avg(a), 9) AS auroc, count(*) AS tasks FROM t",
)
def a05(spark, d):
    return rounded(auroc.within_deployment(order_runs(spark, d), ["unit", "model"], "unit"))


DECOMPOSED = f"""WITH {{runs}}, {PAIRS}, {RANKED}, {POOL}, w AS (SELECT coalesce(sum(c), 0) AS c, count(*) AS same FROM pairs)
SELECT round(U / (P * N)::DOUBLE, 9) AS a_pool, round(c / same, 9) AS a_within, round((U - c) / (P * N - same)::DOUBLE, 9) AS a_cross, round(same / (P * N)::DOUBLE, 9) AS w,
CAST(same AS BIGINT) AS n_within, CAST(P * N - same AS BIGINT) AS n_cross FROM pool, w"""


@register("a06_decomposition", DECOMPOSED.format(runs=PART_RUNS))
def a06(spark, d):
    return rounded(auroc.decomposition(part_runs(spark, d), ["unit"]))


@register("j06_cross_unit_pairs", DECOMPOSED.format(runs=ORDER_RUNS))
def j06(spark, d):
    return rounded(auroc.decomposition(order_runs(spark, d), ["unit"]))


@register(
    "a07_demeaned_auroc",
    f"WITH {PART_RUNS}, m AS (SELECT unit, avg(s) AS mu FROM runs GROUP BY unit HAVING min(y) < max(y)), z AS (SELECT r.y, round(r.s - m.mu, 9) AS s FROM runs r JOIN m ON r.unit = m.unit), "
    + RANKED.replace("FROM runs", "FROM z") + f", {POOL} SELECT round(U / (P * N)::DOUBLE, 9) AS auroc, CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives FROM pool",
)
def a07(spark, d):
    return rounded(auroc.demeaned(part_runs(spark, d), ["unit"]))


CONT = "AVG(CASE WHEN a.s < b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"


@register("a08_concordance_continuous", f"WITH {PART_RUNS} SELECT round({CONT}, 9) AS concordance, count(*) AS pairs FROM runs a JOIN runs b ON a.unit = b.unit WHERE a.cost > b.cost")
def a08(spark, d):
    return rounded(auroc.concordance_continuous(part_runs(spark, d), ["unit"], "cost"))


@register("j07_ordered_pairs", f"WITH {ORDER_RUNS} SELECT round({CONT.replace('a.s', 'a.run').replace('b.s', 'b.run')}, 9) AS concordance, count(*) AS pairs FROM runs a JOIN runs b ON a.unit = b.unit WHERE a.s > b.s")
def j07(spark, d):
    return rounded(auroc.concordance_continuous(order_runs(spark, d), ["unit"], "s", "run"))


@register("a09_concordance_binary", f"WITH {ORDER_RUNS}, b AS (SELECT unit, s, CASE WHEN y = 1 THEN 0 ELSE 1 END AS y FROM runs), {PAIRS.replace('runs', 'b2')} SELECT round(sum(c) / count(*), 9) AS auroc, count(*) AS pairs, count(DISTINCT unit) AS mixed_units FROM pairs".replace(", pairs AS", ", b2 AS (SELECT unit, -s AS s, 1 - y AS y FROM b), pairs AS"))
def a09(spark, d):
    runs = order_runs(spark, d)
    return rounded(auroc.within(runs.withColumn("s", -F.col("s")), ["unit"]))


@register(
    "a10_grouped_auroc",
    f"""WITH {ORDER_RUNS}, r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE AS rk FROM runs),
    m AS (SELECT model, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 9) AS auroc, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM r GROUP BY model),
    {RANKED}, {POOL} SELECT * FROM m UNION ALL SELECT 'all', round(U / (P * N)::DOUBLE, 9), CAST(P AS BIGINT), CAST(N AS BIGINT) FROM pool""",
)
def a10(spark, d):
    runs = order_runs(spark, d)
    return rounded(auroc.pooled(runs, ["model"]).unionByName(auroc.pooled(runs).withColumn("model", F.lit("all"))))


@register(
    "a11_fold_aggregation",
    f"""WITH {ORDER_RUNS}, f AS (SELECT *, unit % 5 AS fold FROM runs),
    p AS (SELECT a.unit, a.fold, CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c FROM f a JOIN f b ON a.unit = b.unit WHERE a.y = 1 AND b.y = 0),
    w AS (SELECT sum(c) / count(*) AS within, count(*) AS pairs, count(DISTINCT unit) AS mixed_units FROM p),
    r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0::DOUBLE AS rk FROM f),
    g AS (SELECT fold, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS a FROM r GROUP BY fold)
    SELECT round(any_value(within), 9) AS within, any_value(pairs) AS pairs, any_value(mixed_units) AS mixed_units, round(avg(a), 9) AS pooled_mean, round(stddev_samp(a), 9) AS pooled_sd, count(*) AS folds FROM g, w""",
)
def a11(spark, d):
    return rounded(auroc.fold_aggregate(order_runs(spark, d).withColumn("fold", F.col("unit") % 5), "fold", ["unit"]))


@register("w03_mid_rank", f"WITH {ORDER_RUNS} SELECT run, rank() OVER (PARTITION BY unit ORDER BY s) + (count(*) OVER (PARTITION BY unit, s) - 1) / 2.0::DOUBLE AS mid_rank FROM runs")
def w03(spark, d):
    return auroc.mid_rank(order_runs(spark, d), "s", ["unit"]).select("run", "mid_rank")


@register(
    "w04_mass_below",
    f"WITH {PART_RUNS}, h AS (SELECT s, sum(1 - y) AS n FROM runs GROUP BY s) SELECT s, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM h",
)
def w04(spark, d):
    return auroc.below(auroc.histogram(part_runs(spark, d), [], "y", "s"), []).select(F.col("_s").alias("s"), "n", F.col("below").cast("long").alias("below"))


@register("i11_controls", f"WITH {ORDER_RUNS}, m AS (SELECT unit, sum(y) * sum(1 - y) AS pr FROM runs GROUP BY unit HAVING min(y) < max(y)), t AS (SELECT CAST(sum(pr) AS BIGINT) AS pairs, count(*) AS mixed_units FROM m) SELECT c.control, c.auroc, t.pairs, t.mixed_units FROM t, (VALUES ('label', 1.0::DOUBLE), ('inverted', 0.0::DOUBLE), ('constant', 0.5::DOUBLE), ('unit_mean', 0.5::DOUBLE)) c(control, auroc)")
def i11(spark, d):
    """Scores whose within-unit AUROC is known."""
    runs = order_runs(spark, d)
    scores = {"label": F.col("y").cast("double"), "inverted": -F.col("y").cast("double"), "constant": F.lit(1.0), "unit_mean": F.col("unit").cast("double")}
    long = runs.select("unit", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("control"), v.alias("s")) for k, v in scores.items()))).alias("z")).select("unit", "y", "z.*")
    return auroc.within(long, ["unit"], ["control"])
