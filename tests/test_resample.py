"""Draws made inside a unit's or a tile's task, beside a row for each draw."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rerunlab.functions import hashing
from rerunlab.functions.special import uniform
from rerunlab.operators import auroc, inference, outcome, resample


@pytest.fixture(scope="module")
def runs(spark):
    """Units of 1 to 60 runs, scores with ties, some scores and labels unknown."""
    rows, run, r = [], 0, np.random.default_rng(5)
    for u in range(90):
        for _ in range(int(r.integers(1, 13)) if u else 60):
            y, s = int(r.random() < 0.2 + 0.6 * (u % 7) / 7), float(r.integers(0, 9))
            rows.append((u, run, None if run % 41 == 7 else y, None if run % 29 == 3 else s))
            run += 1
    return spark.createDataFrame(rows, "unit long, run long, y int, s double").cache()


def test_hashes_are_those_of_spark(spark):
    df = spark.range(-3, 50).withColumn("b", F.explode(F.array(F.lit(0), F.lit(7), F.lit(-2)))).withColumn("u", uniform(F.col("id"), F.col("b"), seed=11)).toPandas()
    got = hashing.with_int(hashing.with_int(hashing.of_long(df.id.to_numpy()), df.b.to_numpy()), 11)
    assert (hashing.unit_interval(got) == df.u.to_numpy()).all()


def picked(units, unit, values, draws, seed):
    """A row for every pick, as the bootstrap made them."""
    rows = units.orderBy(*unit).collect()
    n = len(rows)
    picks = units.sparkSession.range(n).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    out: dict[int, list[float]] = {}
    for b, i in picks.select("b", F.floor(uniform(F.col("id"), F.col("b"), seed=seed) * n).alias("i")).collect():
        out[b] = [x + rows[i][v] for x, v in zip(out.get(b, [0.0] * len(values)), values, strict=True)]
    return out


@pytest.mark.parametrize("tile", [1 << 22, 7])
def test_icc_bootstrap_makes_no_row_for_a_pick(runs, monkeypatch, tile):
    monkeypatch.setattr(resample, "TILE", tile)
    units = outcome.unit_table(runs, ["unit"]).withColumn("q", F.col("s") * 0.25)
    got = {r["b"]: [r["r"], r["s"], r["q"]] for r in resample.drawn_sums(units.repartition(3), ["unit"], ["r", "s", "q"], 40, 3).collect()}
    want = picked(units, ["unit"], ["r", "s", "q"], 40, 3)
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], abs=1e-9) for b in got)
    plan = inference.bootstrap_icc(units, ["unit"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # picks were joined to units, and broadcast as if they were few


def within_picks(runs, draws, seed):
    u = auroc.unit_auroc(runs, ["unit"]).withColumn("pairs", F.col("p") * F.col("n"))
    return {b: c / m for b, (c, m) in picked(u, ["unit"], ["concordance", "pairs"], draws, seed).items()}


def test_equivalence_bound_is_that_of_joined_picks(runs):
    drawn = inference.bootstrap_within(runs, ["unit"], 40, seed=11)
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()
    want = within_picks(runs, 40, 11)
    got = inference.interval(drawn, "auroc").first()
    assert got["draws"] == 40 and got["bound"] == pytest.approx(np.percentile([abs(x - 0.5) for x in want.values()], 95), abs=1e-12)


def test_unit_bootstrap_in_tiles_is_that_of_joined_picks(runs, monkeypatch):
    monkeypatch.setattr(resample, "TILE", 16)
    got = {r["b"]: r["auroc"] for r in inference.bootstrap_within(runs, ["unit"], 25).collect()}
    assert got == pytest.approx(within_picks(runs, 25, 0), abs=1e-12)


@pytest.mark.parametrize("block,chunk", [(65_536, 1 << 15), (50, 64)])
def test_power_is_that_of_a_row_for_each_draw(spark, runs, monkeypatch, block, chunk):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "CHUNK", chunk)
    shifts = [(0.3, 4), (0.9, 5)]
    got = {(r["i"], r["b"]): r["auroc"] for r in resample.synthetic_within(runs, ["unit"], "run", shifts, 6).collect()}
    assert len(got) == 12
    for i, (shift, seed) in enumerate(shifts):
        rows = runs.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(6))))
        scored = rows.withColumn("s", inference.gaussian(F.col("run"), F.col("b"), seed=seed) + shift * F.col("y"))
        want = {(i, r["b"]): r["auroc"] for r in auroc.within(scored, ["unit"], ["b"]).collect()}
        assert {k: v for k, v in got.items() if k[0] == i} == pytest.approx(want, abs=1e-12)
    plan = inference.power(runs, ["unit"], "run", [0.5, 0.6], 2000, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # runs were repeated for every draw and sorted


def same_draws(got, want):
    a, b = ({r["b"]: (r["auroc"], r["pairs"], r["mixed_units"]) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


@pytest.mark.parametrize("block", [65_536, 50])
def test_permutations_are_those_of_a_row_for_each_draw(runs, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    same_draws(resample.permuted_within(runs, ["unit"], "run", 9, seed=2), auroc.within(inference.permuted_labels(runs, ["unit"], "run", 9, seed=2), ["unit"], ["b"]))
    plan = inference.permutation_test(runs, ["unit"], "run", 50)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # runs were repeated for every draw and sorted


def test_permutations_in_folds(runs):
    folded = runs.withColumn("fold", F.col("unit") % 5)
    unit = ["fold", "unit"]
    same_draws(resample.permuted_within(folded, unit, "run", 5, seed=3), auroc.within(inference.permuted_labels(folded, unit, "run", 5, seed=3), unit, ["b"]))


@pytest.mark.parametrize("keep", [2, 5, 9])
def test_subsamples_are_those_of_a_row_for_each_draw(runs, keep):
    same_draws(resample.subsampled_within(runs, ["unit"], "run", keep, 6, seed=keep), auroc.within(inference.subsample_runs(runs, ["unit"], "run", keep, 6, seed=keep), ["unit"], ["b"]))


def test_repeat_drift_repeats_no_run(spark):
    from rerunlab.plans import inference as plans

    assert "Generate" not in plans.i12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_large_histograms_are_not_joined_to_their_own_sizes(spark, runs, monkeypatch):
    small = exchanges(auroc.within(runs, ["unit"]))
    monkeypatch.setattr(auroc, "SMALL", 0)
    assert exchanges(auroc.within(runs, ["unit"])) == small  # was three times as many


def test_runs_stay_in_place_over_rounds(runs):
    """Every round of a bisection moved every run."""
    placed = resample.together(runs, ["unit"]).cache()
    rows = placed.count()
    scored = inference.corrupted(inference.monitor_scores(placed, ["unit"], "run", "A", 0.7), "run", 0.1)
    plan = auroc.unit_auroc(scored, ["unit"])._jdf.queryExecution().executedPlan().toString()
    assert rows and "Exchange" not in plan.split("InMemoryTableScan")[0]
    placed.unpersist()


def test_decomposition_with_large_histograms(runs, monkeypatch):
    want = auroc.decomposition(runs, ["unit"]).first()
    monkeypatch.setattr(auroc, "SMALL", 0)
    monkeypatch.setattr(auroc, "ONE_TASK", 20)
    monkeypatch.setattr(auroc, "RANGES", 5)
    df = auroc.decomposition(runs.withColumn("s", F.col("s") + F.col("run") / 1000), ["unit"])
    assert df.first()["n_within"] == want["n_within"]
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_recorded_runs_stay_in_place_in_replay(spark, monkeypatch):
    """Draws and priors moved every recorded run where tables are too large to broadcast unasked."""
    from rerunlab.operators import replay

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select(F.pmod("id", F.lit(5)).alias("task"), (F.col("id") + 1.0).alias("cost"), (F.col("id") % 3 == 0).cast("int").alias("y"))
        priors = spark.createDataFrame([(0, 2.0, 3.0), (1, 4.0, 1.0)], "task long, alpha double, beta double")
        b = replay.bench(rows).cache()
        b.count()
        under = replay.with_priors(b, priors)
        assert {(r["task"], r["alpha"], r["beta"]) for r in under.collect()} == {(0, 2.0, 3.0), (1, 4.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0)}
        plan = replay.draws(under, [0, 1], 8, 5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan.split("InMemoryTableScan")[0] and "BroadcastHashJoin" in plan
        few = {tuple(map(str, r)) for r in replay.draws(under, [0, 1], 8, 5).collect()}
        monkeypatch.setattr(replay, "FEW", 0)
        assert {tuple(map(str, r)) for r in replay.draws(under, [0, 1], 8, 5).collect()} == few
        b.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
