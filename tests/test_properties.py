"""Known answers, invariants and controls of the metrics, simulators and special functions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rerunlab.functions import special
from rerunlab.functions import text as tx
from rerunlab.operators import auroc, inference, outcome, predict, replay
from rerunlab.operators import relational as rel
from rerunlab.operators import steps as st
from rerunlab.sources import readers, writers


@pytest.fixture(scope="module")
def runs(spark):
    r = random.Random(0)
    rows = []
    for u in range(50):
        q = r.uniform(0.1, 0.9)
        rows += [(f"t{u}", i, int(r.random() < q), q, 0.5 * q + 0.5 * r.random()) for i in range(10)]
    return spark.createDataFrame(rows, "unit string, run int, y int, q double, s double").cache()


def test_task_only_score_is_blind_within(runs):
    assert auroc.pooled(runs, score="q").first()["auroc"] > 0.65
    assert auroc.within(runs, ["unit"], score="q").first()["auroc"] == 0.5


def test_perfect_score(runs):
    assert auroc.within(runs.withColumn("p", F.col("y") * 1.0), ["unit"], score="p").first()["auroc"] == 1.0


def test_uniform_units_have_no_pairs(spark):
    df = spark.createDataFrame([("a", 1, 0.1)] * 4 + [("b", 0, 0.2)] * 4, "unit string, y int, s double")
    r = auroc.within(df, ["unit"]).first()
    assert r["auroc"] is None and r["pairs"] == 0


def brute(rows):
    win = tot = cross = total = 0.0
    for a in rows:
        for b in rows:
            if a["y"] == 1 and b["y"] == 0:
                c = 1.0 if a["s"] > b["s"] else 0.5 if a["s"] == b["s"] else 0.0
                if a["unit"] == b["unit"]:
                    win, tot = win + c, tot + 1
                else:
                    cross, total = cross + c, total + 1
    return (win + cross) / (tot + total), win / tot, cross / total, tot / (tot + total)


def test_decomposition_identity(runs):
    r = auroc.decomposition(runs, ["unit"]).first()
    assert math.isclose(r["a_pool"], r["w"] * r["a_within"] + (1 - r["w"]) * r["a_cross"], abs_tol=1e-12)
    assert np.allclose([r["a_pool"], r["a_within"], r["a_cross"], r["w"]], brute(runs.collect()), atol=1e-12)


def test_metamorphic(runs):
    base = auroc.within(runs, ["unit"]).first()["auroc"]
    assert auroc.within(runs.withColumn("s", F.exp("s") * 3), ["unit"]).first()["auroc"] == base
    assert math.isclose(auroc.within(runs.withColumn("s", -F.col("s")), ["unit"]).first()["auroc"], 1 - base, abs_tol=1e-12)
    twice = runs.unionByName(runs.withColumn("unit", F.concat("unit", F.lit("'"))))
    assert math.isclose(auroc.within(twice, ["unit"]).first()["auroc"], base, abs_tol=1e-12)
    extra = runs.unionByName(runs.limit(5).select(F.lit("z").alias("unit"), "run", F.lit(0).alias("y"), "q", F.lit(9.0).alias("s")))
    assert auroc.within(extra, ["unit"]).first()["auroc"] == base
    assert auroc.pooled(extra).first()["auroc"] != auroc.pooled(runs).first()["auroc"]


@pytest.mark.parametrize("most", [0, 8, 10**6])
def test_range_cut_running_sum(runs, monkeypatch, most):
    """Cutting all, some or no groups into ranges changes nothing."""
    more = runs.unionByName(runs.withColumn("unit", F.lit("hot")))
    whole, inside, split = auroc.pooled(more).first(), auroc.within(more, ["unit"]).first(), auroc.decomposition(more, ["unit"]).first()
    monkeypatch.setattr(auroc, "SMALL", 0)
    monkeypatch.setattr(auroc, "ONE_TASK", most)
    monkeypatch.setattr(auroc, "RANGES", 7)
    assert math.isclose(auroc.pooled(more).first()["auroc"], whole["auroc"], abs_tol=1e-12)
    assert math.isclose(auroc.within(more, ["unit"]).first()["auroc"], inside["auroc"], abs_tol=1e-12)
    assert np.allclose(auroc.decomposition(more, ["unit"]).first(), split, atol=1e-12)


def test_null_scores_and_labels_are_left_out(runs):
    noisy = runs.unionByName(runs.limit(20).withColumn("s", F.lit(None).cast("double"))).unionByName(runs.limit(20).withColumn("y", F.lit(None).cast("int")))
    assert auroc.pooled(noisy).first()["auroc"] == auroc.pooled(runs).first()["auroc"]


def test_leave_one_out_scores_nothing_within(runs):
    loo = outcome.leave_one_out(runs, ["unit"])
    assert auroc.within(loo, ["unit"], score="loo").first()["auroc"] == 0.0


def test_tie_corrected_null_vanishes_on_constant_scores(runs):
    h = auroc.histogram(runs.withColumn("s", F.lit(1.0)), ["unit"], "y", "s")
    assert outcome.null_sd_ties(h, ["unit"]).first()["null_sd"] == 0.0


def test_finite_r_prediction_is_near_the_measured_value(runs):
    measured = outcome.leave_one_out_auroc(runs, ["unit"]).first()["auroc"]
    assert abs(outcome.finite_r(outcome.unit_table(runs, ["unit"])).first()["auroc"] - measured) < 0.08


def test_permutation_and_bootstrap(runs):
    p = inference.permutation_test(runs.withColumn("s", F.col("y") + F.rand(1) * 0.1), ["unit"], "run", 30).first()
    assert p["p_value"] == pytest.approx(1 / 31) and p["observed"] == 1.0
    for exact in (True, False):
        i = inference.interval(inference.bootstrap_within(runs, ["unit"], 60, exact=exact), "auroc").first()
        seen = auroc.within(runs, ["unit"]).first()["auroc"]
        assert i["low"] < seen < i["high"]


def test_permuted_labels_keep_unit_counts(runs):
    b = inference.permuted_labels(runs, ["unit"], "run", 3)
    per = b.groupBy("unit", "b").agg(F.sum("y").alias("n")).groupBy("unit").agg(F.countDistinct("n").alias("k"))
    assert per.where("k <> 1").count() == 0


def test_synthetic_scores_reach_their_target(spark):
    rows = [(f"u{u}", u * 40 + i, i % 2) for u in range(60) for i in range(40)]
    df = spark.createDataFrame(rows, "unit string, run int, y int")
    got = auroc.within(inference.synthetic_scores(df, "run", 0.7), ["unit"]).first()["auroc"]
    assert abs(got - 0.7) < 0.02


def test_prefixes(spark):
    df = spark.createDataFrame([(r, i) for r, n in (("long", 40), ("short", 8)) for i in range(1, n + 1)], "run string, step int")
    turns = {r["run"]: r["count"] for r in st.prefix_turns(df, 5).groupBy("run").count().collect()}
    part = {r["run"]: r["count"] for r in st.prefix_fraction(df, ["run"], 0.25).groupBy("run").count().collect()}
    assert turns == {"long": 5, "short": 5} and part == {"long": 10, "short": 2}
    ten = spark.createDataFrame([("a", i) for i in range(1, 11)], "run string, step int")
    assert st.prefix_fraction(ten, ["run"], 0.25).count() == 2  # 2.5 rounds to even


def test_transition_model_rare_edges(spark):
    seqs = {"a": "xyxyxz", "b": "w", "c": "q"}
    df = spark.createDataFrame([(r, i + 1, c) for r, s in seqs.items() for i, c in enumerate(s)], "run string, step int, act string")
    m = {(r["state"], r["act"]): r["p"] for r in st.transition_model(df, ["run"]).collect()}
    assert m["x", "y"] == 1.0 and ("x", "z") not in m and m["y", "x"] == 1.0
    assert m["<init>", "w"] == pytest.approx(1 / 3)  # every edge of <init> is rare, so all stay
    worst = st.surprise(df, ["run"], st.transition_model(df, ["run"])).agg(F.max("surprise")).first()[0]
    assert worst == pytest.approx(-math.log(1e-4))


def test_sessions_last_error_wins(spark):
    df = spark.createDataFrame([(1, 0, "user", "ignored error"), (1, 1, "assistant", "hi"), (1, 2, "tool", "an Error"), (1, 3, "user", "fine")], "c int, turn int, role string, text string")
    r = st.sessions(df, ["c"], "turn", F.col("role") == "assistant", "text", tx.error_flag(F.col("text"))).collect()
    assert len(r) == 1 and r[0]["err"] == 0 and r[0]["obs_len"] == 2 + 8 + 4


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.normal_survival(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert sum(special.binomial_pmf(7, 0.3)) == pytest.approx(1.0) and special.binomial_pmf(3, 0.0) == [1.0, 0.0, 0.0, 0.0]
    assert special.beta_survival(0.3, 1, 1) == pytest.approx(0.7)
    assert special.beta_survival(0.4, 2, 3) == pytest.approx(1 - (6 * 0.16 - 8 * 0.064 + 3 * 0.0256), abs=1e-10)
    assert special.beta_mean_difference(1, 1) == pytest.approx(1 / 3, abs=1e-6)
    assert special.beta_survival(0.9, 50, 5) == pytest.approx(1 - special.beta_survival(0.1, 5, 50))


@pytest.fixture(scope="module")
def small_runs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in range(20):
        for _ in range(6):
            steps = int(rng.integers(1, 12))
            cum = np.cumsum(rng.uniform(1, 3, steps)).tolist()
            rows.append((t, int(rng.random() >= 0.1 + 0.04 * t), cum[-1], float(rng.random()), steps, cum))
    runs = spark.createDataFrame(rows, "task int, y int, cost double, s double, steps int, cum array<double>")
    priors = spark.createDataFrame([(t, 1.0 + t % 5, 4.0) for t in range(20)], "task int, alpha double, beta double")
    return runs, replay.bench(runs, priors, abort_turn=3, cap=5).cache()


CALIBRATION = ([0.5], [0.4, 0.8], 0.6)
HOW = dict(threshold=0.7, cap=5, calibration=CALIBRATION)


def plain(d, policy, budget, seed):
    """The policies once more, in plain Python over dictionaries."""
    rng, tasks = np.random.default_rng(seed), list(d.task)
    of = {r.task: r for r in d.itertuples()}
    order = [tasks[i] for i in rng.permutation(len(tasks))]
    warm = policy in ("warm", "warm_cost", "give_up", "hybrid", "warm_capped", "routed_prior", "fair_abort")
    ab = {t: [of[t].alpha, of[t].beta] if warm else [1.0, 1.0] for t in tasks}
    mon, seen, alive = {t: [0.0, 0.0] for t in tasks}, dict.fromkeys(tasks, 0), dict.fromkeys(tasks, True)
    fixed = sorted(tasks, key=lambda t: -(of[t].alpha / (of[t].alpha + of[t].beta) / of[t].mean_cost))
    spent, solved, at = 0.0, 0, 0
    while spent < budget and any(alive.values()):
        live = [t for t in tasks if alive[t]]
        if policy in ("round_robin", "abort", "capped", "capped_curve", "static"):
            line = fixed if policy == "static" else order
            while not alive[line[at % len(line)]]:
                at += 1
            t = line[at % len(line)]
            at += 1
        elif policy == "oracle":
            t = max(live, key=lambda t: of[t].truth / of[t].mean_cost)
            if of[t].truth <= 0:
                break
        elif policy == "greedy":
            t = next((t for t in live if not seen[t]), live[0])  # nothing alive has won yet
        else:
            rate = dict(zip(tasks, rng.beta([max(ab[t][0] + mon[t][0], 1e-3) for t in tasks], [max(ab[t][1] + mon[t][1], 1e-3) for t in tasks]), strict=True))
            price = {t: of[t].cost[rng.integers(len(of[t].cost))] for t in tasks} if policy == "warm_cost" else {t: of[t].mean_cost for t in tasks}
            t = max(live, key=lambda t: rate[t] / max(price[t], 1.0))
        i = seen[t]
        r, seen[t] = {c: getattr(of[t], c)[i] for c in ("cost", "win", "s", "steps", "early", "capped")}, i + 1
        charge, got = r["cost"], r["win"]
        if policy in ("abort", "hybrid") and r["s"] >= 0.7:
            charge, got = r["early"], 0
        if policy == "fair_abort":
            fail = 0.8 if r["s"] >= 0.5 else 0.4
            if fail > 0.6 and fail > of[t].mean_score:
                charge, got = r["early"], 0
        if policy in ("capped", "warm_capped") and r["steps"] > 5:
            charge, got = r["capped"], 0
        if policy == "capped_curve":
            charge, got = r["capped"], int(r["win"] and r["steps"] <= 5)
        spent += charge
        if policy.startswith("routed"):
            mon[t][0] += 1 - r["s"]
            mon[t][1] += r["s"]
        if got:
            solved, alive[t] = solved + 1, False
        elif policy != "routed_pure":
            ab[t][1] += 1
            if policy == "give_up" and special.beta_survival(0.1, *ab[t]) < 0.05:
                alive[t] = False
    return solved, spent


def test_draws_are_recorded_runs(small_runs):
    runs, b = small_runs
    rows = {(r["task"], r["index"]): r for r in b.collect()}
    assert len(rows) == runs.count() and {i for t, i in rows if t == 4} == set(range(6))
    for r in runs.collect():
        met = [x for (t, _), x in rows.items() if t == r["task"] and x["cost"] == r["cost"]]
        assert [(x["early"], x["capped"], x["win"]) for x in met] == [(r["cum"][min(3, r["steps"]) - 1], r["cum"][min(5, r["steps"]) - 1], 1 - r["y"])]
    d = replay.draws(b, [0, 1], 400, 5).toPandas()
    assert len(d) == 40 and all(len(x) == 400 for x in d.cost)
    shares = [np.mean(np.array(x) == y) for x, y in zip(d.cost, d.cost.map(lambda c: c[0]), strict=True)]
    assert 0.05 < min(shares) and max(shares) < 0.3  # each of six runs about alike


@pytest.mark.parametrize("policy", replay.POLICIES)
def test_policies_equal_a_plain_simulator(small_runs, policy):
    d = replay.draws(small_runs[1], [0], 4000, 5).toPandas().sort_values("task", ignore_index=True)
    for budget in (30.0, 400.0, 1500.0):
        for seed in (3, 4):
            t = replay.Trial(d, policy, budget, seed, **HOW).run()
            assert t.solved == len(t.curve) and t.spent < budget + 40
            assert (t.solved, t.spent) == pytest.approx(plain(d, policy, budget, seed))


def test_trials_go_on_where_draws_are_used_up(spark, small_runs, monkeypatch):
    full = {tuple(r) for r in replay.trials(small_runs[1], spark, ["static", "warm"], [900.0], 4).collect()}
    monkeypatch.setattr(replay, "READY", 1)
    assert {tuple(r) for r in replay.trials(small_runs[1], spark, ["static", "warm"], [900.0], 4).collect()} == full
    assert len(full) == 8


def test_oracle_beats_round_robin(spark, small_runs):
    rows = replay.trials(small_runs[1], spark, ["oracle", "round_robin"], [150.0], 30).groupBy("policy").agg(F.avg("solved").alias("m")).collect()
    mean = {r["policy"]: r["m"] for r in rows}
    assert mean["oracle"] > mean["round_robin"]


def test_runs_are_numbered_in_cells(spark, small_runs, monkeypatch):
    monkeypatch.setattr(replay, "PER_CELL", 7)
    b = replay.bench(small_runs[0])
    assert {i: n for i, n in b.groupBy("index").count().collect()} == dict.fromkeys(range(6), 20)


def test_folds_do_not_share_groups(runs):
    f = predict.group_folds(runs, "unit")
    predict.assert_no_leak(f, "unit")
    assert f.groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] == 0
    with pytest.raises(AssertionError):
        predict.assert_no_leak(runs.withColumn("fold", F.col("run") % 2), "unit")


def test_injected_feature_is_found_and_noise_is_not(runs):
    r = predict.hash_folds(runs.withColumn("x", F.col("y") * 2.0 + F.rand(3)).withColumn("z", F.rand(4)), "unit", 2)
    good = predict.cross_fit(r, predict.logistic(["x"]), k=2)
    bad = predict.cross_fit(r, predict.logistic(["z"]), k=2)
    assert auroc.within(good, ["unit"], score="score").first()["auroc"] > 0.95
    assert abs(auroc.within(bad, ["unit"], score="score").first()["auroc"] - 0.5) < 0.12


def test_chunk_folds_first_ones_are_larger(spark):
    f = rel.chunk_folds(spark.range(6306), [F.col("id")], 5)
    assert [r["count"] for r in f.groupBy("fold").count().orderBy("fold").collect()] == [1262, 1261, 1261, 1261, 1261]


def test_text_functions(spark):
    df = spark.createDataFrame([("```bash\nGit status\n```",), ("no code",), ("```\n  ls -la\n```",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.command(F.col("t"))).collect()] == ["git", "no_command", "ls", "no_command"]
    n = spark.createDataFrame([("about 1,234 and 0.75 of 100",)], "t string").select(tx.numbers(F.col("t")).alias("n"))
    assert n.first()["n"] == ["1,234", "0.75"]
    v = spark.createDataFrame([("0.750",), ("1234",)], "t string").select(tx.number_variants(F.col("t")).alias("v")).collect()
    assert {"0.750", "0.7500", "0.75"} <= set(v[0]["v"]) and {"1234", "1,234"} <= set(v[1]["v"])
    e = spark.createDataFrame([("Error: error, traceback",)], "t string").select(tx.error_count(F.col("t")).alias("n"))
    assert e.first()["n"] == 3


def test_missing_shards_are_skipped(spark, tmp_path):
    a = f"file://{tmp_path}/a.parquet"
    spark.range(3).write.parquet(a)
    assert readers.shards(spark, [a, f"file://{tmp_path}/b.parquet"], ["id"]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.shards(spark, [f"file://{tmp_path}/b.parquet"], ["id"])


def test_resume_appends_what_is_missing(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert writers.resume(spark.range(5), ["id"], path) == 5
    assert writers.resume(spark.range(8), ["id"], path) == 3
    assert writers.resume(spark.range(8), ["id"], path) == 0
    assert spark.read.parquet(path).count() == 8


def test_streaming_sessions_equal_batch(spark, tmp_path):
    from rerunlab.streaming import prefix_monitor as pm

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_type")
    events.coalesce(2).write.parquet(f"file://{tmp_path}/in")
    late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("view").alias("event_type"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(f"file://{tmp_path}/in")
    pm.run_to_table(pm.session_features(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    late.write.mode("append").parquet(f"file://{tmp_path}/in")
    pm.run_to_table(pm.session_features(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    got = spark.read.parquet(f"file://{tmp_path}/out").select("session_window.start", "user_id", "steps", "errors")
    want = pm.session_features(events).select("session_window.start", "user_id", "steps", "errors")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_padded_batches_equal_a_walk(spark):
    rng = np.random.default_rng(5)
    for budget, most in ((50, 8), (30, 3), (1, 8), (1000, 4)):
        sizes = [int(x) for x in rng.integers(0, 25, 120)]
        df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(5)
        want, batch, held = {}, 0, []
        for size, i in sorted((s, i) for i, s in enumerate(sizes)):
            held.append(i)
            want[i] = batch
            if len(held) * size >= budget or len(held) >= most:
                batch, held = batch + 1, []
        assert {r["id"]: r["batch"] for r in rel.padded_batches(df, "size", "id", budget, most).collect()} == want


def test_synthetic_monitors_reach_their_target(spark, runs):
    rated = runs.withColumn("rate", F.lit(0.2) + F.pmod(F.xxhash64("unit"), F.lit(7)) / 10).withColumn("run", F.xxhash64("unit", "run"))
    key = "run"
    for kind in "ABD":
        x = inference.separation(rated, ["unit"], key, kind, 0.7, rounds=10)
        got = auroc.within(inference.monitor_scores(rated, ["unit"], key, kind, x), ["unit"]).first()["auroc"]
        assert abs(got - 0.7) < 0.05, kind
    flipped = rated.withColumn("y", 1 - F.col("y"))
    same = inference.monitor_scores(rated, ["unit"], key, "B", 0.0), inference.monitor_scores(flipped, ["unit"], key, "B", 0.0)
    assert same[0].select(key, "s").exceptAll(same[1].select(key, "s")).count() == 0  # labels do not leak


def test_rank_form_equals_the_histogram_form(runs):
    a, b = auroc.pooled(runs).first(), auroc.pooled_by_rank(runs).first()
    assert tuple(a) == pytest.approx(tuple(b))
