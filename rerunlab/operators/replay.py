"""Replay of allocation policies under a cost budget.

A pull draws one of a task's recorded runs with replacement; its cost, outcome, score and
length stay together. A success retires the task. A pull is made while less than the
budget is spent, so the last may overshoot. Tasks are walked in key order.

Draws are made by joins: the run that the n-th pull of a task meets in a trial depends on
the task, the trial and n alone, so every policy meets the same runs (paired trials) and
recorded runs stay in their table, however many there are. A trial's simulation, which is
sequential, holds a few numbers for each task and the draws made ready for it; trials
that use up a task's draws are run again with four times as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import beta_survival, uniform

COLUMNS = "policy string, budget double, trial int, solved int, spent double, pulls int, aborted int, enough boolean"
#: Draws made ready for each task of a trial at first, and the most ever.
READY, MOST = 32, 1 << 22
#: Draws up to which recorded runs are looked up in place.
FEW = 500_000
#: Cells into which a task's runs are dealt to be numbered, one for so many of all runs.
PER_CELL = 1_000_000

#: Policies by name, as a way to choose the next task and what happens to a run.
POLICIES = {
    "round_robin": ("walk", ""), "static": ("static", ""), "greedy": ("greedy", ""), "oracle": ("oracle", ""),
    "cold": ("thompson", ""), "warm": ("thompson", "prior"), "warm_cost": ("thompson", "prior cost"),
    "give_up": ("thompson", "prior give_up"), "abort": ("walk", "abort"), "hybrid": ("thompson", "prior abort"),
    "capped": ("walk", "cap"), "capped_curve": ("walk", "cap_curve"), "warm_capped": ("thompson", "prior cap"),
    "routed": ("thompson", "route"), "routed_pure": ("thompson", "route pure"), "routed_prior": ("thompson", "prior route"),
    "fair_abort": ("thompson", "prior fair"),
}


def cost_through(k: int, cost="cost", steps="steps", cum: str | None = None):
    """What a run has cost when it is stopped after turn ``k``: from the running costs
    ``cum`` where there are any, else its cost in proportion to its turns."""
    share = F.col(cost) * F.try_divide(F.least(F.lit(k), F.col(steps)), F.col(steps))
    share = F.coalesce(share, F.col(cost))
    if cum is None:
        return share
    return F.when(F.size(cum) > 0, F.try_element_at(cum, F.least(F.lit(k), F.size(cum)))).otherwise(share)


def bench(runs: DataFrame, priors: DataFrame | None = None, abort_turn: int = 5, cap: int | None = None) -> DataFrame:
    """A row for each run: task, index (from 0 in its task), cost, win, s, steps, early (cost
    through the abort turn), capped (cost through the cap), and of its task: n, mean_cost,
    truth (share of successes), mean_score, alpha and beta (prior counts of ``priors``: task,
    alpha, beta). ``runs``: task, y, cost and, where known, s, steps and cum."""
    have = runs.columns
    cum = "cum" if "cum" in have else None
    rows = runs.select(
        "task", F.col("cost").cast("double").alias("cost"), (1 - F.col("y")).cast("int").alias("win"),
        (F.col("s") if "s" in have else F.lit(0.0)).cast("double").alias("s"), (F.col("steps") if "steps" in have else F.lit(1)).cast("int").alias("steps"), *([cum] if cum else []),
    )
    rows = rows.withColumn("early", cost_through(abort_turn, cum=cum)).withColumn("capped", cost_through(cap, cum=cum) if cap else F.col("cost")).drop("cum")
    order = ["cost", "win", "s", "steps", "early", "capped"]
    cells = max(1, -(-runs.count() // PER_CELL))
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = dealt.groupBy("task", "_cell").agg(F.count(F.lit(1)).alias("_m"), F.sum("cost").alias("_c"), F.sum("win").alias("_w"), F.sum("s").alias("_s"))
    of_task = Window.partitionBy("task")
    before = of_task.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_m").over(of_task)
    tasks = counts.select(
        "task", "_cell", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"), n.alias("n"), F.greatest(F.sum("_c").over(of_task) / n, F.lit(1.0)).alias("mean_cost"),
        (F.sum("_w").over(of_task) / n).alias("truth"), (F.sum("_s").over(of_task) / n).alias("mean_score"),
    )
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("task", "_cell").orderBy(*order)) - 1).join(tasks, ["task", "_cell"])
    out = numbered.withColumn("index", F.col("_start") + F.col("_i")).drop("_cell", "_start", "_i")
    return with_priors(out, priors)


def with_priors(b: DataFrame, priors: DataFrame | None) -> DataFrame:
    """``b`` under other prior counts, one each for tasks without. A row a task is broadcast,
    as every trial holds; runs stay where they are."""
    b = b.withColumn("alpha", F.lit(1.0)).withColumn("beta", F.lit(1.0))
    if priors is None:
        return b
    counts = priors.select("task", F.col("alpha").cast("double"), F.col("beta").cast("double"))
    return b.drop("alpha", "beta").join(F.broadcast(counts), "task", "left").fillna(1.0, ["alpha", "beta"])


def draws(b: DataFrame, trials: list[int], ready: int, seed: int) -> DataFrame:
    """trial, task and its numbers, costs, wins, scores, steps, early, capped: the runs that
    a task's first ``ready`` pulls meet in a trial."""
    tasks = ["task", "n", "mean_cost", "truth", "mean_score", "alpha", "beta"]
    pulls = b.where("index = 0").select(*tasks).withColumn("trial", F.explode(F.array(*(F.lit(t) for t in trials)))).withColumn("pull", F.explode(F.sequence(F.lit(0), F.lit(ready - 1))))
    met = pulls.withColumn("index", F.floor(uniform(F.col("task"), F.col("trial"), F.col("pull"), seed=seed) * F.col("n")).cast("long"))
    run = ["cost", "win", "s", "steps", "early", "capped"]
    if len(trials) * ready * b.where("index = 0").count() <= FEW:
        met = F.broadcast(met)  # all recorded runs stay where they are
    joined = met.join(b.select("task", "index", *run), ["task", "index"])
    listed = joined.groupBy("trial", *tasks).agg(F.array_sort(F.collect_list(F.struct("pull", *run))).alias("r"))
    return listed.select("trial", *tasks, *(F.col(f"r.{c}").alias(c) for c in run))


class UsedUp(Exception):
    """A task's draws are used up."""


class Trial:
    """One simulation over the tasks of ``d`` (rows of ``draws``, in the order of task)."""

    def __init__(self, d: pd.DataFrame, policy: str, budget: float, seed: int, threshold: float = np.inf, cap: int | None = None, calibration: tuple[list[float], list[float], float] | None = None, give_up: float = 0.1):
        self.choice, how = POLICIES[policy]
        self.how, self.d, self.budget, self.threshold, self.cap, self.calibration, self.give_up = how.split(), d, budget, threshold, cap, calibration, give_up
        self.rng = np.random.default_rng(seed)
        n = len(d)
        self.runs = {c: [np.asarray(x) for x in d[c]] for c in ("cost", "win", "s", "steps", "early", "capped")}
        self.mean, self.truth, self.score = (d[c].to_numpy(float) for c in ("mean_cost", "truth", "mean_score"))
        prior = d[["alpha", "beta"]].to_numpy(float)
        self.counts = prior.copy() if "prior" in self.how else np.ones((n, 2))
        self.evidence = np.zeros((n, 2))
        self.ranked = np.argsort(-(prior[:, 0] / prior.sum(axis=1) / self.mean), kind="stable")
        self.alive, self.tried, self.won = np.ones(n, bool), np.zeros(n, int), np.zeros(n, int)
        self.spent, self.solved, self.pulls, self.aborted, self.at = 0.0, 0, 0, 0, 0
        self.curve: list[tuple[float, int]] = []
        self.shuffled = self.rng.permutation(n)

    def walk(self, order: np.ndarray) -> int:
        """The next task alive; the pointer moves on every look and wraps."""
        while True:
            t = order[self.at % len(order)]
            self.at += 1
            if self.alive[t]:
                return int(t)

    def best(self, value: np.ndarray) -> int:
        return int(np.argmax(np.where(self.alive, value, -np.inf)))

    def choose(self) -> int | None:
        if self.choice == "walk":
            return self.walk(self.shuffled)
        if self.choice == "static":
            return self.walk(self.ranked)
        if self.choice == "oracle":
            t = self.best(self.truth / self.mean)
            return t if self.truth[t] > 0 else None
        if self.choice == "greedy":  # on its own history: unseen tasks first
            new = np.flatnonzero(self.alive & (self.tried == 0))
            return int(new[0]) if len(new) else self.best(self.won / np.maximum(self.tried, 1) / self.mean)
        a, b = np.maximum(self.counts + self.evidence, 1e-3).T
        rate, cost = self.rng.beta(a, b), self.mean
        if "cost" in self.how:  # the cost too is drawn, from the task's recorded runs
            cost = np.array([c[self.rng.integers(len(c))] for c in self.runs["cost"]])
        return self.best(rate / np.maximum(cost, 1.0))

    def calibrated(self, s: float) -> float:
        edges, rates, _ = self.calibration
        return rates[int(np.searchsorted(edges, s, side="right"))]

    def settle(self, t: int, i: int) -> tuple[float, int]:
        """What pull ``i`` of task ``t`` is charged and credited."""
        cost, win, s, steps, early, capped = (self.runs[c][t][i] for c in ("cost", "win", "s", "steps", "early", "capped"))
        if "abort" in self.how and s >= self.threshold:
            self.aborted += 1
            return early, 0
        if "fair" in self.how:  # stops a run whose calibrated failure rate passes the break-even
            fail = self.calibrated(s)
            if fail > max(0.5, self.calibration[2]) and fail > self.score[t]:
                self.aborted += 1
                return early, 0
        if "cap" in self.how and steps > self.cap:
            return capped, 0
        if "cap_curve" in self.how:  # charged by the running costs, whether cut or not
            return capped, int(win and steps <= self.cap)
        return cost, win

    def run(self) -> "Trial":
        while self.spent < self.budget and self.alive.any():
            t = self.choose()
            if t is None:
                break
            i = self.tried[t]
            if i >= len(self.runs["cost"][t]):
                raise UsedUp
            cost, win = self.settle(t, i)
            s = float(self.runs["s"][t][i])
            self.spent += float(cost)
            self.pulls += 1
            self.tried[t] += 1
            self.won[t] += int(win)
            if "route" in self.how:  # the monitor's view of the run drawn
                self.evidence[t] += (1 - s, s)
            if win:
                self.solved += 1
                self.alive[t] = False
                self.curve.append((self.spent, self.solved))
            elif "pure" not in self.how:
                self.counts[t, 1] += 1
                if "give_up" in self.how and beta_survival(self.give_up, *map(float, self.counts[t])) < 0.05:
                    self.alive[t] = False
        return self


def calibration(runs: DataFrame, bins: int = 10, least: int = 20) -> tuple[list[float], list[float], float]:
    """Inner edges of ``bins`` score quantiles, the failure rate in each bin (the base rate
    where fewer than ``least`` runs are), and the base rate."""
    edges = runs.agg(F.percentile_approx("s", F.array(*(F.lit(i / bins) for i in range(1, bins))), 100_000).alias("e"), F.avg("y").alias("b")).first()
    cuts, base = list(edges["e"] or []), float(edges["b"] or 0.0)
    place = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col("s"))) if cuts else F.lit(0)
    found = {r["p"]: r["r"] for r in runs.groupBy(place.alias("p")).agg(F.avg("y").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}  # a row a bin
    return cuts, [float(found.get(i, base)) for i in range(len(cuts) + 1)], base


def _rounds(b: DataFrame, jobs: list[tuple[str, float]], trials: list[int], seed: int, **how) -> tuple[list[tuple], int]:
    """A row for each job and trial, and the draws that sufficed for all."""
    thresholds = how.pop("thresholds", None) or {}
    out, ready, left = [], READY, list(trials)
    while left:
        if ready > MOST:
            raise ValueError("runs that cost nothing and never succeed use up no budget")

        def simulate(frames: pd.DataFrame) -> pd.DataFrame:
            d, rows = frames.sort_values("task", ignore_index=True), []
            trial = int(d.trial[0])
            for policy, budget in jobs:
                t = Trial(d, policy, budget, seed + trial, thresholds.get((policy, budget), np.inf), **how)
                try:
                    t.run()
                    rows.append((policy, budget, trial, t.solved, t.spent, t.pulls, t.aborted, True))
                except UsedUp:
                    rows.append((policy, budget, trial, 0, 0.0, 0, 0, False))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

        rows = draws(b, left, ready, seed).groupBy("trial").applyInPandas(simulate, COLUMNS).collect()  # jobs times trials
        short = {r["trial"] for r in rows if not r["enough"]}
        out += [tuple(r)[:-1] for r in rows if r["trial"] not in short]
        left = sorted(short)
        ready = 4 * ready if left else ready
    return out, ready


def trials(b: DataFrame, spark: SparkSession, policies: list[str], budgets: list[float], n: int, seed: int = 9000, **how) -> DataFrame:
    """One row for each policy, budget and trial. ``how``: thresholds (by policy and
    budget), cap (turns), calibration, give_up."""
    rows, _ = _rounds(b, [(p, float(x)) for p in policies for x in budgets], list(range(n)), seed, **how)
    return spark.createDataFrame(rows, COLUMNS.rsplit(", ", 1)[0])


def spending_curve(b: DataFrame, policies: list[str], budget: float, n: int, seed: int = 9000, **how) -> DataFrame:
    """policy, trial, spent, solved after every success."""
    _, ready = _rounds(b, [(p, float(budget)) for p in policies], list(range(n)), seed, **how)

    def simulate(frames: pd.DataFrame) -> pd.DataFrame:
        d = frames.sort_values("task", ignore_index=True)
        trial = int(d.trial[0])
        out = [(p, trial, s, k) for p in policies for s, k in Trial(d, p, budget, seed + trial, **how).run().curve]
        return pd.DataFrame(out, columns=["policy", "trial", "spent", "solved"])

    return draws(b, list(range(n)), ready, seed).groupBy("trial").applyInPandas(simulate, "policy string, trial int, spent double, solved int")


def tuned_thresholds(b: DataFrame, spark: SparkSession, policies: list[str], budgets: list[float], n: int, quantiles: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)) -> dict[tuple[str, float], float]:
    """For each policy and budget the score quantile under which most is solved on the
    tuning tasks; the first best wins."""
    cuts = b.agg(F.percentile_approx("s", F.array(*(F.lit(q) for q in quantiles)), 100_000)).first()[0] or []
    best: dict[tuple[str, float], tuple[float, float]] = {}
    for cut in cuts:
        rows = trials(b, spark, policies, budgets, n, 50_000, thresholds={(p, float(x)): cut for p in policies for x in budgets})
        for r in rows.groupBy("policy", "budget").agg(F.avg("solved").alias("m")).collect():  # policies times budgets rows
            key = (r["policy"], r["budget"])
            if key not in best or r["m"] > best[key][0]:
                best[key] = (r["m"], cut)
    return {k: v[1] for k, v in best.items()}


def paired(trial_rows: DataFrame, base: str, by: list[str], trial: str = "trial", value: str = "solved") -> DataFrame:
    """Differences to ``base`` on equal trials: mean and 95% percentile interval."""
    a = trial_rows.where(F.col("policy") != base)
    b = trial_rows.where(F.col("policy") == base).select(*by, trial, F.col(value).alias("_base"))
    d = a.join(b, [*by, trial]).withColumn("_d", F.col(value) - F.col("_base"))
    return d.groupBy("policy", *by).agg(F.avg("_d").alias("difference"), F.percentile("_d", 0.025).alias("low"), F.percentile("_d", 0.975).alias("high"), F.count(F.lit(1)).alias("trials"))


def budget_to_reach(curve: DataFrame, goal: int, trials_run: int, base: str | None = None) -> DataFrame:
    """Mean spend at which ``goal`` is reached, undefined unless half the trials reach it; saving against ``base``."""
    first = curve.where(F.col("solved") >= goal).groupBy("policy", "trial").agg(F.min("spent").alias("_at"))
    out = first.groupBy("policy").agg(F.when(F.count(F.lit(1)) >= 0.5 * trials_run, F.avg("_at")).alias("budget"), F.count(F.lit(1)).alias("reached"))
    if base is None:
        return out
    ref = out.where(F.col("policy") == base).select(F.col("budget").alias("_ref"))
    return out.crossJoin(F.broadcast(ref)).withColumn("saving", 1 - F.try_divide(F.col("budget"), F.col("_ref"))).drop("_ref")


def crossing(levels: DataFrame, by: list[str], level: str = "level", low: str = "low") -> DataFrame:
    """The least level whose interval lies above zero; NULL where none does."""
    return levels.groupBy(*by).agg(F.min(F.when(F.col(low) > 0, F.col(level))).alias("crossing"))
