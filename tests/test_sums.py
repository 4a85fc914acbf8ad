"""Equal sums are equal, in whatever order they are added."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rerunlab.functions.sums import exact_sum
from rerunlab.operators import outcome


def test_equal_costs_are_ranked_by_task(spark):
    rows = [(t, c, i % 2) for t, costs in ((1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.3)), (3, (0.2, 0.3, 0.1)), (0, (0.1, 0.2, 0.3))) for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "task long, cost double, y int").coalesce(1)
    assert 0.3 + 0.2 + 0.1 != 0.1 + 0.2 + 0.3
    assert [r["task"] for r in outcome.priority(df).orderBy("place").collect()] == [0, 1, 2, 3]


def test_sums_that_are_not_decimal_stay_plain(spark):
    df = spark.createDataFrame([(1e-13,), (2e-13,), (None,), (1e30,)], "x double").coalesce(1)
    assert df.agg(exact_sum(F.col("x"))).first()[0] == pytest.approx(1e30)
    assert df.where("x < 1").agg(exact_sum(F.col("x"))).first()[0] == pytest.approx(3e-13)
