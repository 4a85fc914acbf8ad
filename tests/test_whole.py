"""Registered queries hand the whole data to their operators."""

from __future__ import annotations

import pytest
from rerunlab.operators import predict
from rerunlab.plans import inference, predictors

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def caught(monkeypatch, module, name, run):
    def stop(*args, **how):
        raise Seen(args, how)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Seen) as e:
        run()
    return e.value.args


def test_network_probe_sees_every_component(spark, monkeypatch):
    (columns,), how = caught(monkeypatch, predict, "network", lambda: predictors.e09(spark, SF))
    assert columns == [f"x{i}" for i in range(64)] and how.get("hidden", 64) == 64


def test_text_logistic_has_4000_terms(spark, monkeypatch):
    _, how = caught(monkeypatch, predict, "text_logistic", lambda: predictors.e06(spark, SF))
    assert how.get("features", 4000) == 4000


def test_power_over_all_runs_and_draws(spark, monkeypatch):
    args, _ = caught(monkeypatch, inference.inf, "power", lambda: inference.i09(spark, SF))
    assert args[0].count() == spark.read.parquet(f"{SF}/orders.parquet").count() and args[4] == 2000
