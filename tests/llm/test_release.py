"""The driver gives back native memory that its JVM has freed."""

from __future__ import annotations

from rerunlab.llm import common


def test_release_trims(spark, monkeypatch):
    trim, said = common.trim, []
    monkeypatch.setattr(common, "trim", lambda s: said.append(trim(s)))
    common.release(spark)
    assert len(said) == 1 and "Trim native heap" in said[0]
