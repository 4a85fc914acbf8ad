"""The registered queries: operators bound to tables, each with SQL that states the same result independently."""

from . import inference, metrics, outcomes, predictors, relational, replays, scans, steps  # noqa: F401
