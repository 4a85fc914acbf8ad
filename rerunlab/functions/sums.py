"""Sums of doubles that do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def exact_sum(c: Column, over: WindowSpec | None = None) -> Column:
    """The double nearest to the sum of numbers with up to ten decimals, so that equal sums
    are equal doubles; the plain sum where a number has more or is too large."""
    def of(x: Column) -> Column:
        return x if over is None else x.over(over)

    d = c.try_cast("decimal(38,10)")
    whole = of(F.count(F.when(d.cast("double") == c, F.lit(1)))) == of(F.count(c))
    return F.coalesce(F.when(whole, of(F.try_sum(d)).cast("double")), of(F.sum(c)))
