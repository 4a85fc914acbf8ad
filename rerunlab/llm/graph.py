"""Connected components of a link table by alternating large-star and small-star
steps. Links stay in tables; the driver sees two numbers for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, join_hot


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
    linked = join_hot(both, least, "u", "n", 2 * rows)
    return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours link to the least of them (a > b in every link)."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    linked = join_hot(down, least, "u", "n", rows)
    moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: long columns a, b. Returns node, component (the least node reachable)
    for every linked node but that least one. No links give no rows."""
    table = Table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        rows, mark = table.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()  # whatever the order of rows
        if not rows or (rows, mark) == state:
            break
        state = (rows, mark)
        star = Table(_large_star(table.df, rows))
        settled = Table(_small_star(star.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows))
        table.drop()
        star.drop()
        table = settled
    return table.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
