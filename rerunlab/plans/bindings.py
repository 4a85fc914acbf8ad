"""Run, step and message tables made from the test tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_runs(spark: SparkSession, d: str) -> DataFrame:
    """Many repeats, 11 scores: unit, y, s, cost."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("unit"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_discount").alias("s"), F.col("l_extendedprice").alias("cost"), F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("status")
    )


PART_RUNS = "runs AS (SELECT l_partkey AS unit, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount AS s, l_extendedprice AS cost, l_suppkey AS supplier, l_linestatus AS status FROM lineitem)"


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    """Moderate repeats, continuous scores, some units with one outcome: unit, model, y, s, run."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("s"), F.col("o_orderkey").alias("run")
    )


ORDER_RUNS = "runs AS (SELECT o_custkey AS unit, o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS s, o_orderkey AS run FROM orders)"


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a user's day: user_id, day, step (from 1), act, obs, err."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("act"), F.col("value").alias("obs"))
    w = Window.partitionBy("user_id", "day").orderBy("ts")
    return e.withColumn("step", F.row_number().over(w)).withColumn("err", (F.col("act") == "error").cast("int")).drop("ts")


EVENT_STEPS = """steps AS (SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS step,
  event_type AS act, value AS obs, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err FROM events)"""
RUN = ["user_id", "day"]


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded: sums differ in their last bits with the order of addition."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
