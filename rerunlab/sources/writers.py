"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_json(df: DataFrame, path: str) -> None:
    """Metrics in long form, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def sharded_parquet(df: DataFrame, path: str, shard_rows: int) -> None:
    """Files of at most ``shard_rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).parquet(path)


def jsonl(df: DataFrame, path: str, keys: list[str]) -> None:
    """A fixed set of keys, nulls written too."""
    df.select(*keys).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def filtered_copy(df: DataFrame, keep: Column, path: str) -> None:
    """A filter streamed from scan to file; no more than a batch is held."""
    df.where(keep).write.mode("overwrite").parquet(path)


def resume(df: DataFrame, key: list[str], path: str) -> int:
    """Append the rows whose keys the table at ``path`` lacks; returns how many. The
    committer makes each append atomic."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(path))
    todo = df.join(spark.read.parquet(path).select(*key), key, "left_anti") if there else df
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def with_rejects(df: DataFrame, ok: Column, path: str, rejects: str) -> None:
    """Good rows as parquet, the others as a CSV log."""
    df.where(ok).write.mode("overwrite").parquet(path)
    df.where(~F.coalesce(ok, F.lit(False))).write.mode("overwrite").csv(rejects, header=True)


def id_list(df: DataFrame, column: str, path: str) -> None:
    """Sorted ids, one a line, in one file: a list a person reads."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame, rows: int = 50) -> str:
    """An aligned table."""
    return df._show_string(rows, truncate=False)
