"""Helpers shared by the corpus operators: the cluster's shared folder, stable
row ids, joins that survive hot keys and gapless numbering without one task
holding a whole group."""

from __future__ import annotations

import atexit
import gc
import importlib.util
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only by a local master whose session names no ``spark.checkpoint.dir`` (tests).
FALLBACK_DIR = "file:///tmp/checkpoints/rerunlab"

#: After so many tables the driver is asked to forget finished steps.
RELEASE = 3
#: Characters of a written table's plan that the driver keeps for its listing of queries.
PLAN_TEXT = "2000"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the folder that driver and executors share."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = FALLBACK_DIR
    path = f"{base.rstrip('/')}/rerunlab-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_rerunlab_sent", False):
        return
    top = os.path.dirname(importlib.util.find_spec(__package__.partition(".")[0]).origin)
    path = os.path.join(tempfile.mkdtemp(), "rerunlab.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._rerunlab_sent = True


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished steps: their plans go, and with them, by Spark's
    cleaner, the shuffle files that nothing can ask for any more; native memory that is
    free goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Let the driver's JVM return native memory that it has freed (compilers and buffers leave
    much of it with the allocator). What the JVM says; None where it has no such command."""
    jvm = spark.sparkContext._jvm
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, PySparkException):
        return None


def clean_up() -> None:
    """Delete every folder this process wrote; runs when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended; what lies on this machine can still go
            if path.startswith("file:"):
                shutil.rmtree(path[5:].replace("//", "/"), ignore_errors=True)


atexit.register(clean_up)


class Table:
    """A DataFrame cut from its lineage: written to the shared folder and read back."""

    def __init__(self, df: DataFrame, *, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        conf, limit = self.spark.conf, "spark.sql.maxPlanStringLength"
        before = conf.get(limit)
        conf.set(limit, PLAN_TEXT)  # the driver keeps the text of every plan of the last thousand
        try:
            writer.parquet(self.path)
        finally:
            conf.set(limit, before)
        if len(_written) % RELEASE == 0:
            release(self.spark)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself where it only reads, filters and projects, so that its rows come in
    one order every time; else written once, as rows behind a shuffle may come in another."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if re.search("Exchange|Join|Aggregate|Sort|Window|Limit|Sample|Python|Pandas|Arrow", plan):
        return Table(df).df
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Number rows by their place in the scan. The files and splits of a scan do
    not change between jobs, so a retried task gives its rows the same ids."""
    ship(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int, most: int | None = None) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose ``weight`` counts the key's
    rows in ``left``. Keys with over a thousandth of all rows (so fewer than 1,000
    of them) are broadcast, where there are any; the others are shuffled, none of them hot.
    ``most`` is the largest weight, if known."""
    limit = max(1000, rows // 1000)
    if most is None:
        most = right.agg(F.max(weight)).first()[0] or 0
    if most <= limit:  # as a rule: one join, nothing sent to the driver
        return left.join(right.hint("merge"), key)
    hot = right.where(F.col(weight) > limit)
    rest = right.where(F.col(weight) <= limit)
    marked = left.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    a = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key)
    b = marked.where(F.col("_hot").isNull()).drop("_hot").join(rest.hint("merge"), key)
    return a.unionByName(b)


def gapless(df: DataFrame, group: list[str], spread: list[str], out: str, rows: int, per_task: int = 50_000, sizes: dict[int, int] | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2 … without holding a group in one task:
    rows are dealt into cells by a hash of ``spread``, each cell is numbered by
    itself and starts where the cells before it end. Only the cells' counts, about
    one for ``per_task`` rows, are put in order together. ``rows`` is the size of a
    group; ``sizes`` has it by the value of a single integer group column whose values are few."""
    if sizes:
        large = {k: -(-n // per_task) for k, n in sizes.items() if n > per_task}
        cells = F.lit(1)
        if large:
            lookup = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))
            cells = F.coalesce(F.element_at(lookup, F.col(group[0]).cast("int")), F.lit(1))
    else:
        cells = F.lit(max(1, -(-rows // per_task)))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*spread), cells).cast("int"))
    keys = [*group, "_cell"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_cell")
    starts = counts.withColumn("_start", F.sum("_n").over(over) - F.col("_n")).drop("_n")
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*spread)) - 1)
    return local.join(starts, keys).withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_cell", "_start", "_at")
