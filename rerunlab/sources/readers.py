"""Sources: files of runs, trajectories and predictions as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OUTCOMES = T.StructType([T.StructField("task", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("success", T.IntegerType()), T.StructField("tokens", T.IntegerType())])
TRAJECTORY = "steps array<struct<source:string,tool_calls:array<struct<function_name:string>>,message:string,observation:string>>"


def shards(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Columns of the parquet shards that exist; a missing one is skipped."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    if not there:
        raise FileNotFoundError(f"none of {len(paths)} shards exists")
    return spark.read.parquet(*there).select(*columns)


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def json_column(df: DataFrame, column: str, schema: str = TRAJECTORY) -> DataFrame:
    """A JSON string column parsed; rows that do not parse go."""
    return df.withColumn(column, F.from_json(column, schema)).where(F.col(column).isNotNull())


def outcome_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTCOMES).csv(path, header=True)


def run_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each run, its task and run taken from ``<task>_run<N>.json``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = spark.read.schema(schema).json(path, multiLine=True).withColumn("_name", name)
    pattern = r"^(.*)_run(\d+)\.json$"
    return df.select(F.regexp_extract("_name", pattern, 1).alias("task"), F.regexp_extract("_name", pattern, 2).try_cast("int").alias("run"), *[c for c in df.columns if c != "_name"]).where("run IS NOT NULL")


def vectors(spark: SparkSession, path: str, column: str, where: Column | None = None) -> DataFrame:
    """A slice of a vector archive."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).withColumn("x", F.transform(column, lambda v: v.cast("double"))).drop(column)


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("length(id) > 0")


def numeric_rows(df: DataFrame, key: str) -> DataFrame:
    """Columns other than the key as doubles; rows with any cell that is none go."""
    others = [c for c in df.columns if c != key]
    return df.select(key, *(F.col(c).try_cast("double").alias(c) for c in others)).dropna("any", subset=others)


def widest(df: DataFrame, by: str, vector: str, *ties: str) -> DataFrame:
    """For each ``by`` the row with the longest vector."""
    w = Window.partitionBy(by).orderBy(F.desc(F.size(vector)), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def simulations(spark: SparkSession, path: str) -> DataFrame:
    """Runs of ``<model>_<domain>_<config>_….json`` files; a null reward is skipped."""
    schema = "simulations array<struct<task_id:string,reward_info:struct<reward:double>>>"
    parts = F.split(F.element_at(F.split(F.input_file_name(), "/"), -1), "_")
    df = spark.read.schema(schema).json(path, multiLine=True)
    rows = df.select(parts[0].alias("model"), parts[1].alias("domain"), parts[2].alias("config"), F.explode("simulations").alias("s"))
    return rows.where("s.reward_info.reward IS NOT NULL").select("model", "domain", "config", F.col("s.task_id").alias("task"), (1 - F.bround("s.reward_info.reward", 0)).cast("int").alias("y"))


def pick(columns: list[str], names: list[str]) -> str | None:
    """The first of ``names`` that a column equals, else that it contains, ignoring case."""
    low = {c.lower(): c for c in columns}
    for n in names:
        if n in low:
            return low[n]
    return next((c for n in names for c in columns if n in c.lower()), None)


def sniffed_outcomes(df: DataFrame) -> DataFrame:
    """model, task, y from a table of unknown layout; outcomes are words or numbers."""
    roles = {"model": ["model", "agent", "system"], "task": ["task", "instance", "case", "problem"], "outcome": ["resolved", "success", "outcome", "passed", "score", "reward", "status"]}
    found = {r: pick(df.columns, names) for r, names in roles.items()}
    if found["task"] is None or found["outcome"] is None:
        raise ValueError(f"no task or outcome column among {df.columns}")
    word = F.lower(F.trim(F.col(found["outcome"]).cast("string")))
    ok = F.when(word.isin("true", "yes", "pass", "passed", "success", "resolved"), True).otherwise(F.coalesce(word.try_cast("double") >= 1.0, F.lit(False)))
    model = F.col(found["model"]).cast("string") if found["model"] else F.lit("all")
    return df.select(model.alias("model"), F.col(found["task"]).cast("string").alias("task"), F.when(ok, 0).otherwise(1).alias("y"))


def text_files(spark: SparkSession, path: str, glob: str, most_bytes: int) -> DataFrame:
    """path, content of files by extension and size."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.where(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("content"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def folds(frames: list[DataFrame], out: str = "fold") -> DataFrame:
    """Predictions of several folds, the fold as a column."""
    tagged = [f.withColumn(out, F.lit(i)) for i, f in enumerate(frames)]
    first = tagged[0]
    for f in tagged[1:]:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def turn_cuts(df: DataFrame, segments: str, n_tokens: Column, most: int) -> DataFrame:
    """Cut points of a tokenised run: the last token of each assistant segment, inside the first ``most`` tokens."""
    turns = F.filter(segments, lambda s: s["role"] == "assistant")
    rows = df.select("*", F.posexplode(turns).alias("k", "_s")).withColumn("pos", F.least(F.col("_s")["end_token"], n_tokens) - 1)
    return rows.where((F.col("pos") >= 0) & (F.col("pos") < most)).drop("_s", segments)


def first_of(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in order of preference, the first row of each key kept."""
    ranked = folds(frames, "_source")
    w = Window.partitionBy(key).orderBy("_source", *sorted(c for c in ranked.columns if c not in (key, "_source")))
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def unpivot_scores(df: DataFrame, ids: list[str], prefix: str = "prob__") -> DataFrame:
    """The dynamic set of score columns as model, score rows."""
    return df.unpivot(ids, [c for c in df.columns if c.startswith(prefix)], "model", "score")
