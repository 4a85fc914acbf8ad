"""Queries of sources and sinks. Files for the readers are written first, to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import register
from ..sources import readers, writers
from .bindings import order_runs, part_runs, rounded, table

FALLBACK_DIR = "file:///tmp/checkpoints/rerunlab"


def folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR
    return f"{base.rstrip('/')}/scans-{uuid.uuid4().hex}"


@register("s01_sharded_scan", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_quantity > 45")
def s01(spark, d):
    df = readers.shards(spark, [f"{d}/lineitem.parquet", f"{d}/lineitem_2.parquet"], ["l_orderkey", "l_discount", "l_quantity"])
    return df.where("l_quantity > 45").select("l_orderkey", "l_discount")


@register("s02_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def s02(spark, d):
    return readers.parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@register("s03_json_column", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s03(spark, d):
    return readers.json_column(table(spark, d, "events"), "props", "k int").select("event_id", "props.k")


OUTCOME = "SELECT CAST(o_custkey AS VARCHAR) AS task, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS run, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS success, CAST(floor(o_totalprice) AS INTEGER) AS tokens FROM orders"


def outcomes(spark, d):
    o = order_runs(spark, d)
    return o.select(F.col("unit").cast("string").alias("task"), F.row_number().over(Window.partitionBy("unit").orderBy("run")).alias("run"), (1 - F.col("y")).alias("success"), F.floor("s").cast("int").alias("tokens"))


@register("s04_outcome_csv", OUTCOME)
def s04(spark, d):
    path = folder(spark)
    outcomes(spark, d).write.csv(path, header=True)
    return readers.outcome_csv(spark, path)


@register("s05_run_files", "SELECT 'task' || i AS task, CAST(i + 1 AS INTEGER) AS run, 2 AS commands FROM (SELECT unnest(range(0, 4)) AS i)")
def s05(spark, d):
    """One file for each run; the task and run come back from its name."""
    path = folder(spark)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    for i in range(4):
        out = fs.create(hadoop.Path(f"{path}/task{i}_run{i + 1}.json"))
        out.write(bytearray(f'{{"command_history": ["ls", "cat x{i}"]}}'.encode()))
        out.close()
    return readers.run_files(spark, path, "command_history array<string>").select("task", "run", F.size("command_history").alias("commands"))


@register("s06_vector_slice", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3")
def s06(spark, d):
    v = readers.vectors(spark, f"{d}/embeddings.parquet", "embedding", F.col("label") == 3)
    return rounded(v.select("vec_id", "label", F.element_at("x", 1).alias("first")), 6)


@register("s07_episode_jsonl", "SELECT conv_id, count(*) AS steps, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id")
def s07(spark, d):
    path = folder(spark)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("steps"))
    writers.jsonl(c, path, ["conv_id", "steps"])
    e = readers.jsonl(spark, path, "conv_id long, steps array<struct<turn:long,role:string>>")
    return e.select("conv_id", F.size("steps").cast("long").alias("steps"), F.exists("steps", lambda s: s["role"] == "system").alias("has_system"))


@register("s08_id_list", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 9000")
def s08(spark, d):
    path = folder(spark)
    ids = table(spark, d, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("v"))
    ids.unionByName(spark.createDataFrame([("",), ("   ",)], "v string")).coalesce(1).write.text(path)
    return readers.id_list(spark, path)


@register("s09_numeric_rubric", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_size::DOUBLE AS size, p_retailprice AS price FROM part WHERE p_partkey % 7 <> 0")
def s09(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    return readers.numeric_rows(raw, "id")


@register("s09w_widest_vector", "SELECT label, max(40 + vec_id % 20)::INTEGER AS width FROM embeddings GROUP BY label")
def s09w(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.slice("embedding", F.lit(1), (40 + F.col("vec_id") % 20).cast("int")).alias("x"))
    return readers.widest(e, "label", "x", "vec_id").select("label", F.size("x").alias("width"))


@register("s10_simulations", "SELECT m AS model, 'airline' AS domain, 'base' AS config, '1' AS task, y FROM (VALUES ('m1'), ('m2')) a(m), (VALUES (0), (1)) b(y)")
def s10(spark, d):
    path = folder(spark)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    for model in ("m1", "m2"):
        out = fs.create(hadoop.Path(f"{path}/{model}_airline_base_user_4trials.json"))
        out.write(bytearray(b'{"simulations": [{"task_id": "1", "reward_info": {"reward": 1.0}}, {"task_id": "1", "reward_info": {"reward": 0.0}}, {"task_id": "2", "reward_info": null}]}'))
        out.close()
    return readers.simulations(spark, path)


@register("s11_sniffed_outcomes", "SELECT o_orderpriority AS model, CAST(o_custkey AS VARCHAR) AS task, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS y FROM orders")
def s11(spark, d):
    odd = table(spark, d, "orders").select(F.col("o_orderpriority").alias("Agent_Name"), F.col("o_custkey").alias("Instance_ID"), F.when(F.col("o_orderstatus") == "F", " Resolved").when(F.col("o_orderstatus") == "O", "0.0").otherwise("no").alias("final_status"))
    return readers.sniffed_outcomes(odd)


@register("s12_text_corpus")
def s12(spark, d):
    path = folder(spark)
    table(spark, d, "benchmark").select("text").coalesce(1).write.text(path)
    return readers.text_files(spark, path, "*.txt", 5_000_000).select(F.length("content").alias("size"))


@register("s13_stored_results", "SELECT o_orderpriority AS model, count(*) AS runs FROM orders GROUP BY o_orderpriority")
def s13(spark, d):
    path = folder(spark)
    writers.result_json(order_runs(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("runs")), path)
    return readers.jsonl(spark, path, "model string, runs long")


# Published pass^1 to pass^4 in percent.
LEADERBOARD = [
    ("telecom", "gpt-5-2 (2026-02)", 89.69, 82.46, 76.75, 71.93),
    ("telecom", "gemini-3-flash (2026-03)", 91.23, 83.48, 76.54, 70.18),
    ("telecom", "glm-5-think (2026-03)", 86.84, 76.32, 68.20, 62.28),
    ("retail", "gpt-5-2 (2026-02)", 81.58, 69.59, 59.87, 51.75),
    ("retail", "gemini-3-flash (2026-03)", 76.75, 65.94, 57.89, 51.75),
    ("retail", "glm-5-think (2026-03)", 73.68, 60.38, 51.10, 43.86),
]


@register("s14_literal_table", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {w}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for a, b, w, x, y, z in LEADERBOARD) + ") t(domain, model, pass1, pass2, pass3, pass4)")
def s14(spark, d):
    return readers.literal(spark, LEADERBOARD, "domain string, model string, pass1 double, pass2 double, pass3 double, pass4 double")


@register("a21p_mixed_from_passes", "SELECT model, domain, round(4 * p1 - 6 * p2 + 4 * p3 - 2 * p4, 9) AS mixed FROM (VALUES " + ", ".join(f"('{a}', '{b}', {w / 100}::DOUBLE, {x / 100}::DOUBLE, {y / 100}::DOUBLE, {z / 100}::DOUBLE)" for a, b, w, x, y, z in LEADERBOARD) + ") t(domain, model, p1, p2, p3, p4)")
def a21p(spark, d):
    """Share of units with both outcomes in four runs, from pass^1 to pass^4."""
    m = s14(spark, d)
    return rounded(m.select("model", "domain", ((4 * F.col("pass1") - 6 * F.col("pass2") + 4 * F.col("pass3") - 2 * F.col("pass4")) / 100).alias("mixed")))


@register("s15_fold_union", "SELECT o_orderkey AS run, CAST(o_custkey % 3 AS INTEGER) AS fold FROM orders")
def s15(spark, d):
    runs = order_runs(spark, d).select("run", "unit")
    return readers.folds([runs.where(f"unit % 3 = {i}").select("run") for i in range(3)])


@register("s16_turn_cuts", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k, CAST(least((turn + 1) * 10, 55) - 1 AS BIGINT) AS pos FROM conversations WHERE role = 'assistant'")
def s16(spark, d):
    seg = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.struct(s["role"].alias("role"), ((s["turn"] + 1) * 10).alias("end_token")))
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(seg.alias("segments"))
    return readers.turn_cuts(runs, "segments", F.lit(55).cast("long"), 1000).select("conv_id", "k", "pos")


@register("s17_first_of_sources", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'gold' ELSE 'any' END AS origin FROM customer")
def s17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return readers.first_of([c.where("id % 2 = 0").withColumn("origin", F.lit("gold")), c.withColumn("origin", F.lit("any"))], "id")


@register("p05u_unpivoted_scores", "SELECT l_orderkey AS id, l_linenumber AS n, 'prob__a' AS model, l_discount AS score FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'prob__b', l_tax FROM lineitem")
def p05u(spark, d):
    wide = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("prob__a"), F.col("l_tax").alias("prob__b"))
    return readers.unpivot_scores(wide, ["id", "n"])


@register("k01_result_json", "SELECT o_orderpriority AS model, 'runs' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderpriority")
def k01(spark, d):
    path = folder(spark)
    writers.result_json(order_runs(spark, d).groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("value")).select("model", F.lit("runs").alias("metric"), "value"), path)
    return readers.jsonl(spark, path, "model string, metric string, value double")


@register("k02_sharded_writer", "SELECT count(*) AS rows, true AS all_small FROM orders")
def k02(spark, d):
    path = folder(spark)
    writers.sharded_parquet(order_runs(spark, d), path, 1000)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    return sizes.agg(F.sum("count").alias("rows"), (F.max("count") <= 1000).alias("all_small"))


@register("k03_jsonl_writer", "SELECT conv_id, turn, nullif(role, 'system') AS role FROM conversations")
def k03(spark, d):
    path = folder(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("role"))
    writers.jsonl(c, path, ["conv_id", "turn", "role"])
    return readers.jsonl(spark, path, "conv_id long, turn long, role string")


@register("k04_filtered_copy", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 3")
def k04(spark, d):
    path = folder(spark)
    writers.filtered_copy(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), F.col("l_quantity") < 3, path)
    return spark.read.parquet(path)


@register("k05_resume", "SELECT o_orderkey AS run FROM orders")
def k05(spark, d):
    path, runs = folder(spark), order_runs(spark, d).select("run")
    writers.resume(runs.where("run % 2 = 0"), ["run"], path)
    writers.resume(runs, ["run"], path)
    return spark.read.schema("run long").parquet(path)


@register("k06_reject_log", "SELECT CAST(o_orderkey AS VARCHAR) AS run FROM orders WHERE o_totalprice < 10000")
def k06(spark, d):
    a, b = folder(spark), folder(spark)
    writers.with_rejects(order_runs(spark, d).select("run", "s"), F.col("s") >= 10000, a, b)
    return spark.read.csv(b, header=True).select("run")


@register("k07_id_list_writer", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier")
def k07(spark, d):
    path = folder(spark)
    writers.id_list(table(spark, d, "supplier"), "s_suppkey", path)
    return readers.id_list(spark, path)


@register("k08_report")
def k08(spark, d):
    text = writers.report(part_runs(spark, d).groupBy("y").count().orderBy("y"))
    return spark.createDataFrame([(text,)], "report string")
