"""Queries of trajectories and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import steps as st
from ..registry import register
from .bindings import EVENT_STEPS, ORDER_RUNS, RUN, event_steps, messages, order_runs, rounded, table

S = f"WITH {EVENT_STEPS}"
STATE = "st AS (SELECT *, coalesce(lag(act) OVER (PARTITION BY user_id, day ORDER BY step), '<init>') AS state FROM steps)"
MODEL = """n AS (SELECT state, act, count(*) AS n FROM st GROUP BY state, act), k AS (SELECT *, n >= 2 OR count(*) OVER (PARTITION BY state) = 1 AS ok FROM n),
a AS (SELECT *, bool_or(ok) OVER (PARTITION BY state) AS any_ok FROM k), model AS (SELECT state, act, n, n / sum(n) OVER (PARTITION BY state)::DOUBLE AS p FROM a WHERE ok OR NOT any_ok)"""
SURPRISE = "su AS (SELECT st.*, -ln(greatest(coalesce(m.p, 1e-4::DOUBLE), 1e-4::DOUBLE)) AS x FROM st LEFT JOIN model m ON st.state = m.state AND st.act = m.act)"


@register("w01_previous_activity", f"{S}, {STATE} SELECT user_id, day, step, state FROM st")
def w01(spark, d):
    return st.with_state(event_steps(spark, d), RUN).select(*RUN, F.col("step").cast("long").alias("step"), "state")


@register("w02_running_cost", f"{S} SELECT user_id, day, step, round(sum(obs) OVER (PARTITION BY user_id, day ORDER BY step ROWS UNBOUNDED PRECEDING) / sum(obs) OVER (PARTITION BY user_id, day) * 1000, 5) AS cum FROM steps")
def w02(spark, d):
    return rounded(st.running_cost(event_steps(spark, d), RUN, "obs", F.lit(1000.0)).select(*RUN, F.col("step").cast("long").alias("step"), "cum"), 5)


@register("w05_run_index", f"WITH {ORDER_RUNS} SELECT run, row_number() OVER (PARTITION BY unit ORDER BY run) AS run_index FROM runs")
def w05(spark, d):
    return order_runs(spark, d).select("run", F.row_number().over(Window.partitionBy("unit").orderBy("run")).cast("long").alias("run_index"))


@register("w06_demean", f"WITH {ORDER_RUNS} SELECT run, round(s - avg(s) OVER (PARTITION BY unit), 7) AS demeaned FROM runs")
def w06(spark, d):
    return rounded(order_runs(spark, d).select("run", (F.col("s") - F.avg("s").over(Window.partitionBy("unit"))).alias("demeaned")), 7)


@register(
    "w07_prefix_cuts",
    f"""{S}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS n, coalesce(sum(obs) OVER (PARTITION BY user_id, day ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps)
    SELECT user_id, day, step, 'turns' AS cut FROM n WHERE step <= 2 UNION ALL SELECT user_id, day, step, 'fraction' FROM n WHERE step <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) UNION ALL SELECT user_id, day, step, 'budget' FROM n WHERE before < 120""",
)
def w07(spark, d):
    s = event_steps(spark, d)
    cuts = {"turns": st.prefix_turns(s, 2), "fraction": st.prefix_fraction(s, RUN, 0.25), "budget": st.prefix_budget(s, RUN, "obs", 120.0)}
    parts = [f.select(*RUN, F.col("step").cast("long").alias("step"), F.lit(k).alias("cut")) for k, f in cuts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("w08_first_user_message", "SELECT conv_id, substring(text, 1, 4000) AS issue FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user') WHERE k = 1")
def w08(spark, d):
    m = messages(spark, d).where("role = 'user'")
    return m.groupBy("conv_id").agg(F.substring(F.min_by("text", F.struct("turn", "text")), 1, 4000).alias("issue"))


@register(
    "w09_sessions",
    f"""WITH m AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS step, CASE WHEN regexp_matches(coalesce(text, ''), '(?i){tx.ERROR_LONG}') THEN 1 ELSE 0 END AS e FROM conversations)
    SELECT conv_id, CAST(step AS BIGINT) AS step, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS obs_len, coalesce(arg_max(CASE WHEN role <> 'assistant' THEN e END, CASE WHEN role <> 'assistant' THEN turn END), 0) AS err FROM m WHERE step > 0 GROUP BY conv_id, step""",
)
def w09(spark, d):
    m = messages(spark, d)
    return st.sessions(m, ["conv_id"], "turn", F.col("role") == "assistant", "text", tx.error_flag(F.col("text"))).drop("said")


@register("w10_drift", f"{S}, {STATE}, {MODEL}, {SURPRISE}, h AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY user_id, day) // 2) AS h FROM su) SELECT user_id, day, round(coalesce(abs(avg(CASE WHEN step <= h THEN x END) - avg(CASE WHEN step > h THEN x END)), 0), 8) AS drift, round(CASE WHEN count(*) > 1 THEN (arg_max(x, step) - arg_min(x, step)) / (count(*) - 1) ELSE 0 END, 8) AS mean_step FROM h GROUP BY user_id, day")
def w10(spark, d):
    s = event_steps(spark, d)
    f = st.surprise_features(st.surprise(s, RUN, st.transition_model(s, RUN)), RUN)
    return rounded(f.select(*RUN, "drift", "mean_step"), 8)


@register("w11_surprise_summary", f"{S}, {STATE}, {MODEL}, {SURPRISE} SELECT user_id, day, round(avg(x), 8) AS mean_surprise, round(max(x), 8) AS max_surprise, round(avg(CASE WHEN x > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share_surprising, round(exp(-max(x)), 8) AS least_likely FROM su GROUP BY user_id, day")
def w11(spark, d):
    s = event_steps(spark, d)
    f = st.surprise_features(st.surprise(s, RUN, st.transition_model(s, RUN)), RUN)
    return rounded(f.select(*RUN, "mean_surprise", "max_surprise", "share_surprising", "least_likely"), 8)


@register("w12_holm", "WITH p AS (SELECT l_suppkey AS cell, avg(l_discount) AS p FROM lineitem GROUP BY l_suppkey), i AS (SELECT *, row_number() OVER (ORDER BY p, cell) - 1 AS i, count(*) OVER () AS m FROM p) SELECT cell, round(max(least(1.0::DOUBLE, (m - i) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM i")
def w12(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.avg("l_discount").alias("p"))
    return rounded(st.holm(p, "p", "cell").select("cell", "adjusted"))


@register("w13_autocorrelation", f"WITH {ORDER_RUNS}, x AS (SELECT unit, run, y - avg(y) OVER (PARTITION BY unit) AS x FROM runs), l AS (SELECT x, lag(x) OVER (PARTITION BY unit ORDER BY run) AS b FROM x) SELECT round(sum(x * b) / sum(x * x), 9) AS autocorrelation, count(b) AS pairs FROM l")
def w13(spark, d):
    return rounded(st.autocorrelation(order_runs(spark, d), ["unit"], "run"))


@register(
    "w14_runs_test",
    f"WITH {ORDER_RUNS}, t AS (SELECT unit, y, CASE WHEN y <> lag(y) OVER (PARTITION BY unit ORDER BY run) THEN 1 ELSE 0 END AS t FROM runs), u AS (SELECT 1 + sum(t) AS runs, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM t GROUP BY unit HAVING sum(y) > 0 AND sum(1 - y) > 0), z AS (SELECT runs - (2 * a * b / (a + b) + 1) AS dev, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) AS var FROM u) SELECT round(sum(dev / sqrt(var)) / sqrt(count(*)), 8) AS stouffer, count(*) AS units FROM z WHERE var > 0",
)
def w14(spark, d):
    return rounded(st.runs_test(order_runs(spark, d), ["unit"], "run"), 8)


@register("w15_half_difference", f"WITH {ORDER_RUNS}, n AS (SELECT unit, y, row_number() OVER (PARTITION BY unit ORDER BY run) AS i, count(*) OVER (PARTITION BY unit) AS n FROM runs) SELECT unit, round(avg(CASE WHEN i <= n // 2 THEN y END) - avg(CASE WHEN i > n // 2 THEN y END), 9) AS difference FROM n WHERE n > 1 GROUP BY unit")
def w15(spark, d):
    return rounded(st.half_difference(order_runs(spark, d), ["unit"], "run"))


@register("w16_run_checks", f"{S}, l AS (SELECT user_id, day, act, obs, lag(obs) OVER (PARTITION BY user_id, day ORDER BY step) AS b FROM steps) SELECT user_id, day, count(DISTINCT act) = 1 AS constant, count(CASE WHEN obs < b THEN 1 END) = 0 AS non_decreasing FROM l GROUP BY user_id, day")
def w16(spark, d):
    """Whether a label stays the same in a run and a position never falls."""
    rows = event_steps(spark, d).withColumn("b", F.lag("obs").over(Window.partitionBy(*RUN).orderBy("step")))
    return rows.groupBy(*RUN).agg((F.countDistinct("act") == 1).alias("constant"), (F.count(F.when(F.col("obs") < F.col("b"), 1)) == 0).alias("non_decreasing"))


@register("a28_transition_model", f"{S}, {STATE}, {MODEL} SELECT state, act, n, round(p, 9) AS p FROM model")
def a28(spark, d):
    return rounded(st.transition_model(event_steps(spark, d), RUN))


SHARES = "sh AS (SELECT user_id, day, act, count(*) / sum(count(*)) OVER (PARTITION BY user_id, day)::DOUBLE AS share FROM steps GROUP BY user_id, day, act)"


@register("a29_visit_shares", f"{S}, {SHARES} SELECT user_id, day, act, round(share, 9) AS share FROM sh")
def a29(spark, d):
    return rounded(st.visit_shares(event_steps(spark, d), RUN))


JS = f"""{SHARES}, rn AS (SELECT DISTINCT user_id, day FROM sh), pr AS (SELECT a.user_id, a.day AS da, b.day AS db FROM rn a JOIN rn b ON a.user_id = b.user_id AND a.day < b.day),
g AS (SELECT pr.*, x.act FROM pr, (SELECT DISTINCT act FROM sh) x), v AS (SELECT g.*, coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM g LEFT JOIN sh a ON g.user_id = a.user_id AND g.da = a.day AND g.act = a.act LEFT JOIN sh b ON g.user_id = b.user_id AND g.db = b.day AND g.act = b.act),
js AS (SELECT user_id, da, db, greatest(sum(CASE WHEN p > 0 THEN 0.5::DOUBLE * p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN 0.5::DOUBLE * q * log2(2 * q / (p + q)) ELSE 0 END), 0) AS js FROM v GROUP BY user_id, da, db)"""


@register("a30_js_dispersion", f"{S}, {JS} SELECT user_id, round(avg(js), 8) AS dispersion, count(*) AS pairs FROM js GROUP BY user_id")
def a30(spark, d):
    shares = st.visit_shares(event_steps(spark, d), RUN)
    js = st.js_dispersion(shares, ["user_id"], ["day"])
    return rounded(js.groupBy("user_id").agg(F.avg("js").alias("dispersion"), F.count(F.lit(1)).alias("pairs")), 8)


@register(
    "a31_repeatability",
    f"{S}, r AS (SELECT user_id, day, count(*)::DOUBLE AS n, avg(obs) AS o FROM steps GROUP BY user_id, day), w AS (SELECT avg(n) AS mn, stddev_pop(n) AS sn, avg(o) AS mo, stddev_pop(o) AS so FROM r), z AS (SELECT user_id, (n - mn) / sn AS n, (o - mo) / so AS o, count(*) OVER (PARTITION BY user_id) AS c FROM r, w), u AS (SELECT user_id, avg(n) AS mn, var_pop(n) AS vn, avg(o) AS mo, var_pop(o) AS vo FROM z WHERE c > 1 GROUP BY user_id) SELECT round(var_pop(mn) / (var_pop(mn) + avg(vn)), 8) AS length, round(var_pop(mo) / (var_pop(mo) + avg(vo)), 8) AS size FROM u",
)
def a31(spark, d):
    r = event_steps(spark, d).groupBy(*RUN).agg(F.count(F.lit(1)).cast("double").alias("length"), F.avg("obs").alias("size"))
    return rounded(st.repeatability(r, ["user_id"], ["length", "size"]), 8)


@register(
    "a32_split_ratio",
    f"{S}, {JS}, lb AS (SELECT user_id, day, max(CASE WHEN act = 'purchase' THEN 1 ELSE 0 END) AS y FROM steps GROUP BY user_id, day), t AS (SELECT js.user_id, js.js, a.y = b.y AS same FROM js JOIN lb a ON js.user_id = a.user_id AND js.da = a.day JOIN lb b ON js.user_id = b.user_id AND js.db = b.day), u AS (SELECT user_id, avg(CASE WHEN NOT same THEN js END) AS between_js, avg(CASE WHEN same THEN js END) AS within_js FROM t GROUP BY user_id) SELECT round(avg(between_js / within_js), 7) AS ratio, count(*) AS units FROM u WHERE between_js IS NOT NULL AND within_js > 0",
)
def a32(spark, d):
    """Divergence between runs of different outcome over that between runs of one outcome."""
    s = event_steps(spark, d)
    label = s.groupBy(*RUN).agg(F.max((F.col("act") == "purchase").cast("int")).alias("y"))
    js = st.js_dispersion(st.visit_shares(s, RUN), ["user_id"], ["day"]).select("user_id", F.col("run_a.day").alias("da"), F.col("run_b.day").alias("db"), "js")
    t = js.join(label.select("user_id", F.col("day").alias("da"), F.col("y").alias("ya")), ["user_id", "da"]).join(label.select("user_id", F.col("day").alias("db"), F.col("y").alias("yb")), ["user_id", "db"])
    same = F.col("ya") == F.col("yb")
    u = t.groupBy("user_id").agg(F.avg(F.when(~same, F.col("js"))).alias("b"), F.avg(F.when(same, F.col("js"))).alias("w")).where("b IS NOT NULL AND w > 0")
    return rounded(u.agg(F.avg(F.col("b") / F.col("w")).alias("ratio"), F.count(F.lit(1)).alias("units")), 7)


@register("a42_compute_share", f"{S}, t AS (SELECT *, sum(obs) OVER (PARTITION BY user_id, day) AS t FROM steps) SELECT user_id, day, round(sum(CASE WHEN step <= 2 THEN obs ELSE 0 END) / any_value(t), 8) AS share FROM t GROUP BY user_id, day HAVING any_value(t) > 0")
def a42(spark, d):
    s = event_steps(spark, d).groupBy(*RUN).agg(F.sum(F.when(F.col("step") <= 2, F.col("obs")).otherwise(F.lit(0.0))).alias("a"), F.sum("obs").alias("t")).where("t > 0")
    return rounded(s.select(*RUN, (F.col("a") / F.col("t")).alias("share")), 8)


@register("j09_surprise_lookup", f"{S}, {STATE}, {MODEL}, {SURPRISE} SELECT user_id, day, step, round(x, 8) AS surprise FROM su")
def j09(spark, d):
    s = event_steps(spark, d)
    return rounded(st.surprise(s, RUN, st.transition_model(s, RUN)).select(*RUN, F.col("step").cast("long").alias("step"), "surprise"), 8)


@register("j12_known_alphabet", f"{S}, {SHARES} SELECT user_id, day, act, round(share, 9) AS share FROM sh WHERE act IN (SELECT act FROM steps WHERE user_id % 2 = 0 AND act <> 'signup')")
def j12(spark, d):
    s = event_steps(spark, d)
    return rounded(st.known_shares(st.visit_shares(s, RUN), s.where("user_id % 2 = 0 AND act <> 'signup'").select("act").distinct()))


@register("f18_feature_vector", f"{S}, {STATE}, {MODEL}, {SURPRISE} SELECT user_id, day, count(*) AS n, count(DISTINCT act) AS \"unique\", round(1 - count(DISTINCT act) / count(*)::DOUBLE, 8) AS repetition, round(stddev_pop(x), 7) AS std_surprise, round(arg_max(x, step), 8) AS last_surprise, round(avg(obs), 6) AS mean_obs, round(max(obs), 6) AS max_obs, round(avg(err), 8) AS error_rate, CAST(sum(err) AS BIGINT) AS errors FROM su GROUP BY user_id, day")
def f18(spark, d):
    s = event_steps(spark, d)
    f = st.surprise_features(st.surprise(s, RUN, st.transition_model(s, RUN)), RUN)
    return f.select(*RUN, "n", "unique", *(F.round(c, k).alias(c) for c, k in (("repetition", 8), ("std_surprise", 7), ("last_surprise", 8), ("mean_obs", 6), ("max_obs", 6), ("error_rate", 8))), "errors")


FENCED = "chr(96) || chr(96) || chr(96) || 'bash' || chr(10) || split_part(trim(text), ' ', 1) || ' -x' || chr(10) || chr(96) || chr(96) || chr(96)"
WORD = "lower(regexp_extract(string_split_regex(split_part(trim(text), ' ', 1), '\\s+')[1], '^[A-Za-z_][\\p{L}\\p{M}\\p{N}_.\\-]*', 0))"


def fenced():
    return F.concat(F.lit("```bash\n"), F.split_part(F.trim("text"), F.lit(" "), F.lit(1)), F.lit(" -x\n```"))


@register("f01_command", f"SELECT item_id, CASE WHEN {WORD} = '' THEN 'bash' ELSE {WORD} END AS command FROM benchmark")
def f01(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.command(fenced()).alias("command"))


@register("f02_bucket", "SELECT event_id, CASE WHEN w IN ('ls', 'git') THEN w WHEN w = 'no_command' THEN w ELSE 'other_cmd' END AS agent, CASE WHEN w IN ('ls', 'git', 'no_command') THEN w ELSE 'other_cmd' END AS shell FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'ls' WHEN 'view' THEN 'git' WHEN 'error' THEN 'no_command' ELSE event_type END AS w FROM events)")
def f02(spark, d):
    w = F.when(F.col("event_type") == "click", "ls").when(F.col("event_type") == "view", "git").when(F.col("event_type") == "error", "no_command").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", tx.bucket(w).alias("agent"), tx.bucket(w, tx.SHELL_COMMANDS).alias("shell"))


@register("f03_error_flags", f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){tx.ERROR_LONG}') THEN 1 ELSE 0 END AS long, CASE WHEN regexp_matches(text, '(?i){tx.ERROR_JSON}') THEN 1 ELSE 0 END AS json, CASE WHEN regexp_matches(text, '(?i){tx.ERROR_SHORT}') THEN 1 ELSE 0 END AS short FROM documents")
def f03(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.error_flag(t).alias("long"), tx.error_flag(t, tx.ERROR_JSON).alias("json"), tx.error_flag(t, tx.ERROR_SHORT).alias("short"))


COUNTED = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in tx.ERROR_WORDS)


@register("f04_error_count", f"SELECT doc_id, CAST({COUNTED} AS INTEGER) AS errors, {COUNTED} > 0 AS any_error FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def f04(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.error_count(F.col("text")).alias("errors"), tx.any_error(F.col("text")).alias("any_error"))


@register("f05_first_token", "SELECT page_id, lower(string_split_regex(trim(url), '\\s+')[1]) AS token, list_last(string_split(lower(string_split_regex(trim(url), '\\s+')[1]), '/')) AS base FROM pages".replace("list_last(string_split(lower(string_split_regex(trim(url), '\\s+')[1]), '/'))", "string_split(lower(string_split_regex(trim(url), '\\s+')[1]), '/')[-1]"))
def f05(spark, d):
    return table(spark, d, "pages").select("page_id", tx.first_token(F.col("url")).alias("token"), tx.first_token(F.col("url"), True).alias("base"))


@register("f06_tool_name", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'fn' WHEN event_type = 'view' THEN 'plain' ELSE 'no_tool' END AS tool FROM events")
def f06(spark, d):
    kind = "array<struct<function:struct<name:string>,name:string>>"
    calls = F.when(F.col("event_type") == "click", '[{"function": {"name": "fn"}}]').when(F.col("event_type") == "view", '[{"name": "plain"}]').when(F.col("event_type") == "error", "[]")
    return table(spark, d, "events").select("event_id", tx.tool_name(F.from_json(calls, kind)).alias("tool"))


@register("f07_blocks", "WITH b AS (SELECT item_id, split_part(trim(text), ' ', 1) || ' -x' AS t FROM benchmark) SELECT item_id, t || chr(10) AS block, 'see' AS prose, regexp_extract(t, '^\\S+') AS head, regexp_replace(t, '^\\S+\\s+', '') AS rest FROM b")
def f07(spark, d):
    body = F.concat(F.lit("see ```bash\nold\n``` then "), fenced())
    head, rest = tx.head_and_rest(tx.last_block(body))
    return table(spark, d, "benchmark").select("item_id", tx.last_block(body).alias("block"), tx.prose(body).alias("prose"), head.alias("head"), rest.alias("rest"))


@register("f08_roles", "SELECT conv_id, turn, CASE WHEN role IN ('ai', 'assistant') THEN 'agent' WHEN role IN ('user', 'tool', 'observation') THEN 'environment' ELSE 'other' END AS side, role = 'user' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1 AS first_user FROM conversations")
def f08(spark, d):
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    return messages(spark, d).select("conv_id", "turn", tx.role(F.col("role")).alias("side"), ((F.col("role") == "user") & (k == 1)).alias("first_user"))


@register("f09_tokens", "SELECT doc_id, length(text) / 4.0::DOUBLE AS tokens FROM documents")
def f09(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@register("f10_as_list", "SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 0 ELSE 1 END AS n FROM events")
def f10(spark, d):
    v = F.when(F.col("event_type") == "click", '["a", "b"]').when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.size(tx.as_list(v)).alias("n"))


@register("f11_json_dump", "SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"turn\":' || turn || '}' AS message FROM conversations")
def f11(spark, d):
    return messages(spark, d).select("conv_id", "turn", F.to_json(F.struct("role", "turn")).alias("message"))


@register("f12_key_parsing", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([^/?#]*)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([^/?#]*)', 3) AS lang FROM pages")
def f12(spark, d):
    pat = "^(https?)://([^/]+)/([^/?#]*)"
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", pat, 2).alias("host"), F.regexp_extract("url", pat, 3).alias("lang"))


@register("f13_family", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'qwen' WHEN p_partkey % 3 = 1 THEN 'gpt' ELSE lower(split_part(p_brand || '-x', '-', 1)) END AS family FROM part")
def f13(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "Qwen3-32B").when(F.col("p_partkey") % 3 == 1, "GPT-x").otherwise(F.concat("p_brand", F.lit("-x")))
    return table(spark, d, "part").select("p_partkey", tx.family(name).alias("family"))


@register("f14_numbers")
def f14(spark, d):
    """Numerals of each document with the ways each may be written (look-behind is beyond DuckDB's expressions)."""
    n = table(spark, d, "documents").select("doc_id", F.explode(tx.numbers(F.col("text"))).alias("number"))
    return n.withColumn("variants", tx.number_variants(F.col("number")))


@register("f15_scalars", "SELECT o_orderkey, round(ln(o_totalprice + 1), 8) AS log1p, round(sqrt(o_totalprice), 6) AS root, round(log2(o_totalprice + 2), 8) AS bits, greatest(least(o_totalprice, 200000::DOUBLE), 1000::DOUBLE) AS clipped, abs(o_totalprice - 150000) AS distance FROM orders")
def f15(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log1p(x), 8).alias("log1p"), F.round(F.sqrt(x), 6).alias("root"), F.round(F.log2(x + 2), 8).alias("bits"), F.greatest(F.least(x, F.lit(200000.0)), F.lit(1000.0)).alias("clipped"), F.abs(x - 150000).alias("distance"))


@register("f16_special_functions")
def f16(spark, d):
    from ..functions.special import beta_survival_udf, normal_quantile_udf, normal_survival_udf

    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_size") + 0.5) / 60).alias("p"))
    return rows.select("p_partkey", normal_quantile_udf("p").alias("z"), beta_survival_udf("p", F.lit(2.0), F.lit(5.0)).alias("beta_sf"), normal_survival_udf("p").alias("sf"))


@register("f17_arrays", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last, round(embedding[2]::DOUBLE - embedding[1]::DOUBLE, 6) AS step, len(embedding[3:7]) AS middle FROM embeddings")
def f17(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    diff = F.zip_with(F.slice(e, 2, 63), F.slice(e, 1, 63), lambda a, b: a - b)
    return rounded(table(spark, d, "embeddings").select("vec_id", F.element_at(e, 1).alias("first"), F.element_at(e, -1).alias("last"), F.element_at(diff, 1).alias("step"), F.size(F.slice("embedding", 3, 5)).cast("long").alias("middle")), 6)


@register("f19_message_features", "WITH n AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), u AS (SELECT conv_id, turn, role, k, length(coalesce(text, '')) AS len, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS i FROM n), c AS (SELECT conv_id, min(CASE WHEN role = 'assistant' AND i = 2 THEN turn END) + 1 AS cut FROM u GROUP BY conv_id), g AS (SELECT u.*, cut FROM u JOIN c ON u.conv_id = c.conv_id WHERE turn <= cut) SELECT conv_id, count(*) AS messages, round(avg(CASE WHEN role = 'assistant' THEN len END), 6) AS mean_agent, max(CASE WHEN role = 'assistant' THEN len END) AS max_agent, round(avg(CASE WHEN role = 'user' AND i > 1 THEN len END), 6) AS mean_other, max(CASE WHEN role = 'user' AND i > 1 THEN len END) AS max_other FROM g GROUP BY conv_id")
def f19(spark, d):
    """Message lengths up to one message past the second agent turn; the first user message is left out."""
    m = messages(spark, d).withColumn("len", F.length(F.coalesce("text", F.lit("")))).withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")))
    cut = F.min(F.when((F.col("role") == "assistant") & (F.col("i") == 2), F.col("turn"))).over(Window.partitionBy("conv_id")) + 1
    m = m.withColumn("cut", cut).where("turn <= cut")
    agent, other = F.when(F.col("role") == "assistant", F.col("len")), F.when((F.col("role") == "user") & (F.col("i") > 1), F.col("len"))
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg(agent), 6).alias("mean_agent"), F.max(agent).cast("long").alias("max_agent"), F.round(F.avg(other), 6).alias("mean_other"), F.max(other).cast("long").alias("max_other"))


@register("f20_feature_blocks", f"{S} SELECT user_id, day, count(*) AS n, round(sum(obs), 5) AS total, round(max(obs), 6) AS largest, count(DISTINCT act) AS kinds, CAST(sum(err) AS BIGINT) AS errors FROM steps GROUP BY user_id, day")
def f20(spark, d):
    """Length block (n, total, largest) and content block (kinds, errors)."""
    return event_steps(spark, d).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("obs"), 5).alias("total"), F.round(F.max("obs"), 6).alias("largest"), F.countDistinct("act").alias("kinds"), F.sum("err").cast("long").alias("errors"))
