"""Chained queries, control over tasks and logs, the registry's own queries over tables, and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import compose as C
from textloom.plans.params import Param
from textloom.plans.registry import STABILITY, query
from textloom.sources.scratch import written
from textloom.sources.tables import table


@query("chain_semi_join", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "compose")
def chain_semi_join(spark, sf_dir):
    """Documents that a first query names."""
    return C.chain(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("chain_anti_join", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "compose")
def chain_anti_join(spark, sf_dir):
    """Documents that a first query doesn't name."""
    return C.chain(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", keep=False)


@query("chain_union_distinct", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0", "compose")
def chain_union_distinct(spark, sf_dir):
    """Two lists of values as one."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"))
    return C.union_values(a, table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("chain_three_step", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000))", "compose")
def chain_three_step(spark, sf_dir):
    """Customers to orders to line items."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000")
    orders = lambda values: table(spark, sf_dir, "orders").join(values, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    items = lambda values: table(spark, sf_dir, "lineitem").join(values, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return C.pipeline(c, [("orders", orders, "c_custkey", {}), ("items", items, "o_orderkey", {})]).select("l_orderkey", "l_linenumber")


@query("chain_reverse_edges", "SELECT l_partkey AS dst, count(DISTINCT l_suppkey) AS upstream FROM lineitem GROUP BY 1", "compose")
def chain_reverse_edges(spark, sf_dir):
    """How many sources name each target: a lookup against the direction of the edges."""
    edges = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("dst")).distinct()
    return edges.groupBy("dst").agg(F.count("*").alias("upstream"))


@query("chain_pluck", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1", "compose")
def chain_pluck(spark, sf_dir):
    """One field of nested records."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return n.select("l_orderkey", F.concat_ws(",", F.transform(C.pluck(F.col("items"), "l_partkey"), lambda x: x.cast("string"))).alias("parts"))


LEVEL = "CASE p_size % 4 WHEN 0 THEN 'experimental' WHEN 1 THEN 'beta' WHEN 2 THEN 'stable' ELSE 'old' END"


@query("skill_filter_stability", f"SELECT p_partkey, p_brand, {LEVEL} AS stability FROM part WHERE p_size % 4 IN (1, 2)", "compose", (Param("least", "string", "beta", enum=tuple(STABILITY)),))
def skill_filter_stability(spark, sf_dir, least="beta"):
    """A catalogue by least level."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(LEVEL).alias("stability"))
    return C.at_least(p, "stability", least, STABILITY)


@query("skill_by_category", "SELECT coalesce(p_brand, 'general') AS category, count(*) AS n, min(p_name) AS first, max(p_name) AS last FROM part GROUP BY 1", "compose")
def skill_by_category(spark, sf_dir):
    """A catalogue grouped by category."""
    p = table(spark, sf_dir, "part").groupBy(F.coalesce("p_brand", F.lit("general")).alias("category"))
    return p.agg(F.count("*").alias("n"), F.min("p_name").alias("first"), F.max("p_name").alias("last"))


@query("capability_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')", "compose", (Param("term", "string", "brand#1", min_length=1),))
def capability_search(spark, sf_dir, term="brand#1"):
    """A term in any of several fields."""
    return table(spark, sf_dir, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains(term.lower())).select("p_partkey")


@query("health_summary", "SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 100000) AS healthy, count(*) FILTER (WHERE NOT o_totalprice > 100000) AS unhealthy FROM orders GROUP BY 1", "compose")
def health_summary(spark, sf_dir):
    """Healthy and unhealthy members of each group."""
    ok = F.col("o_totalprice") > 100000
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("total"), F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("unhealthy"))


@query("health_members", "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_totalprice > 100000 THEN 'healthy' ELSE 'unhealthy' END AS health FROM orders", "compose")
def health_members(spark, sf_dir):
    """Each member of a group, healthy or not."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, "healthy").otherwise("unhealthy").alias("health"))


@query("batch_results", "SELECT event_id, runs_as, 'r' || runs_as AS result FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS runs_as FROM events)", "control")
def batch_results(spark, sf_dir):
    """Tasks with the same key run once, and all get the result."""
    e = table(spark, sf_dir, "events").withColumn("key", C.task_key(F.col("user_id"), F.col("event_type")))
    ran = C.dedup_tasks(e, "key", "event_id").where("event_id = runs_as").select("event_id", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result"))
    return C.fan_out(e.select("event_id", "key"), "key", "event_id", ran).select("event_id", "runs_as", "result")


@query("batch_dedup", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS runs_as FROM events", "control")
def batch_dedup(spark, sf_dir):
    """Tasks with the same key run once."""
    e = table(spark, sf_dir, "events").withColumn("key", C.task_key(F.col("user_id"), F.col("event_type")))
    return C.dedup_tasks(e, "key", "event_id").select("event_id", "runs_as")


BUDGET = """WITH RECURSIVE t AS (SELECT user_id, event_id, CAST(ceil(length(props || event_type) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, CASE WHEN cost <= 20 THEN cost ELSE 0 END AS used, cost <= 20 AS runs FROM t WHERE i = 1
UNION ALL SELECT t.user_id, t.event_id, t.i, r.used + CASE WHEN r.used + t.cost <= 20 THEN t.cost ELSE 0 END, r.used + t.cost <= 20 FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
SELECT user_id, event_id, runs FROM r"""


@query("budget_greedy", BUDGET, "control", (Param("budget", "integer", 20, minimum=0),))
def budget_greedy(spark, sf_dir, budget=20):
    """Tasks in order as long as each fits; one that doesn't is skipped."""
    cost = F.ceil(F.length(F.concat("props", "event_type")) / 4.0).cast("long")
    return C.greedy_budget(table(spark, sf_dir, "events").select("user_id", "event_id", cost.alias("cost")), "user_id", "event_id", "cost", budget).drop("cost")


GLOBAL = """WITH RECURSIVE t AS (SELECT event_id, CAST(ceil(length(props || event_type) / 4.0) AS BIGINT) AS cost, row_number() OVER (ORDER BY event_id) AS i FROM events),
r AS (SELECT i, event_id, CASE WHEN cost <= 1000 THEN cost ELSE 0 END AS used, cost <= 1000 AS runs FROM t WHERE i = 1
UNION ALL SELECT t.i, t.event_id, r.used + CASE WHEN r.used + t.cost <= 1000 THEN t.cost ELSE 0 END, r.used + t.cost <= 1000 FROM r JOIN t ON t.i = r.i + 1)
SELECT event_id, runs FROM r"""


@query("budget_global", GLOBAL, "control", (Param("budget", "integer", 1000, minimum=0),))
def budget_global(spark, sf_dir, budget=1000):
    """One budget over a whole batch in order; a task that doesn't fit is skipped."""
    cost = F.ceil(F.length(F.concat("props", "event_type")) / 4.0).cast("long")
    return C.global_budget(table(spark, sf_dir, "events").select("event_id", cost.alias("cost")), "event_id", "cost", budget).select("event_id", "runs")


CLOSURE = """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
r(node, depth) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_size = 7 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node"""


@query("chain_closure", CLOSURE, "compose", (Param("most", "integer", 2, minimum=0),))
def chain_closure(spark, sf_dir, most=2):
    """All that parts of a size depend on over some steps of parts and their suppliers."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    edges = written(pairs.union(pairs.select("dst", "src")))
    starts = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return C.reachable(starts, edges, most, written)


@query("profile_averages", "SELECT event_type AS skill, count(*) AS runs, round(avg(value), 6) AS duration, round(avg(value / 2 + value / 4), 6) AS steps FROM events GROUP BY 1", "control")
def profile_averages(spark, sf_dir):
    """Average duration of runs and of the sum of their steps."""
    e = table(spark, sf_dir, "events").withColumn("steps", F.array(F.col("value") / 2, F.col("value") / 4))
    return e.groupBy(F.col("event_type").alias("skill")).agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("duration"), F.round(F.avg(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x)), 6).alias("steps"))


@query("batch_cached", "SELECT event_id, CASE WHEN k <> 13 THEN event_type || k END AS result, CASE WHEN k = 13 THEN 'k is 13' END AS error, k <> 13 AND EXISTS (SELECT 1 FROM events f WHERE f.event_type = e.event_type AND f.value > 50 AND CAST(json_extract(f.props, '$.k') AS INT) = k) AS from_cache FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) e", "control")
def batch_cached(spark, sf_dir):
    """A second batch, of all events, that runs what the first, of the dear ones, left; failures are rows and run again."""
    k = F.get_json_object("props", "$.k").cast("int")
    tasks = table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k"), C.task_key(F.col("event_type"), k).alias("key"))

    def work(rows):
        bad = F.col("k") == 13
        return rows.withColumns({"result": F.when(~bad, F.concat("event_type", F.col("k").cast("string"))), "error": F.when(bad, "k is 13")})

    _, cache = C.cached_batch(tasks.where("value > 50"), "key", work, None, written)
    return C.cached_batch(tasks, "key", work, cache, written)[0].select("event_id", "result", "error", "from_cache")


STEPS = "WITH s AS (SELECT user_id, event_id, 'read' AS step, value / 2 AS d FROM events UNION ALL SELECT user_id, event_id, 'sort', value / (1 + event_id % 3) FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, step) AS n FROM s), g AS (SELECT user_id, step, count(*) AS n, avg(d) FILTER (WHERE i <= n // 2) AS o, avg(d) FILTER (WHERE i > n // 2) AS w FROM r GROUP BY user_id, step) SELECT user_id, step, n, CASE WHEN n < 4 THEN 'insufficient_data' WHEN w < o * 0.9 THEN 'improving' WHEN w > o * 1.1 THEN 'degrading' ELSE 'stable' END AS trend FROM g"


@query("profile_step_trends", STEPS, "control")
def profile_step_trends(spark, sf_dir):
    """Whether the newer half of each step's times is faster or slower."""
    step = lambda name, ms: F.struct(F.lit(name).alias("step"), ms.alias("duration_ms"))
    steps = F.array(step("read", F.col("value") / 2), step("sort", F.col("value") / (1 + F.col("event_id") % 3)))
    return C.step_trends(table(spark, sf_dir, "events").withColumn("steps", steps), "user_id", "event_id", "steps").select("user_id", "step", "n", "trend")


TRENDS = "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), g AS (SELECT user_id, count(*) AS n, avg(value) FILTER (WHERE i <= n // 2) AS o, avg(value) FILTER (WHERE i > n // 2) AS w FROM r GROUP BY user_id) SELECT user_id, n, CASE WHEN n < 4 THEN 'insufficient_data' WHEN w < o * 0.9 THEN 'improving' WHEN w > o * 1.1 THEN 'degrading' ELSE 'stable' END AS trend FROM g"


@query("profile_trends", TRENDS, "control")
def profile_trends(spark, sf_dir):
    """Whether the newer half of each key's runs is faster or slower."""
    return C.trends(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "n", "trend")


@query("history_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 3", "control", (Param("most", "integer", 3, minimum=1),))
def history_last_n(spark, sf_dir, most=3):
    """The last runs of each key."""
    return C.last_runs(table(spark, sf_dir, "events"), "user_id", "event_id", most).select("user_id", "event_id")


@query("backoff_schedule", "SELECT event_id, CAST(500 * pow(2, event_id % 5) AS BIGINT) AS wait_ms FROM events WHERE event_type = 'error'", "control")
def backoff_schedule(spark, sf_dir):
    """How long each failed run waits before its next attempt."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", C.backoff_ms(F.col("event_id") % 5 + 1, 500).alias("wait_ms"))


@query("error_classes", "SELECT event_id, CASE WHEN regexp_matches(props, '[:] ?[0-4][}]') THEN 'timeout' WHEN regexp_matches(props, '[0-9]{2}') THEN 'permission_denied' ELSE 'unknown' END AS error_type FROM events WHERE event_type = 'error'", "control")
def error_classes(spark, sf_dir):
    """The first pattern that matches an error's text names its type."""
    rules = (("[:] ?[0-4][}]", "timeout"), ("[0-9]{2}", "permission_denied"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", C.classified(F.col("props"), rules).alias("error_type"))


DEGRADED = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(regexp_extract(props, '[0-9]+') AS INT) ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 7 <> 0 THEN 'json' END AS kind, event_id % 7 = 0 AS used_fallback, CASE WHEN event_id % 7 = 0 THEN 'kind is unavailable' ELSE '' END AS warnings FROM events"


@query("degraded_columns", DEGRADED, "control")
def degraded_columns(spark, sf_dir):
    """Records read by a pattern where they are no JSON: columns that it can't fill are null, and a warning says so."""
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("!"), "props")).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    record = F.try_parse_json("text")
    primary = {"k": F.try_variant_get(record, "$.k", "int"), "kind": F.lit("json")}
    out = C.with_fallback(e, primary, {"k": F.regexp_extract("text", "[0-9]+", 0).try_cast("int")}, record.isNull(), "kind is unavailable")
    return out.select("event_id", "k", "kind", "used_fallback", F.concat_ws(",", "warnings").alias("warnings"))


@query("star_equi_join", "SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "star")
def star_equi_join(spark, sf_dir):
    """Orders by nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("star_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "star")
def star_left_join(spark, sf_dir):
    """Customers with how many orders they have, none included."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("star_theta_join", "SELECT s.s_suppkey, count(*) AS richer FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND t.s_acctbal > s.s_acctbal GROUP BY s.s_suppkey", "star")
def star_theta_join(spark, sf_dir):
    """Suppliers of the same nation with a higher balance: a rank within the nation, without pairing them."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.rank().over(w) - 1).cast("long").alias("richer")).where("richer > 0")


@query("star_rank_windows", "SELECT c_custkey, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense_rank, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS previous FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)", "star")
def star_rank_windows(spark, sf_dir):
    """Ranks and neighbours within each nation."""
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w.orderBy("c_acctbal")).alias("rank"), F.dense_rank().over(w.orderBy("c_acctbal")).alias("dense_rank"), F.lag("c_custkey").over(w.orderBy("c_acctbal", "c_custkey")).alias("previous"))


@query("star_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", "star")
def star_set_operations(spark, sf_dir):
    """Intersection and difference of key sets."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))
    return a.exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query("star_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "star")
def star_cube(spark, sf_dir):
    """Line items by both flags and all their totals."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("star_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", "star")
def star_pricing_summary(spark, sf_dir):
    """Prices by flag, with the filter in the scan."""
    l_ = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l_.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))
