"""Queries of log readers, audits, series and object functions; lines are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import strings, values
from tidemark.operators import catalog, collect, dataset, graph, similar, stats, timeseries
from tidemark.plans.temporal import as_history
from tidemark.sources import eventlog, logs, sinks
from tidemark.sources.tables import table as t


def performance_deltas(spark, sf):
    o = t(spark, sf, "orders").groupBy((F.floor(F.col("o_orderkey") / 50) * 1000).alias("at")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("o_custkey").alias("bytes"))
    lines = o.select(F.concat_ws(" ", F.col("at").cast("string"), F.col("tasks").cast("string"), F.col("bytes").cast("string")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("# timestamp tasks",), ("# timestamp tasks bytes",)], "value string"))
    p = logs.performance_rows(lines)
    return timeseries.deltas(p, [], ["timestamp"], "tasks", "bytes", span=1_000_000).select("timestamp", "tasks_delta", "bytes_delta")


def debug_streams(spark, sf):
    lines = t(spark, sf, "events").select(F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(".00 "), F.col("event_type"), F.lit("["), F.col("user_id"), F.lit("] "), F.concat(F.lit("s"), F.col("event_id") % 3), F.lit(": seen: "), F.col("props")).alias("value"))
    d = logs.debug_lines(lines.unionByName(spark.createDataFrame([("no such line",)], "value string")))
    return d.groupBy("program", "stream").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_timestamp("ts")).alias("first"), F.max("pid").alias("pid"), F.max("message").alias("message"))


def workflow_run_summary(spark, sf):
    o = t(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "3").otherwise("4")
    line = lambda at, s: F.concat_ws(" ", (F.col("o_orderkey") * 10 + at).cast("string"), (F.col("o_orderkey") % 1000).cast("string"), s, F.lit("7 1 2 3 4 5 15"))
    lines = o.select(F.explode(F.array(line(1, F.lit("1")), line(2, state))).alias("value")).unionByName(spark.createDataFrame([("# NODE 0 true",)], "value string"))
    return logs.workflow_summary(logs.workflow_runs(lines))


def dag_state_counts(spark, sf):
    o = t(spark, sf, "orders")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 700).cast("string"), (F.col("o_custkey") % 5).cast("string"), F.lit("7 1 2 3 4 5 15"))
    return logs.workflow_states(logs.workflow_runs(o.select(line.alias("value"))))


def attempts_lost(spark, sf):
    """Every order runs on a worker of its own, which leaves in the middle of every third."""
    o = t(spark, sf, "orders")
    at = lambda d: ((F.col("o_orderkey") * 10 + d) * 1000).cast("string")
    key, worker = F.col("o_orderkey").cast("string"), F.concat(F.lit("w"), F.col("o_orderkey"))
    gone = F.col("o_orderkey") % 3 == 0
    lines = F.array_compact(F.array(
        F.concat_ws(" ", at(0), F.lit("m WORKER"), worker, F.lit("CONNECTION")),
        F.concat_ws(" ", at(1), F.lit("m TASK"), key, F.lit("READY c")), F.concat_ws(" ", at(2), F.lit("m TASK"), key, F.lit("RUNNING"), worker),
        F.when(gone, F.concat_ws(" ", at(4), F.lit("m WORKER"), worker, F.lit("DISCONNECTION FAILURE"))),
        F.when(~gone, F.concat_ws(" ", at(5), F.lit("m TASK"), key, F.lit("DONE SUCCESS"))),
        F.when(~gone, F.concat_ws(" ", at(6), F.lit("m WORKER"), worker, F.lit("DISCONNECTION IDLE"))),
    ))
    log = logs.transactions(o.select(F.explode(lines).alias("value")).unionByName(spark.createDataFrame([("0 m MANAGER m START 0",)], "value string")))
    lost = logs.lost_attempts(logs.tasks(log), logs.workers(log))
    return lost.select(F.col("task").cast("long").alias("task"), F.round(F.col("lost") * 1000).cast("long").alias("lost"))


def log_span(spark, sf):
    """The lines of two days as they are, read back."""
    lines = eventlog.to_lines(as_history(spark, sf)).select("part", (F.col("seq") * 2 + F.when(F.col("line").startswith("T "), 0).otherwise(1)).alias("line_no"), "line")
    span = eventlog.within(lines, strings.epoch("2024-01-03 06:00:00"), strings.epoch("2024-01-05 05:59:59"))
    return eventlog.parse(span).where("op NOT IN ('T', 't')").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.countDistinct("key").alias("keys"))


def log_upgrade(spark, sf):
    p = t(spark, sf, "part")
    old = F.array(F.concat(F.lit("C p"), F.col("p_partkey")), F.concat(F.lit("brand "), F.col("p_brand")), F.concat(F.lit("name "), F.col("p_name")), F.concat(F.lit("U p"), F.col("p_partkey"), F.lit(" size "), F.col("p_size")))
    lines = p.select((F.col("p_partkey") % 8).cast("string").alias("part"), "p_partkey", F.posexplode(old).alias("at", "line")).select("part", (F.col("p_partkey") * 4 + F.col("at")).alias("line_no"), "line")
    new = eventlog.parse(eventlog.upgraded(lines))
    return new.select("op", "key", F.col("attrs")["brand"].alias("brand"), F.col("attrs")["name"].alias("label"), "value")


def resource_summary_units(spark, sf):
    p = t(spark, sf, "part")
    raw = p.select(F.col("p_brand").alias("category"), F.col("p_partkey").cast("string").alias("taskid"), F.lit("normal").alias("exit_type"), *[(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(',"MB"]')) if r == "memory" else F.when(F.col("p_partkey") % 4 == 0, "-1").otherwise((F.col("p_partkey") % 7).cast("string")) if r == "cores" else F.lit(None).cast("string")).alias(r) for r in logs.RESOURCES])
    s = logs.summary_rows(raw)
    return s.groupBy("category").agg(F.sum("memory").alias("memory"), F.sum("cores").alias("cores"), F.count("cores").alias("known"), F.count("disk").alias("disks"))


def successful_task_resources(spark, sf):
    o = t(spark, sf, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "SUCCESS  0").otherwise("RESOURCE_EXHAUSTION  1")
    body = F.concat(F.lit('{"cores_avg":[1.5,"cores"],"memory":['), F.col("o_custkey"), F.lit(',"MB"],"disk":['), F.col("o_orderkey") % 11, F.lit(',"MB"],"wall_time":[2,"s"]}'))
    s = logs.summary_log(o.select(F.concat(F.lit("99 1 TASK "), F.col("o_orderkey"), F.lit(" DONE "), result, F.lit(" "), body).alias("value")))
    # parameters follow from the task's number
    return s.select("task", "cores", "memory", "disk", "time", F.floor(F.col("task") / 20 + 1).alias("rate"), F.pmod(F.col("task") - 1, F.lit(20)).alias("blocks"))


def transfer_statistics(spark, sf):
    o = t(spark, sf, "orders")
    line = F.concat_ws(" ", (F.col("o_orderkey") * 1000).cast("string"), F.lit("m WORKER"), F.concat(F.lit("w"), F.col("o_custkey") % 9), F.lit("TRANSFER"), F.when(F.col("o_orderkey") % 3 == 0, "OUTPUT FILE").otherwise("INPUT URL"), F.concat(F.lit("f"), F.col("o_orderkey")), (F.col("o_custkey") % 8).cast("string"), (F.col("o_orderkey") % 4).cast("string"))
    x = logs.transfers(logs.transactions(o.select(line.alias("value")).unionByName(spark.createDataFrame([("0 m MANAGER m START 0",)], "value string"))))
    return logs.transfer_totals(x)


def task_range_filter(spark, sf):
    return t(spark, sf, "orders").where(logs.task_range(F.col("o_orderkey"), "10-25,40,100-120")).select("o_orderkey", "o_orderstatus")


def syscall_sorted(spark, sf):
    call = F.when(F.col("l_returnflag") == "R", "read").otherwise("write")
    lines = t(spark, sf, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), call, F.lit("(3</d/f"), (F.col("l_suppkey") % 30).cast("string"), F.lit('>, "x", 9) = '), F.col("l_quantity").cast("int").cast("string")).alias("value"))
    g = logs.syscalls(lines).groupBy("action", "path").agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("freq"))
    return collect.top(g, 25, F.desc("action"), F.desc("size"), F.desc("freq"), F.asc("path"))


def status_by_project(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("project"), F.col("c_name").alias("owner"))
    return catalog.sorted_view(c, "project", "owner", "c_custkey").limit(40)


def heartbeat_normalised(spark, sf):
    p = t(spark, sf, "pages").select(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("p"), F.col("page_id"))).alias("name"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("sender"), F.col("page_id").alias("received"), F.lit("10.0.0.1").alias("address"), F.lit(0).cast("long").alias("lastheardfrom"), F.col("html").alias("body"))
    return catalog.normalise(p, "sender", "received", 100).select("name", "address", "lastheardfrom", F.length("body").cast("long").alias("n"))


def catalog_tree(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.floor(F.col("c_custkey") / 3)).alias("manager"))
    return graph.tree(c, "c_custkey", "manager").select("node", "root", F.col("depth").cast("long").alias("depth"))


def degraded_replicas(spark, sf):
    files = t(spark, sf, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 4 + 28).cast("long").alias("least"))
    return graph.degraded(files, t(spark, sf, "lineitem").select(F.col("l_partkey").alias("file")), "file", "least")


def common_prefix_of_children(spark, sf):
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lists = l.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("items"))
    return graph.common_prefix(lists.withColumn("parent", F.floor(F.col("l_orderkey") / 2)), "parent", "items").select("parent", F.array_join("prefix", ",").alias("prefix"))


def node_residuals(spark, sf):
    nodes = t(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 13).alias("level"))
    files = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("file"), F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_returnflag") == "R", "OUT").otherwise("IN").alias("direction"))
    return graph.residuals(nodes, files)


def storage_by_owner(spark, sf):
    p = t(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("owner"), strings.dirname(F.regexp_replace("url", r"[?#].*$", "")).alias("dir"), F.octet_length("html").cast("long").alias("bytes"))
    return p.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("dir").alias("dirs"), F.sum("bytes").alias("bytes"))


def named_counters(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("name"), F.when(F.col("event_type") == "purchase", "set").otherwise("inc").alias("op"), F.get_json_object("props", "$.k").cast("long").alias("value"), "event_id")
    return stats.counters(e, "name", "op", "value", "event_id")


def category_allocations(spark, sf):
    b = t(spark, sf, "lineitem").groupBy("l_returnflag", stats.bucket(F.col("l_quantity"), 5.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1))).alias("mean_time"))
    return stats.first_allocations_by(b, "l_returnflag").select("l_returnflag", "bucket", "cumulative", F.round("waste", 6).alias("waste"))


def category_refits(spark, sf):
    return stats.refits(t(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice").withColumn("completed", F.col("completed").cast("long"))


def stacked_per_time(spark, sf):
    e = t(spark, sf, "orders").select(F.unix_timestamp("o_orderdate").alias("time"), "o_orderkey", "o_custkey")
    return timeseries.stacked_at(e, "time", ["o_orderkey"], "o_custkey")


def rebased_times(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("begin"), (F.unix_timestamp("o_orderdate") + F.col("o_custkey")).alias("finish"))
    return timeseries.rebased(o, ["begin", "finish"], "begin").unionByName(timeseries.rebased(o, ["begin", "finish"], "finish", last=True))


def scheduling_times(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") * F.col("o_orderkey")).alias("acc"))
    return timeseries.shared_time(o, "task", "acc", 1000).select("task", F.round("seconds", 6).alias("seconds"))


def deviation_band(spark, sf):
    b = timeseries.band_share(t(spark, sf, "lineitem").select(F.col("l_quantity").alias("x")), "x")
    return b.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round("share", 6).alias("share"))


def interpolated_percentiles(spark, sf):
    l = t(spark, sf, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).alias("cents"))
    p = stats.percentiles(l, ["l_returnflag"], "cents", [0.25, 0.5, 0.75])
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("percentile")))
    return p.groupBy("l_returnflag").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))


def ranks_of_values(spark, sf):
    return stats.ranked(t(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"]).select("p_partkey", "rank")


def mapped_in_batches(spark, sf):
    def doubled(frames):
        for f in frames:
            yield f.assign(twice=f["l_quantity"] * 2)

    return collect.map_rows(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), doubled, "l_orderkey long, l_linenumber int, l_quantity double, twice double")


def pair_list(spark, sf):
    n = t(spark, sf, "nation")
    a, b = t(spark, sf, "region").select(F.col("r_regionkey").alias("i")), n.select(F.col("n_nationkey").alias("j"))
    return collect.ordered_pairs(a, b, "i", "j", F.col("i") * F.col("j")).select(F.col("at").cast("long").alias("at"), F.col("value").cast("long").alias("value"))


def jaro_pairs(spark, sf):
    n = t(spark, sf, "nation")
    p = similar.jaro_join(n, "n_name", 0.65)
    key = lambda name, as_: n.select(F.col("n_name").alias(name), F.col("n_nationkey").alias(as_))
    both = p.join(key("a", "x"), "a").join(key("b", "y"), "b")
    return both.select(F.least("x", "y").alias("n_nationkey_a"), F.greatest("x", "y").alias("n_nationkey_b"), "similarity")


def jaro_words(spark, sf):
    """Words of the test items that resemble one another, with how often each occurs."""
    n = collect.word_counts(t(spark, sf, "benchmark"), "text").select(F.col("key").alias("word"), "n")
    named = lambda side: n.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    return similar.jaro_join(n, "word", 0.65).join(named("a"), "a").join(named("b"), "b").select("a", "n_a", "b", "n_b", "similarity")


def jaro_hosts(spark, sf):
    """Pages' hosts that are nearly the same."""
    return similar.jaro_join(t(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")), "host", 0.9)


def dict_comprehension(spark, sf):
    items = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("items"))
    d = values.dictionary(F.col("items"), lambda x: x["l_returnflag"], lambda x: x["l_linenumber"].cast("string"), lambda x: x["l_quantity"] > 10)
    return items.select("l_orderkey", F.array_join(F.transform(F.sort_array(F.map_entries(d)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("dict"))


def object_functions(spark, sf):
    p = t(spark, sf, "part")
    a = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    b = F.create_map(F.lit("size"), F.concat(F.lit("x"), F.col("p_size")), F.lit("type"), F.col("p_type"))
    m = values.merge_objects(a, b)
    left = values.without(m, "brand")
    return p.select("p_partkey", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("names"), F.array_join(F.sort_array(F.map_values(left)), ",").alias("held"), F.size(F.map_entries(m)).cast("long").alias("n"), F.array_join(F.concat(F.sort_array(F.map_keys(a)), F.sort_array(F.map_keys(b))), ",").alias("joined"))


def object_exports(spark, sf):
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    p = t(spark, sf, "part").select("p_partkey", m.alias("m"))
    return p.select("p_partkey", sinks.canonical_json(F.col("m")).alias("json"), sinks.name_value(F.col("m")).alias("pairs"), sinks.environment(F.col("m")).alias("env"))


def number_functions(spark, sf):
    q = F.col("l_extendedprice") / 1000
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(q).alias("up"), F.floor(-q).alias("down"), values.int_divide(F.col("l_partkey"), F.col("l_linenumber") - 3).alias("div"), values.int_modulo(-F.col("l_partkey"), F.lit(7)).alias("mod"))


def byte_sizes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", strings.byte_size(F.octet_length("text") * F.col("doc_id")).alias("size")).where("size IS NOT NULL")


def events_of_a_span(spark, sf):
    low, high = strings.epoch("2024-01-03 06:00:00"), strings.epoch("2024-01-03 06:00:00") + strings.duration("2d")
    s = F.unix_timestamp("ts")
    return t(spark, sf, "events").where((s >= low) & (s < high)).groupBy((F.floor((s - low) / strings.duration("12h")) + 1).alias("half")).agg(F.count(F.lit(1)).alias("n"))


def dataset_predicates(spark, sf):
    d = dataset.Dataset(t(spark, sf, "customer").withColumn("note", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name"))))
    q = d.query("note IS NULL OR c_mktsegment LIKE 'B%'", "c_acctbal > 1000", d.c.c_nationkey != 3)
    return q.df.select("c_custkey", "c_mktsegment")


def wildcard_names(spark, sf):
    return t(spark, sf, "customer").where(dataset.matches(F.col("c_name"), "*0[!0-4][13579]")).select("c_custkey")


S = "CAST(floor(epoch(ts)) AS BIGINT)"
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
QUERIES = {
    "performance_deltas": (
        performance_deltas,
        """WITH o AS (SELECT CAST(floor(o_orderkey / 50) * 1000 AS BIGINT) AS timestamp, CAST(count(*) AS DOUBLE) AS tasks, CAST(sum(o_custkey) AS DOUBLE) AS bytes FROM orders GROUP BY 1)
        SELECT timestamp, tasks - lag(tasks) OVER w AS tasks_delta, bytes - lag(bytes) OVER w AS bytes_delta FROM o WINDOW w AS (ORDER BY timestamp)""",
    ),
    "debug_streams": (debug_streams, f"SELECT event_type AS program, 's' || (event_id % 3) AS stream, count(*) AS n, min({S}) AS first, max(user_id) AS pid, max('seen: ' || props) AS message FROM events GROUP BY 1, 2"),
    "workflow_run_summary": (
        workflow_run_summary,
        """WITH n AS (SELECT o_orderkey % 1000 AS node, arg_max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END, o_orderkey) AS state, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS ever FROM orders GROUP BY 1)
        SELECT count(*) AS total, count(*) FILTER (state = 2) AS completed, count(*) FILTER (state = 3) AS failed, count(*) FILTER (state = 4) AS aborted, CAST(sum(ever) AS BIGINT) AS ever_failed FROM n""",
    ),
    "dag_state_counts": (dag_state_counts, "SELECT state, count(*) AS n FROM (SELECT o_orderkey % 700 AS node, arg_max(o_custkey % 5, o_orderkey) AS state FROM orders GROUP BY 1) GROUP BY 1"),
    "attempts_lost": (attempts_lost, "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 + 4 END AS lost FROM orders"),
    "log_span": (
        log_span,
        f"""WITH l AS (SELECT {S} AS s, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'C' WHEN event_id % 17 = 3 THEN 'D' WHEN event_id % 17 = 5 THEN 'C' WHEN event_id % 17 = 7 THEN 'R' WHEN event_id % 17 = 9 THEN 'U' ELSE 'M' END AS op FROM events)
        SELECT op, count(*) AS n, CAST(sum(s) AS BIGINT) AS sum_ts, count(DISTINCT user_id) AS keys FROM l WHERE s BETWEEN 1704261600 AND 1704434399 GROUP BY 1""",
    ),
    "log_upgrade": (log_upgrade, "SELECT 'C' AS op, 'p' || p_partkey AS key, p_brand AS brand, p_name AS label, CAST(NULL AS VARCHAR) AS value FROM part UNION ALL SELECT 'U', 'p' || p_partkey, NULL, NULL, CAST(p_size AS VARCHAR) FROM part"),
    "resource_summary_units": (resource_summary_units, "SELECT p_brand AS category, CAST(sum(p_size) AS DOUBLE) AS memory, CAST(sum(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 7 END) AS DOUBLE) AS cores, count(*) FILTER (p_partkey % 4 <> 0) AS known, CAST(0 AS BIGINT) AS disks FROM part GROUP BY 1"),
    "successful_task_resources": (successful_task_resources, "SELECT o_orderkey AS task, CAST(1.5 AS DOUBLE) AS cores, CAST(o_custkey AS DOUBLE) AS memory, CAST(o_orderkey % 11 AS DOUBLE) AS disk, CAST(2 AS DOUBLE) AS time, CAST(floor(o_orderkey / 20 + 1) AS BIGINT) AS rate, (o_orderkey + 19) % 20 AS blocks FROM orders WHERE o_orderstatus = 'F'"),
    "transfer_statistics": (transfer_statistics, "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'OUTPUT' ELSE 'INPUT' END AS direction, CASE WHEN o_orderkey % 3 = 0 THEN 'FILE' ELSE 'URL' END AS kind, count(*) AS n, CAST(sum(o_custkey % 8) AS DOUBLE) AS mb, avg(o_orderkey % 4) AS mean_seconds FROM orders GROUP BY 1, 2"),
    "task_range_filter": (task_range_filter, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 10 AND 25 OR o_orderkey = 40 OR o_orderkey BETWEEN 100 AND 120"),
    "syscall_sorted": (syscall_sorted, "SELECT CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END AS action, '/d/f' || (l_suppkey % 30) AS path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, count(*) AS freq FROM lineitem GROUP BY 1, 2 ORDER BY action DESC, size DESC, freq DESC, path LIMIT 25"),
    "status_by_project": (status_by_project, "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS project, c_name AS owner FROM customer ORDER BY lower(coalesce(project, 'unknown')), owner, c_custkey LIMIT 40"),
    "heartbeat_normalised": (heartbeat_normalised, f"SELECT CASE WHEN page_id % 3 > 0 THEN 'p' || page_id ELSE {HOST} END AS name, {HOST} AS address, page_id AS lastheardfrom, least(length(html), 100) AS n FROM pages"),
    "catalog_tree": (
        catalog_tree,
        """WITH RECURSIVE c AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 7 > 0 THEN c_custkey // 3 END AS parent FROM customer),
        r AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM c WHERE parent IS NULL OR parent NOT IN (SELECT node FROM c) UNION ALL SELECT c.node, r.root, r.depth + 1 FROM c JOIN r ON c.parent = r.node)
        SELECT node, root, depth FROM r""",
    ),
    "degraded_replicas": (degraded_replicas, "SELECT p_partkey AS file, count(l_partkey) AS n, p_size % 4 + 28 - count(l_partkey) AS missing FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size HAVING count(l_partkey) < p_size % 4 + 28"),
    "common_prefix_of_children": (
        common_prefix_of_children,
        """WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS x FROM lineitem GROUP BY 1),
        g AS (SELECT l_orderkey // 2 AS parent, list(x) AS xs FROM l GROUP BY 1),
        k AS (SELECT parent, xs, coalesce(max(n), 0) AS n FROM (SELECT parent, xs, unnest(range(1, len(xs[1]) + 1)) AS n FROM g) WHERE len(list_filter(xs, lambda y: len(y) >= n AND list_slice(y, 1, n) = list_slice(xs[1], 1, n))) = len(xs) GROUP BY 1, 2)
        SELECT g.parent, array_to_string(list_slice(g.xs[1], 1, coalesce(k.n, 0)), ',') AS prefix FROM g LEFT JOIN k USING (parent)""",
    ),
    "node_residuals": (
        node_residuals,
        """WITH o AS (SELECT o_orderkey AS node, o_orderkey % 13 AS level, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS inputs, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS outputs
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT *, max(inputs + outputs) OVER (PARTITION BY level) AS least, CAST(sum(inputs + outputs) OVER (PARTITION BY level) AS BIGINT) AS most FROM o""",
    ),
    "storage_by_owner": (
        storage_by_owner,
        rf"""WITH p AS (SELECT {HOST} AS owner, regexp_replace(url, '[?#].*$', '') AS path, strlen(html) AS b FROM pages)
        SELECT owner, count(*) AS files, count(DISTINCT regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '[^/]*$', ''), '/+$', '')) AS dirs, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY 1""",
    ),
    "named_counters": (
        named_counters,
        """WITH e AS (SELECT user_id AS name, event_type = 'purchase' AS s, CAST(props->>'$.k' AS BIGINT) AS v, event_id FROM events),
        x AS (SELECT *, max(CASE WHEN s THEN event_id END) OVER (PARTITION BY name) AS set_at FROM e)
        SELECT name, CAST(sum(v) AS BIGINT) AS value FROM x WHERE set_at IS NULL OR event_id >= set_at GROUP BY 1""",
    ),
    "category_allocations": (
        category_allocations,
        """WITH b AS (SELECT l_returnflag, ceil(l_quantity / 5.0) * 5.0 AS bucket, count(*) AS n, sum(CAST(round(l_tax * 100) AS BIGINT)) AS spent FROM lineitem GROUP BY 1, 2),
        t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS BIGINT) AS cumulative, sum(n) OVER (PARTITION BY l_returnflag) AS total, sum(spent) OVER (PARTITION BY l_returnflag) AS all_spent, max(bucket) OVER (PARTITION BY l_returnflag) AS most,
          coalesce(sum(spent) OVER (PARTITION BY l_returnflag ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM b)
        SELECT l_returnflag, bucket, cumulative, round(bucket * all_spent / total + most * above / total, 6) AS waste FROM t""",
    ),
    "category_refits": (category_refits, "SELECT * FROM (SELECT o_orderpriority, row_number() OVER w AS completed, max(o_totalprice) OVER w AS known FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE completed % 25 = 0"),
    "stacked_per_time": (stacked_per_time, "SELECT CAST(epoch(o_orderdate) AS BIGINT) AS time, o_orderkey, o_custkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stacked, CAST(sum(o_custkey) OVER (PARTITION BY o_orderdate) AS BIGINT) AS total FROM orders"),
    "rebased_times": (
        rebased_times,
        """WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS b, CAST(epoch(o_orderdate) AS BIGINT) + o_custkey AS f FROM orders)
        SELECT o_orderkey, b - (SELECT min(b) FROM o) AS begin, f - (SELECT min(b) FROM o) AS finish FROM o
        UNION ALL SELECT o_orderkey, b - (SELECT max(f) FROM o), f - (SELECT max(f) FROM o) FROM o""",
    ),
    "scheduling_times": (
        scheduling_times,
        """WITH o AS (SELECT o_orderkey AS task, o_orderkey * o_orderkey AS acc, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nt FROM orders WHERE o_orderstatus = 'F')
        SELECT unnest(range(task, nt)) AS task, round((nt * nt - acc) / (nt - task), 6) AS seconds FROM o WHERE nt IS NOT NULL""",
    ),
    "deviation_band": (
        deviation_band,
        """WITH m AS (SELECT avg(l_quantity) AS mean, count(*) AS n FROM lineitem), d AS (SELECT mean, n, sqrt(sum((l_quantity - mean) * (l_quantity - mean)) / sqrt(n - 1)) AS deviation FROM lineitem, m GROUP BY 1, 2)
        SELECT round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(100.0 * count(*) FILTER (abs(l_quantity - mean) <= deviation) / n, 6) AS share FROM lineitem, d GROUP BY mean, deviation, n""",
    ),
    "interpolated_percentiles": (interpolated_percentiles, "WITH c AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem) SELECT l_returnflag, CAST(quantile_cont(x, 0.25) AS DOUBLE) AS low, CAST(quantile_cont(x, 0.5) AS DOUBLE) AS middle, CAST(quantile_cont(x, 0.75) AS DOUBLE) AS high FROM c GROUP BY 1"),
    "ranks_of_values": (ranks_of_values, "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank FROM part"),
    "mapped_in_batches": (mapped_in_batches, "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2 AS twice FROM lineitem"),
    "pair_list": (pair_list, "SELECT CAST(r_regionkey * 25 + n_nationkey AS BIGINT) AS at, CAST(r_regionkey * n_nationkey AS BIGINT) AS value FROM region, nation"),
    "jaro_pairs": (jaro_pairs, "SELECT least(a.n_nationkey, b.n_nationkey) AS n_nationkey_a, greatest(a.n_nationkey, b.n_nationkey) AS n_nationkey_b, round(jaro_similarity(a.n_name, b.n_name), 9) AS similarity FROM nation a JOIN nation b ON a.n_name < b.n_name AND round(jaro_similarity(a.n_name, b.n_name), 9) >= 0.65"),
    "jaro_words": (
        jaro_words,
        """WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word)
        SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b, round(jaro_similarity(a.word, b.word), 9) AS similarity FROM w a JOIN w b ON a.word < b.word AND round(jaro_similarity(a.word, b.word), 9) >= 0.65""",
    ),
    "jaro_hosts": (
        jaro_hosts,
        """WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)
        SELECT a.host AS a, b.host AS b, round(jaro_similarity(a.host, b.host), 9) AS similarity FROM h a JOIN h b ON a.host < b.host AND a.host <> '' AND round(jaro_similarity(a.host, b.host), 9) >= 0.9""",
    ),
    "dict_comprehension": (
        dict_comprehension,
        """WITH d AS (SELECT l_orderkey, l_returnflag AS k, arg_max(l_linenumber, (l_linenumber, l_quantity)) AS v FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2), g AS (SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) AS dict FROM d GROUP BY 1)
        SELECT o.l_orderkey, coalesce(dict, '') AS dict FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN g USING (l_orderkey)""",
    ),
    "object_functions": (object_functions, "SELECT p_partkey, 'brand,size,type' AS names, array_to_string(list_sort(['x' || p_size, p_type]), ',') AS held, CAST(3 AS BIGINT) AS n, 'brand,size,size,type' AS joined FROM part"),
    "object_exports": (object_exports, """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '"}' AS json, 'brand ' || p_brand || chr(10) || 'name ' || p_name AS pairs, 'export brand="' || p_brand || '"' || chr(10) || 'export name="' || p_name || '"' AS env FROM part"""),
    "number_functions": (number_functions, "SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS up, CAST(floor(-(l_extendedprice / 1000)) AS BIGINT) AS down, CASE WHEN l_linenumber <> 3 THEN CAST(trunc(l_partkey / (l_linenumber - 3)) AS BIGINT) END AS div, (-l_partkey) % 7 AS mod FROM lineitem"),
    "byte_sizes": (
        byte_sizes,
        """WITH n AS (SELECT doc_id, strlen(text) * doc_id AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM n)
        SELECT doc_id, printf('%.2f', n / pow(1024.0, k)) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] AS size FROM p""",
    ),
    "events_of_a_span": (events_of_a_span, f"SELECT CAST(floor(({S} - 1704261600) / 43200) + 1 AS BIGINT) AS half, count(*) AS n FROM events WHERE {S} >= 1704261600 AND {S} < 1704434400 GROUP BY 1"),
    "dataset_predicates": (dataset_predicates, "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_custkey % 4 = 0 OR c_mktsegment LIKE 'B%') AND c_acctbal > 1000 AND c_nationkey <> 3"),
    "wildcard_names": (wildcard_names, "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, '.*0[^0-4][13579]')"),
}
