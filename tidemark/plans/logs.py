"""Queries of log readers and streams: lines are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import collect, stats, timeseries
from tidemark.plans.temporal import as_history
from tidemark.sources import eventlog, logs
from tidemark.sources.tables import table as t


def _transaction_lines(spark, sf):
    """Every order is a task: ready at its key, running on worker custkey % 20, done with its status."""
    o = t(spark, sf, "orders")
    at = lambda d: ((F.col("o_orderkey") * 10 + d) * 1000).cast("string")
    line = lambda d, *rest: F.concat_ws(" ", at(d), F.lit("m"), F.lit("TASK"), F.col("o_orderkey").cast("string"), *rest)
    worker = F.concat(F.lit("w"), (F.col("o_custkey") % 20).cast("string"))
    again = F.when(F.col("o_orderkey") % 5 == 0, line(3, F.lit("READY"), F.lit("retry")))
    lines = F.array_compact(F.array(line(1, F.lit("READY"), F.col("o_orderstatus")), line(2, F.lit("RUNNING"), worker), again, line(4, F.lit("DONE"), F.lit("SUCCESS"))))
    return o.select(F.explode(lines).alias("value")).unionByName(spark.createDataFrame([("# a comment",), ("0 m MANAGER m START 0",)], "value string"))


def transaction_log_tasks(spark, sf):
    a = logs.tasks(logs.transactions(_transaction_lines(spark, sf)))
    return a.groupBy("attempt", F.coalesce("worker", F.lit("-")).alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.count("done").alias("done"), F.round(F.sum(F.col("done") - F.col("ready")) * 1000).cast("long").alias("ms"))


def task_graph_tables(spark, sf):
    l = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("ins"))
    lines = l.select(F.concat(F.lit("TASK "), F.col("l_orderkey").cast("string"), F.lit(' "order task" INPUTS '), F.array_join("ins", " "), F.lit(" OUTPUTS o"), F.col("l_orderkey").cast("string")).alias("value"))
    _, _, edges = logs.task_graph(lines)
    return edges.groupBy("direction", F.substring("file", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def syscall_directories(spark, sf):
    call = F.when(F.col("l_returnflag") == "R", "read").otherwise("write")
    lines = t(spark, sf, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), call, F.lit("(3</data/s"), (F.col("l_suppkey") % 30).cast("string"), F.lit('/f>, "x", 9) = '), F.col("l_quantity").cast("int").cast("string")).alias("value"))
    return logs.directory_totals(logs.syscalls(lines))


def event_log_round_trip(spark, sf):
    h = as_history(spark, sf)
    lines = eventlog.to_lines(h).select("part", F.row_number().over(_file_order()).alias("line_no"), "line")
    return eventlog.parse(lines).where("op NOT IN ('T', 't')").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.countDistinct("key").alias("keys"))


def _file_order():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("seq", F.col("line").startswith("T ").desc())


def latest_attempt_per_task(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("attempt"))
    return timeseries.latest_attempt(e, "user_id", ["event_id"], "attempt").select("event_id", "attempt")


def fill_missing_end(spark, sf):
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("begin"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey") * 10 + F.col("l_linenumber") * 2).alias("finish"))
    return timeseries.fill_end(l, ["l_orderkey"], "begin", "finish").select("l_orderkey", "l_linenumber", "finish")


def series_from_first_dispatch(spark, sf):
    e = t(spark, sf, "events").select("event_id", "event_type", F.unix_timestamp("ts").alias("s"))
    return timeseries.from_first(e, "s", F.col("event_type") == "purchase").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"))


def tree_reduce_function(spark, sf):
    return collect.reduce_with(t(spark, sf, "lineitem"), "l_quantity", max, arity=25).select(F.col("value").alias("high"))


def windows_of_results(spark, sf):
    return collect.windows_of(t(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 8).select("group", F.aggregate("values", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size("values").cast("long").alias("n"))


def wavefront_grid(spark, sf):
    n = t(spark, sf, "region").withColumnRenamed("r_regionkey", "n_nationkey")
    top = n.select(F.col("n_nationkey").alias("j"), (F.col("n_nationkey") + 1).cast("long").alias("value"))
    left = n.select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * 2 + 1).cast("long").alias("value"))
    return collect.wavefront(top, left, 5, lambda u, l, d: (u + l - d + 1) % 1000)


def exhaustive_buckets(spark, sf):
    return stats.exhaustive_buckets(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 1.0, 4)


def predicted_allocations(spark, sf):
    b = t(spark, sf, "lineitem").groupBy("l_returnflag", stats.bucket(F.col("l_quantity"), 5.0).alias("upper")).agg(F.count(F.lit(1)).alias("n"))
    return stats.predicted_allocation(b, "l_returnflag", F.col("upper") > 0, 0.7)


S = "CAST(floor(epoch(ts)) AS BIGINT)"
QUERIES = {
    "transaction_log_tasks": (
        transaction_log_tasks,
        """WITH a AS (SELECT 1 AS attempt, 'w' || (o_custkey % 20) AS worker, o_orderkey % 5 <> 0 AS done, 3 AS ms FROM orders
          UNION ALL SELECT 2, '-', true, 1 FROM orders WHERE o_orderkey % 5 = 0)
        SELECT CAST(attempt AS BIGINT) AS attempt, worker, count(*) AS n, count(*) FILTER (done) AS done, CAST(sum(CASE WHEN done THEN ms END) AS BIGINT) AS ms FROM a GROUP BY 1, 2""",
    ),
    "task_graph_tables": (
        task_graph_tables,
        """WITH e AS (SELECT DISTINCT 'IN' AS direction, 'p' AS kind, l_orderkey AS task, 'p' || l_partkey AS file FROM lineitem
          UNION ALL SELECT DISTINCT 'OUT', 'o', l_orderkey, 'o' || l_orderkey FROM lineitem)
        SELECT direction, kind, count(*) AS n, count(DISTINCT file) AS files FROM e GROUP BY 1, 2""",
    ),
    "syscall_directories": (
        syscall_directories,
        """SELECT '/data/s' || (l_suppkey % 30) AS directory, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS read_bytes,
          CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS written_bytes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1 ORDER BY bytes DESC, directory LIMIT 10""",
    ),
    "event_log_round_trip": (
        event_log_round_trip,
        f"""WITH l AS (SELECT {S} AS s, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'C' WHEN event_id % 17 = 3 THEN 'D' WHEN event_id % 17 = 5 THEN 'C' WHEN event_id % 17 = 7 THEN 'R' WHEN event_id % 17 = 9 THEN 'U' ELSE 'M' END AS op FROM events)
        SELECT op, count(*) AS n, CAST(sum(s) AS BIGINT) AS sum_ts, count(DISTINCT user_id) AS keys FROM l GROUP BY 1""",
    ),
    "latest_attempt_per_task": (latest_attempt_per_task, "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempt FROM events"),
    "fill_missing_end": (
        fill_missing_end,
        """WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS b, CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber * 2 END AS f FROM lineitem)
        SELECT l_orderkey, l_linenumber, coalesce(f, max(greatest(b, coalesce(f, b))) OVER (PARTITION BY l_orderkey)) AS finish FROM x""",
    ),
    "series_from_first_dispatch": (series_from_first_dispatch, f"SELECT event_type, count(*) AS n, min({S}) AS first FROM events WHERE {S} >= (SELECT min({S}) FROM events WHERE event_type = 'purchase') GROUP BY 1"),
    "tree_reduce_function": (tree_reduce_function, "SELECT max(l_quantity) AS high FROM lineitem"),
    "windows_of_results": (windows_of_results, "SELECT CAST(floor((r - 1) / 8) AS BIGINT) AS \"group\", CAST(sum(p_size) AS BIGINT) AS total, count(*) AS n FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1"),
    "wavefront_grid": (
        wavefront_grid,
        # R[i,j] = R[i-1,j] + R[i,j-1] - R[i-1,j-1] + 1 from edges j + 1 and 2 i + 1 is i * j + 2 i + j + 1
        "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST((i * j + 2 * i + j + 1) % 1000 AS BIGINT) AS value FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)",
    ),
    "exhaustive_buckets": (exhaustive_buckets, None),
    "predicted_allocations": (
        predicted_allocations,
        """WITH b AS (SELECT l_returnflag, ceil(l_quantity / 5.0) * 5.0 AS upper, count(*) AS n FROM lineitem GROUP BY 1, 2),
        c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY upper) / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM b)
        SELECT l_returnflag, min(upper) AS allocation FROM c WHERE share >= 0.7 AND upper > 0 GROUP BY 1""",
    ),
}
