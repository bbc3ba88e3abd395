"""Queries of resource statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import stats, timeseries
from tidemark.sources.tables import table as t


def histogram_buckets(spark, sf):
    return stats.histogram(t(spark, sf, "lineitem"), "l_extendedprice", 2500.0)


def log2_histogram(spark, sf):
    return stats.log2_histogram(t(spark, sf, "lineitem"), "l_quantity")


def histogram_mode(spark, sf):
    l = t(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return stats.mode(l, "l_quantity", 5.0, "at")


def _buckets(spark, sf):
    l = t(spark, sf, "lineitem")
    return l.groupBy(stats.bucket(F.col("l_quantity"), 5.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1))).alias("mean_time"))


def cumulative_tail_means(spark, sf):
    return stats.tails(_buckets(spark, sf)).select("bucket", "n", "cumulative", F.round("tail_time", 6).alias("tail_time"))


def first_allocation_min_waste(spark, sf):
    return stats.min_waste(_buckets(spark, sf)).withColumn("waste", F.round("waste", 6))


def first_allocation_max_throughput(spark, sf):
    return stats.max_throughput(_buckets(spark, sf)).withColumn("throughput", F.round("throughput", 9))


def first_allocation_max_seen(spark, sf):
    return stats.max_seen(t(spark, sf, "lineitem"), "l_extendedprice", 1000.0, 90000.0)


def quantized_buckets(spark, sf):
    return stats.quantized_buckets(t(spark, sf, "part"), "p_retailprice", ["p_partkey"], 10).withColumn("bucket", F.col("bucket").cast("long"))


def greedy_buckets(spark, sf):
    return stats.greedy_buckets(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 1.0)


def _summaries(spark, sf):
    return t(spark, sf, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(F.col("p_size")).alias("cores"), F.when(F.col("p_size") > 40, -1).otherwise(F.col("p_size") * 2).alias("memory"))


def summary_merge_max_min_add(spark, sf):
    columns = [m for how in ("max", "min", "add", "override", "default") for m in stats.merged(how, ["cores", "memory"], "p_partkey", "" if how == "max" else f"_{how}")]
    return _summaries(spark, sf).groupBy("p_brand").agg(*columns)


def max_with_peak_time(spark, sf):
    l = t(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return stats.peaks(l, ["l_returnflag"], "at", ["l_quantity", "l_extendedprice"])


def limit_check(spark, sf):
    l = t(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.array_join(stats.over_limits(l, {"l_quantity": 45, "l_extendedprice": 80000, "l_discount": 0.09}), ",").alias("exceeded")).where("exceeded <> ''")


def running_maxima(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("so_far"), F.when(F.max("o_totalprice").over(w) > 400000, "over").otherwise("within").alias("state"))


def worker_slots(spark, sf):
    o = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("worker"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 97 + 1).alias("end"))
    return timeseries.slots(o, "worker", "start", "end")


B = """b AS (SELECT ceil(l_quantity / 5.0) * 5.0 AS bucket, count(*) AS n, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS mean_time FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS cumulative, sum(n) OVER () AS total, coalesce(sum(mean_time * n) OVER (ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS tail_time, max(bucket) OVER () AS am, sum(mean_time * n) OVER () / sum(n) OVER () AS tau FROM b),
c AS (SELECT bucket, bucket * tau + am * tail_time AS waste, (cumulative / total * am / bucket + 1 - cumulative / total) / (tau + tail_time) AS throughput FROM t)"""
P = "p AS (SELECT p_brand, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS cores, CASE WHEN p_size > 40 THEN NULL ELSE p_size * 2 END AS memory FROM part)"
MERGE = ", ".join(
    f"CAST(coalesce(max({c}), -1) AS INTEGER) AS {c}, CAST(coalesce(min({c}), -1) AS INTEGER) AS {c}_min, CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}_add, coalesce(arg_max({c}, k) FILTER ({c} IS NOT NULL), -1) AS {c}_override, coalesce(arg_min({c}, k) FILTER ({c} IS NOT NULL), -1) AS {c}_default"
    for c in ("cores", "memory")
)
QUERIES = {
    "histogram_buckets": (histogram_buckets, "SELECT ceil(l_extendedprice / 2500.0) * 2500.0 AS bucket, count(*) AS n FROM lineitem GROUP BY 1"),
    "log2_histogram": (log2_histogram, "SELECT CAST(floor(log2(l_quantity) + 1e-12) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1"),
    "histogram_mode": (
        histogram_mode,
        """WITH h AS (SELECT ceil(l_quantity / 5.0) * 5.0 AS bucket, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS reached FROM lineitem GROUP BY 1)
        SELECT arg_max(bucket, (n, -reached)) AS mode, max(n) AS mode_count, (SELECT greatest(max(l_quantity), 0.0) FROM lineitem) AS max, (SELECT least(min(l_quantity), 0.0) FROM lineitem) AS min, CAST(sum(n) AS BIGINT) AS total FROM h""",
    ),
    "cumulative_tail_means": (cumulative_tail_means, f"WITH {B} SELECT bucket, n, CAST(cumulative AS BIGINT) AS cumulative, round(tail_time, 6) AS tail_time FROM t"),
    "first_allocation_min_waste": (first_allocation_min_waste, f"WITH {B} SELECT arg_min(bucket, (waste, bucket)) AS allocation, round(min(waste), 6) AS waste FROM c"),
    "first_allocation_max_throughput": (first_allocation_max_throughput, f"WITH {B} SELECT arg_max(bucket, (throughput, -bucket)) AS allocation, round(max(throughput), 9) AS throughput FROM c"),
    "first_allocation_max_seen": (first_allocation_max_seen, "SELECT least(ceil((max(l_extendedprice) + 1000.0 / 3) / 1000.0) * 1000.0, 90000.0) AS allocation FROM lineitem"),
    "quantized_buckets": (quantized_buckets, "SELECT bucket, max(p_retailprice) AS upper, count(*) AS n FROM (SELECT p_retailprice, ntile(10) OVER (ORDER BY p_retailprice, p_partkey) AS bucket FROM part) GROUP BY 1"),
    "greedy_buckets": (greedy_buckets, None),
    "summary_merge_max_min_add": (summary_merge_max_min_add, f"WITH {P} SELECT p_brand, {MERGE} FROM p GROUP BY 1"),
    "max_with_peak_time": (
        max_with_peak_time,
        "SELECT l_returnflag, max(l_quantity) AS l_quantity, arg_max(seq, (l_quantity, -seq)) AS l_quantity_at, max(l_extendedprice) AS l_extendedprice, arg_max(seq, (l_extendedprice, -seq)) AS l_extendedprice_at FROM (SELECT *, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY 1",
    ),
    "limit_check": (limit_check, "SELECT * FROM (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'l_quantity' END, CASE WHEN l_extendedprice > 80000 THEN 'l_extendedprice' END, CASE WHEN l_discount > 0.09 THEN 'l_discount' END) AS exceeded FROM lineitem) WHERE exceeded <> ''"),
    "running_maxima": (running_maxima, "SELECT o_orderkey, so_far, CASE WHEN so_far > 400000 THEN 'over' ELSE 'within' END AS state FROM (SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS so_far FROM orders)"),
    "worker_slots": (
        worker_slots,
        """WITH RECURSIVE t AS (SELECT o_custkey % 50 AS worker, o_orderkey AS start, o_orderkey + o_custkey % 97 + 1 AS "end", row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey, o_custkey % 97) AS i FROM orders),
        r AS (SELECT worker, start, "end", i, 1 AS slot, ["end"] AS ends FROM t WHERE i = 1
          UNION ALL SELECT worker, start, "end", i, slot, ends[:slot - 1] || ["end"] || ends[slot + 1:] FROM
            (SELECT t.*, r.ends, CAST(coalesce(nullif(list_position(list_transform(r.ends, lambda x: x <= t.start), true), 0), len(r.ends) + 1) AS INTEGER) AS slot FROM r JOIN t ON t.worker = r.worker AND t.i = r.i + 1))
        SELECT worker, start, "end", slot FROM r""",
    ),
}
