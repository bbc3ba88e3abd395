"""Queries that search a folder tree, and that predict what a run should be given from buckets of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dataset, stats
from tidemark.sources.tables import shared_folder
from tidemark.sources.tables import table as t


def path_search(spark, sf):
    """Folders of a tree of customers by nation and segment: by a path from its root on, or by a segment anywhere."""
    root = shared_folder(spark, "tree")
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lower("c_mktsegment").alias("segment"), "c_custkey")
    c.repartition("nation").write.partitionBy("nation", "segment").parquet(root)
    found = dataset.find(spark, root, "/nation=1*/segment=[a-f]*|segment=h*")
    return found.select("path", "is_dir")


def path_search_first(spark, sf):
    """The least folder by segment of every nation below 10: no other nation's folder is listed."""
    root = shared_folder(spark, "tree")
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lower("c_mktsegment").alias("segment"), "c_custkey")
    c.repartition("nation").write.partitionBy("nation", "segment").parquet(root)
    return dataset.find(spark, root, "/nation=?/segment=*", first=True).select("path", "is_dir")


def _buckets(spark, sf) -> DataFrame:
    """Sizes of every brand's parts, later ones weighing more, in buckets up to 10, 20, 35 and 50."""
    p = t(spark, sf, "part").where("p_brand <> 'Brand#1'").select("p_brand", "p_size", (F.col("p_partkey") + 1).alias("weight"))
    uppers = p.select("p_brand").distinct().select("p_brand", F.explode(F.array(*[F.lit(x) for x in (10.0, 20.0, 35.0, 50.0)])).alias("upper"))
    return stats.bucket_probabilities(p, "p_brand", "p_size", "weight", uppers)


def _tries(spark, sf) -> DataFrame:
    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") * 2 - 20).alias("q"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    draw = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007) / 10007
    return l.join(p, "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", F.when(F.col("q") > 0, F.col("q")).alias("tried"), draw.alias("draw"))


def _totals(tries: DataFrame) -> DataFrame:
    return tries.groupBy("p_brand", "allocation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("tried", F.lit(0.0))).cast("long").alias("tried"))


def bucket_predictions(spark, sf):
    """What runs get whose last try is known, by a draw over the buckets left."""
    return _totals(stats.predicted_tries(_tries(spark, sf), "p_brand", "tried", _buckets(spark, sf), 4.0, 2.0, "draw"))


def bucket_predictions_next(spark, sf):
    """The same without a draw: the next larger bucket."""
    return _totals(stats.predicted_tries(_tries(spark, sf), "p_brand", "tried", _buckets(spark, sf), 4.0, 2.0))


FOLDERS = "f AS (SELECT DISTINCT c_nationkey AS n, lower(c_mktsegment) AS s FROM customer)"
BUCKETS = """p AS (SELECT p_brand, p_size, p_partkey + 1 AS weight, CASE WHEN p_size <= 10 THEN 10.0 WHEN p_size <= 20 THEN 20.0 WHEN p_size <= 35 THEN 35.0 ELSE 50.0 END AS upper FROM part WHERE p_brand <> 'Brand#1'),
b AS (SELECT p_brand, upper, sum(weight) / sum(sum(weight)) OVER (PARTITION BY p_brand) AS prob FROM p GROUP BY 1, 2),
x AS (SELECT row_number() OVER () AS id, p_brand, CASE WHEN l_linenumber % 3 > 0 AND l_quantity * 2 - 20 > 0 THEN l_quantity * 2 - 20 END AS tried, ((l_orderkey * 7919 + l_linenumber * 104729) % 10007) / 10007.0 AS draw FROM lineitem JOIN part ON p_partkey = l_partkey)"""
GROWN = "CASE WHEN tried IS NULL THEN 4.0 ELSE 4.0 * pow(2.0, floor(ln(tried / 4.0) / ln(2.0) + 1e-12) + 1) END"
TOTALS = "SELECT p_brand, CAST(allocation AS DOUBLE) AS allocation, count(*) AS n, CAST(sum(coalesce(tried, 0)) AS BIGINT) AS tried FROM a GROUP BY 1, 2"
QUERIES = {
    "path_search": (path_search, f"WITH {FOLDERS} SELECT '/nation=' || n || '/segment=' || s AS path, true AS is_dir FROM f WHERE (n = 1 OR n BETWEEN 10 AND 19) AND s[1] BETWEEN 'a' AND 'f' OR s[1] = 'h'"),
    "path_search_first": (path_search_first, f"WITH {FOLDERS} SELECT '/nation=' || n || '/segment=' || min(s) AS path, true AS is_dir FROM f WHERE n < 10 GROUP BY n"),
    "bucket_predictions": (
        bucket_predictions,
        f"""WITH {BUCKETS}, y AS (SELECT x.*, b.upper, sum(prob) OVER w AS upto, sum(prob) OVER (PARTITION BY id) AS whole, row_number() OVER (PARTITION BY id ORDER BY upper DESC) AS from_end
          FROM x LEFT JOIN b ON b.p_brand = x.p_brand AND b.upper > coalesce(tried, -1) WINDOW w AS (PARTITION BY id ORDER BY upper)),
        a AS (SELECT id, any_value(p_brand) AS p_brand, any_value(tried) AS tried, coalesce(min(upper) FILTER (upto / whole > draw), max(upper), any_value({GROWN})) AS allocation FROM y GROUP BY id)
        {TOTALS}""",
    ),
    "bucket_predictions_next": (
        bucket_predictions_next,
        f"""WITH {BUCKETS}, a AS (SELECT id, any_value(x.p_brand) AS p_brand, any_value(tried) AS tried, coalesce(min(upper), any_value({GROWN})) AS allocation
          FROM x LEFT JOIN b ON b.p_brand = x.p_brand AND b.upper > coalesce(tried, -1) GROUP BY id)
        {TOTALS}""",
    ),
}
