"""Queries over what sinks write: objects as rows, CSV tables read back, a stream dealt in turn, a graph as dot lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources import sinks
from tidemark.sources.tables import shared_folder
from tidemark.sources.tables import table as t


def object_display(spark, sf):
    """Customers as objects, one JSON text a row, shown by the segment that is their step."""
    c = t(spark, sf, "customer")
    attrs = F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("key"), F.col("c_custkey").cast("string"))
    return sinks.object_rows(c.select(F.col("c_mktsegment").alias("step"), attrs.alias("attrs")), "step", "attrs")


def csv_tables(spark, sf):
    """Two tables written as CSV with headers and read back by the names in these."""
    root = shared_folder(spark, "csv")
    sinks.write_tables(root, customers=t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), nations=t(spark, sf, "nation").select("n_nationkey", "n_name"))
    read = lambda name: spark.read.option("header", "true").csv(f"{root}/{name}")
    both = read("customers").join(read("nations"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "n_name")


def stream_dealt_in_turn(spark, sf):
    """How many of all orders' lines each of seven folders gets."""
    root = shared_folder(spark, "dealt")
    sinks.split_stream(t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")), root, 7)
    return spark.read.text(root).groupBy(F.col("host").cast("long").alias("host")).agg(F.count(F.lit(1)).alias("n"))


def graph_as_dot(spark, sf):
    """Nations and their suppliers as the lines of a dot graph."""
    s = t(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("child"))
    return graph.to_dot(s)


QUERIES = {
    "object_display": (object_display, """SELECT c_mktsegment AS step, '{"key":"' || c_custkey || '","name":"' || c_name || '","nation":"' || c_nationkey || '"}' AS object FROM customer"""),
    "csv_tables": (csv_tables, "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "stream_dealt_in_turn": (stream_dealt_in_turn, "SELECT i % 7 AS host, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS i FROM orders) GROUP BY 1"),
    "graph_as_dot": (graph_as_dot, """SELECT 'digraph {' AS line UNION ALL SELECT '}' UNION ALL SELECT '"n' || s_nationkey || '" -> "' || s_name || '";' FROM supplier"""),
}
