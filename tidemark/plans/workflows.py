"""Workflows made of the orders: a task for every customer, order and line item, and tasks that collect what these leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import storage
from tidemark.sources.tables import checkpointed
from tidemark.sources.tables import table as t


def workflow_storage(spark, sf):
    """Customer -> orders -> line items -> one collecting task an order -> one a customer, whose output is final."""
    lines, orders, people = t(spark, sf, "lineitem"), t(spark, sf, "orders"), t(spark, sf, "customer")
    numbered = _fits([(people, "c_custkey", 11), (orders, "o_orderkey", 11), (orders, "o_custkey", 11), (lines, "l_orderkey", 11), (lines, "l_linenumber", 3)])
    name = _number if numbered else _name
    # by shuffles, and each table made once: what grows with the orders is not sent to the driver
    lines = checkpointed(lines.groupBy(F.col("l_orderkey").alias("o"), "l_linenumber").agg(F.max(F.floor(F.col("l_quantity") * 100)).alias("size")))
    orders = orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.floor(F.col("o_totalprice") / 100).alias("size")).hint("merge").join(lines.select("o").distinct(), "o", "left_semi")
    people = people.select(F.col("c_custkey").alias("c"), F.floor(F.abs("c_acctbal")).alias("size"))
    orders = orders.hint("merge").join(people.select("c"), "c", "left_semi").withColumns({"c_": name("c", "c"), "o_": name("o", "o"), "j_": name("j", "o"), "k_": name("k", "c")})
    orders = checkpointed(orders)
    people = checkpointed(people.hint("merge").join(orders.select("c").distinct(), "c", "left_semi").withColumns({"c_": name("c", "c"), "k_": name("k", "c")}))
    lines = checkpointed(lines.hint("merge").join(orders.select("o", "o_", "j_").distinct(), "o").select("size", "o_", "j_", name("l", "o", "l_linenumber").alias("l_")))
    c, o, j, k, item = (F.col(x) for x in ("c_", "o_", "j_", "k_", "l_"))
    files = lambda df, name, size: df.select(name.alias("file"), size.cast("long").alias("size"))
    needs = lambda df, file, node: df.select(file.alias("file"), node.alias("node"))
    sizes = files(people, c, F.col("size")).union(files(orders, o, F.col("size"))).union(files(lines, item, F.col("size")))
    sizes = sizes.union(files(orders, j, F.col("o") % 97)).union(files(people, k, F.lit(10)))
    needed = needs(orders, c, o).union(needs(lines, o, item)).union(needs(lines, item, j)).union(needs(orders, j, k))
    # a file is named after the task that makes it
    out = storage.footprints(sizes, sizes.select("file", F.col("file").alias("node")), needed, people.select(k.alias("file")))
    return out.withColumn("node", _named(F.col("node"))) if numbered else out


KINDS = "cjklo"  # in the order of their letters


def _name(kind: str, key: str, line: str | None = None) -> Column:
    name = F.concat(F.lit(kind), F.col(key).cast("string"))
    return name if line is None else F.concat(name, F.lit("."), F.col(line).cast("string"))


def _number(kind: str, key: str, line: str | None = None) -> Column:
    """A number that orders as the name does among names of one kind and, with lines, one key: digits from the left, then how many they are."""
    digits = lambda x, most: F.rpad(F.col(x).cast("string"), most, "0").cast("long")
    code = F.lit(KINDS.index(kind) << 41).cast("long") + digits(key, 11) * 16 + F.length(F.col(key).cast("string"))
    return F.shiftleft(code, 12) if line is None else F.shiftleft(code, 12) + digits(line, 3) * 4 + F.length(F.col(line).cast("string"))


def _named(number: Column) -> Column:
    """The name of a number."""
    digits = lambda code, bits, most: F.lpad(F.shiftright(code, bits).cast("string"), most, "0").substr(F.lit(1), code.bitwiseAND((1 << bits) - 1).cast("int"))
    code, line = F.shiftright(number, 12), number.bitwiseAND(4095)
    kind = F.lit(KINDS).substr((F.shiftright(code, 41) + 1).cast("int"), F.lit(1))
    name = F.concat(kind, digits(code.bitwiseAND((1 << 41) - 1), 4, 11))
    return F.when(line == 0, name).otherwise(F.concat(name, F.lit("."), digits(line, 2, 3)))


def _fits(keys: list[tuple[DataFrame, str, int]]) -> bool:
    """Whether every key is a whole number of at most so many digits; others keep their names."""
    whole = all(rows.schema[key].dataType.typeName() in ("long", "integer", "short", "byte") for rows, key, _ in keys)
    return whole and all(rows.where(~F.col(key).between(0, 10**most - 1)).isEmpty() for rows, key, most in keys)


WORKFLOW_STORAGE = """
WITH li AS (SELECT l_orderkey AS o, l_linenumber AS n, MAX(CAST(FLOOR(l_quantity * 100) AS BIGINT)) AS l FROM lineitem GROUP BY 1, 2),
per_order AS (SELECT o, COUNT(*) AS n, SUM(l) AS ls FROM li GROUP BY o),
ord AS (
  SELECT r.o_orderkey AS o, r.o_custkey AS c, 'o' || r.o_orderkey AS name, CAST(FLOOR(r.o_totalprice / 100) AS BIGINT) AS os, r.o_orderkey % 97 AS js,
         p.n, CAST(p.ls AS BIGINT) AS ls, CAST(FLOOR(ABS(u.c_acctbal)) AS BIGINT) AS cs
  FROM orders r JOIN per_order p ON p.o = r.o_orderkey JOIN customer u ON u.c_custkey = r.o_custkey),
branch AS (
  SELECT *, GREATEST(ls + js, cs + os, os + ls) AS w,
         CASE WHEN (CASE WHEN n > 1 THEN cs > ls ELSE cs >= ls END) AND cs + os >= ls + js THEN 1 ELSE 0 END AS has_c
  FROM ord),
turn AS (SELECT *, COALESCE(SUM(js) OVER (PARTITION BY c ORDER BY js - w, js, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_before,
                ROW_NUMBER() OVER (PARTITION BY c ORDER BY w DESC, name) AS heaviest FROM branch),
per_customer AS (
  SELECT c, MAX(cs) AS cs, COUNT(*) AS m, SUM(js) AS js, MAX(cs + left_before + w - has_c * cs) AS del,
         SUM(js) + MAX(CASE WHEN heaviest = 1 THEN w - js END) AS tog, SUM(w) - GREATEST(SUM(has_c) - 1, 0) * MAX(cs) AS unb
  FROM turn GROUP BY c),
all_nodes AS (
  SELECT 'c' || c AS node, cs AS run, m > 1 AS splits, del, tog, unb FROM per_customer
  UNION ALL SELECT 'k' || c, js + 10, FALSE, 0, 0, 0 FROM per_customer
  UNION ALL SELECT name, cs + os, n > 1, os + ls, os + ls, os + ls FROM ord
  UNION ALL SELECT 'j' || o, ls + js, FALSE, 0, 0, 0 FROM ord
  UNION ALL SELECT 'l' || li.o || '.' || li.n, ord.os + li.l, FALSE, 0, 0, 0 FROM li JOIN ord ON ord.o = li.o),
plain AS (SELECT node, run, CASE WHEN splits THEN del ELSE 0 END AS del, CASE WHEN splits THEN tog ELSE 0 END AS tog, CASE WHEN splits THEN unb ELSE 0 END AS unb FROM all_nodes)
SELECT node, CAST(run AS BIGINT) AS run, CAST(del AS BIGINT) AS deleting, CAST(tog AS BIGINT) AS together, CAST(unb AS BIGINT) AS unbounded,
       CAST(GREATEST(run, LEAST(del, tog)) AS BIGINT) AS least, CAST(GREATEST(unb, del, run) AS BIGINT) AS most,
       CASE WHEN run > LEAST(del, tog) THEN 'run' WHEN del <= tog THEN 'deleting' ELSE 'together' END AS kind
FROM plain
"""

QUERIES = {"workflow_storage": (workflow_storage, WORKFLOW_STORAGE)}
