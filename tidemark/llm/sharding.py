"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

A tree is a table of nodes: every inner node has weighted children.  A row descends from the root; at each node
every child draws  -ln(u) / weight , u being a hash of the row's key and the child's name in (0, 1), and the least
draw wins, so a child gets its weight's share of what its parent has.  Draws depend on nothing but key, name and
weight: when weights change, rows only move into or out of the children whose own weight changed, and all
that lies below other children stays as it is.  An inner node's weight is stated with it (``leaves`` sums it), so a
change inside a rack whose weight is kept moves rows inside that rack alone.

The law held is ``key``: doc_id and the tree decide.  ``grown`` adds one shard as a region of its own, whose
draws can only win rows from the others, so the new shard takes rows and no other does.

Assigning is a projection without a shuffle.  ``slots`` numbers the rows of every shard from 0 in the order of a
hash, in two levels: counts over 65,536 buckets a shard, and rows inside a bucket.  Repeated rows are counted before
the shuffle and dealt out again in pieces, so they are no hot task.

Defined results: null texts have size 1 and checksum 0, as they have no bytes; rows with a null doc_id share one
key, hence a shard; rows of one doc_id share a shard whatever their texts; repeated rows each get a slot; an empty
table gives no rows; extra columns are not read by ``slots`` and kept by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: parent -> [(child, weight)]; the root is "", a shard's name ends in its number.
Tree = dict[str, list[tuple[str, float]]]

LEVELS = ("region", "rack", "shard")
#: Copies of a row that one task deals out.
COPIES = 4096


def leaves(shards: list[tuple[int, int, int, float]]) -> Tree:
    """(region, rack, shard, weight) rows as a tree whose racks and regions weigh what is in them."""
    tree: Tree = {}
    for at in (1, 2, 3):
        for parent in dict.fromkeys(x[: at - 1] for x in shards):
            below = [x for x in shards if x[: at - 1] == parent]
            tree[_name(parent)] = [(_name(node), float(sum(x[3] for x in below if x[:at] == node))) for node in dict.fromkeys(x[:at] for x in below)]
    return tree


def _name(path: tuple[int, ...]) -> str:
    return "/".join(f"{level} {n}" for level, n in zip(LEVELS, path))


def even(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards of equal weight, ``per_rack`` in a rack and ``racks`` in a region."""
    return leaves([(s // (racks * per_rack), s // per_rack % racks, s, 1.0) for s in range(shards)])


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered next, in a new region."""
    numbers = [int(child.rsplit(" ", 1)[1]) for children in tree.values() for child, _ in children if child.count("/") == 2]
    regions = [int(child.rsplit(" ", 1)[1]) for child, _ in tree[""]]
    path = (max(regions) + 1, 0, max(numbers) + 1)
    return {**tree, "": [*tree[""], (_name(path[:1]), weight)], _name(path[:1]): [(_name(path[:2]), weight)], _name(path[:2]): [(_name(path), weight)]}


def _uniform(key: Column, name: Column) -> Column:
    """48 bits of a hash of key and name, strictly between 0 and 1."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key, name)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that a key (text) descends to."""
    node_type = "array<struct<node:string,weight:double>>"
    children = F.create_map(*[x for parent, below in tree.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in below if w > 0]).cast(node_type))])
    node = F.lit("")
    for _ in LEVELS:
        draws = F.transform(F.element_at(children, node), lambda c: F.struct((-F.ln(_uniform(key, c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")))
        node = F.array_min(draws)["node"]
    return F.substring_index(node, " ", -1).cast("int")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def sharded(docs: DataFrame, tree: Tree | None = None, name: str = "shard") -> DataFrame:
    """docs with the shard of every row added: no shuffle."""
    return docs.withColumn(name, shard_of(_key(F.col("doc_id")), tree or even()))


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None) -> None:
    """A folder for every shard, a large one in several files."""
    sharded(docs, tree).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def movement(docs: DataFrame, old: Tree, new: Tree) -> DataFrame:
    """(was, now, rows): what a change of the tree moves."""
    both = sharded(sharded(docs.select("doc_id"), old, "was"), new, "now")
    return both.groupBy("was", "now").agg(F.count(F.lit(1)).alias("rows"))


def slots(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    tree = tree or even()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = _key(F.col("doc_id"))
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    rows = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"), order.alias("order"), F.substring(order, 1, 4).alias("bucket"))
    rows = written(rows, "placed")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(buckets, ["shard", "bucket"])
    first = F.col("base") + F.col("within")
    copies = lambda at, n: F.explode(F.sequence(at, at + n - 1))
    few = rows.where(F.col("n") <= COPIES).select("*", copies(first, F.col("n")).alias("slot"))
    many = rows.where(F.col("n") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("piece")).repartition("shard", "order", "piece")
    many = many.select("*", copies(first + F.col("piece"), F.least(F.lit(COPIES), F.col("n") - F.col("piece"))).alias("slot")).drop("piece")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(table(spark, sf_dir, "documents"))


def _sql_tree(tree: Tree) -> str:
    return ", ".join(f"('{parent}', '{child}', {weight!r})" for parent, below in tree.items() for child, weight in below)


def _sql_descent(name: str, tree: Tree) -> str:
    """CTEs that end in ``name``(row, shard): a join with the children of the node reached, and the least draw, per level."""
    parts, before = [f"{name}_tree(parent, child, weight) AS (VALUES {_sql_tree(tree)})"], "SELECT id, key, '' AS node FROM keyed"
    for k in range(len(LEVELS)):
        parts.append(
            f"{name}_{k} AS (SELECT id, key, arg_min(child, -ln((CAST('0x' || substr(md5(key || '|' || child), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / weight) AS node"
            f" FROM ({before}) b JOIN {name}_tree ON parent = b.node GROUP BY id, key)"
        )
        before = f"SELECT id, key, node FROM {name}_{k}"
    return ", ".join([*parts, f"{name} AS (SELECT id, CAST(split_part(node, ' ', -1) AS INTEGER) AS shard FROM {name}_{len(LEVELS) - 1})"])


SQL = f"""WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
rows AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
sums AS (SELECT id, doc_id, octet_length(encode(text)) + 1 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM rows, bits),
keyed AS (SELECT id, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM rows),
{_sql_descent("placed", even())}, {_sql_descent("regrown", grown(even()))}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, p.shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY md5(concat_ws(':', doc_id, size, crc))) - 1 AS slot, g.shard AS grown_shard
FROM sums JOIN placed p USING (id) JOIN regrown g USING (id)"""
