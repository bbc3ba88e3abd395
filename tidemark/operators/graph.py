"""Workflow graphs as tables: nodes and edges, levels, widths, ancestors, k hops, readiness, export.

Tables of a graph are narrow and compress well: what is small as a file need not be small in memory, so the steps that
grow with the graph join by shuffles (``hint("merge")``) and send no table to the driver.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed


def edges(created: DataFrame, needed: DataFrame) -> DataFrame:
    """created(file, node) and needed(file, node) -> (parent, child) of tasks."""
    return created.select("file", F.col("node").alias("parent")).hint("merge").join(needed.select("file", F.col("node").alias("child")), "file").select("parent", "child").distinct()


def source_files(needed: DataFrame, created: DataFrame) -> DataFrame:
    return needed.select("file").distinct().join(created.select("file"), "file", "left_anti")


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(node) -> (node, level): longest path from a node without parents; a frontier join per level.

    A cycle is an error: no path can have more links than there are nodes.
    """
    n_nodes = nodes.select("node").distinct().count()
    links = checkpointed(links.select("parent", "child").distinct()).hint("merge")
    frontier = nodes.select("node").distinct().hint("merge").join(links.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(0))
    out = frontier
    for _ in range(n_nodes + 1):
        frontier = checkpointed(frontier.join(links, frontier["node"] == links["parent"]).select(F.col("child").alias("node"), (F.col("level") + 1).alias("level")).distinct())
        if not frontier.limit(1).count():
            return out.groupBy("node").agg(F.max("level").alias("level"))
        out = out.unionByName(frontier)
    raise ValueError("the graph has a cycle")


def by_parent(links: DataFrame) -> DataFrame:
    """(parent, child, parents, children): links once each, with how many parents the child and how many children the parent has.

    Kept in memory, or on local disk, in all shuffle partitions by parent, so that a step from parents to children shuffles
    these parents alone; the caller unpersists it.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.select("parent", "child").repartition("child").distinct().withColumn("parents", F.count(F.lit(1)).over(Window.partitionBy("child")))
    links = links.repartition(parts, "parent").withColumn("children", F.count(F.lit(1)).over(Window.partitionBy("parent")))
    return links.persist()


def peeled(links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(node, level) by the longest path from a node without parents, the links of every level's nodes, and those that pass a level by.

    links: as by_parent keeps them of pairs(parent, child).  A node is taken once, when its last parent is.  The links (parent, child, level of the
    child) that pass a level by are None if there are none: only a child that waited for a parent has any.  A cycle is an
    error, as its links are never come by.
    """
    nodes = now = checkpointed(links.select(F.col("parent").alias("node")).distinct().hint("merge").join(pairs.select(F.col("child").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("level")))
    levels, late, waiting, seen = [], None, None, 0
    for level in itertools.count(1):
        out = checkpointed(links.hint("merge").join(now.select(F.col("node").alias("parent")), "parent"))
        n = out.count()
        if not n:
            break
        seen += n
        levels.append(out)
        came = out.groupBy("child").agg(F.count(F.lit(1)).alias("_came"), F.max("parents").alias("_asked"), F.lit(False).alias("_late"))
        if waiting is not None:
            came = came.unionByName(waiting).groupBy("child").agg(F.sum("_came").alias("_came"), F.max("_asked").alias("_asked"), F.max("_late").alias("_late"))
        came = checkpointed(came)
        whole = came.where("_came = _asked")
        now = whole.select(F.col("child").alias("node"), F.lit(level).alias("level"))
        nodes = nodes.unionByName(now)
        if waiting is not None:
            new = whole.where("_late").select("child", F.lit(level).alias("level"))
            late = new if late is None else late.unionByName(new)
        waiting = came.where("_came < _asked").withColumn("_late", F.lit(True))
        if waiting.isEmpty():
            waiting = None
    if seen < links.count():
        raise ValueError("the graph has a cycle")
    if late is None:
        return nodes, levels, None
    above = functools.reduce(DataFrame.unionByName, [out.select("parent", "child", F.lit(i).alias("_above")) for i, out in enumerate(levels)])
    return nodes, levels, checkpointed(above.hint("merge").join(late, "child").where("level > _above + 1").select("parent", "child", "level"))


def descendants(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(ancestor, node): what lies below starts(ancestor, deepest) along links(parent, child, level), down to that level of a child."""
    found = now = checkpointed(starts.hint("merge").join(links.withColumnRenamed("parent", "ancestor"), "ancestor").where("level <= deepest").select("ancestor", F.col("child").alias("node"), "deepest").distinct())
    while not now.isEmpty():
        step = now.hint("merge").join(links.withColumnRenamed("parent", "node"), "node").where("level <= deepest").select("ancestor", F.col("child").alias("node"), "deepest").distinct()
        now = checkpointed(step.hint("merge").join(found.select("ancestor", "node"), ["ancestor", "node"], "left_anti"))
        found = found.unionByName(now)
    return found.select("ancestor", "node")


def between(links: DataFrame, pairs: DataFrame, below: DataFrame) -> DataFrame:
    """(ancestor, end, node): the nodes on the ways from ancestor to end of every pair, for below(ancestor, node) of their ancestors."""
    up = links.select("parent", F.col("child").alias("node"))
    now = pairs.select("ancestor", "end", F.col("end").alias("node"))
    found = None
    while True:
        step = now.join(up, "node").select("ancestor", "end", F.col("parent").alias("node")).distinct().join(below, ["ancestor", "node"], "left_semi")
        now = checkpointed(step if found is None else step.join(found, ["ancestor", "end", "node"], "left_anti"))
        found = now if found is None else found.unionByName(now)
        if now.isEmpty():
            return found


def depth_and_width(leveled: DataFrame) -> DataFrame:
    return leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg((F.max("level") + 1).alias("depth"), F.max("n").alias("width"))


def guaranteed_width(links: DataFrame) -> DataFrame:
    """The most children with a single parent that any parent has."""
    only = links.groupBy("child").agg(F.countDistinct("parent").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    return only.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("width"))


def closure(links: DataFrame, hops: int | None = None) -> DataFrame:
    """(ancestor, node, distance): shortest distances up to ``hops`` (all if None).

    Distances double each round: what lies beyond ``half`` links, up to twice as far, is reached from a node at exactly
    ``half``, as a shortest path's parts are shortest paths.  So the rounds are as many as the longest distance has
    binary digits, and each joins one layer of pairs, not all of them, with the pairs known so far.  The layer is the
    side that a join holds a node's rows of; pairs compress well, so they stay in all shuffle partitions.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda pairs: pairs.repartition(parts, "ancestor", "node")
    links = links.select("parent", "child").distinct()
    reached = checkpointed(links.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")))
    if hops is not None and hops < 1:
        return reached.limit(0)
    half = 1
    while hops is None or half < hops:
        layer = reached.where(F.col("distance") == half).select("ancestor", F.col("node").alias("_middle"))
        beyond = reached.select(F.col("ancestor").alias("_middle"), "node", (F.col("distance") + half).alias("distance"))
        if hops is not None:
            beyond = beyond.where(F.col("distance") <= hops)
        step = spread(beyond.hint("merge").join(layer, "_middle").select("ancestor", "node", "distance")).groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))
        found = checkpointed(step.join(spread(reached.select("ancestor", "node")).hint("merge"), ["ancestor", "node"], "left_anti"))
        if found.isEmpty():
            break
        reached, half = reached.unionByName(found), 2 * half
    return reached


def ready(needs: DataFrame, done: DataFrame) -> DataFrame:
    """needs(task, file), done(file) -> tasks of which every file is there."""
    have = needs.join(done.select("file").distinct().withColumn("_there", F.lit(1)), "file", "left")
    return have.groupBy("task").agg(F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0)).alias("missing")).where("missing = 0").select("task")


def footprint(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes that live at each level: files(file, size, made_level, last_level) from their making to their last use."""
    span = files.select("size", F.explode(F.sequence("made_level", "last_level")).alias("level"))
    return span.groupBy("level").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def to_dot(links: DataFrame) -> DataFrame:
    """Lines of a dot graph, one edge each, in order; header and footer are rows as well."""
    body = links.select(F.lit(1).alias("at"), F.format_string('"%s" -> "%s";', F.col("parent").cast("string"), F.col("child").cast("string")).alias("line"))
    spark = links.sparkSession
    return spark.createDataFrame([(0, "digraph {"), (2, "}")], "at int, line string").unionByName(body).orderBy("at", "line").select("line")


def tree(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of parent-child rows: a row whose parent is no row's node is a root of depth 0; rows in a cycle have none."""
    r = rows.select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct()
    roots = r.join(r.select(F.col("node").alias("parent")).distinct(), "parent", "left_anti")
    frontier = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    out = frontier
    for d in itertools.count(1):
        frontier = checkpointed(r.join(frontier.select(F.col("node").alias("parent"), "root"), "parent").select("node", "root", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def degraded(files: DataFrame, replicas: DataFrame, file: str, minimum: str) -> DataFrame:
    """Files with fewer replicas than they ask for, none at all included, and how many are missing."""
    n = replicas.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    have = files.join(n, file, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return have.where(F.col("n") < F.col(minimum)).select(file, "n", (F.col(minimum) - F.col("n")).alias("missing"))


def common_prefix(lists: DataFrame, by: str, items: str) -> DataFrame:
    """The longest list that every row's list of a group begins with."""
    place = lists.select(by, F.posexplode(items).alias("at", "item"))
    n = lists.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    same = place.groupBy(by, "at").agg(F.count(F.lit(1)).alias("have"), F.min("item").alias("item"), F.max("item").alias("_max")).join(n, by)
    ends = same.where((F.col("have") < F.col("n")) | (F.col("item") != F.col("_max"))).groupBy(by).agg(F.min("at").alias("_end"))
    kept = same.join(ends, by, "left").where(F.col("_end").isNull() | (F.col("at") < F.col("_end"))).where("have = n AND item = _max")
    found = kept.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("prefix"))
    return n.select(by).join(found, by, "left").withColumn("prefix", F.coalesce("prefix", F.array().cast("array<string>")))


def residuals(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node, level, inputs, outputs, least, most): bytes of a node's files, and the least and most that its level may hold.

    files(file, size, node, direction) of nodes(node, level).  The least is what one node of the level needs while it
    runs, the largest of them; the most is all nodes of the level at once.
    """
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("size"))), F.lit(0))
    own = nodes.join(files, "node", "left").groupBy("node", "level").agg(side("IN").alias("inputs"), side("OUT").alias("outputs"))
    held = F.col("inputs") + F.col("outputs")
    level = own.groupBy("level").agg(F.max(held).alias("least"), F.sum(held).alias("most"))
    return own.join(level, "level").select("node", "level", "inputs", "outputs", "least", "most")
