"""How much storage a workflow holds while it runs: the least and the most, for every task and all that comes after it.

A task runs with its inputs and outputs, with the final results made above it and with what was made above it and is
still needed below it: its *run* files.  Beyond that, what lies below a task counts where it splits into branches.  A
branch is what follows a child up to where all children's ways meet again; what stays of it then is its *residue*,
and the most that it needs at a time its *weight*.  A task's branches can run

* one after another, those that give back most first, each beside what stayed of the ones before it (``deleting``), or
* the heaviest beside what stays of all the others (``together``); ``unbounded`` is all weights at once.

The least of a task is the smaller of ``deleting`` and ``together``, or ``run`` if that is more; its most is the largest of
``unbounded``, ``deleting`` and ``run``.  Files that several sets share count once.

The fold is by levels of *branching* tasks alone: for all others, least and most are their run files.  Every set is rows
of (task, file), with the file's size, so a task with any number of branches or files is held in no one row.  A task's links,
run files and branches' members go through one Spark task, sorted and spilled, its branches' files do not: these are gone
through by task and file, and summed partially.  What lies below a task is only needed for makers of final files, and where
a link passes a level by: a link from a level to the next has no longer path beside it.  So the graph is not closed as a whole.

What grows with the workflow is shuffled a fixed number of times, and as little as can be at every level: links are kept in
memory (or on local disk) by parent, each level's links are written as they are come by, and a branch is walked only as
far as where it meets the others.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources.tables import checkpointed


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """By a shuffle: what is small as a file need not be small in memory."""
    return a.hint("merge").join(b, on, how)


def superfluous(jumps: DataFrame, links: DataFrame, below: DataFrame) -> DataFrame:
    """Of the links jumps(parent, child) those that a longer path makes superfluous: another parent of the child is below the parent."""
    others = _join(jumps.select("parent", "child"), links.select(F.col("parent").alias("node"), "child"), "child")
    return _join(others, below.withColumnRenamed("ancestor", "parent"), ["parent", "node"], "left_semi").select("parent", "child").distinct()


def branches(levels: list[DataFrame], links: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, child, step, member, splits, last, rank), and (node, to, rank): the tasks of every branch, and where a task's branches meet.

    A branch is the ways' common tasks from the child (step 0) to the last one before the other children's ways are met
    (step ``last``); ``to`` is null if they never all meet.  Ways lead from a task with one child to it, and from one that splits
    to where its branches meet.  All children's ways are walked a step at a time, until one place has been passed on
    all of them.  ``rank`` is larger than that of any member that splits.  levels: links(parent, child, children) by the
    parent's level; a task's ways lie in the levels after its own, so these are gone through from the last one.
    """
    only = links.where("children = 1").select(F.col("parent").alias("member"), F.col("child").alias("to"))
    found, met = [], None
    place, way, task = Window.partitionBy("node", "to"), Window.partitionBy("node", "child").orderBy("step"), Window.partitionBy("node").orderBy("child")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    for level in reversed(levels):
        ahead = level.where("children > 1").select(F.col("parent").alias("node"), "child", F.col("children").alias("n"), F.lit(0).alias("step"), F.col("child").alias("member"))
        passed = None
        for at in itertools.count():
            if ahead.isEmpty():
                break
            step = _join(ahead, only, "member", "left")
            if met is None:
                step = step.withColumn("inner", F.lit(None).cast("int"))
            else:
                step = _join(step, met.select(F.col("node").alias("member"), F.col("to").alias("_to"), F.col("rank").alias("inner")), "member", "left")
                step = step.withColumn("to", F.coalesce("to", "_to")).drop("_to")
            now = (step if passed is None else passed.unionByName(step)).repartition("node")
            now = now.withColumn("_all", F.count(F.lit(1)).over(place) == F.col("n"))
            now = now.withColumn("last", F.min(F.when(F.col("_all"), F.col("step"))).over(way.rowsBetween(*whole))).drop("_all")
            now = now.withColumn("rank", F.coalesce(F.max("inner").over(task.rowsBetween(*whole)) + 1, F.lit(0))).withColumn("is_first", F.dense_rank().over(task) == 1)
            now = checkpointed(now)
            done = now.where("step <= last")
            found.append(done.select("node", "child", "step", "member", F.col("inner").isNotNull().alias("splits"), "last", "rank"))
            new = done.where("is_first AND step = last").select("node", "to", "rank")
            met = new if met is None else met.unionByName(new)
            passed = now.where("last IS NULL").select("node", "child", "n", "step", "member", "to", "inner")
            ahead = passed.where((F.col("step") == at) & F.col("to").isNotNull()).select("node", "child", "n", (F.col("step") + 1).alias("step"), F.col("to").alias("member"))
    if not found:
        return None, None
    return functools.reduce(DataFrame.unionByName, found), met


def footprints(sizes: DataFrame, made: DataFrame, needed: DataFrame, final: DataFrame) -> DataFrame:
    """(node, run, deleting, together, unbounded, least, most, kind) for sizes(file, size), made(file, node), needed(file, node), final(file).

    ``kind`` says what the least is: ``run``, ``deleting`` or ``together``.  A file without a size, or that no row of sizes
    names, has none; repeated rows count once (of several sizes the largest); rows without file or node are none.  A task
    without a split has zeros for the three sums of branches.  A cycle is an error.  Equal weights and equal gains go
    by the smaller task.
    """
    made, needed = (x.select("file", "node").dropna() for x in (made, needed))
    size, node = F.col("size").cast("long").alias("size"), made.schema["node"].dataType
    sizes = sizes.where("file IS NOT NULL").select("file", size)
    # a file's makers get its size in the shuffle that makes them distinct, its users get both from the makers
    both = made.select("file", "node", F.lit(None).cast("long").alias("size")).unionByName(sizes.select("file", F.lit(None).cast(node).alias("node"), "size"))
    both = both.repartition("file").groupBy("file", "node").agg(F.max("size").alias("size")).withColumn("size", F.coalesce(F.max("size").over(Window.partitionBy("file")), F.lit(0)))
    final = final.select("file").dropna().distinct().withColumn("is_final", F.lit(True))
    own = checkpointed(_join(both.where("node IS NOT NULL"), final, "file", "left").select("node", "file", "size", F.coalesce("is_final", F.lit(False)).alias("is_final")))
    inputs = checkpointed(_join(needed, own.select("file", F.col("node").alias("parent"), "size"), "file", "left").select("node", "file", "size", "parent"))
    unmade = inputs.where("parent IS NULL").select("node", "file", "parent")
    if not unmade.isEmpty():
        asked = _join(unmade, sizes.groupBy("file").agg(F.max("size").alias("size")), "file", "left")
        inputs = inputs.where("parent IS NOT NULL").unionByName(checkpointed(asked.select("node", "file", F.coalesce("size", F.lit(0)).alias("size"), "parent")))
    pairs = inputs.where("parent IS NOT NULL").select("parent", F.col("node").alias("child"))
    kept = [graph.by_parent(pairs)]
    try:
        return _footprints(own, inputs, pairs, kept)
    finally:
        for links in kept:
            links.unpersist()


def _footprints(own: DataFrame, inputs: DataFrame, pairs: DataFrame, kept: list[DataFrame]) -> DataFrame:
    links = kept[0]
    nodes, levels, jumps = graph.peeled(links, pairs)

    # what a task runs with
    results = own.where("is_final").select("node", "file", "size")
    starts = results.select(F.col("node").alias("ancestor"), F.lit((1 << 31) - 1).alias("deepest")).distinct()
    if jumps is None:
        leveled = links.select("parent", "child", F.lit(0).alias("level"))
    else:
        starts = starts.unionByName(jumps.groupBy(F.col("parent").alias("ancestor")).agg(F.max("level").alias("deepest"))).groupBy("ancestor").agg(F.max("deepest").alias("deepest"))
        leveled = checkpointed(_join(links.select("parent", "child"), nodes.withColumnRenamed("node", "child"), "child"))
    below = graph.descendants(leveled, starts)
    runs = [own.select("node", "file", "size", F.lit(True).alias("own"), F.col("is_final").alias("ends")), inputs.select("node", "file", "size", F.lit(False).alias("own"), F.lit(False).alias("ends"))]
    if not below.isEmpty():
        runs.append(_join(results.withColumnRenamed("node", "ancestor"), below, "ancestor").select("node", "file", "size", F.lit(False).alias("own"), F.lit(True).alias("ends")))
    idle = None if jumps is None else checkpointed(superfluous(jumps, links, below))
    if idle is not None and not idle.isEmpty():
        # a file waits while a task between its maker and its user runs: only a superfluous link has tasks between its ends
        far = idle.select(F.col("parent").alias("ancestor"), F.col("child").alias("end"))
        files = _join(_join(own.select(F.col("node").alias("ancestor"), "file", "size"), inputs.select(F.col("node").alias("end"), "file").distinct(), "file"), far, ["ancestor", "end"], "left_semi")
        runs.append(_join(files, graph.between(links, far, below), ["ancestor", "end"]).select("node", "file", "size", F.lit(False).alias("own"), F.lit(False).alias("ends")))
        links = graph.by_parent(_join(pairs, idle, ["parent", "child"], "left_anti"))
        kept.append(links)
        levels = [checkpointed(_join(links, level.select("parent").distinct(), "parent")) for level in levels]
    files = checkpointed(functools.reduce(DataFrame.unionByName, runs).repartition("node").groupBy("node", "file").agg(F.max("size").alias("size"), F.max("own").alias("own"), F.max("ends").alias("ends")))
    stays = F.coalesce(F.sum(F.when(F.col("own") | F.col("ends"), F.col("size"))), F.lit(0))
    run = checkpointed(files.groupBy("node").agg(F.sum("size").alias("run"), stays.alias("stays")))

    ways, split = branches(levels, links)
    figures = None
    if split is not None:
        of_split = checkpointed(_join(files, split.select("node", "rank"), "node"))
        sets = None
        last = split.agg(F.max("rank")).head()[0]
        for rank in range(last + 1):
            here = of_split.where(F.col("rank") == rank).drop("rank")
            new, more = _folded(ways.where(F.col("rank") == rank), here, run, files, figures, sets, rank == last)
            figures = new if figures is None else figures.unionByName(new)
            sets = more if sets is None else sets if more is None else sets.unionByName(more)
    names = ("deleting", "together", "unbounded")
    if figures is None:
        return run.select("node", "run", *[F.lit(0).cast("long").alias(x) for x in names], F.col("run").alias("least"), F.col("run").alias("most"), F.lit("run").alias("kind"))
    both = _join(run.select("node", "run"), figures.drop("run", "stays"), "node", "left")
    return both.select(
        "node", "run", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in names], F.coalesce("least", "run").alias("least"), F.coalesce("most", "run").alias("most"), F.coalesce("kind", F.lit("run")).alias("kind")
    )


def _folded(ways, here, run, files, figures, sets, is_last):
    """One rank of splitting tasks: their figures, and the files that stay below them, of their least and of their most."""
    # of each branch: its weight, what stays, which members these are of, and its turn
    known = _join(ways.where("NOT splits"), run.select(F.col("node").alias("member"), F.col("run").alias("least"), F.col("run").alias("most"), "stays"), "member")
    if figures is not None:
        known = known.unionByName(_join(ways.where("splits"), figures.select(F.col("node").alias("member"), "least", "most", "stays"), "member"))
    branch, task = Window.partitionBy("node", "child"), Window.partitionBy("node")
    known = known.drop("rank").repartition("node").withColumn("is_end", F.col("step") == F.col("last"))
    known = known.withColumn("is_peak", F.row_number().over(branch.orderBy(F.desc("most"), "step")) == 1)
    by_least = branch.orderBy(F.desc("least"), "step")
    everything = by_least.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("is_heavy", F.row_number().over(by_least) == 1).withColumn("weight", F.max("least").over(everything)).withColumn("residue", F.max(F.when(F.col("is_end"), F.col("stays"))).over(everything))
    known = known.withColumn("is_first", F.dense_rank().over(task.orderBy(F.desc("weight"), "child")) == 1)
    known = known.withColumn("turn", F.dense_rank().over(task.orderBy(F.desc(F.col("weight") - F.col("residue")), "residue", "child")))
    asked = known.where("is_heavy OR is_peak OR is_end").select("member", "node", "turn", "is_first", "is_heavy", "is_peak", "is_end", "splits")

    # (node, turn, file): of the branch's weight, of what it leaves, of its most; a task's own outputs are there from the start
    wide = _join(asked.where("NOT splits"), files.select(F.col("node").alias("member"), "file", "size", (F.col("own") | F.col("ends")).alias("rest"), F.lit(True).alias("of_least"), F.lit(True).alias("of_most")), "member")
    if sets is not None:
        wide = wide.unionByName(_join(asked.where("splits"), sets.withColumnRenamed("node", "member"), "member"))
    wide = wide.select("node", "turn", "file", "size", "is_first", (F.col("is_heavy") & F.col("of_least")).alias("weighs"), (F.col("is_end") & F.col("rest")).alias("leaves"), (F.col("is_peak") & F.col("of_most")).alias("peaks"))
    never = F.lit(False)
    wide = wide.where("weighs OR leaves OR peaks").unionByName(here.where("own").select("node", F.lit(0).alias("turn"), "file", "size", never.alias("is_first"), never.alias("weighs"), F.lit(True).alias("leaves"), never.alias("peaks")))
    wide = wide.withColumn("together", (F.col("weighs") & F.col("is_first")) | (F.col("leaves") & ~F.col("is_first") & (F.col("turn") > 0)))
    order = Window.partitionBy("node", "file").orderBy("turn")
    one = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = wide.withColumn("since", F.min(F.when(F.col("leaves"), F.col("turn"))).over(one))
    for name in ("together", "peaks"):
        wide = wide.withColumn(f"any_{name}", F.max(name).over(one))
    wide = wide.withColumn("is_one", F.row_number().over(order) == 1)
    if not is_last:
        wide = checkpointed(wide)

    # in turn: a file is held from the first branch that leaves it
    of = lambda condition, name: F.coalesce(F.sum(F.when(F.expr(condition), F.col("size"))), F.lit(0)).alias(name)
    turns = wide.groupBy("node", "turn").agg(
        of("leaves AND turn = since", "more"), of("weighs AND (since IS NULL OR since >= turn)", "adds"), of("is_one AND any_together", "together"), of("is_one AND any_peaks", "unbounded")
    )
    in_turn = task.orderBy("turn")
    turns = turns.withColumn("space", F.when(F.col("turn") > 0, F.coalesce(F.sum("more").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("adds")))
    turns = turns.withColumn("deleting", F.max("space").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sums = turns.groupBy("node").agg(F.max("deleting").alias("deleting"), F.min(F.when(F.col("space") == F.col("deleting"), F.col("turn"))).alias("spot"), F.sum("together").alias("together"), F.sum("unbounded").alias("unbounded"))
    less = F.least("deleting", "together")
    kind = F.when(F.col("run") > less, "run").when(F.col("deleting") <= F.col("together"), "deleting").otherwise("together")
    new = _join(sums, here.groupBy("node").agg(F.sum("size").alias("run")), "node").withColumn("least", F.greatest("run", less)).withColumn("most", F.greatest("unbounded", "deleting", "run")).withColumn("kind", kind)
    figure = ("node", "run", "deleting", "together", "unbounded", "least", "most", "kind")
    new = checkpointed(new.select(*figure, "spot"))
    if is_last:  # its tasks are nobody's branch
        return new.select(*figure, F.lit(None).cast("long").alias("stays")), None

    by_all, by_turn = F.col("most") == F.col("unbounded"), F.col("most") == F.col("deleting")
    choice = new.select("node", "spot", "kind", F.when(by_all, "unbounded").when(by_turn, "deleting").otherwise("run").alias("of"))
    rows = _join(wide.select("node", "turn", "file", "size", "weighs", "leaves", "peaks", "together", "since"), choice, "node")
    deleting = F.expr("(leaves AND turn = since AND turn < spot) OR (weighs AND turn = spot)")
    rows = rows.select(
        "node", "file", "size", (F.col("leaves") & (F.col("turn") > 0)).alias("rest"),
        (((F.col("kind") == "deleting") & deleting) | ((F.col("kind") == "together") & F.col("together"))).alias("of_least"),
        (((F.col("of") == "unbounded") & F.col("peaks")) | ((F.col("of") == "deleting") & deleting)).alias("of_most"),
    )
    rows = rows.unionByName(_join(here, choice, "node").select("node", "file", "size", F.col("ends").alias("rest"), (F.col("kind") == "run").alias("of_least"), (F.col("of") == "run").alias("of_most")))
    sets = rows.where("rest OR of_least OR of_most").groupBy("node", "file").agg(F.max("size").alias("size"), *[F.max(x).alias(x) for x in ("rest", "of_least", "of_most")])
    sets = checkpointed(sets)
    stays = sets.where("rest").groupBy("node").agg(F.sum("size").alias("stays"))
    return checkpointed(_join(new.select(*figure), stays, "node", "left").fillna(0, ["stays"])), sets
