"""Parallel collection operators: map, pairs, all-pairs, reduce, merge, map-reduce, linkage.

Cross products here are the operation itself, whose result holds a row for every pair: Spark broadcasts
the smaller side where its size is below the session's threshold and joins by partitions where not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import ranked
from tidemark.sources.tables import checkpointed


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn over batches (pandas frames) of rows; order within a partition is kept."""
    return df.mapInPandas(fn, schema)


def all_pairs(left: DataFrame, right: DataFrame, i: str, j: str, value: Column, alias: str = "value") -> DataFrame:
    """(i, j, value) for every pair; value is an expression over the columns of both sides."""
    return left.crossJoin(right).select(F.col(i), F.col(j), value.alias(alias))


def ordered_pairs(left: DataFrame, right: DataFrame, i: str, j: str, value: Column) -> DataFrame:
    """(at, value): the flat list of a function over all pairs, row by row; keys i and j count from 0 without gaps."""
    width = right.agg((F.max(j) + 1).alias("_width"))
    pairs = left.crossJoin(right).crossJoin(F.broadcast(width))
    return pairs.select((F.col(i) * F.col("_width") + F.col(j)).alias("at"), value.alias("value"))


def matrix_rows(pairs: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """One row per i with its values ordered by j."""
    return pairs.groupBy(i).agg(F.transform(F.array_sort(F.collect_list(F.struct(j, value))), lambda x: x[value]).alias("row"))


def self_pairs(df: DataFrame, key: str, within: list[str] = (), columns: list[str] = (), ordered: bool = False) -> DataFrame:
    """Pairs of different rows that agree on ``within``; ordered: each unordered pair once."""
    a = df.select(*within, F.col(key).alias(f"{key}_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(*within, F.col(key).alias(f"{key}_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    pairs = a.join(b, list(within)) if within else a.crossJoin(b)
    return pairs.where(F.col(f"{key}_a") < F.col(f"{key}_b") if ordered else F.col(f"{key}_a") != F.col(f"{key}_b"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def map_reduce(df: DataFrame, key: Column, *aggregates: Column) -> DataFrame:
    """Group by a mapped key and reduce; Spark combines on the map side."""
    return df.groupBy(key.alias("key")).agg(*aggregates)


def tokens(df: DataFrame, text: str, pattern: str = r"[^a-z]+") -> DataFrame:
    return df.select(F.explode(F.split(F.lower(text), pattern)).alias("word")).where("word <> ''")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return map_reduce(tokens(df, text), F.col("word"), F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def value_counts(df: DataFrame, *fields: str) -> DataFrame:
    """(field, value, n) over several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of equal keys over several (key, n) tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.sum("n").alias("n"))


def link_one_to_one(a: DataFrame, b: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Rows of a and b whose key occurs exactly once on each side."""
    both = a.select(*key, F.col(id_).alias("a"), F.lit(None).cast(a.schema[id_].dataType).alias("b")).unionByName(b.select(*key, F.lit(None).cast(a.schema[id_].dataType).alias("a"), F.col(id_).alias("b")))
    g = both.groupBy(*key).agg(F.count("a").alias("_na"), F.count("b").alias("_nb"), F.min("a").alias("a"), F.min("b").alias("b"))
    return g.where("_na = 1 AND _nb = 1").select(*key, "a", "b")


def duplicate_groups(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str]) -> DataFrame:
    """Each left row with the latest right row of the same key not after it: one union, one window, no range join."""
    l = left.withColumn("_side", F.lit(1)).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in columns])
    r = right.select(*by, on, *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.struct(*[F.col(f"_{c}") for c in columns])
    both = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, seen), ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col("_last")[f"_{c}"].alias(c) for c in columns])


def reduce_with(df: DataFrame, value: str, fn: Callable[[list], Any], arity: int = 1000, order: list[str] | None = None, kind: str = "double") -> DataFrame:
    """A tree reduction by an associative Python function of a list: one row ``value`` of type ``kind``, none for no rows.

    Every task reduces its own rows, ``arity`` values at a time, to one; each round then joins up to ``arity`` of these
    by their place, until one is left.  One value is returned as it is.  With ``order`` tasks hold ranges of it and the
    values of a list lie in its order, so fn need not commute; without it fn must.
    Sums, extrema and the like belong in ``agg``, which Spark reduces by itself.
    """
    arity = max(arity, 2)

    def fold(values: list) -> Any:
        while len(values) > 1:
            values = [fn(values[i : i + arity]) if len(values) - i > 1 else values[i] for i in range(0, len(values), arity)]
        return values[0]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        left: list = []
        for frame in frames:
            for x in frame["value"]:
                left.append(x)
                if len(left) >= arity:
                    left = [fn(left)]
        if left:
            yield pd.DataFrame({"place": [TaskContext.get().partitionId()], "value": [fold(left)]})

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": [key[0]], "value": [fold(list(frame.sort_values("place")["value"]))]})

    if order:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the number of ranges is given, so that a range's place is its task's number
        df = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    out = checkpointed(df.select(F.col(value).cast(kind).alias("value")).mapInPandas(partial, f"place long, value {kind}"))
    while out.limit(2).count() > 1:
        out = checkpointed(out.groupBy(F.floor(F.col("place") / arity).alias("group")).applyInPandas(join, f"place long, value {kind}"))
    return out.select("value")


def map_in_order(df: DataFrame, order: list[str], value: str, fn: Callable[[list], list], kind: str, chunk: int = 1000) -> DataFrame:
    """df's order columns with ``result``: what fn, of lists of up to ``chunk`` consecutive values, has at each one's place.

    Tasks hold ranges of the order, so a list's values follow one another.  fn must return as many as it gets.
    """

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), chunk):
                part = frame.iloc[at : at + chunk]
                got = list(fn(list(part["value"])))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} results of {len(part)} values")
                yield part[order].assign(result=got)

    rows = df.select(*order, F.col(value).alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    return rows.mapInPandas(apply, f"{types}, result {kind}")


def windows_of(df: DataFrame, order: str, value: str, domain: int) -> DataFrame:
    """Groups of ``domain`` consecutive rows by a numeric order: what a function over windows of earlier results maps."""
    at = ranked(df, order).withColumn("_at", F.col("rank") - 1)
    return at.groupBy(F.floor(F.col("_at") / domain).alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def wavefront(top: DataFrame, left: DataFrame, n: int, cell: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """R[i,j] = cell(R[i-1,j], R[i,j-1], R[i-1,j-1]) over an n by n grid whose row 0 and column 0 are given.

    top(j, value) and left(i, value) start it; each anti-diagonal is one join of the two before it.
    """
    start = top.select(F.lit(0).alias("i"), "j", "value").unionByName(left.where("i > 0").select("i", F.lit(0).alias("j"), "value"))
    diagonal = lambda d: start.where(F.col("i") + F.col("j") == d)
    done, before, last = start, diagonal(0), diagonal(1)
    for d in range(2, 2 * n - 1):
        # a cell meets its upper and left neighbours on the last diagonal and the corner on the one before
        to = lambda f, di, dj, name: f.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("value").alias(name))
        step = to(last, 1, 0, "_u").join(to(last, 0, 1, "_l"), ["i", "j"]).join(to(before, 1, 1, "_d"), ["i", "j"])
        step = step.select("i", "j", cell(F.col("_u"), F.col("_l"), F.col("_d")).alias("value"))
        step = checkpointed(step)
        done, before, last = done.unionByName(step), last, step.unionByName(diagonal(d))
    return done
