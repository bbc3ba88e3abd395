"""Resource statistics: histograms, tails, first allocations, buckets, elementwise summary merges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spans
from tidemark.sources.tables import checkpointed


def bucket(value: Column, size: float) -> Column:
    """Upper edge of the interval (edge - size, edge] that holds value."""
    return F.ceil(value / F.lit(float(size))) * F.lit(float(size))


def histogram(df: DataFrame, column: str, size: float) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(bucket(F.col(column), size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def log2_histogram(df: DataFrame, column: str) -> DataFrame:
    """Power-of-two bins: bin b holds [2**b, 2**(b+1))."""
    return df.where(F.col(column) > 0).groupBy(F.floor(F.log2(column) + 1e-12).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, column: str, size: float, order: str) -> DataFrame:
    """The bucket of the highest count, of several the first to reach it; with floored max, capped min, total."""
    h = df.groupBy(bucket(F.col(column), size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("reached"), F.max(column).alias("high"), F.min(column).alias("low"))
    return h.agg(
        F.max_by("bucket", F.struct("n", -F.col("reached"))).alias("mode"),
        F.max("n").alias("mode_count"),
        F.greatest(F.max("high"), F.lit(0.0)).alias("max"),
        F.least(F.min("low"), F.lit(0.0)).alias("min"),
        F.sum("n").alias("total"),
    )


def tails(buckets: DataFrame, value: str = "bucket", count: str = "n", mean: str = "mean_time") -> DataFrame:
    """Per allocation bucket: cumulative count, and mean time of the tail above it over all runs.

    buckets has a row per distinct allocation (a histogram), so the ordered windows see few rows.
    """
    up = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(count).over(Window.partitionBy())
    return buckets.select(
        "*",
        F.sum(count).over(up).alias("cumulative"),
        total.alias("total"),
        (F.coalesce(F.sum(F.col(mean) * F.col(count)).over(above), F.lit(0.0)) / total).alias("tail_time"),
    )


def first_allocations(buckets: DataFrame) -> DataFrame:
    """Candidates with what each costs: buckets(bucket, n, mean_time) -> waste and throughput of a first try.

    A task runs in allocation a if it fits, else again in the largest one a_m.  Waste: a * mean time +
    a_m * tail time.  Throughput: tasks per unit, (share that fits * a_m / a + share that doesn't) over
    mean time + tail time.
    """
    t = tails(buckets)
    everything = Window.partitionBy()
    a, a_m = F.col("bucket"), F.max("bucket").over(everything)
    tau = F.sum(F.col("mean_time") * F.col("n")).over(everything) / F.col("total")
    fits = F.col("cumulative") / F.col("total")
    return t.select("bucket", "cumulative", "tail_time", (a * tau + a_m * F.col("tail_time")).alias("waste"), ((fits * a_m / a + (1 - fits)) / (tau + F.col("tail_time"))).alias("throughput"))


def min_waste(buckets: DataFrame) -> DataFrame:
    return first_allocations(buckets).agg(F.min_by("bucket", F.struct("waste", "bucket")).alias("allocation"), F.min("waste").alias("waste"))


def max_throughput(buckets: DataFrame) -> DataFrame:
    return first_allocations(buckets).agg(F.max_by("bucket", F.struct("throughput", -F.col("bucket"))).alias("allocation"), F.max("throughput").alias("throughput"))


def max_seen(df: DataFrame, column: str, size: float, limit: float | None = None) -> DataFrame:
    """The largest value plus a third of a bucket, rounded up to a bucket, at most ``limit``."""
    edge = F.ceil((F.max(column) + size / 3) / size) * size
    return df.agg((F.least(edge, F.lit(limit)) if limit is not None else edge).alias("allocation"))


def ranked(df: DataFrame, value: str, order: list[str] = (), bins: int = 4096) -> DataFrame:
    """df with rank (1, 2, ... by a numeric value, then order) and total, without one task for all rows.

    Values fall in at most ``bins`` ranges between their extremes; ranges are counted, their counts summed
    up over that small table, and rows numbered inside their range.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = (float(high) - float(low)) / bins if low is not None and high > low else 1.0
    rows = df.withColumn("_bin", F.when(F.col(value).isNull(), -1).otherwise(F.least(F.floor((F.col(value) - F.lit(low)) / width), F.lit(bins))))
    counts = rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(value, *order))
    return rows.withColumn("_inside", inside).join(F.broadcast(counts), "_bin").withColumn("rank", F.col("_before") + F.col("_inside")).drop("_bin", "_inside", "_before")


def quantized_buckets(df: DataFrame, value: str, order: list[str], n: int) -> DataFrame:
    """n buckets of equal count, the first ones a row larger if it doesn't divide: number, upper value, count."""
    r = ranked(df.select(value, *order), value, order)
    each, more, at = F.floor(F.col("total") / n), F.col("total") % n, F.col("rank") - 1
    head = more * (each + 1)
    number = F.when(at < head, F.floor(at / (each + 1)) + 1).otherwise(more + F.floor((at - head) / F.greatest(each, F.lit(1))) + 1)
    return r.withColumn("bucket", number).groupBy("bucket").agg(F.max(value).alias("upper"), F.count(F.lit(1)).alias("n"))


def _greedy(values: np.ndarray, weights: np.ndarray) -> list[int]:
    """Ends (indices into sorted values) of the buckets of a top-down split that lowers the expected waste.

    A run falls in the lower part with probability p, in the upper one with q, by weight; its try is given the
    part's largest value, and one that was given the lower part's and needs more is given the largest after it.
    So the waste of a split at value b of values up to m is  p*p*(b - low) + p*q*(m - low) + q*p*(b + m - high)
    + q*q*(m - high), low and high being the parts' weighted means; no split is worth m - mean.
    """
    n, total = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * values))
    ends, open_ = [], [(0, len(values) - 1)]
    while open_:
        first, last = open_.pop()
        m, at = values[last], np.arange(first, last)
        p = (n[at + 1] - n[first]) / (n[last + 1] - n[first])
        low = (total[at + 1] - total[first]) / (n[at + 1] - n[first])
        high = (total[last + 1] - total[at + 1]) / (n[last + 1] - n[at + 1])
        b, q = values[at], 1 - p
        cost = np.append(p * p * (b - low) + p * q * (m - low) + q * p * (b + m - high) + q * q * (m - high), m - (total[last + 1] - total[first]) / (n[last + 1] - n[first]))
        best = len(at) - int(np.argmin(np.round(cost, 9)[::-1]))  # of equal ones the last, so none is cut for nothing
        if best == len(at):
            ends.append(last)
        else:
            open_ += [(first, first + best), (first + best + 1, last)]
    return sorted(ends)


def greedy_buckets(df: DataFrame, by: str, value: str, resolution: float) -> DataFrame:
    """Per group: buckets over its values that split while the expected waste falls.

    Values are first counted in steps of ``resolution`` in Spark, so a group reaches its task as a
    histogram of distinct steps however many rows it has.
    """
    steps = df.groupBy(by, bucket(F.col(value), resolution).alias("step")).agg(F.count(F.lit(1)).alias("n"))

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        values = g["step"].tolist()
        ends = _greedy(g["step"].to_numpy(float), g["n"].to_numpy(float))
        cumulative, rows, before = g["n"].cumsum().tolist(), [], 0
        for e in ends:
            rows.append((g[by].iloc[0], values[e], cumulative[e] - before))
            before = cumulative[e]
        return pd.DataFrame(rows, columns=[by, "upper", "n"])

    return steps.groupBy(by).applyInPandas(split, f"{by} {df.schema[by].dataType.simpleString()}, upper double, n long")


def merged(how: str, columns: list[str], order: str | None = None, suffix: str = "") -> list[Column]:
    """Elementwise merges of summaries in which -1 means undefined: max, min, add, override (last), default (first)."""
    known = lambda c: F.when(F.col(c) != -1, F.col(c))
    at = lambda c: F.when(F.col(c) != -1, F.col(order))
    merge = {
        "max": lambda c: F.coalesce(F.max(known(c)), F.lit(-1)),
        "min": lambda c: F.coalesce(F.min(known(c)), F.lit(-1)),
        "add": lambda c: F.coalesce(F.sum(known(c)), F.lit(0)),  # undefined everywhere adds up to 0
        "override": lambda c: F.coalesce(F.max_by(known(c), at(c)), F.lit(-1)),
        "default": lambda c: F.coalesce(F.min_by(known(c), at(c)), F.lit(-1)),
    }[how]
    return [merge(c).alias(c + suffix) for c in columns]


def merge_summaries(df: DataFrame, by: list[str], how: str, columns: list[str], order: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*merged(how, columns, order))


def peaks(df: DataFrame, by: list[str], time: str, columns: list[str]) -> DataFrame:
    """Per column its maximum and the earliest time of it."""
    return df.groupBy(*by).agg(*[x for c in columns for x in (F.max(c).alias(c), F.max_by(time, F.struct(F.col(c), -F.col(time))).alias(f"{c}_at"))])


def over_limits(df: DataFrame, limits: dict[str, float]) -> Column:
    """Names of the resources above their limits."""
    return F.array_compact(F.array(*[F.when(F.col(c) > v, F.lit(c)) for c, v in limits.items()]))


def exhaustive_buckets(df: DataFrame, by: str, value: str, resolution: float, most: int) -> DataFrame:
    """Per group: the at most ``most`` buckets of least total waste (upper edge minus value), by dynamic programming.

    A group reaches its task as a histogram in steps of ``resolution``.
    """
    steps = df.groupBy(by, bucket(F.col(value), resolution).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step").reset_index(drop=True)
        edge, n, total = g["step"].tolist(), [0, *g["n"].cumsum()], [0.0, *g["total"].cumsum()]
        m, inf = len(edge), float("inf")
        waste = lambda i, j: edge[j] * (n[j + 1] - n[i]) - (total[j + 1] - total[i])
        best, back = [[inf] * m for _ in range(most + 1)], [[0] * m for _ in range(most + 1)]
        for j in range(m):
            best[1][j] = waste(0, j)
        for k in range(2, most + 1):
            for j in range(m):
                best[k][j], back[k][j] = best[k - 1][j], -1
                for i in range(1, j + 1):
                    cost = best[k - 1][i - 1] + waste(i, j)
                    if cost < best[k][j] - 1e-9:
                        best[k][j], back[k][j] = cost, i
        rows, j, k = [], m - 1, most
        while j >= 0:
            while k > 1 and back[k][j] == -1:
                k -= 1
            i = back[k][j] if k > 1 else 0
            rows.append((g[by].iloc[0], edge[j], n[j + 1] - n[i]))
            j, k = i - 1, k - 1
        return pd.DataFrame(rows[::-1], columns=[by, "upper", "n"])

    return steps.groupBy(by).applyInPandas(split, f"{by} {df.schema[by].dataType.simpleString()}, upper double, n long")


def predicted_allocation(buckets: DataFrame, by: str, needed: Column, share: float = 0.5) -> DataFrame:
    """First try per group: the smallest bucket whose cumulative share of past runs reaches ``share``."""
    w = Window.partitionBy(by).orderBy("upper").rowsBetween(Window.unboundedPreceding, 0)
    b = buckets.withColumn("_share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(by)))
    return b.where((F.col("_share") >= share) & needed).groupBy(by).agg(F.min("upper").alias("allocation"))


def bucket_probabilities(points: DataFrame, by: str, value: str, significance: str, uppers: DataFrame) -> DataFrame:
    """by, buckets: each group's buckets (upper, prob, upto) in order.

    A point lies in the first bucket whose upper edge reaches it, those beyond all edges in the last; a bucket's probability is its
    share of the points' significance, which is what later runs weigh more with.  upto sums the probabilities.
    uppers(by, upper) has a few edges for each group.
    """
    edges = uppers.groupBy(by).agg(F.sort_array(F.collect_set(F.col("upper").cast("double"))).alias("edges"))
    met = points.join(edges, by)
    at = F.least(F.size(F.filter("edges", lambda x: x < F.col(value))), F.size("edges") - 1)
    sums = met.groupBy(by, at.alias("at")).agg(F.sum(significance).cast("double").alias("weight"), F.first("edges").alias("edges"))
    own = Window.partitionBy(by)
    prob = F.col("weight") / F.sum("weight").over(own)
    upto = F.sum("weight").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(own)
    rows = sums.select(by, F.struct(F.get("edges", F.col("at")).alias("upper"), prob.alias("prob"), upto.alias("upto")).alias("bucket"))
    return rows.groupBy(by).agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))


def predicted_tries(tries: DataFrame, by: str, tried: str, buckets: DataFrame, default: float, rate: float = 2.0, draw: str | None = None) -> DataFrame:
    """tries with ``allocation``: what to give a run whose last try was ``tried`` (null or -1 for a first one).

    Only buckets above the last try are left.  With ``draw``, a column of numbers in [0, 1), one of them is drawn by their
    probabilities, rescaled to those left; without it the smallest is taken.  Beyond the last bucket, and in a group that has none
    yet, the default grows by powers of ``rate`` until it exceeds the last try.  Buckets are one row a group.
    """
    last = F.coalesce(F.col(tried).cast("double"), F.lit(-1.0))
    met = tries.join(buckets.select(by, "buckets"), by, "left")
    left = F.filter("buckets", lambda b: b["upper"] > last)
    skipped = F.aggregate(F.filter("buckets", lambda b: b["upper"] <= last), F.lit(0.0), lambda total, b: total + b["prob"])
    if draw is not None:
        reached = F.filter(left, lambda b: (b["upto"] - skipped) / (1 - skipped) > F.col(draw))
        chosen = F.coalesce(F.get(reached, F.lit(0)), F.get(left, F.size(left) - 1))
    else:
        chosen = F.get(left, F.lit(0))
    grown = F.lit(default) * F.pow(F.lit(rate), F.floor(F.log(last / default) / F.log(F.lit(rate)) + 1e-12) + 1)
    return met.withColumn("allocation", F.coalesce(F.when(F.size(left) > 0, chosen["upper"]), F.when(last > 0, grown), F.lit(default))).drop("buckets")


def counters(events: DataFrame, name: str, op: str, value: str, order: str) -> DataFrame:
    """Named integers after ``set`` and ``inc`` events in order: the last value set plus what was added since."""
    is_set = F.col(op) == "set"
    last = events.where(is_set).groupBy(name).agg(F.max(order).alias("_at"), F.max_by(value, order).alias("_set"))
    rest = events.where(~is_set).join(last, name, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at")))
    added = rest.groupBy(name).agg(F.sum(value).alias("_added"))
    names = events.select(name).distinct()
    return names.join(last, name, "left").join(added, name, "left").select(name, (F.coalesce("_set", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("value"))


def first_allocations_by(buckets: DataFrame, by: str) -> DataFrame:
    """``first_allocations`` fitted for every category: buckets(by, bucket, n, mean_time), and which is of least waste."""
    up = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(by).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(by)
    spent = F.col("mean_time") * F.col("n")
    t = buckets.select("*", (F.coalesce(F.sum(spent).over(above), F.lit(0.0)) / F.sum("n").over(own)).alias("tail_time"), (F.sum(spent).over(own) / F.sum("n").over(own)).alias("tau"), F.max("bucket").over(own).alias("most"), F.sum("n").over(up).alias("cumulative"))
    return t.select(by, "bucket", "cumulative", (F.col("bucket") * F.col("tau") + F.col("most") * F.col("tail_time")).alias("waste"))


def refits(df: DataFrame, by: str, order: str, value: str, every: int = 25, span: int = 4096) -> DataFrame:
    """The largest value of each category after every ``every`` completions: what a re-fit at that moment would know.

    A few categories hold the whole table, so numbers and maxima run over spans of ``span`` of the order, a number.
    """
    width = F.floor(F.col(order) / span)
    seen = spans.running(df.select(by, order, value), [by], width, [order], F.lit(1).cast("long"), "completed")
    seen = spans.running(seen, [by], width, [order], F.col(value), "known", "max")
    return seen.where(F.col("completed") % every == 0).select(by, "completed", "known")


def percentiles(df: DataFrame, by: list[str], value: str, fractions: list[float], buckets: int = 1024, few: int = 4096) -> DataFrame:
    """by, fraction, percentile: exact, interpolated between the two values around fraction * (n - 1), nulls apart.

    A distributed selection: every rank that is asked for has an interval of values in which it lies.  A round counts the
    interval's values in ``buckets`` ranges and goes on with the range that holds the rank, between the least and the greatest value
    there, so it always narrows.  Where at most ``few`` values are left, or one value repeated, these are numbered.
    No task holds a group's values: what meets in one are the counts of a rank's buckets, or few values.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    key = [*by, "fraction", "side"]
    every = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    ask = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    ranks = every.select("*", ask).select("*", (F.col("fraction") * (F.col("n") - 1)).alias("at")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    rank = F.when(F.col("side") == 0, F.floor("at")).otherwise(F.ceil("at"))
    asked = checkpointed(ranks.select(*key, "at", rank.cast("long").alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    agree = lambda names: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], F.lit(True))
    named = lambda d: d.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in d.columns if c not in by])
    wide = (F.col("inside") > few) & (F.col("low") < F.col("high"))
    while not asked.where(wide).isEmpty():
        met = rows.join(named(asked.where(wide)), agree(by)).where(F.col("_v").between(F.col("low"), F.col("high")))
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))
        counts = met.groupBy(*key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("here"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("here").over(Window.partitionBy(*key).orderBy("bucket"))
        counts = counts.withColumn("upto", upto).join(asked.select(*[F.col(c).alias(f"_{c}") for c in key], "rank", "below"), agree(key))
        hit = counts.where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("here")))
        hit = hit.select(*[F.col(c).alias(f"_{c}") for c in key], F.struct("least", "most", "here", "upto").alias("hit"))
        narrowed = asked.join(hit, agree(key), "left")
        pick = lambda new, old: F.when(F.col("hit").isNotNull(), new).otherwise(F.col(old)).alias(old)
        asked = checkpointed(narrowed.select(*key, "at", "rank", pick(F.col("hit.least"), "low"), pick(F.col("hit.most"), "high"), pick(F.col("below") + F.col("hit.upto") - F.col("hit.here"), "below"), pick(F.col("hit.here"), "inside")))
    alone = asked.where("low = high").select(*key, "at", F.col("low").alias("_v"))
    met = rows.join(named(asked.where("low < high")), agree(by)).where(F.col("_v").between(F.col("low"), F.col("high")))
    numbered = met.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1).where("nth = rank - below").select(*key, "at", "_v")
    part = F.col("at") - F.floor("at")
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("_v")))
    both = alone.unionByName(numbered).groupBy(*by, "fraction").agg(side(0).alias("_a"), side(1).alias("_b"), F.max(part).alias("_part"))
    return both.select(*by, "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("percentile"))
