"""Time series of logs: deltas, down-sampling, stacked shares, curves, fills, slots."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import spans


def deltas(df: DataFrame, by: list[str], order: list[str], *columns: str, span: int | None = None) -> DataFrame:
    """Each column minus its value in the row before.

    span cuts the first column of the order, a number, into pieces of that width, so that a key of most rows, or a table
    without a key, is many tasks.
    """
    if span is not None:
        out = spans.previous(df, by, F.floor(F.col(order[0]) / span), order, list(columns))
        return out.select(*df.columns, *[(F.col(c) - F.col(f"{c}_before")).alias(f"{c}_delta") for c in columns])
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in columns])


def first_of_step(df: DataFrame, by: list[str], ts: str, order: list[str], width: int) -> DataFrame:
    """The first row of every time step of ``width``: an aggregate, so nothing is sorted."""
    step = F.floor(F.col(ts) / width)
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*by, step.alias("step")).agg(F.min_by(row, F.struct(ts, *order)).alias("_row")).select("step", "_row.*")


def from_first(df: DataFrame, ts: str, started: Column) -> DataFrame:
    """Rows from the first one for which ``started`` holds."""
    return df.crossJoin(F.broadcast(df.where(started).agg(F.min(ts).alias("_first")))).where(F.col(ts) >= F.col("_first")).drop("_first")


def stacked_percent(df: DataFrame, *columns: str) -> DataFrame:
    """Running percentages of the columns, each stacked on those before; all 0 where the total is 0."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    out, run = [], F.lit(0)
    for c in columns:
        run = run + F.col(c)
        out.append(F.when(total != 0, 100.0 * run / total).otherwise(0.0).alias(f"{c}_pct"))
    return df.select("*", *out)


def completion_curve(df: DataFrame, step: str) -> DataFrame:
    """Cumulative counts per step: counts first, then a window over the few steps."""
    n = df.groupBy(step).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def latest_attempt(df: DataFrame, task: str, order: list[str], attempt: str) -> DataFrame:
    """Rows with the last non-null attempt of their task so far."""
    w = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(attempt, F.last(attempt, ignorenulls=True).over(w))


def fill_end(df: DataFrame, by: list[str], ts: str, end: str) -> DataFrame:
    """A missing end is the latest time of its group."""
    last = df.groupBy(*by).agg(F.max(F.greatest(ts, F.coalesce(end, ts))).alias("_end"))
    return df.join(last, by).withColumn(end, F.coalesce(end, "_end")).drop("_end")


def sessions(df: DataFrame, by: list[str], ts: str, gap: int) -> DataFrame:
    """Islands of rows at most ``gap`` apart: session number per key."""
    w = Window.partitionBy(*by).orderBy(ts)
    new = F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def slots(df: DataFrame, worker: str, start: str, end: str, span: int = 4096, stretches: int = 1024) -> DataFrame:
    """The smallest free slot of its worker for every task: greedy, in start order; null without a start or an end.

    Where all earlier tasks of a worker have ended every slot is free again, so its busy stretches are apart from one another:
    rows are dealt out by worker and ``stretches`` of its stretches, and streamed in order through one loop a task that
    holds the tasks running.  Which rows begin a stretch is a running maximum of ends over spans of ``span`` start times,
    so a worker of most tasks is many tasks unless it is never idle; then it is one sorted stream in bounded memory.
    """
    width = F.floor(F.col(start) / span)
    rows = spans.running(df, [worker], width, [start, end], F.col(end), "_busy", "max", before=True)
    rows = rows.withColumn("_idle", F.coalesce(F.col(start) >= F.col("_busy"), F.lit(True)).cast("int"))
    rows = spans.running(rows, [worker], width, [start, end, F.col("_idle").desc()], F.col("_idle"), "_stretch").withColumn("_deal", F.floor(F.col("_stretch") / stretches))
    rows = rows.select(*df.columns, "_deal").repartition(worker, "_deal").sortWithinPartitions(worker, "_deal", start, end)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free, busy, used = None, [], [], 0
        for batch in batches:
            out = []
            for *at, s, e in zip(*(batch.column(c).to_pylist() for c in (worker, "_deal", start, end))):
                if at != now:
                    now, free, busy, used = at, [], [], 0
                if s is None or e is None:
                    out.append(None)
                    continue
                while busy and busy[0][0] <= s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    slot = heapq.heappop(free)
                else:
                    used += 1
                    slot = used
                heapq.heappush(busy, (e, slot))
                out.append(slot)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int32())], names=[*batch.schema.names[:-1], "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", slot int"
    return rows.mapInArrow(assign, schema)


def rebased(df: DataFrame, columns: list[str], origin: str, last: bool = False) -> DataFrame:
    """Times counted from the smallest (or, with ``last``, the largest) value of a column."""
    at = df.agg((F.max if last else F.min)(origin).alias("_origin"))
    return df.crossJoin(F.broadcast(at)).select(*[(F.col(c) - F.col("_origin")).alias(c) if c in columns else F.col(c) for c in df.columns])


def stacked_at(df: DataFrame, time: str, order: list[str], value: str) -> DataFrame:
    """Each row's value on top of those before it at the same time, and the time's total."""
    at = Window.partitionBy(time)
    return df.select("*", F.sum(value).over(at.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("stacked"), F.sum(value).over(at).alias("total"))


def shared_time(df: DataFrame, task: str, accumulated: str, every: int) -> DataFrame:
    """(task, seconds) for every task id: the growth of an accumulated time between two logged ids, shared evenly among
    the ids from the first up to the next.

    ``every`` bounds how many ids one row may stand for before it is cut into pieces of that many.
    """
    # ids fall in ranges, so that only the first of each range looks into the next one
    rows = df.groupBy(task).agg(F.min(accumulated).alias("acc")).withColumn("_range", F.floor(F.col(task) / every))
    first = rows.groupBy("_range").agg(F.min_by(F.struct(task, "acc"), task).alias("_first"))
    ahead = first.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_ahead"))
    inside = F.lead(F.struct(task, "acc")).over(Window.partitionBy("_range").orderBy(task))
    rows = rows.join(ahead, "_range").withColumn("_next", F.coalesce(inside, F.col("_ahead"))).where("_next IS NOT NULL")
    gap = F.col("_next")[task] - F.col(task)
    rows = rows.select(F.explode(F.sequence(F.col(task), F.col("_next")[task] - 1, F.lit(every).cast("long"))).alias("_from"), F.col("_next")[task].alias("_to"), ((F.col("_next")["acc"] - F.col("acc")) / gap).alias("seconds"))
    return rows.select(F.explode(F.sequence("_from", F.least(F.col("_from") + every, F.col("_to")) - 1)).alias("task"), "seconds")


def band_share(df: DataFrame, value: str) -> DataFrame:
    """mean, deviation, share: how many percent of the values lie within one deviation of the mean.

    The variance is the sum of squares over the square root of n - 1, as the tool that this stands for has it.
    """
    m = df.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    d = df.crossJoin(F.broadcast(m)).groupBy("mean", "n").agg(F.sqrt(F.sum((F.col(value) - F.col("mean")) ** 2) / F.sqrt(F.first("n") - 1)).alias("deviation"))
    inside = F.abs(F.col(value) - F.col("mean")) <= F.col("deviation")
    return df.crossJoin(F.broadcast(d)).groupBy("mean", "deviation").agg((100.0 * F.sum(inside.cast("long")) / F.first("n")).alias("share"))
