"""The nine reductions (COUNT SUM MIN MAX AVERAGE FIRST LAST INC UNIQUE) in their three scopes.

Spatial: over the objects alive at each step.  Temporal: per key, over the events of a step.  Global:
over all events of a step.  All are plain aggregates, so Spark sums partially before it shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("COUNT", "SUM", "MIN", "MAX", "AVERAGE", "FIRST", "LAST", "INC", "UNIQUE")


@dataclass(frozen=True)
class Reduce:
    """A reduction of an expression; order decides FIRST, LAST, INC.

    COUNT counts every row, SUM takes what is no number (null too) as 1; the others pass over null.
    """

    name: str
    value: Column
    alias: str

    def column(self, order: Column) -> Column:
        v = self.value
        kind = self.name.upper()
        zero, number = F.lit(0.0), F.coalesce(v.try_cast("double"), F.lit(1.0))
        first, last = F.min_by(v, F.when(v.isNotNull(), order)), F.max_by(v, F.when(v.isNotNull(), order))
        out = {
            "COUNT": lambda: F.count(F.lit(1)),
            "SUM": lambda: F.coalesce(F.sum(number), zero),
            "MIN": lambda: F.coalesce(F.min(v), zero),
            "MAX": lambda: F.coalesce(F.max(v), zero),
            "AVERAGE": lambda: F.coalesce(F.avg(v), zero),
            "FIRST": lambda: first,
            "LAST": lambda: last,
            "INC": lambda: last - first,
            "UNIQUE": lambda: F.sort_array(F.collect_set(v)),
        }.get(kind)
        if out is None:
            raise ValueError(f"unknown reduction {self.name!r}")
        return out().alias(self.alias)


def spatial(states: DataFrame, step: Column, order: Column, *reductions: Reduce) -> DataFrame:
    return states.groupBy(step.alias("step")).agg(*[r.column(order) for r in reductions])


def temporal(events: DataFrame, step: Column, key: Column, order: Column, *reductions: Reduce) -> DataFrame:
    return events.groupBy(step.alias("step"), key.alias("key")).agg(*[r.column(order) for r in reductions])


def overall(events: DataFrame, step: Column, order: Column, *reductions: Reduce) -> DataFrame:
    return events.groupBy(step.alias("step")).agg(*[r.column(order) for r in reductions])


def feeding(events: DataFrame) -> DataFrame:
    """The events that feed temporal and global reductions: creates, merges and updates, live or not."""
    return events.where("op IN ('C', 'M', 'U')")


def hourly(ts: Column) -> Column:
    """Epoch second of the hour that holds a timestamp."""
    return (F.floor(F.unix_timestamp(ts) / 3600) * 3600).cast("long")
