"""Running values in two levels: inside spans of an order, and over the table of spans.

A window without a partition, or with one that holds most rows, is one task.  Here an order is cut into spans, each
span is a window partition of its own, and only one row a span meets in the window that carries values from span to span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SO_FAR = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def running(df: DataFrame, by: list[str], span: Column, order: list[str], value: Column, name: str, how: str = "sum", before: bool = False) -> DataFrame:
    """df with the running sum, max, min or last non-null value of its rows by ``order``, up to each row or before it.

    span must rise with the order.  A running sum of nothing is 0, anything else of nothing is null.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    # one key of all parts, in which nulls are equal: window, sums and join are dealt by it alike
    df = df.withColumns({"_key": F.struct(*by, span.alias("_span")), "_value": value})
    whole = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))) if how == "last" else fold("_value")
    spans = df.groupBy("_key").agg(whole.alias("_whole"))
    carry = fold("_whole").over(Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy("_key._span").rowsBetween(*BEFORE))
    spans = spans.select("_key", carry.alias("_carry"))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(*(BEFORE if before else SO_FAR))
    met = df.withColumn("_local", fold("_value").over(inside)).join(spans, "_key")
    zero = F.lit(0).cast(df.schema["_value"].dataType)
    both = {
        "sum": lambda: F.coalesce("_local", zero) + F.coalesce("_carry", zero),
        "max": lambda: F.greatest("_local", "_carry"),
        "min": lambda: F.least("_local", "_carry"),
        "last": lambda: F.coalesce("_local", "_carry"),
    }[how]()
    return met.withColumn(name, both).drop("_key", "_value", "_local", "_carry")


def previous(df: DataFrame, by: list[str], span: Column, order: list[str], columns: list[str]) -> DataFrame:
    """df with ``<column>_before``: the columns' values in the row before, null in the first."""
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    out = running(df, by, span, order, row, "_previous", "last", before=True)
    return out.select("*", *[F.col("_previous")[c].alias(f"{c}_before") for c in columns]).drop("_previous")


def numbered(df: DataFrame, span: Column, order: list[str], name: str = "rank") -> DataFrame:
    """df with row numbers from 1 by ``order``."""
    return running(df, [], span, order, F.lit(1).cast("long"), name)
