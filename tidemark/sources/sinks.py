"""Outputs: reduced rows, object streams, name-value text, CSV tables, split streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(attrs: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(attrs))))


def object_rows(states: DataFrame, step: str, attrs: str) -> DataFrame:
    """One JSON object a row, by step: large steps stay many rows, never one."""
    return states.select(step, canonical_json(F.col(attrs)).alias("object"))


def name_value(attrs: Column) -> Column:
    """``name value`` lines with sorted names."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(attrs)), lambda e: F.concat_ws(" ", e["key"], e["value"])), "\n")


def environment(attrs: Column) -> Column:
    """``export NAME=value`` lines, values quoted for a shell."""
    from tidemark.functions.strings import shell_escape

    return F.array_join(F.transform(F.sort_array(F.map_entries(attrs)), lambda e: F.concat(F.lit("export "), e["key"], F.lit("="), shell_escape(e["value"]))), "\n")


def write_tables(path: str, **tables: DataFrame) -> None:
    """Each table as CSV with a header under path/name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def split_stream(lines: DataFrame, path: str, n: int, copy: bool = False) -> None:
    """Lines dealt to n folders in turn, or all to each.

    A line's turn is its place in its task after all lines of the tasks before, which are counted first.
    """
    if copy:
        host = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    else:
        # an id has the task's number above the line's place in it
        lines = lines.withColumn("_id", F.monotonically_increasing_id())
        task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        counts = lines.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        lines = lines.withColumn("_task", task).join(counts, "_task")
        host = (F.col("_before") + place) % n
    value = F.col("value")
    lines.select(value, host.alias("host")).write.partitionBy("host").text(path)


def percent_f(*columns: str) -> list[Column]:
    """Reduction values as C's %lf prints them."""
    return [F.format_string("%f", F.col(c).cast("double")).alias(c) for c in columns]
