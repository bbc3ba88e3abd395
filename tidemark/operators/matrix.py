"""Two-dimensional matrices in long form (i, j, value): reads, overlays, audits, thresholds, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_rows(df: DataFrame, i: str, values: str) -> DataFrame:
    return df.select(F.col(i).alias("i"), F.posexplode(values).alias("j", "value"))


def rectangle(m: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Elements with i0 <= i < i1 and j0 <= j < j1; an element, row or column is a thin one."""
    return m.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1))


def overlay(m: DataFrame, patch: DataFrame) -> DataFrame:
    """m with the elements of patch written over it."""
    return m.join(patch.select("i", "j"), ["i", "j"], "left_anti").unionByName(patch)


def write(m: DataFrame, path: str, rows_per_block: int) -> None:
    m.withColumn("block", F.floor(F.col("i") / rows_per_block)).repartition("block").write.partitionBy("block").parquet(path)


def audit(df: DataFrame, *by: str, **sums: Column) -> DataFrame:
    """Totals at every grouping level of ``by`` in one pass; level is the grouping id."""
    return df.cube(*by).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(k) for k, c in sums.items()])


def roc(scored: DataFrame, score: str, genuine: str, steps: int = 100) -> DataFrame:
    """Per threshold k/steps: share of impostors accepted and of genuine pairs accepted.

    Scores are binned once and summed from the top over the bins: no join with the thresholds.
    """
    from pyspark.sql import Window

    k = F.least(F.greatest(F.floor(F.col(score) * steps + 1e-9), F.lit(-1)), F.lit(steps))
    bins = scored.groupBy(k.cast("int").alias("k")).agg(F.sum(F.col(genuine).cast("int")).alias("g"), F.sum((~F.col(genuine)).cast("int")).alias("b"))
    every = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    all_bins = every.join(bins, "k", "full").select("k", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("b", F.lit(0)).alias("b"))
    down, whole = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    share = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return all_bins.select("k", share("b").alias("false_accept"), share("g").alias("true_accept")).where("k >= 0").select((F.col("k") / steps).alias("threshold"), "false_accept", "true_accept")


def pivot(df: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(value)
