"""Catalogue of heartbeats: normalise, upsert by newest, expire, filter, sort, total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key() -> Column:
    """address:port:name[:uuid], of the columns that are there."""
    return F.concat_ws(":", F.col("address"), F.col("port").cast("string"), F.col("name"), F.col("uuid"))


def normalise(updates: DataFrame, sender: str, received: str, max_size: int = 1 << 20) -> DataFrame:
    """The sender's address and the receive time are stated by the receiver; oversized bodies are cut."""
    out = updates.withColumn("address", F.col(sender)).withColumn("lastheardfrom", F.col(received))
    return out.withColumn("name", F.coalesce("name", sender)) if "body" not in out.columns else out.withColumn("name", F.coalesce("name", sender)).withColumn("body", F.substring("body", 1, max_size))


def newest(updates: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key: a max over structs, combined on the map side."""
    row = F.struct(*[F.col(c) for c in updates.columns])
    return updates.groupBy(*by).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def upsert(current: DataFrame, updates: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return newest(current.unionByName(updates, allowMissingColumns=True), by, order)


def alive(current: DataFrame, now: int, lifetime: int = 1800) -> DataFrame:
    """Rows heard within the smaller of their own lifetime and the catalogue's."""
    limit = F.least(F.coalesce("lifetime", F.lit(lifetime)), F.lit(lifetime)) if "lifetime" in current.columns else F.lit(lifetime)
    return current.where(F.lit(now) - F.col("lastheardfrom") <= limit)


def sorted_view(df: DataFrame, name: str, *then: str) -> DataFrame:
    """By name without regard to case; the nameless count as 'unknown'."""
    return df.orderBy(F.lower(F.coalesce(name, F.lit("unknown"))), *then)


def totals(df: DataFrame, by: list[str], total: str, avail: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(total).alias("total"), F.sum(avail).alias("avail"), F.count(F.lit(1)).alias("n"))


def table_view(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as text, '???' where missing."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("???")).alias(c) for c in columns])
