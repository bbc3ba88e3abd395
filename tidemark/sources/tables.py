"""Parquet tables of a data directory, and the shared folder for what queries write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Times without zone are UTC: histories count seconds since the epoch."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared storage that the session names; on one machine a temporary one stands in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, its lineage cut, its size known to joins above."""
    path = shared_folder(df.sparkSession, "steps")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
