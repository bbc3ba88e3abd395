"""Sorted files with a manifest: a distributed sort whose output can be looked up and merged by its files' borders.

Rows are range partitioned by sampled splitters, sorted inside every range and written, one file a range; the manifest says for
each file what its least and greatest key are.  A lookup reads the files whose borders hold its keys and no others;
a merge rewrites the files that the new rows fall between and leaves all others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def _described(files: DataFrame, key: str) -> DataFrame:
    """file, least, greatest, rows of every file."""
    name = F.col("_metadata.file_path").alias("file")
    return files.select(name, F.col(key).alias("_key")).groupBy("file").agg(F.min("_key").alias("least"), F.max("_key").alias("greatest"), F.count(F.lit(1)).alias("rows"))


def write_sorted(df: DataFrame, path: str, key: str, files: int, then: list[str] = ()) -> DataFrame:
    """df, by key and then the other columns, as at most ``files`` sorted files under path/data; their manifest.

    Equal keys lie in one file, rows without a key in the first one.
    """
    df.repartitionByRange(files, key).sortWithinPartitions(key, *then).write.parquet(f"{path}/data")
    return _with_manifest(df, path, key)


def _with_manifest(df: DataFrame, path: str, key: str) -> DataFrame:
    spark = df.sparkSession
    _described(spark.read.schema(df.schema).parquet(f"{path}/data"), key).coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def _open(spark: SparkSession, files: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def between(borders: DataFrame, key: str, low, high, schema) -> DataFrame:
    """The rows with a key in [low, high]: only files that may have some are read."""
    inside = borders.where((F.col("greatest") >= low) & (F.col("least") <= high))
    rows = _open(borders.sparkSession, [r.file for r in inside.select("file").collect()], schema)
    return rows.where(F.col(key).between(low, high))


def merge(borders: DataFrame, new: DataFrame, path: str, key: str, files: int, then: list[str] = ()) -> DataFrame:
    """The manifest of all rows after ``new`` ones came: files whose range new keys fall in are written anew under path.

    Keys below the least and above the greatest of all go to the first and the last file.
    """
    spark = new.sparkSession
    held = borders.where("least IS NOT NULL")
    edges = [(r.file, r.least) for r in held.orderBy("least").collect()]
    if not edges:
        return write_sorted(new, path, key, files, then)
    # the file of a key: the last one that begins at or below it, or else the first
    at = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(x) for _, x in edges]), lambda x: x <= F.col(key)))).alias("_at")
    hit = {r[0] for r in new.select(at).distinct().collect()}
    names = [name for i, (name, _) in enumerate(edges, 1) if i in hit]
    rows = _open(spark, names, new.schema).unionByName(new).select("*", at)
    # no new file goes past the borders of an old one: between two that are written anew others may lie
    rows.repartitionByRange(files, "_at", key).sortWithinPartitions("_at", key, *then).write.partitionBy("_at").parquet(f"{path}/data")
    _with_manifest(new, path, key)
    return borders.where(~F.col("file").isin(names)).unionByName(manifest(spark, path))


def disorder(files: DataFrame, key: Column | str) -> DataFrame:
    """rows and inversions: neighbours in the wrong order, in a file or between a file's end and the next one's beginning."""
    from pyspark.sql import Window

    k = F.col(key) if isinstance(key, str) else key
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), k.alias("k"))
    inside = rows.withColumn("before", F.lag("k").over(Window.partitionBy("file").orderBy("start", "id")))
    ends = inside.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("greatest"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("k") < F.col("before")).cast("long")).alias("wrong"))
    over = ends.withColumn("earlier", F.lag("greatest").over(Window.orderBy("least", "greatest")))
    return over.agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("inside"), F.coalesce(F.sum((F.col("earlier") > F.col("least")).cast("long")), F.lit(0)).alias("between"))
