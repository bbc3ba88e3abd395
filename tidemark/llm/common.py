"""Helpers shared by the training-data operators: tables, words, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``: what separates words and is stripped from lines.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts may be long, and a task holds a batch or two of them.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made inside each open scratch block, innermost last.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder takes its place on one machine; on a cluster that is an error,
    as each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder inside it.

    An operator's result reads such tables, so it must be written elsewhere before the block ends.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            _delete(spark, folder)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written and read back, with all that making it left deleted."""
    path = f"{shared_dir(spark)}/{name}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+``, in order; null and blank texts have none."""
    t = trimmed(text)
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def byte_words(text: bytes | None) -> list[bytes]:
    """The same words of UTF-8 bytes: bytes.split() splits at exactly these six characters."""
    return text.split() if text else []


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def salted_join(rows: DataFrame, groups: DataFrame, key: str | list[str], spread_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """rows JOIN groups on key, where one key may hold a large share of rows and groups has one row a key.

    groups is repeated ``salts`` times and rows are dealt over the copies by a hash of spread_by, so a
    hot key is ``salts`` partitions rather than one.
    """
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).join(copies, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")
