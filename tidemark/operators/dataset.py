"""A lazy data set with chained filters and a limit, over any DataFrame, file listing or SQL view."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.strings import fnmatch
from tidemark.functions.values import passes
from tidemark.sources.tables import checkpointed


class Columns:
    """ds.c.name is the column of that name."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        return self._df[name]


class Dataset:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def c(self) -> Columns:
        return Columns(self.df)

    @classmethod
    def from_glob(cls, spark: SparkSession, folder: str, pattern: str = "*") -> Dataset:
        """Files with path, length and modificationTime; contents are not read."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        return cls(files.select("path", "length", "modificationTime"))

    @classmethod
    def from_list(cls, spark: SparkSession, path: str) -> Dataset:
        """A file of paths, one a line."""
        return cls(spark.read.text(path).select(F.col("value").alias("path")))

    @classmethod
    def from_sql(cls, spark: SparkSession, query: str) -> Dataset:
        return cls(spark.sql(query))

    def query(self, *filters: Column | str, limit: int = 0) -> Dataset:
        """All filters, columns or SQL conditions, hold; limit 0 means all rows."""
        df = self.df
        for f in filters:
            df = df.where(passes(F.expr(f) if isinstance(f, str) else f))
        return Dataset(df.limit(limit) if limit else df)


def any_of(*filters: Column) -> Column:
    out = passes(filters[0])
    for f in filters[1:]:
        out = out | passes(f)
    return out


def all_of(*filters: Column) -> Column:
    out = passes(filters[0])
    for f in filters[1:]:
        out = out & passes(f)
    return out


def matches(column: Column, pattern: str) -> Column:
    return fnmatch(column, pattern)


def search(spark: SparkSession, folder: str, pattern: str, first: bool = False) -> DataFrame:
    """Paths under folder whose name matches the wildcard pattern."""
    df = Dataset.from_glob(spark, folder).df
    df = df.where(fnmatch(F.regexp_extract("path", "([^/]*)$", 1), pattern)).select("path", "length")
    return df.orderBy("path").limit(1) if first else df


def path_regex(atom: str) -> str:
    """A wildcard pattern of paths as a regular expression: no wildcard stands for a slash."""
    out, i = "", 0
    while i < len(atom):
        c, i = atom[i], i + 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := atom.find("]", i + 1)) > 0:
            inside = atom[i:end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and i < len(atom):
            out, i = out + re.escape(atom[i]), i + 1
        else:
            out += re.escape(c)
    return out


def find(spark: SparkSession, root: str, pattern: str, first: bool = False) -> DataFrame:
    """path, is_dir, size, modified of all files and folders below root that a pattern matches; path begins with a slash.

    A pattern is one or more atoms with ``|`` between them.  An atom that begins with a slash is matched from root on, another
    one from any folder on; wildcards match within a name.  Folders are listed by executors, one level of the tree a round, each
    folder once; where all atoms begin with a slash only folders that begin like one of them are.  With ``first`` each folder
    gives its least match alone.  Names that begin with ``.__`` are internal and left out.
    """
    atoms = pattern.split("|")
    hit = "|".join(f"(?:{path_regex(x)})" if x.startswith("/") else f"(?:(?:.*/)?{path_regex(x)})" for x in atoms if x)
    if not hit:
        return spark.createDataFrame([], "path string, is_dir boolean, size long, modified timestamp")
    ways = None
    if all(x.startswith("/") for x in atoms if x):
        begun = {"/".join(names[:n]) for x in atoms if x for names in [x.split("/")] for n in range(2, len(names) + 1)}
        ways = "|".join(f"(?:{path_regex(x)})" for x in sorted(begun))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in fs.get_file_info(pafs.FileSelector(f"{base}{folder}", allow_not_found=True)) if not x.base_name.startswith(".__")]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [[folder] * len(part), [f"{folder}/{x.base_name}" for x in part], [x.type == pafs.FileType.Directory for x in part], [x.size for x in part], [x.mtime for x in part]]
                    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["folder", "path", "is_dir", "size", "modified"])

    folders, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = checkpointed(folders.mapInArrow(listed, "folder string, path string, is_dir boolean, size long, modified timestamp"))
        out = level if out is None else out.unionByName(level)
        folders = level.where("is_dir")
        if ways:
            folders = folders.where(F.col("path").rlike(f"^(?:{ways})$"))
        if folders.isEmpty():
            break
        # as many folders as there are, however few tasks have listed the level above
        folders = folders.select("path").repartition(spark.sparkContext.defaultParallelism)
    out = out.where(F.col("path").rlike(f"^(?:{hit})$"))
    if first:
        out = out.groupBy("folder").agg(F.min_by(F.struct("path", "is_dir", "size", "modified"), "path").alias("m")).select("m.*")
    return out.select("path", "is_dir", "size", "modified")
