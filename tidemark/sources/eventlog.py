"""Change logs of keyed JSON objects: text lines to an event table, stores of day files, checkpoints, and back to text.

A line is one event: ``C key object`` (create), ``M key object`` (merge attributes), ``D key`` (delete),
``U key name value``, ``R key name`` (remove attribute), ``T seconds`` (absolute time) or ``t seconds``
(time since the marker before).  Event order is (part, line): the part is the day file, and time is a running sum
inside a part.  A part is not a task: running values go from span to span of a part's lines (operators.spans).

A store is a folder with a log and a checkpoint for every day, days counted from 0 in UTC: ``2024/9.log`` and ``2024/9.ckpt``,
or, as Spark writes them, ``year=2024/day=9/part-*``.  A part's name is padded, so that names order as days do.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import spans

#: Columns of an event table; attrs maps attribute names to JSON text.
EVENT = "part string, seq long, ts long, op string, key string, name string, value string, attrs map<string,string>"
#: Line numbers of a span: at least half as many bytes.
SPAN = 1 << 26
DAY = 86400


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """part, line_no, line of every text file under path; line numbers follow the file's order, with gaps.

    Files are split like any other text: lines are numbered inside their split, from twice the byte at which it begins.
    A line takes a byte at least, so the numbers of a split end below those of the next one.  Of a day in several files
    the second one's numbers begin at 2^44, and so on.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    day = r"(?:year=)?(\d{4,})/(?:day=)?(\d{1,3})(?:\.log)?(?:/[^/]*)?$"
    part = F.when(file.rlike(day), F.concat_ws("/", F.regexp_extract(file, day, 1), F.lpad(F.regexp_extract(file, day, 2), 3, "0"))).otherwise(F.regexp_extract(file, r"([^/]+/[^/]+)$", 1))
    number = F.when(file.rlike(day), F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("long"))
    raw = raw.select(part.alias("part"), (F.coalesce(number, F.lit(0)) * (1 << 44) + F.col("_metadata.file_block_start") * 2).alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    nth = F.row_number().over(Window.partitionBy("part", "start").orderBy("id"))
    return raw.select("part", (F.col("start") + nth).alias("line_no"), "line").where("line <> ''")


def _span(at: str) -> Column:
    return F.floor(F.col(at) / SPAN)


def _timed(rows: DataFrame, at: str, absolute: Column, mark: Column) -> DataFrame:
    """rows of (part, at) with ``ts``: the last absolute marker plus the relative ones since, from span to span."""
    rows = rows.withColumns({"_span": _span(at), "_mark": F.coalesce(mark, F.lit(0).cast("long"))})
    inside = Window.partitionBy("part", "_span").orderBy(at)
    rows = rows.withColumn("_era", F.sum(F.when(absolute, 1).otherwise(0)).over(inside))
    rows = rows.withColumn("_run", F.sum("_mark").over(Window.partitionBy("part", "_span", "_era").orderBy(at)))
    # a span with an absolute marker ends at a time, another one only adds to the time before it
    ends = rows.groupBy("part", "_span").agg((F.max("_era") > 0).cast("int").alias("_fixed"), F.max_by("_run", at).alias("_end"))
    order = Window.partitionBy("part").orderBy("_span")
    ends = ends.withColumn("_group", F.sum("_fixed").over(order)).withColumn("_time", F.sum("_end").over(Window.partitionBy("part", "_group").orderBy("_span")))
    ends = ends.select("part", "_span", F.coalesce(F.lag("_time").over(order), F.lit(0)).alias("_carry"))
    rows = rows.join(ends, ["part", "_span"])
    return rows.withColumn("ts", F.col("_run") + F.when(F.col("_era") == 0, F.col("_carry")).otherwise(0)).drop("_span", "_mark", "_era", "_run", "_carry")


def _marked(rows: DataFrame, at: str, line: Column) -> DataFrame:
    """part, at, sub, line: the lines with a ``T`` marker before each whose ts is not that of the line before."""
    timed = spans.previous(rows, ["part"], _span(at), [at], ["ts"])
    out = F.array_compact(F.array(F.when(~F.col("ts").eqNullSafe(F.col("ts_before")), F.concat(F.lit("T "), F.col("ts"))), line))
    return timed.select("part", at, F.posexplode(out).alias("sub", "line"))


def within(lines: DataFrame, start: int, stop: int) -> DataFrame:
    """The lines of a log as they are whose time lies in [start, stop], with a first marker for each part: the way past
    the objects, where a query only copies a span."""
    marker = F.col("line").rlike(r"^[Tt] \d+")
    rows = _timed(lines, "line_no", F.col("line").startswith("T "), F.when(marker, F.regexp_extract("line", r"^. (\d+)", 1).cast("long")))
    return _marked(rows.where(F.col("ts").between(start, stop) & ~marker), "line_no", F.col("line")).select("part", (F.col("line_no") * 2 + F.col("sub")).alias("line_no"), "line")


def upgraded(lines: DataFrame) -> DataFrame:
    """Lines of the older form, in which ``C key`` is followed by ``name value`` lines up to the next event, as lines of today."""
    event = F.col("line").rlike(r"^([CMD] \S+|U \S+ \S+ .*|R \S+ \S+|[Tt] \d+)")
    bare = F.col("line").rlike(r"^C \S+\s*$")
    rows = lines.withColumn("_event", event)
    rows = spans.running(rows, ["part"], _span("line_no"), ["line_no"], F.when(F.col("_event"), F.struct("line_no", bare.alias("bare"))), "_head", "last")
    pairs = rows.where("NOT _event AND _head.bare AND line LIKE '% %'").select("part", F.col("_head.line_no").alias("line_no"), F.col("line_no").alias("at"), F.substring_index("line", " ", 1).alias("name"), F.regexp_replace("line", r"^\S+ ", "").alias("value"))
    # the last of equal names holds
    last = pairs.groupBy("part", "line_no", "name").agg(F.max_by("value", "at").alias("value"))
    objects = last.groupBy("part", "line_no").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))).alias("attrs"))
    heads = rows.where("_event").join(objects, ["part", "line_no"], "left")
    return heads.select("part", "line_no", F.when(bare, F.concat(F.rtrim("line"), F.lit(" "), F.coalesce("attrs", F.lit("{}")))).otherwise(F.col("line")).alias("line"))


def fields(lines: DataFrame, parsed: bool = True) -> DataFrame:
    """lines(part, line_no, line, ...) with what each says: seq, op, key, name, value, attrs, mark; unknown lines are dropped.

    Without ``parsed`` attrs are the JSON text of the line.

    A removal run together with the record after it (``R key name`` without a line end) is split.
    """
    fixed = F.regexp_replace("line", r"^(R \S+ [A-Za-z_][A-Za-z0-9_]*)([CDMURTt] )", "$1\n$2")
    others = [c for c in lines.columns if c not in ("line_no", "line")]
    one = lines.select(*others, "line_no", F.posexplode(F.split(fixed, "\n")).alias("sub", "line"))
    op = F.substring("line", 1, 1)
    body = F.regexp_extract("line", r"^[CM] \S+ (.*)$", 1)
    word = lambda n: F.regexp_extract("line", r"^\S+ (\S+)" + (r" (\S+)" * (n - 1)), n)
    return one.where(F.col("line").rlike(r"^([CM] \S+ \{|D \S+|U \S+ \S+ .|R \S+ \S+|[Tt] \d+)")).select(
        *others,
        (F.col("line_no").cast("long") * 2 + F.col("sub")).alias("seq"),
        op.alias("op"),
        F.when(~op.isin("T", "t"), word(1)).alias("key"),
        F.when(op.isin("U", "R"), word(2)).alias("name"),
        F.when(op == "U", F.regexp_extract("line", r"^U \S+ \S+ (.*)$", 1)).alias("value"),
        F.when(op.isin("C", "M"), F.from_json(body, "map<string,string>") if parsed else body).alias("attrs"),
        F.when(op.isin("T", "t"), word(1).cast("long")).alias("mark"),
    )


def parse(lines: DataFrame) -> DataFrame:
    """lines(part, line_no, line) -> the event table."""
    rows = _timed(fields(lines), "seq", F.col("op") == "T", F.col("mark"))
    return rows.select("part", "seq", "ts", "op", "key", "name", "value", "attrs")


def _files(spark: SparkSession, folder: str) -> set[str]:
    """Names in a folder of any file system that Spark reads; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()


def day_of(ts: int) -> tuple[int, int]:
    """Year and day, from 0, of a time."""
    t = datetime.datetime.fromtimestamp(ts, datetime.UTC)
    return t.year, t.timetuple().tm_yday - 1


def days_between(start: int, stop: int) -> list[tuple[int, int]]:
    return [day_of(t) for t in range(start // DAY * DAY, stop + 1, DAY)]


def read_store(spark: SparkSession, root: str, start: int, stop: int, checkpoint: bool = True, missing: int = 5) -> DataFrame:
    """The events of a store that a question about [start, stop] needs: the objects of the start day's checkpoint, as creates
    at the beginning of that day, and the events of its days up to ``stop``.

    Nothing but the span's days is listed or read.  Days without a file are passed over, but more than ``missing`` of
    them are an error, as is an absent checkpoint unless ``checkpoint`` is False.
    """
    days = days_between(start, stop)
    here: set[str] = set()
    for year in sorted({y for y, _ in days}):
        here |= {f"{year}/{x}" for x in _files(spark, f"{root}/{year}")} | {f"year={year}/{x}" for x in _files(spark, f"{root}/year={year}")}
    paths = [[x for x in (f"{y}/{d}.log", f"year={y}/day={d}") if x in here] for y, d in days]
    if (gone := sum(not x for x in paths)) > missing:
        raise FileNotFoundError(f"{gone} of {len(days)} days of {root} have no log")
    found = [f"{root}/{x}" for day in paths for x in day]
    events = parse(read_lines(spark, found)).where(F.col("ts") <= stop) if found else spark.createDataFrame([], EVENT)
    if not checkpoint:
        return events
    year, day = days[0]
    if f"{year}/{day}.ckpt" not in here:
        raise FileNotFoundError(f"{root}/{year}/{day}.ckpt")
    began = read_checkpoint(spark, f"{root}/{year}/{day}.ckpt").withColumns({"part": F.lit(f"{year:04d}/{day:03d}"), "seq": F.lit(-1).cast("long"), "ts": F.lit(start // DAY * DAY).cast("long")})
    return began.unionByName(events)


def write_store(events: DataFrame, root: str) -> None:
    """Events as day files of a store, ``year=2024/day=9``: ordered by (ts, part, seq), a large day in several files in order."""
    at = F.timestamp_seconds("ts")
    e = events.where("op NOT IN ('T', 't')").withColumns({"year": F.year(at), "day": F.dayofyear(at) - 1}).repartitionByRange("ts", "part", "seq")
    e = e.sortWithinPartitions("ts", "part", "seq")
    # every file begins with its own marker: times are compared inside one task's rows, which lie in order
    e = e.select("year", "day", "ts", _body().alias("body"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("id"))
    before = F.lag("ts").over(Window.partitionBy("task", "year", "day").orderBy("id"))
    lines = F.array_compact(F.array(F.when(~F.col("ts").eqNullSafe(before), F.concat(F.lit("T "), F.col("ts"))), F.col("body")))
    rows = e.withColumn("lines", lines).select("year", "day", "task", "id", F.posexplode("lines").alias("sub", "value"))
    rows = rows.repartitionByRange("task").sortWithinPartitions("year", "day", "id", "sub")
    rows.select("year", "day", "value").write.partitionBy("year", "day").text(root)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint as create events at sequence 0; the form is that of the first line of path.

    JSON lines with key and attrs, as ``write_checkpoint`` leaves them; one JSON document, key -> object, which
    is split between objects where it is printed with a line for every key and one for every object, and else is
    one row; or blank-line separated records of the older form.
    """
    first = spark.read.text(path).where(F.trim("value") != "").head()
    first = first[0].strip() if first else "{}"
    objects = "map<string,map<string,string>>"
    if first == "{":
        # ,\n" stands between objects only: inside one, line ends are escaped
        rows = spark.read.option("lineSep", ',\n"').text(path)
        body = F.regexp_replace(F.regexp_replace("value", r'^\s*\{\s*"', ""), r"\}\s*\n\s*$", "")
        rows = rows.where(F.col("value").rlike(r'":\s*\{')).select(F.explode(F.from_json(F.concat(F.lit('{"'), body, F.lit("}")), objects)).alias("key", "attrs"))
    elif first.startswith('{"key":') and first.endswith("}"):
        rows = spark.read.schema("key string, attrs map<string,string>").json(path)
    elif first.startswith("{"):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", objects)).alias("key", "attrs"))
    else:
        rows = name_value_records(spark, path)
    none = F.lit(None).cast("string")
    return rows.select(F.lit("").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("ts"), F.lit("C").alias("op"), "key", none.alias("name"), none.alias("value"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))


def name_value_records(spark: SparkSession, path: str) -> DataFrame:
    """The older checkpoint form: blank-line separated records of ``name value`` lines, typed by their text."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    pairs = F.transform(F.filter(F.split(F.trim("value"), "\n"), lambda x: x.contains(" ")), lambda x: F.struct(F.substring_index(x, " ", 1).alias("key"), F.regexp_replace(x, r"^\S+ ", "").alias("value")))
    attrs = F.map_from_entries(pairs)
    return rows.select(attrs["key"].alias("key"), attrs.alias("attrs"))


def _body() -> Column:
    return (
        F.when(F.col("op").isin("C", "M"), F.concat_ws(" ", "op", "key", F.to_json("attrs")))
        .when(F.col("op") == "U", F.concat_ws(" ", "op", "key", "name", "value"))
        .when(F.col("op") == "R", F.concat_ws(" ", "op", "key", "name"))
        .when(F.col("op") == "D", F.concat_ws(" ", "op", "key"))
    )


def to_lines(events: DataFrame) -> DataFrame:
    """Events as log lines (part, seq, line), with a T marker wherever the time changes."""
    return _marked(events.where("op NOT IN ('T', 't')"), "seq", _body()).select("part", "seq", "line")


def write_log(events: DataFrame, path: str) -> None:
    """One folder per part; lines sorted, so each part reads back in order."""
    lines = to_lines(events).repartition("part").sortWithinPartitions("part", "seq", F.col("line").startswith("T ").desc())
    lines.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)


def write_checkpoint(objects: DataFrame, path: str) -> None:
    """objects(key, attrs) as JSON lines, one object a line: the table form of a checkpoint."""
    objects.select(F.to_json(F.struct("key", "attrs")).alias("value")).write.text(path)
