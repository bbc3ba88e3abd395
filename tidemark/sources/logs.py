"""Readers of task, worker, performance, workflow and trace logs: text lines to typed tables.

Each takes a DataFrame with a ``value`` column (``spark.read.text``), so files split freely; line order
comes from the times that the lines carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed

#: Managers that are sent to every task as they are, and lines of a manager beyond which it is one of many lines.
FEW, MANY = 10_000, 1 << 16
#: The fields of a resource summary.
RESOURCES = (
    "start end wall_time cpu_time memory virtual_memory swap_memory disk bytes_read bytes_written bytes_received bytes_sent bandwidth gpus cores cores_avg machine_cpus machine_load "
    "context_switches max_concurrent_processes total_processes total_files fs_nodes workers"
).split()


def transactions(lines: DataFrame) -> DataFrame:
    """``time_us manager subject target event [argument]`` -> ts (seconds since the manager's start) and the rest."""
    f = F.split(F.trim("value"), r"\s+", 6)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 5)).select(f[0].cast("long").alias("us"), f[1].alias("manager"), f[2].alias("subject"), f[3].alias("target"), f[4].alias("event"), F.when(F.size(f) > 5, f[5]).alias("arg"))
    start = F.min(F.when((F.col("subject") == "MANAGER") & (F.col("event") == "START"), F.col("us")))
    origin = rows.groupBy("manager").agg(F.coalesce(start, F.min("us")).alias("origin"), F.count(F.lit(1)).alias("_n"))
    return with_managers(rows, origin).select("manager", ((F.col("us") - F.col("origin")) / 1e6).alias("ts"), "us", "subject", "target", "event", "arg")


def with_managers(rows: DataFrame, managers: DataFrame, few: int = FEW, many: int = MANY) -> DataFrame:
    """rows JOIN managers on manager, for managers(manager, _n: its lines, ...), without bringing a manager's rows into one task.

    A few managers go to every task.  Of more, those of many lines do, of which there is one in ``many`` lines at most; the
    others' rows are dealt by manager.
    """
    managers = checkpointed(managers)
    if managers.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(managers.drop("_n")), "manager")
    met = rows.join(F.broadcast(managers.where(F.col("_n") > many)), "manager", "left")
    near = met.where("_n IS NOT NULL").drop("_n")
    far = met.where("_n IS NULL").select(*rows.columns).join(managers.where(F.col("_n") <= many).drop("_n"), "manager")
    return near.unionByName(far)


def tasks(log: DataFrame) -> DataFrame:
    """One row per task attempt: when ready, running, done, on which worker, with which outcome.

    An attempt begins with each READY (or WAITING) state.
    """
    t = log.where("subject = 'TASK'")
    w = Window.partitionBy("manager", "target").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("attempt", F.sum(F.when(F.col("event").isin("READY", "WAITING"), 1).otherwise(0)).over(w))
    at = lambda *events: F.min(F.when(F.col("event").isin(*events), F.col("ts")))
    arg = lambda n, *events: F.min(F.when(F.col("event").isin(*events), F.get(F.split("arg", r"\s+"), F.lit(n))))
    return t.groupBy("manager", F.col("target").alias("task"), "attempt").agg(
        at("READY", "WAITING").alias("ready"), at("RUNNING").alias("running"), at("WAITING_RETRIEVAL").alias("finished"), at("RETRIEVED").alias("retrieved"), at("DONE").alias("done"),
        arg(0, "READY", "WAITING").alias("category"), arg(0, "RUNNING").alias("worker"), arg(0, "DONE").alias("result"),
    )


def workers(log: DataFrame) -> DataFrame:
    """One row per connection of a worker; one still connected ends with its manager's last line."""
    w = log.where("subject = 'WORKER'")
    order = Window.partitionBy("manager", "target").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("connection", F.sum(F.when(F.col("event") == "CONNECTION", 1).otherwise(0)).over(order))
    last = log.groupBy("manager").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("_n"))
    w = w.groupBy("manager", F.col("target").alias("worker"), "connection").agg(F.min(F.when(F.col("event") == "CONNECTION", F.col("ts"))).alias("connected"), F.max(F.when(F.col("event") == "DISCONNECTION", F.col("ts"))).alias("disconnected"), F.max(F.when(F.col("event") == "DISCONNECTION", F.col("arg"))).alias("reason"))
    return with_managers(w, last).withColumn("disconnected", F.coalesce("disconnected", "last")).drop("last")


def transfers(log: DataFrame) -> DataFrame:
    """INPUT and OUTPUT transfers: ``event kind file size seconds ...`` per worker."""
    a = F.split("arg", r"\s+")
    return log.where("subject = 'WORKER' AND event = 'TRANSFER'").select("manager", "ts", F.col("target").alias("worker"), F.get(a, F.lit(0)).alias("direction"), F.get(a, F.lit(1)).alias("kind"), F.get(a, F.lit(2)).alias("file"), F.get(a, F.lit(3)).cast("double").alias("mb"), F.get(a, F.lit(4)).cast("double").alias("seconds"))


def transfer_totals(t: DataFrame) -> DataFrame:
    return t.groupBy("direction", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("mb").alias("mb"), F.avg("seconds").alias("mean_seconds"))


def task_range(column: Column, ranges: str) -> Column:
    """'1-5,9': ids in any of the ranges."""
    out = F.lit(False)
    for part in ranges.split(","):
        low, _, high = part.partition("-")
        out = out | column.between(int(low), int(high or low))
    return out


def summary_log(lines: DataFrame) -> DataFrame:
    """Successful tasks of a log of resource summaries: their id, and cores, memory, disk and wall time by name."""
    v = F.col("value")
    number = lambda name: F.regexp_extract(v, rf'"{name}":\s*\[\s*(-?[\d.eE+]+)', 1).try_cast("double")
    done = lines.where(v.rlike(r"TASK \S+ DONE SUCCESS\s+0"))
    return done.select(F.regexp_extract(v, r"TASK (\d+) DONE", 1).cast("long").alias("task"), number("cores_avg").alias("cores"), number("memory").alias("memory"), number("disk").alias("disk"), number("wall_time").alias("time"))


def performance(spark: SparkSession, path: str) -> DataFrame:
    """A log whose ``#`` header names the columns; every other line is numbers (the first a time in us)."""
    return performance_rows(spark.read.text(path))


def performance_rows(raw: DataFrame) -> DataFrame:
    """The rows of a log given as lines(value); of several headers the longest holds, as later ones add columns."""
    header = raw.where(F.col("value").startswith("#")).agg(F.max(F.struct(F.size(F.split(F.trim("value"), r"\s+")), "value"))["value"]).first()[0]
    if header is None:
        raise ValueError("a performance log opens with a # header")
    names = header.lstrip("# ").split()
    f = F.split(F.trim("value"), r"\s+")
    return raw.where(F.col("value").rlike(r"^\s*\d")).select(*[F.get(f, F.lit(i)).cast("double" if i else "long").alias(n) for i, n in enumerate(names)])


def task_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``TASK id "name" INPUTS a b OUTPUTS c`` and ``FILE id "source" size`` -> (nodes, files, edges)."""
    v = F.col("value")
    task = lines.where(v.startswith("TASK ")).select(F.regexp_extract(v, r"^TASK (\S+)", 1).alias("task"), F.regexp_extract(v, r'^TASK \S+ "([^"]*)"', 1).alias("name"), F.regexp_extract(v, r"INPUTS((?: (?!OUTPUTS)\S+)*)", 1).alias("i"), F.regexp_extract(v, r"OUTPUTS((?: \S+)*)", 1).alias("o"))
    files = lines.where(v.startswith("FILE ")).select(F.regexp_extract(v, r"^FILE (\S+)", 1).alias("file"), F.regexp_extract(v, r'^FILE \S+ "([^"]*)"', 1).alias("source"), F.regexp_extract(v, r"(\d+)\s*$", 1).cast("long").alias("size"))
    side = lambda c, d: task.select("task", F.explode(F.filter(F.split(F.trim(c), " "), lambda x: x != "")).alias("file"), F.lit(d).alias("direction"))
    return task.select("task", "name"), files, side("i", "IN").unionByName(side("o", "OUT"))


def workflow_runs(lines: DataFrame) -> DataFrame:
    """``us node state job waiting running complete failed aborted total`` lines of a workflow's run log."""
    names = ["us", "node", "state", "job", "waiting", "running", "complete", "failed", "aborted", "total"]
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.col("value").rlike(r"^\d+( \S+){9}$")).select(*[F.get(f, F.lit(i)).cast("long").alias(n) for i, n in enumerate(names)])


def workflow_summary(runs: DataFrame) -> DataFrame:
    """Nodes by their last state: total, completed, aborted, failed, and how many ever failed."""
    last = runs.groupBy("node").agg(F.max_by("state", "us").alias("state"), F.max((F.col("state") == 3).cast("int")).alias("ever_failed"))
    n = lambda s: F.sum((F.col("state") == s).cast("int"))
    return last.agg(F.count(F.lit(1)).alias("total"), n(2).alias("completed"), n(3).alias("failed"), n(4).alias("aborted"), F.sum("ever_failed").alias("ever_failed"))


def workflow_states(runs: DataFrame) -> DataFrame:
    """Nodes in each state, by their last line."""
    return runs.groupBy("node").agg(F.max_by("state", "us").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def lost_attempts(attempts: DataFrame, connections: DataFrame) -> DataFrame:
    """attempts of ``tasks`` with ``lost``: when their worker went away before they had finished, null otherwise."""
    c = connections.select("manager", "worker", "connected", F.col("disconnected").alias("_gone"))
    both = attempts.join(c, ["manager", "worker"], "left")
    on = F.col("running").between(F.col("connected"), F.col("_gone")) & (F.col("finished").isNull() | (F.col("finished") > F.col("_gone"))) & (F.col("done").isNull() | (F.col("done") > F.col("_gone")))
    return both.groupBy(*attempts.columns).agg(F.min(F.when(on, F.col("_gone"))).alias("lost"))


def workflow_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON workflow (rules, categories, environment) -> (rules, edges by file)."""
    schema = "rules array<struct<command: string, inputs: array<string>, outputs: array<string>, category: string, local_job: boolean>>, default_category string"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    rules = doc.select("default_category", F.posexplode("rules").alias("node", "r")).select("node", "r.command", "r.inputs", "r.outputs", F.coalesce("r.category", "default_category", F.lit("default")).alias("category"), F.coalesce("r.local_job", F.lit(False)).alias("local_job"))
    files = rules.select("node", F.explode("inputs").alias("file"), F.lit("IN").alias("direction")).unionByName(rules.select("node", F.explode("outputs").alias("file"), F.lit("OUT").alias("direction")))
    return rules, files


def debug_lines(lines: DataFrame) -> DataFrame:
    """``date time program[pid] stream: message``."""
    shape = r"^(\d{4}/\d\d/\d\d) (\d\d:\d\d:\d\d(?:\.\d+)?) (\S+?)\[(\d+)\] (\S+?): (.*)$"
    g = lambda i: F.regexp_extract("value", shape, i)
    return lines.where(F.col("value").rlike(shape)).select(F.to_timestamp(F.concat_ws(" ", F.regexp_replace(g(1), "/", "-"), g(2))).alias("ts"), g(3).alias("program"), g(4).cast("long").alias("pid"), g(5).alias("stream"), g(6).alias("message"))


def syscalls(lines: DataFrame) -> DataFrame:
    """Trace lines ``pid call("path", ...) = result``: action, path, bytes, ok."""
    v = F.col("value")
    call = F.regexp_extract(v, r"^(?:\d+\s+)?(\w+)\(", 1)
    result = F.regexp_extract(v, r"=\s*(-?\d+)", 1).cast("long")
    action = F.when(call.isin("read", "pread64"), "read").when(call.isin("write", "pwrite64"), "write").when(call.isin("stat", "lstat", "newfstatat", "statx"), "stat").when(call == "mmap", "map").when(call.isin("open", "openat"), F.when(v.rlike("O_WRONLY|O_RDWR|O_CREAT"), "open for writing").otherwise("open"))
    path = F.coalesce(F.nullif(F.regexp_extract(v, r"\w\(\d+<([^>]*)>", 1), F.lit("")), F.nullif(F.regexp_extract(v, r'"([^"]*)"', 1), F.lit("")))
    return lines.select(action.alias("action"), path.alias("path"), F.when(action.isin("read", "write") & (result > 0), result).otherwise(0).alias("bytes"), (result >= 0).alias("ok")).where("action IS NOT NULL")


def directory_totals(calls: DataFrame, depth: int = 2, n: int = 10) -> DataFrame:
    """The n directories (first ``depth`` components) of most bytes, reads and writes apart."""
    d = F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split("path", "/"), lambda x: x != ""), 1, depth), "/"))
    by = lambda a: F.sum(F.when(F.col("action") == a, F.col("bytes")).otherwise(0))
    return calls.where("path IS NOT NULL").groupBy(d.alias("directory")).agg(F.count(F.lit(1)).alias("n"), by("read").alias("read_bytes"), by("write").alias("written_bytes"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "directory").limit(n)


def resource_summaries(spark: SparkSession, path: str) -> DataFrame:
    """JSON summaries in which a resource is a number or [number, unit]; -1 is undefined and becomes NULL."""
    head = "category string, taskid string, exit_type string"
    return summary_rows(spark.read.schema(head + ", " + ", ".join(f"`{r}` string" for r in RESOURCES)).json(path))


def summary_rows(raw: DataFrame) -> DataFrame:
    """Resource summaries whose values are JSON text, as numbers."""
    number = lambda r: F.regexp_extract(F.col(f"`{r}`"), r"^\s*\[?\s*(-?[\d.eE+]+)", 1).try_cast("double")
    return raw.select("category", "taskid", "exit_type", *[F.when(number(r) != -1, number(r)).alias(r) for r in RESOURCES])
