"""Queries over live histories: keyed state, windows and derived streams, each read to its end and then compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.operators.reductions import Reduce, feeding, spatial, temporal
from tidemark.plans.temporal import LOG, as_history
from tidemark.sources import eventlog, log_tail
from tidemark.sources.tables import shared_folder
from tidemark.sources.tables import table as t
from tidemark.streaming import keyed_state


def to_the_end(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All that a stream of the files at hand puts out, as a table: every batch is written by the executors, none collected.

    A folder in which a stream ended before is gone on with.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "live")
    way = {"complete": "overwrite"}.get(mode, "append")

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode(way).parquet(f"{folder}/out")

    q = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark, sf):
    e = t(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _changes(spark, sf):
    """The events as a live change log: the operation by event_id % 6."""
    kind = F.pmod("event_id", F.lit(6))
    op = F.when(kind == 0, "C").when(kind == 1, "D").when(kind == 2, "U").when(kind == 3, "R").otherwise("M")
    attrs = F.when(op == "C", F.create_map(F.lit("type"), F.col("event_type"), F.lit("event"), F.col("event_id").cast("string"))).when(op == "M", F.create_map(F.lit("event"), F.col("event_id").cast("string")))
    name = F.when(op.isin("U", "R"), "event")
    return _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), name.alias("name"), F.when(op == "U", F.concat(F.lit("u"), F.col("event_id"))).alias("value"), attrs.alias("attrs"))


def _relative(lines: DataFrame) -> DataFrame:
    """Lines whose markers but the first of a part say how much later it is."""
    marks = F.when(F.col("line").startswith("T "), F.substring("line", 3, 20).cast("long"))
    before = F.lag("mark").over(Window.partitionBy("part").orderBy("seq"))
    timed = lines.withColumn("mark", marks).where("mark IS NOT NULL").withColumn("before", before)
    later = timed.select("part", "seq", F.coalesce(F.concat(F.lit("t "), F.col("mark") - F.col("before")), "line").alias("line"))
    return lines.where(~F.col("line").startswith("T ")).unionByName(later)


def live_log_tail(spark, sf):
    """The log of as_history as day files that are followed: read once when half of it is there, mid-day, and again when all is."""
    spark.dataSource.register(log_tail.LogTail)
    log = as_history(spark, sf).withColumn("part", F.format_string("%d/%03d", F.year(F.timestamp_seconds("ts")), F.dayofyear(F.timestamp_seconds("ts")) - 1))
    root, folder, noon = shared_folder(spark, "tail"), shared_folder(spark, "live"), 1704067200 + 16 * 86400 + 43200
    stream = log_tail.timed(spark.readStream.format("log_tail").option("path", root).option("range", 1 << 14).load())
    for there in (log.where(F.col("ts") < noon), log):
        log_tail.write_files(_relative(eventlog.to_lines(there)), root).write.format("noop").mode("overwrite").save()
        out = to_the_end(stream, "append", folder)
    return out.where("op NOT IN ('T', 't')").groupBy("part", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.countDistinct("key").alias("keys"))


def _last_state(states: DataFrame) -> DataFrame:
    last = states.groupBy("key").agg(F.max_by(F.struct("alive", "attrs"), "ts").alias("s")).where("s.alive")
    return last.select("key", F.get_json_object("s.attrs", "$.type").alias("type"), F.get_json_object("s.attrs", "$.event").alias("event"))


def live_state(spark, sf):
    return _last_state(to_the_end(keyed_state.live_objects(_changes(spark, sf)), "update"))


def live_state_operations(spark, sf):
    """How often each operation changed a live state, from the batch rules on the same log."""
    spark_log = _changes_batch(spark, sf)
    return history.effective(spark_log).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


def _changes_batch(spark, sf):
    kind = F.pmod("event_id", F.lit(6))
    op = F.when(kind == 0, "C").when(kind == 1, "D").when(kind == 2, "U").when(kind == 3, "R").otherwise("M")
    return t(spark, sf, "events").select(F.lit("").alias("part"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"))


def derived_stream(spark, sf):
    """A live stream of states, filtered again: keys in which an attribute says 'click'."""
    states = keyed_state.live_objects(_changes(spark, sf))
    return _last_state(to_the_end(states.where(F.col("alive") & (F.get_json_object("attrs", "$.type") == "click")), "update"))


def stream_hourly_counts(spark, sf):
    steps = keyed_state.stepped(_events(spark, sf), "ts", "1 hour", "30 days", F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
    return to_the_end(steps, "complete").select(F.unix_timestamp("window.start").alias("step"), "n", "high")


def stream_closed_hours(spark, sf):
    """Append mode: an hour comes out once, when the watermark has passed it."""
    steps = keyed_state.stepped(_events(spark, sf), "ts", "1 hour", "90 minutes", F.count(F.lit(1)).alias("n"))
    return to_the_end(steps, "append").select(F.unix_timestamp("window.start").alias("step"), "n")


def stream_sessions(spark, sf):
    s = keyed_state.session_steps(_events(spark, sf), "ts", "user_id", "2 hours", "0 seconds", F.count(F.lit(1)).alias("n"))
    return to_the_end(s, "append").select("user_id", F.unix_timestamp("session_window.start").alias("begin"), "n")


def sliding_windows(spark, sf):
    steps = keyed_state.stepped(_events(spark, sf), "ts", "6 hours", "30 days", F.count(F.lit(1)).alias("n"), slide="2 hours")
    return to_the_end(steps, "complete").select(F.unix_timestamp("window.start").alias("step"), "n")


def _states(spark, sf, **kw):
    log = as_history(spark, sf)
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    steps = spark.range(1, 6).select((F.lit(low) + F.floor(F.col("id") * (high - low) / 6)).alias("ts"))
    return history.states_at(log, steps, ["event", "event_type"], **kw)


def spatial_over_live_objects(spark, sf):
    """Reductions over the objects alive at each step; a missing attribute counts, and adds 1."""
    s = _states(spark, sf)
    v = F.regexp_replace("event", "^u", "").try_cast("double")
    out = spatial(s, F.col("ts"), F.col("key"), Reduce("COUNT", v, "n"), Reduce("SUM", v, "total"), Reduce("AVERAGE", v, "mean"), Reduce("MIN", v, "low"), Reduce("MAX", v, "high"), Reduce("UNIQUE", F.col("event_type"), "types"))
    return out.withColumn("types", F.array_join("types", ",")).withColumn("mean", F.round("mean", 6))


def state_displays(spark, sf):
    s = _states(spark, sf, where=F.col("event_type") == "click")
    return history.displays(s, F.col("key"), F.concat(F.col("event_type"), F.lit("/"), F.coalesce("event", F.lit("-"))).alias("shown"), iso=True)


def static_filter_snapshot(spark, sf):
    """Objects created as a click or a view are followed, all others never exist."""
    log = as_history(spark, sf)
    at = log.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).first()[0]
    s = history.snapshot(log, at, static_filter=F.col("attrs")["event_type"].isin("click", "view"))
    return s.select("key", F.col("attrs")["event_type"].alias("event_type"), F.col("attrs")["event"].alias("event"))


def update_triggers(spark, sf):
    """Temporal reductions are fed by creates, merges and updates, whether they change a state or not."""
    e = feeding(as_history(spark, sf))
    out = temporal(e, (F.floor(F.col("ts") / 86400) * 86400).cast("long"), F.col("key"), F.col("seq"), Reduce("COUNT", F.col("seq"), "n"), Reduce("AVERAGE", F.col("seq"), "mean"), Reduce("LAST", F.col("op"), "last"))
    return out.withColumn("mean", F.round("mean", 6))


S = "CAST(floor(epoch(ts)) AS BIGINT)"
LIVE = f"""
log AS (SELECT event_id AS seq, {S} AS ts, CAST(user_id AS VARCHAR) AS key, event_type, CASE event_id % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'U' WHEN 3 THEN 'R' ELSE 'M' END AS op FROM events),
live AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('C', 'D') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'D') = 'C' AS alive FROM log),
eff AS (SELECT *, sum(CASE WHEN op = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq) AS gen FROM live WHERE (op = 'C') <> alive),
ends AS (SELECT key, max(gen) AS gen FROM eff GROUP BY key HAVING arg_max(op, (ts, seq)) <> 'D'),
state AS (SELECT key, max_by(event_type, (ts, seq)) FILTER (op = 'C') AS type,
  nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, (ts, seq)), '') AS event FROM eff JOIN ends USING (key, gen) GROUP BY key)"""
STEPS = f"""{LOG}, b AS (SELECT min(ts) AS low, max(ts) AS high FROM log), st AS (SELECT CAST(low + floor(k * (high - low) / 6) AS BIGINT) AS tick FROM b, (SELECT unnest(range(1, 6)) AS k)),
life AS (SELECT tick, key, max(gen) AS gen FROM eff, st WHERE ts < tick GROUP BY tick, key HAVING arg_max(op, seq) <> 'D'),
x AS (SELECT tick, eff.* FROM eff JOIN life USING (key, gen) WHERE ts < tick),
z AS (SELECT tick AS ts, key, nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, seq), '') AS event, max_by(event_type, seq) FILTER (op IN ('C', 'M')) AS event_type FROM x GROUP BY 1, 2)"""
QUERIES = {
    "live_state": (live_state, f"WITH {LIVE} SELECT key, type, event FROM state"),
    "live_state_operations": (
        live_state_operations,
        """WITH log AS (SELECT event_id AS seq, user_id AS key, CASE event_id % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'U' WHEN 3 THEN 'R' ELSE 'M' END AS op FROM events),
        live AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('C', 'D') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'D') = 'C' AS alive FROM log)
        SELECT op, count(*) AS n, count(DISTINCT key) AS keys FROM live WHERE (op = 'C') <> alive GROUP BY 1""",
    ),
    "live_log_tail": (live_log_tail, f"WITH {LOG} SELECT '2024/' || lpad(CAST((ts - 1704067200) // 86400 AS VARCHAR), 3, '0') AS part, op, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, count(DISTINCT key) AS keys FROM log GROUP BY 1, 2"),
    "derived_stream": (derived_stream, f"WITH {LIVE} SELECT key, type, event FROM state WHERE type = 'click'"),
    "stream_hourly_counts": (stream_hourly_counts, "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(*) AS n, max(value) AS high FROM events GROUP BY 1"),
    "stream_closed_hours": (stream_closed_hours, "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(*) AS n FROM events GROUP BY 1 HAVING floor(epoch(any_value(ts)) / 3600) * 3600 + 3600 <= (SELECT epoch(max(ts)) - 5400 FROM events)"),
    "stream_sessions": (
        stream_sessions,
        """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events),
        y AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS begin, count(*) AS n FROM y GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""",
    ),
    "sliding_windows": (sliding_windows, "SELECT CAST(floor(epoch(ts) / 7200) * 7200 - k * 7200 AS BIGINT) AS step, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS k) GROUP BY 1"),
    "spatial_over_live_objects": (
        spatial_over_live_objects,
        f"""WITH {STEPS}, v AS (SELECT *, CAST(replace(event, 'u', '') AS DOUBLE) AS v FROM z)
        SELECT ts AS step, count(*) AS n, sum(coalesce(v, 1)) AS total, round(coalesce(avg(v), 0), 6) AS mean, coalesce(min(v), 0) AS low, coalesce(max(v), 0) AS high, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM v GROUP BY 1""",
    ),
    "state_displays": (state_displays, f"WITH {STEPS} SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS time, key, event_type || '/' || coalesce(event, '-') AS shown FROM z WHERE event_type = 'click'"),
    "static_filter_snapshot": (
        static_filter_snapshot,
        f"""WITH {LOG.replace("live AS (SELECT *", "kept AS (SELECT * FROM log WHERE op <> 'C' OR event_type IN ('click', 'view')), live AS (SELECT *").replace("AS alive FROM log)", "AS alive FROM kept)")},
        mid AS (SELECT floor((min(ts) + max(ts)) / 2) AS tick FROM log), e AS (SELECT * FROM eff WHERE ts <= (SELECT tick FROM mid)),
        ends AS (SELECT key, max(gen) AS gen FROM e GROUP BY key HAVING arg_max(op, seq) <> 'D'),
        x AS (SELECT e.* FROM e JOIN ends USING (key, gen))
        SELECT key, max_by(event_type, seq) FILTER (op IN ('C', 'M')) AS event_type,
          nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, seq), '') AS event FROM x GROUP BY key""",
    ),
    "update_triggers": (update_triggers, f"WITH {LOG} SELECT CAST(floor(ts / 86400) * 86400 AS BIGINT) AS step, key, count(*) AS n, round(avg(seq), 6) AS mean, arg_max(op, seq) AS last FROM log WHERE op IN ('C', 'M', 'U') GROUP BY 1, 2"),
}
