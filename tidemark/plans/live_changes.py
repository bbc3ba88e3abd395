"""Queries over live changes: the events come in several files, one micro-batch each, and all changes are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.live import LIVE, to_the_end
from tidemark.sources.tables import shared_folder
from tidemark.sources.tables import table as t
from tidemark.streaming.live_changes import changes, with_state_store

HOURS = 3600
#: Where the events are cut into batches: days of the month.
CUTS = ("2024-01-09", "2024-01-17", "2024-01-24")


def _batches(spark, sf, kept: str = "true") -> DataFrame:
    """The events as a stream of files that follow one another in time."""
    e = t(spark, sf, "events").where(kept)
    folder = shared_folder(spark, "live")
    for low, high in zip((None, *CUTS), (*CUTS, None)):
        part = e.where((F.col("ts") >= low) if low else F.lit(True)).where((F.col("ts") < high) if high else F.lit(True))
        # one file is one batch; its row groups are short, for as many tasks to read it
        part.coalesce(1).write.mode("append").option("parquet.block.size", 1 << 22).parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return stream.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", "1 second")


def _operations(e: DataFrame) -> DataFrame:
    """Events as the operations of a log: by event_id % 6."""
    kind = F.pmod("event_id", F.lit(6))
    op = F.when(kind == 0, "C").when(kind == 1, "D").when(kind == 2, "U").when(kind == 3, "R").otherwise("M")
    attrs = F.when(op == "C", F.create_map(F.lit("type"), F.col("event_type"), F.lit("event"), F.col("event_id").cast("string"))).when(op == "M", F.create_map(F.lit("event"), F.col("event_id").cast("string")))
    at = F.unix_timestamp(F.col("time") if "time" in e.columns else F.col("ts"))
    rows = e.select(F.col("user_id").cast("string").alias("key"), at.alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op.isin("U", "R"), "event").alias("name"), F.when(op == "U", F.concat(F.lit("u"), F.col("event_id"))).alias("value"), attrs.alias("attrs"), *(["time"] if "time" in e.columns else []))
    return rows


def _heartbeats(e: DataFrame) -> DataFrame:
    """Every event is its user's whole object: its type, whether it is big, and a count that is always new."""
    attrs = F.create_map(F.lit("type"), F.col("event_type"), F.lit("big"), F.when(F.col("value") > 50, "yes"), F.lit("uptime"), F.col("event_id").cast("string"))
    none = F.lit(None).cast("string")
    return e.select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp("time").alias("ts"), F.col("event_id").alias("seq"), none.alias("op"), none.alias("name"), none.alias("value"), attrs.alias("attrs"), "time")


def _all(spark, stream: DataFrame) -> DataFrame:
    with with_state_store(spark):
        return to_the_end(stream, "update")


def live_changes(spark, sf):
    """What every operation changed, and from what."""
    return _all(spark, changes(_operations(_batches(spark, sf)).drop("time")))


def live_change_capture(spark, sf):
    """What differs between a user's objects, event by event."""
    return _all(spark, changes(_heartbeats(_batches(spark, sf)).drop("time"), whole=True, ignore=("uptime",))).select("key", "ts", "op", "name", "old", F.when(F.col("op") != "C", F.col("value")).alias("value"))


def live_expiry(spark, sf):
    """Users that were silent for four hours, as soon as the watermark or their next event tells."""
    return _all(spark, changes(_heartbeats(_batches(spark, sf)), lifetime=4 * HOURS, whole=True)).where("op = 'X'").select("key", F.col("ts").alias("expired_at"))


def live_state_seeded(spark, sf):
    """The stream from the 17th on, begun with the objects that are alive before: each attribute's last change gives the end."""
    e = t(spark, sf, "events")
    early = _operations(e.where(F.col("ts") < CUTS[1])).withColumn("part", F.lit(""))
    began = history.snapshot(early, 1 << 40).select("key", F.lit(0).cast("long").alias("ts"), "attrs")
    log = _all(spark, changes(_operations(_batches(spark, sf, f"ts >= '{CUTS[1]}'")).drop("time"), began=began))
    # turns from absent to alive and back, from where the seed left the key
    turns = log.where("op IN ('C', 'D')").groupBy("key").agg(F.count(F.lit(1)).alias("turns"), F.max_by("op", "ts").alias("last"))
    both = turns.join(began.select("key"), "key", "full")
    return both.select("key", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), F.coalesce(F.col("last") == "C", F.lit(True)).alias("alive"))


S = "CAST(floor(epoch(ts)) AS BIGINT)"
QUERIES = {
    "live_changes": (
        live_changes,
        f"""WITH {LIVE}, v AS (SELECT *, CASE op WHEN 'R' THEN NULL WHEN 'U' THEN 'u' || seq WHEN 'D' THEN NULL ELSE CAST(seq AS VARCHAR) END AS val FROM eff),
        w AS (SELECT *, lag(val) OVER (PARTITION BY key, gen ORDER BY ts, seq) AS prev FROM v)
        SELECT key, ts, CASE op WHEN 'M' THEN 'U' ELSE op END AS op, CASE WHEN op IN ('C', 'D') THEN NULL ELSE 'event' END AS name, CASE WHEN op IN ('C', 'D') THEN NULL ELSE prev END AS old,
          CASE op WHEN 'C' THEN '{{"event":"' || seq || '","type":"' || event_type || '"}}' ELSE val END AS value FROM w WHERE op <> 'R' OR prev IS NOT NULL""",
    ),
    "live_change_capture": (
        live_change_capture,
        f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, {S} AS ts, event_id, event_type AS type, CASE WHEN value > 50 THEN 'yes' END AS big FROM events),
        d AS (SELECT *, lag(type) OVER w AS otype, lag(big) OVER w AS obig, row_number() OVER w AS i FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
        SELECT key, ts, 'C' AS op, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS value FROM d WHERE i = 1
        UNION ALL SELECT key, ts, 'U', 'type', otype, type FROM d WHERE i > 1 AND type <> otype
        UNION ALL SELECT key, ts, CASE WHEN big IS NULL THEN 'R' ELSE 'U' END, 'big', obig, big FROM d WHERE i > 1 AND big IS DISTINCT FROM obig""",
    ),
    "live_expiry": (
        live_expiry,
        f"""WITH h AS (SELECT CAST(user_id AS VARCHAR) AS key, {S} AS s, lead({S}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
        SELECT key, s + 14400 AS expired_at FROM h WHERE nxt - s > 14400 OR (nxt IS NULL AND s + 14400 <= (SELECT epoch(max(ts)) - 1 FROM events))""",
    ),
    "live_state_seeded": (
        live_state_seeded,
        f"""WITH {LIVE}, late AS (SELECT * FROM eff WHERE op IN ('C', 'D') AND ts >= epoch(TIMESTAMP '{CUTS[1]}')),
        early AS (SELECT key, arg_max(op, (ts, seq)) AS last FROM eff WHERE ts < epoch(TIMESTAMP '{CUTS[1]}') GROUP BY key HAVING arg_max(op, (ts, seq)) <> 'D'),
        n AS (SELECT key, count(*) AS turns, arg_max(op, (ts, seq)) AS last FROM late GROUP BY key)
        SELECT key, coalesce(turns, 0) AS turns, coalesce(n.last, 'C') = 'C' AS alive FROM n FULL JOIN early USING (key)""",
    ),
}
