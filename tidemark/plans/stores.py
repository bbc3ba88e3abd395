"""Queries over stores of day files: the events table is written as a store, and parts of it are read back.

The events of 30 days are spread over 120, so that the days of a span have one, two and three digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.temporal import DAY, LOG, as_history
from tidemark.sources import eventlog
from tidemark.sources.tables import shared_folder

#: 2024-01-01, where the events begin.
ORIGIN = 1704067200
START, STOP = ORIGIN + 8 * DAY + DAY // 2, ORIGIN + 101 * DAY + DAY // 3


def _spread(spark, sf) -> DataFrame:
    return as_history(spark, sf).withColumn("ts", (F.col("ts") - ORIGIN) * 4 + ORIGIN)


def _store(spark, sf, log: DataFrame) -> str:
    """The log's day files, and the checkpoint of the day in which START lies."""
    root = shared_folder(spark, "store")
    eventlog.write_store(log, root)
    day = START // DAY * DAY
    before = history.snapshot(log, day - 1)
    year, number = eventlog.day_of(START)
    eventlog.write_checkpoint(before, f"{root}/{year}/{number}.ckpt")
    return root


def history_directory(spark, sf):
    """Objects at STOP: from the checkpoint of START's day and the days from it on, whatever came before."""
    root = _store(spark, sf, _spread(spark, sf))
    s = history.snapshot(eventlog.read_store(spark, root, START, STOP), STOP)
    return s.select("key", F.col("attrs")["event_type"].alias("event_type"), F.col("attrs")["event"].alias("event"))


def history_directory_states(spark, sf):
    """Live objects at steps of ten days from START, read from the store."""
    root = _store(spark, sf, _spread(spark, sf))
    events = eventlog.read_store(spark, root, START, STOP)
    steps = spark.range(START, STOP, 10 * DAY).select(F.col("id").alias("ts"))
    return history.states_at(events, steps, ["event"]).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count("event").alias("with_event"))


def history_directory_days(spark, sf):
    """The days 98 to 101 of the store, as they are, by day and operation."""
    log = _spread(spark, sf)
    root = shared_folder(spark, "store")
    eventlog.write_store(log, root)
    e = eventlog.read_store(spark, root, ORIGIN + 98 * DAY, ORIGIN + 102 * DAY - 1, checkpoint=False).where("op NOT IN ('T', 't')")
    return e.groupBy("part", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.countDistinct("key").alias("keys"))


def checkpoint_round_trip(spark, sf):
    """A checkpoint as it is read back: every object with what it holds."""
    root = shared_folder(spark, "store")
    log = as_history(spark, sf)
    eventlog.write_checkpoint(history.snapshot(log, ORIGIN + 20 * DAY), f"{root}/a.ckpt")
    c = eventlog.read_checkpoint(spark, f"{root}/a.ckpt")
    return c.select("key", "op", F.col("attrs")["event_type"].alias("event_type"), F.col("attrs")["event"].alias("event"))


SPREAD = LOG.replace("CAST(floor(epoch(ts)) AS BIGINT) AS ts", f"(CAST(floor(epoch(ts)) AS BIGINT) - {ORIGIN}) * 4 + {ORIGIN} AS ts")


def _at(log: str, at: int, columns: str = "") -> str:
    """The objects of a log at a time."""
    return f"""WITH {log}, e AS (SELECT * FROM eff WHERE ts <= {at}),
        life AS (SELECT key, max(gen) AS gen FROM e GROUP BY key HAVING arg_max(op, seq) <> 'D'),
        x AS (SELECT e.* FROM e JOIN life USING (key, gen))
        SELECT key, {columns}max_by(event_type, seq) FILTER (op IN ('C', 'M')) AS event_type,
          nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, seq), '') AS event FROM x GROUP BY key"""


QUERIES = {
    "history_directory": (history_directory, _at(SPREAD, STOP)),
    "history_directory_states": (
        history_directory_states,
        f"""WITH {SPREAD}, st AS (SELECT unnest(range({START}, {STOP}, {10 * DAY})) AS tick),
        life AS (SELECT tick, key, max(gen) AS gen FROM eff, st WHERE ts < tick GROUP BY tick, key HAVING arg_max(op, seq) <> 'D'),
        x AS (SELECT tick, eff.* FROM eff JOIN life USING (key, gen) WHERE ts < tick),
        z AS (SELECT tick AS ts, key, max_by(CASE op WHEN 'R' THEN '' ELSE 'x' END, seq) AS event FROM x GROUP BY 1, 2)
        SELECT ts, count(*) AS n, count(*) FILTER (event = 'x') AS with_event FROM z GROUP BY 1""",
    ),
    "history_directory_days": (
        history_directory_days,
        f"""WITH {SPREAD} SELECT '2024/' || lpad(CAST((ts - {ORIGIN}) // {DAY} AS VARCHAR), 3, '0') AS part, op, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, count(DISTINCT key) AS keys
        FROM log WHERE ts >= {ORIGIN + 98 * DAY} AND ts < {ORIGIN + 102 * DAY} GROUP BY 1, 2""",
    ),
    "checkpoint_round_trip": (checkpoint_round_trip, _at(LOG, ORIGIN + 20 * DAY, "'C' AS op, ")),
}
