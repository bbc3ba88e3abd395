"""Queries over histories: reductions in three scopes, steps, snapshots, versions, change capture, expiry.

The events table is a history whose keys are users: every row merges event_type and value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history, timeseries
from tidemark.operators.reductions import Reduce, hourly, overall, spatial, temporal
from tidemark.sources.tables import table as t

DAY = 86400


def as_history(spark, sf):
    """events as a change log: the first row of a user creates, others merge; purchases update, one type removes; a day is a part."""
    e = t(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first"))
    e = e.join(first, "user_id")
    born = F.col("event_id") == F.col("first")
    kind = F.pmod("event_id", F.lit(17))
    op = F.when(born, "C").when(kind == 3, "D").when(kind == 5, "C").when(kind == 7, "R").when(kind == 9, "U").otherwise("M")
    attrs = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("event"), F.col("event_id").cast("string"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("part"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"), op.alias("op"), F.col("user_id").cast("string").alias("key"),
        F.when(op.isin("U", "R"), F.lit("event")).alias("name"), F.when(op == "U", F.concat(F.lit("u"), F.col("event_id"))).alias("value"), F.when(op.isin("C", "M"), attrs).alias("attrs"),
    )


#: The same log as a relation.
LOG = """
log AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS key, event_type,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'C' WHEN event_id % 17 = 3 THEN 'D' WHEN event_id % 17 = 5 THEN 'C'
       WHEN event_id % 17 = 7 THEN 'R' WHEN event_id % 17 = 9 THEN 'U' ELSE 'M' END AS op FROM events),
live AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('C', 'D') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'D') = 'C' AS alive FROM log),
eff AS (SELECT *, sum(CASE WHEN op = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS gen FROM live WHERE (op = 'C') <> alive)"""


def spatial_reductions(spark, sf):
    e = t(spark, sf, "events").where("event_type = 'click'")
    v, cents = F.col("value"), F.round(F.col("value") * 100).cast("long")
    return spatial(e, hourly(F.col("ts")), F.struct("ts", "event_id"), Reduce("COUNT", v, "n"), Reduce("MIN", v, "low"), Reduce("MAX", v, "high"), Reduce("SUM", cents.cast("double"), "cents")).withColumn("cents", F.col("cents").cast("long"))


def temporal_reductions(spark, sf):
    e = t(spark, sf, "events")
    day = (F.floor(F.unix_timestamp("ts") / DAY) * DAY).cast("long")
    v = F.col("value")
    out = temporal(e, day, F.col("user_id"), F.struct("ts", "event_id"), Reduce("FIRST", v, "first"), Reduce("LAST", v, "last"), Reduce("INC", v, "inc"), Reduce("COUNT", v, "n"))
    return out.withColumn("inc", F.round("inc", 6))


def global_reductions(spark, sf):
    e = t(spark, sf, "events")
    out = overall(e, hourly(F.col("ts")), F.struct("ts", "event_id"), Reduce("COUNT", F.col("event_id"), "n"), Reduce("LAST", F.col("event_id"), "last"), Reduce("FIRST", F.col("event_id"), "first"), Reduce("UNIQUE", F.col("event_type"), "types"))
    return out.withColumn("types", F.array_join("types", ","))


def interval_steps(spark, sf):
    e = t(spark, sf, "events").select(F.unix_timestamp("ts").alias("ts"))
    start = e.agg(F.min("ts")).first()[0]
    return history.firing_markers(e.distinct(), start, 7 * 3600).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))


def snapshot_as_of(spark, sf):
    log = as_history(spark, sf)
    at = log.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).first()[0]
    s = history.snapshot(log, at)
    return s.select("key", F.col("attrs")["event_type"].alias("event_type"), F.col("attrs")["event"].alias("event"))


def state_versions(spark, sf):
    return history.attribute_spans(as_history(spark, sf), ["event"])


def states_at_steps(spark, sf):
    log = as_history(spark, sf)
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    steps = spark.range(1, 6).select((F.lit(low) + F.floor(F.col("id") * (high - low) / 6)).alias("ts"))
    return history.states_at(log, steps, ["event", "event_type"], where=F.col("event_type") == "click")


def change_capture(spark, sf):
    e = t(spark, sf, "events")
    attrs = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("big"), F.when(F.col("value") > 50, "yes")), lambda _, v: v.isNotNull())
    # one row per time and user: the last event
    o = e.groupBy(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("ts")).agg(F.max_by(attrs, "event_id").alias("attrs"))
    c = history.change_capture(o)
    return c.select("key", "ts", "op", "name", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("changed"))


def ttl_expiry(spark, sf):
    h = t(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("ts"))
    return history.expiries(h, 4 * 3600)


def timeseries_delta(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return timeseries.deltas(e, ["user_id"], ["s", "event_id"], "s", "cents").select("event_id", "s_delta", "cents_delta")


def downsample_first(spark, sf):
    e = t(spark, sf, "events").select("event_type", "event_id", "value", F.unix_timestamp("ts").alias("s"))
    return timeseries.first_of_step(e, ["event_type"], "s", ["event_id"], 6 * 3600)


def stacked_percent(spark, sf):
    g = t(spark, sf, "events").groupBy(hourly(F.col("ts")).alias("step")).pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)
    s = timeseries.stacked_percent(g, "click", "view", "purchase")
    return s.select("step", *[F.round(f"{c}_pct", 6).alias(f"{c}_pct") for c in ("click", "view", "purchase")])


def cumulative_curve(spark, sf):
    return timeseries.completion_curve(t(spark, sf, "events").select(hourly(F.col("ts")).alias("step")), "step")


def session_islands(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.unix_timestamp("ts").alias("s"))
    return timeseries.sessions(e, ["user_id"], "s", 2 * 3600).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("begin"), F.max("s").alias("end"))


S = "CAST(floor(epoch(ts)) AS BIGINT)"
QUERIES = {
    "spatial_reductions": (spatial_reductions, f"SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(value) AS n, min(value) AS low, max(value) AS high, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_type = 'click' GROUP BY 1"),
    "temporal_reductions": (temporal_reductions, "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS step, user_id AS key, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS inc, count(value) AS n FROM events GROUP BY 1, 2"),
    "global_reductions": (global_reductions, "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last, arg_min(event_id, (ts, event_id)) AS first, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1"),
    "interval_steps": (
        interval_steps,
        f"""WITH RECURSIVE m AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT {S} AS ts FROM events)),
        lo AS (SELECT min(ts) AS start FROM m),
        r AS (SELECT i, ts, true AS fires, (SELECT start FROM lo) + 25200 AS nxt FROM m WHERE i = 1
          UNION ALL SELECT m.i, m.ts, m.ts >= r.nxt, CASE WHEN m.ts >= r.nxt THEN r.nxt + 25200 ELSE r.nxt END FROM r JOIN m ON m.i = r.i + 1)
        SELECT ts, CAST(1 AS BIGINT) AS n FROM r WHERE fires""",
    ),
    "snapshot_as_of": (
        snapshot_as_of,
        f"""WITH {LOG}, mid AS (SELECT floor((min(ts) + max(ts)) / 2) AS tick FROM log), e AS (SELECT * FROM eff WHERE ts <= (SELECT tick FROM mid)),
        life AS (SELECT key, max(gen) AS gen FROM e GROUP BY key HAVING arg_max(op, seq) <> 'D'),
        x AS (SELECT e.* FROM e JOIN life USING (key, gen))
        SELECT key, max_by(event_type, seq) FILTER (op IN ('C', 'M')) AS event_type,
          nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, seq), '') AS event FROM x GROUP BY key""",
    ),
    "state_versions": (
        state_versions,
        f"""WITH {LOG}, x AS (SELECT *, min(CASE WHEN op = 'D' THEN ts END) OVER (PARTITION BY key, gen) AS died FROM eff),
        y AS (SELECT *, lead(ts) OVER (PARTITION BY key, gen ORDER BY seq) AS nxt FROM x WHERE op <> 'D')
        SELECT key, CAST(gen AS BIGINT) AS generation, 'event' AS name, CASE WHEN op = 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END AS value, ts AS from_ts, coalesce(nxt, died) AS to_ts
        FROM y WHERE op <> 'R' AND (coalesce(nxt, died) IS NULL OR coalesce(nxt, died) > ts)""",
    ),
    "states_at_steps": (
        states_at_steps,
        f"""WITH {LOG}, b AS (SELECT min(ts) AS low, max(ts) AS high FROM log), st AS (SELECT CAST(low + floor(k * (high - low) / 6) AS BIGINT) AS tick FROM b, (SELECT unnest(range(1, 6)) AS k)),
        life AS (SELECT tick, key, max(gen) AS gen FROM eff, st WHERE ts < tick GROUP BY tick, key HAVING arg_max(op, seq) <> 'D'),
        x AS (SELECT tick, eff.* FROM eff JOIN life USING (key, gen) WHERE ts < tick),
        z AS (SELECT tick AS ts, key, nullif(max_by(CASE op WHEN 'R' THEN '' WHEN 'U' THEN 'u' || seq ELSE CAST(seq AS VARCHAR) END, seq), '') AS event, max_by(event_type, seq) FILTER (op IN ('C', 'M')) AS event_type FROM x GROUP BY 1, 2)
        SELECT * FROM z WHERE event_type = 'click'""",
    ),
    "change_capture": (
        change_capture,
        f"""WITH o AS (SELECT user_id AS key, {S} AS ts, arg_max(event_type, event_id) AS type, arg_max(CASE WHEN value > 50 THEN 1 ELSE 0 END, event_id) AS big FROM events GROUP BY 1, 2),
        d AS (SELECT *, lag(type) OVER w AS otype, lag(big) OVER w AS obig FROM o WINDOW w AS (PARTITION BY key ORDER BY ts)),
        m AS (SELECT key, ts, concat_ws(',', CASE WHEN big = 1 AND obig = 0 THEN 'big' END, CASE WHEN type <> otype THEN 'type' END) AS changed FROM d WHERE otype IS NOT NULL)
        SELECT key, ts, 'C' AS op, CAST(NULL AS VARCHAR) AS name, CASE WHEN big = 1 THEN 'big,type' ELSE 'type' END AS changed FROM d WHERE otype IS NULL
        UNION ALL SELECT key, ts, 'M', NULL, changed FROM m WHERE changed <> ''
        UNION ALL SELECT key, ts, 'R', 'big', NULL FROM d WHERE obig = 1 AND big = 0""",
    ),
    "ttl_expiry": (ttl_expiry, f"SELECT key, ts AS last_heard, ts + 14400 AS expired_at FROM (SELECT user_id AS key, {S} AS ts, lead({S}) OVER (PARTITION BY user_id ORDER BY {S}) AS nxt FROM events) WHERE nxt - ts > 14400"),
    "timeseries_delta": (timeseries_delta, f"SELECT event_id, {S} - lag({S}) OVER w AS s_delta, CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT)) OVER w AS cents_delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {S}, event_id)"),
    "downsample_first": (downsample_first, f"SELECT CAST(floor({S} / 21600) AS BIGINT) AS step, event_type, arg_min(event_id, ({S}, event_id)) AS event_id, arg_min(value, ({S}, event_id)) AS value, min({S}) AS s FROM events GROUP BY 1, 2"),
    "stacked_percent": (
        stacked_percent,
        """WITH g AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
        SELECT step, CASE WHEN c + v + p = 0 THEN 0.0 ELSE round(100.0 * c / (c + v + p), 6) END AS click_pct, CASE WHEN c + v + p = 0 THEN 0.0 ELSE round(100.0 * (c + v) / (c + v + p), 6) END AS view_pct, CAST(CASE WHEN c + v + p = 0 THEN 0 ELSE 100 END AS DOUBLE) AS purchase_pct FROM g""",
    ),
    "cumulative_curve": (cumulative_curve, "SELECT step, n, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS cumulative FROM (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, count(*) AS n FROM events GROUP BY 1)"),
    "session_islands": (
        session_islands,
        f"""WITH x AS (SELECT user_id, {S} AS s, CASE WHEN {S} - lag({S}) OVER (PARTITION BY user_id ORDER BY {S}) <= 7200 THEN 0 ELSE 1 END AS n FROM events),
        y AS (SELECT user_id, s, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM x)
        SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(s) AS begin, max(s) AS end FROM y GROUP BY 1, 2""",
    ),
}
