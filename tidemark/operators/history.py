"""Temporal queries over change logs: object state at a time, at steps, as versions; change capture; expiry.

Events are (part, seq, ts, op, key, name, value, attrs) as sources.eventlog makes them; ``order`` below
is (part, seq).  Creating a live key keeps the stored object; merging, updating or removing on an absent
key does nothing; deleting ends a generation and a later create begins the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import passes


def firing_markers(markers: DataFrame, start: int, every: int, stop: int | None = None) -> DataFrame:
    """markers(ts) -> those at which a step is shown.

    A marker fires if it has reached the next display time, which then moves on by ``every`` once.  In
    closed form: number the markers from ``start``, c = (ts - start) // every + 1 is how many displays
    are due by then, d_i = i + min(0, min over j <= i of (c_j - j)) how many have happened, and marker i
    fires where d grows.  The numbers and the running minimum are taken in two levels: over spans of 4,096
    steps, of which there are few, and inside each span, so no task holds all markers.
    """
    m = markers.select("ts").where(F.col("ts") >= start)
    if stop is not None:
        m = m.where(F.col("ts") <= stop)
    if not every:
        return m
    m = m.select("ts", F.floor((F.col("ts") - start) / every).alias("_step"))
    m = m.withColumn("_span", F.floor(F.col("_step") / 4096)).withColumn("_due", F.col("_step") + 1)
    inside = Window.partitionBy("_span").orderBy("ts")
    m = m.withColumn("_n", F.row_number().over(inside).cast("long"))
    spans = m.groupBy("_span").agg(F.max("_n").alias("_size"), F.min(F.col("_due") - F.col("_n")).alias("_low"))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    spans = spans.withColumn("_floor", F.coalesce(F.min(F.col("_low") - F.col("_base")).over(earlier), F.lit(0)))
    m = m.join(spans.select("_span", "_base", "_floor"), "_span")
    inside = Window.partitionBy("_span").orderBy("_n")  # equal times in the order that they were numbered in
    low = F.min(F.col("_due") - F.col("_n")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_base")
    m = m.withColumn("_lag", F.least(F.lit(0), F.col("_floor"), low))
    # how many have happened grows by one at a marker unless the minimum falls there
    m = m.withColumn("_before", F.coalesce(F.lag("_lag").over(inside), F.least(F.lit(0), F.col("_floor"))))
    return m.where(F.col("_lag") == F.col("_before")).select("ts")


def effective(events: DataFrame, static_filter: Column | None = None) -> DataFrame:
    """The events that change state, with ``generation``; a created object failing static_filter never exists."""
    e = events.where("op NOT IN ('T', 't')")
    if static_filter is not None:
        e = e.where((F.col("op") != "C") | passes(static_filter))
    order = Window.partitionBy("key").orderBy("part", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("C", "D"), F.col("op")), ignorenulls=True).over(before)
    e = e.withColumn("_alive", F.coalesce(last == "C", F.lit(False)))
    e = e.where((F.col("op") == "C") != F.col("_alive")).drop("_alive")
    return e.withColumn("generation", F.sum(F.when(F.col("op") == "C", 1).otherwise(0)).over(order))


def attribute_spans(events: DataFrame, names: list[str] | None = None, static_filter: Column | None = None) -> DataFrame:
    """key, generation, name, value, from_ts, to_ts: when each attribute had each value.

    names prunes to the attributes that a query uses, before anything is shuffled again.
    """
    e = effective(events, static_filter)
    life = F.min(F.when(F.col("op") == "D", F.col("ts"))).over(Window.partitionBy("key", "generation"))
    e = e.withColumn("_end", life).where("op <> 'D'")
    one = F.create_map("name", F.coalesce("value", F.lit(None).cast("string")))
    attrs = F.when(F.col("op").isin("C", "M"), F.col("attrs")).otherwise(one)
    if names is not None:
        attrs = F.map_filter(attrs, lambda k, _: k.isin(*names))
    rows = e.select("key", "generation", "part", "seq", "ts", "_end", F.col("op").alias("_op"), F.explode(attrs).alias("name", "value"))
    nxt = F.lead("ts").over(Window.partitionBy("key", "generation", "name").orderBy("part", "seq"))
    rows = rows.withColumn("to_ts", F.coalesce(nxt, "_end")).where("_op <> 'R'")
    return rows.where("to_ts IS NULL OR to_ts > ts").select("key", "generation", "name", "value", F.col("ts").alias("from_ts"), "to_ts")


def snapshot(events: DataFrame, at: int, names: list[str] | None = None, static_filter: Column | None = None) -> DataFrame:
    """Objects alive after the events up to time ``at``: key, attrs (without attributes that were removed)."""
    e = effective(events.where(F.coalesce("ts", F.lit(at)) <= at), static_filter)
    life = e.groupBy("key").agg(F.max("generation").alias("generation"), F.max_by("op", F.struct("part", "seq")).alias("_last")).where("_last <> 'D'").select("key", "generation")
    e = e.where("op <> 'D'").join(life, ["key", "generation"], "left_semi")
    one = F.create_map("name", "value")
    attrs = F.when(F.col("op").isin("C", "M"), F.col("attrs")).otherwise(one)
    if names is not None:
        attrs = F.map_filter(attrs, lambda k, _: k.isin(*names))
    rows = e.select("key", "part", "seq", "op", F.explode(attrs).alias("name", "value"))
    # the last writer of each attribute: an aggregate with partial sums, not a window
    last = rows.groupBy("key", "name").agg(F.max_by(F.struct("op", "value"), F.struct("part", "seq")).alias("w")).where("w.op <> 'R'")
    objects = last.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.col("w.value").alias("value"))))).alias("attrs"))
    return life.select("key").join(objects, "key", "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def _while_alive(changes: DataFrame, steps: DataFrame, ranges: int = 64) -> DataFrame:
    """(key, _t): the steps in each life of a key, after its birth and up to its death.

    Lives and steps meet in an equi-join on ranges of time, of which there are ``ranges`` between the first step and the last.
    """
    low, high = steps.agg(F.min("ts"), F.max("ts")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) // ranges))
    lives = changes.groupBy("key", "generation").agg(F.min("ts").alias("_born"), F.max(F.when(F.col("op") == "D", F.col("ts"))).alias("_died"))
    lives = lives.where((F.col("_born") < high) & F.coalesce(F.col("_died") >= low, F.lit(True)))
    at = lambda t: F.floor((t - low) / width)
    lives = lives.withColumn("_range", F.explode(F.sequence(at(F.greatest("_born", F.lit(low))), at(F.least(F.coalesce("_died", F.lit(high)), F.lit(high))))))
    ticks = lives.join(steps.select(F.col("ts").alias("_t"), at(F.col("ts")).alias("_range")), "_range")
    return ticks.where((F.col("_t") > F.col("_born")) & F.coalesce(F.col("_t") <= F.col("_died"), F.lit(True))).select("key", "_t")


def states_at(events: DataFrame, steps: DataFrame, names: list[str], static_filter: Column | None = None, where: Column | None = None) -> DataFrame:
    """Per step(ts) and live object: key and one column per name (JSON text), as before the events at the step.

    Events and steps meet in one union per key, values carried forward by last-non-null; each key sees
    only the steps at which it is alive.
    """
    e = effective(events, static_filter)
    own = e.select(
        "key", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), "part", "seq", "op",
        *[
            F.when(F.col("op") == "C", F.struct(F.col("attrs")[n].alias("v")))
            .when((F.col("op") == "M") & F.map_contains_key("attrs", n), F.struct(F.col("attrs")[n].alias("v")))
            .when((F.col("op") == "U") & (F.col("name") == n), F.struct(F.col("value").alias("v")))
            .when((F.col("op") == "R") & (F.col("name") == n), F.struct(F.lit(None).cast("string").alias("v")))
            .alias(f"_a{i}")
            for i, n in enumerate(names)
        ],
    )
    ticks = _while_alive(e, steps)
    none = F.lit(None).cast("struct<v:string>")
    ticks = ticks.select("key", "_t", F.lit(0).alias("_kind"), F.lit("").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), *[none.alias(f"_a{i}") for i in range(len(names))])
    so_far = Window.partitionBy("key").orderBy("_t", "_kind", "part", "seq").rowsBetween(Window.unboundedPreceding, 0)
    alive = F.last(F.when(F.col("op").isin("C", "D"), F.col("op")), ignorenulls=True).over(so_far)
    both = own.unionByName(ticks).select("key", "_t", "_kind", alive.alias("_alive"), *[F.last(f"_a{i}", ignorenulls=True).over(so_far)["v"].alias(n) for i, n in enumerate(names)])
    out = both.where("_kind = 0 AND _alive = 'C'").select(F.col("_t").alias("ts"), "key", *names)
    return out.where(passes(where)) if where is not None else out


def displays(states: DataFrame, *outputs: Column, iso: bool = False) -> DataFrame:
    """One row per record and step: the time (epoch or ISO) and the projected expressions."""
    when = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss") if iso else F.col("ts")
    return states.select(when.alias("time"), *outputs)


def change_capture(objects: DataFrame, ignore: tuple[str, ...] = ("lastheardfrom", "uptime")) -> DataFrame:
    """objects(key, ts, attrs) in time order -> the events that turn each into the next: C, then M and R.

    Objects compress well, so tasks are not sized by what is shuffled: all shuffle partitions are used, and each is sorted once.
    """
    objects = objects.repartition(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    order = Window.partitionBy("key").orderBy("ts")
    o = objects.withColumn("_old", F.lag("attrs").over(order))
    old = F.coalesce("_old", F.create_map().cast("map<string,string>"))
    quiet = lambda k: k.isin(*ignore) if ignore else F.lit(False)
    o = o.select("key", "ts", "attrs", "_old", old.alias("_before"))
    changed = F.map_filter("attrs", lambda k, v: ~quiet(k) & ~v.eqNullSafe(F.col("_before")[k]))
    removed = F.filter(F.map_keys("_before"), lambda k: ~quiet(k) & ~F.map_contains_key("attrs", k))
    none, no_attrs = F.lit(None).cast("string"), F.lit(None).cast(objects.schema["attrs"].dataType)
    event = lambda op, name, attrs: F.struct(F.lit(op).alias("op"), name.alias("name"), attrs.alias("attrs"))
    put = F.when(F.col("_old").isNull(), event("C", none, F.col("attrs"))).when(F.size(changed) > 0, event("M", none, changed))
    gone = F.transform(F.filter(removed, lambda _: F.col("_old").isNotNull()), lambda k: event("R", k, no_attrs))
    rows = o.select("key", "ts", F.explode(F.concat(F.array_compact(F.array(put)), gone)).alias("_e"))
    return rows.select("key", "ts", "_e.op", "_e.name", "_e.attrs")


def expiries(heartbeats: DataFrame, lifetime: int, own: str | None = None, until: int | None = None) -> DataFrame:
    """heartbeats(key, ts) -> key, last_heard, expired_at wherever a key was silent longer than its lifetime.

    own names a column with a key's own lifetime; the smaller one holds.  The last heartbeat expires only
    if ``until`` is given and lies beyond it.
    """
    limit = F.least(F.lit(lifetime), F.coalesce(own, F.lit(lifetime))) if own else F.lit(lifetime)
    nxt = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    h = heartbeats.withColumn("_next", F.coalesce(nxt, F.lit(until)) if until is not None else nxt)
    return h.where(F.col("_next") - F.col("ts") > limit).select("key", F.col("ts").alias("last_heard"), (F.col("ts") + limit).alias("expired_at"))
