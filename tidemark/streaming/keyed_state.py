"""Live histories: keyed object state kept by Spark's state store, with expiry, late rows and windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "attrs string, alive boolean, ts long"
OUT = "key string, ts long, alive boolean, attrs string"


def apply_event(attrs: dict, alive: bool, op: str, name: str | None, value: str | None, body: dict | None) -> tuple[dict, bool]:
    """State after one event; a create of a live key and changes of an absent one change nothing."""
    if op == "C":
        return (attrs, True) if alive else (dict(body or {}), True)
    if not alive:
        return attrs, alive
    if op == "D":
        return {}, False
    if op == "M":
        return attrs | (body or {}), True
    if op == "U":
        return attrs | {name: value}, True
    if op == "R":
        return {k: v for k, v in attrs.items() if k != name}, True
    return attrs, alive


def live_objects(events: DataFrame, lifetime: int | None = None) -> DataFrame:
    """A stream of (key, ts, seq, op, name, value, attrs) -> one row per touched key and batch: its state after it.

    With a lifetime a key that stays silent that long (in event time, behind the watermark) is removed,
    and a row says so.  Needs a watermark on ``time`` then.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attrs, alive, ts = state.get if state.exists else ("{}", False, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], ts + (lifetime or 0), False, "{}")], columns=["key", "ts", "alive", "attrs"])
            return
        held = json.loads(attrs)
        # a key's rows may come in several Arrow batches, which are in no order
        for e in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples(index=False):
            body = dict(e.attrs) if e.attrs is not None else None
            held, alive = apply_event(held, alive, e.op, e.name, e.value, body)
            ts = max(ts, int(e.ts))
        state.update((json.dumps(held, sort_keys=True), bool(alive), ts))
        if lifetime is not None:
            state.setTimeoutTimestamp(max((ts + lifetime) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], ts, bool(alive), json.dumps(held, sort_keys=True))], columns=["key", "ts", "alive", "attrs"])

    timeout = GroupStateTimeout.EventTimeTimeout if lifetime is not None else GroupStateTimeout.NoTimeout
    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", timeout)


def stepped(events: DataFrame, time: str, every: str, late: str, *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Windowed reductions with a watermark: tumbling, or sliding with ``slide``."""
    return events.withWatermark(time, late).groupBy(F.window(time, every, slide or every)).agg(*aggregates)


def session_steps(events: DataFrame, time: str, key: str, gap: str, late: str, *aggregates: Column) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(*aggregates)
