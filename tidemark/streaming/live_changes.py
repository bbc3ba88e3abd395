"""Live objects with a state entry for every attribute, timers for expiry, and their changes as output.

A key's object is a map state, name to value, of which an event reads and writes the names that it touches; the
object as a whole is only read where a whole one is compared with it.  Every change comes out as a row, so the output
is a change log that any later store can follow:

    C  the object began; value is what it began with, as JSON
    U  an attribute has a new value, R  it is gone; old is what it was before
    D  the object was deleted, X  it was not heard of for its lifetime; ts is when that was over

Rows of a key are taken in the order of (ts, seq) within a micro-batch.  Silence is seen in two ways: by a timer when the
watermark passes the lifetime, or earlier by the next row of the key itself, so what comes out does not
depend on how the input falls into batches, provided that batches follow one another in time.

State lives in the RocksDB store (``with_state_store``), which is what keeps it off the heap; an initial state,
say from a checkpoint, is a grouped frame of (key, ts, attrs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "key string, ts long, op string, name string, old string, value string"
CHANGE = Row("key", "ts", "op", "name", "old", "value")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _json(attrs: dict) -> str:
    return json.dumps(attrs, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class LiveObjects(StatefulProcessor):
    """Rows (key, ts, seq, op, name, value, attrs) in, changes out.

    whole: rows are whole objects (attrs) as their sender states them again and again, and what differs from the object
    before is the change, names in ``ignore`` apart.  lifetime: seconds that a key may be silent.
    """

    def __init__(self, lifetime: int | None = None, whole: bool = False, ignore: tuple[str, ...] = ()):
        self.lifetime, self.whole, self.ignore = lifetime, whole, ignore

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attrs = handle.getMapState("attrs", "name string", "value string")
        self.life = handle.getValueState("life", "alive boolean, ts long")

    def _old(self, stored: dict, name: str) -> str | None:
        """A value of the store, read once a call; stored has what was read since."""
        if name not in stored:
            stored[name] = self.attrs.getValue((name,))[0] if self.attrs.containsKey((name,)) else None
        return stored[name]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted((tuple(r)[1:7] for r in rows), key=itemgetter(0, 1))
        began, last = self.life.get() if self.life.exists() else (False, None)
        # what the store has, as far as it was read, and what the rows make of it; every call to the store is a way to the JVM and back
        stored: dict[str, str | None] = {n[0]: v[0] for n, v in self.attrs.iterator()} if self.whole and began else {}
        held = dict(stored)
        alive, heard, out = began, last, []
        dropped = not began

        def begin(ts: int, attrs: dict) -> None:
            held.update(attrs)
            out.append((ts, "C", None, None, _json(attrs)))

        def end(ts: int, op: str) -> None:
            nonlocal held, dropped
            held, dropped = {}, True
            out.append((ts, op, None, None, None))

        def put(ts: int, name: str, value: str | None) -> None:
            old = held[name] if name in held else None if dropped else self._old(stored, name)
            if old != value:
                held[name] = value
                out.append((ts, "R" if value is None else "U", name, old, value))

        for ts, _, op, name, value, body in events:
            attrs = {k: v for k, v in dict(body).items() if v is not None} if body is not None else {}
            if alive and self.lifetime is not None and heard is not None and ts - heard > self.lifetime:
                end(heard + self.lifetime, "X")
                alive = False
            heard = ts if heard is None else max(heard, ts)
            if self.whole:
                if not alive:
                    begin(ts, attrs)
                    alive = True
                    continue
                for n in sorted({n for n, v in held.items() if v is not None} | attrs.keys()):
                    if n not in self.ignore:
                        put(ts, n, attrs.get(n))
                    elif n in attrs:
                        held[n] = attrs[n]
            elif op == "C":
                if not alive:
                    begin(ts, attrs)
                    alive = True
            elif alive:
                if op == "D":
                    end(ts, "D")
                    alive = False
                elif op == "M":
                    for n in sorted(attrs):
                        put(ts, n, attrs[n])
                elif op in ("U", "R"):
                    put(ts, name, value if op == "U" else None)
        if began and dropped:
            self.attrs.clear()
        before = {} if dropped else stored
        for name, value in held.items():
            if value != before.get(name):
                if value is None:
                    self.attrs.removeKey((name,))
                else:
                    self.attrs.updateValue((name,), (value,))
        if (alive, heard) != (began, last):
            self.life.update((alive, heard))
            self._wait(last if began else None, heard if alive else None)
        for ts, op, name, old, value in out:
            yield CHANGE(key[0], ts, op, name, old, value)

    def _wait(self, before: int | None, heard: int | None) -> None:
        """The one timer of a key that is alive, for when its lifetime is over: in place of the one set when it was heard ``before``."""
        if self.lifetime is None or before == heard:
            return
        if before is not None:
            self.handle.deleteTimer((before + self.lifetime) * 1000)
        if heard is not None:
            self.handle.registerTimer((heard + self.lifetime) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        alive, last = self.life.get() if self.life.exists() else (False, None)
        if alive and last + self.lifetime <= expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.attrs.clear()
            self.life.clear()
            yield CHANGE(key[0], last + self.lifetime, "X", None, None, None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # one row; by the interface of rows Spark hands it as it is
        for _, ts, attrs in [initialState] if isinstance(initialState, Row) else initialState:
            for name, value in dict(attrs).items():
                if value is not None:
                    self.attrs.updateValue((name,), (value,))
            self.life.update((True, ts))
            self._wait(None, ts)

    def close(self) -> None:
        pass


def changes(events: DataFrame, lifetime: int | None = None, whole: bool = False, ignore: tuple[str, ...] = (), began: DataFrame | None = None) -> DataFrame:
    """The changes of a stream of events; with a lifetime it needs a watermark on its column ``time``.

    began: the objects (key, ts, attrs) that are alive before the stream begins.
    """
    rows = events.select("key", "ts", "seq", "op", "name", "value", "attrs", *(["time"] if "time" in events.columns else []))
    began = began.select("key", "ts", "attrs").groupBy("key") if began is not None else None
    return rows.groupBy("key").transformWithState(LiveObjects(lifetime, whole, ignore), CHANGES, "update", "None" if lifetime is None else "EventTime", began)
