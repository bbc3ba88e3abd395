"""Stores of day files: numeric day order, spans, checkpoints in every form, running values over small spans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, spans
from tidemark.sources import eventlog
from test_history import SCHEMA, random_log, replay

ORIGIN, DAY = 1704067200, 86400


def day_files(root, days, year=2024):
    (root / str(year)).mkdir(exist_ok=True)
    for d in days:
        lines = [f"T {ORIGIN + d * DAY + 5}", *(['C a {"load":1}'] if d == days[0] else [f'U a load {d}']), "t 60", f"U a seen {d}"]
        (root / f"{year}/{d}.log").write_text("\n".join(lines) + "\n")


def test_day_ten_follows_day_nine(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024/9.log").write_text('T 100\nC a {"load":1}\nU a load 2\n')
    (tmp_path / "2024/10.log").write_text("T 200\nU a load 3\n")
    events = eventlog.parse(eventlog.read_lines(spark, str(tmp_path)))
    assert [r.attrs["load"] for r in history.snapshot(events, 300).collect()] == ["3"]
    assert [r.value for r in history.attribute_spans(events).orderBy("from_ts").collect() if r.name == "load"] == ["2", "3"]


def test_a_span_reads_its_days_alone(spark, tmp_path):
    day_files(tmp_path, [*range(8, 13), *range(97, 103)])
    (tmp_path / "2024/98.ckpt").write_text('{\n"a":\n{"load":97,"name":"x, y"},\n"b":\n{}}\n')
    events = eventlog.read_store(spark, str(tmp_path), ORIGIN + 98 * DAY + 3, ORIGIN + 101 * DAY + 70)
    read = {x.rsplit("/", 1)[1] for x in events.inputFiles()}
    assert read == {"98.log", "99.log", "100.log", "101.log", "98.ckpt"}
    got = {r.key: r.attrs for r in history.snapshot(events, ORIGIN + 101 * DAY + 10).collect()}
    assert got == {"a": {"load": "101", "name": "x, y", "seen": "100"}, "b": {}}
    steps = spark.createDataFrame([(ORIGIN + 99 * DAY,), (ORIGIN + 100 * DAY + 30,)], "ts long")
    assert sorted((r.ts, r.key, r.load) for r in history.states_at(events, steps, ["load"]).collect()) == [
        (ORIGIN + 99 * DAY, "a", "98"), (ORIGIN + 99 * DAY, "b", None), (ORIGIN + 100 * DAY + 30, "a", "100"), (ORIGIN + 100 * DAY + 30, "b", None),
    ]


def test_missing_days_and_checkpoints(spark, tmp_path):
    day_files(tmp_path, [8, 14])
    (tmp_path / "2024/8.ckpt").write_text("{}")
    assert eventlog.read_store(spark, str(tmp_path), ORIGIN + 8 * DAY, ORIGIN + 14 * DAY + 100).where("op = 'U'").count() == 3
    with pytest.raises(FileNotFoundError, match="6 of 8 days"):
        eventlog.read_store(spark, str(tmp_path), ORIGIN + 8 * DAY, ORIGIN + 15 * DAY)
    with pytest.raises(FileNotFoundError, match="14.ckpt"):
        eventlog.read_store(spark, str(tmp_path), ORIGIN + 14 * DAY, ORIGIN + 14 * DAY)


def test_a_span_crosses_the_year(spark, tmp_path):
    day_files(tmp_path, [364, 365])  # 2024 has 366 days
    (tmp_path / "2025").mkdir()
    (tmp_path / "2025/0.log").write_text(f"T {ORIGIN + 366 * DAY}\nU a load new\n")
    events = eventlog.read_store(spark, str(tmp_path), ORIGIN + 364 * DAY, ORIGIN + 366 * DAY, checkpoint=False)
    assert [r.attrs["load"] for r in history.snapshot(events, ORIGIN + 366 * DAY).collect()] == ["new"]


@pytest.mark.parametrize("text", [
    '{"k1":{"x":1},"k2":{}}',
    '{\n"k1":\n{"x":1},\n"k2":\n{}}\n',
    '{\n"k2":\n{},\n"k1":\n{"x":1}\n}\n',
    '{"key":"k1","attrs":{"x":"1"}}\n{"key":"k2","attrs":{}}\n',
])
def test_checkpoint_forms(spark, tmp_path, text):
    (tmp_path / "a.ckpt").write_text(text)
    assert {r.key: r.attrs for r in eventlog.read_checkpoint(spark, str(tmp_path / "a.ckpt")).collect()} == {"k1": {"x": "1"}, "k2": {}}


def test_checkpoints_that_are_empty_old_or_split(spark, tmp_path):
    for text in ("", "{}", "{\n}\n"):
        (tmp_path / "e.ckpt").write_text(text)
        assert eventlog.read_checkpoint(spark, str(tmp_path / "e.ckpt")).count() == 0
    (tmp_path / "old.ckpt").write_text("key a\nname one two\n\nkey b\nn 3\n")
    assert {r.key for r in eventlog.read_checkpoint(spark, str(tmp_path / "old.ckpt")).collect()} == {"a", "b"}
    objects = {f"key {i}": {"text": f'line\n"quoted", {i}'} for i in range(300)}
    (tmp_path / "big.ckpt").write_text("{\n" + ",\n".join(f"{json.dumps(k)}:\n{json.dumps(v)}" for k, v in objects.items()) + "}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert {r.key: r.attrs for r in eventlog.read_checkpoint(spark, str(tmp_path / "big.ckpt")).collect()} == objects
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_checkpoint_reads_back(spark, tmp_path):
    objects = spark.createDataFrame([("a", {"x": "1"}), ("b", {}), ("c", {'q"': "two\nlines"})], "key string, attrs map<string,string>")
    eventlog.write_checkpoint(objects, str(tmp_path / "c.ckpt"))
    assert {r.key: r.attrs for r in eventlog.read_checkpoint(spark, str(tmp_path / "c.ckpt")).collect()} == {"a": {"x": "1"}, "b": {}, "c": {'q"': "two\nlines"}}


def test_store_round_trip(spark, tmp_path):
    rows = [(*r[:2], ORIGIN + 7 * DAY + r[2] * 2000, *r[3:]) for r in random_log(3, 150)]
    eventlog.write_store(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "s"))
    start, stop = ORIGIN + 7 * DAY, rows[-1][2]
    back = eventlog.read_store(spark, str(tmp_path / "s"), start, stop, checkpoint=False)
    got = [(r.ts, r.op, r.key, r.name, r.value, r.attrs) for r in back.where("op NOT IN ('T', 't')").orderBy("part", "seq").collect()]
    assert got == [r[2:] for r in rows]
    at = rows[90][2]
    assert {r.key: r.attrs for r in history.snapshot(back, at).collect()} == replay(rows, lambda ts: ts <= at)


@pytest.fixture
def small_spans(monkeypatch):
    monkeypatch.setattr(eventlog, "SPAN", 5)


def test_times_go_from_span_to_span(spark, small_spans):
    rng, lines, now, want = random.Random(8), [], 0, []
    for i in range(200):
        kind = rng.random()
        if kind < 0.05 or not i:
            now = 1000 + 10 * i
            lines.append(f"T {now}")
        elif kind < 0.4:
            step = rng.randint(1, 5)
            now += step
            lines.append(f"t {step}")
        else:
            lines.append(f"D k{i}")
            want.append((now, f"k{i}"))
    df = spark.createDataFrame([("p", 3 * i, x) for i, x in enumerate(lines)], "part string, line_no long, line string")
    events = eventlog.parse(df)
    assert [(r.ts, r.key) for r in events.where("op = 'D'").orderBy("seq").collect()] == want
    again = eventlog.parse(eventlog.to_lines(events).select("part", (F.col("seq") * 2 + F.when(F.col("line").startswith("T "), 0).otherwise(1)).alias("line_no"), "line"))
    assert [(r.ts, r.key) for r in again.where("op = 'D'").orderBy("seq").collect()] == want
    inside = eventlog.parse(eventlog.within(df, want[30][0], want[80][0])).where("op = 'D'").orderBy("seq").collect()
    assert [(r.ts, r.key) for r in inside] == [x for x in want if want[30][0] <= x[0] <= want[80][0]]


def test_running_values_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, -3])) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    for how, fold, nothing in (("sum", sum, 0), ("max", max, None), ("min", min, None), ("last", lambda x: x[-1], None)):
        for before in (False, True):
            out = spans.running(df, ["k"], F.floor(F.col("at") / 10), ["at"], F.col("v"), "r", how, before).collect()
            assert len(out) == len(rows)
            for r in out:
                own = [v for k, i, v in rows if k == r.k and (i < r.at or i == r.at and not before) and v is not None]
                assert r.r == (fold(own) if own else nothing)
    out = spans.previous(df, [], F.floor(F.col("at") / 7), ["at"], ["v"]).orderBy("at").collect()
    assert [r.v_before for r in out] == [None, *[v for _, _, v in rows[:-1]]]
    assert [r.rank for r in spans.numbered(df, F.floor(F.col("at") / 7), ["at"]).orderBy("at").collect()] == list(range(1, 151))


def test_slots_follow_the_greedy_rule(spark):
    import heapq

    from tidemark.operators import timeseries

    rng, rows = random.Random(9), []
    for w in ("idle", "busy", None):
        s = 0
        for _ in range(150):
            s += rng.choice([0, 1, 2, 30]) if w == "idle" else rng.choice([0, 1])
            rows.append((w, s, s + rng.randint(1, 12), rng.random()))
    rows.append(("idle", None, 3, 0.5))
    df = spark.createDataFrame(rows, "worker string, begin long, finish long, x double").repartition(3)
    got = {}
    for r in timeseries.slots(df, "worker", "begin", "finish", span=16, stretches=3).collect():
        got.setdefault(r.worker, []).append((r.begin, r.finish, r.slot))
    assert [x[2] for x in got["idle"] if x[0] is None] == [None]
    for w in ("idle", "busy", None):
        free, busy, used, want = [], [], 0, []
        for s, e in sorted((s, e) for k, s, e, _ in rows if k == w and s is not None):
            while busy and busy[0][0] <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            slot = heapq.heappop(free) if free else (used := used + 1)
            heapq.heappush(busy, (e, slot))
            want.append((s, e, slot))
        assert sorted(x for x in got[w] if x[0] is not None) == sorted(want)
