"""History queries against a plain replay of random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.sources import eventlog

SCHEMA = eventlog.EVENT


def random_log(seed, n=40):
    rng, ts, rows = random.Random(seed), 100, []
    for i in range(n):
        ts += rng.choice([0, 0, 1, 3, 9])
        op, key = rng.choice("CCMMMUURD"), rng.choice("ab")
        name = rng.choice("xyz") if op in "UR" else None
        attrs = {k: str(rng.randint(0, 4)) for k in rng.sample("xyz", rng.randint(0, 3))} if op in "CM" else None
        rows.append(("d", i, ts, op, key, name, str(rng.randint(0, 9)) if op == "U" else None, attrs))
    return rows


def replay(rows, until, keep=lambda a: True):
    table = {}
    for _, _, ts, op, key, name, value, attrs in rows:
        if not until(ts):
            break
        if op == "C" and key not in table and keep(attrs):
            table[key] = dict(attrs)
        elif key in table:
            if op == "M":
                table[key] |= attrs
            elif op == "U":
                table[key][name] = value
            elif op == "R":
                table[key].pop(name, None)
            elif op == "D":
                del table[key]
    return table


@pytest.fixture(scope="module")
def logs(spark):
    return [(rows, spark.createDataFrame(rows, SCHEMA)) for rows in map(random_log, range(6))]


def test_snapshot_is_replay(logs):
    for rows, df in logs:
        at = rows[25][2]
        got = {r.key: r.attrs for r in history.snapshot(df, at).collect()}
        assert got == replay(rows, lambda ts: ts <= at)
        kept = {r.key: r.attrs for r in history.snapshot(df, at, static_filter=F.col("attrs")["x"] == "1").collect()}
        assert kept == replay(rows, lambda ts: ts <= at, lambda a: a.get("x") == "1")


def test_states_at_steps_are_replays(spark, logs):
    for rows, df in logs:
        steps = sorted({rows[i][2] + d for i in (5, 15, 30) for d in (0, 1)})
        got = {(r.ts, r.key): (r.x, r.y) for r in history.states_at(df, spark.createDataFrame([(s,) for s in steps], "ts long"), ["x", "y"]).collect()}
        want = {(s, k): (a.get("x"), a.get("y")) for s in steps for k, a in replay(rows, lambda ts: ts < s).items()}
        assert got == want


def test_spans_cover_snapshots(logs):
    rows, df = logs[0]
    spans = history.attribute_spans(df).collect()
    for at in sorted({r[2] for r in rows}):
        got = {(s.key, s.name): s.value for s in spans if s.from_ts <= at and (s.to_ts is None or at < s.to_ts)}
        want = {(k, n): v for k, a in replay(rows, lambda ts: ts <= at).items() for n, v in a.items()}
        assert got == want


def test_firing_markers_follow_the_step_rule(spark):
    rng = random.Random(2)
    for every in (1, 5, 13):
        ts = sorted(rng.randint(0, 200) for _ in range(60))
        start, stop, due, want = 20, 180, 20, []
        for t in ts:
            if start <= t <= stop and t >= due:
                want.append(t)
                due += every
        got = [r.ts for r in history.firing_markers(spark.createDataFrame([(t,) for t in ts], "ts long"), start, every, stop).orderBy("ts").collect()]
        # equal markers are one another's copies, so only the times matter
        assert got == want


def test_log_text_round_trip(spark, tmp_path):
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020/5.log").write_text('T 100\nC a {"x":1,"y":"s"}\nt 5\nM a {"x":2}\nR a yU a z 7\n\nbad line\nD b\nt 2\nD a\n')
    events = eventlog.parse(eventlog.read_lines(spark, str(tmp_path)))
    rows = [(r.ts, r.op, r.key, r.name, r.value, r.attrs) for r in events.where("op NOT IN ('T', 't')").orderBy("seq").collect()]
    assert rows == [
        (100, "C", "a", None, None, {"x": "1", "y": "s"}), (105, "M", "a", None, None, {"x": "2"}), (105, "R", "a", "y", None, None),
        (105, "U", "a", "z", "7", None), (105, "D", "b", None, None, None), (107, "D", "a", None, None, None),
    ]
    eventlog.write_log(events, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "T 100" and lines.count("T 105") == 1 and lines[-1] == "D a" and len(lines) == 9


def test_checkpoints(spark, tmp_path):
    (tmp_path / "a.ckpt").write_text('{"k1":{"x":1},"k2":{}}')
    got = {r.key: r.attrs for r in history.snapshot(eventlog.read_checkpoint(spark, str(tmp_path / "a.ckpt")), 10).collect()}
    assert got == {"k1": {"x": "1"}, "k2": {}}
    (tmp_path / "old.txt").write_text("key a\nname one two\n\nkey b\nn 3\n")
    assert {r.key: r.attrs.get("name") for r in eventlog.name_value_records(spark, str(tmp_path / "old.txt")).collect()} == {"a": "one two", "b": None}


def test_change_capture_ignores_volatile_names(spark):
    o = spark.createDataFrame([("a", 1, {"x": "1", "uptime": "5"}), ("a", 2, {"x": "1", "uptime": "6"}), ("a", 3, {"y": "2", "uptime": "7"})], "key string, ts long, attrs map<string,string>")
    got = sorted((r.ts, r.op, r.name or "", r.attrs) for r in history.change_capture(o).collect())
    assert got == [(1, "C", "", {"x": "1", "uptime": "5"}), (3, "M", "", {"y": "2"}), (3, "R", "x", None)]


def test_expiry_uses_the_smaller_lifetime(spark):
    h = spark.createDataFrame([("a", 0, None), ("a", 100, 30), ("a", 140, None), ("b", 0, 500)], "key string, ts long, own long")
    got = {(r.key, r.last_heard, r.expired_at) for r in history.expiries(h, 60, "own", until=1000).collect()}
    assert got == {("a", 0, 60), ("a", 100, 130), ("a", 140, 200), ("b", 0, 60)}


def test_firing_markers_over_many_spans(spark):
    rng = random.Random(6)
    for every in (1, 3, 10):
        marks = sorted({rng.randint(0, 120_000) for _ in range(300)} | set(range(50_000, 50_040)))
        due, want = 5, []
        for ts in marks:
            if ts >= due:
                want.append(ts)
                due += every
        got = sorted(r.ts for r in history.firing_markers(spark.createDataFrame([(x,) for x in marks], "ts long"), 5, every).collect())
        assert got == want


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "2021").mkdir()
    rng = random.Random(5)
    text = [f"T {100 + i}" if i % 7 == 0 else "" if i % 11 == 0 else "x" * rng.randint(1, 30) + str(i) for i in range(2000)]
    (tmp_path / "2021/9.log").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = eventlog.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "2021/9.log")).rdd.getNumPartitions() > 3
        got = [r.line for r in rows.orderBy("line_no").collect()]
        assert got == [x for x in text if x] and rows.select("line_no").distinct().count() == len(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_spans_and_older_lines(spark):
    log = ["T 100", 'C a {"x":1}', "t 5", "D a", 't 10', 'C b {"y":2}', "U b y 3"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(log)], "part string, line_no long, line string")
    assert [r.line for r in eventlog.within(lines, 103, 200).orderBy("line_no").collect()] == ["T 105", "D a", "T 115", 'C b {"y":2}', "U b y 3"]
    old = ["T 100", "C a", "name one two", "load 3", "load 4", "", "D a", "C b", 'C c {"z":1}', "R c z"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(old)], "part string, line_no long, line string")
    assert [r.line for r in eventlog.upgraded(lines).orderBy("line_no").collect()] == ["T 100", 'C a {"load":"4","name":"one two"}', "D a", "C b {}", 'C c {"z":1}', "R c z"]


def test_change_capture_uses_all_shuffle_partitions(spark):
    """Objects that are small when shuffled stay in as many tasks as there are shuffle partitions, and are read once."""
    o = spark.range(400).select((F.col("id") % 40).alias("key"), F.col("id").alias("ts"), F.create_map(F.lit("a"), (F.col("id") % 3).cast("string")).alias("attrs"))
    got = history.change_capture(o)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.where("op = 'C'").count() == 40 and got.where("op = 'M'").count() == 360
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
