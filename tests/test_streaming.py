import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.streaming import keyed_state
from tidemark.streaming.live_changes import LiveObjects
from test_history import random_log, replay

SCHEMA = "part string, seq long, ts long, op string, key string, name string, value string, attrs map<string,string>"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_live_state_is_the_replay(spark, tmp_path):
    rows = [(*r[:2], 1000 + i, *r[3:]) for i, r in enumerate(random_log(11, 60))]
    for i in range(3):  # three batches, in order
        spark.createDataFrame(rows[20 * i : 20 * i + 20], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(keyed_state.live_objects(events), "live", "update")
    finals = spark.table("live").groupBy("key").agg(F.max_by(F.struct("alive", "attrs"), "ts").alias("s")).collect()
    assert {r.key: json.loads(r.s.attrs) for r in finals if r.s.alive} == replay(rows, lambda ts: True)


def test_a_key_in_several_arrow_batches_is_taken_in_order(spark, tmp_path):
    n, size = 50, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [("d", i, 1000 + i, "C" if i == 0 else "U", "a", "n", str(i), {} if i == 0 else None) for i in reversed(range(n))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        run(keyed_state.live_objects(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))), "arrow_batches", "update")
    finally:
        spark.conf.set(size, before)
    (row,) = spark.table("arrow_batches").collect()
    assert row.alive and json.loads(row.attrs) == {"n": str(n - 1)}


def test_windows_equal_batch(spark, tmp_path):
    e = spark.range(200).select((F.lit(1_600_000_000) + F.col("id") * 37).cast("timestamp").alias("time"), (F.col("id") % 3).alias("k"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    run(keyed_state.stepped(stream, "time", "10 minutes", "1 hour", F.count(F.lit(1)).alias("n")), "steps", "complete")
    got = {(r.window.start, r.n) for r in spark.table("steps").collect()}
    want = {(r.window.start, r.n) for r in e.groupBy(F.window("time", "10 minutes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_expiry_by_event_time(spark, tmp_path):
    rows = [("d", 0, 100, "C", "a", None, None, {"x": "1"}), ("d", 1, 200, "C", "b", None, None, {"x": "2"}), ("d", 2, 5000, "C", "c", None, None, {}), ("d", 3, 9000, "C", "d", None, None, {})]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", "1 second")
    run(keyed_state.live_objects(events, lifetime=60), "expiring", "update")
    gone = {(r.key, r.ts) for r in spark.table("expiring").where("NOT alive").collect()}
    assert {("a", 160), ("b", 260)} <= gone


def gathered(spark, tmp_path, rows, cuts, **kw):
    """All changes of rows that come in the batches which cuts divide."""
    from tidemark.plans.live import to_the_end
    from tidemark.streaming.live_changes import changes, with_state_store

    folder = str(tmp_path / f"in{len(cuts)}")
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").json(folder)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    if kw.get("lifetime"):
        events = events.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", "1 second")
    with with_state_store(spark):
        out = to_the_end(changes(events, **kw), "update").collect()
    return sorted(((r.key, r.ts, r.op, r.name, r.old, r.value) for r in out), key=repr), out


def test_live_changes_rebuild_the_replay(spark, tmp_path):
    rows = [(*r[:2], 1000 + i, *r[3:]) for i, r in enumerate(random_log(21, 70))]
    whole, out = gathered(spark, tmp_path, rows, [])
    parts, _ = gathered(spark, tmp_path, rows, [20, 45])
    assert whole == parts
    held = {}
    for r in sorted(out, key=lambda r: r.ts):
        if r.op == "C":
            held[r.key] = json.loads(r.value)
        elif r.op == "D":
            del held[r.key]
        elif r.op == "U":
            assert held[r.key].get(r.name) == r.old
            held[r.key][r.name] = r.value
        else:
            assert held[r.key].pop(r.name) == r.old
    assert held == replay(rows, lambda ts: True)


def test_live_changes_of_whole_objects_and_silence(spark, tmp_path):
    states = [("a", 10, {"x": "1", "up": "1"}), ("b", 12, {"x": "5"}), ("a", 20, {"x": "1", "up": "2"}), ("a", 30, {"y": "2", "up": "3"}), ("b", 200, {"x": "5"}), ("c", 400, {}), ("c", 401, {"z": "1"})]
    rows = [("d", i, ts, None, k, None, None, attrs) for i, (k, ts, attrs) in enumerate(states)]
    want = [
        ("a", 10, "C", None, None, '{"up":"1","x":"1"}'), ("a", 30, "R", "x", "1", None), ("a", 30, "U", "y", None, "2"), ("a", 90, "X", None, None, None),
        ("b", 12, "C", None, None, '{"x":"5"}'), ("b", 72, "X", None, None, None), ("b", 200, "C", None, None, '{"x":"5"}'), ("b", 260, "X", None, None, None),
        ("c", 400, "C", None, None, "{}"), ("c", 401, "U", "z", None, "1"),
    ]
    for cuts in ([], [2, 4, 5]):
        got, _ = gathered(spark, tmp_path, rows, cuts, lifetime=60, whole=True, ignore=("up",))
        assert got == sorted(want, key=repr)


def test_live_changes_begin_with_a_checkpoint(spark, tmp_path):
    began = spark.createDataFrame([("a", 5, {"x": "1"}), ("q", 5, {"x": "9"})], "key string, ts long, attrs map<string,string>")
    rows = [("d", 0, 10, "U", "a", "x", "2", None), ("d", 1, 11, "C", "a", None, None, {"x": "3"}), ("d", 2, 12, "U", "b", "x", "2", None), ("d", 3, 13, "D", "a", None, None, None)]
    got, _ = gathered(spark, tmp_path, rows, [1], began=began)
    assert got == [("a", 10, "U", "x", "1", "2"), ("a", 13, "D", None, None, None)]


def test_tail_of_growing_files(spark, tmp_path):
    """Files grow between two runs, in the middle of a line and of a stretch of relative times: each event once, timed as the batch reader does."""
    import random

    from tidemark.plans.live import to_the_end
    from tidemark.sources import eventlog, log_tail

    rng, text = random.Random(3), {}
    for day in (9, 10, 100):
        lines = [f"T {1000 * day}"]
        for i in range(120):
            lines.append(rng.choice([f"t {rng.randint(1, 9)}", f"U k{i} n é{i}", f'C k{i} {{"x":{i},"y":"ü"}}', f"R k{i} aD k{i}", "not a line", f"T {1000 * day + 8 * i}"]))
        text[day] = ("\n".join(lines) + "\n").encode()
    root = tmp_path / "logs"
    (root / "2024").mkdir(parents=True)
    spark.dataSource.register(log_tail.LogTail)
    stream = log_tail.timed(spark.readStream.format("log_tail").option("path", f"file://{root}").option("range", 64).load())
    for done in ({9: 700, 10: 1}, {9: 701, 10: 900}, {9: 10**6, 10: 10**6, 100: 10**6}):
        for day, n in done.items():
            (root / f"2024/{day}.log").write_bytes(text[day][:n])
        out = to_the_end(stream, "append", f"file://{tmp_path}/stream")
    columns = ["part", "ts", "op", "key", "name", "value", "attrs"]
    order = lambda df: [tuple(r[c] for c in columns) for r in df.orderBy("part", "seq").collect()]
    got, want = order(out), order(eventlog.parse(eventlog.read_lines(spark, str(root))))
    assert got == want and len(got) > 250


class _Counted:
    """A key's state in memory, counting the calls to it."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, [], 0

    def __getattr__(self, name):
        ways = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "clear": lambda: self.map.clear(), "iterator": lambda: iter([((k,), v) for k, v in self.map.items()]), "containsKey": lambda k: k[0] in self.map,
            "getValue": lambda k: self.map[k[0]], "updateValue": lambda k, v: self.map.update({k[0]: v}), "removeKey": lambda k: self.map.pop(k[0]),
            "registerTimer": lambda t: self.timers.append(t), "deleteTimer": lambda t: self.timers.remove(t), "listTimers": lambda: iter([(t,) for t in self.timers]),
        }

        def call(*args):
            self.calls += 1
            return ways[name](*args)

        return call


def test_a_batch_of_a_key_makes_few_calls_to_the_store():
    p, s, life = LiveObjects(lifetime=60, whole=True, ignore=("uptime",)), _Counted(), _Counted()
    p.handle, p.attrs, p.life = s, s, life
    beat = lambda i, kind: Row(key="a", ts=i, seq=i, op=None, name=None, value=None, attrs={"type": kind, "uptime": str(i)})
    got = list(p.handleInputRows(("a",), iter([beat(i, "x") for i in range(50)]), None))
    assert [(r.ts, r.op) for r in got] == [(0, "C")] and s.timers == [109_000]
    s.calls = life.calls = 0
    got = list(p.handleInputRows(("a",), iter([beat(i, "y" if i > 70 else "x") for i in reversed(range(50, 100))]), None))
    assert [(r.ts, r.op, r.name, r.old, r.value) for r in got] == [(71, "U", "type", "x", "y")]
    assert s.map == {"type": ("y",), "uptime": ("99",)} and s.timers == [159_000]
    assert s.calls + life.calls <= 8


def test_short_ranges_share_a_task(tmp_path):
    from tidemark.sources import log_tail

    (tmp_path / "2024").mkdir()
    lines = [f"U k a {i}" + "x" * (i % 90) for i in range(500)]
    (tmp_path / "2024" / "9.log").write_text("\n".join(lines) + "\n")
    r = log_tail.TailReader(f"file://{tmp_path}", 64)
    parts = r.partitions({}, r.latestOffset())
    rows = [x for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert len(parts) == 1 and [x["line"] for x in rows] == lines
    starts, at = [], 0
    for line in lines:
        starts.append(at * 2 + 1)
        at += len(line) + 1
    assert [x["line_no"] for x in rows] == starts
