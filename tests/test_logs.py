from pyspark.sql import functions as F

from tidemark.operators import catalog, dataset, graph, matrix, stats, timeseries
from tidemark.operators.reductions import Reduce, overall
from tidemark.sources import logs, sinks

LOG = """# time manager subject target event arg
1000000 m1 MANAGER m1 START 0
2000000 m1 WORKER w1 CONNECTION host:1
3000000 m1 TASK 1 READY default FIRST_RESOURCES {}
4000000 m1 TASK 1 RUNNING w1 FIRST_RESOURCES {}
5000000 m1 WORKER w1 TRANSFER INPUT FILE data 2.5 0.5 1
6000000 m1 TASK 1 READY default RETRY {}
7000000 m1 TASK 1 RUNNING w1 x
8000000 m1 TASK 1 WAITING_RETRIEVAL w1
9000000 m1 TASK 1 RETRIEVED SUCCESS 0
9500000 m1 TASK 1 DONE SUCCESS 0
9700000 m1 MANAGER m1 END
"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n") if x], "value string")


def test_transaction_log(spark):
    log = logs.transactions(lines(spark, LOG))
    t = {r.attempt: r for r in logs.tasks(log).collect()}
    assert t[1].running == 3.0 and t[1].done is None and t[2].ready == 5.0 and t[2].done == 8.5 and t[2].result == "SUCCESS" and t[2].worker == "w1"
    w = logs.workers(log).first()
    assert (w.connected, w.disconnected) == (1.0, 8.7)
    x = logs.transfer_totals(logs.transfers(log)).first()
    assert (x.direction, x.n, x.mb, x.mean_seconds) == ("INPUT", 1, 2.5, 0.5)
    assert [r[0] for r in spark.range(12).select(logs.task_range(F.col("id"), "1-3,9")).collect()] == [i in (1, 2, 3, 9) for i in range(12)]


def test_a_managers_lines_never_meet_in_one_task(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        log = logs.transactions(lines(spark, LOG))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (log, logs.tasks(log), logs.workers(log))]
    finally:
        spark.conf.set(threshold, before)
    assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    # more managers than are sent as they are: those of many lines and the others
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), ("c", 2)], "manager string, us long")
    managers = rows.groupBy("manager").agg(F.max("us").alias("last"), F.count(F.lit(1)).alias("_n"))
    want = sorted((r.manager, r.us, {"a": 8, "b": 1, "c": 2}[r.manager]) for r in rows.collect())
    for few, many in ((10, 3), (1, 3), (1, 0), (1, 100)):
        got = logs.with_managers(rows, managers, few, many)
        assert got.columns == ["manager", "us", "last"] and sorted(map(tuple, got.collect())) == want


def test_levels_send_no_table_to_the_driver(spark, monkeypatch):
    plans, write = [], graph.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "checkpointed", noted)
    nodes = spark.range(1, 50).withColumnRenamed("id", "node")
    needed = nodes.where("node > 1").select(F.floor(F.col("node") / 2).alias("file"), "node")
    got = {r.node: r.level for r in graph.levels(nodes, graph.edges(nodes.select(F.col("node").alias("file"), "node"), needed)).collect()}
    assert got == {n: n.bit_length() - 1 for n in range(1, 50)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_performance_and_graph_logs(spark, tmp_path):
    (tmp_path / "p").write_text("# timestamp tasks bytes\n1000 1 5\n2000 4 9\n")
    p = logs.performance(spark, str(tmp_path / "p"))
    assert p.columns == ["timestamp", "tasks", "bytes"]
    d = timeseries.deltas(p, [], ["timestamp"], "bytes").orderBy("timestamp").collect()
    assert [r.bytes_delta for r in d] == [None, 4.0]
    nodes, files, edges = logs.task_graph(lines(spark, 'TASK T1 "a b" INPUTS f1 f2 OUTPUTS f3\nTASK T2 "c" INPUTS f3 OUTPUTS\nFILE f1 "src" 10\nFILE f3 "" 7'))
    assert {tuple(r) for r in edges.collect()} == {("T1", "f1", "IN"), ("T1", "f2", "IN"), ("T1", "f3", "OUT"), ("T2", "f3", "IN")}
    assert nodes.count() == 2 and files.agg(F.sum("size")).first()[0] == 17
    dot = [r.line for r in graph.to_dot(spark.createDataFrame([("T1", "T2")], "parent string, child string")).collect()]
    assert dot == ["digraph {", '"T1" -> "T2";', "}"]


def test_workflow_logs(spark, tmp_path):
    runs = logs.workflow_runs(lines(spark, "# STARTED\n1 0 1 10 1 1 0 0 0 2\n2 0 3 10 1 0 0 1 0 2\n3 0 2 11 1 0 1 0 0 2\n4 1 4 12 0 0 1 0 1 2"))
    assert tuple(logs.workflow_summary(runs).first()) == (2, 1, 0, 1, 1)
    (tmp_path / "w.json").write_text('{"rules":[{"command":"c","inputs":["a"],"outputs":["b"]},{"command":"d","inputs":["b"],"outputs":["e"],"category":"big"}]}')
    rules, files = logs.workflow_rules(spark, str(tmp_path / "w.json"))
    assert [r.category for r in rules.orderBy("node").collect()] == ["default", "big"] and files.count() == 4


def test_debug_and_trace_logs(spark):
    d = logs.debug_lines(lines(spark, "2020/01/02 03:04:05.50 prog[12] wq: worker joined: ok\nnoise")).collect()
    assert len(d) == 1 and d[0].pid == 12 and d[0].message == "worker joined: ok" and d[0].stream == "wq"
    c = logs.syscalls(lines(spark, '1 openat(3, "/usr/lib/x", O_RDONLY) = 4\n1 read(4</usr/lib/x>, "..", 9) = 9\n1 write(5</tmp/o/p>, "a", 4) = 4\n1 stat("/no", 0) = -1\n1 exit(0) = ?'))
    top = logs.directory_totals(c).collect()
    assert (top[0].directory, top[0].read_bytes, top[1].written_bytes) == ("/usr/lib", 9, 4)


def test_resource_summaries(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"category":"c","taskid":"1","memory":[512,"MB"],"cores":2,"disk":-1}\n')
    r = logs.resource_summaries(spark, str(tmp_path)).first()
    assert (r.memory, r.cores, r.disk, r.gpus) == (512.0, 2.0, None, None)


def test_sinks(spark, tmp_path):
    m = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit('x"'))
    r = spark.range(1).select(sinks.canonical_json(m), sinks.name_value(m), sinks.environment(m)).first()
    assert tuple(r) == ('{"a":"x\\"","b":"2"}', 'a x"\nb 2', 'export a="x\\""\nexport b="2"')
    sinks.split_stream(spark.range(10).select(F.col("id").cast("string").alias("value")), str(tmp_path / "s"), 3)
    sinks.split_stream(spark.range(4).select(F.col("id").cast("string").alias("value")), str(tmp_path / "c"), 2, copy=True)
    turns = {int(r.value): r.host for r in spark.read.text(str(tmp_path / "s")).collect()}
    assert turns == {i: i % 3 for i in range(10)}
    assert spark.read.text(str(tmp_path / "s")).count() == 10 and spark.read.text(str(tmp_path / "c")).count() == 8
    sinks.write_tables(str(tmp_path / "t"), a=spark.range(2))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t/a")).count() == 2


def test_dataset(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / n).write_text(n * 3)
    ds = dataset.Dataset.from_glob(spark, str(tmp_path), "*.txt")
    assert ds.query(ds.c.length >= 15).df.count() == 2 and ds.query(limit=1).df.count() == 1 and ds.query(limit=0).df.count() == 2
    assert dataset.search(spark, str(tmp_path), "c*").count() == 1
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    q = dataset.Dataset(df)
    assert q.query(dataset.any_of(q.c.b > 1, q.c.a == 1)).df.count() == 2 and q.query(dataset.all_of(q.c.b > 1, q.c.a > 0)).df.count() == 1


def test_catalog(spark):
    u = spark.createDataFrame([("n", "h", 1, None, 10, None), ("n", "h", 1, None, 30, 5), ("z", "h", 2, "u", 20, None)], "name string, address string, port int, uuid string, lastheardfrom long, lifetime long")
    now = catalog.newest(u.withColumn("key", catalog.key()), ["key"], ["lastheardfrom"])
    assert {r.key: r.lastheardfrom for r in now.collect()} == {"h:1:n": 30, "h:2:z:u": 20}
    assert [r.key for r in catalog.alive(now, 40, 25).collect()] == ["h:2:z:u"]


def test_histogram_edges(spark):
    v = [-0.6, -0.5, 0.0, 0.1, 0.5, 0.6, 1.0]
    h = {r.bucket: r.n for r in stats.histogram(spark.createDataFrame([(x,) for x in v], "v double"), "v", 0.5).collect()}
    assert h == {-0.5: 2, 0.0: 1, 0.5: 2, 1.0: 2}


def test_greedy_buckets_split_distant_values(spark):
    df = spark.createDataFrame([("a", x) for x in [10.0] * 20 + [100.0] * 5] + [("b", 7.0)], "k string, v double")
    got = sorted(tuple(r) for r in stats.greedy_buckets(df, "k", "v", 1.0).collect())
    assert got == [("a", 10.0, 20), ("a", 100.0, 5), ("b", 7.0, 1)]


def test_greedy_buckets_weigh_every_run(spark):
    import random

    def split(runs):
        """Ends by the definition, over single runs: what each run is given if the next one falls low or high."""
        top = max(runs)
        whole, best, at = sum(top - v for v in runs) / len(runs), None, None
        for b in sorted(set(runs))[:-1]:
            low, high = [v for v in runs if v <= b], [v for v in runs if v > b]
            p, q = len(low) / len(runs), len(high) / len(runs)
            mean = lambda x: sum(x) / len(x)
            cost = p * p * (b - mean(low)) + p * q * (top - mean(low)) + q * p * (b + top - mean(high)) + q * q * (top - mean(high))
            if best is None or round(cost, 9) <= round(best, 9):
                best, at = cost, b
        if at is None or round(best, 9) >= round(whole, 9):
            return [top]
        return split([v for v in runs if v <= at]) + split([v for v in runs if v > at])

    rng, rows = random.Random(3), []
    groups = {f"g{i}": [float(rng.choice([1, 2, 3, 10, 11, 40, 41, 90])) for _ in range(rng.randint(1, 60))] for i in range(25)}
    groups |= {"low": [1.0] * 1000 + [2.0, 3.0, 10.0], "high": [1.0, 2.0, 3.0] + [10.0] * 1000}
    rows = [(k, v) for k, x in groups.items() for v in x]
    got = {}
    for r in stats.greedy_buckets(spark.createDataFrame(rows, "k string, v double"), "k", "v", 1.0).collect():
        got.setdefault(r.k, []).append((r.upper, r.n))
    for k, runs in groups.items():
        ends = split(runs)
        assert sorted(u for u, _ in got[k]) == ends and sum(n for _, n in got[k]) == len(runs)
    assert got["low"] != got["high"]


def test_trees_and_prefixes(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "n int, p int")
    assert {(r.node, r.root, r.depth) for r in graph.tree(rows, "n", "p").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}
    lists = spark.createDataFrame([("a", ["x", "y", "z"]), ("a", ["x", "y"]), ("b", ["q"]), ("b", ["r"]), ("c", ["s", "t"])], "k string, items array<string>")
    assert {r.k: r.prefix for r in graph.common_prefix(lists, "k", "items").collect()} == {"a": ["x", "y"], "b": [], "c": ["s", "t"]}
    files = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "f int, least int")
    assert {tuple(r) for r in graph.degraded(files, spark.createDataFrame([(1,), (2,)], "f int"), "f", "least").collect()} == {(1, 1, 1)}


def test_performance_log_takes_the_widest_header(spark, tmp_path):
    (tmp_path / "p").write_text("# timestamp tasks\n1000 1\n# timestamp tasks bytes\n2000 4 9\n")
    assert [tuple(r) for r in logs.performance(spark, str(tmp_path / "p")).orderBy("timestamp").collect()] == [(1000, 1.0, None), (2000, 4.0, 9.0)]


def test_summary_merges(spark):
    df = spark.createDataFrame([("g", 1, -1, 4), ("g", 2, 3, -1), ("g", 3, 5, -1), ("h", 4, -1, -1)], "g string, at int, x int, y int")
    get = lambda how: {r.g: (r.x, r.y) for r in stats.merge_summaries(df, ["g"], how, ["x", "y"], "at").collect()}
    assert get("max") == {"g": (5, 4), "h": (-1, -1)} and get("add") == {"g": (8, 4), "h": (0, 0)}
    assert get("override") == {"g": (5, 4), "h": (-1, -1)} and get("default") == {"g": (3, 4), "h": (-1, -1)}


def test_slots_are_smallest_free(spark):
    df = spark.createDataFrame([("w", 0, 10), ("w", 1, 3), ("w", 2, 5), ("w", 3, 4), ("w", 10, 12)], "w string, s int, e int")
    assert {r.s: r.slot for r in timeseries.slots(df, "w", "s", "e").collect()} == {0: 1, 1: 2, 2: 3, 3: 2, 10: 1}


def test_slots_of_many_stretches(spark):
    import random

    rng, rows = random.Random(9), []
    for w in range(4):
        at = 0
        for _ in range(60):
            at += rng.choice([0, 1, 2, 12])
            rows.append((w, at, at + rng.randint(0, 9), len(rows)))
    want = {}
    for w in range(4):
        busy = {}
        for _, s, e, i in sorted((r for r in rows if r[0] == w), key=lambda r: (r[1], r[2])):
            busy = {k: x for k, x in busy.items() if x > s}
            want[i] = next(k for k in range(1, 100) if k not in busy)
            busy[want[i]] = e
    got = timeseries.slots(spark.createDataFrame(rows, "w int, s int, e int, i int"), "w", "s", "e").collect()
    # tasks of the same start and end may swap their slots
    place = lambda r, k: (r[0], r[1], r[2], k)
    assert sorted(place((r.w, r.s, r.e), r.slot) for r in got) == sorted(place(r, want[r[3]]) for r in rows)


def test_levels_and_cycles(spark):
    import pytest

    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    links = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "parent int, child int")
    lv = graph.levels(nodes, links)
    assert {r.node: r.level for r in lv.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert tuple(graph.depth_and_width(lv).first()) == (4, 2)
    cyclic = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "parent int, child int")
    with pytest.raises(ValueError):
        graph.levels(nodes, cyclic)
    f = graph.footprint(nodes, spark.createDataFrame([("a", 10, 0, 2), ("b", 5, 1, 1)], "file string, size int, made_level int, last_level int"))
    assert {r.level: r.bytes for r in f.collect()} == {0: 10, 1: 15, 2: 10}


def test_closure_has_no_limit_but_hops(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "parent long, child long")
    assert graph.closure(chain, 0).count() == 0
    assert graph.closure(chain, 1).count() == 4
    # a range is bounded beforehand; without hops the frontier alone ends the search
    monkeypatch.setattr(graph, "range", lambda a, b: range(a, min(b, 3)), raising=False)
    assert {(r.ancestor, r.node, r.distance) for r in graph.closure(chain).collect()} == {(i, j, j - i) for i in range(5) for j in range(i + 1, 5)}


def test_closure_has_shortest_distances(spark):
    import random

    rng = random.Random(12)
    for n, m in ((30, 45), (12, 40)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        want, frontier, d = {}, {(a, b) for a, b in edges}, 1
        while frontier:
            want |= {p: d for p in frontier}
            frontier, d = {(a, c) for a, b in frontier for x, c in edges if x == b} - set(want), d + 1
        links = spark.createDataFrame(sorted(edges), "parent int, child int")
        for hops in (None, 3):
            got = {(r.ancestor, r.node): r.distance for r in graph.closure(links, hops).collect()}
            assert got == {p: k for p, k in want.items() if hops is None or k <= hops}


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1500)], "parent int, child int")
    r = graph.closure(chain).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).first()
    assert (r.n, r.far) == (1500 * 1501 // 2, 1500)


def test_empty_reductions(spark):
    df = spark.createDataFrame([(1, None)], "s int, v double")
    r = overall(df, F.col("s"), F.col("s"), *[Reduce(n, F.col("v"), n) for n in ("COUNT", "SUM", "MIN", "MAX", "AVERAGE", "FIRST", "UNIQUE")]).first()
    assert tuple(r)[1:] == (1, 1.0, 0.0, 0.0, 0.0, None, [])
    t = spark.createDataFrame([(1, "2.5"), (1, "word"), (1, None)], "s int, v string")
    assert tuple(overall(t, F.col("s"), F.col("v"), Reduce("COUNT", F.col("v"), "n"), Reduce("SUM", F.col("v"), "total")).first()) == (1, 3, 4.5)


def test_roc_bounds(spark):
    df = spark.createDataFrame([(0.2, False), (0.4, False), (0.6, True), (1.0, True)], "s double, g boolean")
    got = {round(r.threshold, 2): (r.false_accept, r.true_accept) for r in matrix.roc(df, "s", "g").collect()}
    assert len(got) == 101 and got[0.0] == (1.0, 1.0) and got[0.5] == (0.0, 1.0) and got[0.3] == (0.5, 1.0) and got[1.0] == (0.0, 0.5)


def test_exhaustive_buckets_are_the_best(spark):
    import itertools
    import random

    rng = random.Random(4)
    values = [float(rng.choice([3, 4, 9, 20, 21, 40])) for _ in range(60)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")

    def waste(ends):
        return sum(min(e for e in ends if e >= v) - v for v in values)

    edges = sorted(set(values))
    best = min(waste([*c, edges[-1]]) for k in range(3) for c in itertools.combinations(edges[:-1], k))
    got = stats.exhaustive_buckets(df, "k", "v", 1.0, 3).collect()
    assert waste([r.upper for r in got]) == best and sum(r.n for r in got) == 60 and len(got) <= 3


def test_reduce_with_any_arity(spark):
    from tidemark.operators import collect

    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    for arity in (2, 11, 1000):
        assert collect.reduce_with(df.repartition(5), "v", sum, arity).first().value == 5050.0
    assert collect.reduce_with(df.where("v = 7"), "v", sum).first().value == 7.0


def test_ranks_over_ranges(spark):
    import random

    rng = random.Random(1)
    for values in ([5.0] * 7, [rng.choice([1.0, 2.0, 1e9, None]) for _ in range(40)], [float(i * i) for i in range(30)], []):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        got = [(r.i, r["rank"]) for r in stats.ranked(df, "v", ["i"], bins=8).orderBy("rank").collect()]
        want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
        assert got == [(i, k + 1) for k, i in enumerate(want)]


def test_closure_stays_in_all_shuffle_partitions(spark, monkeypatch):
    tasks, write = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: tasks.append(df.select(F.spark_partition_id()).distinct().count()) or write(df))
    links = spark.range(1, 200).select(F.floor(F.col("id") / 2).alias("parent"), F.col("id").alias("child"))
    graph.closure(links)
    assert tasks[1] == int(spark.conf.get("spark.sql.shuffle.partitions"))
