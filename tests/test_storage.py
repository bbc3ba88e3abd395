"""Storage of a workflow against a version that walks the graph task by task."""

import random

import pytest

from tidemark.operators import storage
from tidemark.plans import workflows


def walked(sizes, made, needed, final):
    nodes = sorted({n for _, n in made} | {n for _, n in needed})
    maker = {}
    for f, n in made:
        maker.setdefault(f, set()).add(n)
    outs = {n: {f for f, m in made if m == n} for n in nodes}
    ins = {n: {f for f, m in needed if m == n} for n in nodes}
    kids = {n: {m for m in nodes if outs[n] & ins[m]} for n in nodes}
    size = lambda files: sum(sizes.get(f) or 0 for f in files)

    def under(n):
        return set().union(*({c} | under(c) for c in kids[n])) if kids[n] else set()

    below = {n: under(n) for n in nodes}
    above = {n: {m for m in nodes if n in below[m]} for n in nodes}
    direct = {n: sorted(c for c in kids[n] if not any(c in below[x] for x in kids[n])) for n in nodes}
    ends = {n: set().union(*(outs[m] & final for m in above[n] | {n})) for n in nodes}
    waits = {n: {f for m in above[n] for f in outs[m] if any(f in ins[u] for u in below[n])} for n in nodes}
    run = {n: ins[n] | outs[n] | ends[n] | waits[n] for n in nodes}
    chain, stay, least, most, out = {}, {}, {}, {}, {}

    def visit(n):
        if n in out:
            return
        for c in direct[n]:
            visit(c)
        if len(direct[n]) < 2:
            chain[n] = (chain[direct[n][0]] if direct[n] else []) + [n]
            stay[n] = outs[n] | ends[n]
            least[n] = most[n] = run[n]
            out[n] = (size(run[n]), 0, 0, 0, size(run[n]), size(run[n]), "run")
            return
        common = []
        for members in zip(*(chain[c] for c in direct[n])):
            if len(set(members)) > 1:
                break
            common.append(members[0])
        chain[n] = common + [n]
        res, heavy, peak = {}, {}, {}
        for c in direct[n]:
            branch = chain[c][len(common) :]
            res[c] = stay[branch[0]] | ends[branch[0]]
            heavy[c] = max(reversed(branch), key=lambda m: size(least[m]))
            peak[c] = max(reversed(branch), key=lambda m: size(most[m]))
        weight = {c: size(least[heavy[c]]) for c in direct[n]}
        stay[n] = set().union(*res.values())
        held, deleting = set(outs[n]), None
        for c in sorted(direct[n], key=lambda c: (size(res[c]) - weight[c], size(res[c]), c)):
            space = held | least[heavy[c]]
            if deleting is None or size(space) > size(deleting):
                deleting = space
            held |= res[c]
        order = sorted(direct[n], key=lambda c: (-weight[c], c))
        together = least[heavy[order[0]]].union(*(res[c] for c in order[1:]))
        unbounded = set().union(*(most[peak[c]] for c in direct[n]))
        least[n], kind = (deleting, "deleting") if size(deleting) <= size(together) else (together, "together")
        if size(run[n]) > size(least[n]):
            least[n], kind = run[n], "run"
        most[n] = unbounded
        for other in (deleting, run[n]):
            if size(other) > size(most[n]):
                most[n] = other
        out[n] = (size(run[n]), size(deleting), size(together), size(unbounded), size(least[n]), size(most[n]), kind)

    for n in nodes:
        visit(n)
    return {n: out[n] for n in nodes}


def frames(spark, sizes, made, needed, final):
    pair = "file string, node long"
    return (
        spark.createDataFrame(list(sizes.items()), "file string, size long"),
        spark.createDataFrame(made, pair),
        spark.createDataFrame(needed, pair),
        spark.createDataFrame([(f,) for f in final], "file string"),
    )


def graph_of(seed):
    """Tasks that need files of earlier ones; many small graphs side by side, as one table."""
    rng = random.Random(seed)
    sizes, made, needed, final = {}, [], [], set()
    for g in range(12):
        n = rng.randint(2, 11)
        for i in range(n):
            node = g * 100 + i
            for k in range(rng.randint(1, 2)):
                f = f"f{node}.{k}"
                sizes[f] = rng.choice([None, 0, 1, 5, 5, 9, 40, 41])
                made.append((f, node))
                if rng.random() < 0.15:
                    final.add(f)
            if i:
                for p in rng.sample(range(i), min(i, rng.choice([1, 1, 2, 3]))):
                    needed.append((f"f{g * 100 + p}.0", node))
            else:
                needed.append((f"source{g}", node))
                sizes[f"source{g}"] = 7
    return sizes, made, needed, final


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    g = graph_of(seed)
    got = {r.node: tuple(r)[1:] for r in storage.footprints(*frames(spark, *g)).collect()}
    want = walked(*g)
    assert got == want
    assert any(r[6] == "deleting" for r in want.values()) and any(r[1] > 0 and r[1] != r[2] for r in want.values())


def test_one_task_nulls_and_repeats(spark):
    sizes, made, needed, final = frames(spark, {"a": 3, "b": 4}, [("b", 1), ("b", 1), (None, 2), ("c", None)], [("a", 1), ("a", 1)], {"b"})
    got = storage.footprints(sizes.withColumn("node", sizes.file), made, needed, final).collect()
    assert [tuple(r) for r in got] == [(1, 7, 0, 0, 0, 7, 7, "run")]


def test_no_tasks(spark):
    assert storage.footprints(*frames(spark, {}, [], [], set())).collect() == []


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        storage.footprints(*frames(spark, {}, [("a", 1), ("b", 2)], [("a", 2), ("b", 1)], set()))


def test_the_graph_is_not_closed_as_a_whole(spark, monkeypatch):
    """A superfluous link, a final file in the middle and one at the end: only what these need is looked for."""
    monkeypatch.setattr(storage.graph, "closure", lambda *a, **k: pytest.fail("closure of the whole graph"))
    g = {"a": 3, "b": 4, "c": 5, "d": 6}, [("a", 1), ("b", 2), ("c", 3), ("d", 4)], [("a", 2), ("a", 3), ("a", 4), ("b", 4), ("c", 4)], {"b", "d"}
    assert {r.node: tuple(r)[1:] for r in storage.footprints(*frames(spark, *g)).collect()} == walked(*g)


def test_links_are_shuffled_once(spark):
    """A step from a level to the next shuffles the level's tasks and not all links, and meets every link once."""
    pairs = spark.createDataFrame([(i, i + k) for i in range(7) for k in (1, 1, 2)], "parent long, child long")
    links = storage.graph.by_parent(pairs)
    step = storage._join(links.select("parent", "child"), spark.range(5).withColumnRenamed("id", "parent"), "parent")
    assert step.count() == 10
    plan = step._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in plan and "Exchange" not in plan.split("InMemoryTableScan")[0].split("SortMergeJoin")[-1]
    nodes, levels, jumps = storage.graph.peeled(links, pairs)
    assert {r.node: r.level for r in nodes.collect()} == {i: min(i, 7) for i in range(9)}
    assert [x.count() for x in levels] == [2] * 7
    assert sorted(tuple(r) for r in jumps.collect()) == [(i, i + 2, i + 2) for i in range(6)]
    links.unpersist()


def test_few_tables_are_written(spark, monkeypatch):
    """Steps share their shuffles: 25 tables for a graph with two ranks of splits (53 before)."""
    written = []
    for module in (storage, storage.graph):
        monkeypatch.setattr(module, "checkpointed", lambda df, whole=module.checkpointed: written.append(df.columns) or whole(df))
    made = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6)]
    needed = [("a", 2), ("a", 3), ("b", 4), ("b", 5), ("d", 6), ("e", 6), ("c", 6)]
    g = {f: i + 3 for i, (f, _) in enumerate(made)}, made, needed, {"f"}
    assert {r.node: tuple(r)[1:] for r in storage.footprints(*frames(spark, *g)).collect()} == walked(*g)
    assert len(written) <= 26


@pytest.mark.parametrize("far", [12, -3, 10**12 + 7])
def test_keys_that_are_no_short_numbers(spark, tmp_path, far):
    """Orders of equal gain go by their names, whether their keys are numbered or not."""
    duckdb = pytest.importorskip("duckdb")
    orders = [(k, 1 + k % 2, 100.0) for k in (1, 10, 2, 100, 19, far)]
    lines = [(o, n, float(5 + n % 3)) for o, _, _ in orders for n in (1, 2, 10)[: 1 + o % 3]]
    tables = {
        "customer": spark.createDataFrame([(1, 3.0), (2, 700.5)], "c_custkey long, c_acctbal double"),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double"),
    }
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query, sql = workflows.QUERIES["workflow_storage"]
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == sorted(con.execute(sql).fetchall())
