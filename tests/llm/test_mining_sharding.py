"""Hard negatives and sharding against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm import sharding


def brute_negatives(rows, k_pos=5, k_neg=10):
    q = []
    for vec_id, label, v in rows:
        if None in (vec_id, label, v) or any(x is None or not math.isfinite(x) or abs(x) > hn.LARGEST for x in v):
            continue
        q.append((vec_id, label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    asking = {}
    for r in q:
        if r[0] % 100 == 0:
            asking[r[0]] = min(asking.get(r[0], r), r)
    out = []
    for a_id, label, a in asking.values():
        scored = sorted((-dot(a, v), i, lab) for i, lab, v in q)
        for s, pos, _ in [x for x in scored if x[2] == label and x[1] != a_id][:k_pos]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k_neg]
            out += [(a_id, pos, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return out


def vectors(seed, n, dim=6, step=None):
    rng = random.Random(seed)
    draw = lambda: rng.gauss(0, 0.4) if step is None else rng.choice([0.0, step, 2 * step])
    return [(i, rng.randrange(4), [draw() for _ in range(dim)]) for i in range(n)]


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("q", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("score", F.lit(2))
    out = hn.hard_negatives(hn.quantised(df.repartition(3)), F.col("vec_id") % 100 == 0, **sizes)
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("sizes", [{}, {"digit": 2, "slack": 1, "row_block": 50, "anchor_block": 2}])
def test_hard_negatives(spark, sizes):
    rows = vectors(1, 420)
    rows += [(500, None, [1.0] * 6), (None, 1, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")]), (504, 2, [float("inf")]), (505, 2, [1e30] * 6)]
    rows += [(600, 1, []), (601, 1, [0.5] * 9), (602, 3, [0.5, 0.25]), (700, 9, [0.1] * 6)]
    assert mined(spark, rows, **sizes) == Counter(brute_negatives(rows))


@pytest.mark.parametrize("sizes", [{}, {"digit": 2, "slack": 1, "row_block": 40, "anchor_block": 3}])
def test_hard_negatives_ties_and_copies(spark, sizes):
    """Few different scores, one vector in a third of the rows, repeated rows and ids with several labels."""
    rows = vectors(2, 300, step=0.5)
    rows = [(i, lab, [0.5, 0.5, 0.0, 0.5, 0.0, 1.0] if i % 3 == 0 else v) for i, lab, v in rows]
    rows += rows[90:130] + [(200, 3, [1.0] * 6), (201, 0, [1.0] * 6)]
    got = mined(spark, rows, **sizes)
    want = Counter(brute_negatives(rows))
    assert got == want and len(want) > 50


def test_hard_negatives_empty(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, 1, [1.0])])


def test_scores_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    for high in (100, 1 << 20, 1 << 26):
        a, b = (rng.integers(-high, high, (3, 40), dtype=np.int64) for _ in range(2))
        assert (hn.scores_of(a.astype("<i4"), b.astype("<i4")).astype(object) == a.astype(object) @ b.astype(object).T).all()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("n", F.lit(0))


def test_slots(spark):
    rows = [(i, f"text {i} é" * (i % 5)) for i in range(400)] + [(None, None), (None, "x"), (7, "other"), (8, None), (9, "")] + [(5, "again")] * 20
    out = sharding.slots(documents(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    by_shard, by_doc = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        by_doc[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert set(by_shard) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in by_doc.values())
    assert 20 < sum(r.grown_shard == 8 for r in out) < 80
    assert sharding.slots(documents(spark, [])).count() == 0


def test_repeated_rows_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    out = sharding.slots(documents(spark, [(1, "a")] * 50 + [(2, "b")] * 7 + [(3, "c")])).collect()
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    assert len(out) == 58 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_changed_weights_move_rows_only_where_they_changed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    old = sharding.leaves([(r, k, 4 * r + 2 * k + s, 1.0) for r in range(2) for k in range(2) for s in range(2)])
    # inside rack 0/0 one shard gives what the other gets: the rack weighs the same
    new = sharding.leaves([(r, k, n, {0: 0.5, 1: 1.5}.get(n, 1.0)) for r in range(2) for k in range(2) for s in range(2) for n in [4 * r + 2 * k + s]])
    moved = {(r.was, r.now) for r in sharding.movement(docs, old, new).collect() if r.was != r.now}
    assert moved == {(0, 1)}
    # a region that grows takes rows from the other, and within the region every rack keeps its own
    heavier = {**old, "": [("region 0", 4.0), ("region 1", 8.0)]}
    moved = {(r.was, r.now) for r in sharding.movement(docs, old, heavier).collect() if r.was != r.now}
    assert moved and all(was < 4 <= now for was, now in moved)
    moved = {(r.was, r.now): r["rows"] for r in sharding.movement(docs, old, sharding.grown(old)).collect() if r.was != r.now}
    assert {now for _, now in moved} == {8} and 350 < sum(moved.values()) < 540
    shares = Counter(r.shard for r in sharding.sharded(docs, sharding.leaves([(0, 0, 0, 3.0), (1, 0, 1, 1.0)])).collect())
    assert 2850 < shares[0] < 3150


def test_write_shards(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in sharding.sharded(docs).collect()}


def test_op11_broadcasts_no_windows(spark, monkeypatch):
    plans, write = [], hn.written

    def noted(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(hn, "written", noted)
    rows = spark.createDataFrame([(i, i % 3, [i % 7 - 3, i % 5]) for i in range(60)], "vec_id long, label long, q array<bigint>")
    out = hn.hard_negatives(rows, F.col("vec_id") % 20 == 0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
