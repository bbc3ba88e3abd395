"""Orders, selections and similarity joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import collect, similar, sorted_files, stats


def jaro(x, y):
    """The definition, by marking."""
    reach, a, b = max(len(x), len(y)) // 2 - 1, [0] * len(x), [0] * len(y)
    for i, c in enumerate(x):
        for k in range(len(y)):
            if abs(i - k) <= reach and not b[k] and y[k] == c:
                a[i] = b[k] = 1
                break
    m = sum(a)
    if not m:
        return 0.0
    moved = sum(p != q for p, q in zip([c for c, u in zip(x, a) if u], [c for c, u in zip(y, b) if u])) // 2
    return (m / len(x) + m / len(y) + (m - moved) / m) / 3


@pytest.mark.parametrize("threshold", [0.65, 0.9])
def test_jaro_join_loses_no_pair(spark, threshold):
    rng = random.Random(4)
    words = {"".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 9))) for _ in range(60)} | {"martha", "amrtha", "dixon", "dicksonx"}
    df = spark.createDataFrame([(w,) for w in [*words, "martha", "", None]], "w string")
    got = {(r.a, r.b): r.similarity for r in similar.jaro_join(df, "w", threshold).collect()}
    want = {(x, y): round(jaro(x, y), 9) for x in words for y in words if x < y and round(jaro(x, y), 9) >= threshold}
    assert got == pytest.approx(want) and ("amrtha", "martha") in got


def test_jaro_join_of_nothing(spark):
    assert similar.jaro_join(spark.createDataFrame([("",), (None,)], "w string"), "w", 0.8).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_reductions_keep_the_order(spark, parts):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdef")) for i in range(137)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, c string").repartition(parts)
    out = collect.reduce_with(df, "c", "".join, arity=3, order=["i"], kind="string").collect()
    assert [r.value for r in out] == ["".join(c for _, c in sorted(rows))]
    assert collect.reduce_with(df.limit(0), "c", "".join, order=["i"], kind="string").count() == 0
    assert collect.reduce_with(df.where("i = 7"), "c", "".join, order=["i"], kind="string").first().value == dict(rows)[7]
    assert collect.reduce_with(df, "i", sum, arity=4).first().value == sum(range(137))


def test_maps_return_results_at_their_place(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") * 2).alias("v")).repartition(7)
    out = collect.map_in_order(df, ["i"], "v", lambda xs: [x + len(xs) * 0 + 1 for x in xs], "long", chunk=9)
    assert sorted((r.i, r.result) for r in out.collect()) == [(i, 2 * i + 1) for i in range(100)]
    with pytest.raises(Exception, match="results of"):
        collect.map_in_order(df, ["i"], "v", lambda xs: xs[1:], "long").collect()


def test_percentiles_of_skewed_values(spark):
    rng = random.Random(7)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(301)], "one": [3.25], "same": [2.0] * 200, "steep": [10.0 ** rng.randint(-4, 4) for _ in range(250)],
        None: [1.0, 2.0], "mostly": [0.0] * 180 + [float(i) for i in range(20)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.fraction): r.percentile for r in stats.percentiles(df, ["g"], "v", fractions, buckets=16, few=20).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        for f in fractions:
            at = f * (len(vs) - 1)
            low = int(at)
            want[g, f] = vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)
    assert got == pytest.approx(want)
    assert stats.percentiles(df.where("v = 3.25"), [], "v", [0.5]).first().percentile == 3.25


def test_sorted_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(4)
    borders = sorted_files.write_sorted(df, str(tmp_path / "a"), "k", 8, ["i"])
    held = sorted((r.least, r.greatest) for r in borders.collect())
    assert 4 < len(held) <= 8 and all(a[1] < b[0] for a, b in zip(held, held[1:]))
    one = sorted_files.between(borders, "k", 200, 200, df.schema)
    assert len(one.inputFiles()) == 1 and sorted(one.collect()) == sorted(r for r in rows if r[0] == 200)
    span = sorted_files.between(borders, "k", 100, 250, df.schema)
    assert len(span.inputFiles()) < len(held) and sorted(span.collect()) == sorted(r for r in rows if r[0] is not None and 100 <= r[0] <= 250)
    assert sorted_files.between(borders, "k", 900, 950, df.schema).count() == 0
    more = [(k, 1000 + i) for i, k in enumerate([3, 5, 7, 2000, -4])]
    both = sorted_files.merge(borders, spark.createDataFrame(more, df.schema), str(tmp_path / "b"), "k", 3, ["i"])
    files = [r.file for r in both.collect()]
    assert any("/a/" in x for x in files) and any("/b/" in x for x in files)
    back = spark.read.schema(df.schema).parquet(*files)
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows + more, key=key)
    d = sorted_files.disorder(back.where("k IS NOT NULL"), F.struct("k", "i")).first()
    assert (d["inside"], d["between"]) == (0, 0)
    bad = spark.createDataFrame([(3, 1), (2, 2), (5, 3)], df.schema).coalesce(1)
    bad.write.parquet(str(tmp_path / "bad"))
    assert sorted_files.disorder(spark.read.parquet(str(tmp_path / "bad")), "k").first()["inside"] == 1
