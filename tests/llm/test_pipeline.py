"""The pipeline stage by stage, each held against a brute-force version over its own input."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_lines, prose, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = prose(501, 30)


def corpus():
    rng, rows = random.Random(1), []
    for i in range(240):
        text = prose(1000 + i, rng.randint(20, 90))
        if i % 4 == 0:
            w = text.split()
            text = " ".join([*w[:9], rng.choice(["grobian", "grobiante"]), *w[9:]])
        if i % 7 == 1:
            text += "\nThis footer line is the same in every one of these documents."
        if i % 40 == 2:
            text = prose(7, 100) + f" tail{i // 80}"
        if i % 60 == 3:
            text += " " + ITEM
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return [*rows, (900, None, "en", None, None), (901, "", "en", "s1", 0)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash"))
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240) if i % 40 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(777, 20))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out, frame = [docs], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, sf).write.parquet(f"{sf}/out{k}")
        frame = spark.read.parquet(f"{sf}/out{k}")
        out.append(frame)
    return out, sf


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stage_columns(stages):
    out, _ = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(df.columns == out[0].columns for df in out[1:-1])


def test_toxic_documents_go(stages):
    before, after = map(rows, stages[0][:2])
    want = [r for r in before if not (r[1] and "grobian" in r[1])]
    assert after == want


def test_shared_lines_go(stages):
    before, after = map(rows, stages[0][1:3])
    cut = {d: kept for d, _, dropped, kept in brute_lines(before) if dropped}
    assert cut and after == sorted((d, cut.get(d, t)) for d, t in before)
    assert all(r.n_chars == len(r.text) for r in stages[0][2].collect() if r.text is not None)


def test_one_of_each_class_stays(stages):
    before, after = map(rows, stages[0][2:4])
    classes = brute_classes(before)
    assert after == [r for r in before if classes[r[0]] == r[0]] and len(after) < len(before)


def test_leaks_go(stages):
    before, after = map(rows, stages[0][3:5])
    sh = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4)}
    assert after == [r for r in before if len(sh(ITEM) & sh(r[1])) < 0.8 * len(sh(ITEM))] and len(after) < len(before)


def test_the_mix_takes_its_targets(stages):
    before, after = stages[0][4], stages[0][5].collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before.collect())
    source = {r.doc_id: r.source for r in before.collect()}
    for s in set(source.values()):
        own = [r for r in after if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64 + 0.02 * own[0].target and all(r.taken <= 3 * r.size for r in own)


def test_run_is_its_stages(spark, stages):
    out, sf = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, out[-1].collect()))
