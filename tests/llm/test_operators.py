"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity, warc

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base, other = prose(1, 200), prose(2, 180)
    edited = base.split()
    edited[50] = "changed"
    passage = prose(3, 70)
    shared_line = "This line is shared by many documents, so it goes."
    rows = [
        (1, base, "a"), (2, base, "b"), (3, " ".join(edited), "a"), (4, other, "a"),
        (5, None, None), (6, "", "b"), (7, " \n\t ", "b"), (8, "one", "a"), (8, "one", "a"),
        (9, passage + " " + prose(4, 60), "a"), (10, prose(5, 30) + "\n" + passage, "c"),
        (11, prose(6, 40) + " " + passage + " " + prose(7, 40), None),
        (12, "Is " * 300, "a"), (13, "x" * 5000 + " Is" * 299, "a"), (14, prose(8, 3000), "hot"),
        *[(20 + i, f"{prose(100 + i, 12)}\n  {shared_line.upper() if i % 2 else shared_line} \n{prose(200 + i, 5)}", "hot") for i in range(8)],
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))


def clashing(docs):
    """Extra columns named like the operators' own."""
    for c in ("n_words", "size", "text_", "line", "drop", "kept", "anchor", "block", "id", "band", "component", "score", "key", "target", "toxic", "quality", "_matches_"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def words(text):
    return (text or "").encode().split()


def brute_substring(rows, window=50):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark, docs):
    out = substring_dedup.substring_dedup(clashing(docs))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    assert Counter(got) == Counter(brute_substring(corpus()))
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert spans[2][0].length == 200 and not spans[1]


def test_substring_dedup_random(spark):
    rng = random.Random(5)
    pool = [prose(i, 60) for i in range(6)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng.random(), rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(200 + i, ("ab cd " * rng.randint(20, 60)) + prose(i, 5)) for i in range(6)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    out = out.collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]
    assert Counter(got) == Counter(brute_substring(rows))
    texts = {d: f" {' '.join(t.split())} " for d, t in rows}
    for r in out:
        own, end = texts[r.doc_id].split(), 0
        for f in r.factors:  # apart, in order, each found whole in its reference
            assert f.start >= end and f.length > 0 and f.source < r.doc_id
            end = f.start + f.length
            assert f" {' '.join(own[f.start : end])} " in texts[f.source]
            assert any(s.start <= f.start and end <= s.start + s.length for s in r.spans)
    assert sum(f.length for r in out for f in r.factors) > 0.5 * sum(r.n_removed for r in out)


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, docs):
    out = line_dedup.line_dedup(clashing(docs)).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept or "") for r in out)
    assert got == Counter(brute_lines(corpus()))
    assert sum(r.n_dropped for r in out) == 7


def test_cleaned_keeps_columns(spark, docs):
    source = clashing(docs)
    out = line_dedup.cleaned(source)
    assert out.columns == source.columns and out.schema == source.schema
    rows = out.collect()
    assert len(rows) == len(corpus())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def jaccard(a, b):
    sh = lambda t: {tuple(w[i : i + 5]) for w in [words(t.lower())] for i in range(max(1, len(w) - 4))} if words(t) else set()
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else float(a == b)


def brute_classes(rows):
    rows = [r for r in rows if r[0] is not None]
    parent = {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[1] is not None and b[1] is not None and (a[1] == b[1] or (words(a[1]) and words(b[1]) and jaccard(a[1], b[1]) >= 0.8)):
                x, y = sorted((top(a[0]), top(b[0])))
                parent[y] = x
    return {d: top(d) for d in parent}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(clashing(docs)).collect()}
    assert got == brute_classes(corpus())


def family(n, edits, seed):
    """Copies of one text, each edited its own way: similarities on both sides of the threshold."""
    rng, base = random.Random(seed), prose(seed, 150).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        out.append((1000 * seed + i, " ".join(w)))
    return out


def test_near_duplicates_of_an_id_with_several_texts(spark):
    a, b, c = (prose(600 + i, 80) for i in range(3))
    close = [" ".join(["new", *t.split()[1:]]) for t in (a, b)]
    rows = [(1, a), (1, b), (2, close[0]), (3, close[1]), (7, a), (7, c), (7, c), (8, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("same", F.lit(0))
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (7, 7), (7, 7), (8, 7)])
    assert Counter((r.doc_id, r.text) for r in near_dedup.one_of_each(df).collect()) == Counter([(1, a), (1, b), (7, c)])


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicates_lose_no_link_in_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # 2: the prefix filter finds every pair left
    rows = family(60, 8, 3) + family(40, 12, 4) + [(1, prose(9, 40))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_weighted_signatures_estimate_weighted_jaccard():
    a, b = (near_dedup.weighted_shingles((f"{prose(1, 60)} " * k + prose(2, 80)).encode(), weights="count") for k in (2, 4))
    k = 4000
    same = (near_dedup.dart_signature(*a, k) == near_dedup.dart_signature(*b, k)).mean()
    assert abs(same - near_dedup.similarity(a, b)) < 0.04


def test_one_of_each(spark, docs):
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect())
    assert ids.count(8) == 1 and 1 in ids and 2 not in ids and 3 not in ids and 5 in ids


def test_decontamination(spark, docs):
    item = " ".join(prose(8, 3000).split()[1000:1040])
    near = item.split()
    near[-1] = "other"
    items = spark.createDataFrame([(1, item), (2, " ".join(near)), (3, prose(77, 30)), (4, "too short"), (5, None), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = []
    sh = lambda t: {tuple(w[i : i + 5]) for w in [words(t.lower())] for i in range(len(w) - 4)}
    for doc, text, *_ in corpus():
        for i, t in ((1, item), (2, " ".join(near)), (3, prose(77, 30))):
            n = len(sh(t) & sh(text or ""))
            if n >= 0.8 * len(sh(t)):
                want.append((doc, i, len(sh(t)), n))
    for block in (10, 1_000_000):
        got = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs, items, block_words=block).collect()]
        assert sorted(got) == sorted(want) == [(14, 1, 36, 36), (14, 2, 36, 35)]
    for block in (10, 1_000_000):
        left = decontaminate.decontaminated(clashing(docs), items, block_words=block)
        assert left.columns == clashing(docs).columns and left.count() == len(corpus()) - 1


def test_partitions_of_items_miss_nothing():
    rng = random.Random(4)
    texts = {i: [prose(i, rng.randint(5, 120)).encode()] for i in range(60)}
    items = decontaminate.Items(texts, 5, 0.8)
    assert len(items.partitions) > 8
    for _ in range(150):
        own = [w for i in rng.sample(range(60), 3) for w in texts[i][0].split()]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = b"other"
        text = b" ".join([*prose(rng.random(), rng.randint(0, 300)).encode().split(), *own])
        have = decontaminate.shingles(text.split(), 5)
        want = [(i, len(v), len(v & have)) for i, v in sorted(items.shingles.items()) if len(v & have) >= 0.8 * len(v) - 1e-9]
        assert items.find(text) == want


def test_token_counts(spark, docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_counts.VOCABULARY, "rb"))}
    codec = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(codec.encode_ordinary(t or "")) for _, t, _ in corpus())
    hist = token_counts.length_histogram(token_counts.token_lengths(clashing(docs).select("text")))
    for r in hist.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n) and r.docs_up_to == sum(x <= n for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > n) and r.truncated_tokens == sum(min(x, n) for x in lengths)
    one = token_counts.truncated_total(hist, 100).first()
    assert one.kept_tokens == sum(min(x, 100) for x in lengths) and one.truncated_docs == sum(x > 100 for x in lengths)


def test_token_counts_of_long_runs():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_counts.VOCABULARY, "rb"))}
    codec = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    length = token_counts.encoded_length(open(token_counts.VOCABULARY, "rb").read())
    rng = random.Random(2)
    space = [" ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\r\n", "  "]
    for _ in range(60):
        text = "".join(rng.choice(["word", "x", "12", "!?", "é"]) * rng.randint(0, 3) + rng.choice(space) * rng.randint(0, 2000) for _ in range(6)) + rng.choice(["", "end"])
        assert length(text) == len(codec.encode_ordinary(text))
    big = 10_000_000
    assert length(" " * big) + 1 >= length(" " * big + "a") > length(" " * (big - 1000))
    assert length("a" * 2_000_000) == 2 * length("a" * 1_000_000) and length("Is\n" + "\n" * big + "Is") > 2


def test_scratch_leaves_nothing_but_the_result(spark, docs, tmp_path):
    from pathlib import Path

    from tidemark.llm.common import settled

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tidemark"
    before = {x.name for x in shared.iterdir()} if shared.exists() else set()
    out = settled(spark, lambda: line_dedup.cleaned(docs), "cleaned")
    assert out.count() == len(corpus()) and len({x.name for x in shared.iterdir()} - before) == 1


def very_long(kind):
    """Texts of more than 5 MB: prose on one line, one word, white space, many lines."""
    rng = random.Random(kind)
    return {"words": lambda: " ".join(rng.choices(WORDS, k=1_200_000)), "word": lambda: "ab" * 2_600_000, "space": lambda: " \t\n" * 1_800_000, "lines": lambda: "\n".join(f"line {i} of a text that has very many of them" for i in range(120_000))}[kind]()


def test_very_long_texts(spark, monkeypatch, tmp_path):
    rows = [(i, very_long(k), "a") for i, k in enumerate(("words", "word", "space", "lines"))]
    rows += [(10, rows[0][1], "b"), (11, rows[3][1] + "\nand one more", "a"), (12, prose(1, 60), "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "long"))
    df = spark.read.parquet(str(tmp_path / "long"))
    n = {d: len(t.split()) for d, t, _ in rows}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).select("doc_id", "n_removed").collect()}
    assert removed == {**{d: 0 for d in n}, 10: n[0], 11: n[3]}
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df, min_docs=2).select("doc_id", "n_dropped").collect() if r.n_dropped} == {0: 1, 3: sum(len(x) >= 40 for x in rows[3][1].split("\n"))}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect() if r.doc_id != r.class_id} == {10: 0, 11: 3}
    item = " ".join(rows[0][1].split()[600_000:600_040])
    found = decontaminate.contained_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id").collect()
    assert {r.doc_id for r in found} == {0, 10}
    lengths = token_counts.length_histogram(token_counts.token_lengths(df.select("text"))).agg(F.sum("n_docs"), F.max("n_tokens")).first()
    assert lengths[0] == len(rows) and lengths[1] > 1_000_000
    rules = {r.doc_id: (r.n_words, r.n_dup_lines) for r in quality_rules.quality_rules(df).collect()}
    assert rules == {d: (k, 0) for d, k in n.items()}
    mix = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(df).collect()}
    assert {d: s for d, (s, _) in mix.items()} == n and all(t <= 3 * s for s, t in mix.values())
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    kinds = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert kinds == {d: (len(t.encode()), 0 if d == 10 else None) for d, t, _ in rows}
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in n], "doc_id long, toxic int, quality int")
    for module, query in ((toxicity, toxicity.op4_toxicity), (quality_classifier, quality_classifier.op10_quality_classifier)):
        with_tables(spark, monkeypatch, module, df, labels)
        assert query(spark, "").where("score BETWEEN 0 AND 1").count() == len(rows)


def brute_targets(sizes, times=3):
    """Reshare step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(times * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: times * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > times * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs):
    def rows():
        return sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, r.source or "") for r in mixing.Mix(clashing(docs).withColumn("source", docs.source), block_words=8).taken().select("doc_id", "size", "source_size", "target", "taken", "source").collect())

    got = rows()
    assert got == rows()
    sizes = defaultdict(int)
    for _, t, s in corpus():
        sizes[s] += len(words(t))
    target = brute_targets(dict(sizes))
    assert len(got) == len(corpus())
    taken = defaultdict(int)
    for d, size, source_size, t, k, s in got:
        s = s or None
        assert source_size == sizes[s] and abs(t - target[s]) < 1e-6 * max(1, t) and 0 <= k <= 3 * size
        taken[s] += k
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 16 + 0.02 * target[s]


def test_mixed_blocks_are_text(spark):
    rows = [(i, prose(i, 40), "ab"[i % 2]) for i in range(10)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16)
    blocks = mix.blocks().collect()
    assert len(blocks) == mix.slots().count()
    assert {b.key for b in blocks} == {0, 1}
    assert all(0 < len(b.text.split()) <= 16 for b in blocks)


def test_taken_is_blocks_times_uses(spark):
    """Every document's words, laid in their source's row, against the blocks that hold them and how often these are drawn."""
    rng = random.Random(12)
    rows = [(i, prose(i, rng.choice([0, 1, 7, 60, 300])), "abc"[i % 3] if i % 7 else None) for i in range(90)] + [(500, prose(1, 30_000), "b"), (None, prose(2, 50), "a")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16)
    uses = Counter((r.key, r.block) for r in mix.slots().collect())
    text, row = {d: t.split() for d, t, _ in rows}, defaultdict(dict)
    for r in mix.taken().collect():
        own = Counter((r.begin + i) // 16 for i in range(r["size"]))
        assert r.taken == sum(n * uses[r.key, b] for b, n in own.items())
        row[r.key].update({r.begin + i: w for i, w in enumerate(text[r.doc_id])})
    assert all(sorted(x) == list(range(len(x))) for x in row.values())
    block = {(r.shard, r.slot, r.key): r.block for r in mix.slots().collect()}
    got = mix.blocks().collect()
    assert len(got) == len(block)
    for r in got:
        at = block[r.shard, r.slot, r.key] * 16
        assert r.text == " ".join(row[r.key][i] for i in range(at, at + 16) if i in row[r.key])


def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def pages():
    big = "<p>" + "é" * 300 + "</p>"
    return [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", big), (8, "u8", "z" * 200_000), (9, "u9", "a" * 99), (10, "u0", "a" * 99), (11, "v", "b" * 100), (12, "v", "b" * 100), (12, "v", "b" * 100), (None, "n", "c" * 200), (13, "n", "c" * 200), (None, None, None), (1, "u1", "d" * 150), (14, "w", "d" * 150), (2, "u2", "e" * 120), (2, "u2", "d" * 150)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(0))
    first = {}
    for i, _, h in pages():
        if i is not None:
            first.setdefault(h or "", i)
    want = []
    for i, _, h in pages():
        p = (h or "").encode()
        again = i is not None and len(p) >= 100 and first[h] != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, roll_bytes=1000).collect()]
    assert Counter(got) == Counter(want)


def test_warc_members_and_index(spark, tmp_path):
    import gzip

    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    manifest = warc.write_monolithic(warc.with_revisits(df), f"{folder}/m", roll_bytes=500).collect()
    members = warc.normalise(spark.createDataFrame(manifest), f"{folder}/r").collect()
    (tmp_path / "r" / "left_by_a_lost_executor.warc.gz.idx").write_text("0 1 response x - -\n")
    index = warc.read_index(spark.createDataFrame(members)).collect()
    assert len(index) == len(pages()) == sum(m.n_records for m in members)
    for r in index:
        data = open(r.archive.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        head = gzip.decompress(data).split(b"\r\n\r\n")[0].decode()
        assert f"WARC-Page-ID: {'-' if r.page_id is None else r.page_id}" in head.split("\r\n") and f"WARC-Type: {r.record_type}" in head


@pytest.mark.parametrize("chunk", [1, 64, 1 << 20])
def test_inflated_records(chunk):
    import gzip
    import io

    payloads = [b"z" * 50_000, b"", b"a\r\n\r\nb" * 20, bytes(range(256)) * 4]
    records = [warc.record_bytes({"WARC-Type": "response"}, p) for p in payloads]
    joined = gzip.compress(b"".join(records))
    apart = b"".join(map(gzip.compress, records))
    for data in (joined, apart, joined + apart):
        got = [(h["warc-type"], p) for h, _, p in warc.inflated_records(io.BytesIO(data), chunk)]
        assert got == [("response", p) for p in payloads] * (2 if data == joined + apart else 1)
    assert list(warc.inflated_records(io.BytesIO(b""), chunk)) == []
    for cut in (5, len(joined) // 2, len(joined) - 1):
        with pytest.raises(ValueError):
            list(warc.inflated_records(io.BytesIO(joined[:cut]), chunk))


def test_quality_rules_against_brute_force(spark, docs):
    rows = corpus() + [(90, "a b c d e a b c d e f", "a"), (91, ("x y " * 30), "a"), (92, "the#! of ## and| to", "a"), (93, "l m\nl m\n\nl m", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    for r in quality_rules.quality_rules(df).collect():
        texts = [t for d, t, *_ in rows if d == r.doc_id]
        w = [x.decode() for x in words(texts[0])]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (texts[0] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[0] or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def labelled(n, bad):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(60)]
        if y:
            w = bad(w, rng)
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels


def accuracy(rows, labels):
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def with_tables(spark, monkeypatch, module, docs, labels):
    monkeypatch.setattr(module, "table", lambda s, d, name: {"documents": docs, "labels": labels}[name])


def test_toxicity_held_out(spark, monkeypatch):
    rows, labels = labelled(900, lambda w, rng: w[:30] + [rng.choice(["grobian", "grobiante"])] + w[30:])
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    tags = spark.createDataFrame([*labels, (0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    with_tables(spark, monkeypatch, toxicity, docs, tags)
    out = toxicity.op4_toxicity(spark, "").collect()
    assert accuracy([r for r in out if r.doc_id < 5000], labels) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and {r.predicted for r in out if r.doc_id >= 5000} == {0}
    kept = {r.doc_id for r in toxicity.harmless(docs, tags).collect()}
    assert {5000, 5001} <= kept and 1 in kept and 0 not in kept


def test_toxicity_of_many_mild_expressions(spark, monkeypatch):
    """Every text uses the expression; the classes differ by how often."""
    rows, labels = labelled(900, lambda w, rng: [x if rng.random() > 0.15 else rng.choice(["achlich", "achkeit"]) for x in w])
    rows = [(i, f"{text} achlich achkeit") for i, text in rows]
    with_tables(spark, monkeypatch, toxicity, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert accuracy(toxicity.op4_toxicity(spark, "").collect(), labels) > 0.95


def test_toxicity_tells_all_expressions_apart():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)) for _ in range(8)]
    held = set()
    for text in texts:
        s = f" {text} "
        held.update(s[max(s.rindex(" ", 0, i), i - 5) : i + 1] for i in range(1, len(s)))
    frame = pd.DataFrame({"text": [x.encode() for x in texts], "toxic": [i % 2 for i in range(8)]})
    parts = list(toxicity._class_counts(iter([frame])))
    assert sum(map(len, parts)) == len(held)
    counted = pd.concat(parts)
    gram, value = counted["gram"].to_numpy(), counted["toxic"].to_numpy() + 1.0
    assert set(gram) == {int.from_bytes(x.encode(), "big") for x in held}
    ratios = toxicity.Ratios(gram[::2], value[::2])
    assert (ratios.of(gram[::2]) == value[::2]).all() and not ratios.of(gram[1::2]).any()


def brute_model(texts, labels):
    """The continuation counts, and a function for the log ratio of a word, by the formulas of the module."""
    import math

    def pieces(text, n):
        s = b" " + b" ".join(text.split()) + b" "
        return [s[max(s.rindex(b" ", 0, i), i - n + 1) : i + 1] for i in range(1, len(s))]

    count, documents = [Counter(), Counter()], Counter()
    for i, y in labels.items():
        held = pieces(texts[i], 6)
        count[y].update(held)
        documents.update(set(held))
    both = count[0] + count[1]
    of_context = [Counter(), Counter()]
    for y in (0, 1):
        for g, n in count[y].items():
            of_context[y][g[:-1]] += n
    rest = Counter()
    for g, n in both.items():
        rest[g[:-1]] += min(n, toxicity.DISCOUNT)
    begins, before = Counter(), defaultdict(set)
    for w in {w for t in texts.values() for w in t.split()}:
        s = b" " + w + b" "
        for i in range(1, len(s)):
            low = max(s.rindex(b" ", 0, i), i - 3)
            g = s[low : i + 1]
            if low == 0:
                begins[g] += 1
            else:
                before[g].add(s[low - 1])
    k = {g: begins[g] + len(before[g]) for g in {*begins, *before}}
    total, kinds = Counter(), Counter()
    for g, n in k.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    d, prior = toxicity.LOW_DISCOUNT, toxicity.PRIOR

    def ratio(word):
        out = 0.0
        for g in set(pieces(word, 6)) & set(both):
            low, h = g[-4:], g[:-1]
            shared = (max(k[low] - d, 0) + d * kinds[low[:-1]] / 64) / total[low[:-1]]
            common = (max(both[g] - toxicity.DISCOUNT, 0) + rest[h] * shared) / (of_context[0][h] + of_context[1][h])
            b = both[g] / documents[g]
            log = [math.log((count[y][g] / b + prior) / (of_context[y][h] * common / b + prior)) for y in (0, 1)]
            out += (log[1] - log[0]) * pieces(word, 6).count(g)
        return out

    return k, ratio


@pytest.mark.parametrize("block", [40, 1 << 21])
def test_toxicity_values_against_brute_force(spark, monkeypatch, block):
    rows, labels = labelled(60, lambda w, rng: [x if rng.random() > 0.2 else rng.choice(["grobian", "grobiante", "\u00e9rdö"]) for x in w])
    rows = [*rows, (60, "grobian x " * 3000), (61, rows[0][1]), (62, None), (62, ""), (63, "\n \t")]
    texts = {i: (t or "").lower().encode() for i, t in rows}
    monkeypatch.setattr(toxicity, "BLOCK_GRAMS", block)
    monkeypatch.setattr(toxicity.expressions, "__defaults__", (block,))
    monkeypatch.setattr(toxicity, "crc_mod", lambda c, n: F.lit(0))
    tags = spark.createDataFrame([(i, y) for i, y in labels if i % 3], "doc_id long, toxic int")
    usable = tags.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1_000_000)) < 200_000)
    counted = {r.doc_id: r.toxic for r in usable.where("NOT curve").collect()}
    assert 10 < len(counted) < 40 and set(counted.values()) == {0, 1}
    docs = spark.createDataFrame([*rows, rows[0], rows[60], rows[60]], "doc_id long, text string")
    model = toxicity.Toxicity(docs, tags)
    got = {r.key: (r.level0, r.level1) for r in model.values.collect()}
    ratio = brute_model(texts, counted)[1]
    known = {w: ratio(w) for t in texts.values() for w in set(t.split())}
    for i, text in texts.items():
        own = text.split()
        want = [sum(min(max(known[w] - x, 0), 1) for w in own) / max(1, len(own)) for x in toxicity.LEVELS]
        assert got.get(i, (0, 0)) == pytest.approx(tuple(want), abs=1e-6)
    assert got[60][0] > 0 and 62 not in got


def test_continuation_counts(spark):
    texts = {1: b"banana bandana  cabana", 2: b"an ana", 3: b""}
    words = spark.createDataFrame([(bytearray(w),) for w in {w for t in texts.values() for w in t.split()}], "word binary")
    k, _ = brute_model(texts, {1: 0, 2: 1})
    assert {r.gram: r.k for r in toxicity.continuations(words).collect()} == {int.from_bytes(g, "big"): n for g, n in k.items()}


def test_toxicity_in_several_languages(spark, monkeypatch):
    """A toxic beginning of words in each language, in new words each time; the ordinary texts use it now and then."""
    rng, rows, labels = random.Random(8), [], []
    stems = {"de": "achlich", "fr": "réeux", "es": "bomen"}
    for i in range(1500):
        lang, toxic = rng.choice([*stems]), i % 4 == 0
        w = [lang + rng.choice(WORDS) for _ in range(120)]
        for _ in range(4 if toxic else rng.random() < 0.2):
            w[rng.randrange(len(w))] = stems[lang] + "".join(rng.choices("abcdefghij", k=4))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    with_tables(spark, monkeypatch, toxicity, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert accuracy(toxicity.op4_toxicity(spark, "").collect(), labels) > 0.97


def test_toxicity_without_labels(spark, monkeypatch, docs):
    with_tables(spark, monkeypatch, toxicity, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {(r.score, r.predicted) for r in toxicity.op4_toxicity(spark, "").collect()} == {(0.5, 0)}


def test_quality_held_out(spark, monkeypatch):
    rows, labels = labelled(900, lambda w, rng: [x + rng.choice(["%%%", "$$"]) for x in w])
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string").withColumn("quality", F.lit("clash"))
    with_tables(spark, monkeypatch, quality_classifier, docs, spark.createDataFrame([*labels, (0, 1), (1, None), (None, 1)], "doc_id long, quality int"))
    out = quality_classifier.op10_quality_classifier(spark, "").collect()
    assert accuracy([r for r in out if r.doc_id < 5000], labels) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_empty_tables(spark, monkeypatch, docs):
    none = docs.limit(0)
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert token_counts.length_histogram(token_counts.token_lengths(none.select("text"))).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, items).count() == len(corpus())
    assert decontaminate.contained_items(none, items).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    for module, query in ((toxicity, toxicity.op4_toxicity), (quality_classifier, quality_classifier.op10_quality_classifier)):
        with_tables(spark, monkeypatch, module, none, labels)
        assert query(spark, "").count() == 0


def test_null_ids_and_null_sources(spark, monkeypatch):
    same = prose(1, 120)
    rows = [(None, same, None), (None, same, "a"), (1, same, None), (2, same, "a"), (None, None, None), (None, "", "a"), (3, prose(2, 30), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    removed = Counter((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert removed == Counter([(None, 0)] * 4 + [(1, 0), (2, 120), (3, 0)])
    assert line_dedup.line_dedup(df).where("n_dropped > 0").count() == 0
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()) == Counter([(None, None)] * 4 + [(1, 1), (2, 1), (3, 3)])
    assert near_dedup.one_of_each(df).count() == 6
    mix = mixing.Mix(df, block_words=8).taken().collect()
    assert len(mix) == 7 and all(0 <= r.taken <= 3 * r.size for r in mix)
    assert quality_rules.quality_rules(df).count() == 7
    items = spark.createDataFrame([(1, same)], "item_id long, text string")
    assert decontaminate.decontaminated(df, items).count() == 3
    assert {(r.doc_id, r.n_shared) for r in decontaminate.contained_items(df, items).collect()} == {(None, 116), (1, 116), (2, 116)}
    labels = spark.createDataFrame([(None, 1, 0), (1, 0, 1), (2, None, None), (3, 1, 0)], "doc_id long, toxic int, quality int")
    for module, query in ((toxicity, toxicity.op4_toxicity), (quality_classifier, quality_classifier.op10_quality_classifier)):
        with_tables(spark, monkeypatch, module, df, labels)
        out = query(spark, "").collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
