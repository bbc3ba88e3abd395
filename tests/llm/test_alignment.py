"""Cross-tokenizer alignment against whole encodings of every text, without a dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies(open(alignment.A_FILE, "rb").read(), open(alignment.B_FILE, "rb").read())


def brute(v, rows):
    """The contract, token pair by token pair."""
    docs = []
    for doc_id, text in rows:
        raw = f" {text or ''}".encode()
        a = v.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = v.b.encode(text) if text else []
        if b"".join(v.a_bytes[x] for x in a) != raw or b"".join(v.b_bytes[x] for x in b) != raw:
            a, b = [], []
        place = lambda ids, size: [(i, sum(len(size[y]) for y in ids[:k]), sum(len(size[y]) for y in ids[: k + 1])) for k, i in enumerate(ids)]
        a, b = place(a, v.a_bytes), place(b, v.b_bytes)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for high in cuts:
            inside = lambda ids: ",".join(str(x[0]) for x in ids if low < x[2] <= high)  # noqa: B023, E731
            groups.append(f"{inside(a)}|{inside(b)}")
            low = high
        docs.append((doc_id, len(a), len(b), groups, links))
    count = Counter(pair for d in docs for pair in set(d[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return Counter(
        (d, na, nb, len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, links in docs
    )


def corpus():
    rng = random.Random(4)
    stems = ["tokenizer", "alignment", "don't", "naïve", "漢字", "x" * 40, "  ", "\n\n", "3.14159", "snake_case", "<0x41>", "<|endoftext|>", "</s>", "\t", "Überraschung", "\r\n", "　", "\x00", "😀"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", ",", ".\n"]) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a ▁ mark"), (204, "trailing "), (205, "\n"), (None, "no id"), (7, "again again"), (7, "again again")]
    return [*rows, (300, "word" * 300), (301, " " * 700 + "end")]


@pytest.mark.parametrize("block_chars", [alignment.BLOCK_CHARS, 300])
def test_alignment(spark, vocabularies, block_chars):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash")).withColumn("block", F.lit("clash")).withColumn("a", F.lit(1))
    out = alignment.Alignment(docs, block_chars=block_chars).documents()
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute(vocabularies, corpus())


def test_alignment_empty_and_hopeless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.Alignment(empty).documents().count() == 0
    none = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.Alignment(none).documents().collect()) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_dictionary_is_whole(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three")], "doc_id long, text string")
    a = alignment.Alignment(docs)
    groups = {r.key: (r.freq, r.held) for r in a.groups.collect()}
    assert sorted(groups.values()) == [(1, 1), (1, 1), (3, 2)]
    assert a.links.count() == 3 and {r.n for r in a.pairs.collect()} == {1, 2}


def test_pieces_are_encoded_as_whole_texts_are(vocabularies):
    rng = random.Random(6)
    signs = " \n\t  　é漢😀\x00\x1c\r'.,aBc1-<>|_"
    for _ in range(3000):
        text = "".join(rng.choice([*signs, " the", " don't", "  ", "\n\n"]) for _ in range(rng.randint(1, 40)))
        a, b = [], []
        for x, y in zip(*vocabularies.encoded(vocabularies.pieces(text))):
            a, b = a + x, b + y
        assert a == vocabularies.a.encode(f" {text}", add_special_tokens=False).ids and b == vocabularies.b.encode(text)


def test_long_texts(spark, vocabularies):
    texts = ["ab cd " * 400_000, "q" * 1_000_000, "\n" * 600_000]
    out = alignment.Alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).documents().collect()
    for r in out:
        assert (r.n_a, r.n_b) == (len(vocabularies.a.encode(f" {texts[r.doc_id]}", add_special_tokens=False).ids), len(vocabularies.b.encode(texts[r.doc_id])))
