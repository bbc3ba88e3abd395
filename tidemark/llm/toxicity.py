r"""Toxicity: class-conditional Kneser-Ney models of characters, compared word by word over whole texts.

Words may be new although their parts are not, so the models predict characters.  All occurrences of
6-grams are counted for both classes; contexts end at the space that begins the word, so all words start
from one context and the product along a word's beginning is the rate of words that begin so.  Both
classes are measured against one Kneser-Ney model of the two together, whose lower order, a 4-gram
distribution, comes from all documents, labelled or not:

    P(x | h5) = (max(n(h5 x) - D, 0) + (sum over y of min(n(h5 y), D)) * P(x | h3)) / n(h5 .)
    P(x | h3) = (max(k(h3 x) - d, 0) + d * N(h3 .) / 64) / k(h3 .)
    r_c(h5 x) = (n_c(h5 x) / b + K) / (n_c(h5 .) * P(x | h5) / b + K)

n is the sum of both classes.  b is how often a document that holds h5 x repeats it, so what one
document repeats counts as one observation, and K observations of the common model are added: rates
that few documents tell apart stay near 1, and a 6-gram of no labelled document says nothing.  k is the
Kneser-Ney continuation count over the vocabulary of all documents: after how many different characters
h3 x occurs, or, where h3 begins with the space that begins the word and nothing can stand before it, in how
many different words.

A word's log ratio is the sum over its characters of log r_toxic - log r_ordinary: its log likelihood in the
toxic model less that in the ordinary one.  A text is described by the mean over all its words of what
their log ratios exceed 1 by, and of what they exceed 2 by, each at most 1: log likelihoods normalised by
length, in which no word counts for more than another that is as surely toxic.  Beside them stands how many words
the second mean is of, as one word of a short text is less sure than the same share of a long one.  A
logistic curve of the first mean and the logarithms of the others, fitted on labelled documents that the
counts have not seen, maps them to 0..1.

A word's log ratio depends on the word alone, so the work is four joins of tables that grow with the
corpus, and every broadcast has a fixed bound:

1. The 6-grams of labelled documents, summed by task and then by Spark.
2. The vocabulary: every distinct word of all documents; its 4-grams give the lower order.
3. The log ratios go to the vocabulary's tasks in blocks of at most about ``BLOCK_GRAMS``, one pass over the
   vocabulary a block, and are added up by word.  Words above 1 are the expressions.
4. Documents are read once more: each task sends on the words whose bit is set in a bitmap of 2**26 bits
   made from the expressions, and these few meet the expressions in a join, where those that share a bit
   with another word drop out; then they are summed by document.

Only labels whose crc32(doc_id) mod 3 is not 1 are used: a fifth of them, at most about ``CURVE_ROWS`` and up
to half of those of each class, for the curve, whose intercept restores the classes' shares, and all others
for the counts.  Defined results: null or empty texts have the values 0; labels that are null are ignored and
repeated labels of a document count once, as toxic if any is; without any usable label of both classes every
score is 0.5 and predicted is 0; repeated rows are each scored; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, salted_join, table, written
from tidemark.llm.shingles import word_hashes

HIGH, LOW = 6, 4
#: N-grams of single documents, or distinct words, that a task gathers before it adds them up.
GATHERED = 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Taken from each count of the classes together, or all of a smaller one; and from each shared count.
DISCOUNT, LOW_DISCOUNT = 1.8, 0.9
#: Observations of the common model that are added to each class.
PRIOR = 4
#: What a word's log ratio must exceed to count, and how much of the excess counts at most.
LEVELS, MOST = (1.0, 2.0), 1.0
#: The second mean that is as far from 0 as twice it is from it, on the curve's logarithmic scale.
KNEE = 0.002
#: Log ratios in a broadcast block, at 24 to 48 bytes each; and the bits of the expressions' bitmap.
BLOCK_GRAMS, FILTER_BITS = 1 << 21, 26
#: Share of usable labels kept from the counts to fit the curve, and most rows of it that are used.
CURVE_FOLDS, CURVE_ROWS = 5, 20_000


def characters(text: bytes | None) -> np.ndarray:
    """The bytes of a lower-cased text, each run of spaces as one space, with a space at both ends."""
    return np.frombuffer(b" " + b" ".join((text or b"").split()) + b" ", np.uint8)


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Every character but the first, in the low byte, behind its context.

    The context is the n-1 characters before, cut at the space that begins the word.
    """
    size = len(chars) - 1
    place = np.arange(size)
    begins = np.maximum.accumulate(np.where(chars[:-1] == 32, place, 0))
    length = np.minimum(place + 1 - begins, n - 1)
    h = np.zeros(size, np.int64)
    for j in range(min(n - 1, size)):
        h[j:] |= chars[: size - j].astype(np.int64) << (8 * j)
    h &= (np.int64(1) << (length * 8)) - 1
    return h << 8 | chars[1:]


def places(gram: np.ndarray, bits: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def word_starts(chars: np.ndarray, n: int) -> np.ndarray:
    """Whether the context of each character but the first begins with the space that begins its word."""
    place = np.arange(len(chars) - 1)
    return place - np.maximum.accumulate(np.where(chars[:-1] == 32, place, 0)) < n - 1


def _gathered(parts: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays of equal length, joined to about GATHERED rows."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= GATHERED:
            yield [np.concatenate(x) for x in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of each 6-gram in each class, and the documents that hold it."""

    def parts() -> Iterator[tuple]:
        for frame in batches:
            for text, label in zip(frame["text"], frame["toxic"]):
                found, times = np.unique(grams(characters(text), HIGH), return_counts=True)
                yield found, times, np.full(len(found), bool(label))

    for gram, times, toxic in _gathered(parts()):
        found, at, documents = np.unique(gram, return_inverse=True, return_counts=True)
        of_toxic, of_all = (np.bincount(at, w, len(found)).astype(np.int64) for w in (times * toxic, times))
        yield pd.DataFrame({"gram": found, "toxic": of_toxic, "ordinary": of_all - of_toxic, "documents": documents})


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of a task's texts."""
    held: set[bytes] = set()
    for frame in batches:
        for text in frame["text"]:
            held.update((text or b"").split())
            if len(held) >= GATHERED:
                yield pd.DataFrame({"word": list(held)})
                held = set()
    yield pd.DataFrame({"word": list(held)})


def _shared_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of distinct words their 4-grams, with the character before (-1 at the beginning of a word) and in how many words."""
    for frame in batches:
        chars = np.frombuffer(b" " + b" ".join(frame["word"]) + b" ", np.uint8)
        gram, before = grams(chars, LOW), np.full(len(chars) - 1, -1)
        inside = np.flatnonzero(~word_starts(chars, LOW))
        before[inside] = chars[inside - (LOW - 1)]
        found, n = np.unique(np.stack([gram, before]), axis=1, return_counts=True)
        yield pd.DataFrame({"gram": found[0], "before": found[1].astype(np.int16), "n": n})


def continuations(words: DataFrame) -> DataFrame:
    """(gram, k) of the distinct words' 4-grams: the Kneser-Ney continuation counts."""
    pairs = words.mapInPandas(_shared_counts, "gram long, before short, n long").groupBy("gram", "before").agg(F.sum("n").alias("n"))
    return pairs.groupBy("gram").agg(F.sum(F.when(F.col("before") < 0, F.col("n")).otherwise(1)).alias("k"))


def log_ratios(high: DataFrame, low: DataFrame) -> DataFrame:
    """(gram, ratio), toxic over ordinary, of all 6-grams; from the sums of _class_counts and the continuations."""
    low = low.select(F.col("gram").alias("low"), F.shiftright("gram", 8).alias("back"), "k")
    backs = low.groupBy("back").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("kinds"))
    part = (F.greatest(F.col("k") - LOW_DISCOUNT, F.lit(0.0)) + LOW_DISCOUNT * F.col("kinds") / 64) / F.col("total")
    shared = low.join(backs, "back").select("low", part.alias("shared"))
    n = F.col("toxic") + F.col("ordinary")
    high = high.select("*", n.alias("n"), F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("low"))
    sums = [F.sum(c).alias(f"all_{c}") for c in ("toxic", "ordinary", "n")]
    contexts = high.groupBy("context").agg(*sums, F.sum(F.least("n", F.lit(DISCOUNT))).alias("rest"))
    common = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + F.col("rest") * F.col("shared")) / F.col("all_n")
    repeats = F.col("n") / F.col("documents")
    joined = high.join(contexts, "context").join(shared, "low").withColumn("common", common).withColumn("repeats", repeats)
    logs = [F.log((F.col(c) / F.col("repeats") + PRIOR) / (F.col(f"all_{c}") * F.col("common") / F.col("repeats") + PRIOR)) for c in ("toxic", "ordinary")]
    return joined.select("gram", (logs[0] - logs[1]).cast("float").alias("ratio"))


class Ratios:
    """Log ratios by 6-gram, 0 for others: a hash table with at least two places a key, told apart by the key."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray):
        self.bits = max(8, int(2 * len(gram)).bit_length())
        home = places(gram, self.bits)
        order = np.argsort(home)
        at = np.arange(len(order))
        at += np.maximum.accumulate(home[order] - at)  # the next free place
        size = max(1 << self.bits, int(at[-1]) + 2 if len(at) else 0)
        self.key, self.ratio = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        self.key[at], self.ratio[at] = gram[order], ratio[order]

    def of(self, gram: np.ndarray) -> np.ndarray:
        at = places(gram, self.bits)
        key = self.key[at]
        while len(other := np.flatnonzero((key != gram) & (key >= 0))):
            at[other] += 1
            key[other] = self.key[at[other]]
        return np.where(key == gram, self.ratio[at], 0).astype(np.float64)


def word_ratios(words: list[bytes], ratios: Ratios) -> np.ndarray:
    """The log ratio of each word: the sum over its characters and the space that ends it."""
    chars = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    return np.add.reduceat(ratios.of(grams(chars, HIGH)), np.flatnonzero(chars[:-1] == 32))


def expressions(words: DataFrame, ratios: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(word, place, level0, level1) of the words(word) that count: their place in the bitmap and the excess over each level."""
    spark, parts = words.sparkSession, []
    n_blocks = max(1, -(-ratios.count() // block_grams))
    for b in range(n_blocks):
        rows = ratios.where(F.pmod(F.xxhash64("gram"), F.lit(n_blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast(Ratios(rows["gram"].to_numpy(), rows["ratio"].to_numpy()))
        parts.append(written(words.mapInPandas(_adder(shared, None if n_blocks > 1 else LEVELS[0]), "word binary, ratio double"), "word_ratios"))
        shared.unpersist()
    total = parts[0] if n_blocks == 1 else reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("ratio").alias("ratio"))
    levels = [F.greatest(F.lit(0.0), F.least(F.lit(MOST), F.col("ratio") - x)).alias(f"level{i}") for i, x in enumerate(LEVELS)]
    return total.where(F.col("ratio") > LEVELS[0]).select("word", F.pandas_udf(_places, "long")("word").alias("place"), *levels)


def _adder(shared, above: float | None):
    """Of each word what a block of log ratios adds up to; only words above a limit, or not 0."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ratio = word_ratios(list(frame["word"]), shared.value) if len(frame) else np.zeros(0)
            keep = ratio > above if above is not None else ratio != 0
            yield pd.DataFrame({"word": frame["word"][keep], "ratio": ratio[keep]})

    return add


def _places(words: pd.Series) -> pd.Series:
    return pd.Series((word_hashes(list(words)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64))


def bitmap(found: DataFrame) -> np.ndarray:
    """The bits of found(place) as 2**FILTER_BITS / 64 words, whatever the number of places."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    rows = found.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _hits(shared):
    """Of each text its words that may be expressions, with their shares of all its words, and a row b"" that counts the text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keys, ties, words, counts, shares = [], [], [], [], []
            for key, tie, text in zip(frame["key"], frame["tie"], frame["text"]):
                own = (text or b"").split()
                place = word_hashes(own) >> np.uint64(64 - FILTER_BITS)
                maybe = np.flatnonzero(shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                times = Counter(own[i] for i in maybe.tolist())
                if times:
                    words += [b"", *times]
                    counts += [0.0, *times.values()]
                    shares += [1.0, *(x / len(own) for x in times.values())]
                    keys += [key] * (len(times) + 1)
                    ties += [tie] * (len(times) + 1)
            yield pd.DataFrame({"key": np.array(keys, np.int64), "tie": np.array(ties, np.int64), "word": words, "times": np.array(counts, float), "share": np.array(shares, float)})

    return find


def logistic_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the columns of x, and the intercept, of Platt's curve, with his smoothed targets, by Newton steps."""
    up, down = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _key() -> list[Column]:
    """What a document's values are kept by; they depend on the text alone, so rows without doc_id may share a key."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key"), F.xxhash64("text").alias("tie")]


def features() -> list[Column]:
    """What the curve is of, from the columns of Toxicity.values; all 0 where these are null."""
    level0, level1, count = (F.coalesce(c, F.lit(0.0)) for c in ("level0", "level1", "count"))
    return [level0, F.log1p(level1 / KNEE), F.log1p(count)]


class Toxicity:
    """Learned from docs(doc_id, text) and labels(doc_id, toxic).

    ``values`` has a row (key, tie, level0, level1, count) for every document of docs that holds an expression; all others
    have the values 0.  ``score`` maps them to 0..1.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        keys = docs.select("doc_id", *_key())
        docs = docs.select("doc_id", *_key(), F.lower("text").cast("binary").alias("text"))
        usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 3) != 1)
        usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = [min(1 / CURVE_FOLDS, CURVE_ROWS / 2 / max(n.get(k, 0), 1)) for k in (0, 1)]
        drawn = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1_000_000))
        usable = usable.withColumn("curve", drawn < F.when(F.col("toxic") == 1, int(share[1] * 1_000_000)).otherwise(int(share[0] * 1_000_000)))
        # labels grow with the corpus: merged, never broadcast
        counted = docs.join(usable.where("NOT curve").hint("merge"), "doc_id").select("text", "toxic")
        sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary", "documents")]
        high = written(counted.mapInPandas(_class_counts, "gram long, toxic long, ordinary long, documents long").groupBy("gram").agg(*sums), "classes")
        words = written(docs.select("text").mapInPandas(_vocabulary, "word binary").distinct(), "words")
        low = written(continuations(words), "continuations")  # read twice
        ratios = written(log_ratios(high, low), "ratios")
        found = written(expressions(words, ratios), "expressions")
        shared = spark.sparkContext.broadcast(bitmap(found))
        hits = docs.select("key", "tie", "text").mapInPandas(_hits(shared), "key long, tie long, word binary, times double, share double")
        # a frequent expression is many partitions
        levels = [f"level{i}" for i in range(len(LEVELS))]
        marker = spark.range(1).select(F.lit(b"").alias("word"), *[F.lit(0.0).alias(c) for c in levels])
        met = salted_join(hits, found.select("word", *levels).unionByName(marker).hint("merge"), "word", "tie")
        rows = F.sum(F.when(F.octet_length("word") == 0, 1))
        sums = [F.sum(F.col("share") * F.col(c)).alias(c) for c in levels] + [F.sum(F.col("times") * F.col(levels[-1])).alias("count")]
        summed = met.groupBy("key", "tie").agg(rows.alias("rows"), *sums)
        self.values = written(summed.select("key", "tie", *[(F.col(c) / F.col("rows")).alias(c) for c in (*levels, "count")]).where(f"{levels[0]} > 0"), "values")

        def measured(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
            """Values and classes of the documents of a bounded sample of labels."""
            rows = keys.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").distinct().join(self.values, ["key", "tie"], "left")
            rows = rows.select("toxic", *[x.alias(f"x{i}") for i, x in enumerate(features())]).toPandas()
            return rows.drop(columns="toxic").to_numpy(float), rows["toxic"].to_numpy(float)

        x, y = measured(usable.where("curve"))
        if len(set(y)) < 2:  # too few labels to keep any apart
            few = usable.orderBy(F.xxhash64("doc_id"), "doc_id")
            x, y = measured(few.where("toxic = 1").limit(CURVE_ROWS // 2).unionByName(few.where("toxic = 0").limit(CURVE_ROWS // 2)))
            share = [min(1.0, CURVE_ROWS / 2 / max(n.get(k, 0), 1)) for k in (0, 1)]
        self.curve = None
        if len(set(y)) == 2:
            self.curve = logistic_curve(x, y)
            self.curve[-1] -= math.log(share[1] / share[0])  # the classes as often as among all labels

    @property
    def plain(self) -> float:
        """The score of a text without expressions."""
        return 0.5 if self.curve is None else 1 / (1 + math.exp(-self.curve[-1]))

    def score(self) -> Column:
        """0 to 1 for the columns of values, null for 0."""
        if self.curve is None:
            return F.lit(0.5)
        z = reduce(Column.__add__, [float(w) * x for w, x in zip(self.curve[:-1], features())], F.lit(float(self.curve[-1])))
        return 1 / (1 + F.exp(-z))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Toxicity(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", *_key()).join(model.values, ["key", "tie"], "left")
    out = out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def harmless(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """Pipeline stage: the rows of docs that score under the limit, all columns as they are."""
    model = Toxicity(docs.select("doc_id", "text"), labels)
    rejected = model.values.where(model.score() >= limit).select("key", "tie")
    rows = docs.select(*_key(), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    if model.plain < limit:
        return rows.join(rejected, ["key", "tie"], "left_anti").select("row.*")
    return rows.join(model.values.join(rejected, ["key", "tie"], "left_anti"), ["key", "tie"], "left_semi").select("row.*")
