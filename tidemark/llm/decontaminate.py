r"""Benchmark decontamination: containment search for short test items inside long documents.

An item of n distinct 5-word shingles is contained in a document that holds at least ``threshold`` of
them, so such a document misses at most floor((1 - threshold) * n).  Ordered by hash, the item's first
k = floor((1 - threshold) * n) + 1 shingles (its bottom-k MinHash sketch) therefore share at least one
with every document that contains it: the search loses nothing, whatever the length of the document.
Items are partitioned by size (bounds growing by a quarter), and all items of a partition have the
sketch length of its upper bound.  A partition is a table of its own: the hashes of its items' sketches,
its cutoff, which is the largest of them, and the least number of shingles that a document containing one of
its items has.  A document is sketched for each partition that it is large enough for: its MinHash sketch
at the partition's rate is those of its distinct hashes that don't exceed the cutoff, so a long document
keeps many and a short one few, and none that could match is missed.

Documents are read once and never shuffled: each task sketches whole texts, probes the partitions, and
verifies the few candidates by exact containment of word tuples, not of hashes, taken only from where the
candidates' hashes stand in the text.  The items are a stated query set: they are measured first and go
out in blocks of bounded size, one pass over the documents per block.

Words are ``[^\x20\x09-\x0D]+`` of the lower-cased text.  Defined results: items of fewer than five
words and null or empty texts have no shingles and match nothing; repeated item ids count as one item
with the shingles of all rows; repeated documents report one row; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words, table, word_count, written
from tidemark.llm.shingles import window_hashes, word_hashes

#: Words of test items per block: what one broadcast holds at most, but for a single longer item.
BLOCK_WORDS = 250_000
GROWTH = 1.25
#: 4 MB in a broadcast.
MAYBE_BITS = 22
MATCH = "array<struct<item_id: long, n_shingles: long, n_shared: long>>"


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def lower_bytes(text: Column) -> Column:
    return F.lower(text).cast("binary")


@dataclass(frozen=True)
class Partition:
    """Items of similar size: sorted hashes of their sketches, and for each hash the items that hold it."""

    least: int
    hashes: np.ndarray
    items: list[list[int]]

    def candidates(self, hashes: np.ndarray, size: int) -> set[int]:
        """Items that share a hash with the sketch of a document of ``size`` distinct, sorted hashes."""
        if size < self.least:
            return set()
        sketch = hashes[: np.searchsorted(hashes, self.hashes[-1], side="right")]
        at = np.searchsorted(self.hashes, sketch)
        return {i for x in at[self.hashes[at] == sketch].tolist() for i in self.items[x]}


class Items:
    """One block of items: the tables of its size partitions, and the items' shingles for the verification."""

    def __init__(self, texts: dict[int, list[bytes]], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        own: dict[int, set[tuple[bytes, ...]]] = defaultdict(set)
        for item, rows in texts.items():
            for text in rows:
                own[item] |= shingles(byte_words(text), n)
        self.shingles = {k: v for k, v in own.items() if v}
        self.hashes = {k: np.sort(np.concatenate([window_hashes(word_hashes(list(x)), n) for x in v])) for k, v in self.shingles.items()}
        sizes: dict[int, list[int]] = defaultdict(list)
        for item, v in self.shingles.items():
            sizes[int(np.log(len(v)) / np.log(GROWTH))].append(item)
        self.partitions = [self._partition(part, items) for part, items in sorted(sizes.items())]
        #: By which bits any partition's hashes begin: a quick look before the tables, which few shingles pass.
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        for p in self.partitions:
            self.maybe[(p.hashes >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)] = True

    def _partition(self, part: int, items: list[int]) -> Partition:
        held = [len(self.shingles[i]) for i in items]
        upper = max(*held, int(GROWTH ** (part + 1)))
        k = int((1 - self.threshold) * upper + 1e-9) + 1
        holders: dict[int, list[int]] = defaultdict(list)
        for item in items:
            for x in self.hashes[item][:k].tolist():
                holders[x].append(item)
        hashes = np.array(sorted(holders), np.uint64)
        return Partition(int(np.ceil(self.threshold * min(held) - 1e-9)), hashes, [holders[x] for x in hashes.tolist()])

    def find(self, text: bytes | None) -> list[tuple[int, int, int]]:
        words = byte_words(text)
        if len(words) < self.n or not self.partitions:
            return []
        h = window_hashes(word_hashes(words), self.n)
        seen = np.unique(h[self.maybe[(h >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)]])
        if not len(seen):
            return []
        size = len(np.unique(h))
        found = sorted(set().union(*(p.candidates(seen, size) for p in self.partitions)))
        if not found:
            return []
        near = np.flatnonzero(np.isin(h, np.concatenate([self.hashes[i] for i in found])))
        own = {tuple(words[i : i + self.n]) for i in near.tolist()}
        shared = [(i, len(self.shingles[i]), len(self.shingles[i] & own)) for i in found]
        return [x for x in shared if x[2] >= self.threshold * x[1] - 1e-9]


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[dict[int, list[bytes]]]:
    """The items in blocks of about block_words words: few blocks, each bounded, whatever the table's size."""
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_words) if total > block_words else 1)
    for b in range(n_blocks):
        texts: dict[int, list[bytes]] = defaultdict(list)
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).select("item_id", lower_bytes(F.col("text"))).toLocalIterator():
            texts[item].append(bytes(text or b""))
        yield texts


def _finder(shared: Broadcast):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[{"item_id": i, "n_shingles": a, "n_shared": b} for i, a, b in shared.value.find(x)] for x in rows])

    return F.pandas_udf(find, MATCH)


def _passes(docs: DataFrame, items: DataFrame, n: int, threshold: float, block_words: int) -> Iterator[Column]:
    """For each block of items, the matches of a row's text with it; a block is let go when the next is asked for."""
    for texts in item_blocks(items, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Items(texts, n, threshold))
        yield _finder(shared)(lower_bytes(F.col("text")))
        shared.unpersist()


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs: doc_id, item_id, n_shingles (of the item), n_shared, containment."""
    docs, blocks = docs.select("doc_id", "text"), []
    for found in _passes(docs, items, n, threshold, block_words):
        pairs = docs.select("doc_id", F.explode(found).alias("m")).groupBy("doc_id", "m.item_id")
        blocks.append(written(pairs.agg(F.max("m.n_shingles").alias("n_shingles"), F.max("m.n_shared").alias("n_shared")), "contained"))
    return reduce(DataFrame.unionByName, blocks).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pipeline stage: the rows of docs that contain no item, all columns as they are."""
    for k, found in enumerate(_passes(docs, items, n, threshold, block_words)):
        if k:  # else one task would hold all blocks
            docs = written(docs, "undecided")
        docs = docs.where(F.size(found) == 0)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
di AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5),
bi AS (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5),
ds AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS s FROM di),
bs AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 4) AS s FROM bi),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
