r"""Substring dedup: relative Lempel-Ziv parsing of documents against indexed reference blocks.

Blocks.  Every window of 50 words chooses an anchor, the 20-word shingle of smallest hash in it; the
same words choose the same anchor wherever they stand.  An anchor and the 30 words on either side
(fewer at a document's ends) are a block.  A block holds every 50-word window that contains its anchor,
so two equal blocks share all of them.  There are about 2 anchors per 32 words.

Index.  The reference index maps each distinct block of an anchor that several documents share to the
smallest document holding it.  Grouping is by (anchor hash, block hash), 128 bits together, with min
pre-aggregated before the shuffle; anchors of one document only are dropped at once.

Parse.  A document's block that equals a reference block of a smaller document can be copied whole.  From
left to right each factor takes the leftmost words not yet copied and is extended greedily, block by
block, as long as the next block overlaps it and names the same reference document; then the next factor
begins where it ends.  ``factors`` holds them with their references, and those of at least 50 words, or next to
one another, are duplicate spans, since every word of a copied block lies in one of its windows.

Factor boundaries.  Where a passage begins or ends inside a block the blocks differ.  Only for anchors
with more than one distinct block, and only in the smallest document of each such block, the windows
that chose the anchor and lie in no copied block are indexed one by one; a window that also starts in a
smaller document extends the span.  Copies never reach this step, so it grows with distinct texts,
not with the size of a group of copies.

The union of both is exactly the words covered by a window that starts in a smaller document.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  Defined results: null or empty text has no words; texts
under 50 words lose nothing; rows repeating a doc_id are one document and each lose the
same sequences; rows with a null doc_id neither lose words nor serve as reference; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words, salted_join, table, written
from tidemark.llm.shingles import MULTIPLIER, SECOND_MULTIPLIER, mixed, window_hashes, word_hashes

WINDOW, ANCHOR = 50, 20
SIDE = WINDOW - ANCHOR
CUT = "n_words long, n_removed long, kept string, spans array<struct<start: int, length: int>>, factors array<struct<start: int, length: int, source: long>>"


def anchors_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, for each 50-word window the place of its anchor: the leftmost smallest shingle)."""
    g = window_hashes(h, ANCHOR)
    best, at, size = g, np.arange(len(g)), 1
    while size * 2 <= SIDE + 1:
        right = best[size:] < best[:-size]
        best, at = np.where(right, best[size:], best[:-size]), np.where(right, at[size:], at[:-size])
        size *= 2
    step = SIDE + 1 - size
    if step:
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
    return g, at


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(SECOND_MULTIPLIER), -1, 1 << 64))
        size = max(n, 1 << 15)
        for name, base in (("up", SECOND_MULTIPLIER), ("down", inverse)):
            _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


def block_hashes(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the words around each anchor, and of how far they reach."""
    up, down = _power_table(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    low, high = np.maximum(places - SIDE, 0), np.minimum(places + WINDOW, len(h))
    reach = (places - low).astype(np.uint64) * np.uint64(1 << 16) + (high - places).astype(np.uint64)
    return mixed((total[high] - total[low]) * down[low] + reach * MULTIPLIER)


class Parse:
    """The anchors and blocks of one text of at least 50 words."""

    def __init__(self, words: list[bytes]):
        self.h = word_hashes(words)
        self.g, self.at = anchors_of(self.h)
        self.places = self.at[np.concatenate([[True], self.at[1:] != self.at[:-1]])]
        self.blocks = block_hashes(self.h, self.places)

    def places_of(self, blocks) -> np.ndarray:
        return self.places[np.isin(self.blocks.astype(np.int64), np.asarray(blocks, np.int64))]

    def windows(self) -> np.ndarray:
        return window_hashes(self.h, WINDOW, SECOND_MULTIPLIER).astype(np.int64)


def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        docs, hashes, blocks = [], [], []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            words = byte_words(text)
            if len(words) < WINDOW:
                continue
            p = Parse(words)
            own, first = np.unique(p.blocks, return_index=True)  # text that repeats itself has equal blocks
            docs.append(np.full(len(own), doc, np.int64))
            hashes.append(p.g[p.places[first]].astype(np.int64))
            blocks.append(own.astype(np.int64))
        if docs:
            yield pd.DataFrame({"anchor": np.concatenate(hashes), "block": np.concatenate(blocks), "doc_id": np.concatenate(docs)})


def _boundary_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        parts = []
        for doc, text, copied, open_ in zip(frame["doc_id"], frame["text"], frame["copied"], frame["open"]):
            words = byte_words(text)
            if len(words) < WINDOW:
                continue
            p = Parse(words)
            places = p.places_of(copied)
            wanted = np.zeros(len(p.g), bool)
            wanted[p.places_of(open_)] = True
            i = np.flatnonzero(wanted[p.at] & ~_marked(len(p.at), places - SIDE, places + 1))
            if len(i):
                parts.append(pd.DataFrame({"anchor": p.g[p.at[i]].astype(np.int64), "window": p.windows()[i], "doc_id": doc}).drop_duplicates())
        if parts:
            yield pd.concat(parts)


def factors_of(n: int, places: np.ndarray, sources: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, source) of the greedy parse: copied blocks around ordered places, and what each was copied from."""
    out: list[list[int]] = []
    for place, source in zip(places.tolist(), sources.tolist()):
        start, end = max(place - SIDE, 0), min(place + WINDOW, n)
        if out and start <= out[-1][1]:
            if source == out[-1][2]:
                out[-1][1] = max(end, out[-1][1])
                continue
            start = out[-1][1]
        if start < end:
            out.append([start, end, source])
    return [(start, end - start, source) for start, end, source in out]


def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, blocks, sources, windows in batches:
        rows = []
        for text, copied, source, again in zip(texts, blocks, sources, windows):
            words = byte_words(text)
            n, spans, factors = len(words), [], []
            if n >= WINDOW and (copied is not None or again is not None):
                p = Parse(words)
                if copied is not None:
                    copied, source = np.asarray(copied, np.int64), np.asarray(source, np.int64)
                    order = np.argsort(copied)
                    own = p.blocks.astype(np.int64)
                    at = np.minimum(np.searchsorted(copied[order], own), len(copied) - 1)
                    found = copied[order][at] == own
                    factors = factors_of(n, p.places[found], source[order][at[found]])
                starts = np.flatnonzero(np.isin(p.windows(), np.asarray(again, np.int64))) if again is not None else np.zeros(0, np.int64)
                begin = np.array([f[0] for f in factors], np.int64)
                end = np.array([f[0] + f[1] for f in factors], np.int64)
                gone = _marked(n, np.concatenate([begin, starts]), np.concatenate([end, starts + WINDOW]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                words = [words[i] for i in np.flatnonzero(~gone)]
            rows.append((n, n - len(words), b" ".join(words).decode(), spans, [dict(zip(("start", "length", "source"), f)) for f in factors]))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "spans", "factors"])


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text as binary) -> doc_id, copied (hashes of copied blocks), sources (where each is copied from),
    again (hashes of boundary windows)."""
    anchors = docs.where("doc_id IS NOT NULL").mapInPandas(_anchors, "anchor long, block long, doc_id long")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = written(salted_join(anchors, several, "anchor", "doc_id"), "shared_anchors")
    index = shared.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"))
    varied = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_blocks")).where("n_blocks > 1").select("anchor", F.lit(True).alias("varied"))
    index = salted_join(index, varied, "anchor", "block", how="left").withColumn("varied", F.coalesce("varied", F.lit(False)))
    index = written(index, "reference_blocks")
    judged = salted_join(shared, index, ["anchor", "block"], "doc_id").where("first < doc_id OR varied")
    copy = F.col("first") < F.col("doc_id")
    found = F.collect_set(F.when(copy, F.struct("block", "first")))
    parse = judged.groupBy("doc_id").agg(found.alias("found"), F.collect_set(F.when(~copy, F.col("block"))).alias("open"))
    parse = written(parse.select("doc_id", F.col("found.block").alias("copied"), F.col("found.first").alias("sources"), "open"), "parse")

    bounds = docs.join(parse.where(F.size("open") > 0), "doc_id").mapInPandas(_boundary_windows, "anchor long, window long, doc_id long")
    bounds = written(bounds, "boundary_windows")
    twice = bounds.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    starts = salted_join(bounds, twice, ["anchor", "window"], "doc_id").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("again"))
    return parse.where(F.size("copied") > 0).select("doc_id", "copied", "sources").join(starts, "doc_id", "full")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept (words joined by a space), spans (word start, length),
    factors (start, length, source: the document that holds the words as well)."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = docs.join(repeats(docs), "doc_id", "left")
    return out.select("doc_id", F.pandas_udf(_cut, CUT)("text", "copied", "sources", "again").alias("cut")).select("doc_id", "cut.*")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
again AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM again, (SELECT unnest(range(0, 50)) AS o)),
word AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) > 0),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS n_removed
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
