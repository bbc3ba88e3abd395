"""Mixing sources to target weights, by blocks of equal length.

The words of each source are laid end to end in doc_id order and cut into blocks of ``block_words``.
The mix is a fixed number of slots, dealt to output shards.  How many slots of a shard each source
gets is a multinomial draw: shards belong to groups, a group's slots per source are the source's share
by cumulative rounding, and inside a group every shard draws from what the group has left, which is the
multinomial given its totals; so sources hit their targets to within a block or two.  Slot t of a
source of n blocks shows block  permutation(t // n)[t % n] , a keyed Feistel permutation of the
source's block numbers for each pass, so every block is used floor or ceil of slots/n times.  Blocks
meet their slots in an equi-join on (source, block).

Offsets are prefix sums over (source, bucket) totals and then inside buckets of hundreds of
documents, so a hot source is never one task.  Sources are few (one row each): their weights and
targets are computed in Spark over the aggregated table.

Targets: shares of all words by weights 1, 2, 3, 1, ... over sources by code point (null last), each
at most 3 times its source's words, the excess reshared by weight.  That is one level of water: with
sources sorted by limit/weight, a source is full if its limit/weight is at most the level left by the
full ones before it.

Defined results: null or blank texts have size 0 and take 0; a source without words has target 0;
repeated rows are separate pieces of their source, ordered by doc_id and text; empty input gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, word_count, words, written

#: Least documents per bucket of the two-level offsets, on average; beyond its square, the root of their number,
#: so that neither the buckets nor what lies in one outgrow a task.
BUCKET_DOCS = 512
SHARD_SLOTS = 1024
GROUP_SHARDS = 64


def _sources(sizes: DataFrame, max_times: float) -> DataFrame:
    """source, key (its rank), source_size, target: the water-filling over the table of sources."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("key", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("key") % 3 + 1).cast("double"))
    s = s.withColumn("limit", max_times * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("all_size") - F.col("limit_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("full", F.col("ratio") <= level)
    s = s.withColumn("full_limit", F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0)))
    s = s.withColumn("full_weight", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0.0)))
    rest = (F.col("all_size") - F.col("full_limit")) * F.col("weight") / (F.col("all_weight") - F.col("full_weight"))
    return s.select("source", "key", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(rest).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) sends each index: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        out[walk] = left << shift | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def _draw(group: pd.DataFrame) -> pd.DataFrame:
    """Slots of each shard of one group, per source: draws without replacement from the group's slots."""
    group = group.sort_values("key")
    left = (group["slots_to"] - group["slots_from"]).to_numpy()
    rng = np.random.default_rng([int(group["seed"].iloc[0]), int(group["grp"].iloc[0])])
    at, rows = group["slots_from"].to_numpy().copy(), []
    for shard in range(GROUP_SHARDS):
        got = rng.multivariate_hypergeometric(left, -(-int(left.sum()) // (GROUP_SHARDS - shard)), method="marginals") if left.sum() else left * 0
        rows.append(pd.DataFrame({"key": group["key"].to_numpy(), "blocks": group["blocks"].to_numpy(), "seed": group["seed"].to_numpy(), "shard": int(group["grp"].iloc[0]) * GROUP_SHARDS + shard, "first": at.copy(), "n": got}))
        at, left = at + got, left - got
    out = pd.concat(rows)
    return out[out["n"] > 0]


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for x in rows.itertuples(index=False):
            t = np.arange(x.first, x.first + x.n)
            block = np.empty(len(t), np.int64)
            for turn in np.unique(t // x.blocks):
                own = t // x.blocks == turn
                block[own] = permuted(t[own] % x.blocks, x.blocks, int(x.seed * 1_000_003 + x.key * 8_191 + turn))
            yield pd.DataFrame({"key": x.key, "block": block, "shard": x.shard, "slot": t})


class Mix:
    """The parts of a mix over docs(doc_id, source, text), each a DataFrame.

    sources: source, key, source_size, target, blocks, slots.  rows: every document with its source's
    figures and begin, its first word's place in the source.  slots(): key, block, shard, slot.
    """

    def __init__(self, docs: DataFrame, block_words: int = 64, max_times: int = 3, seed: int = 0):
        self.docs, self.block_words, self.seed = docs.select("doc_id", "source", "text"), block_words, seed
        sizes = written(self.docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
        sources = _sources(sizes, max_times).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        # by the mean size of the source's blocks, of which the last may be short
        n_slots = F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
        self.sources = sources.withColumn("slots", n_slots.cast("long"))
        n_rows, all_words = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
        n_buckets = max(1, n_rows // max(BUCKET_DOCS, math.isqrt(n_rows)))
        #: Tasks that make slots, a few groups each; the rows behind them are too small for Spark to tell.
        self._tasks = min(10_000, -(-(all_words or 1) // (block_words * SHARD_SLOTS * GROUP_SHARDS)))
        named = sizes.join(self.sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        named = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n_buckets)))
        totals = named.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
        within = named.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        self.rows = within.join(totals, ["key", "bucket"]).withColumn("begin", F.col("base") + F.col("within")).drop("bucket", "base", "within")

    def slots(self) -> DataFrame:
        groups = F.greatest(F.lit(1), F.ceil(F.col("all_slots") / (SHARD_SLOTS * GROUP_SHARDS)))
        per_group = self.sources.where("blocks > 0").withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
        per_group = per_group.select("key", "blocks", "slots", groups.alias("groups")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"))
        cut = lambda g: F.floor(g * F.col("slots") / F.col("groups"))
        per_group = per_group.select("key", "blocks", "grp", F.lit(self.seed).cast("long").alias("seed"), cut(F.col("grp")).alias("slots_from"), cut(F.col("grp") + 1).alias("slots_to"))
        drawn = per_group.repartition(self._tasks, "grp").groupBy("grp").applyInPandas(_draw, "key long, blocks long, seed long, shard long, first long, n long")
        return drawn.mapInPandas(_slots, "key long, block long, shard long, slot long")

    def pieces(self) -> DataFrame:
        """Every document cut at block borders: key, block, begin (of its document), piece_at, piece_words."""
        b = self.block_words
        cut = self.rows.where("size > 0").select("doc_id", "tie", "key", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))).alias("block"))
        at = F.greatest(F.col("begin"), F.col("block") * b)
        end = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select("doc_id", "tie", "key", "block", "begin", at.alias("piece_at"), (end - at).alias("piece_words"))

    def taken(self) -> DataFrame:
        """rows with taken, the words that the mix takes of each, repeats counted."""
        uses = self.slots().groupBy("key", "block").agg(F.count(F.lit(1)).alias("uses"))
        # the planner can't know how many slots a task makes, so it must not choose to broadcast them
        taken = self.pieces().join(uses.hint("merge"), ["key", "block"]).groupBy("key", "begin").agg(F.sum(F.col("piece_words") * F.col("uses")).alias("taken"))
        # an empty document shares its begin with the next one
        out = self.rows.join(taken.hint("merge"), ["key", "begin"], "left")
        return out.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long"))

    def blocks(self) -> DataFrame:
        """The mix itself: shard, slot, key, text of every block drawn (its words joined by a space).

        A text is cut at its block borders in its own row, so pieces carry their own words alone.
        """
        b = self.block_words
        texts = self.docs.withColumn("tie", F.xxhash64("text")).dropDuplicates(["doc_id", "tie"]).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), words(F.col("text")).alias("_words"))
        rows = self.rows.where("size > 0")
        rows = rows.join(texts, rows["doc_id"].eqNullSafe(texts["_id"]) & (rows["tie"] == texts["_tie"]))
        first, last = F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b)

        def piece(block: Column) -> Column:
            at = F.greatest(F.col("begin"), block * b)
            n = F.least(F.col("begin") + F.col("size"), (block + 1) * b) - at
            part = F.array_join(F.slice("_words", (at - F.col("begin") + 1).cast("int"), n.cast("int")), " ")
            return F.struct(block.alias("block"), at.alias("piece_at"), part.alias("part"))

        cut = rows.select("key", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("key", "p.*")
        block = cut.groupBy("key", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_at", "part"))), lambda x: x["part"]), " ").alias("text"))
        return self.slots().join(block.hint("merge"), ["key", "block"]).select("shard", "slot", "key", "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")
