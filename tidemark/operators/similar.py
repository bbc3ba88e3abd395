"""Similarity joins of strings by Jaro, complete for any threshold, without comparing all with all.

Jaro is (m/|x| + m/|y| + (m - t)/m) / 3 for m matched characters, of which t are out of order.  So a pair that reaches a
threshold s has at least  m >= (3 s - 1) |x| |y| / (|x| + |y|)  matches, and m is at most what the two multisets
of characters have in common.  A string's characters, each numbered by its occurrence (``l1 l2 e1``), make that multiset a
set.  For every length that a partner may have, strings that need m common elements must share one of their
rarest  |x| - m + 1 .  Pairs that do meet in an equi-join, there their common elements are counted, and only what passes is
compared, once.

The lower the threshold the less this can rule out: below 2/3 a string may resemble others of any length, and short
strings that share a letter often do, so candidates then grow with the square of the number of distinct strings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro: equal characters within half the longer length, less half of those out of order, rounded down."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return float(x == y)
        reach, used, mine = max(len(x), len(y)) // 2 - 1, [False] * len(y), []
        for i, c in enumerate(x):
            for k in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if not used[k] and y[k] == c:
                    used[k] = True
                    mine.append(c)
                    break
        if not mine:
            return 0.0
        theirs = [c for c, u in zip(y, used) if u]
        moved = sum(p != q for p, q in zip(mine, theirs)) // 2
        m = len(mine)
        return (m / len(x) + m / len(y) + (m - moved) / m) / 3

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def elements(value: Column) -> Column:
    """The characters of a string, each with the number of its occurrence."""
    chars = F.split(value, "(?!^)(?!$)")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _needed(x: Column, y: Column, threshold: float) -> Column:
    """The least number of matches of strings of these lengths."""
    return F.greatest(F.lit(1), F.ceil((3 * threshold - 1) * x * y / (x + y) - 1e-9).cast("int"))


def jaro_join(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """(a, b, similarity) for every pair a < b of distinct non-empty values whose similarity, to 9 places, is at least threshold."""
    names = df.select(F.col(value).alias("v")).where("v <> ''").distinct().select("v", F.length("v").alias("n"), elements(F.col("v")).alias("e"))
    # rare elements first: what two strings must share lies among their rarest
    one = names.select("v", "n", F.explode("e").alias("x"))
    rare = one.groupBy("x").agg(F.count(F.lit(1)).alias("held"))
    ordered = one.join(rare, "x").groupBy("v", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("held", "x"))), lambda s: s["x"]).alias("e"))
    #: As many as there are lengths, at most the longest string's.
    lengths = [r[0] for r in names.select("n").distinct().collect()]
    if not lengths:
        return df.select(F.col(value).alias("a"), F.col(value).alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    kept = ordered.select("*", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("other"))
    kept = kept.withColumn("need", _needed(F.col("n"), F.col("other"), threshold)).where(F.col("need") <= F.least("n", "other"))
    kept = kept.select("*", F.explode(F.slice("e", 1, F.col("n") - F.col("need") + 1)).alias("x"))
    key = [F.least("n", "other").alias("low"), F.greatest("n", "other").alias("high"), "x"]
    shorter = kept.where("n <= other").select(*key, "need", F.col("v").alias("p"), F.col("e").alias("p_e"))
    longer = kept.where("n >= other").select(*key, F.col("v").alias("q"), F.col("e").alias("q_e"))
    met = shorter.join(longer, ["low", "high", "x"])
    # of equally long ones each pair meets both ways round; a pair that shares several rare elements passes at the rarest
    common = F.array_intersect("p_e", "q_e")
    passed = met.where((F.col("p") != F.col("q")) & ((F.col("low") < F.col("high")) | (F.col("p") < F.col("q"))) & (F.size(common) >= F.col("need")) & (F.get(common, F.lit(0)) == F.col("x")))
    pairs = passed.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return pairs.select("a", "b", F.round(jaro_similarity("a", "b"), 9).alias("similarity")).where(F.col("similarity") >= threshold)
