"""Token counts: an exact histogram of encoded lengths answers totals, quantiles and truncated totals.

Each text is encoded whole by a public byte-level BPE vocabulary, a file whose path is a parameter; its
bytes, about 1 MB whatever the corpus, are broadcast and turned into an encoder once per task.

The vocabulary's pattern looks ahead after white space, which its matcher does by recursion, so long runs of
white space are cut out at the borders where the pattern itself would cut, and encoded as pieces.

Documents are then aggregated by length (partial sums before the shuffle, so no hot key).  Suffix sums
over the distinct lengths answer every context limit L:  sum(min(length, L)) = tokens in documents of
at most L tokens + L * documents longer than L.

The running sums are two-level, over ranges of lengths and then inside each range, so no task gathers
all lengths.  Defined results: null or empty text has length 0; repeated rows count each; empty input
gives an empty histogram; doc_id and extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is cut out from this many characters on.
LONG_RUN = 512
#: Lengths per range of the two-level running sums.
RANGE = 4096


def encoded_length(vocabulary: bytes):
    """A function text -> number of tokens, for use inside one worker."""
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    codec = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    runs = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")

    def length(text: str | None) -> int:
        n, at = 0, 0
        for run in runs.finditer(text or ""):
            # the last character of a run that a word follows belongs to the next piece
            end = run.end() if run.end() == len(text) else run.end() - 1
            n += len(codec.encode_ordinary(text[at : run.start()])) + len(piece.encode_ordinary(text[run.start() : end]))
            at = end
        return n + len(codec.encode_ordinary(text[at:] if at else text)) if text else 0

    return length


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens added to (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        length = encoded_length(shared.value)
        for texts in batches:
            yield pd.Series([length(x) for x in texts], dtype="int64")

    return docs.withColumn("n_tokens", F.pandas_udf(count, "long")(F.col("text")))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct n_tokens: n_docs and, with every limit answered, the sums below and above it.

    docs_up_to, tokens_up_to: documents of at most n_tokens, and their tokens.  docs_over, tokens_over:
    the suffix sums.  truncated_tokens: what a context limit of n_tokens keeps of all documents.
    quantile: share of documents of at most n_tokens.
    """
    # read twice below, and encoding is what costs
    by_length = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths").withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    parts = by_length.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("part_docs").over(everything).alias("all_docs"),
        F.sum("part_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = by_length.join(parts, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_up_to"),
        (F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_up_to"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        (F.col("all_docs") - F.col("docs_up_to")).alias("docs_over"),
        (F.col("all_tokens") - F.col("tokens_up_to")).alias("tokens_over"),
        (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_up_to"))).alias("truncated_tokens"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that a context limit keeps, documents it truncates; any limit, also between lengths."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(d * F.least(n, F.lit(limit))), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(n > limit, d)), F.lit(0)).alias("truncated_docs"),
        F.coalesce(F.sum(d * n), F.lit(0)).alias("all_tokens"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents").select("text")))
