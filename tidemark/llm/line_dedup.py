r"""Line dedup: drop lines that many documents share, keep one carrier, reassemble by position.

Lines are exploded once with their positions; those whose normalised form (stripped of
``[\x20\x09-\x0D]``, A-Z lower-cased) is long enough are written as (document, position, 128-bit hash).
``count(DISTINCT doc)`` is pre-aggregated before its shuffles, so a line in a third of all documents costs
one row per task.  The hashes over the threshold, few against the lines, are repeated over salts and joined
back to the written lines, so a hot hash is many partitions; the positions that a document loses are
gathered, and each whole text is put together again from the others.

Defined results: null or empty text is one empty line; rows with a null doc_id neither count nor lose
lines; repeated rows of a document count once and are each returned; rows of one doc_id with several texts
are told apart by a 64-bit hash of the text; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, salted_join, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the lines at the positions that go; those that lose none as they are."""
    for texts, drops in batches:
        out = []
        for text, drop in zip(texts, drops):
            if drop is not None and text is not None:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        yield pd.Series(out, dtype="object")


def _tie(text: str) -> Column:
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, tie, drop): positions of the lines that the document of this doc_id and hash of its text loses."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # the hash of the text is taken before the explosion, or each line would take it again
    lines = docs.select("doc_id", _tie("text").alias("tie"), F.split("text", "\n").alias("lines")).select("doc_id", "tie", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("doc_id", "tie", "pos", line_key(F.col("line")).alias("key"))
    lines = written(lines.where(F.length("key") >= min_chars).select("doc_id", "tie", "pos", F.unhex(F.md5("key")).alias("line")), "lines")
    common = lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("line", "keeper")
    return salted_join(lines, common, "line", "doc_id").where("doc_id <> keeper").groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("drop"))


def _reassembled(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row: a row of docs as it was, drop, kept: its text without what it loses)."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", _tie("text").alias("tie"), row)
    rows = rows.join(dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs), ["doc_id", "tie"], "left")
    loses = F.col("drop").isNotNull()
    kept = F.pandas_udf(_without, "string")(F.when(loses, F.col("row.text")), F.col("drop"))
    return rows.select("row", "drop", F.when(loses, kept).otherwise(F.col("row.text")).alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_lines, n_dropped, kept (the text that stays; null stays null)."""
    out = _reassembled(docs.select("doc_id", "text"), min_chars, min_docs)
    n_lines = F.length("row.text") - F.length(F.translate("row.text", "\n", "")) + 1
    return out.select("row.doc_id", F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Pipeline stage: docs with shared lines cut from text, other columns as they are; n_chars follows the text."""
    out = _reassembled(docs, min_chars, min_docs)
    cols = {"text": F.col("kept").alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("drop").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.select(*[cols.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, pos, line, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
