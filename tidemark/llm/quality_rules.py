r"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

The measures are Catalyst expressions over one row: no shuffle, no explode, no Python.  RULES is the
table; ``compile_rules`` turns it into one boolean column per rule and their conjunction.

Words in repeated 5-word windows: every window is hashed (xxhash64 of its five words); only texts in
which two hashes agree sort (hash, position) pairs, keep the positions whose neighbour has the same
hash, and add up the gaps between kept positions, at most five words each.  That is O(n log n) in the
words of one text.  Equal windows always agree; that two different windows of one text of n words
agree has a chance of about n*n / 2**65.

Defined results: null or blank text has no words and fails the base rules; repeated rows are each
judged; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, table, words

#: Frequent function words of the languages in the corpus.
STOP_WORDS = sorted(set((
    "the of and a in to is was that for it as on be at by with from this are or an not have "
    "der die das und ist von mit den zu im ein eine für auf dem des nicht als auch es "
    "le la les de des du et un une est que qui dans en au aux pour par sur avec ce il elle "
    "el los las del y que en un una es por con para se su al no lo como"
).split()))


@dataclass(frozen=True)
class Rule:
    """measure / per must lie in [low, high]; rules over texts shorter than min_words don't apply."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The thresholds. Base rules decide base_failed, all rules decide kept.
BASE = (
    Rule("words", "n_words", None, 10, None),
    Rule("repeat_words", "n_repeat_words", "n_words", None, 0.20),
)
RULES = (
    *BASE,
    Rule("mean_word_chars", "word_chars", "n_words", 2, 14),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.50),
    Rule("upper_case", "n_upper", "word_chars", None, 0.40),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None, 50),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(ws: Column, n: int = 5) -> Column:
    """How many words of ws lie in n-word windows that occur twice or more in ws."""

    def covered(pairs: Column) -> Column:
        size = F.size(pairs)
        same = F.filter(
            F.transform(
                pairs,
                lambda p, i: F.when(
                    ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < size - 1) & (F.get(pairs, i + 1)["h"] == p["h"])),
                    p["i"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return _let(
            F.sort_array(same),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - p, F.lit(n)))),
                F.lit(0),
                lambda total, gap: total + gap,
            ),
        )

    def counted(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return _let(
            F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n))),
            lambda hs: F.when(
                F.size(F.array_distinct(hs)) < F.size(hs),
                _let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered),
            ).otherwise(F.lit(0)),
        )

    return _let(ws, counted).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the measures that the rules use, each bigint."""
    text = F.coalesce("text", F.lit(""))
    ws = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return (
        docs.select("doc_id", "text", words(F.col("text")).alias("_words"), lines.alias("_lines"))
        .select(
            "doc_id",
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(ws).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(ws, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )
    )


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """Name of each rule -> boolean column, true where the row passes."""
    out = {}
    for r in rules:
        value, per = F.col(r.measure), F.col(r.per) if r.per else F.lit(1)
        checks = [value >= r.low * per] * (r.low is not None) + [value <= r.high * per] * (r.high is not None)
        passed = checks[0] if len(checks) == 1 else checks[0] & checks[1]
        out[r.name] = (F.col("n_words") < r.min_words) | passed if r.min_words else passed
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Measures, base_failed, kept and the names of the failed rules of each row of docs(doc_id, text)."""
    m = measures(docs)
    passed = compile_rules(rules)
    base_ok = F.lit(True)
    for c in compile_rules(base).values():
        base_ok = base_ok & c
    failed = F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in passed.items()]), lambda x: x.isNotNull())
    m = m.withColumn("base_failed", ~base_ok).withColumn("failed_rules", F.array_join(failed, ","))
    return m.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
hashed AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM windows),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM hashed) WHERE n >= 2),
repeated AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN (__STOP__))) AS n_stop_words
  FROM w LEFT JOIN repeated USING (doc_id)),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words
         AND n_symbols <= 0.10 * n_words AND n_dup_lines <= 0.50 * n_lines AND n_upper <= 0.40 * word_chars
         AND (n_words < 50 OR n_stop_words >= 0.05 * n_words) AS kept
FROM j
""".replace("__STOP__", ", ".join(f"'{x}'" for x in STOP_WORDS))
