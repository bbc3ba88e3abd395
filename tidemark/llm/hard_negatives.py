"""Hard-negative mining by distributed radix selection over integer scores.

Vectors are quantised to integers, so scores are exact.  Rows and anchors are packed into blocks of a bounded number of
vectors; every row block meets every anchor block once a round in an equi-join on the row block's salt, and a
matrix product gives the block's scores.  No pair of rows is ever a row of a table.

A window is what a selection is over: an anchor with an interval of scores and the k best to find, first by score, then by
smaller id.  A round cuts each window's interval into 2^digits buckets, counts every block's scores by bucket, sums
the counts, and keeps the bucket in which the kth row lies; rows of better buckets are in, those of worse ones out.
Windows whose kept rows are few are settled; for the others the next digit refines the bucket, and where one score is
left whose rows tie, digits of the ids follow.  Then only rows within the settled windows are gathered, at most k from a
block, and ranked.  A block counts no buckets below the one that holds its own kth row: the kth row of all
lies no lower.

Windows grow with the anchors and compress well as files, so their joins are shuffles (``hint("merge")``): none is broadcast.

Positives are one such selection (an anchor's best rows of its label), negatives another, whose windows the
positives' scores give.  Nothing of it passes through the driver but how many blocks there are, the largest norms and ids,
and whether a window is open.

Defined results: rows without a label, an id or a vector, with a null or non-finite component, or with one beyond
2^18 (whose products would leave 64 bits) take no part; a vector of fewer components than another counts as
ended by zeros, so an empty one scores 0; repeated rows are separate candidates under one id; of the rows that
share an anchor's id the one of the smallest label, then vector, asks, and none is its positive; an anchor without
positives, and a positive without negatives, gives no rows; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SCALE = 256
#: Components beyond this take no part.
LARGEST = float(1 << 18)
ROW_BLOCK = 8192
ANCHOR_BLOCK = 1024
#: Bits of a radix digit, and how many times k rows a settled window may hold.
DIGIT = 8
SLACK = 16

PACKED = "block long, norm double, low_id long, high_id long, ids binary, labels binary, dim int, vectors binary"
WINDOW = ("j", "p", "lo", "hi", "top", "id_lo", "id_hi", "need")


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, q: the rows that take part, with floor(256 x) of every component."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & usable)
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """rows(vec_id, label, q) as blocks of at most ``size`` vectors, each in the order of its ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by("vec_id")
            q = pa.concat_arrays(t["q"].chunks)
            lengths = np.diff(q.offsets.to_numpy())
            dim = max(int(lengths.max()), 1)
            x = np.zeros((len(q), dim), "<i4")
            x[np.arange(dim) < lengths[:, None]] = q.flatten().to_numpy()
            ids, labels = (t[c].to_numpy().astype("<i8") for c in ("vec_id", "label"))
            norm = float(np.sqrt((x.astype("f8") ** 2).sum(axis=1)).max())
            row = [[block], [norm], [int(ids[0])], [int(ids[-1])], [ids.tobytes()], [labels.tobytes()], [dim], [x.tobytes()]]
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield out()
                    block, held, n = block + 1, [], 0
        if n:
            yield out()

    return rows.mapInArrow(pack, PACKED)


def _matrix(dim: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, dim)


def scores_of(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and x, in the narrowest type that holds every partial sum."""
    dim = min(a.shape[1], x.shape[1])  # what is beyond the shorter one would meet zeros
    a, x = a[:, :dim], x[:, :dim]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * dim
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return a.astype(kind) @ x.astype(kind).T


def _shift(width: int, digit: int) -> int:
    return max(0, int(width).bit_length() - digit)


def _counts(score: np.ndarray, ids: np.ndarray, w: dict, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a window and a block's rows in each; score falls, and equal ones have rising ids."""
    first, last = np.searchsorted(-score, [-w["hi"], -w["lo"] + 1])
    if w["lo"] < w["hi"]:
        bucket = (w["hi"] - score[first:last]) >> _shift(w["hi"] - w["lo"], digit)
    else:
        own = ids[first:last]
        own = own[(own >= w["id_lo"]) & (own <= w["id_hi"])]
        bucket = (own - w["id_lo"]) >> _shift(w["id_hi"] - w["id_lo"], digit)
    if len(bucket) > w["need"]:
        bucket = bucket[: np.searchsorted(bucket, bucket[w["need"] - 1], side="right")]
    return np.unique(bucket, return_counts=True)


def _kept(score: np.ndarray, ids: np.ndarray, w: dict, k: int) -> np.ndarray:
    """Places of a block's k best rows that the settled window lets in."""
    first, last = np.searchsorted(-score, [-w["top"], -w["lo"] + 1])
    at = np.arange(first, last)
    if w["lo"] == w["hi"]:
        at = at[(score[at] > w["lo"]) | (ids[at] <= w["id_hi"])]
    return at[:k]


def _cells(same: bool, cell: Callable, schema: pa.Schema) -> Callable:
    """A mapInArrow function over pairs of a row block and an anchor block with windows: cell(anchor id, block, j, score, ids, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in names if c != "windows"}
                windows = batch.column("windows")[i].values
                w = {c: windows.field(c).to_numpy(zero_copy_only=False) for c in WINDOW}
                ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                anchors, anchor_labels = np.frombuffer(r["a_ids"], "<i8"), np.frombuffer(r["a_labels"], "<i8")
                asked, of = np.unique(w["j"], return_inverse=True)
                scores = scores_of(_matrix(r["a_dim"], r["a_vectors"])[asked], _matrix(r["dim"], r["vectors"]))
                by_anchor = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
                out = []
                for n, (j, mine) in enumerate(zip(asked, by_anchor)):
                    ours = labels == anchor_labels[j]
                    able = ours & (ids != anchors[j]) if same else ~ours
                    at = np.flatnonzero(able & (scores[n] >= w["lo"][mine].min()) & (scores[n] <= w["top"][mine].max()))
                    score = scores[n][at].astype(np.int64)
                    order = np.argsort(-score, kind="stable")
                    for m in mine:
                        out += cell(int(anchors[j]), r["a_block"], score[order], ids[at[order]], {c: int(w[c][m]) for c in WINDOW})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


class Selection:
    """The k best candidates of every window: blocks of rows against blocks of anchors."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, same: bool, k: int, digit: int = DIGIT, slack: int = SLACK):
        self.same, self.k, self.digit, self.slack = same, k, digit, slack
        self.anchors = anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("block", "ids", "labels", "dim", "vectors")])
        n, self.low_id, self.high_id = rows.agg(F.count(F.lit(1)), F.min("low_id"), F.max("high_id")).first()
        #: Parts that the row blocks are dealt to; each gets the anchor blocks once.
        self.parts = max(1, min(n, 10_000))
        salted = rows.select("ids", "labels", "dim", "vectors", F.pmod(F.xxhash64("block"), F.lit(self.parts)).alias("salt"))
        self.rows = salted.repartition(self.parts, "salt")

    def _met(self, windows: DataFrame) -> DataFrame:
        per_block = windows.groupBy("a_block").agg(F.collect_list(F.struct(*WINDOW)).alias("windows"))
        asked = self.anchors.hint("merge").join(per_block, "a_block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.parts - 1).cast("long"))))
        # of a salt the right side is held, which is a row block or two; the anchors pass by
        return asked.hint("merge").join(self.rows, "salt").drop("salt")

    def _narrowed(self, windows: DataFrame) -> DataFrame:
        """One digit of every open window."""
        digit = self.digit

        def count(_: int, block: int, score: np.ndarray, ids: np.ndarray, w: dict) -> list[dict]:
            return [{"a_block": block, "j": w["j"], "p": w["p"], "bucket": int(b), "n": int(n)} for b, n in zip(*_counts(score, ids, w, digit))]

        schema = pa.schema([("a_block", pa.int64()), ("j", pa.int32()), ("p", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])
        found = self._met(windows.where("open")).mapInArrow(_cells(self.same, count, schema), "a_block long, j int, p int, bucket long, n long")
        key = ["a_block", "j", "p"]
        sums = found.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")))
        # the bucket of the kth row: the first whose running count reaches what is needed
        hit = sums.hint("merge").join(windows.select(*key, "need"), key).where("upto >= need").groupBy(*key).agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("hit"))
        w = windows.hint("merge").join(hit, key, "left")
        by_id = F.col("lo") == F.col("hi")
        width = F.when(by_id, F.col("id_hi") - F.col("id_lo")).otherwise(F.col("hi") - F.col("lo"))
        bits = F.when(width > 0, F.length(F.bin(width))).otherwise(0)
        size = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), bits - self.digit))
        hi = F.col("hi") - F.col("hit.bucket") * size
        id_lo = F.col("id_lo") + F.col("hit.bucket") * size
        need = F.col("need") - (F.col("hit.upto") - F.col("hit.n"))
        w = w.withColumns({"_size": size, "_by_id": by_id, "_needed": need, "_hi": hi, "_id_lo": id_lo})
        moved = F.col("hit").isNotNull()
        once = lambda c, f: F.when(moved & f, c)
        # few are left, or nothing is left that could tell them apart
        done = (F.lit(self.k) - F.col("_needed") + F.col("hit.n") <= self.k * self.slack) | (F.col("_by_id") & (F.col("_size") == 1))
        return w.select(
            *key,
            "top",
            F.coalesce(once(F.greatest(F.col("lo"), F.col("_hi") - F.col("_size") + 1), ~F.col("_by_id")), F.col("lo")).alias("lo"),
            F.coalesce(once(F.col("_hi"), ~F.col("_by_id")), F.col("hi")).alias("hi"),
            F.coalesce(once(F.col("_id_lo"), F.col("_by_id")), F.col("id_lo")).alias("id_lo"),
            F.coalesce(once(F.least(F.col("id_hi"), F.col("_id_lo") + F.col("_size") - 1), F.col("_by_id")), F.col("id_hi")).alias("id_hi"),
            F.when(moved, F.col("_needed")).otherwise(F.col("need")).alias("need"),
            (F.col("open") & moved & ~done).alias("open"),
        )

    def best(self, windows: DataFrame) -> DataFrame:
        """windows(a_block, j, p, lo, hi) -> anchor_id, a_block, j, p, rank, id, score of the k best rows of each."""
        windows = windows.select("a_block", "j", "p", F.col("hi").alias("top"), "lo", "hi", F.lit(self.low_id).cast("long").alias("id_lo"), F.lit(self.high_id).cast("long").alias("id_hi"), F.lit(self.k).cast("long").alias("need"), F.lit(True).alias("open"))
        windows = written(windows, "windows")
        for _ in range(2 * -(-64 // self.digit) + 2):
            if windows.where("open").isEmpty():
                break
            windows = written(self._narrowed(windows), "windows")
        else:
            raise RuntimeError("windows did not settle")
        k = self.k

        def gather(anchor: int, block: int, score: np.ndarray, ids: np.ndarray, w: dict) -> list[dict]:
            return [{"anchor_id": anchor, "a_block": block, "j": w["j"], "p": w["p"], "id": int(ids[i]), "score": int(score[i])} for i in _kept(score, ids, w, k)]

        schema = pa.schema([("anchor_id", pa.int64()), ("a_block", pa.int64()), ("j", pa.int32()), ("p", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
        found = self._met(windows).mapInArrow(_cells(self.same, gather, schema), "anchor_id long, a_block long, j int, p int, id long, score long")
        rank = F.row_number().over(Window.partitionBy("a_block", "j", "p").orderBy(F.col("score").desc(), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows(vec_id, label, q).

    The negatives of an anchor and a positive have  low * positive <= 100 * score <= high * positive .
    """
    row_block, anchor_block = sizes.pop("row_block", ROW_BLOCK), sizes.pop("anchor_block", ANCHOR_BLOCK)
    asking = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")
    blocks, anchors = written(packed(rows, row_block), "rows"), written(packed(asking, anchor_block), "anchors")
    norm = lambda df: df.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
    bound = int(norm(blocks) * norm(anchors)) + 1
    each = anchors.select(F.col("block").alias("a_block"), F.explode(F.sequence(F.lit(0), (F.octet_length("ids") / 8 - 1).cast("int"))).alias("j"))
    whole = each.select("a_block", "j", F.lit(0).alias("p"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    best = written(Selection(blocks, anchors, True, positives, **sizes).best(whole), "positives")
    # a negative score leaves no interval
    found = best.where("score >= 0").select("a_block", "j", F.col("rank").alias("p"), F.expr(f"({low} * score + 99) div 100").alias("lo"), F.expr(f"({high} * score) div 100").alias("hi")).where("lo <= hi")
    worst = Selection(blocks, anchors, False, negatives, **sizes).best(found)
    named = best.select("a_block", "j", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worst.hint("merge").join(named, ["a_block", "j", "p"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
