r"""MinHash near-dedup with DartMinHash signatures, banded joins and exact verification.

A document is a weighted set: its distinct 5-word shingles, each of weight 1 (``weights="set"``, whose
similarity is plain Jaccard) or of its number of occurrences (``weights="count"``).  Over each element
lies a plane of weight by rank, cut into unit cells; a hash of (element, cell) says how many darts hit
the cell (Poisson, mean 1) and where.  Darts above the element's weight miss.  Looking only at ranks up
to the expected number of darts over the total weight finds about k * (ln k + 3) darts for a document
of any length, and every coordinate keeps its earliest dart: the chance that two documents keep the
same dart is their weighted Jaccard similarity.  A coordinate left empty doubles the rank limit.

1. Equal texts collapse to their smallest doc_id first, so huge groups of copies cost one row per task.
2. Signatures are cut into bands; rows that share a band's hash are candidates.
3. In each band bucket everyone is compared with the bucket's smallest id (a star, never all pairs);
   candidates are verified by exact similarity of whole texts; links form components.
4. Buckets that hold several components form a star around their best linked member.
5. For those that still do, the remaining pairs across different components are
   verified as well, so no link between different texts is lost to the star: all of them in small
   buckets, and in large ones those that pass an exact prefix filter on rare shingles.

Words are ``[^\x20\x09-\x0D]+`` of the lower-cased text; a text of one to four words is one shingle.
A text stands in the link graph by the smallest doc_id that holds it, its id.
Defined results: texts without words are near nothing but equal texts; null texts and rows with a null
doc_id are classes of their own; rows of one doc_id and text are one document; where one doc_id has rows of
several texts each row has the class of its text, and an id that stands for several texts is linked by any
of them; extra columns are not read.  A pair of similarity 0.8 shares no band with a chance of (1 - 0.8**5)**30 = 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words, salted_join, table, written
from tidemark.llm.components import components
from tidemark.llm.decontaminate import lower_bytes
from tidemark.llm.shingles import MULTIPLIER, mixed, window_hashes, word_hashes

BANDS, ROWS = 30, 5
#: Split buckets of at most so many members have all their pairs compared; beyond it the prefix filter does.
SMALL = 32
#: Rounds in which split buckets form another star, around the member of most links.
HUB_ROUNDS = 1
#: P(at most i darts in a unit cell), i = 0, 1, ...
POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, i + 1))) for i in range(20)])
UNIT = 2.0**-53


def weighted_shingles(text: bytes | None, n: int = 5, weights: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their weights."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    elements, counts = np.unique(window_hashes(word_hashes(words), min(n, len(words))), return_counts=True)
    return elements, counts.astype(float) if weights == "count" else np.ones(len(elements))


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart (a 64-bit hash) of each of k coordinates; elements must not be empty."""
    darts = k * (np.log(k) + 3)
    while True:
        limit = darts / weights.sum()
        signature, filled = _throw(elements, weights, k, limit)
        if filled.all():
            return signature
        darts *= 2


def _throw(elements: np.ndarray, weights: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    strips = np.ceil(weights).astype(np.int64)
    if strips.max() > 1:  # a row per element and unit of weight
        owner = np.repeat(np.arange(len(elements)), strips)
        strip = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
        room, elements = weights[owner] - strip, mixed(elements[owner] + strip.astype(np.uint64) * MULTIPLIER)
    else:
        room = weights
    steps = int(np.ceil(limit))
    cells = elements if steps == 1 else (elements[:, None] + np.arange(steps, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)).ravel()
    cells = mixed(cells + np.uint64(0x632BE59BD9B4E019))
    hits = np.searchsorted(POISSON, (cells >> np.uint64(11)).astype(float) * UNIT, side="right")
    cell = np.repeat(np.arange(len(cells)), hits)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(hits) - hits, hits)
    dart = mixed(cells[cell] + (nth + 1).astype(np.uint64) * MULTIPLIER)
    rank = (cell % steps if steps > 1 else 0) + (dart >> np.uint64(11)).astype(float) * UNIT
    keep = rank < limit
    if (room < 1).any():
        height = (mixed(dart + np.uint64(1)) >> np.uint64(11)).astype(float) * UNIT
        keep &= height < room[cell // steps]
    dart, rank = dart[keep], rank[keep]
    order = np.argsort(-rank)
    dart = dart[order]
    coordinate = (mixed(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
    signature, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
    signature[coordinate] = dart  # the earliest comes last
    filled[coordinate] = True
    return signature, filled


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = signature.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * MULTIPLIER
    for j in range(rows):
        h = mixed(h + grid[:, j])
    return h.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (elements, weights)."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][at], b[1][bt]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int, weights: str) -> DataFrame:
    """pairs(a, b) of which a text of texts(id, text) each is at least threshold similar, with the similarity."""

    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, last_text = None, None
        for centres, others in batches:
            out = []
            for x, y in zip(centres, others):
                if x != last_text:  # rows come sorted by the centre
                    last, last_text = weighted_shingles(x, n, weights), x
                other = weighted_shingles(y, n, weights)
                low, high = sorted((last[1].sum(), other[1].sum()))
                out.append(similarity(last, other) if low >= threshold * high else 0.0)
            yield pd.Series(out)

    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("_tb"))
    both = pairs.join(ta, "a").join(tb, "b")
    return both.select("a", "b", F.pandas_udf(verify, "double")("_tb", "_ta").alias("similarity")).where(F.col("similarity") >= threshold)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _split(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(band, id, component, n) of the band buckets that hold several components."""
    named = shared.where("n > 2").select("band", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    return salted_join(named, several, "band", "id")


def _degrees(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))


def _hub_pairs(split: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs (a > b) of a split bucket's best linked member with those of other components: linear in the rows."""
    ranked = split.join(degrees, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    hubs = ranked.groupBy("band").agg(F.max_by(F.struct(F.col("id").alias("hub"), F.col("component").alias("_part")), F.struct("n_links", -F.col("id"))).alias("h")).select("band", "h.*")
    others = salted_join(split, hubs, "band", "id").where("component <> _part")
    return others.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()


def _pairs_of_small_buckets(split: DataFrame, most: int) -> DataFrame:
    """Pairs (a > b) of different components in a split bucket of at most ``most`` members: linear in the rows."""
    small = split.where(F.col("n") <= most)
    left = small.select("band", F.col("id").alias("a"), F.col("component").alias("_ca"))
    right = small.select("band", F.col("id").alias("b"), F.col("component").alias("_cb"))
    return left.join(right, "band").where("a > b AND _ca <> _cb").select("a", "b").distinct()


def _pairs_of_large_buckets(split: DataFrame, texts: DataFrame, most: int, threshold: float, n: int, weights: str) -> DataFrame:
    """Pairs (a > b) of different components among members of larger split buckets that can be similar enough.

    An exact prefix filter: with the shingles of every text in one order, rarest first, two texts of
    similarity t or more first meet at a shingle before which each has passed little enough weight for
    the rest to hold an overlap of t / (1 + t) of both weights.  So a text is joined by its rare
    shingles alone, which copies of one original, each edited its own way, don't share.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i, text, component in zip(frame["id"], frame["text"], frame["component"]):
                elements, w = weighted_shingles(text, n, weights)
                yield pd.DataFrame({"id": i, "component": component, "shingle": elements.astype(np.int64), "weight": w})

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i, component, rows in zip(frame["id"], frame["component"], frame["rows"]):
                w = np.array([x["weight"] for x in rows])
                before = np.cumsum(w) - w
                keep = [k for k in np.flatnonzero(before <= (1 - threshold) * w.sum() + 1e-9) if rows[k]["df"] > 1]
                yield pd.DataFrame({"id": i, "component": component, "shingle": [rows[k]["shingle"] for k in keep], "left": [w.sum() - before[k] for k in keep], "size": w.sum()})

    ids = split.where(F.col("n") > most).groupBy("id").agg(F.min("component").alias("component"))
    elements = texts.join(ids, "id").mapInPandas(explode, "id long, component long, shingle long, weight double")
    df = elements.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ordered = salted_join(elements, df, "shingle", "id").groupBy("id").agg(F.min("component").alias("component"), F.sort_array(F.collect_list(F.struct("df", "shingle", "weight"))).alias("rows"))
    rare = written(ordered.mapInPandas(prefix, "id long, component long, shingle long, left double, size double"), "prefixes")
    x, y = (rare.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "left", "size")]) for side in "xy")
    fits = F.least("x_left", "y_left") >= threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) - 1e-9
    return x.join(y, "shingle").where((F.col("x_id") > F.col("y_id")) & (F.col("x_component") != F.col("y_component")) & fits).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _classes(docs: DataFrame, threshold: float, n: int, bands: int, rows: int, weights: str) -> DataFrame:
    """(doc_id, same, class_id) of the rows of docs(doc_id, text) that have both; same is the text's digest."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for text in frame.pop("_low"):
                elements, w = weighted_shingles(text, n, weights)
                out.append(band_hashes(dart_signature(elements, w, bands * rows), bands, rows) if len(elements) else [])
            frame["bands"] = out
            yield frame

    signed = texts.select("doc_id", _digest(F.col("text")).alias("same"), lower_bytes(F.col("text")).alias("_low")).mapInPandas(sign, "doc_id long, same binary, bands array<long>")
    signed = written(signed, "signatures")
    ids = signed.groupBy("same").agg(F.min("doc_id").alias("id"))
    members = written(salted_join(signed.select("doc_id", "same", "bands"), ids, "same", "doc_id").select("doc_id", "same", "id", F.when(F.col("doc_id") == F.col("id"), F.col("bands")).alias("bands")), "members")
    buckets = members.where("bands IS NOT NULL").select("id", F.explode("bands").alias("band")).distinct()
    centres = buckets.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(salted_join(buckets, centres, "band", "id"), "buckets")

    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    # the rows whose doc_id stands for their text, once each; an id that stands for several texts has several rows
    own = members.where("doc_id = id").select("doc_id", "same").distinct().join(wanted, "doc_id", "left_semi")
    near = texts.withColumn("same", _digest(F.col("text"))).join(own, ["doc_id", "same"], "left_semi")
    near = written(near.select(F.col("doc_id").alias("id"), "same", lower_bytes(F.col("text")).alias("text")).dropDuplicates(["id", "same"]).drop("same"), "texts")
    star = shared.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links = written(_verified(star, near, threshold, n, weights), "links")
    found = components(links)
    split = written(_split(shared, found), "split_buckets")

    tested = star
    for _ in range(HUB_ROUNDS):
        if split.isEmpty():
            break
        pairs = written(_hub_pairs(split, _degrees(links)).join(tested, ["a", "b"], "left_anti"), "hub_pairs")
        more = written(_verified(pairs, near, threshold, n, weights), "hub_links")
        tested = tested.unionByName(pairs)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)
        split = written(_split(shared, found), "split_buckets")
    if not split.isEmpty():
        rest = _pairs_of_small_buckets(split, SMALL).union(_pairs_of_large_buckets(split, near, SMALL, threshold, n, weights))
        rest = rest.distinct().join(tested, ["a", "b"], "left_anti")
        more = written(_verified(rest, near, threshold, n, weights), "more_links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    return members.select("doc_id", "same", "id").join(found, "id", "left").select("doc_id", "same", F.coalesce("component", "id").alias("class_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """(doc_id, class_id), one row per row of docs: class_id is the smallest doc_id of the class of the row's text."""
    docs = docs.select("doc_id", "text")
    alone = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return _classes(docs, threshold, n, bands, rows, weights).select("doc_id", "class_id").unionByName(alone)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of every class the rows of the smallest doc_id stay, all columns as they are.

    Rows that repeat a doc_id and its text become one of them; rows of one doc_id with several texts are judged
    one by one; rows without doc_id or text have no near duplicates and stay.
    """
    gone = _classes(docs.select("doc_id", "text"), 0.8, 5, BANDS, ROWS, "set").where("doc_id <> class_id").select("doc_id", "same").distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    kept = docs.where("doc_id IS NOT NULL").select("doc_id", _digest(F.col("text")).alias("same"), row)
    kept = kept.join(gone, ["doc_id", "same"], "left_anti").dropDuplicates(["doc_id", "same"]).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
