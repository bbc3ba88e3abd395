"""Queries whose result depends on the order of a sequence: maps, reductions that don't commute, sorted files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import collect, sorted_files
from tidemark.sources.tables import shared_folder
from tidemark.sources.tables import table as t

#: The product of matrices is taken modulo this.
PRIME = 1_000_003


def ordered_concat(spark, sf):
    """All parts' first letters, in the order of their keys, as one string; its hash and length."""
    p = t(spark, sf, "part").select("p_partkey", F.substring("p_name", 1, 1).alias("letter"))
    whole = collect.reduce_with(p, "letter", "".join, arity=50, order=["p_partkey"], kind="string")
    return whole.select(F.md5("value").alias("hash"), F.length("value").cast("long").alias("n"))


def ordered_matrix_product(spark, sf):
    """The product of a 2 x 2 matrix for every line item, in order."""

    def product(matrices: list) -> list:
        out = [1, 0, 0, 1]
        for m in matrices:
            out = [(out[0] * m[0] + out[1] * m[2]) % PRIME, (out[0] * m[1] + out[1] * m[3]) % PRIME, (out[2] * m[0] + out[3] * m[2]) % PRIME, (out[2] * m[1] + out[3] * m[3]) % PRIME]
        return [int(x) for x in out]

    l = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit(1), F.col("l_quantity").cast("long"), F.col("l_suppkey") % 7, F.lit(2)).cast("array<long>").alias("m"))
    out = collect.reduce_with(l, "m", product, arity=200, order=["l_orderkey", "l_linenumber", "m"], kind="array<long>")
    return out.select(*[F.col("value")[i].alias(c) for i, c in enumerate("abcd")])


def mapped_in_order(spark, sf):
    """What a function of lists of names has for every part, at its place."""

    def lengths(names: list) -> list:
        return [f"{len(x)}:{x[::-1]}" for x in names]

    return collect.map_in_order(t(spark, sf, "part"), ["p_partkey"], "p_name", lengths, "string", chunk=64)


def _sorted(spark, sf, files: int = 12) -> tuple[str, object, object]:
    o = t(spark, sf, "orders").select("o_totalprice", "o_orderkey", "o_custkey")
    path = shared_folder(spark, "sorted")
    return path, o, sorted_files.write_sorted(o, path, "o_totalprice", files, ["o_orderkey"])


def sorted_files_order(spark, sf):
    """How many rows the sorted files hold, and how many neighbours are in the wrong order in a file and between files."""
    path, o, _ = _sorted(spark, sf)
    return sorted_files.disorder(spark.read.schema(o.schema).parquet(f"{path}/data"), F.struct("o_totalprice", "o_orderkey"))


def sorted_files_lookup(spark, sf):
    """Orders of a narrow range of prices, from the files that hold it."""
    _, o, borders = _sorted(spark, sf)
    return sorted_files.between(borders, "o_totalprice", 100_000.0, 101_000.0, o.schema)


def sorted_files_merge(spark, sf):
    """A third of the orders sorted first, the dear ones of the rest merged in later: rows and what is out of order."""
    o = t(spark, sf, "orders").select("o_totalprice", "o_orderkey", "o_custkey")
    path, late = shared_folder(spark, "sorted"), (F.col("o_orderkey") % 3 > 0) & (F.col("o_totalprice") > 300_000)
    first = sorted_files.write_sorted(o.where("o_orderkey % 3 = 0"), f"{path}/a", "o_totalprice", 12, ["o_orderkey"])
    both = sorted_files.merge(first, o.where(late), f"{path}/b", "o_totalprice", 12, ["o_orderkey"])
    kept = [r.file for r in both.select("file").collect()]
    d = sorted_files.disorder(spark.read.schema(o.schema).parquet(*kept), F.struct("o_totalprice", "o_orderkey"))
    return d.select("rows", "inside", "between", F.lit(sum("/a/" in x for x in kept) > 0).alias("some_kept"))


QUERIES = {
    "ordered_concat": (ordered_concat, "SELECT md5(string_agg(p_name[1], '' ORDER BY p_partkey)) AS hash, count(*) AS n FROM part"),
    "ordered_matrix_product": (
        ordered_matrix_product,
        f"""WITH m AS (SELECT list([1, CAST(l_quantity AS BIGINT), l_suppkey % 7, 2] ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT), l_suppkey % 7) AS ms FROM lineitem),
        p AS (SELECT list_reduce(list_prepend([CAST(1 AS BIGINT), 0, 0, 1], ms), lambda x, y: [(x[1] * y[1] + x[2] * y[3]) % {PRIME}, (x[1] * y[2] + x[2] * y[4]) % {PRIME}, (x[3] * y[1] + x[4] * y[3]) % {PRIME}, (x[3] * y[2] + x[4] * y[4]) % {PRIME}]) AS p FROM m)
        SELECT p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d FROM p""",
    ),
    "mapped_in_order": (mapped_in_order, "SELECT p_partkey, length(p_name) || ':' || reverse(p_name) AS result FROM part"),
    "sorted_files_order": (sorted_files_order, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS inside, CAST(0 AS BIGINT) AS between FROM orders"),
    "sorted_files_lookup": (sorted_files_lookup, "SELECT o_totalprice, o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000"),
    "sorted_files_merge": (sorted_files_merge, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS inside, CAST(0 AS BIGINT) AS between, true AS some_kept FROM orders WHERE o_orderkey % 3 = 0 OR o_totalprice > 300000"),
}
