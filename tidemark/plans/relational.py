"""Queries of joins, linkage, catalogue views and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog, collect, dataset, graph, spans
from tidemark.sources.tables import table as t


def equi_join_inner(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def left_join_having_zero(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    return c.join(o.where("o_totalprice > 300000 AND o_orderstatus = 'P'").select("o_custkey"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_custkey").alias("n")).where("n < 1").select("c_custkey")


def semi_join_in(spark, sf):
    o, l = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    return o.join(l.where("l_quantity >= 50"), o.o_orderkey == l.l_orderkey, "left_semi").select("o_orderkey", "o_orderstatus")


def anti_join_missing(spark, sf):
    p, l = t(spark, sf, "part"), t(spark, sf, "lineitem")
    return p.join(l.where("l_quantity > 45"), p.p_partkey == l.l_partkey, "left_anti").select("p_partkey", "p_brand")


def natural_join_using(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_regionkey").alias("regionkey"), "n_name")
    return n.join(t(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"), ["regionkey"])


def multiway_join(spark, sf):
    l, o, c, n, r = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    q = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return q.groupBy("r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def cross_locality_top1(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    have = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    regions = t(spark, sf, "region").select("r_regionkey")
    m = regions.crossJoin(n).where("n_regionkey <> r_regionkey").join(have, F.col("n_nationkey") == have.s_nationkey, "left")
    m = m.select("r_regionkey", "n_nationkey", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))
    return collect.top_per_group(m, ["r_regionkey"], 1, F.desc("n_suppliers"), F.asc("n_nationkey"))


def all_pairs_matrix(spark, sf):
    r, n = t(spark, sf, "region"), t(spark, sf, "nation")
    p = collect.all_pairs(r, n, "r_regionkey", "n_nationkey", (F.col("r_regionkey") * F.col("n_nationkey")).cast("long"))
    return collect.matrix_rows(p, "r_regionkey", "n_nationkey", "value").select("r_regionkey", F.array_join(F.col("row").cast("array<string>"), ",").alias("row"))


def self_pairs_nonidentity(spark, sf):
    return collect.self_pairs(t(spark, sf, "nation"), "n_nationkey", ["n_regionkey"])


def similarity_pairs(spark, sf):
    p = collect.self_pairs(t(spark, sf, "nation"), "n_nationkey", columns=["n_name"], ordered=True)
    return p.withColumn("similarity", F.round(collect.edit_similarity(F.col("n_name_a"), F.col("n_name_b")), 6)).where("similarity > 0.3").select("n_nationkey_a", "n_nationkey_b", "similarity")


def asof_event_order(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), F.unix_timestamp("ts").alias("s"))
    # the same keys in the other table: customers' orders, shifted to the events' time
    low = e.agg(F.min("s")).first()[0]
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.lit(low) + F.pmod(F.col("o_orderkey") * 7919, F.lit(30 * 86400))).alias("s"), "o_orderkey")
    o = o.groupBy("k", "s").agg(F.max("o_orderkey").alias("o_orderkey"))
    return collect.as_of(e, o, ["k"], "s", ["o_orderkey"]).select("event_id", "o_orderkey")


def record_linkage_one_to_one(spark, sf):
    d = t(spark, sf, "documents").withColumn("digest", F.md5("text"))
    return collect.link_one_to_one(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["digest"], "doc_id")


def bare_column_argmin(spark, sf):
    l = t(spark, sf, "lineitem")
    o = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return l.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("price"), F.min_by("l_orderkey", o).alias("orderkey"), F.max_by("l_partkey", o).alias("dearest_part"))


def free_slots_having(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("open")).where("open < 3 AND n >= 5")


def claim_next(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


def newest_per_key(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return catalog.newest(o, ["o_custkey"], ["o_orderkey"])


def placement_order(spark, sf):
    s = t(spark, sf, "supplier")
    n = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    log = lambda c: F.floor(F.log(c + 1) + 1e-12)
    p = s.join(n, s.s_suppkey == n.l_suppkey, "left").select("s_suppkey", log(F.coalesce("n", F.lit(0))).alias("load"), log(F.greatest("s_acctbal", F.lit(0.0))).alias("room"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    order = ["load", (-F.col("room")), "bytes", "s_suppkey"]
    return spans.numbered(p, F.struct("load", (-F.col("room")).alias("less_room"), F.floor(F.col("bytes") / 100)), order, "place")


def catalog_status_totals(spark, sf):
    s = t(spark, sf, "supplier").withColumn("cents", F.round(F.col("s_acctbal") * 100).cast("long"))
    return catalog.totals(s, ["s_nationkey"], "cents", F.greatest("cents", F.lit(0).cast("long")))


def catalog_sorted_view(spark, sf):
    return catalog.sorted_view(t(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", "s_suppkey")


def catalog_status_filters(spark, sf):
    c = dataset.Dataset(t(spark, sf, "customer"))
    q = c.query(dataset.any_of(c.c.c_mktsegment == "BUILDING", dataset.matches(c.c.c_name, "*7?")), c.c.c_acctbal > 1000)
    return catalog.table_view(q.df, "c_custkey", "c_name")


def heartbeat_upsert(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("lastheardfrom"), "event_id", "event_type")
    half = e.agg(F.floor((F.min("lastheardfrom") + F.max("lastheardfrom")) / 2)).first()[0]
    by, order = ["key"], ["lastheardfrom", "event_id"]
    now = catalog.upsert(catalog.newest(e.where(F.col("lastheardfrom") <= half), by, order), e.where(F.col("lastheardfrom") > half), by, order)
    end = e.agg(F.max("lastheardfrom")).first()[0]
    return catalog.alive(now, end, 2 * 86400).select("key", "lastheardfrom", "event_id")


def _parts(spark, sf):
    """A workflow over parts: task p needs the files of p // 2 and p // 3."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    created = p.select(F.col("node").alias("file"), "node")
    needed = p.where("node > 1").select(F.explode(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))).alias("file"), "node").where("file > 0").distinct()
    return p, created, needed


def dag_depth_width(spark, sf):
    p, created, needed = _parts(spark, sf)
    return graph.depth_and_width(graph.levels(p, graph.edges(created, needed)))


def dag_guaranteed_width(spark, sf):
    _, created, needed = _parts(spark, sf)
    return graph.guaranteed_width(graph.edges(created, needed))


def ancestor_closure(spark, sf):
    _, created, needed = _parts(spark, sf)
    return graph.closure(graph.edges(created, needed))


def k_hop_consumers(spark, sf):
    _, created, needed = _parts(spark, sf)
    return graph.closure(graph.edges(created, needed), hops=2).groupBy("ancestor").agg(F.countDistinct("node").alias("n"))


def ready_set(spark, sf):
    _, _, needed = _parts(spark, sf)
    done = t(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("file"))
    return graph.ready(needed.select(F.col("node").alias("task"), "file"), done)


def source_files(spark, sf):
    _, _, needed = _parts(spark, sf)
    created = t(spark, sf, "part").where("p_size <> 10").select(F.col("p_partkey").alias("file"))
    return graph.source_files(needed, created)


E = """e AS (SELECT DISTINCT f AS parent, node AS child FROM (SELECT p_partkey AS node, unnest([p_partkey // 2, p_partkey // 3]) AS f FROM part WHERE p_partkey > 1) WHERE f > 0)"""
QUERIES = {
    "equi_join_inner": (equi_join_inner, "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "left_join_having_zero": (left_join_having_zero, "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 AND o_orderstatus = 'P' GROUP BY 1 HAVING count(o_custkey) < 1"),
    "semi_join_in": (semi_join_in, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)"),
    "anti_join_missing": (anti_join_missing, "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"),
    "natural_join_using": (natural_join_using, "SELECT n_regionkey AS regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "multiway_join": (multiway_join, "SELECT r_name, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "cross_locality_top1": (
        cross_locality_top1,
        """WITH h AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
        SELECT r_regionkey, n_nationkey, coalesce(n, 0) AS n_suppliers FROM region, nation LEFT JOIN h ON s_nationkey = n_nationkey WHERE n_regionkey <> r_regionkey
        QUALIFY row_number() OVER (PARTITION BY r_regionkey ORDER BY coalesce(n, 0) DESC, n_nationkey) = 1""",
    ),
    "all_pairs_matrix": (all_pairs_matrix, "SELECT r_regionkey, string_agg(CAST(r_regionkey * n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS row FROM region, nation GROUP BY 1"),
    "self_pairs_nonidentity": (self_pairs_nonidentity, "SELECT a.n_regionkey, a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "similarity_pairs": (similarity_pairs, "SELECT n_nationkey_a, n_nationkey_b, similarity FROM (SELECT a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name), 1), 6) AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) WHERE similarity > 0.3"),
    "asof_event_order": (
        asof_event_order,
        """WITH e AS (SELECT event_id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), lo AS (SELECT min(s) AS low FROM e),
        o AS (SELECT k, s, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey AS k, low + (o_orderkey * 7919) % 2592000 AS s, o_orderkey FROM orders, lo) GROUP BY 1, 2)
        SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.s >= o.s""",
    ),
    "record_linkage_one_to_one": (
        record_linkage_one_to_one,
        """SELECT md5(text) AS digest, min(doc_id) FILTER (doc_id % 2 = 0) AS a, min(doc_id) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY 1
        HAVING count(*) FILTER (doc_id % 2 = 0) = 1 AND count(*) FILTER (doc_id % 2 = 1) = 1""",
    ),
    "bare_column_argmin": (bare_column_argmin, "SELECT l_suppkey, min(l_extendedprice) AS price, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS orderkey, arg_max(l_partkey, (l_extendedprice, l_orderkey, l_linenumber)) AS dearest_part FROM lineitem GROUP BY 1"),
    "free_slots_having": (free_slots_having, "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') < 3 AND count(*) >= 5"),
    "claim_next": (claim_next, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25"),
    "newest_per_key": (newest_per_key, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"),
    "placement_order": (placement_order, "SELECT *, row_number() OVER (ORDER BY load, room DESC, bytes, s_suppkey) AS place FROM (SELECT s_suppkey, CAST(floor(ln(coalesce(n, 0) + 1) + 1e-12) AS BIGINT) AS load, CAST(floor(ln(greatest(s_acctbal, 0.0) + 1) + 1e-12) AS BIGINT) AS room, coalesce(bytes, 0) AS bytes FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"),
    "catalog_status_totals": (catalog_status_totals, "SELECT s_nationkey, CAST(sum(c) AS BIGINT) AS total, CAST(sum(greatest(c, 0)) AS BIGINT) AS avail, count(*) AS n FROM (SELECT s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS c FROM supplier) GROUP BY 1"),
    "catalog_sorted_view": (catalog_sorted_view, "SELECT s_suppkey, s_name FROM supplier ORDER BY lower(coalesce(s_name, 'unknown')), s_suppkey"),
    "catalog_status_filters": (catalog_status_filters, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' OR regexp_full_match(c_name, '.*7.')) AND c_acctbal > 1000"),
    "heartbeat_upsert": (
        heartbeat_upsert,
        """WITH e AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id FROM events), m AS (SELECT key, max(s) AS lastheardfrom, arg_max(event_id, (s, event_id)) AS event_id FROM e GROUP BY 1)
        SELECT * FROM m WHERE (SELECT max(s) FROM e) - lastheardfrom <= 172800""",
    ),
    "dag_depth_width": (
        dag_depth_width,
        f"""WITH RECURSIVE {E}, r AS (SELECT CAST(p_partkey AS BIGINT) AS node, 0 AS level FROM part WHERE p_partkey = 1 UNION SELECT child, level + 1 FROM r JOIN e ON parent = node),
        l AS (SELECT node, max(level) AS level FROM r GROUP BY 1) SELECT max(level) + 1 AS depth, max(n) AS width FROM (SELECT level, count(*) AS n FROM l GROUP BY 1)""",
    ),
    "dag_guaranteed_width": (
        dag_guaranteed_width,
        f"""WITH {E}, o AS (SELECT child, min(parent) AS parent FROM e GROUP BY 1 HAVING count(DISTINCT parent) = 1)
        SELECT coalesce(max(n), 0) AS width FROM (SELECT parent, count(*) AS n FROM o GROUP BY 1)""",
    ),
    "ancestor_closure": (
        ancestor_closure,
        f"""WITH RECURSIVE {E}, r AS (SELECT parent AS ancestor, child AS node, 1 AS distance FROM e UNION SELECT ancestor, child, distance + 1 FROM r JOIN e ON parent = node)
        SELECT ancestor, node, min(distance) AS distance FROM r GROUP BY 1, 2""",
    ),
    "k_hop_consumers": (k_hop_consumers, f"WITH {E}, h AS (SELECT parent AS ancestor, child AS node FROM e UNION SELECT a.parent, b.child FROM e a JOIN e b ON a.child = b.parent) SELECT ancestor, count(DISTINCT node) AS n FROM h GROUP BY 1"),
    "ready_set": (ready_set, f"WITH {E} SELECT child AS task FROM e JOIN part ON p_partkey = parent GROUP BY 1 HAVING count(*) FILTER (p_size <= 5) = 0"),
    "source_files": (source_files, f"WITH {E} SELECT DISTINCT parent AS file FROM e JOIN part ON p_partkey = parent WHERE p_size = 10"),
}
