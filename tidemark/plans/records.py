"""Queries over records, arrays, strings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import strings, values
from tidemark.operators import collect, matrix
from tidemark.sources.tables import table as t


def where_project_records(spark, sf):
    p = values.passes((F.col("event_type") == "click") & (F.col("value") > 50))
    return t(spark, sf, "events").where(p).select("event_id", "user_id", (F.col("value") * 2).alias("doubled"))


def json_props_lookup(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf, "events").select("event_id", k.alias("k"), (k % 7).alias("k_mod")).where(values.passes(F.col("k") >= 50))


def like_regex_filter(spark, sf):
    return t(spark, sf, "part").where(F.col("p_name").rlike("^(cold|large) .*[lt]$")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_name"))


def string_functions(spark, sf):
    u = F.col("url")
    path = F.regexp_replace(u, r"[?#].*$", "")
    return t(spark, sf, "pages").select(
        "page_id",
        strings.basename(path).alias("base"),
        strings.dirname(path).alias("dir"),
        strings.join(F.split(path, "/"), "|").alias("joined"),
        strings.shell_escape(u).alias("escaped"),
        strings.printf("%d:%s", F.col("page_id"), F.lit("p")).alias("label"),
        strings.template("page {id} of {{all}}", id=F.col("page_id")).alias("templated"),
    )


def array_select_project(spark, sf):
    items = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("items"))
    big = F.filter("items", lambda x: x["l_quantity"] > 25)
    numbers = F.transform(big, lambda x: x["l_linenumber"])
    return items.select(
        "l_orderkey",
        F.size("items").cast("long").alias("n"),
        F.size(big).cast("long").alias("n_big"),
        F.array_join(numbers.cast("array<string>"), ",").alias("big_lines"),
        values.item(F.transform("items", lambda x: x["l_quantity"]), -1).alias("last_quantity"),
        F.size(values.cut(F.col("items"), 1, -1)).cast("long").alias("n_inner"),
        F.size(values.half_open_range(F.lit(0), F.size("items"), 2)).cast("long").alias("n_even"),
    )


def list_comprehension_pairs(spark, sf):
    names = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: a < b), lambda b: F.concat(a, F.lit("-"), b))))
    return names.select("n_regionkey", F.size(pairs).cast("long").alias("n"), F.array_join(F.array_sort(pairs), ";").alias("pairs"))


def schema_inference(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("key").agg(values.json_type(F.min_by("value", "event_id")).alias("type"), F.min("event_id").alias("first_event"))


def value_counts_unpivot(spark, sf):
    return collect.value_counts(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def duplicate_groups(spark, sf):
    return collect.duplicate_groups(t(spark, sf, "documents").withColumn("digest", F.md5("text")), "digest", "lang")


def word_count_topk(spark, sf):
    return collect.top(collect.word_counts(t(spark, sf, "documents"), "text"), 10, F.desc("n"), F.asc("key")).select(F.col("key").alias("word"), "n")


def map_reduce_wordcount(spark, sf):
    w = collect.tokens(t(spark, sf, "conversations"), "text")
    return collect.map_reduce(w, F.length("word"), F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("kinds"))


def tree_reduce_sum_max(spark, sf):
    q = F.col("l_quantity").cast("long")
    return t(spark, sf, "lineitem").agg(F.sum(q).alias("total"), F.max(q).alias("high"), F.min(q).alias("low"), F.count(F.lit(1)).alias("n"))


def union_all_tables(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(t(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


def group_concat_list(spark, sf):
    g = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\t").alias("names"))
    return g


def set_difference(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).distinct().exceptAll(t(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey")).distinct())


def merged_counts(spark, sf):
    a = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    b = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return collect.merge_counts(a, b)


def directory_rollup_topk(spark, sf):
    p = t(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1)).withColumn("bytes", F.octet_length("html").cast("long"))
    g = p.groupBy("host").agg(F.count(F.lit(1)).alias("freq"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("url").contains("?"), F.col("bytes")).otherwise(0)).alias("query_bytes"))
    return collect.top(g, 10, F.desc("bytes"), F.asc("host"))


def audit_cube(spark, sf):
    c = t(spark, sf, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    return matrix.audit(c, "c_mktsegment", "c_nationkey", cents=F.col("cents"), n=F.lit(1))


def roc_curve(spark, sf):
    scored = t(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("s"), (F.col("l_returnflag") == "R").alias("genuine"))
    return matrix.roc(scored, "s", "genuine").select(F.round("threshold", 2).alias("threshold"), F.round("false_accept", 9).alias("false_accept"), F.round("true_accept", 9).alias("true_accept"))


def pivot_matrix(spark, sf):
    return matrix.pivot(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


def matrix_row_col_range(spark, sf):
    m = matrix.from_rows(t(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))
    return matrix.rectangle(m, 10, 20, 2, 6)


def matrix_overlay(spark, sf):
    m = matrix.from_rows(t(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))
    patch = matrix.rectangle(m, 5, 10, 0, 3).withColumn("value", F.lit(0.0))
    return matrix.overlay(m, patch)


WORDS = "unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''))"
QUERIES = {
    "where_project_records": (where_project_records, "SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE coalesce(event_type = 'click' AND value > 50, false)"),
    "json_props_lookup": (json_props_lookup, "SELECT event_id, k, k % 7 AS k_mod FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50"),
    "like_regex_filter": (like_regex_filter, "SELECT p_brand, count(*) AS n, min(p_name) AS first_name FROM part WHERE regexp_matches(p_name, '^(cold|large) .*[lt]$') GROUP BY p_brand"),
    "string_functions": (
        string_functions,
        r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
        SELECT page_id, regexp_extract(path, '([^/]*)/*$', 1) AS base,
          regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '[^/]*$', ''), '/+$', '') AS dir,
          replace(path, '/', '|') AS joined, '"' || regexp_replace(url, '([\\"$`])', '\\\1', 'g') || '"' AS escaped,
          page_id || ':p' AS label, 'page ' || page_id || ' of {all}' AS templated FROM p""",
    ),
    "array_select_project": (
        array_select_project,
        """SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_big,
          coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity) FILTER (l_quantity > 25), '') AS big_lines,
          arg_max(l_quantity, (l_linenumber, l_quantity)) AS last_quantity, greatest(count(*) - 2, 0) AS n_inner, (count(*) + 1) // 2 AS n_even
        FROM lineitem GROUP BY l_orderkey""",
    ),
    "list_comprehension_pairs": (list_comprehension_pairs, "SELECT a.n_regionkey, count(*) AS n, string_agg(a.n_name || '-' || b.n_name, ';' ORDER BY a.n_name || '-' || b.n_name) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name GROUP BY 1"),
    "schema_inference": (
        schema_inference,
        """WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events),
        v AS (SELECT key, event_id, json_type(json_extract(props, '$.' || key)) AS ty FROM k)
        SELECT key, CASE WHEN arg_min(ty, event_id) IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN arg_min(ty, event_id) = 'DOUBLE' THEN 'double' WHEN arg_min(ty, event_id) = 'VARCHAR' THEN 'string' ELSE lower(arg_min(ty, event_id)) END AS type, min(event_id) AS first_event
        FROM v GROUP BY key""",
    ),
    "value_counts_unpivot": (value_counts_unpivot, "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"),
    "duplicate_groups": (duplicate_groups, "SELECT md5(text) AS digest, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1"),
    "word_count_topk": (word_count_topk, f"SELECT word, count(*) AS n FROM (SELECT {WORDS} AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 10"),
    "map_reduce_wordcount": (map_reduce_wordcount, f"SELECT CAST(length(word) AS INTEGER) AS key, count(*) AS n, count(DISTINCT word) AS kinds FROM (SELECT {WORDS} AS word FROM conversations) GROUP BY 1"),
    "tree_reduce_sum_max": (tree_reduce_sum_max, "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, max(CAST(l_quantity AS BIGINT)) AS high, min(CAST(l_quantity AS BIGINT)) AS low, count(*) AS n FROM lineitem"),
    "union_all_tables": (union_all_tables, "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region"),
    "group_concat_list": (group_concat_list, "SELECT n_regionkey, string_agg(n_name, chr(9) ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "set_difference": (set_difference, "SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000"),
    "merged_counts": (merged_counts, "SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key"),
    "directory_rollup_topk": (directory_rollup_topk, "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS freq, CAST(sum(strlen(html)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN contains(url, '?') THEN strlen(html) ELSE 0 END) AS BIGINT) AS query_bytes FROM pages GROUP BY 1 ORDER BY bytes DESC, host LIMIT 10"),
    "audit_cube": (audit_cube, "SELECT c_mktsegment, c_nationkey, CAST(grouping_id(c_mktsegment, c_nationkey) AS BIGINT) AS level, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)"),
    "roc_curve": (
        roc_curve,
        """WITH q AS (SELECT l_quantity / 50 AS s, l_returnflag = 'R' AS same FROM lineitem), t AS (SELECT unnest(range(0, 101)) AS k)
        SELECT round(k / 100, 2) AS threshold, round(count(*) FILTER (NOT same AND s >= k / 100 - 1e-9) / count(*) FILTER (NOT same), 9) AS false_accept,
          round(count(*) FILTER (same AND s >= k / 100 - 1e-9) / count(*) FILTER (same), 9) AS true_accept FROM q, t GROUP BY k""",
    ),
    "pivot_matrix": (pivot_matrix, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "matrix_row_col_range": (matrix_row_col_range, "SELECT i, j, CAST(embedding[j + 1] AS DOUBLE) AS value FROM (SELECT vec_id AS i, embedding, CAST(unnest(range(2, 6)) AS INTEGER) AS j FROM embeddings WHERE vec_id >= 10 AND vec_id < 20)"),
    "matrix_overlay": (matrix_overlay, "SELECT i, j, CASE WHEN i >= 5 AND i < 10 AND j < 3 THEN 0.0 ELSE CAST(embedding[j + 1] AS DOUBLE) END AS value FROM (SELECT vec_id AS i, embedding, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS j FROM embeddings)"),
}
