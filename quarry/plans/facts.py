"""Fact store queries: compiling, merging, numbering, indexes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import json_long, minute
from quarry.operators import facts, joins

from .catalogue import query

REASONS = [("low_value", "value < 10"), ("low_k", "k < 5")]


def _compiled(t):
    return facts.compile_facts(t("events").withColumn("k", json_long("props", "k")), REASONS)


_OUTCOME = "CASE WHEN value < 10 THEN 'low_value' WHEN CAST(props->>'k' AS BIGINT) < 5 THEN 'low_k' ELSE 'compiled' END"


@query(f"SELECT event_type, {_OUTCOME} AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def fact_compile_drop_reasons(t):
    return _compiled(t).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_type, count(*) AS record_count, count(*) FILTER (o = 'compiled') AS compiled_count,
    count(*) FILTER (o <> 'compiled') AS dropped_count FROM (SELECT event_type, {_OUTCOME} AS o FROM events) GROUP BY 1""")
def coverage_ledger(t):
    return facts.coverage(_compiled(t), "event_type")


@query("""SELECT sha1(concat_ws('::', kind, CAST(entity AS VARCHAR), hour)) AS signature, count(*) AS merge_count,
    array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(record) AS first_record
    FROM (SELECT event_type AS kind, user_id AS entity, strftime(ts, '%Y-%m-%d %H') AS hour, 'events' AS source, event_id AS record FROM events
    UNION ALL SELECT 'purchase', o_custkey, strftime(o_orderdate, '%Y-%m-%d %H'), 'orders', o_orderkey FROM orders) GROUP BY 1""")
def fact_signature_merge(t):
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias("hour")
    events = t("events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("entity"), hour("ts"), F.lit("events").alias("source"), F.col("event_id").alias("record"))
    orders = t("orders").select(F.lit("purchase").alias("kind"), F.col("o_custkey").alias("entity"), hour("o_orderdate"), F.lit("orders").alias("source"), F.col("o_orderkey").alias("record"))
    return facts.merge(events.unionByName(orders), ["kind", "entity", "hour"], "source", "record")


@query("""WITH f AS (SELECT sha1('event::' || user_id || '::' || event_type || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END || '|' || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END) AS signature, event_id AS id, 't' || (event_id % 4) AS tool, 'r' || (event_id % 90) AS ref, 'e' || (event_id % 7) AS ex FROM events),
    x AS (SELECT signature, ex, min(id) AS pos FROM f GROUP BY 1, 2), k AS (SELECT signature, string_agg(ex, ',' ORDER BY pos) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY pos) AS r FROM x) WHERE r <= 3 GROUP BY 1)
    SELECT signature, count(*) AS merge_count, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools, array_to_string(list_sort(list(DISTINCT ref))[1:20], ',') AS refs, count(DISTINCT ref) > 20 AS truncated, any_value(excerpts) AS excerpts, min(id) AS event_id FROM f JOIN k USING (signature) GROUP BY 1""")
def fact_merge_canonical(t):
    e = F.col("event_id")
    mod = lambda letter, n: F.concat(F.lit(letter), (e % n).cast("string"))
    rows = t("events").select(e, F.lit("event").alias("kind"), "user_id", "event_type", F.when(e % 3 != 0, "x").alias("p"), F.when(e % 3 == 0, "x").alias("q"), mod("t", 4).alias("tool"), mod("r", 90).alias("ref"), mod("e", 7).alias("ex"))
    merged = facts.merge_facts(rows, "kind", "user_id", ["event_type", "p", "q"], "tool", "ref", "ex", "event_id", refs=20)
    return merged.select("signature", "merge_count", F.array_join("source_tools", ",").alias("tools"), F.array_join("record_refs", ",").alias("refs"), "truncated", F.array_join("raw_excerpts", ",").alias("excerpts"), "event_id")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS fact_no FROM events")
def fact_id_numbering(t):
    return facts.number(t("events").select("event_id", "event_type"), "event_type", "event_id")


@query("""SELECT index_name, key, count(*) AS n_facts, min(event_id) AS first_fact FROM (
    SELECT 'by_user' AS index_name, CAST(user_id AS VARCHAR) AS key, event_id FROM events
    UNION ALL SELECT 'by_type', event_type, event_id FROM events
    UNION ALL SELECT 'by_minute', strftime(ts, '%Y-%m-%d %H:%M'), event_id FROM events) GROUP BY 1, 2""")
def inverted_index_build(t):
    index = facts.inverted_index(t("events"), {"by_user": F.col("user_id"), "by_type": F.col("event_type"), "by_minute": minute(F.col("ts"))}, "event_id")
    return index.groupBy("index_name", "key").agg(F.count(F.lit(1)).alias("n_facts"), F.min("fact_id").alias("first_fact"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def index_lookup_semi(t):
    return t("orders").join(t("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def index_lookup_anti(t):
    return t("orders").join(t("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT 'order' AS kind, o_orderkey AS entity FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def hidden_entity_antijoin(t):
    orders, customers = t("orders"), t("customer")
    hidden = orders.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("entity"))
    return hidden.unionByName(customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("entity")))


@query("""SELECT p_brand, count(*) AS n_lines, count(DISTINCT p_partkey) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pair_reference_lookup(t):
    known = t("part").select("p_partkey", "p_brand")
    return t("lineitem").join(known, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("p_partkey").alias("n_parts"))


@query("""SELECT a.user_id, count(*) AS n_pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
    AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND GROUP BY 1""")
def self_join_temporal(t):
    events = t("events")
    pairs = joins.followed_within(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "ts", 3600)
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("""SELECT CASE WHEN o_orderkey IN (SELECT s_suppkey FROM supplier) THEN 'supplier' WHEN o_orderkey IN (SELECT c_custkey FROM customer) THEN 'customer'
    WHEN o_orderkey IN (SELECT p_partkey FROM part) THEN 'part' ELSE 'none' END AS bound_to, count(*) AS n FROM orders GROUP BY 1""")
def multi_attempt_bind(t):
    attempts = [("supplier", t("supplier"), "s_suppkey"), ("customer", t("customer"), "c_custkey"), ("part", t("part"), "p_partkey")]
    return joins.first_attempt(t("orders").select("o_orderkey"), "o_orderkey", attempts).groupBy("bound_to").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_lines IS NULL THEN 'UNRESOLVED' WHEN n_lines >= 3 AND o_orderstatus <> 'P' THEN 'MATCH' ELSE 'MISMATCH' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY 1""")
def claim_status_agg(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return joins.claim_status(t("orders"), lines, "o_orderkey", "n_lines >= 3 AND o_orderstatus <> 'P'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE month(o_orderdate) = 3 OR month(l_shipdate) = 3 GROUP BY 1""")
def timestamp_window_any(t):
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where(F.exists(F.array("o_orderdate", "l_shipdate"), lambda d: F.month(d) == 3)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT minute, e * p AS n_pairs FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) FILTER (event_type = 'error') AS e,
    count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) WHERE e * p > 0""")
def minute_bucket_correlate(t):
    side = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    counts = t("events").groupBy(minute(F.col("ts")).alias("minute")).agg((side("error") * side("purchase")).alias("n_pairs"))
    return counts.where("n_pairs > 0")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS sum_k, min(CAST(props->>'k' AS BIGINT)) AS min_k, max(CAST(props->>'k' AS BIGINT)) AS max_k FROM events GROUP BY 1")
def json_field_extract(t):
    k = json_long("props", "k")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"))
