"""Routing queries: deduplication, verdicts, confidence, buckets and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import first_of, names_of
from quarry.operators import entities

from .catalogue import query


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderpriority, -o_totalprice, o_orderkey)) AS o_orderkey, min_by(o_orderpriority, (o_orderpriority, -o_totalprice, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1")
def dedup_max_by_rank(t):
    return entities.best_by_rank(t("orders"), "o_custkey", [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"])


_RANK = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query(f"SELECT o_custkey, min_by(o_orderkey, ({_RANK}, o_orderkey)) AS o_orderkey, min_by(o_orderstatus, ({_RANK}, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def cross_bucket_priority(t):
    return entities.best_by_rank(t("orders"), "o_custkey", [F.expr(_RANK).alias("r"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT v)), ',') AS verdicts, count(DISTINCT v) > 1 AS conflict
    FROM (SELECT source, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS v FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def verdict_contradiction(t):
    verdict = first_of([("toxic", "toxic = 1"), ("good", "quality = 1")], "poor")
    seen = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").withColumn("v", verdict)
    kinds = seen.groupBy("source").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return kinds.select("source", F.concat_ws(",", "v").alias("verdicts"), (F.size("v") > 1).alias("conflict"))


_LINES = "(SELECT o_orderkey, o_orderpriority, o_orderstatus, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def _lines(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(lines, "o_orderkey", "left").fillna(0, ["n"])


_BASE = "CAST(5 - CAST(left(o_orderpriority, 1) AS INTEGER) AS BIGINT)"
_CEILING = "CASE WHEN n >= 5 THEN 4 WHEN n >= 3 THEN 3 WHEN n >= 1 THEN 2 ELSE 0 END"


@query(f"SELECT confidence, count(*) AS n_orders FROM (SELECT least({_BASE}, {_CEILING}) AS confidence FROM {_LINES}) GROUP BY 1")
def confidence_ceiling(t):
    return _lines(t).groupBy(F.expr(f"least({_BASE}, CAST({_CEILING} AS BIGINT))").alias("confidence")).agg(F.count(F.lit(1)).alias("n_orders"))


@query(f"SELECT o_orderstatus, CAST(sum(greatest(1, least(3, {_BASE}))) AS BIGINT) AS clamped, CAST(sum({_BASE}) AS BIGINT) AS raw FROM {_LINES} GROUP BY 1")
def severity_clamp(t):
    return _lines(t).groupBy("o_orderstatus").agg(F.sum(F.expr(f"greatest(1L, least(3L, {_BASE}))")).alias("clamped"), F.sum(F.expr(_BASE)).alias("raw"))


ROUTES = [("confirmed", "n >= 6 AND o_orderstatus = 'F'"), ("benign", "o_orderstatus = 'O' AND n <= 2"), ("inconclusive", "n = 0"), ("synthesis", "o_orderpriority LIKE '1%'")]
_ROUTE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in ROUTES) + " ELSE 'review' END"


@query(f"SELECT {_ROUTE} AS disposition, count(*) AS n_orders FROM {_LINES} GROUP BY 1")
def router_case(t):
    return _lines(t).groupBy(first_of(ROUTES, "review").alias("disposition")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_findings, count(*) = count(DISTINCT o_orderkey) AS is_partition FROM orders")
def partition_proof(t):
    routed = _lines(t).withColumn("disposition", first_of(ROUTES, "review"))
    each = routed.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_findings"), (F.max("n") == 1).alias("is_partition"))


@query("""SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) < coalesce(a.n, 0) AS regressed
    FROM (SELECT event_type, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY 1) b ON a.event_type = b.event_type""")
def coverage_regression(t):
    half = lambda c, n: t("events").where(c).groupBy("event_type").agg(F.count(F.lit(1)).alias(n))
    both = half("day(ts) <= 15", "before").join(half("day(ts) > 15", "after"), "event_type", "full").fillna(0, ["before", "after"])
    return both.withColumn("regressed", F.col("after") < F.col("before"))


@query("""SELECT o_orderpriority, count(*) FILTER (year(o_orderdate) % 2 = 0) AS even_years, count(*) FILTER (year(o_orderdate) % 2 = 1) AS odd_years,
    count(*) FILTER (year(o_orderdate) % 2 = 1) - count(*) FILTER (year(o_orderdate) % 2 = 0) AS drift FROM orders GROUP BY 1""")
def severity_drift(t):
    side = lambda k: F.count(F.when(F.year("o_orderdate") % 2 == k, 1))
    return t("orders").groupBy("o_orderpriority").agg(side(0).alias("even_years"), side(1).alias("odd_years"), (side(1) - side(0)).alias("drift"))


_REASONS = [("error", "event_type = 'error'"), ("high_value", "value > 95"), ("night", "hour(ts) < 6")]


@query("SELECT event_id, concat_ws(','" + "".join(f", CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS) + ") AS reasons FROM events WHERE " + " OR ".join(f"({c})" for _, c in _REASONS))
def salience_reasons(t):
    return t("events").withColumn("reasons", names_of(_REASONS)).where("reasons <> ''").select("event_id", "reasons")
