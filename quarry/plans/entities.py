"""Entity queries: scores, caps, outliers, rollups, presence and graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.columns import first_of
from quarry.operators import entities, graph
from quarry.streaming.windows import windowed_counts

from .catalogue import query

WEIGHTS = {"error": 5, "purchase": 3, "signup": 2, "click": 1, "view": 1}
_SCORES = """(SELECT user_id, CAST(sum(least(n, 4) * w) + CASE WHEN count(*) >= 3 THEN 3 ELSE 0 END AS BIGINT) AS score, CAST(sum(n) AS BIGINT) AS n_facts, count(*) AS n_kinds
    FROM (SELECT user_id, event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS w FROM events GROUP BY 1, 2) GROUP BY 1)"""


def _scores(t):
    return entities.scores(t("events"), "user_id", "event_type", WEIGHTS)


@query(f"SELECT user_id, score, n_facts, n_kinds FROM {_SCORES}")
def entity_group_score(t):
    return _scores(t)


@query(f"SELECT user_id, score, row_number() OVER (ORDER BY score DESC, n_facts DESC, user_id) <= 20 AS kept FROM {_SCORES}")
def candidate_order_cap(t):
    return entities.ordered_cap(_scores(t), "user_id", [F.desc("score"), F.desc("n_facts"), F.asc("user_id")], 20).select("user_id", "score", "kept")


@query(f"SELECT CASE WHEN score >= 50 THEN 'strong' WHEN n_kinds >= 5 THEN 'broad' WHEN n_facts >= 40 THEN 'busy' ELSE 'rest' END AS bucket, count(*) AS n FROM {_SCORES} GROUP BY 1")
def recall_ceiling(t):
    bucket = first_of([("strong", "score >= 50"), ("broad", "n_kinds >= 5"), ("busy", "n_facts >= 40")], "rest")
    return _scores(t).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY 1), s AS (SELECT avg(total) AS m, stddev_pop(total) AS d, count(*) AS n FROM u)
    SELECT user_id, total, n >= 8 AND total > m + 2 * d AS is_outlier FROM u, s""")
def egress_outlier(t):
    return entities.outliers(t("events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total")), "total")


@query("""SELECT p_brand, p_type, n, n_items FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, n_items DESC, p_type DESC) AS r
    FROM (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n_items FROM part GROUP BY 1, 2)) WHERE r = 1 AND n_items >= 3""")
def extension_burst(t):
    return entities.dominant(t("part"), "p_brand", "p_type", "p_size")


@query("SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def usage_rollup(t):
    return t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"))


@query("""SELECT event_id, event_type, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
    WHERE r <= CASE WHEN event_type IN ('error', 'purchase') THEN 20 ELSE 5 END""")
def stratified_topk(t):
    return entities.stratified_top(t("events"), "event_type", [F.desc("value"), F.asc("event_id")], {"error": 20, "purchase": 20}, 5).select("event_id", "event_type", "rank")


@query("""SELECT doc_id, lang, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS used FROM documents) WHERE used <= 200000""")
def cumulative_budget_prefix(t):
    return entities.budget_prefix(t("documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 200_000).select("doc_id", "lang", "used")


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"bool_or(event_type = '{k}') AS in_{k}" for k in _KINDS) + " FROM events GROUP BY 1")
def cross_view_presence(t):
    return entities.presence(t("events"), "user_id", "event_type", _KINDS)


@query("SELECT user_id, n FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1) WHERE n >= 2")
def consensus_2plus(t):
    seen = t("events").where(F.col("event_type").isin("error", "purchase", "signup"))
    return seen.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n >= 2")


@query("""SELECT user_id, risk, CASE WHEN risk >= 60 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS tier FROM (
    SELECT user_id, least(40, 4 * count(*) FILTER (event_type = 'error')) + least(30, count(*) FILTER (event_type = 'purchase')) + least(30, count(*) FILTER (value > 90)) AS risk FROM events GROUP BY 1)""")
def user_risk_score(t):
    part = lambda c, w, cap: F.least(F.lit(cap).cast("long"), w * F.count(F.when(F.expr(c), 1)))
    risk = part("event_type = 'error'", 4, 40) + part("event_type = 'purchase'", 1, 30) + part("value > 90", 1, 30)
    users = t("events").groupBy("user_id").agg(risk.alias("risk"))
    return users.withColumn("tier", first_of([("high", "risk >= 60"), ("medium", "risk >= 30")], "low"))


@query("""SELECT event_type, user_id, n, round(n / next_n, 3) AS ratio FROM (SELECT *, lead(n) OVER w AS next_n, row_number() OVER w AS r FROM
    (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY n DESC, user_id)) WHERE r = 1""")
def top_user_ratio(t):
    counts = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    top = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return top.withColumn("next_n", F.lead("n").over(order)).where("rank = 1").select("event_type", "user_id", "n", F.round(F.col("n") / F.col("next_n"), 3).alias("ratio"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n, min_by(event_id, (ts, event_id)) AS first_event FROM events WHERE event_type = 'signup' GROUP BY 1")
def logon_first_seen(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t("events").where("event_type = 'signup'").groupBy("user_id").agg(text(F.min("ts")).alias("first_seen"), text(F.max("ts")).alias("last_seen"), F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("""SELECT kinds, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS kinds, count(*) AS n
    FROM events GROUP BY 1) GROUP BY 1""")
def behavior_group(t):
    users = t("events").groupBy("user_id").agg(F.concat_ws("+", F.array_sort(F.collect_set("event_type"))).alias("kinds"), F.count(F.lit(1)).alias("n"))
    return users.groupBy("kinds").agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_events"))


# Orders whose numbers stand in the same 500 are joined one to the next; labels have to travel the whole chain.
@query("SELECT o_orderkey AS node, component FROM (SELECT o_orderkey, min(o_orderkey) OVER w AS component, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderkey // 500)) WHERE n > 1")
def connected_components(t):
    chain = Window.partitionBy(F.floor(F.col("o_orderkey") / 500)).orderBy("o_orderkey")
    edges = t("orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(chain).alias("b")).where("b IS NOT NULL")
    return graph.connected_components(edges)


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_size, p_partkey) AS r FROM part) WHERE r <= 25")
def tool_rank(t):
    return t("part").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(25).select("p_partkey", "p_brand")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(t):
    return windowed_counts(t("events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n_events", "total")
