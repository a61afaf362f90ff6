"""Caps, writers, noise, salience and rewrites over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import selection as S

from .catalogue import query
from .scalars import pick


@query("SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 20 ELSE 5 END")
def arrival_caps(t):
    return S.arrival_cap(t("events").select("event_type", "event_id"), "event_type", "event_id", {"error": 30, "purchase": 20}, 5)


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1")
def first_and_last_writers(t):
    return S.writers(t("orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY l_suppkey % 50, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END, l_partkey // 64")
def offset_dedup(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 50).alias("file"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("name"), F.col("l_partkey").alias("offset"))
    return S.by_offset(rows, ["file", "name"], "offset", "id", 64).select("id")


_TOOLS = [["run_appcompatcacheparser"], ["get_amcache", "parse_prefetch"], ["get_amcache", "vol_malfind"], ["run_mftecmd", "other"], []]
_WHY = ["plain", "credential dumping", "listed", "egress outlier"]


@query("SELECT o_orderkey AS finding_id, o_orderkey % 3 = 0 AND o_custkey % 5 IN (0, 1) AND o_custkey % 4 IN (0, 2) AS demoted FROM orders")
def history_only_confirms(t):
    tools = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _TOOLS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    rows = t("orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderkey") % 3 == 0, "confirmed_malicious_atomic").otherwise("suspicious_needs_review").alias("bucket"), tools.alias("source_tools"), F.array(pick(_WHY, "o_custkey")).alias("reasons"), F.array(F.lit("executes_from_temp_path")).alias("signals"), F.array(F.lit("path")).alias("claim_types"))
    return rows.select("finding_id", S.history_only().alias("demoted"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'no_injection_facts' WHEN p_size % 7 = 0 THEN 'payload_corroborated' WHEN p_partkey % 5 = 0 THEN 'payload_signature_present' WHEN p_size % 3 = 0 THEN 'not_a_managed_jit_host' WHEN p_size % 5 = 0 THEN 'unlinked_dll_present' WHEN p_partkey % 13 = 0 THEN 'external_egress_present' WHEN p_partkey % 17 = 0 THEN 'ancestry_violation_present' ELSE 'benign_jit_rwx' END AS reason FROM part""")
def managed_rwx_rails(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(F.lit("code"), F.lit(" MZ_PE"))).otherwise(F.array(F.lit("code")))
    rows = t("part").select("p_partkey", kinds.alias("characterizations"), (size % 7 == 0).alias("corroborated"), (size % 3 != 0).alias("managed"), (size % 5 == 0).alias("unlinked"), (k % 13 == 0).alias("egress"), (k % 17 == 0).alias("odd_parent"))
    return rows.select("p_partkey", S.managed_rwx().alias("reason"))


_SALIENT = """(SELECT c_custkey, array_to_string(list_filter([CASE WHEN (c_custkey % 3 = 0 OR c_custkey % 7 = 0) AND c_custkey % 5 <> 0 THEN 'public_non_vendor_peer' END, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 6 <> 0 AND c_nationkey % 3 <> 0 THEN 'non_baseline_high_port_listener' END,
    CASE WHEN c_nationkey % 3 = 1 THEN 'lolbin_owner_network' END, CASE WHEN c_custkey % 5 = 1 THEN 'encoded_or_download_url' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer)"""


def _salient(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(F.when(k % 5 == 0, "http://google.com/x ").when(k % 5 == 1, "http://h.evil.org/x downloadstring ").otherwise("plain "), F.when(k % 7 == 0, "9.9.9.9").otherwise("10.0.0.1"))
    rows = t("customer").select("c_custkey", F.when(n % 3 == 0, "svchost.exe").when(n % 3 == 1, "powershell").otherwise("app.exe").alias("owner"), F.when(k % 3 == 0, "8.8.4.4").otherwise("192.168.0.1").alias("dst_ip"), F.when(k % 6 == 0, "80").otherwise("4444").alias("src_port"), F.when(k % 4 == 0, "Listening").alias("state"), text.alias("text"))
    return rows.select("c_custkey", S.salience().alias("reasons"))


@query(f"SELECT * FROM {_SALIENT}")
def network_salience(t):
    return _salient(t).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM {_SALIENT}) WHERE reason <> '' GROUP BY 1")
def salience_summary(t):
    return _salient(t).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, 'seen ' || CASE WHEN s_suppkey % 3 = 0 THEN 'private/internal address 10.0.0.' || (s_suppkey % 200) WHEN s_suppkey % 3 = 1 THEN 'external IP 8.8.' || (s_suppkey % 200) || '.4' ELSE 'private/internal address 192.168.1.' || (s_suppkey % 200) END || ' twice' AS text FROM supplier")
def private_wording(t):
    k = F.col("s_suppkey")
    n = (k % 200).cast("string")
    text = F.concat(F.lit("seen "), F.when(k % 3 == 0, F.concat(F.lit("external IP 10.0.0."), n)).when(k % 3 == 1, F.concat(F.lit("external IP 8.8."), n, F.lit(".4"))).otherwise(F.concat(F.lit("public ip address 192.168.1."), n)), F.lit(" twice"))
    return t("supplier").select("s_suppkey", S.honest_addresses(text).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 4 = 3 THEN 'pseudo' WHEN c_nationkey % 4 = 2 THEN 'derived' ELSE 'tool' END AS kind FROM customer")
def provenance_kinds(t):
    tools = t("nation").where("n_nationkey % 4 < 3").select(F.concat(F.lit("Tool"), F.col("n_nationkey").cast("string")).alias("tool"), (F.col("n_nationkey") % 4 == 2).alias("derived"))
    labels = t("customer").select("c_custkey", F.concat(F.lit(" tool"), F.col("c_nationkey").cast("string")).alias("label"))
    return S.provenance("label", tools, labels).select("c_custkey", "kind")


@query("SELECT s_suppkey AS fact_id, CASE s_suppkey % 3 WHEN 0 THEN 'fact_type,pid,type' WHEN 1 THEN 'fact_type,hash,type,value' END AS names FROM supplier WHERE s_suppkey % 3 < 2")
def fact_claims(t):
    k = F.col("s_suppkey")
    fields = F.when(k % 3 == 0, F.create_map(F.lit("pid"), k.cast("string"))).when(k % 3 == 1, F.create_map(F.lit("sha1"), F.lit("ab"), F.lit("path"), F.lit("p"))).otherwise(F.create_map(F.lit("note"), F.lit("x")))
    made = S.typed_claims(t("supplier").select(k.alias("fact_id"), F.lit("a_fact").alias("fact_type"), fields.alias("fields")))
    return made.select("fact_id", F.array_join(F.array_sort(F.map_keys("claim")), ",").alias("names"))


@query("SELECT o_orderkey AS report_id, o_custkey AS finding_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def uncited_findings(t):
    valid = t("customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("finding_id"))
    return S.uncited(t("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("finding_id")), valid).select("report_id", "finding_id")


@query("SELECT p_partkey AS candidate_id FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def prompt_reserve(t):
    found = t("part").select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("parse_registry_persistence"))).otherwise(F.array(F.lit("x"))).alias("source_tools"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 2 == 0).alias("ready"))
    return S.reserve(found, t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("candidate_id")), ["parse_registry_persistence"], 12).select("candidate_id")


@query("SELECT finding_id, open AND row_number() OVER (PARTITION BY open ORDER BY rank, finding_id) <= 80 AS asked FROM (SELECT o_orderkey AS finding_id, o_custkey AS rank, o_orderkey % 3 < 2 AS open FROM orders)")
def adjudication_budget(t):
    rows = t("orders").select(F.col("o_orderkey").alias("finding_id"), F.element_at(F.array(*map(F.lit, ["suspicious_needs_review", "inconclusive_unresolved", "benign_or_false_positive"])), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("bucket"), F.col("o_custkey").alias("rank"))
    return S.budgeted(rows).select("finding_id", "asked")
