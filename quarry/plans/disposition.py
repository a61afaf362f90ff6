"""Gates, router and reconciliation over findings made of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import disposition as D
from quarry.operators import reconcile as R

from .catalogue import query
from .scalars import sql_list

# Each feature of a finding takes one of these values by the order's number.
_SEVERITY, _CONFIDENCE = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "SPECULATIVE"], ["HIGH", "MEDIUM", "HIGH", "LOW", "MEDIUM", "SPECULATIVE", ""]
_VERDICTS = [None, "malicious", None, "benign", "malicious", "inconclusive", None, "likely_false_positive", "malicious"]
_SIGNALS = [[], ["executes_from_temp_path"], ["srum_egress_outlier"], ["rwx_memory_region_with_unusual_protection"], ["rwx_memory_region_with_unusual_protection", "process_hollowing_indicators"], ["c2_staging_domain"], ["ifeo_debugger_hijack"], ["lnk_execution_from_staging", "executes_from_temp_path"]]
_CLAIMS = [
    [], [{"type": "pid", "pid": "7", "process": "a.exe"}], [{"type": "pid", "pid": "7"}, {"type": "connection", "foreign_addr": "8.8.4.4"}], [{"type": "path", "path": "C:\\t\\a.exe"}, {"type": "hash", "sha1": "a" * 40}],
    [{"type": "pid", "pid": str(i), "process": f"{i}.exe"} for i in range(3)], [{"type": "process_exists", "pid": "9"}, {"type": "pid", "pid": "9", "action": "inject"}], [{"type": "connection", "foreign_addr": "10.0.0.5"}],
    [{"type": "pid", "pid": str(i)} for i in range(3)],
]
_TOOLS, _TYPES, _SUPPORT = [["vol_malfind", "vol_ldrmodules"], ["vol_netscan"], ["get_amcache"], [], ["vol_malfind"]], [[], ["process_fact"], ["process_fact", "sid_fact"], ["process_fact"]], [[], ["a"], ["a"], ["a", "b"]]
_TITLES, _TYPES_OF = ["Injected code in a.exe", "Full attack chain: a -> b -> c", "Odd service", "", "Attack chain summary"], ["atomic", "atomic", "atomic", "synthesis", "atomic", "narrative"]
#: Feature: (divisor, values); its index is h // divisor % n.
_INDEX = {"sev": (1, 5), "conf": (3, 7), "ver": (5, 9), "sig": (7, 8), "cl": (11, 8), "tool": (13, 5), "ft": (17, 4), "ti": (19, 5), "kind": (23, 6)}
_FLAGS = {"entity_conflict": (29, 17), "fp_routing": (31, 19), "jit_rwx": (37, 23), "tool_noise": (41, 29), "route_out": (43, 21), "blocked": (47, 9), "no_support": (53, 4), "is_context": (59, 5), "is_synthesis": (61, 31), "deterministic": (67, 3), "unvalidated": (71, 3), "no_excerpt": (73, 9), "no_calls": (79, 9), "concrete": (83, 7), "long_story": (89, 6), "no_axes": (97, 2)}


def _findings(t):
    """Findings of all orders."""
    h = t("orders").select("o_orderkey", F.expr("o_orderkey * 31 + o_custkey * 7").alias("h"))
    index = h.select("o_orderkey", *(F.expr(f"cast((h div {p}) % {n} as int)").alias(k) for k, (p, n) in _INDEX.items()), *(F.expr(f"(h div {p}) % {n} = 0").alias(k) for k, (p, n) in _FLAGS.items()))
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    at = lambda values, k: F.element_at(F.array(*values), F.col(k) + 1)
    claim = lambda c: F.create_map(*(F.lit(x) for kv in c.items() for x in kv))
    many = [F.array(*map(claim, c)) if c else F.array().cast("array<map<string,string>>") for c in _CLAIMS]
    none = texts([])
    return index.select(
        F.col("o_orderkey").alias("finding_id"), at(map(F.lit, _SEVERITY), "sev").alias("severity"), at(map(F.lit, _CONFIDENCE), "conf").alias("confidence"), at([F.lit(v).cast("string") for v in _VERDICTS], "ver").alias("verdict"), at(map(texts, _SIGNALS), "sig").alias("signals"),
        at(many, "cl").alias("claims"), at(map(texts, _TOOLS), "tool").alias("source_tools"), at(map(texts, _TYPES), "ft").alias("fact_types"), at(map(texts, _SUPPORT), "ft").alias("support_tools"), at(map(F.lit, _TITLES), "ti").alias("title"),
        at(map(F.lit, _TYPES_OF), "kind").alias("finding_type"), F.lit("").alias("evidence_type"), F.when(F.col("long_story"), "a multi-stage intrusion").otherwise("plain").alias("description"), F.when(F.col("no_excerpt"), " ").otherwise("raw").alias("raw_excerpt"),
        F.when(F.col("no_calls"), none).otherwise(texts(["c1"])).alias("tool_calls"), F.when(F.col("no_support"), none).otherwise(at(map(texts, _SIGNALS), "sig")).alias("supported"), F.when(F.col("is_context"), texts(["listening_port"])).otherwise(none).alias("context"),
        F.when(F.col("no_axes"), 1).otherwise(2).alias("c2_axes"), (~F.col("unvalidated")).alias("validated"), "entity_conflict", "fp_routing", "jit_rwx", "tool_noise", "route_out", "blocked", "is_synthesis", "deterministic", "concrete")


_F = f"""(SELECT o_orderkey AS finding_id, {", ".join(f"(h // {p}) % {n} AS {k}" for k, (p, n) in _INDEX.items())}, {", ".join(f"(h // {p}) % {n} = 0 AS {k}" for k, (p, n) in _FLAGS.items())} FROM (SELECT o_orderkey, o_orderkey * 31 + o_custkey * 7 AS h FROM orders))"""
# What the features amount to: a public peer is named by one list of claims alone, which also speaks of a connection.
_G = f"""(SELECT *, {sql_list(_SEVERITY)}[sev + 1] AS severity, {sql_list(_CONFIDENCE)}[conf + 1] AS confidence, [{", ".join("NULL" if v is None else f"'{v}'" for v in _VERDICTS)}][ver + 1] AS verdict, sig > 0 AS has_signal, sig IN (0, 1, 3, 7) AS weak, ft >= 2 AS strong,
    [0, 1, 2, 2, 3, 2, 1, 3][cl + 1] AS n_claims, cl = 2 AS peer, tool = 0 AS two_methods, tool = 2 AND cl = 3 AS hashed, NOT unvalidated AS validated,
    (NOT (deterministic AND sig > 0)) AND (kind IN (3, 5) OR is_synthesis OR cl = 4 OR (CAST(ti IN (1, 4) AS INTEGER) + CAST(long_story AS INTEGER) + CAST(cl IN (4, 7) AS INTEGER) + CAST(ti = 1 AS INTEGER)) >= 2) AS narrative FROM {_F})"""
_WHY = """list_filter([CASE WHEN ti = 3 THEN 'missing_core_field:title' END, CASE WHEN cl = 0 THEN 'no_checkable_claims' END, CASE WHEN NOT validated AND ft = 0 THEN 'no_typed_or_validated_support' END, CASE WHEN route_out THEN 'severity_ledger_route_out' END,
    CASE WHEN verdict IN ('benign', 'likely_false_positive', 'inconclusive') THEN 'react_verdict_benign_or_false_positive' END, CASE WHEN confidence = '' THEN 'confidence_missing' END, CASE WHEN confidence = 'SPECULATIVE' THEN 'confidence_speculative' END,
    CASE WHEN tool = 3 THEN 'empty_source_tools' END, CASE WHEN no_calls THEN 'missing_tool_call_ids' END, CASE WHEN no_excerpt THEN 'missing_raw_excerpt' END, CASE WHEN NOT has_signal THEN 'no_malicious_semantic_signal' END, CASE WHEN NOT has_signal AND is_context THEN 'environment_context_only' END,
    CASE WHEN sig IN (1, 3, 7) AND NOT (peer OR two_methods OR strong OR concrete OR hashed) THEN 'weak_alone_signal_uncorroborated' END, CASE WHEN ft = 0 THEN 'no_explicit_fact_id_in_claims' END, CASE WHEN ft = 0 THEN 'no_durable_fact_refs' END,
    CASE WHEN has_signal AND no_support THEN 'no_semantic_signal_provenance' END, CASE WHEN has_signal AND no_support THEN 'malicious_semantic_provenance_missing' END, CASE WHEN cl IN (0, 1, 4, 7) THEN 'pid_or_process_existence_only' END, CASE WHEN entity_conflict THEN 'react_entity_verdict_conflict' END,
    CASE WHEN sig IN (1, 3) AND NOT peer AND NOT two_methods THEN 'rwx_memory_region_uncorroborated' END, CASE WHEN sig = 5 AND no_axes THEN 'c2_staging_domain_uncorroborated' END], lambda x: x IS NOT NULL)"""
_R = f"""(SELECT *, CASE WHEN entity_conflict THEN 'entity_conflict' WHEN fp_routing THEN 'fp_routing' WHEN jit_rwx THEN 'jit_rwx' WHEN tool_noise THEN 'tool_status_noise' WHEN route_out THEN 'severity_ledger'
    WHEN verdict IN ('benign', 'likely_false_positive') THEN CASE WHEN sig = 2 THEN 'benign_vs_anomaly' WHEN sig = 6 THEN 'benign_vs_persistence' ELSE 'benign' END WHEN verdict = 'inconclusive' THEN 'inconclusive' WHEN narrative THEN 'synthesis'
    WHEN severity IN ('CRITICAL', 'HIGH') AND confidence = 'LOW' THEN 'severe_with_low_confidence' WHEN is_context AND NOT has_signal THEN 'environment_only'
    WHEN n_claims < 2 AND NOT strong THEN CASE WHEN coalesce(verdict, '') <> 'malicious' AND weak THEN CASE WHEN severity IN ('LOW', 'SPECULATIVE') THEN 'one_claim_weak' ELSE 'one_claim_unbound' END WHEN verdict = 'malicious' THEN 'one_claim_malicious'
        WHEN deterministic AND has_signal AND NOT weak AND NOT no_support THEN 'one_claim_deterministic' ELSE 'one_claim' END
    WHEN blocked THEN 'blocked' WHEN len({_WHY}) > 0 THEN CASE WHEN coalesce(verdict, '') <> 'malicious' AND weak AND NOT strong THEN 'weak_only' ELSE 'not_eligible' END ELSE 'all_gates_cleared' END AS rule FROM {_G})"""
_BUCKET = f"""CASE WHEN rule IN ('fp_routing', 'jit_rwx', 'tool_status_noise', 'benign', 'one_claim_weak', 'weak_only') THEN '{D.BENIGN}' WHEN rule IN ('inconclusive', 'one_claim_unbound', 'one_claim') THEN '{D.INCONCLUSIVE}' WHEN rule = 'synthesis' THEN '{D.SYNTHESIS}' WHEN rule = 'all_gates_cleared' THEN '{D.CONFIRMED}' ELSE '{D.REVIEW}' END"""


@query(f"SELECT finding_id, array_to_string({_WHY}, ',') AS reasons, len({_WHY}) = 0 AS eligible FROM {_G}")
def eligibility_gates(t):
    judged = D.eligibility(_findings(t))
    return judged.select("finding_id", F.array_join("blocking_reasons", ",").alias("reasons"), (F.size("failed_gates") == 0).alias("eligible"))


@query(f"SELECT finding_id, rule, {_BUCKET} AS bucket FROM {_R}")
def router_full(t):
    return D.route(_findings(t)).select("finding_id", "rule", "bucket")


_LATE = f"(SELECT *, {_BUCKET} AS bucket, fp_routing OR jit_rwx OR tool_noise OR finding_id % 13 = 0 AS says FROM {_R})"


@query(f"""SELECT finding_id, CASE WHEN bucket IN ('{D.REVIEW}', '{D.INCONCLUSIVE}') AND (says OR coalesce(verdict, '') IN ('benign', 'likely_false_positive')) AND NOT entity_conflict AND NOT route_out THEN '{D.BENIGN}' ELSE bucket END AS bucket FROM {_LATE}""")
def late_benign_pass(t):
    routed = D.route(_findings(t)).withColumn("tool_noise", F.col("tool_noise") | (F.col("finding_id") % 13 == 0))
    return D.late_benign(routed).select("finding_id", "bucket")


@query(f"""WITH placed AS (SELECT finding_id, {_BUCKET} AS bucket FROM {_R} WHERE finding_id % 97 <> 0 UNION ALL SELECT finding_id, '{D.REVIEW}' FROM {_R} WHERE finding_id % 89 = 0 UNION ALL SELECT -finding_id, '{D.BENIGN}' FROM {_R} WHERE finding_id % 83 = 0 UNION ALL SELECT finding_id, 'elsewhere' FROM {_R} WHERE finding_id % 79 = 0),
    w AS (SELECT finding_id, count(*) AS n, count(*) FILTER (bucket = 'elsewhere') AS odd FROM placed GROUP BY 1), b AS (SELECT coalesce(w.finding_id, f.o_orderkey) AS finding_id, n, odd, f.o_orderkey AS m FROM w FULL JOIN orders f ON f.o_orderkey = w.finding_id)
    SELECT fault, count(*) AS n, CAST(sum(finding_id) AS BIGINT) AS ids FROM (SELECT finding_id, unnest(list_filter([CASE WHEN n IS NULL THEN 'absent' END, CASE WHEN m IS NULL THEN 'orphan' END, CASE WHEN n > 1 THEN 'several' END, CASE WHEN odd > 0 THEN 'unknown_bucket' END], lambda x: x IS NOT NULL)) AS fault FROM b) GROUP BY 1""")
def bucket_partition_faults(t):
    routed = D.route(_findings(t)).select("finding_id", "bucket")
    placed = routed.where("finding_id % 97 <> 0").unionByName(routed.where("finding_id % 89 = 0").withColumn("bucket", F.lit(D.REVIEW)))
    placed = placed.unionByName(routed.where("finding_id % 83 = 0").select((-F.col("finding_id")).alias("finding_id"), F.lit(D.BENIGN).alias("bucket"))).unionByName(routed.where("finding_id % 79 = 0").withColumn("bucket", F.lit("elsewhere")))
    faults = D.partition_faults(placed, t("orders").select(F.col("o_orderkey").alias("finding_id")))
    return faults.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.sum("finding_id").alias("ids"))


# -- identities -----------------------------------------------------------------------------

_BLOCK = "(o_orderkey // 64)"
_ORDERS = f"(SELECT o_orderkey AS finding_id, o_orderkey // 64 // 5 AS grp, o_custkey % 7 AS n_tools, o_custkey % 5 AS n_claims, o_orderkey // 64 // 5 % 5 AS by_group, o_custkey % 3 AS by_order FROM orders)"


def _linked(t, bucket):
    """Orders whose keys join five neighbouring blocks of order numbers into a group."""
    k = F.col("o_orderkey")
    second = F.floor((k + 32) / 64)
    keys = F.array_compact(F.array(F.concat(F.lit("a:"), F.floor(k / 64).cast("string")), F.when(second % 5 != 0, F.concat(F.lit("b:"), second.cast("string")))))
    return t("orders").select(k.alias("finding_id"), keys.alias("keys"), (F.col("o_custkey") % 7).alias("n_tools"), (F.col("o_custkey") % 5).alias("n_claims"), bucket.alias("bucket"))


@query(f"""SELECT finding_id, merged_into FROM (SELECT finding_id, first_value(finding_id) OVER (PARTITION BY grp ORDER BY n_tools DESC, n_claims DESC, finding_id) AS merged_into FROM {_ORDERS} WHERE by_group = 0) WHERE finding_id <> merged_into""")
def dedup_within(t):
    buckets = F.element_at(F.array(*map(F.lit, D.BUCKETS)), (F.floor(F.floor(F.col("o_orderkey") / 64) / 5) % 5 + 1).cast("int"))
    return R.dedup_within(_linked(t, buckets), D.CONFIRMED)


@query(f"""SELECT finding_id, from_bucket, merged_into, into_bucket FROM (SELECT finding_id, b AS from_bucket, first_value(finding_id) OVER w AS merged_into, first_value(b) OVER w AS into_bucket, min(by_order) OVER (PARTITION BY grp) < max(by_order) OVER (PARTITION BY grp) AS spans
    FROM (SELECT *, ['{D.CONFIRMED}', '{D.REVIEW}', '{D.BENIGN}'][by_order + 1] AS b FROM {_ORDERS}) WINDOW w AS (PARTITION BY grp ORDER BY by_order, n_tools DESC, n_claims DESC, finding_id)) WHERE spans AND finding_id <> merged_into""")
def dedup_across(t):
    buckets = F.element_at(F.array(*map(F.lit, (D.CONFIRMED, D.REVIEW, D.BENIGN))), (F.col("o_custkey") % 3 + 1).cast("int"))
    return R.dedup_across(_linked(t, buckets))


_HEX = "sha1(p_name)"


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k = 0 THEN 'h:' || {_HEX} END, CASE WHEN k = 1 THEN 'p:c:/dir/' || replace(p_name, ' ', '_') || '.exe' END, CASE WHEN k = 1 THEN 'p:dir/' || replace(p_name, ' ', '_') || '.exe' END,
    CASE WHEN k = 2 THEN 'r:hklm/software/' || replace(p_name, ' ', '/') END, CASE WHEN k = 3 THEN 'evt:4624|2024-01-02T03:04:05|10.0.0.' || p_size END, CASE WHEN k = 4 THEN 'svc:svc' || p_size END,
    CASE WHEN k = 5 THEN 'proc:a.exe|' || p_size || '|t:;c:pid|inj:' || CASE WHEN p_partkey % 4 = 1 THEN '1' ELSE '0' END || '|peers:' || CASE WHEN p_size % 2 = 0 THEN '8.8.4.4' ELSE '' END END], lambda x: x IS NOT NULL))), ',') AS keys FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def identity_keys(t):
    k, name, size = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_size").cast("string")
    claim = lambda *pairs: F.array(F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs)))
    made = (
        F.when(k == 0, claim("type", "hash", "sha1", F.upper(F.sha1(name)))).when(k == 1, claim("type", "path", "path", F.concat(F.lit("C:\\\\dir\\"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(".exe"))))
        .when(k == 2, claim("type", "raw", "value", F.concat(F.lit("Registry key HKLM\\Software\\"), F.replace(name, F.lit(" "), F.lit("\\"))))).when(k == 3, claim("type", "event_log", "event_id", "4624"))
        .when(k == 4, claim("type", "service", "service_name", F.concat(F.lit("Svc"), size))).otherwise(claim("type", "pid", "pid", size, "process", "A.exe", "dst_ip", F.when(F.col("p_size") % 2 == 0, "8.8.4.4").otherwise("10.0.0.1")))
    )
    rows = t("part").select("p_partkey", made.alias("claims"), F.when(F.col("p_partkey") % 4 == 1, F.array(F.lit("vol_malfind"))).otherwise(F.array(F.lit("x"))).alias("source_tools"), F.lit("").alias("raw_excerpt"), F.lit("at 2024-01-02 03:04:05Z").alias("seen_at"), F.concat(F.lit("10.0.0."), size).alias("artifact"))
    return rows.select("p_partkey", F.array_join(R.exact_keys(), ",").alias("keys"))


_TITLE = "p_brand || ' (PID ' || p_size || ') loads ' || split_part(p_name, ' ', 1) || ' at 0x' || substr(md5(p_name), 1, 6)"
_SHAPE = "'brand loads ' || split_part(p_name, ' ', 1) || ' at'"
_PBUCKET = f"{sql_list(list(D.BUCKETS))}[p_partkey % 5 + 1]"


def _parts(t):
    title = F.concat(F.col("p_brand"), F.lit(" (PID "), F.col("p_size").cast("string"), F.lit(") loads "), F.split("p_name", " ")[0], F.lit(" at 0x"), F.substring(F.md5("p_name"), 1, 6))
    bucket = F.element_at(F.array(*map(F.lit, D.BUCKETS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("finding_id"), title.alias("title"), bucket.alias("bucket"), F.col("p_size"), F.col("p_brand"), F.array(F.concat(F.lit("k:"), F.col("p_brand")), F.concat(F.lit("s:"), (F.col("p_partkey") % 997).cast("string"))).alias("keys"))


@query(f"""WITH s AS (SELECT p_partkey AS finding_id, {_SHAPE} AS shape, {_PBUCKET} AS bucket FROM part), g AS (SELECT shape, bool_or(bucket = '{D.CONFIRMED}') AS c, bool_or(bucket = '{D.REVIEW}') AS r, bool_or(bucket = '{D.INCONCLUSIVE}') AS i, bool_or(bucket = '{D.BENIGN}') AS b FROM s GROUP BY 1 HAVING count(DISTINCT bucket) > 1)
    SELECT finding_id, bucket AS from_bucket, to_bucket FROM s JOIN (SELECT shape, CASE WHEN r OR ((i OR b) AND c) THEN '{D.REVIEW}' WHEN i THEN '{D.INCONCLUSIVE}' WHEN b THEN '{D.BENIGN}' ELSE '{D.REVIEW}' END AS to_bucket FROM g) USING (shape) WHERE bucket NOT IN ('{D.CONFIRMED}', '{D.SYNTHESIS}') AND bucket <> to_bucket""")
def signature_reconcile(t):
    return R.reconcile_titles(_parts(t))


_KEYED = f"(SELECT p_partkey AS finding_id, {_PBUCKET} AS bucket, unnest(['k:' || p_brand || (p_partkey % 8), 's:' || (p_partkey % 97)]) AS key, p_size % 2 = 0 AS adjudicated, p_size % 5 = 0 AS malice, p_size % 3 = 0 AND p_partkey % 5 = 3 AS strong_benign FROM part)"


def _keyed(t):
    keys = F.array(F.concat(F.lit("k:"), F.col("p_brand"), (F.col("finding_id") % 8).cast("string")), F.concat(F.lit("s:"), (F.col("finding_id") % 97).cast("string")))
    size = F.col("p_size")
    return _parts(t).withColumns({"keys": keys, "adjudicated": size % 2 == 0, "malice": size % 5 == 0, "strong_benign": (size % 3 == 0) & (F.col("finding_id") % 5 == 3), "split_justified": size % 7 == 0})


@query(f"""WITH k AS (SELECT * FROM {_KEYED} WHERE bucket <> '{D.SYNTHESIS}'), g AS (SELECT key, bool_or(bucket <> '{D.BENIGN}') AS elsewhere, bool_or(bucket = '{D.CONFIRMED}') AS confirmed FROM k GROUP BY 1)
    SELECT finding_id, min(key) AS key FROM k JOIN g USING (key) WHERE bucket = '{D.BENIGN}' AND elsewhere GROUP BY 1 HAVING NOT bool_or(adjudicated) OR bool_or(confirmed)""")
def cross_bucket_escalate(t):
    return R.escalate(_keyed(t))


@query(f"""WITH k AS (SELECT * FROM {_KEYED} WHERE bucket <> '{D.SYNTHESIS}'), g AS (SELECT key, bool_or(malice) AS am, bool_or(strong_benign) AS ab FROM k GROUP BY 1 HAVING bool_or(bucket = '{D.BENIGN}') AND bool_or(bucket IN ('{D.CONFIRMED}', '{D.REVIEW}'))),
    a AS (SELECT finding_id, bucket, CASE WHEN ab AND NOT am AND bucket IN ('{D.CONFIRMED}', '{D.REVIEW}') AND NOT malice THEN CASE WHEN bucket = '{D.CONFIRMED}' THEN '{D.REVIEW}' ELSE '{D.BENIGN}' END WHEN NOT (ab AND NOT am) AND bucket IN ('{D.BENIGN}', '{D.INCONCLUSIVE}') AND NOT strong_benign THEN '{D.REVIEW}' END AS asked FROM k JOIN g USING (key))
    SELECT finding_id, bucket AS from_bucket, CASE WHEN bool_or(asked = '{D.REVIEW}') THEN '{D.REVIEW}' ELSE '{D.BENIGN}' END AS to_bucket FROM a WHERE asked IS NOT NULL GROUP BY 1, 2 HAVING bucket <> CASE WHEN bool_or(asked = '{D.REVIEW}') THEN '{D.REVIEW}' ELSE '{D.BENIGN}' END""")
def entity_split(t):
    return R.settle_split(_keyed(t))


@query(f"""SELECT p_partkey AS finding_id, CASE WHEN d THEN '{D.REVIEW}' ELSE bucket END AS bucket, d AS demoted FROM (SELECT p_partkey, {_PBUCKET} AS bucket, p_partkey % 5 = 0 AND p_size % 4 IN (0, 1) AND p_size % 3 = 0 AS d FROM part)""")
def demote_low_confidence(t):
    levels = _parts(t).withColumns({"severity": F.element_at(F.array(*map(F.lit, ["low", "INFO", "HIGH", "MEDIUM"])), F.col("p_size") % 4 + 1), "confidence": F.element_at(F.array(*map(F.lit, ["SPECULATIVE", "HIGH", "MEDIUM"])), F.col("p_size") % 3 + 1)})
    return R.demote_weak(levels).select("finding_id", "bucket", "demoted")


_BOOK = """(SELECT 'process:' || (s_suppkey % 60) AS entity_key, 'process' AS scope, ['malicious', 'benign', 'inconclusive', 'unknown'][s_nationkey % 4 + 1] AS verdict, s_suppkey AS finding_id FROM supplier
    UNION ALL SELECT 'chain:' || (s_nationkey % 7), 'chain', CASE WHEN s_nationkey % 2 = 0 THEN 'malicious' ELSE 'benign' END, s_suppkey FROM supplier)"""
_LEDGER = f"(SELECT entity_key, scope, bool_or(verdict = 'malicious') AS malicious, bool_or(verdict = 'benign') AS benign, bool_or(verdict = 'inconclusive') AS inconclusive, count(DISTINCT finding_id) AS n_findings FROM {_BOOK} WHERE verdict <> 'unknown' GROUP BY 1, 2)"


def _book(t):
    s = t("supplier")
    text = lambda c: c.cast("string")
    process = s.select(F.concat(F.lit("process:"), text(F.col("s_suppkey") % 60)).alias("entity_key"), F.lit("process").alias("scope"), F.element_at(F.array(*map(F.lit, ["malicious", "benign", "inconclusive", "unknown"])), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("verdict"), F.col("s_suppkey").alias("finding_id"))
    chain = s.select(F.concat(F.lit("chain:"), text(F.col("s_nationkey") % 7)).alias("entity_key"), F.lit("chain").alias("scope"), F.when(F.col("s_nationkey") % 2 == 0, "malicious").otherwise("benign").alias("verdict"), F.col("s_suppkey").alias("finding_id"))
    return R.ledger(process.unionByName(chain))


@query(f"SELECT * FROM {_LEDGER}")
def verdict_ledger(t):
    return _book(t)


@query(f"""WITH l AS (SELECT * FROM {_LEDGER}) SELECT entity_key, scope, 'direct_entity_verdict_conflict' AS conflict_type, CASE WHEN scope = 'process' THEN 'blocked_from_confirmed_atomic' ELSE 'flagged_for_review' END AS routing_decision FROM l WHERE malicious AND (benign OR inconclusive)
    UNION ALL SELECT entity_key, scope, 'chain_member_tension', 'blocked_from_confirmed_atomic' FROM l WHERE scope = 'process' AND (benign OR inconclusive) AND NOT malicious AND entity_key IN (SELECT 'process:' || (s_suppkey % 60) FROM supplier WHERE 'chain:' || (s_nationkey % 7) IN (SELECT entity_key FROM l WHERE scope = 'chain' AND malicious))""")
def ledger_contradictions(t):
    members = t("supplier").select(F.concat(F.lit("chain:"), (F.col("s_nationkey") % 7).cast("string")).alias("chain_key"), F.concat(F.lit("process:"), (F.col("s_suppkey") % 60).cast("string")).alias("entity_key"))
    return R.contradictions(_book(t), members)


_TOUCH = f"(SELECT p_partkey AS finding_id, {_PBUCKET} AS bucket, p_size % 7 = 0 AS sj, unnest(['process:' || (p_partkey % 90), 'process:' || (p_size % 70)]) AS key FROM part)"


def _touching(t):
    keys = F.array(*(F.concat(F.lit("process:"), c.cast("string")) for c in (F.col("finding_id") % 90, F.col("p_size") % 70)))
    return _keyed(t).withColumn("keys", keys)


@query(f"""WITH m AS (SELECT entity_key AS key, malicious AND benign AS mx, benign AND NOT malicious AS gd, malicious AND NOT benign AS bd FROM {_LEDGER} WHERE malicious OR benign), e AS (SELECT finding_id, bucket, sj, bool_or(mx) AS mx, bool_or(gd) AS gd, bool_or(bd) AS bd FROM {_TOUCH} JOIN m USING (key) WHERE bucket IN ('{D.CONFIRMED}', '{D.REVIEW}', '{D.BENIGN}') GROUP BY 1, 2, 3)
    SELECT finding_id, CASE WHEN sj THEN 'preserve_split_justified' WHEN mx THEN CASE WHEN bucket = '{D.REVIEW}' THEN 'already_review_mixed_entity' ELSE 'move_to_review_mixed_entity' END WHEN gd AND bd THEN CASE WHEN bucket = '{D.REVIEW}' THEN 'already_review_refuted_subset' ELSE 'move_to_review_refuted_subset' END
        WHEN gd THEN CASE WHEN bucket = '{D.BENIGN}' THEN 'already_benign' ELSE 'move_to_benign_refuted_entity' END ELSE 'preserve_pure_malicious_entity' END AS action FROM e""")
def contradiction_routes(t):
    return R.contradiction_routes(_touching(t), _book(t))


@query(f"""WITH m AS (SELECT entity_key AS key, malicious, benign FROM {_LEDGER} WHERE scope = 'process') SELECT finding_id, min(key) FILTER (benign AND NOT malicious) AS key FROM {_TOUCH} JOIN m USING (key) WHERE bucket = '{D.CONFIRMED}' GROUP BY 1 HAVING NOT bool_or(malicious) AND bool_or(benign)""")
def benign_only_demotions(t):
    return R.benign_only_demotions(_touching(t), _book(t))


@query("""SELECT c_custkey AS finding_id, array_to_string(list_sort(list_filter(list_distinct(['F' || lpad(CAST(c_custkey % 90 AS VARCHAR), 3, '0'), 'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0')]), lambda x: CAST(substr(x, 2) AS INTEGER) % 3 = 0)), ',') AS cited FROM customer WHERE c_custkey % 90 % 3 = 0 OR c_nationkey % 3 = 0""")
def dependent_narratives(t):
    label = lambda c: F.concat(F.lit("F"), F.lpad(c.cast("string"), 3, "0"))
    told = t("customer").select(F.col("c_custkey").alias("finding_id"), F.concat_ws(" and ", label(F.col("c_custkey") % 90), label(F.col("c_nationkey"))).alias("text"))
    moved = t("customer").select((F.col("c_custkey") % 90).alias("n")).distinct().where("n % 3 = 0").select(label(F.col("n")).alias("label"))
    return R.dependent_narratives(told, moved)


@query("""SELECT c_custkey AS id, NOT (c_custkey % 3 <> 0 AND c_nationkey % 2 = 1) AND NOT (c_custkey % 5 = 1) AND (c_custkey % 4 = 0 OR c_nationkey % 3 = 0) AS allowed FROM customer""")
def merge_guard(t):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    rows = t("customer").select(
        k.alias("id"), F.lit("Injected thread found in service").alias("title_a"), F.when(n % 3 == 0, "Service with injected code").otherwise("Something else here").alias("title_b"), F.when(k % 3 != 0, "to 10.0.0.1").otherwise("none").alias("text_a"),
        F.when(n % 2 == 1, "to 10.0.0.2").otherwise("to 10.0.0.1 and 10.0.0.2").alias("text_b"), F.array(F.lit("k1")).alias("keys_a"), F.when(k % 4 == 0, F.array(F.lit("k1"))).otherwise(F.array(F.lit("k2"))).alias("keys_b"), F.array(F.lit("7")).alias("pids_a"),
        F.when(k % 5 == 1, F.array(F.lit("8"))).otherwise(F.array().cast("array<string>")).alias("pids_b"))
    return R.may_merge(rows).select("id", "allowed")


@query("""SELECT fp, count(*) AS n, min(finding_id) AS first FROM (SELECT o_orderkey AS finding_id, CASE o_custkey % 4 WHEN 0 THEN 'pid:' || (o_custkey % 50) || '|proc:abcdefghijklmn' WHEN 1 THEN 'path:users/f' || (o_custkey % 30) || '.txt' WHEN 2 THEN 'desc:art' || (o_custkey % 20) || '|a title' ELSE 'uid:' || o_orderkey END AS fp FROM orders) GROUP BY 1""")
def consensus_fingerprint(t):
    k = F.col("o_custkey")
    none = F.array().cast("array<map<string,string>>")
    claims = F.when(k % 4 == 0, F.array(F.create_map(F.lit("type"), F.lit("pid"), F.lit("pid"), (k % 50).cast("string"), F.lit("process"), F.lit("ABCDEFGHIJKLMNOP.exe")))).when(k % 4 == 1, F.array(F.create_map(F.lit("type"), F.lit("path"), F.lit("path"), F.concat(F.lit("C:\\Users\\F"), (k % 30).cast("string"), F.lit(".txt"))))).otherwise(none)
    rows = t("orders").select(F.col("o_orderkey").alias("finding_id"), claims.alias("claims"), F.when(k % 4 == 2, F.concat(F.lit("Art"), (k % 20).cast("string"))).alias("artifact"), F.when(k % 4 == 2, "A title").alias("title"))
    return rows.select("finding_id", R.fingerprint().alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first"))


@query("""SELECT o_orderkey AS finding_id, s AS subject, CASE WHEN s IS NULL THEN CASE WHEN o_custkey % 3 = 0 THEN 3 ELSE 2 END ELSE 2 END AS n_claims FROM (SELECT o_orderkey, o_custkey, unnest(CASE WHEN o_custkey % 3 = 1 THEN ['1', '2'] ELSE [NULL] END) AS s FROM orders)""")
def atomic_subjects(t):
    claim = lambda *pairs: F.create_map(*(F.lit(x) for x in pairs))
    k = F.col("o_custkey") % 3
    both = [claim("type", "pid", "pid", "1"), claim("type", "pid", "pid", "2")]
    claims = F.when(k == 0, F.array(*both, claim("type", "child_process", "x", "y"))).when(k == 1, F.array(*both, claim("type", "path", "path", "p"))).otherwise(F.array(both[0], claim("type", "path", "path", "p")))
    cut = R.split_subjects(t("orders").select(F.col("o_orderkey").alias("finding_id"), claims.alias("claims")))
    return cut.select("finding_id", "subject", F.size("claims").alias("n_claims"))
