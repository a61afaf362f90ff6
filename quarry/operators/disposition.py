"""Where a finding goes: gates that a confirmation must pass, and the ordered rules of the router.

A finding is a row with finding_id, title, description, severity, confidence, finding_type, evidence_type, is_synthesis,
deterministic, blocked, validated, raw_excerpt, source_tools, tool_calls, claims (array of maps), fact_types (of its typed
references), support_tools, signals (malicious), supported (those with provenance), context (signals of the
environment), c2_axes, verdict (malicious, benign, likely_false_positive, inconclusive or null) and the flags of earlier passes.  All
rules are columns of one row: no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions.columns import computed

CONFIRMED, REVIEW, INCONCLUSIVE, BENIGN, SYNTHESIS = BUCKETS = (
    "confirmed_malicious_atomic", "suspicious_needs_review", "inconclusive_unresolved", "benign_or_false_positive", "synthesis_narrative")
# Names of signals and tools that the rules depend on.
WEAK = ["rwx_memory_region_with_unusual_protection", "null_or_empty_cmdline_on_executable", "sensitive_privilege_enabled_on_non_baseline", "executes_from_temp_path", "explicit_credential_logon"]
HISTORY = ["appcompatcache_execution_from_staging", "lnk_execution_from_staging", "jumplist_access_to_staging"]
ANOMALY = [
    "srum_egress_outlier", "archive_in_staging_path", "inhibit_system_recovery", "anti_forensics_execution", "mass_encryption_burst", "service_account_interactive_execution",
    "admin_share_access", "privileged_group_modification",
]
PERSISTENCE = ["ifeo_debugger_hijack", "safeboot_alternateshell_persistence"]
NETWORK_TOOLS = ["vol_netscan", "extract_network_iocs", "vol_handles", "run_srumecmd"]
INJECTION_TOOLS = ["vol_malfind", "vol_ldrmodules", "vol_psxview", "vol_handles", "vol_vadinfo", "vol_vadyarascan", "vol_threads", "vol_hollowprocesses"]
HISTORY_TOOLS = ["run_appcompatcacheparser", "get_amcache", "parse_prefetch"]
SYNTHESIS_TYPES = ["synthesis", "narrative", "attack_chain_summary", "composite_narrative"]
BEHAVIOUR = [
    "child_process", "parent_process", "child_pid", "parent_pid", "foreign_addr", "registry_path", "value_data", "path", "image_path", "protection", "action", "scheduled_task",
    "command_line", "cmd", "sha1", "sha256", "md5", "filename", "artifact",
]
PUBLIC = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"
HASH = r"\b[a-fA-F0-9]{32}(?:[a-fA-F0-9]{8})?(?:[a-fA-F0-9]{24})?\b"


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _any(array: str, values: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(F.col(array), F.array().cast("array<string>")), _lits(values))


def _only(array: str, values: list[str]) -> Column:
    """Whether all of an array are among these values (an empty one is)."""
    return F.size(F.array_except(array, _lits(values))) == 0


def _text(*names: str) -> Column:
    return F.concat_ws(" ", *names)


def _of(claim: Column, name: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at(claim, F.lit(name))), F.lit(""))


def _distinct(*names: str) -> Column:
    """Number of distinct texts that the claims give under the first of these names."""
    first = lambda c: F.coalesce(*(F.nullif(F.lower(_of(c, n)), F.lit("")) for n in names))
    return F.size(F.array_distinct(F.array_compact(F.transform("claims", first))))


def _all_distinct(names: list[str], pattern: str = "") -> Column:
    """Number of distinct texts that the claims give under any of these names, of those that match a pattern."""
    each = F.flatten(F.transform("claims", lambda c: F.array(*(F.lower(F.trim(_of(c, n))) for n in names))))
    return F.size(F.array_distinct(F.filter(each, lambda x: (x != "") & x.rlike(pattern))))


def external_peer() -> Column:
    """A public address in a claim or the text of a finding that speaks of connections."""
    fields = ["foreign_addr", "foreign_ip", "remote_addr", "remote_ip", "value"]
    said = F.array_join(F.transform("claims", lambda c: F.concat_ws(" ", *(_of(c, n) for n in fields))), " ")
    found = F.regexp_extract_all(F.concat_ws(" ", said, _text("title", "description", "raw_excerpt")), F.lit(PUBLIC), 1)
    linked = F.exists("claims", lambda c: _of(c, "type") == "connection") | _any("source_tools", NETWORK_TOOLS)
    return linked & F.exists(found, N.public_by_octets)


def typed_support() -> Column:
    """References of two fact types, or of any type from two tools."""
    types = F.size(F.array_distinct("fact_types"))
    return (types >= 2) | ((types > 0) & (F.size(F.array_distinct("support_tools")) >= 2))


def hashed_execution() -> Column:
    """A record of execution together with a hash."""
    said = F.array_join(F.transform("claims", lambda c: F.array_join(F.map_values(c), " ")), " ")
    return _any("source_tools", HISTORY_TOOLS) & F.concat_ws(" ", said, "description").rlike(HASH)


def behaviour() -> Column:
    """A claim that says more than that a process is there."""
    return F.exists("claims", lambda c: ~F.lower(_of(c, "type")).isin("pid", "process_exists", "") | reduce(lambda a, b: a | b, (_of(c, n) != "" for n in BEHAVIOUR)))


def synthesis() -> Column:
    """Names of the signs of a narrative: one strong sign, or two weak ones."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    title = low("title")
    strong = F.array_compact(F.array(
        F.when(low("finding_type").isin(SYNTHESIS_TYPES), "finding_type"), F.when(low("evidence_type").isin("synthesis", "narrative"), "evidence_type"), F.when(F.col("is_synthesis"), "flag"),
        F.when(_all_distinct(["process", "image_name", "child_process", "parent_process"]) >= 3, "processes")))
    weak = F.array_compact(F.array(
        F.when(F.startswith(title, F.lit("full attack chain")) | F.startswith(title, F.lit("attack chain summary")), "title"), F.when(low("description").rlike("multi-stage intrusion|full attack chain"), "description"),
        F.when(_all_distinct(["pid", "parent_pid", "child_pid"], r"^-*[0-9]+$") >= 3, "pids"), F.when(F.size(F.regexp_extract_all(title, F.lit("(->|→)"), 1)) >= 2, "arrows")))
    atomic = F.coalesce(F.col("deterministic"), F.lit(False)) & (F.size("signals") > 0)
    return F.when(~atomic & (F.size(strong) > 0), strong).when(~atomic & (F.size(weak) >= 2), weak).otherwise(F.array().cast("array<string>"))


def _weak_only() -> Column:
    return _only("signals", WEAK + HISTORY)


def gates(columns: list[str] | None = None) -> dict[str, dict[str, Column]]:
    """Reasons against a confirmation by gate: name -> {reason: condition}."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    some = F.size("signals") > 0
    two_methods = F.size(F.array_intersect(F.array_distinct("source_tools"), _lits(INJECTION_TOOLS))) >= 2
    rwx = F.array_contains("signals", WEAK[0])
    lone_memory = some & (_only("signals", WEAK) | (rwx & _weak_only())) & ~external_peer() & ~two_methods
    lone_weak = some & _weak_only() & ~(external_peer() | two_methods | typed_support() | F.coalesce(F.col("concrete"), F.lit(False)) | hashed_execution())
    unsupported = some & (F.size(F.array_intersect("signals", "supported")) == 0)
    return {
        "evidence": {
            "missing_core_field:finding_id": blank("finding_id"), "missing_core_field:title": blank("title") & (blank("artifact") if "artifact" in (columns or []) else F.lit(True)), "missing_core_field:severity": blank("severity"), "no_checkable_claims": F.size("claims") == 0,
            "no_typed_or_validated_support": ~F.coalesce(F.col("validated"), F.lit(False)) & (F.size("fact_types") == 0), "severity_ledger_route_out": F.col("route_out"),
            "react_verdict_benign_or_false_positive": F.coalesce(F.col("verdict"), F.lit("")).isin("benign", "likely_false_positive", "inconclusive"),
        },
        "no_speculative": {"confidence_missing": blank("confidence"), "confidence_speculative": F.upper("confidence") == "SPECULATIVE"},
        "no_empty_source": {"empty_source_tools": F.size("source_tools") == 0},
        "raw_evidence": {"missing_tool_call_ids": F.size("tool_calls") == 0, "missing_raw_excerpt": blank("raw_excerpt")},
        "malicious_semantic": {"no_malicious_semantic_signal": ~some, "environment_context_only": ~some & (F.size("context") > 0), "weak_alone_signal_uncorroborated": lone_weak},
        "explicit_fact_id": {"no_explicit_fact_id_in_claims": F.size("fact_types") == 0},
        "claim_fact_reference": {"no_durable_fact_refs": F.size("fact_types") == 0},
        "signal_provenance": {"no_semantic_signal_provenance": unsupported},
        "malicious_provenance": {"malicious_semantic_provenance_missing": unsupported},
        "no_pid_only": {"pid_or_process_existence_only": ~behaviour()},
        "entity_conflict": {"react_entity_verdict_conflict": F.col("entity_conflict")},
        "rwx_corroboration": {"rwx_memory_region_uncorroborated": lone_memory},
        "c2_corroboration": {"c2_staging_domain_uncorroborated": some & _any("signals", ["c2_staging_domain", "dga_domain"]) & (F.coalesce(F.col("c2_axes"), F.lit(0)) < 2)},
    }


def eligibility(findings: DataFrame) -> DataFrame:
    """``findings`` with ``failed_gates`` and ``blocking_reasons`` (both empty where a confirmation may stand)."""
    table = gates(findings.columns)
    sure = lambda c: F.coalesce(c, F.lit(False))
    failed = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, map(sure, reasons.values())), F.lit(gate)) for gate, reasons in table.items())))
    why = F.array_compact(F.array(*(F.when(sure(c), F.lit(reason)) for reasons in table.values() for reason, c in reasons.items())))
    return computed(findings, failed_gates=failed, blocking_reasons=why)


def route(findings: DataFrame) -> DataFrame:
    """``findings`` with ``failed_gates``, ``blocking_reasons``, ``bucket`` and ``rule``, the name of the first rule that holds."""
    judged = computed(eligibility(findings), _syn=synthesis(), _strong=typed_support())
    verdict, some = F.coalesce(F.col("verdict"), F.lit("")), F.size("signals") > 0
    severity = F.upper(F.coalesce(F.col("severity"), F.lit("")))
    benign, weak = verdict.isin("benign", "likely_false_positive"), _weak_only()
    few = (F.size("claims") < 2) & ~F.col("_strong")
    plain = (verdict != "malicious") & weak
    rules = [
        ("entity_conflict", F.col("entity_conflict"), REVIEW), ("fp_routing", F.col("fp_routing"), BENIGN), ("jit_rwx", F.col("jit_rwx"), BENIGN), ("tool_status_noise", F.col("tool_noise"), BENIGN), ("severity_ledger", F.col("route_out"), REVIEW),
        ("benign_vs_anomaly", benign & _any("signals", ANOMALY), REVIEW), ("benign_vs_persistence", benign & _any("signals", PERSISTENCE), REVIEW), ("benign", benign, BENIGN), ("inconclusive", verdict == "inconclusive", INCONCLUSIVE),
        ("synthesis", F.size("_syn") > 0, SYNTHESIS), ("severe_with_low_confidence", severity.isin("CRITICAL", "HIGH") & (F.upper("confidence") == "LOW"), REVIEW), ("environment_only", (F.size("context") > 0) & ~some, REVIEW),
        ("one_claim_weak", few & plain & severity.isin("LOW", "SPECULATIVE", ""), BENIGN), ("one_claim_unbound", few & plain, INCONCLUSIVE), ("one_claim_malicious", few & (verdict == "malicious"), REVIEW),
        ("one_claim_deterministic", few & F.col("deterministic") & some & ~weak & (F.size("supported") > 0), REVIEW), ("one_claim", few, INCONCLUSIVE),
        ("blocked", F.col("blocked"), REVIEW), ("weak_only", (F.size("blocking_reasons") > 0) & plain & ~F.col("_strong"), BENIGN), ("not_eligible", F.size("blocking_reasons") > 0, REVIEW),
    ]
    first = None
    for name, condition, bucket in rules:
        first = (F if first is None else first).when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(bucket).alias("bucket"), F.lit(name).alias("rule")))
    found = computed(judged, _to=first.otherwise(F.struct(F.lit(CONFIRMED).alias("bucket"), F.lit("all_gates_cleared").alias("rule"))))
    return found.withColumns({"bucket": F.col("_to.bucket"), "rule": F.col("_to.rule")}).drop("_to", "_syn", "_strong")


def late_benign(routed: DataFrame) -> DataFrame:
    """``routed`` after the second pass: findings under review or inconclusive that a flag or verdict calls benign go there, contested ones stay."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    says = flag("fp_routing") | flag("jit_rwx") | flag("tool_noise") | F.coalesce(F.col("verdict"), F.lit("")).isin("benign", "likely_false_positive")
    moved = F.col("bucket").isin(REVIEW, INCONCLUSIVE) & says & ~flag("entity_conflict") & ~flag("route_out")
    return routed.withColumns({"late_benign": moved, "bucket": F.when(moved, BENIGN).otherwise(F.col("bucket"))})


def partition_faults(placed: DataFrame, findings: DataFrame) -> DataFrame:
    """(finding_id, fault) that show that ``placed`` (finding_id, bucket) is no partition of ``findings``: absent, in several buckets, orphan, unknown bucket.

    Both sides are counted by finding before they meet.
    """
    where = placed.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bucket").isin(*BUCKETS)).alias("odd"))
    final = findings.groupBy("finding_id").agg(F.count(F.lit(1)).alias("m"))
    both = where.join(final, "finding_id", "full_outer")
    faults = F.array_compact(F.array(F.when(F.col("n").isNull(), "absent"), F.when(F.col("m").isNull(), "orphan"), F.when(F.col("n") > F.coalesce("m", F.lit(1)), "several"), F.when(F.col("odd") > 0, "unknown_bucket")))
    return both.select("finding_id", F.explode(faults).alias("fault"))
