"""Keeping, ordering and marking: caps in the order of arrival, first and last writers, noise, salience and history-only confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import normalise as N
from quarry.functions import vocabulary as V

# Patterns of tools and words that the rules depend on.
HISTORY_TOOLS = r"(?i)appcompatcache|shimcache|amcache|mft|timeline|prefetch|registry"
BEHAVIOUR_TOOLS = r"(?i)malfind|netscan|netstat|handles|ldrmodules|dlllist|vadyarascan|vadregexscan|malware|injection|yarascan|svcscan|cmdline"
CORROBORATION = (
    r"(?i)inject|shellcode|rwx|page_execute|\bc2\b|beacon|egress|exfil|anti.?forensic|\bwipe\b|sdelete|credential|mimikatz|lsass|encoded|reflection|persistence|"
    r"\bhollow|known.?malware|yara"
)
EXTERNAL_WORDS = r"(?i)\b(?:external|public)\s+(?:ip(?:\s+address)?|address)\s+([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"


def arrival_cap(df: DataFrame, key: str, ordinal: str, limits: dict[str, int], default: int) -> DataFrame:
    """The first rows of each key in the order of arrival, as many as its own limit or the default."""
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col(key)], F.lit(default))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(ordinal)))
    # the constant lets each task keep that many rows of a key before they are shuffled
    return ranked.where((F.col("rank") <= max([default, *limits.values()])) & (F.col("rank") <= limit))


def round_robin(df: DataFrame, key: str, newest: str, ordinal: str, reserved: list[str], reserve: int, others: int, chunk: int, most: int) -> DataFrame:
    """At most ``most`` rows of ``df`` with ``phase`` and ``position`` (from 1), dealt over the values of ``key`` in turn, the newest of each first.

    Phase 0 seeds every reserved key with its newest row; phase 1 deals ``chunk`` rows a turn to reserved keys until each has ``reserve``; phase 2
    deals to all keys, ``others`` more to each at most.  Within a turn keys go by name; a null key is ''.  Rows without a time come last, rows of
    one time by ``ordinal``.  A row's place follows from its rank in its key, so no turn has to be played: each key's
    first rows are limited before they are shuffled.
    """
    keyed = df.withColumn("_key", F.coalesce(key, F.lit("")))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc_nulls_last(newest), F.asc(ordinal)))
    ranked = keyed.withColumn("_rank", rank).where(F.col("_rank") <= reserve + others)
    r, high = F.col("_rank"), F.col("_key").isin(reserved)
    beyond = r - F.when(high, F.lit(reserve)).otherwise(F.lit(0))  # place in the last phase
    phase = F.when(high & (r <= reserve), F.when(r == 1, 0).otherwise(1)).otherwise(2)
    turn = F.when(phase == 0, 0).when(phase == 1, F.floor((r - 2) / chunk)).otherwise(F.floor((beyond - 1) / chunk))
    placed = ranked.where(beyond <= others).withColumn("phase", phase).withColumn("_turn", turn)
    order = ["phase", "_turn", "_key", "_rank"]
    kept = placed.orderBy(*order).limit(most)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("_key", "_rank", "_turn")  # of ``most`` rows


def dealt_report(df: DataFrame, kept: DataFrame, key: str, reserved: list[str]) -> DataFrame:
    """(key, source, kept, dropped, starved) of each key: ``starved`` is a reserved key with rows of which none is kept."""
    name = F.coalesce(key, F.lit("")).alias("key")
    sums = df.groupBy(name).agg(F.count(F.lit(1)).alias("source")).join(kept.groupBy(name).agg(F.count(F.lit(1)).alias("kept")), "key", "left")
    kept_ = F.coalesce("kept", F.lit(0))
    return sums.select("key", "source", kept_.alias("kept"), (F.col("source") - kept_).alias("dropped"), (F.col("key").isin(reserved) & (kept_ == 0)).alias("starved"))


def writers(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, first, last): what the first and the last row of each key say."""
    return df.groupBy(key).agg(F.min_by(value, ordinal).alias("first"), F.max_by(value, ordinal).alias("last"))


def by_offset(df: DataFrame, keys: list[str], offset: str, ordinal: str, bucket: int = 512) -> DataFrame:
    """One row, the first to arrive, for each of ``keys`` and bucket of offsets; null names are one name."""
    names = [F.coalesce(F.col(k).cast("string"), F.lit("<no-name>")).alias(f"k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*names, F.floor(F.coalesce(offset, F.lit(0)) / bucket).alias("b")).agg(F.min_by(F.struct(*df.columns), ordinal).alias("r")).select("r.*")


def history_only() -> Column:
    """Whether a confirmed finding (bucket, source_tools, reasons, signals, claim_types) rests on records of execution alone, with nothing that corroborates it."""
    tools = F.col("source_tools")
    said = F.concat_ws(" ", "reasons", "signals", "claim_types")
    return (F.col("bucket") == "confirmed_malicious_atomic") & (F.size(tools) > 0) & ~F.exists(tools, lambda t: t.rlike(BEHAVIOUR_TOOLS)) & F.forall(tools, lambda t: t.rlike(HISTORY_TOOLS)) & ~said.rlike(CORROBORATION)


def managed_rwx() -> Column:
    """Why writable code of a process (characterizations, corroborated, managed, unlinked, egress, odd_parent) is a managed runtime's, or why not: the first reason that holds."""
    return (
        F.when(F.size("characterizations") == 0, "no_injection_facts").when(F.col("corroborated"), "payload_corroborated").when(F.exists("characterizations", lambda c: F.lower(F.trim(c)).isin("mz_pe", "pe", "shellcode")), "payload_signature_present")
        .when(~F.col("managed"), "not_a_managed_jit_host").when(F.col("unlinked"), "unlinked_dll_present").when(F.col("egress"), "external_egress_present").when(F.col("odd_parent"), "ancestry_violation_present").otherwise("benign_jit_rwx")
    )


def salience() -> Column:
    """Reasons for which a network fact (owner, dst_ip, src_port, state, text) is worth a look."""
    owner, text = F.lower(F.coalesce("owner", F.lit(""))), F.coalesce("text", F.lit(""))
    urls = F.regexp_extract_all(text, F.lit(r"(https?://[^\s'\"<>]+)"), 1)
    plain = (F.size(urls) == 0) | F.exists(urls, lambda u: ~u.rlike("(?i)" + V.VENDOR))
    ips = F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), 1)
    port = N.whole(F.col("src_port"))
    known = owner.isin(V.BASELINE_PROCESSES)
    return F.array_compact(F.array(
        F.when((N.public_by_registry(F.col("dst_ip")) | F.exists(ips, N.public_by_registry)) & plain, "public_non_vendor_peer"), F.when(F.contains(F.upper(F.coalesce("state", F.lit(""))), F.lit("LISTEN")) & (port >= 1024) & ~known, "non_baseline_high_port_listener"),
        F.when(owner.rlike(V.LOLBIN_WORDS) & ~known, "lolbin_owner_network"), F.when(F.lower(text).rlike(V.ENCODED_OR_DOWNLOAD) & plain, "encoded_or_download_url")))


def honest_addresses(text: Column) -> Column:
    """A text in which no private address is called external; public ones stay."""
    found = F.regexp_extract_all(text, F.lit(EXTERNAL_WORDS), 0)
    address = lambda m: F.regexp_extract(m, EXTERNAL_WORDS, 1)
    inside = F.array_distinct(F.filter(found, lambda m: N.internal_by_registry(address(m))))
    return F.aggregate(inside, text, lambda t, m: F.replace(t, m, F.concat(F.lit("private/internal address "), address(m))))


def provenance(label: str, tools: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with ``kind``: tool (a real one of ``tools``: tool, derived), derived, or pseudo."""
    known = tools.select(F.lower("tool").alias("_tool"), "derived")
    met = labels.withColumn("_tool", F.lower(F.trim(label))).join(known, "_tool", "left")
    return met.withColumn("kind", F.when(F.col("derived").isNull(), "pseudo").when(F.col("derived"), "derived").otherwise("tool")).drop("_tool", "derived")


def typed_claims(facts: DataFrame) -> DataFrame:
    """(fact_id, claim) of facts (fact_id, fact_type, fields) that name an entity: a claim of a typed fact under each name that binds it."""
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in names))
    parts = {
        "pid": first("pid"), "ip": first("remote_ip", "foreign_addr", "ip", "dst_ip"), "port": first("port", "foreign_port", "dst_port"), "hash": first("sha256", "sha1", "md5", "hash"), "event_id": first("event_id"),
        "value": first("normalized_registry_path", "registry_path", "normalized_path", "path", "service_name", "task_name"),
    }
    named = F.map_filter(F.create_map(*(x for n, c in parts.items() for x in (F.lit(n), c))), lambda k, v: v.isNotNull())
    made = facts.select("fact_id", "fact_type", named.alias("named")).where("size(named) > 0 AND coalesce(fact_type, '') <> ''")
    return made.select("fact_id", F.map_concat(F.create_map(F.lit("type"), F.lit("typed_fact"), F.lit("fact_type"), F.col("fact_type")), F.col("named")).alias("claim"))


def uncited(citations: DataFrame, validated: DataFrame) -> DataFrame:
    """Citations (report_id, finding_id) of findings that were not validated."""
    return citations.join(validated.select("finding_id").distinct(), "finding_id", "left_anti")


def reserve(candidates: DataFrame, rendered: DataFrame, tools: list[str], most: int) -> DataFrame:
    """The best ready candidates of these tools (candidate_id, source_tools, score, ready) that were not rendered, ``most`` of them."""
    own = candidates.where(F.col("ready") & F.arrays_overlap("source_tools", F.array(*map(F.lit, tools))))
    return own.join(rendered.select("candidate_id"), "candidate_id", "left_anti").orderBy(F.desc("score"), "candidate_id").limit(most)


def budgeted(findings: DataFrame, most: int = 80) -> DataFrame:
    """``findings`` (finding_id, bucket, rank) with ``asked``: of those under review or inconclusive the first ``most`` by rank; the rest stay where they are."""
    open_ = findings.where(F.col("bucket").isin("suspicious_needs_review", "inconclusive_unresolved")).orderBy("rank", "finding_id").limit(most).select("finding_id", F.lit(True).alias("asked"))
    return findings.join(F.broadcast(open_), "finding_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))  # as many rows as the budget
