"""What other evidence says about processes, users and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions.columns import computed
from quarry.operators.emission import greedy
from quarry.operators.mentions import NAME_BORDER, mentions

# Processes and the parents that an undisturbed system gives them, tools by kind of evidence and method.
PARENTS = {
    "svchost.exe": ["services.exe"], "lsass.exe": ["wininit.exe"], "csrss.exe": ["smss.exe"], "smss.exe": ["system", "registry", "smss.exe"],
    "services.exe": ["wininit.exe"], "wininit.exe": ["smss.exe"], "winlogon.exe": ["smss.exe"], "taskhostw.exe": ["svchost.exe"],
}
TRANSIENT = "smss.exe"
KIND_OF_TOOL = {
    "M": ["vol_pstree", "vol_malfind", "vol_cmdline", "vol_dlllist", "vol_handles", "vol_psscan", "vol_ssdt", "vol_filescan", "run_strings", "vol_ldrmodules", "vol_psxview", "vol_envars", "vol_getsids", "vol_privileges", "vol_sessions", "vol_svcscan", "run_memprocfs"],
    "N": ["vol_netscan"], "A": ["get_amcache", "extract_prefetch", "extract_shimcache", "vol_amcache", "parse_prefetch", "run_appcompatcacheparser"],
    "T": ["extract_mft_timeline", "run_mftecmd", "sleuthkit_fls", "sleuthkit_mactime", "sleuthkit_tsk_recover"],
    "E": ["parse_event_logs", "parse_powershell_transcripts", "parse_rdp_artifacts", "parse_wmi_subscription", "parse_sysmon"],
    "R": ["parse_registry", "parse_registry_persistence", "vol_reg_hivelist", "vol_userassist", "parse_userassist", "parse_usb_devices"],
    "D": ["extract_srum", "run_srumecmd", "parse_browser", "parse_jump_lists", "parse_lnk", "hash_lookup", "parse_scheduled_tasks_disk", "run_jlecmd", "run_lecmd"],
}
METHODS = {
    "vad": ["vol_malfind", "vol_vadinfo", "vol_vadyarascan", "vol_vadwalk"], "mod": ["vol_ldrmodules", "vol_dlllist"], "thread": ["vol_suspiciousthreads", "vol_threads"], "handle": ["vol_handles"],
    "proc": ["vol_pstree", "vol_psscan", "vol_psxview", "vol_pslist"], "priv": ["vol_privileges", "vol_getsids"], "svc": ["vol_svcscan"], "kernel": ["vol_ssdt"], "net": ["vol_netscan"], "cmd": ["vol_cmdline", "vol_envars"],
}
MEMORY_TOOLS = ["vol_pstree", "vol_netscan", "vol_malfind", "vol_cmdline", "vol_dlllist", "vol_psscan", "vol_handles", "vol_envars", "vol_svcscan"]
DISK_TOOLS = ["get_amcache", "extract_mft_timeline", "parse_event_logs", "parse_prefetch", "parse_shellbags", "parse_powershell_transcripts", "parse_rdp_artifacts", "parse_wmi_subscription"]
LEVELS = ["UNRESOLVED", "SPECULATIVE", "LOW", "MEDIUM", "HIGH"]
CRITICAL = ["pwdump", "mimikatz", "procdump", "lsass", "credential", "psexec", "wmiexec", "smbexec", "lateral movement", "pass-the-hash", "kerberoast", "dcsync", "ntds.dit", "sam dump", "hashdump"]
HIGH = r"wmi.*powershell|powershell.*encoded|whoami|ipconfig|net user|systeminfo|netstat|discovery|reconnaissance|scheduled task|registry run|service creat|malfind|injected|hollowed|beacon"
MEDIUM = r"listening|established|suspicious|unusual|unknown service|temp\\|tmp/"
HUMAN_LOGONS = [2, 7, 10, 11]
SERVICE_SIDS = ["s-1-5-18", "s-1-5-19", "s-1-5-20"]


def _map(groups: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) for kind, tools in groups.items() for t in tools for x in (t, kind)))


def kinds_of(tools: Column) -> Column:
    """Sorted kinds of evidence that tools give; tools of several kinds or none do not count."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tools, lambda t: _map(KIND_OF_TOOL)[t]))))


def methods_of(tools: Column) -> Column:
    """Sorted independent memory methods among tools."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tools, lambda t: _map(METHODS)[t]))))


def hidden(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Processes of the scan (pid, name, exit_time) that are in no list and have not ended: names end in ``.exe``, and any text as exit time counts as an end."""
    alive = scanned.where(F.endswith("name", F.lit(".exe")) & (F.coalesce("exit_time", F.lit("")) == ""))
    return alive.join(listed.select("pid").distinct(), "pid", "left_anti")


def odd_parents(processes: DataFrame) -> DataFrame:
    """Processes (pid, ppid, name, created, ended, ordinal) whose parent is none of those that belong to their name.

    Of a reused number the last row is the parent.  Left out are parents that are unknown, younger than the child, ended before it, or of
    the same second where the rightful parent is short-lived.  Systems without wininit have winlogon above lsass and services.
    """
    last = processes.groupBy("pid").agg(F.max_by(F.struct("name", "created", "ended"), "ordinal").alias("p")).select(F.col("pid").alias("ppid"), F.col("p.name").alias("parent"), F.col("p.created").alias("p_created"), F.col("p.ended").alias("p_ended"))
    own = processes.groupBy("pid").agg(F.max_by("created", "ordinal").alias("c_created"))
    old = processes.agg((~F.coalesce(F.bool_or(F.lower("name") == "wininit.exe"), F.lit(False))).alias("old"))
    rightful = F.create_map(*(x for n, ps in PARENTS.items() for x in (F.lit(n), F.array(*map(F.lit, ps)))))
    child = computed(processes.join(F.broadcast(old)), low=F.lower("name"))  # one row
    expected = F.when(F.col("old") & F.col("low").isin("lsass.exe", "services.exe"), F.array(F.lit("winlogon.exe"))).otherwise(rightful[F.col("low")])
    met = child.withColumn("expected", expected).where("expected IS NOT NULL").join(last, "ppid").join(own, "pid").where(~F.array_contains("expected", F.lower("parent")))
    young, gone = F.col("p_created") > F.col("c_created"), F.col("p_ended") < F.col("c_created")
    same = (F.col("p_created") == F.col("c_created")) & F.array_contains("expected", TRANSIENT)
    kept = met.where(~F.coalesce(young, F.lit(False)) & ~F.coalesce(gone, F.lit(False)) & ~F.coalesce(same, F.lit(False)))
    reason = F.when(F.col("p_created") < F.col("c_created"), "parent_older_than_child").when(F.col("p_created") == F.col("c_created"), "parent_create_time_equal_unverifiable").otherwise("times_unavailable")
    return kept.select("pid", "name", "ppid", "parent", "expected", reason.alias("reason"))


def corroborated(findings: DataFrame, facts: DataFrame, least: int = 3) -> DataFrame:
    """(finding_id, new_tools, families, kinds) of findings whose entities other tools' facts name too, where all tools together cover ``least`` kinds of evidence.

    Findings have (finding_id, paths, hashes, services, source_tools), facts (fact_type, source_tool, path, hash, service, text).  File names, with blanks or
    whatever else is in them, are searched in all texts at once (``mentions``); no letter, digit, dot, dash or underscore may stand beside them.
    """
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    scannable = lambda b: (F.length(b) >= 5) & F.contains(b, F.lit("."))
    norm = F.transform("paths", N.path_of_fact)
    bases = F.filter(F.transform(norm, name), scannable)
    tokens = F.concat(
        F.transform(norm, lambda p: F.concat(F.lit("p:"), p)), F.transform("hashes", lambda h: F.concat(F.lit("h:"), F.lower(h))), F.transform("services", lambda s: F.concat(F.lit("s:"), F.lower(s))),
        F.transform(bases, lambda b: F.concat(F.lit("b:"), b)), F.transform(bases, lambda b: F.concat(F.lit("s:"), F.regexp_replace(b, r"\.[^.]*$", ""))))
    wanted = findings.select("finding_id", F.explode(F.array_distinct(tokens)).alias("token"))
    one = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(kind), c))
    held = F.array_compact(F.array(one("p:", N.path_of_fact(F.col("path"))), one("h:", F.lower("hash")), one("s:", F.lower("service"))))
    keyed = facts.select("fact_type", "source_tool", F.explode(F.array_distinct(held)).alias("token"))
    # equal texts are searched once
    told = facts.where("text <> ''").select("fact_type", "source_tool", F.sha2("text", 256).alias("id"), "text").distinct()
    names = wanted.where("token LIKE 'b:%'").select(F.substring("token", 3, 1 << 30).alias("name"))
    found = mentions(told.select("id", "text").distinct(), names, NAME_BORDER)
    have = keyed.union(told.select("fact_type", "source_tool", "id").join(found, "id").select("fact_type", "source_tool", F.concat(F.lit("b:"), "name"))).distinct()
    hits = wanted.join(have, "token").groupBy("finding_id").agg(F.array_sort(F.collect_set("source_tool")).alias("found"), F.array_sort(F.collect_set("fact_type")).alias("families"))
    met = findings.select("finding_id", "source_tools").join(hits, "finding_id")
    made = met.select("finding_id", F.array_except("found", "source_tools").alias("new_tools"), "families", kinds_of(F.array_union("source_tools", "found")).alias("kinds"))
    return made.where((F.size("new_tools") > 0) & (F.size("kinds") >= least))


def human(sid: Column) -> Column:
    """Whether a security identifier is an account's."""
    return F.lower(F.trim(sid)).rlike(r"^s-1-5-21-|^s-1-12-1-")


def account(name: Column) -> Column:
    """Name of an account without its domain; '' for machines and empty names."""
    bare = F.regexp_extract(F.translate(F.trim(F.coalesce(name, F.lit(""))), "/", "\\"), r"([^\\]*)$", 1)
    return F.when(F.endswith(bare, F.lit("$")) | bare.isin("-", ""), "").otherwise(bare)


def pid_users(sids: DataFrame) -> DataFrame:
    """(pid, user): the first account of (pid, sid, name, ordinal) rows that owns a process."""
    known = sids.where(human(F.col("sid"))).withColumn("user", account(F.col("name"))).where("user <> ''")
    return known.groupBy("pid").agg(F.min_by("user", "ordinal").alias("user"))


def process_contexts(sids: DataFrame) -> DataFrame:
    """(process, user, context) of (process, sid, name, ordinal) rows: the first account, else the service's context."""
    mine = sids.withColumns({"process": F.lower(F.trim("process")), "user": F.when(human(F.col("sid")), F.nullif(account(F.col("name")), F.lit("")))}).where("process <> ''")
    each = mine.groupBy("process").agg(F.min_by("user", F.when(F.col("user").isNotNull(), F.col("ordinal"))).alias("user"))
    return each.select("process", F.coalesce("user", F.lit("")).alias("user"), F.when(F.col("user").isNotNull(), "user").otherwise("system_service").alias("context"))


def launchers(events: DataFrame) -> DataFrame:
    """(image, user): who first started each program by events (event_id, sid, user, image, ordinal) of new processes."""
    known = events.where((F.col("event_id") == "4688") & human(F.col("sid"))).select(N.process_name(F.col("image")).alias("image"), account(F.col("user")).alias("user"), "ordinal").where("user <> '' AND image LIKE '%.exe'")
    return known.groupBy("image").agg(F.min_by("user", "ordinal").alias("user"))


def human_logons(events: DataFrame) -> DataFrame:
    """(user, logon_type, first_time, source_ip, n) of human logons of (event_id, sid, user, logon_type, at, ip)."""
    real = F.when(N.is_quad(F.coalesce("ip", F.lit(""))) & ~F.col("ip").isin("0.0.0.0", "127.0.0.1"), F.col("ip"))
    known = events.where((F.col("event_id") == "4624") & F.col("logon_type").isin(HUMAN_LOGONS) & human(F.col("sid"))).withColumn("user", F.lower(account(F.col("user")))).where("user <> ''")
    return known.groupBy("user", "logon_type").agg(F.min("at").alias("first_time"), F.min_by(real, F.when(real.isNotNull(), F.col("at"))).alias("source_ip"), F.count(F.lit(1)).alias("n"))


def usage_named(usage: DataFrame, ids: DataFrame) -> DataFrame:
    """``usage`` (app_id, user_id, ...) with ``application`` and ``user`` of the table ``ids`` (id, name): unknown programs keep their number."""
    app = ids.select(F.col("id").alias("app_id"), F.col("name").alias("application"))
    met = usage.join(app, "app_id", "left").join(ids.select(F.col("id").alias("user_id"), F.col("name").alias("user")), "user_id", "left")
    return met.withColumns({"application": F.when(F.coalesce("application", F.lit("")) != "", F.col("application")).when(F.col("app_id") != 0, F.concat(F.lit("AppId:"), F.col("app_id").cast("string"))).otherwise(""), "user": F.coalesce("user", F.lit(""))})


def short_names(users: DataFrame) -> DataFrame:
    """``users`` (domain, name) with ``canonical``: a short name of ordinal 1 becomes the one long name of its domain that it can stand for."""
    prefix = lambda c: F.upper(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9$%'_@{}!#()&^-]", ""), 1, 6))
    long = users.where(~F.contains("name", F.lit("~"))).select("domain", prefix(F.col("name")).alias("prefix"), "name").groupBy("domain", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("long")).where("n = 1").drop("n")
    asked = users.withColumn("prefix", F.upper(F.regexp_extract("name", r"^([^~]{1,6})~1$", 1)))
    return asked.join(long, ["domain", "prefix"], "left").withColumn("canonical", F.coalesce("long", "name")).drop("prefix", "long")


def user_risk(users: DataFrame) -> DataFrame:
    """``users`` with ``risk`` and ``tier`` from n_bad_pids, n_privileged, n_credential, n_staged, n_failed, n_logons, n_scripts, entry_role, persistence_role.

    The user of most scripts has 20 points more if there are three users and they run twice as many as the next.
    """
    top = users.orderBy(F.desc("n_scripts")).limit(2).agg(F.max("n_scripts").alias("most"), F.min("n_scripts").alias("next"))
    n = users.agg(F.count(F.lit(1)).alias("n_users"))
    met = users.join(F.broadcast(top)).join(F.broadcast(n))  # one row each
    least = lambda c, k: F.least(F.coalesce(c, F.lit(0)), F.lit(k))
    scripts = F.coalesce("n_scripts", F.lit(0))
    stands_out = (F.col("n_users") >= 3) & (scripts >= 100) & (scripts == F.col("most")) & (F.col("next") > 0) & (F.col("most") >= 2 * F.col("next"))
    risk = (
        25 * least("n_bad_pids", 3) + 15 * least("n_privileged", 3) + 10 * least("n_credential", 3) + 5 * least("n_staged", 5) + F.when((F.col("n_failed") > 0) & (F.col("n_logons") > 0), 8).otherwise(0)
        + F.when(scripts >= 5000, 50).when(scripts >= 1000, 30).when(scripts >= 100, 15).otherwise(0) + F.when(stands_out, 20).otherwise(0) + F.when(F.col("entry_role"), 30).otherwise(0) + F.when(F.col("persistence_role"), 20).otherwise(0)
    )
    scored = met.withColumn("risk", risk.cast("long")).drop("most", "next", "n_users")
    return scored.withColumn("tier", F.when(F.col("risk") >= 86, "CRITICAL").when(F.col("risk") >= 61, "HIGH").when(F.col("risk") >= 31, "MEDIUM").otherwise("LOW"))


def collections(accesses: DataFrame, least: int = 20) -> DataFrame:
    """(user, n_assets) of users who touched ``least`` distinct assets (user, path)."""
    return accesses.groupBy("user").agg(F.countDistinct("path").alias("n_assets")).where(F.col("n_assets") >= least)


def calibrated(trust: Column, memory_only: Column) -> Column:
    """Confidence of a finding (confidence, source_tools, claim_tools, tool_rows, false_positive) by what supports it.

    Tools without rows do not count; the number of kinds of evidence is a ceiling; a doubtful kernel holds memory findings at MEDIUM; memory and disk together, or three independent
    methods in a memory-only run with a sound kernel, give HIGH.
    """
    tools = F.filter(F.array_union("source_tools", "claim_tools"), lambda t: F.coalesce(F.try_element_at("tool_rows", t), F.lit(0)) > 0)
    kinds, rank = kinds_of(tools), lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    n = F.size(kinds)
    top = F.when(n >= 3, F.when((trust != "full") & F.array_contains(kinds, "M"), "MEDIUM").otherwise("HIGH")).when(n >= 1, "MEDIUM").otherwise("SPECULATIVE")
    said = F.upper(F.coalesce("confidence", F.lit("LOW")))
    capped = F.when(rank(said) > rank(top), top).otherwise(said)
    among = lambda names: F.arrays_overlap(tools, F.array(*map(F.lit, names)))
    lift = (among(MEMORY_TOOLS) & among(DISK_TOOLS)) | (memory_only & (trust == "full") & (F.size(methods_of(tools)) >= 3))
    return F.when(F.col("false_positive"), "LOW").when(lift, "HIGH").otherwise(capped)


def severity_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\bpwdum[a-z0-9_.-]*\b") | low.rlike("|".join(c.replace(".", r"\.") for c in CRITICAL)), "CRITICAL").when(low.rlike(HIGH), "HIGH").when(low.rlike(MEDIUM), "MEDIUM").otherwise("LOW")


def clamped(severity: Column, confidence: Column) -> Column:
    """Severity held between what a confidence allows and what it demands."""
    order = F.array(*map(F.lit, ["LOW", "MEDIUM", "HIGH", "CRITICAL"]))
    at = F.greatest(F.array_position(order, F.upper(F.coalesce(severity, F.lit("LOW")))), F.lit(1))
    sure = F.upper(F.coalesce(confidence, F.lit("LOW")))
    top, low = F.when(sure == "MEDIUM", 2).when(sure == "HIGH", 4).otherwise(1), F.when(sure == "MEDIUM", 2).when(sure == "HIGH", 3).otherwise(1)
    return F.element_at(order, F.greatest(F.least(at, top), low).cast("int"))


def kernel_trust(entries: DataFrame) -> DataFrame:
    """One row (trust, hooked) of the call table's entries (module): full, degraded (no entries, or up to five foreign modules) or untrusted."""
    module = F.lower(F.coalesce("module", F.lit("")))
    foreign = (module != "") & ~F.contains(module, F.lit("ntoskrnl")) & ~F.contains(module, F.lit("win32k"))
    counts = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(foreign).alias("hooked"))
    return counts.select(F.when(F.col("n") == 0, "degraded").when(F.col("hooked") > 5, "untrusted").when(F.col("hooked") > 0, "degraded").otherwise("full").alias("trust"), "hooked")


def silent_tools(chosen: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tool, reason) of chosen tools without rows: not_run, failed (an error is told), or no_records; ``outputs`` has (tool, record_count, error)."""
    met = chosen.select("tool").distinct().join(outputs, "tool", "left")
    reason = F.when(F.col("record_count").isNull(), "not_run").when(F.coalesce("error", F.lit("")) != "", "failed").when(F.col("record_count") == 0, "no_records")
    return met.select("tool", reason.alias("reason")).where("reason IS NOT NULL")


def hit_tools(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """``findings`` (finding_id, source_tools) whose tools without a row in ``hits`` (tool, n) are left out (``dropped``)."""
    each = findings.select("finding_id", F.posexplode_outer("source_tools").alias("at", "tool")).join(hits.where("n > 0").select("tool", F.lit(True).alias("hit")), "tool", "left")
    lists = each.groupBy("finding_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "tool")))), lambda x: x["tool"]).alias(n) for n, c in (("source_tools", F.col("hit")), ("dropped", F.col("hit").isNull() & F.col("tool").isNotNull()))))
    return lists


def fresh(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (candidate_id, tokens, score) that share no token with ``existing`` (token) findings, nor with a better candidate that is kept.

    One after the other, those of most points (then the least id) first: a candidate that only shares tokens with one that gave way itself is kept.
    """
    pairs = candidates.select("candidate_id", "score", F.lit("").alias("entity_key"), F.explode(F.array_distinct("tokens")).alias("token"))
    seen = pairs.join(existing.select("token").distinct(), "token", "left_semi").select("candidate_id").distinct()
    return candidates.join(greedy(pairs.join(seen, "candidate_id", "left_anti")), "candidate_id", "left_semi")
