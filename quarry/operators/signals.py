"""Semantic signals and scores of facts, as column expressions.

Facts are rows (fact_id, fact_type, fields): ``fields`` is a map of lower-case names to texts, in
which a present name may have a null value.  All rules are evaluated in one pass without a shuffle; only the
outlier rule needs the table's mean, and ``finding_signals`` one join and one grouping.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.functions import vocabulary as V
from quarry.functions.columns import computed, entropy, ip_class


def field(*names: str) -> Column:
    """Trimmed lower-case text of the first of these fields that is not blank; else ''."""
    found = [F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in names]
    return F.lower(F.coalesce(*found, F.lit("")))


def blob() -> Column:
    """Every field's text, in lower case."""
    return F.lower(F.concat_ws(" ", F.map_values("fields")))


def has(text: Column, tokens: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(t)) for t in tokens))


def ends(text: Column, suffixes: list[str]) -> Column:
    return reduce(or_, (F.endswith(text, F.lit(s)) for s in suffixes))


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def of(*types: str) -> Column:
    return F.col("fact_type").isin(*types)


def true(name: str) -> Column:
    return field(name).isin("true", "1", "yes")


def _hosts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://([a-z0-9.\-]+)"), 1)


def _outside(host: Column) -> Column:
    """A name with a plausible top domain that is no address and belongs to no vendor."""
    name = F.regexp_replace(host, r"^\.+|\.+$", "")
    return F.contains(name, F.lit(".")) & ~F.regexp_extract(name, r"([^.]*)$", 1).isin(V.NON_TLD) & ~F.replace(name, F.lit("."), F.lit("")).rlike("^[0-9]+$") & ~name.rlike(V.KNOWN_GOOD_HOSTS)


def host_score(host: Column) -> Column:
    """0 to 4: high entropy, length, digits and few vowels of the label that a host is registered by."""
    parts = F.filter(F.split(F.lower(host), r"\."), lambda p: p != "")
    n = F.size(parts)
    last = lambda k: F.try_element_at(parts, F.lit(-k))
    label = F.when(n < 2, F.coalesce(last(1), F.lit(""))).when((n >= 3) & (F.length(last(1)) == 2) & (F.length(last(2)) <= 3), last(3)).otherwise(last(2))
    size = F.length(label)
    share = lambda letters: F.length(F.regexp_replace(label, f"[^{letters}]", "")) / size
    points = (entropy(label) >= 3.6).cast("int") + (size >= 16).cast("int") + (share("0-9") >= 0.3).cast("int") + (share("aeiou") <= 0.2).cast("int")
    return F.when((size >= 7) & label.rlike(r"^[a-z0-9-]+$"), points).otherwise(F.lit(0))


def _strange_host(host: Column) -> Column:
    return ~host.rlike(V.KNOWN_GOOD_HOSTS) & (host_score(host) >= 2)


def _dga(text: Column) -> Column:
    odd = F.exists(F.regexp_extract_all(text, F.lit(r"https?://[a-z0-9.\-]+:([0-9]{2,5})"), 1), lambda p: ~p.isin(V.ORDINARY_PORTS))
    raw_ip = text.rlike(r"https?://[0-9]{1,3}(\.[0-9]{1,3}){3}")
    return raw_ip | odd | F.exists(_hosts(text), _strange_host) | (of("network_ioc_fact") & _strange_host(field("host", "value")))


def _odd_driver(text: Column) -> Column:
    """Whether a text names a driver outside the driver folders that is no core module."""
    text = F.regexp_replace(F.regexp_replace(text, r"\\\?\?\\", ""), r"\\systemroot\\|%systemroot%\\?|%windir%\\?", r"c:\\windows\\")
    core = lambda p: F.regexp_replace(leaf(p), r"\.sys$", "").isin(V.CORE_MODULES)
    return F.exists(F.regexp_extract_all(text, F.lit(V.DRIVER_PATH), 1), lambda p: ~p.rlike(V.DRIVER_FOLDER) & ~core(p))


def _strange_driver(text: Column) -> Column:
    """An odd driver as a service's image path, in an image-path field, or in an event of a service's installation."""
    key = F.regexp_replace(field("normalized_registry_path", "registry_path", "key", "path"), r"\\", "/")
    value = (field("value_name", "name") == "imagepath") | F.endswith(key, F.lit("/imagepath"))
    installed = has(text, ["7045", "service control manager", "service was installed"])
    return (value & _odd_driver(field("value_data", "data", "value"))) | _odd_driver(field("image_path", "imagepath")) | (installed & _odd_driver(text))


def _reverse_shell() -> Column:
    """A command line that is a remote shell beyond doubt; of facts without one, any of their fields."""
    line = field("command_line", "commandline", "cmdline", "cmd", "command", "args", "arguments", "process_command_line", "decoded", "script", "raw_excerpt_text")
    return tags.is_strong_shell(tags.shell_signals(F.when(line != "", line).otherwise(F.col("blob"))))


def _appended(path: Column) -> Column:
    """Whether a foreign extension follows a data file's own."""
    parts = F.split(leaf(path), r"\.")
    new = F.try_element_at(parts, F.lit(-1))
    return (F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).isin(V.DATA_EXTENSIONS) & new.rlike("^[a-z0-9]{1,12}$") & ~new.isin(V.DATA_EXTENSIONS)


def _privileged(text: Column) -> Column:
    return text.rlike(V.PRIVILEGED_GROUP) | F.regexp_extract(text, r"s-1-5-21-[0-9]+-[0-9]+-[0-9]+-([0-9]+)", 1).isin(V.PRIVILEGED_DOMAIN_RIDS)


def _cleared(text: Column, event: Column) -> Column:
    return (event == "1102") | ((event == "104") & F.contains(text, F.lit("cleared")) & F.contains(text, F.lit("log"))) | has(text, V.ANTI_FORENSICS)


def _recovery(text: Column) -> Column:
    return has(text, V.INHIBIT_RECOVERY) | (F.contains(text, F.lit("win32_shadowcopy")) & has(text, ["remove-wmiobject", "delete"]))


def _outbound_c2() -> Column:
    by = (field("process", "owner", "image_name", "process_name", "imagefilename") != "") | ~field("pid").isin("", "0")
    kind = field("classification")
    flags = F.concat_ws(" ", field("ioc_match"), field("threat_label"), field("verdict"), field("tag"))
    return field("direction").isin("", "outbound", "out", "egress") & by & (true("is_suspicious") | true("is_c2") | ~kind.isin("", "unknown", "benign", "clean", "none") | has(flags, V.C2_FLAGS))


def rules() -> dict[str, Column]:
    """Condition of every signal but the outlier's, each guarded by its fact types."""
    text, event = F.col("blob"), field("event_id", "eventid", "entity_id")
    path = F.regexp_replace(field("path", "normalized_path", "raw_excerpt_text"), "/", r"\\")
    ran = F.regexp_replace(field("image_path", "path", "exe_path", "process_path", "imagefilename", "command_line", "cmdline", "cmd", "file_path", "raw_excerpt_text"), "/", r"\\")
    slashed = F.regexp_replace(text, "/", r"\\")
    image = field("image_name", "imagefilename", "process_name", "path")
    command_present = F.map_contains_key("fields", "cmdline") | F.map_contains_key("fields", "cmd")
    staged = lambda *names: has(field(*names), V.TEMP_PATHS)
    shell_path = F.contains(field("registry_path", "normalized_registry_path"), F.lit("safeboot")) & (field("value_name") == "alternateshell")
    process = of("process_fact", "process_relationship_fact")
    return {
        "kernel_driver_nonstandard_path": of("registry_persistence_fact", "event_log_fact", "kernel_module_fact", "service_fact") & _strange_driver(text),
        "c2_staging_domain": of("powershell_command_fact", "decoded_string_fact", "network_ioc_fact") & text.rlike(V.CRADLE) & F.exists(_hosts(text), _outside),
        "dga_domain": of("powershell_command_fact", "decoded_string_fact", "network_ioc_fact") & _dga(text),
        "c2_reverse_shell_cmdline": (process | of("powershell_command_fact", "event_log_fact")) & _reverse_shell(),
        "ifeo_debugger_hijack": of("registry_persistence_fact") & F.contains(field("registry_path", "normalized_registry_path"), F.lit("image file execution options")) & (field("value_name") == "debugger"),
        "safeboot_alternateshell_persistence": of("registry_persistence_fact") & shell_path & ~field("value_data").isin("", "none", "null", "n/a", "cmd.exe"),
        "admin_share_access": of("event_log_fact", "rdp_artifact_fact") & event.isin(V.ADMIN_SHARE_EVENTS) & has(text, V.ADMIN_SHARES),
        "explicit_credential_logon": of("event_log_fact", "rdp_artifact_fact") & (event == "4648"),
        "privileged_group_modification": of("event_log_fact") & event.isin(V.GROUP_EVENTS) & _privileged(text),
        "service_account_interactive_execution": of("sid_fact", "process_fact") & field("sid", "owner_sid", "account_sid").isin(V.SERVICE_SIDS) & leaf(field("process_name", "image_name", "process", "image")).isin(V.SHELLS),
        "mass_encryption_burst": of("filesystem_timeline_fact", "filesystem_listing_fact", "file_object_fact") & _appended(field("normalized_path", "path", "file_path", "filename")),
        "anti_forensics_execution": of("file_execution_fact", "process_fact", "event_log_fact", "powershell_command_fact", "scheduled_task_fact") & _cleared(text, event),
        "inhibit_system_recovery": of("process_fact", "event_log_fact", "powershell_command_fact", "scheduled_task_fact") & _recovery(text),
        "archive_in_staging_path": of("filesystem_timeline_fact") & ends(path, V.ARCHIVES) & has(path, V.TEMP_PATHS),
        "executes_from_temp_path": of("file_execution_fact", "process_fact") & ~has(ran, V.INSTALLER_CACHES) & (has(ran, V.TEMP_PATHS) | (~has(slashed, V.INSTALLER_CACHES) & has(slashed, V.TEMP_PATHS))),
        "null_or_empty_cmdline_on_executable": of("process_fact") & ends(image, V.EXE_SUFFIXES) & command_present & (field("cmdline", "cmd") == "") & ~leaf(image).isin(V.NULL_CMDLINE_PROCESSES),
        "rwx_memory_region_with_unusual_protection": of("memory_injection_fact") | (of("process_fact") & has(field("protection"), V.RWX) & true("private_rwx")),
        "injected_pe_image_in_executable_memory": of("memory_injection_fact") & has(field("characterization", "payload", "content_type", "region_content"), V.PAYLOADS),
        "process_hollowing_indicators": of("memory_injection_fact", "process_fact") & has(text, V.HOLLOWING),
        "spawned_by_lolbin_with_suspicious_chain": process & leaf(field("parent_process_name", "parent_name", "parent")).isin(V.LOLBINS) & (has(field("image_name", "process_name", "child_process_name"), V.SUSPICIOUS_CHILDREN) | staged("path", "child_path")),
        "registry_run_key_pointing_to_temp": of("registry_persistence_fact") & has(F.regexp_replace(field("registry_path", "normalized_registry_path"), "/", r"\\"), V.RUN_KEYS) & has(F.regexp_replace(field("value_data"), "/", r"\\"), V.TEMP_PATHS),
        "scheduled_task_with_hidden_action": of("scheduled_task_fact") & (true("hidden") | has(field("actions", "action", "command"), V.HIDDEN_ACTIONS)),
        "outbound_to_known_c2_pattern": of("network_connection_fact", "network_ioc_fact") & _outbound_c2(),
        "external_inbound_to_sensitive_listener": of("network_connection_fact") & field("localport", "src_port").try_cast("int").isin(V.LISTENER_PORTS) & field("foreignaddr", "dst_ip").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (ip_class(field("foreignaddr", "dst_ip")) == "public") & ~field("foreignaddr", "dst_ip").rlike(r"^0\.|^2(4[0-9]|5[0-5])\."),
        "appcompatcache_execution_from_staging": of("appcompatcache_execution_fact") & has(path, V.TEMP_PATHS),
        "lnk_execution_from_staging": of("lnk_execution_fact") & has(F.regexp_replace(text, "/", r"\\"), V.TEMP_PATHS),
        "jumplist_access_to_staging": of("jumplist_fact") & has(F.regexp_replace(text, "/", r"\\"), V.TEMP_PATHS),
    }


def with_signals(facts: DataFrame) -> DataFrame:
    """``facts`` with ``signals``, the sorted names of the rules that fire; undecidable conditions do not."""
    names = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules().items()))
    return computed(computed(facts, blob=blob()), signals=F.array_sort(F.array_compact(names))).drop("blob")


def egress(facts: DataFrame) -> DataFrame:
    """(fact_id) of usage facts whose bytes exceed the mean of all positive rows by two deviations; of 8 rows at least."""
    number = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)).try_cast("double"), F.lit(0.0))
    total = number("bytes_total")
    sent = facts.where(of("srum_usage_fact")).select("fact_id", F.when(total > 0, total).otherwise(number("bytes_sent") + number("bytes_received")).alias("bytes")).where("bytes > 0")
    line = sent.agg(F.count(F.lit(1)).alias("n"), (F.avg("bytes") + 2 * F.stddev_pop("bytes")).alias("line")).where("n >= 8")
    return sent.join(F.broadcast(line), F.col("bytes") > F.col("line")).select("fact_id")  # one row


def finding_signals(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, signals) of rows (finding_id, fact_id): names that fire on any of a finding's facts.

    Names are made distinct before they are gathered, so a finding of many facts gathers at most one row for each rule.
    """
    fired = with_signals(facts).select("fact_id", F.explode("signals").alias("signal")).unionByName(egress(facts).withColumn("signal", F.lit("srum_egress_outlier")))
    pairs = findings.select("finding_id", "fact_id").join(fired, "fact_id").select("finding_id", "signal").distinct()
    return findings.select("finding_id").distinct().join(pairs.groupBy("finding_id").agg(F.array_sort(F.collect_list("signal")).alias("signals")), "finding_id", "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
