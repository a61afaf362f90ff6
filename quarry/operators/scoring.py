"""The scoring table: points, signals and suppressions of facts, and candidates grouped by entity.

Facts are rows (fact_id, fact_type, fields, source_tool).  A fact is scored by columns of its own row; candidates are explode, a
numbering within (entity, signal, tool, type) that keeps four supports of each, and one grouping by entity.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import normalise as N

from quarry.functions import vocabulary as V
from quarry.functions.columns import computed

from .signals import _cleared, _privileged, _recovery, _strange_host, blob, ends, field, has, leaf, of, true

SUPPORTS = 4
#: Types whose facts are grouped and not scored.
UNSCORED = ["handle_fact", "filesystem_timeline_fact", "filesystem_listing_fact"]
CONTEXT_TYPES = ["context_only", "remote_access_context"]


def _path(*names: str) -> Column:
    return N.path_of_candidate(field(*names))


def _staged(text: Column) -> Column:
    return text.rlike(V.STAGING) & text.rlike(V.EXECUTABLE)


def _urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s'\"<>]+)"), 1)


def _foreign(urls: Column) -> Column:
    return F.exists(urls, lambda u: ~u.rlike(V.VENDOR))


def table() -> list[tuple[str, int, Column]]:
    """(signal, points, condition) of every rule; a signal may have several."""
    text, event, events = F.col("blob"), field("event_id", "eventid", "entity_id"), of("event_log_fact")
    process, registry, task, lnk, jump, usage = of("process_fact", "process_relationship_fact"), of("registry_persistence_fact"), of("scheduled_task_fact"), of("lnk_execution_fact"), of("jumplist_fact"), of("srum_usage_fact")
    cache, service, network, ioc, power, wmi = of("appcompatcache_execution_fact"), of("service_fact"), of("network_connection_fact"), of("network_ioc_fact"), of("powershell_command_fact"), of("wmi_subscription_fact")
    owner = field("process_name", "image_name", "owner", "imagefilename")
    own_path = _path("path", "image_name", "imagefilename")
    coded = lambda c: c.rlike(V.ENCODED_OR_DOWNLOAD)
    lolbin = lambda c: c.rlike(V.LOLBIN_WORDS)
    run_path, value, named = _path("normalized_path", "path"), field("value_data"), field("service_name")
    value_path, image = N.path_of_candidate(value), field("value_name") == "imagepath"
    normal = value_path.rlike(V.NORMAL_SERVICE) | value.rlike(V.NORMAL_SERVICE)
    baseline_value = (F.size(F.filter(F.split(value, ","), lambda p: F.trim(p) != "")) == 1) & ~(value_path.rlike(V.STAGING) | lolbin(value) | coded(value)) & (value_path.rlike(V.SYSTEM_FOLDER) | F.trim(value).isin(V.DEFAULT_SHELLS))
    actions = field("actions", "action")
    local, target, arguments = _path("local_path", "target_abs_path"), _path("target_abs_path"), field("arguments")
    link, linked = F.concat_ws(" ", local, target, arguments), local.rlike(V.EXECUTABLE) | target.rlike(V.EXECUTABLE)
    opened = _path("path")
    app, app_text = _path("normalized_path", "application_path", "application"), F.concat_ws(" ", _path("normalized_path", "application_path", "application"), field("application", "application_path"), field("table"))
    volume = F.coalesce(F.replace(field("bytes_total"), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    volume = F.when(volume > 0, volume).otherwise(F.coalesce(field("bytes_sent").try_cast("double"), F.lit(0.0)) + F.coalesce(field("bytes_received").try_cast("double"), F.lit(0.0)))
    cached = F.concat_ws(" ", _path("expanded_path", "normalized_path", "path"), field("path", "normalized_path", "expanded_path"))
    cached_bad = (cached.rlike(V.STAGING) | lolbin(cached)) & cached.rlike(V.EXECUTABLE)
    here, there, port = field("src_ip", "localaddr"), field("dst_ip", "foreignaddr"), N.whole(field("src_port", "localport"))
    urls, ips = _urls(text), F.filter(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), 1), N.is_quad)
    kind = field("classification")
    public = kind.isin("public", "external") | F.exists(ips, N.public_by_registry)
    private = kind.isin("private", "loopback", "local") | F.exists(ips, N.internal_by_registry)
    installed = F.regexp_extract(text, V.SERVICE_IMAGE, 1)
    abnormal = (event == "7045") & (installed != "") & ~installed.rlike(V.NORMAL_SERVICE) & ~leaf(installed).rlike(V.KERNEL_MODULE)
    given = F.filter(F.transform(F.split(field("ttp_tags", "ttp_tag"), r"[,\[\]\" ]+"), lambda t: F.replace(t, F.lit("-"), F.lit("_"))), lambda t: t != "")
    ttp = lambda *names: F.arrays_overlap(given, F.array(*map(F.lit, names)))
    command = field("command", "command_line", "cmdline", "decoded", "script", "value")
    command = F.when(command != "", command).otherwise(text)
    spoken_code = power & ~ttp("encoded_command") & command.rlike(r"(?:^|\s)[-/]e(?:nc|ncodedcommand|c)?\b\s+[A-Za-z0-9+/=]{20,}")
    spoken_load = power & ~ttp("download_cradle", "encoded_command") & ~spoken_code & command.rlike(r"net\.webclient|downloadstring|downloadfile|downloaddata|invoke-webrequest|invoke-restmethod")
    payload = F.concat_ws(" ", field("extracted_script_text"), field("extracted_script_filename"), field("extracted_command_template"), field("extracted_executable_path"))
    consumer = wmi & F.contains(field("type", "class"), F.lit("consumer")) & (F.trim(payload) != "")
    assist = F.concat_ws(" ", _path("keypath", "path", "registrypath", "registry_path"), _path("name", "value", "entryname"))
    enabled = F.exists(F.split(field("attributes"), ","), lambda a: F.trim(a) == "enabled")
    no_threads = (F.map_contains_key("fields", "thrdscan") | F.map_contains_key("fields", "thrdproc")) & ~(true("thrdscan") | true("thrdproc"))
    unlinked = (field("pslist") == "false") & (field("psscan") == "true") & field("exittime", "exit_time", "exit time").isin("") & ~field("pid").isin("0", "4") & ~field("process_name", "name").isin(V.META_PROCESSES) & ~no_threads
    decoded = of("decoded_string_fact")
    return [
        ("inhibit_system_recovery", 80, _recovery(text)),
        ("anti_forensics_execution", 80, of("file_execution_fact", "process_fact", "event_log_fact", "powershell_command_fact", "scheduled_task_fact") & _cleared(text, F.lit(""))),
        ("service_account_interactive_execution", 70, of("sid_fact") & field("sid", "owner_sid", "account_sid").isin(V.SERVICE_SIDS) & leaf(field("process_name", "process", "image_name")).isin(V.SHELLS)),
        ("memory_injection", 100, of("memory_injection_fact")),
        ("memprocfs_findevil_indicator", 70, of("memprocfs_indicator_fact") & ((field("semantic_family") == "findevil_indicators") | (field("semantic_role") == "anomaly_indicator"))),
        ("encoded_or_download_execution", 75, process & coded(text)), ("process_from_staging_path", 55, process & _staged(own_path)), ("lolbin_or_admin_process", 25, process & lolbin(text) & ~owner.isin(V.BASELINE_PROCESSES)),
        ("archive_in_staging_path", 40, of("filesystem_timeline_fact") & opened.rlike(V.ARCHIVE) & opened.rlike(V.STAGING)),
        ("execution_from_staging_path", 55, of("file_execution_fact") & _staged(run_path)), ("admin_or_lolbin_artifact", 35, of("file_execution_fact") & lolbin(run_path)),
        ("high_risk_persistence", 95, registry & text.rlike(V.HIGH_PERSISTENCE) & ~baseline_value), ("registry_points_to_staging_path", 85, registry & image & _staged(value_path)),
        ("remote_management_or_admin_service", 30, registry & named.rlike(V.REMOTE_MANAGEMENT)), ("admin_service_name", 45, (registry | service) & lolbin(named)), ("registry_lolbin_imagepath", 40, registry & image & lolbin(value) & ~normal),
        ("scheduled_task_points_to_staging_path", 85, task & _staged(actions)), ("scheduled_task_encoded_or_download", 80, task & coded(actions)), ("hidden_scheduled_task", 35, task & F.when(field("hidden") != "", field("hidden")).otherwise(text).rlike(r"\btrue\b|hidden")),
        ("lnk_target_in_staging_path", 70, lnk & F.when(local != "", local).otherwise(target).rlike(V.STAGING) & linked), ("lnk_encoded_or_download_argument", 75, lnk & coded(link)), ("lnk_lolbin_target", 45, lnk & lolbin(link) & linked),
        ("jumplist_access_to_staging_path", 65, jump & _staged(opened)), ("jumplist_encoded_or_download_argument", 70, jump & coded(F.concat_ws(" ", opened, arguments))), ("jumplist_lolbin_access", 40, jump & lolbin(F.concat_ws(" ", opened, arguments)) & opened.rlike(V.EXECUTABLE)),
        ("srum_staging_app_usage", 65, usage & _staged(app)), ("srum_lolbin_app_usage", 45, usage & lolbin(app_text)), ("srum_network_usage_context", 35, usage & ((volume > 0) | F.contains(field("table"), F.lit("network")))), ("srum_high_volume_network_usage", 55, usage & (volume >= 10 * 1024 * 1024)),
        ("removable_media_connection", 30, of("usb_device_fact")),
        ("appcompatcache_staging_execution_artifact", 85, cache & _staged(cached)), ("appcompatcache_lolbin_execution_artifact", 45, cache & lolbin(cached) & cached.rlike(V.EXECUTABLE)), ("appcompatcache_executed_flag", 25, cache & cached_bad & true("executed")),
        ("service_points_to_staging_path", 85, service & _staged(text)), ("remote_management_service_context", 25, service & named.rlike(V.REMOTE_MANAGEMENT)),
        ("public_remote_peer", 55, network & N.public_by_registry(there)), ("localhost_high_port_context", 20, network & F.startswith(here, F.lit("127.")) & (port >= 1024)),
        ("non_system_high_port_listener", 35, network & F.contains(field("state"), F.lit("listen")) & (port >= 1024) & ~owner.isin(V.BASELINE_PROCESSES)), ("admin_or_sensitive_process_network", 25, network & lolbin(owner) & ~owner.isin(V.BASELINE_PROCESSES)),
        ("public_non_allowlisted_network_ioc", 55, ioc & public & _foreign(urls)), ("internal_or_loopback_url_context", 35, ioc & private & _foreign(urls)), ("script_download_network_ioc", 70, ioc & coded(text) & _foreign(urls)),
        ("dga_domain", 75, ioc & (F.size(urls) == 0) & (F.size(ips) == 0) & _strange_host(field("host", "value"))),
        ("event_encoded_or_download_execution", 75, events & coded(text)), ("event_high_risk_persistence", 80, events & text.rlike(V.HIGH_PERSISTENCE)), ("event_staging_path", 55, events & _staged(text)), ("event_non_allowlisted_url", 45, events & _foreign(urls)),
        ("admin_share_access", 70, events & event.isin(V.ADMIN_SHARE_EVENTS) & has(text, V.ADMIN_SHARES)), ("explicit_credential_logon", 40, events & (event == "4648")),
        ("anti_forensics_execution", 80, events & ((event == "1102") | ((event == "104") & F.contains(text, F.lit("cleared")) & F.contains(text, F.lit("log"))))), ("privileged_group_modification", 75, events & event.isin(V.GROUP_EVENTS) & _privileged(text)),
        ("event_service_install_abnormal", 80, events & abnormal), ("event_kernel_driver_nonstandard_path", 0, events & abnormal & ends(installed, [".sys"])),
        *((f"powershell_ttp:{n}", 0, power & ttp(n)) for n in V.SHELL_TTP),
        ("powershell_credential_dumping", 95, power & ttp("invoke_mimikatz", "lsass_access")), ("powershell_encoded_command", 85, power & ttp("encoded_command")), ("powershell_download_cradle", 80, power & ttp("download_cradle")), ("powershell_evasion_or_load", 80, power & ttp("amsi_bypass", "reflection_load")),
        ("powershell_lateral_or_wmi", 70, power & ttp("ps_remoting_lateral", "wmi_execution")), ("powershell_credential_harvest", 60, power & ttp("credential_harvest")), ("powershell_stealth_flags", 45, power & ttp("bypass_execution_policy", "no_profile_hidden")),
        ("powershell_base64_blob", 35, power & ttp("long_base64_blob") & ~ttp("encoded_command", "download_cradle")), ("powershell_non_allowlisted_url", 30, power & _foreign(_urls(field("urls")))), ("powershell_network_indicator", 20, power & ((field("domains") != "") | (field("ips") != ""))), ("powershell_suspicious_marker", 25, power & (field("suspicious_markers") != "")),
        ("powershell_encoded_command", 85, spoken_code), ("powershell_ttp:encoded_command", 0, spoken_code), ("powershell_download_cradle", 80, spoken_load), ("powershell_ttp:download_cradle", 0, spoken_load), ("powershell_high_severity", 0, power & ttp(*V.SEVERE_TTP)),
        ("rdp_target_reference", 25, of("rdp_artifact_fact") & ((F.size(ips) > 0) | (field("host_or_target", "remote_host", "target", "server", "hostname").rlike(r"^[a-z0-9_-]{1,63}(\.[a-z0-9_-]{1,63})+$") & ~field("host_or_target", "remote_host", "target", "server", "hostname").rlike(V.EXECUTABLE)))),
        *(("wmi_event_subscription_persistence", p, consumer & c) for p, c in ((85, coded(payload)), (80, _staged(payload)), (60, lolbin(payload)), (45, _foreign(_urls(payload))))),
        ("userassist_execution_from_staging", 55, of("userassist_fact") & _staged(assist)),
        ("sensitive_privilege_enabled_on_non_baseline", 65, of("privilege_fact") & field("privilege").isin(V.SENSITIVE_PRIVILEGES) & enabled & ~field("process_name", "process").isin(V.BASELINE_PROCESSES)),
        ("kernel_ssdt_hook", 90, of("ssdt_integrity_fact") & (field("module") != "") & ~field("module").rlike(V.KERNEL_MODULE)), ("process_view_inconsistency", 80, of("psxview_fact") & unlinked),
        ("decoded_encoded_command", 90, decoded & ttp("encoded_command")), ("decoded_ttp:encoded_command", 0, decoded & ttp("encoded_command")), ("decoded_download_cradle", 85, decoded & ttp("download_cradle")), ("decoded_ttp:download_cradle", 0, decoded & ttp("download_cradle")),
        ("decoded_long_base64_blob", 60, decoded & ttp("long_base64_blob")), ("decoded_ttp:long_base64_blob", 0, decoded & ttp("long_base64_blob")),
    ]


#: Signals that keep a fact that also names a vendor.
SURE = [
    "memory_injection", "process_view_inconsistency", "kernel_ssdt_hook", "sensitive_privilege_enabled_on_non_baseline", "userassist_execution_from_staging", "encoded_or_download_execution", "event_encoded_or_download_execution",
    "script_download_network_ioc", "high_risk_persistence", "registry_points_to_staging_path", "scheduled_task_points_to_staging_path", "service_points_to_staging_path", "wmi_event_subscription_persistence",
]


def suppressions(scored: Column) -> list[tuple[str, Column]]:
    """(name, condition) of what speaks against a fact with these signals."""
    text, none, urls = F.col("blob"), F.size(scored) == 0, _urls(F.col("blob"))
    path, value = _path("normalized_path", "path"), field("value_data")
    high = text.rlike(V.HIGH_PERSISTENCE)
    return [
        ("memprocfs_baseline_listing", of("memprocfs_indicator_fact") & none), ("benign_system_or_vendor_path_noise", of("file_execution_fact") & path.rlike(V.BENIGN_FOLDER) & ~path.rlike(V.LOLBIN_WORDS)),
        ("registry_persistence_default_value", of("registry_persistence_fact") & high & ~F.array_contains(scored, "high_risk_persistence")),
        ("normal_windows_service_imagepath", of("registry_persistence_fact") & (field("value_name") == "imagepath") & (N.path_of_candidate(value).rlike(V.NORMAL_SERVICE) | value.rlike(V.NORMAL_SERVICE)) & none),
        ("baseline_service_registry", of("registry_persistence_fact") & none & (field("persistence_type") == "service")), ("scheduled_task_without_suspicious_action", of("scheduled_task_fact") & none), ("baseline_or_benign_shortcut", of("lnk_execution_fact") & none),
        ("baseline_application_access_history", of("jumplist_fact") & none), ("baseline_srum_usage_context", of("srum_usage_fact") & none), ("baseline_appcompatcache_entry", of("appcompatcache_execution_fact") & none), ("baseline_service_context", of("service_fact") & none),
        ("known_vendor_update_url", of("network_ioc_fact") & (F.size(urls) > 0) & ~_foreign(urls)), ("noisy_event_provider_without_behavior_signal", of("event_log_fact") & none & field("provider").rlike(V.NOISY_PROVIDER)),
        ("rdp_context_without_target", of("rdp_artifact_fact") & none), ("wmi_default_consumer_no_payload", of("wmi_subscription_fact") & F.contains(field("type", "class"), F.lit("consumer")) & none & (F.concat(field("extracted_script_text"), field("extracted_script_filename"), field("extracted_command_template"), field("extracted_executable_path")) == "")),
        ("psxview_no_view_data", of("psxview_fact") & (F.concat(field("pslist"), field("psscan")) == "")),
        ("known_vendor_or_update_noise", text.rlike(V.VENDOR) & ~F.arrays_overlap(scored, F.array(*map(F.lit, SURE)))),
    ]


def with_score(facts: DataFrame) -> DataFrame:
    """``facts`` with ``score``, ``scored`` (sorted signals) and ``suppressed`` (sorted reasons against); undecidable conditions do not count.

    Severe script techniques lift a script's score to 210 at least.
    """
    given = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(p).alias("points"))) for n, p, c in table())))
    found = computed(computed(facts, blob=blob()), _given=given)
    named = computed(found, score=F.aggregate("_given", F.lit(0), lambda a, g: a + g["points"]), scored=F.array_sort(F.array_distinct(F.transform("_given", lambda g: g["name"]))))
    against = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in suppressions(F.col("scored"))))))
    score = F.when(F.array_contains("scored", "powershell_high_severity"), F.greatest("score", F.lit(210))).otherwise(F.col("score"))
    return computed(named, suppressed=against, score=score).drop("blob", "_given")


def entity_keys() -> Column:
    """Entities that a fact names: process, path, service, task, registry key, sockets, addresses, URLs, hashes, hosts; else its own artefact."""
    here, there, hp, tp = field("src_ip", "localaddr"), field("dst_ip", "foreignaddr"), field("src_port", "localport"), field("dst_port", "foreignport")
    text, open_ips = blob(), ["*", "0.0.0.0", "::"]
    pid, name, path = field("pid"), field("process_name", "image_name", "owner", "imagefilename"), _path("normalized_path", "path", "file_path", "imagepath")
    one = lambda kind, value, when=None: F.when((value != "") if when is None else when, F.concat(F.lit(f"{kind}:"), value))
    host = field("host_or_target", "remote_host", "server", "dns_name", "dst_host")
    hashes = [one("hash", field(k), field(k).rlike("^([a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64})$")) for k in ("sha256", "sha1", "md5", "imphash", "file_hash", "hash")]
    plain = F.array(
        one("pid", pid), one("process", F.concat(name, F.lit(":"), pid), (pid != "") & (name != "")), one("path", path), one("service", field("service_name")), one("task", field("task_name", "task_path")),
        one("registry", F.translate(field("normalized_registry_path", "registry_path"), "\\", "/")), one("socket", F.concat(here, F.lit(":"), hp), (here != "") & (hp != "")), one("peer", F.concat(there, F.lit(":"), tp), (there != "") & (tp != "") & ~there.isin(open_ips)),
        one("ip", here, (here != "") & ~here.isin(open_ips)), one("ip", there, (there != "") & ~there.isin(open_ips)), *hashes, one("host", host, host.rlike(r"^[a-z0-9_-]{1,63}(\.[a-z0-9_-]{1,63})+$") & ~host.rlike(V.EXECUTABLE) & (host != field("computer"))))
    urls = F.transform(F.slice(_urls(text), 1, 3), lambda u: F.concat(F.lit("url:"), F.regexp_replace(u, "[.,;]+$", "")))
    ips = F.transform(F.slice(F.filter(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), 1), N.is_quad), 1, 3), lambda i: F.concat(F.lit("ip:"), i))
    found = F.array_distinct(F.concat(F.array_compact(plain), urls, ips))
    own = F.array(F.concat(F.lit("artifact:"), F.substring(F.when(field("artifact") != "", field("artifact")).otherwise(F.lower(F.col("fact_id").cast("string"))), 1, 120)))
    return F.when(F.size(found) > 0, found).otherwise(own)


#: Kinds of candidates in the order in which they are told: (kind, signals).
KINDS = [
    ("encoded_powershell_or_download_cradle", ["decoded_encoded_command", "decoded_download_cradle", "decoded_long_base64_blob"]), ("kernel_rootkit_indicator", ["kernel_ssdt_hook"]), ("memory_injection", ["memory_injection"]),
    ("process_hiding_indicator", ["process_view_inconsistency"]), ("wmi_event_subscription_persistence", ["wmi_event_subscription_persistence"]), ("elevated_privilege_context", ["sensitive_privilege_enabled_on_non_baseline"]),
    ("encoded_powershell_or_download_cradle", ["powershell_ttp:encoded_command", "powershell_ttp:download_cradle", "powershell_ttp:long_base64_blob"]), ("suspicious_powershell_command", [f"powershell_ttp:{n}" for n in V.SHELL_TTP]),
    ("encoded_powershell_or_download_cradle", ["encoded_or_download_execution", "event_encoded_or_download_execution", "scheduled_task_encoded_or_download", "script_download_network_ioc"]),
    ("high_risk_persistence", ["high_risk_persistence", "event_high_risk_persistence", "registry_points_to_staging_path", "scheduled_task_points_to_staging_path", "service_points_to_staging_path", "hidden_scheduled_task", "userassist_execution_from_staging"]),
    ("admin_or_remote_management_persistence", ["admin_service_name", "registry_lolbin_imagepath", "remote_management_or_admin_service"]), ("network_c2_or_external_peer", ["public_remote_peer", "public_non_allowlisted_network_ioc"]),
    ("internal_or_local_staging_network", ["internal_or_loopback_url_context", "localhost_high_port_context", "non_system_high_port_listener"]), ("data_exfiltration_egress_outlier", ["srum_egress_self_relative_outlier"]),
    ("srum_usage_context", ["srum_staging_app_usage", "srum_lolbin_app_usage", "srum_network_usage_context", "srum_high_volume_network_usage"]),
    ("suspicious_file_or_process_execution", ["execution_from_staging_path", "process_from_staging_path", "event_staging_path", "lnk_target_in_staging_path", "lnk_encoded_or_download_argument", "lnk_lolbin_target", "jumplist_access_to_staging_path",
        "jumplist_encoded_or_download_argument", "jumplist_lolbin_access", "appcompatcache_staging_execution_artifact", "appcompatcache_lolbin_execution_artifact"]),
    ("remote_access_context", ["rdp_target_reference"]), ("lateral_movement_admin_share", ["admin_share_access"]), ("privilege_escalation_group_modification", ["privileged_group_modification"]), ("account_context_anomaly", ["service_account_interactive_execution"]),
    ("ransomware_mass_encryption", ["mass_encryption_burst"]), ("kernel_driver_nonstandard_path", ["event_kernel_driver_nonstandard_path"]), ("service_install_nonstandard_path", ["event_service_install_abnormal"]), ("defense_evasion_anti_forensics", ["anti_forensics_execution"]),
    ("system_recovery_inhibition", ["inhibit_system_recovery"]), ("data_collection_staging", ["archive_in_staging_path"]), ("removable_media_usage", ["removable_media_connection"]),
]
#: Signals that make a candidate ready by themselves.
STRONG = [
    "memory_injection", "process_view_inconsistency", "kernel_ssdt_hook", "sensitive_privilege_enabled_on_non_baseline", "userassist_execution_from_staging", "encoded_or_download_execution", "event_encoded_or_download_execution", "scheduled_task_encoded_or_download",
    "script_download_network_ioc", "high_risk_persistence", "event_high_risk_persistence", "event_service_install_abnormal", "event_kernel_driver_nonstandard_path", "anti_forensics_execution", "registry_points_to_staging_path", "scheduled_task_points_to_staging_path",
    "service_points_to_staging_path", "execution_from_staging_path", "process_from_staging_path", "wmi_event_subscription_persistence", "lnk_target_in_staging_path", "lnk_encoded_or_download_argument", "lnk_lolbin_target", "jumplist_access_to_staging_path",
    "jumplist_encoded_or_download_argument", "jumplist_lolbin_access", "appcompatcache_staging_execution_artifact", "appcompatcache_lolbin_execution_artifact", "srum_staging_app_usage", "srum_lolbin_app_usage", "srum_high_volume_network_usage", "registry_lolbin_imagepath",
    "decoded_encoded_command", "decoded_download_cradle", *(f"powershell_ttp:{n}" for n in V.SHELL_TTP), *(f"decoded_ttp:{n}" for n in ("encoded_command", "download_cradle", "long_base64_blob")),
]


def candidate_type(signals: Column) -> Column:
    cases = [(kind, F.arrays_overlap(signals, F.array(*map(F.lit, names)))) for kind, names in KINDS]
    out = F.when(cases[0][1], cases[0][0])
    for kind, condition in cases[1:]:
        out = out.when(condition, kind)
    return out.otherwise("context_only")


def candidates(facts: DataFrame, supports: int = SUPPORTS, outliers: DataFrame | None = None) -> DataFrame:
    """(entity_key, score, candidate_type, signals, source_tools, fact_types, n_supports, suppression, ready, review_worthy) by entity.

    Of a signal from one tool and fact type, the first ``supports`` facts by fact_id count; a fact gives at most 100 points, two tools 35 more, two fact types 30, three
    supports 10.  Kept are candidates of 35 points and ready ones.  ``outliers`` (fact_id) are ready by themselves.  An entity with most facts is
    numbered within (entity, signal, tool, type), so it is not one task's work.
    """
    marked = facts.join(F.broadcast(outliers.select("fact_id", F.lit(True).alias("outlier"))), "fact_id", "left") if outliers is not None else facts.withColumn("outlier", F.lit(False))  # the outliers of one rule are a few
    scored = with_score(marked).withColumn("outlier", F.coalesce("outlier", F.lit(False)))
    empty = F.array().cast("array<string>")
    idle = F.col("fact_type").isin(UNSCORED)
    scored = scored.withColumns({"score": F.when(idle, 0).otherwise(F.col("score")), "scored": F.when(idle, empty).otherwise(F.col("scored")), "suppressed": F.when(idle, empty).otherwise(F.col("suppressed"))})
    named = scored.withColumn("scored", F.when(F.col("outlier"), F.array_union("scored", F.array(F.lit("srum_egress_self_relative_outlier")))).otherwise(F.col("scored")))
    slim = named.select("fact_id", "fact_type", "source_tool", "score", "scored", "suppressed", "outlier", F.explode(entity_keys()).alias("entity_key"))
    wide = slim.groupBy("entity_key").agg(F.array_sort(F.collect_set("source_tool")).alias("source_tools"), F.array_sort(F.collect_set("fact_type")).alias("fact_types"))
    against = slim.select("entity_key", F.explode("suppressed").alias("reason")).groupBy("entity_key", "reason").agg(F.count(F.lit(1)).alias("n"))
    against = against.groupBy("entity_key").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))), 1, 3), lambda x: x["reason"]), "; ").alias("reasons"))
    order = Window.partitionBy("entity_key", "signal", "source_tool", "fact_type").orderBy("fact_id")
    each = slim.where("(score > 0 AND size(scored) > 0) OR outlier").select("entity_key", "fact_id", "fact_type", "source_tool", "score", F.explode("scored").alias("signal")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= supports)
    by_fact = each.groupBy("entity_key", "fact_id").agg(F.least(F.first("score"), F.lit(100)).alias("points"))
    sums = by_fact.groupBy("entity_key").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n_supports"))
    signals = each.groupBy("entity_key").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    met = wide.join(sums, "entity_key", "left").join(signals, "entity_key", "left").join(against, "entity_key", "left")
    some, tools, types = F.coalesce("n_supports", F.lit(0)) > 0, F.size("source_tools"), F.size("fact_types")
    bonus = F.when(some & (tools >= 2), 35).otherwise(0) + F.when(some & (types >= 2), 30).otherwise(0) + F.when(F.coalesce("n_supports", F.lit(0)) >= 3, 10).otherwise(0)
    found = computed(met, score=(F.coalesce("points", F.lit(0)) + bonus).cast("long"), signals=F.coalesce("signals", empty))
    strong = F.arrays_overlap("signals", F.array(*map(F.lit, STRONG)))
    found = computed(found, candidate_type=candidate_type(F.col("signals")), suppression=F.when(strong | F.col("reasons").isNull() | (F.col("score") >= 120), "").otherwise(F.col("reasons")))
    calm = ~F.col("candidate_type").isin(CONTEXT_TYPES)
    ready = some & (F.col("suppression") == "") & calm & ((strong & (F.col("score") >= 80)) | ((F.col("score") >= 130) & (types >= 2) & (tools >= 2)))
    found = computed(found, ready=ready | F.array_contains("signals", "srum_egress_self_relative_outlier"))
    worthy = ~F.col("ready") & (F.col("suppression") == "") & calm & (F.col("score") >= 60) & (tools >= 2) & (types >= 2)
    kept = found.withColumn("review_worthy", worthy).where(some | (F.col("suppression") != "")).where((F.col("score") >= 35) | F.col("ready"))
    return kept.select("entity_key", "score", "candidate_type", "signals", "source_tools", "fact_types", F.coalesce("n_supports", F.lit(0)).alias("n_supports"), "suppression", "ready", "review_worthy")


def selected(found: DataFrame, most: int = 1000) -> DataFrame:
    """The candidates in their order (ready, of high-value tools, score, fact types, tools, type, entity, all descending): ``most``, and all ready ones."""
    limit = max(most, found.where("ready").count())
    high = F.arrays_overlap("source_tools", F.array(*map(F.lit, V.HIGH_VALUE_TOOLS)))
    return found.orderBy(F.desc("ready"), high.desc(), F.desc("score"), F.size("fact_types").desc(), F.size("source_tools").desc(), F.desc("candidate_type"), F.desc("entity_key")).limit(limit)


def ceiling(found: DataFrame) -> DataFrame:
    """(bucket, n) of all candidates: ready, review_worthy, and why the others are neither."""
    tools, types = F.size("source_tools"), F.size("fact_types")
    bucket = F.when(F.col("ready"), "ready").when(F.col("review_worthy"), "review_worthy").when(F.col("suppression") != "", "suppressed").when(F.col("candidate_type").isin(CONTEXT_TYPES), "context").when(tools < 2, "single_source").when(types < 2, "single_fact_type").otherwise("low_score")
    return found.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
