"""Typed compilers: records of many tools to facts, driven by a table of families.

A family says which fact type a tool's records become, under which names their values go, what a record
must have, and which indexes its facts enter.  The table has a fixed number of rows and is
broadcast, so all tools are compiled in one pass over the records, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.functions.columns import computed
from quarry.functions.columns import path as plain_path

#: tool: (fact type, {name: record keys, first non-blank wins}, names of which one must be there, drop reason, {index: name}).
FAMILIES: dict[str, tuple[str, dict[str, list[str]], list[str], str, dict[str, str]]] = {
    "vol_pstree": ("process_fact", {"pid": ["PID"], "parent_pid": ["PPID"], "process_name": ["ImageFileName"], "path": ["Path"], "cmdline": ["Cmd", "Args"], "create_time": ["CreateTime"]}, ["pid", "process_name"], "missing_pid_or_name", {"by_pid": "pid", "by_path": "normalized_path"}),
    "vol_psscan": ("process_fact", {"pid": ["PID"], "parent_pid": ["PPID"], "process_name": ["ImageFileName"], "create_time": ["CreateTime"], "exit_time": ["ExitTime"]}, ["pid", "process_name"], "missing_pid_or_name", {"by_pid": "pid"}),
    "vol_netscan": ("network_connection_fact", {"pid": ["PID"], "src_ip": ["LocalAddr"], "src_port": ["LocalPort"], "dst_ip": ["ForeignAddr"], "dst_port": ["ForeignPort"], "state": ["State"], "protocol": ["Proto"], "owner": ["Owner"]}, ["pid", "src_ip", "dst_ip"], "no_pid_or_endpoint", {"by_pid": "pid", "by_ip": "dst_ip", "by_port": "dst_port"}),
    "vol_malfind": ("memory_injection_fact", {"pid": ["PID"], "process_name": ["Process"], "protection": ["Protection"], "vad_start": ["Start VPN"], "vad_end": ["End VPN"], "tag": ["Tag"], "characterization": ["characterization"]}, ["pid"], "missing_pid", {"by_pid": "pid"}),
    "vol_cmdline": ("process_cmdline_fact", {"pid": ["PID"], "process_name": ["Process"], "cmdline": ["Args"]}, ["pid"], "no_pid", {"by_pid": "pid"}),
    "vol_dlllist": ("dll_load_fact", {"pid": ["PID"], "process_name": ["Process"], "dll_name": ["Name"], "path": ["Path"]}, ["pid"], "no_pid", {"by_pid": "pid", "by_path": "normalized_path"}),
    "vol_handles": ("handle_fact", {"pid": ["PID"], "process_name": ["Process"], "handle_type": ["Type"], "handle_name": ["Name"], "access": ["GrantedAccess"]}, ["handle_type"], "no_handle_type", {"by_pid": "pid"}),
    "vol_envars": ("environment_variable_fact", {"pid": ["PID"], "process_name": ["Process"], "variable": ["Variable"], "value": ["Value"], "block": ["Block"]}, ["variable"], "no_variable", {"by_envvar_name": "variable", "by_pid": "pid", "by_process_name": "process_name"}),
    "vol_getsids": ("sid_fact", {"pid": ["PID"], "process_name": ["Process"], "sid": ["SID"], "account": ["Name"]}, ["sid"], "no_pid_or_sid", {"by_pid": "pid"}),
    "vol_privileges": ("privilege_fact", {"pid": ["PID"], "process_name": ["Process"], "privilege": ["Privilege"], "attributes": ["Attributes"]}, ["privilege"], "no_pid_or_privilege", {"by_pid": "pid"}),
    "vol_svcscan": ("service_fact", {"pid": ["PID"], "service_name": ["Name"], "display": ["Display"], "path": ["Binary", "Dll"], "state": ["State"], "start": ["Start"]}, ["service_name"], "missing_service_name", {"by_service_name": "service_name", "by_pid": "pid", "by_path": "normalized_path"}),
    "vol_sessions": ("session_fact", {"pid": ["Process ID"], "process_name": ["Process"], "session_id": ["Session ID"], "user": ["User Name"]}, ["pid"], "no_pid", {"by_pid": "pid", "by_process_name": "process_name"}),
    "vol_ssdt": ("ssdt_integrity_fact", {"address": ["Address"], "index": ["Index"], "module": ["Module"], "symbol": ["Symbol"]}, ["index", "module"], "no_index_or_module", {}),
    "vol_filescan": ("filesystem_listing_fact", {"path": ["Name"], "offset": ["Offset"]}, ["path"], "vol_filescan_path_empty", {"by_path": "normalized_path"}),
    "vol_reg_hivelist": ("registry_hive_fact", {"path": ["FileFullPath"], "offset": ["Offset"]}, ["path"], "empty_hive_path", {}),
    "vol_modscan": ("kernel_module_fact", {"module": ["Name"], "path": ["Path"], "base": ["Base"]}, ["module", "path"], "no_name_or_path", {"by_path": "normalized_path"}),
    "vol_psxview": ("psxview_fact", {"pid": ["PID"], "process_name": ["Name"], "pslist": ["pslist"], "psscan": ["psscan"], "exit_time": ["Exit Time"]}, ["pid"], "no_pid", {"by_pid": "pid"}),
    "parse_amcache": ("file_execution_fact", {"path": ["path"], "sha1": ["sha1"], "first_run": ["first_run"]}, ["path", "sha1"], "missing_path_and_hash", {"by_path": "normalized_path", "by_hash": "sha1"}),
    "parse_prefetch": ("file_execution_fact", {"path": ["path"], "filename": ["executable_name"], "run_count": ["run_count"]}, ["filename"], "missing_prefetch_executable", {"by_path": "normalized_path"}),
    "extract_mft_timeline": ("filesystem_timeline_fact", {"path": ["path", "filename"], "sha1": ["sha1"], "si_created": ["si_created"], "fn_created": ["fn_created"], "si_modified": ["si_modified"], "fn_modified": ["fn_modified"], "action": ["action"], "timestomped": ["timestomped"]}, ["path"], "missing_path", {"by_path": "normalized_path"}),
    "parse_registry_persistence": ("registry_persistence_fact", {"registry_path": ["registry_path"], "value_name": ["value_name"], "value_data": ["value_data"], "value_type": ["value_type"], "persistence_type": ["persistence_type"], "service_name": ["service_name"], "control_set": ["control_set"], "hive": ["hive_type"], "last_write_time": ["last_write_time"], "source_hive": ["source_hive"]}, ["registry_path"], "missing_registry_path", {"by_registry_path": "registry_path", "by_service_name": "service_name"}),
    "parse_scheduled_tasks_disk": ("scheduled_task_fact", {"task_name": ["task_name"], "task_path": ["task_path"], "actions": ["actions"], "triggers": ["triggers"], "enabled": ["enabled"], "hidden": ["hidden"], "author": ["author"], "user_id": ["user_id"]}, ["task_name"], "missing_task_name", {"by_task_name": "task_name", "by_user": "user_id"}),
    "parse_event_logs": ("event_log_fact", {"event_id": ["EventID"], "provider": ["Provider"], "channel": ["Channel"], "computer": ["Computer"], "timestamp": ["TimeCreated"], "message": ["Message"]}, ["event_id"], "missing_event_id", {"by_event_id": "event_id"}),
    "extract_network_iocs": ("network_ioc_fact", {"value": ["value"], "kind": ["type"], "classification": ["classification"], "port": ["port"]}, ["value"], "missing_value", {"by_ip": "value", "by_port": "port"}),
    "decode_base64_strings": ("decoded_string_fact", {"decoded_preview": ["decoded_preview"], "original_preview": ["original_preview"], "encoding": ["encoding"], "suspicious_keywords": ["suspicious_keywords"]}, ["decoded_preview"], "decoded_empty", {}),
    "parse_usb_history": ("usb_device_fact", {"device_kind": ["type"], "serial": ["serial"], "vendor": ["vendor"], "product": ["product"], "friendly_name": ["friendly_name"], "drive_letter": ["drive_letter"], "user": ["user"], "registry_path": ["registry_path"]}, ["serial", "friendly_name", "drive_letter"], "missing_usb_entity", {"by_user": "user", "by_registry_path": "registry_path"}),
    "vol_ldrmodules": ("memory_injection_fact", {"pid": ["Pid", "PID"], "process_name": ["Process"], "vad_start": ["Base"], "mapped_path": ["MappedPath"], "in_load": ["InLoad"], "in_mem": ["InMem"]}, ["pid"], "missing_pid", {"by_pid": "pid"}),
    "vol_callbacks": ("kernel_callback_fact", {"callback_type": ["Type"], "module": ["Module"], "address": ["Callback"]}, ["callback_type", "module"], "no_type_or_module", {}),
    "vol_userassist": ("userassist_fact", {"registry_path": ["Path", "KeyPath"], "hive": ["Hive Name", "HiveName"], "entry_name": ["Name"], "count": ["Count"], "last_write_time": ["Last Write Time"]}, ["registry_path", "hive"], "no_hive_or_path", {}),
    "parse_userassist": ("userassist_fact", {"entry_name": ["program", "Name"], "registry_path": ["registry_path", "Path"], "user": ["user"], "count": ["run_count"], "last_run": ["last_run"]}, ["entry_name"], "no_hive_or_path", {"by_user": "user"}),
    "parse_rdp_artifacts": ("rdp_artifact_fact", {"record_type": ["record_type", "type"], "event_id": ["event_id", "EventID"], "user": ["user", "username"], "host_or_target": ["host_or_target", "server", "target"], "source_ip": ["source_ip", "ip"], "computer": ["computer"], "timestamp": ["timestamp"], "source_file": ["source_file"]}, ["record_type", "event_id", "user", "host_or_target", "source_ip", "source_file"], "empty_record", {"by_event_id": "event_id", "by_user": "user", "by_host": "host_or_target", "by_ip": "source_ip"}),
    "parse_wmi_subscription": ("wmi_subscription_fact", {"type": ["type", "class"], "name": ["extracted_name", "name"], "extracted_script_text": ["extracted_script_text"], "extracted_script_filename": ["extracted_script_filename"], "extracted_command_template": ["extracted_command_template"], "extracted_executable_path": ["extracted_executable_path"], "filter": ["extracted_filter_ref"], "consumer": ["extracted_consumer_ref"]}, ["type", "name", "filter", "consumer"], "empty_wmi_record", {}),
    "run_strings": ("string_artifact_fact", {"string_value": ["value", "string"]}, ["string_value"], "string_too_short", {}),
    "run_yara": ("yara_match_fact", {"rule": ["rule"], "target": ["target", "path"], "namespace": ["namespace"], "path": ["target", "path"]}, ["rule", "target"], "empty_yara_record", {"by_path": "normalized_path"}),
    "sleuthkit_fls": ("filesystem_listing_fact", {"path": ["path", "name"], "inode": ["inode"], "flags": ["flags", "type"]}, ["path"], "fls_path_empty", {"by_path": "normalized_path"}),
    "sleuthkit_mactime": ("filesystem_timeline_fact", {"path": ["path", "file_name"], "timestamp": ["timestamp", "date"], "activity": ["activity", "macb"]}, ["path"], "mactime_path_empty", {"by_path": "normalized_path"}),
    "sleuthkit_tsk_recover": ("filesystem_listing_fact", {"path": ["path", "original_path"], "recovered_path": ["recovered_path"], "name": ["name"], "size": ["size"], "sha256": ["sha256"]}, ["path", "recovered_path"], "tsk_recover_path_empty", {"by_path": "normalized_path", "by_hash": "sha256"}),
    "run_bulk_extractor": ("ioc_carve_summary_fact", {"emails": ["emails"], "urls": ["urls"], "domains": ["domains"], "carved_feature_total": ["carved_feature_total"]}, ["emails", "urls", "domains", "carved_feature_total"], "non_dict_record", {}),
    "run_appcompatcacheparser": ("appcompatcache_execution_fact", {"path": ["Path", "path"], "control_set": ["ControlSet"], "position": ["CacheEntryPosition"], "last_modified_utc": ["LastModifiedTimeUTC"], "executed": ["Executed"], "duplicate": ["Duplicate"], "source_file": ["SourceFile"]}, ["path"], "missing_path", {"by_path": "normalized_path"}),
    "run_lecmd": ("lnk_execution_fact", {"local_path": ["LocalPath"], "target_abs_path": ["TargetIDAbsolutePath"], "arguments": ["Arguments"], "working_directory": ["WorkingDirectory"], "source_file": ["SourceFile"], "machine_id": ["MachineID"], "target_modified": ["TargetModified"], "path": ["LocalPath", "TargetIDAbsolutePath"]}, ["local_path", "target_abs_path", "source_file"], "empty_record", {"by_path": "normalized_path"}),
    "run_jlecmd": ("jumplist_fact", {"path": ["Path", "LocalPath"], "arguments": ["Arguments"], "app_id": ["AppId"], "app_description": ["AppIdDescription"], "source_file": ["SourceFile"], "last_modified": ["LastModified"]}, ["path", "app_id", "source_file"], "empty_record", {"by_path": "normalized_path"}),
    "run_mftecmd": ("filesystem_timeline_fact", {"path": ["FullPath", "ParentPath", "FileName"], "filename": ["FileName"], "si_created": ["Created0x10"], "fn_created": ["Created0x30"], "si_lt_fn": ["SI<FN"], "usec_zeros": ["uSecZeros"], "entry": ["EntryNumber"]}, ["path", "entry"], "missing_locator", {"by_path": "normalized_path"}),
    "parse_powershell_transcripts": ("powershell_command_fact", {"command": ["command"], "decoded_command": ["decoded_command"], "host_application": ["host_application"], "user": ["user"], "timestamp": ["timestamp"], "urls": ["urls"], "domains": ["domains"], "ips": ["ips"], "paths": ["paths"], "suspicious_markers": ["suspicious_markers"], "source_file": ["source_file"]}, ["command", "decoded_command", "host_application"], "no_powershell_signal_noise", {"by_user": "user", "by_source_file": "source_file"}),
    "run_memprocfs": ("memprocfs_indicator_fact", {"pid": ["pid", "PID"], "process_name": ["process_name", "Process"], "semantic_family": ["semantic_family"], "semantic_role": ["semantic_role"], "indicator_type": ["indicator_type", "Type"], "path": ["path", "Path"], "description": ["description"], "source_csv": ["source_csv"]}, ["pid", "path", "indicator_type", "description"], "no_canonical_key", {"by_pid": "pid", "by_path": "normalized_path"}),
    "run_srumecmd": ("srum_usage_fact", {"table": ["_srum_table"], "application": ["ApplicationName"], "sid": ["UserSid"], "bytes_sent": ["BytesSent"], "bytes_received": ["BytesReceived"], "timestamp": ["TimeStamp"], "source_file": ["SourceFile"]}, ["application"], "missing_application", {"by_user": "sid"}),
}


def table(spark: SparkSession) -> DataFrame:
    """The families, one row for each tool."""
    pairs = lambda named: [(k, v) for k, v in named.items()]
    rows = [(tool, kind, pairs(names), needs, reason, pairs(index)) for tool, (kind, names, needs, reason, index) in FAMILIES.items()]
    return spark.createDataFrame(rows, "tool string, fact_type string, names array<struct<name string, keys array<string>>>, needs array<string>, reason string, indexes array<struct<index string, name string>>")


def compile_records(records: DataFrame) -> DataFrame:
    """(tool, record_no, fact_type, fields, fact_id, drop_reason, indexes) of rows (tool, record_no, record), ``record`` being JSON text.

    Every record gives one row: ``drop_reason`` is null for a fact, else ``unknown_tool``, ``non_dict_record`` or
    the family's.  ``fact_id`` is the SHA-1 of type and fields, so facts that say the same have the same id.  Zero is a value;
    null and blank are not.
    """
    spark = records.sparkSession
    parsed = computed(records.select("tool", "record_no", "record"), m=F.from_json("record", "map<string,string>"))
    known = parsed.join(F.broadcast(table(spark)), "tool", "left")  # as many rows as families
    value = lambda k: F.nullif(F.trim(F.try_element_at("m", k)), F.lit(""))
    entries = F.transform("names", lambda n: F.struct(n["name"].alias("name"), F.element_at(F.concat(F.array_compact(F.transform(n["keys"], value)), F.array(F.lit(None).cast("string"))), 1).alias("value")))
    made = computed(known, fields=F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    made = computed(made, where=plain_path(F.try_element_at("fields", F.lit("path"))))
    made = computed(made, fields=F.when(F.col("where").isNotNull(), F.map_concat("fields", F.create_map(F.lit("normalized_path"), "where"))).otherwise(F.col("fields")))
    lacking = ~F.exists("needs", lambda n: F.map_contains_key("fields", n))
    why = F.when(F.col("fact_type").isNull(), "unknown_tool").when(F.col("m").isNull(), "non_dict_record").when(lacking, F.col("reason"))
    return made.select("tool", "record_no", "fact_type", "fields", F.sha1(F.concat_ws("::", "fact_type", F.to_json(F.array_sort(F.map_entries("fields"))))).alias("fact_id"), why.alias("drop_reason"), "indexes")


def ledger(compiled: DataFrame) -> DataFrame:
    """(tool, record_count, compiled_count, dropped_count, dropped) by tool; ``dropped`` has the counts by reason."""
    each = compiled.groupBy("tool", "drop_reason").agg(F.count(F.lit(1)).alias("n"))
    some = F.collect_list(F.when(F.col("drop_reason").isNotNull(), F.struct("drop_reason", "n")))
    return each.groupBy("tool").agg(F.sum("n").alias("record_count"), F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0)).alias("compiled_count"), F.coalesce(F.sum(F.when(F.col("drop_reason").isNotNull(), F.col("n"))), F.lit(0)).alias("dropped_count"), F.map_from_entries(some).alias("dropped"))


def indexed(compiled: DataFrame) -> DataFrame:
    """(index_name, key, fact_id) of the facts, keys in lower case, each once."""
    facts = compiled.where("drop_reason IS NULL").select("fact_id", "fields", F.explode("indexes").alias("to"))
    keys = facts.select(F.col("to.index").alias("index_name"), F.lower(F.try_element_at("fields", F.col("to.name"))).alias("key"), "fact_id")
    return keys.where("key IS NOT NULL").distinct()


def script_facts(compiled: DataFrame) -> DataFrame:
    """``compiled`` whose script facts have ``ttp_tags`` and are dropped unless they show a technique, carry decoded text, or speak of a shell and of something it did."""
    text = F.concat_ws(" ", *(F.try_element_at("fields", F.lit(n)) for n in ("command", "decoded_command", "host_application")))
    power = F.col("fact_type") == "powershell_command_fact"
    some = lambda *names: F.exists(F.array(*(F.coalesce(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in names)), lambda v: ~v.isin("", "[]"))
    made = computed(compiled, _tags=F.when(power, tags.shell_tags(text)).otherwise(F.array().cast("array<string>")), _context=power & text.rlike(tags.SHELL_CONTEXT))
    sure = F.size(F.filter("_tags", lambda t: t != "long_base64_blob")) > 0
    keep = sure | some("decoded_command") | (F.col("_context") & ((F.size("_tags") > 0) | some("suspicious_markers", "urls", "domains", "ips", "paths")))
    noted = F.when(power & F.col("fields").isNotNull(), F.map_concat("fields", F.create_map(F.lit("ttp_tags"), F.array_join("_tags", ",")))).otherwise(F.col("fields"))
    return made.withColumns({"fields": noted, "drop_reason": F.when(power & F.col("drop_reason").isNull() & ~keep, "no_powershell_signal_noise").otherwise(F.col("drop_reason"))}).drop("_tags", "_context")


def unbacked_modules(compiled: DataFrame) -> DataFrame:
    """``compiled`` whose module rows are dropped where the module has a file or is in no list of loaded ones."""
    low = lambda n: F.lower(F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")))
    odd = low("mapped_path").isin("", "none", "n/a") & (low("in_load").isin("true", "1") | low("in_mem").isin("true", "1"))
    return compiled.withColumn("drop_reason", F.when((F.col("tool") == "vol_ldrmodules") & F.col("drop_reason").isNull() & ~odd, "ldrmodules_backed_or_not_loaded").otherwise(F.col("drop_reason")))


def of_process(records: DataFrame, pid: int | str) -> DataFrame:
    """Records (record as JSON text) whose process number is ``pid``, whatever the case of the column's name."""
    m = F.from_json("record", "map<string,string>")
    own = F.exists(F.map_entries(m), lambda e: F.lower(e["key"]).isin("pid", "process id") & (F.trim(e["value"]) == str(pid)))
    return records.where(F.coalesce(own, F.lit(False)))


def in_window(rows: DataFrame, columns: list[str], start: str, end: str) -> DataFrame:
    """Rows one of whose times, by its date, lies between ``start`` and ``end``, both included."""
    return rows.where(F.exists(F.array(*(F.substring(F.col(c).cast("string"), 1, 10) for c in columns)), lambda d: d.between(start, end)))


def timestomped() -> Column:
    """Whether a file's own times were set: the flag of its source, or times without fractions."""
    low = lambda n: F.lower(F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")))
    return low("si_lt_fn").isin("true", "1") | low("usec_zeros").isin("true", "1")
