"""Claims of every kind against a handful of facts, with the verdicts that they must have."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import claims, corroborate, disposition, facts, reconcile
from quarry.plans import catalogue

FACTS = [
    ("p0", "process_fact", {"pid": "5", "process_name": "only.exe"}),
    ("p1", "process_fact", {"pid": "7", "process_name": "iCloudPhotos.e", "parent_pid": "1"}), ("p2", "process_fact", {"pid": "9", "process_name": "a.exe"}), ("p3", "process_fact", {"pid": "9", "process_name": "b.exe"}),
    ("n1", "network_connection_fact", {"pid": "7", "owner": "iCloudPhotos.exe", "dst_ip": "8.8.4.4", "dst_port": "443"}), ("n2", "network_connection_fact", {"dst_ip": "9.9.9.9", "dst_port": "53"}),
    ("x1", "file_execution_fact", {"sha1": "ab" * 20, "path": "C:\\Tools\\run.exe"}), ("c1", "process_cmdline_fact", {"pid": "7", "process_name": "icloudphotos.exe", "cmdline": "icloud  /Start"}), ("c2", "process_cmdline_fact", {"pid": "8", "cmdline": ""}),
    ("d1", "dll_load_fact", {"pid": "7", "dll_name": "x.dll", "path": "C:/W/x.dll"}), ("v1", "privilege_fact", {"pid": "7", "privilege": "SeDebugPrivilege", "attributes": "Present"}), ("v2", "privilege_fact", {"pid": "8", "privilege": "SeDebugPrivilege"}),
    ("s1", "sid_fact", {"pid": "7", "sid": "S-1-5-18", "account": "NT AUTHORITY\\SYSTEM"}), ("w1", "service_fact", {"service_name": "Spooler", "state": "Running"}), ("t1", "scheduled_task_fact", {"task_name": "Updater", "actions": "cmd /c run.exe"}),
    ("e1", "event_log_fact", {"event_id": "7045", "message": "Service evil installed"}), ("u1", "srum_usage_fact", {"application": "C:\\Tools\\run.exe", "bytes_total": "5000", "user": "Ann"}), ("k1", "powershell_command_fact", {"ttp_tag": "download_cradle_web", "user": "Ann"}),
    ("m1", "environment_variable_fact", {"pid": "7", "process_name": "icloudphotos.exe", "variable": "PATH", "value": "C:\\Bin"}), ("r1", "rdp_artifact_fact", {"host": "srv1"}), ("i1", "ssdt_integrity_fact", {"index": "3", "module": "odd.sys"}),
    ("q1", "process_relationship_fact", {"pid": "7", "parent_pid": "1"}), ("q2", "process_relationship_fact", {"pid": "70", "parent_pid": "1"}),
]
CLAIMS = [
    ({"type": "pid", "pid": "7", "process": "icloudphotos.exe"}, "MATCH"), ({"type": "pid", "pid": "7", "process": "cmd.exe"}, "MATCH"), ({"type": "pid", "pid": "5", "process": "cmd.exe"}, "MISMATCH"), ({"type": "pid", "pid": "9", "process": "c.exe"}, "MATCH"), ({"type": "pid", "pid": "99", "process": "c.exe"}, None), ({"type": "pid", "pid": "bad"}, None),
    ({"type": "process_exists", "pid": "9"}, "MATCH"), ({"type": "process_exists", "process": "A.EXE"}, "MATCH"), ({"type": "process_exists", "process": "zzz.exe"}, None), ({"type": "child_process", "child_pid": "7", "parent_pid": "1"}, "MATCH"), ({"type": "child_process", "child_pid": "7", "parent_pid": "2"}, "MISMATCH"),
    ({"type": "connection", "pid": "7", "foreign_addr": "8.8.4.4", "foreign_port": "443"}, "MATCH"), ({"type": "connection", "pid": "7", "foreign_addr": "8.8.4.4", "process": "cmd.exe"}, "MISMATCH"), ({"type": "connection", "foreign_addr": "9.9.9.9", "foreign_port": "80"}, "MISMATCH"), ({"type": "connection", "foreign_addr": "1.2.3.4"}, None),
    ({"type": "hash", "sha1": "AB" * 20, "filename": "run.exe"}, "MATCH"), ({"type": "hash", "sha1": "AB" * 20, "filename": "other.exe"}, "MISMATCH"), ({"type": "path", "value": "d:\\tools\\RUN.exe"}, "MATCH"), ({"type": "artifact", "artifact": "spooler"}, "MATCH"), ({"type": "raw", "value": "nowhere"}, None),
    ({"type": "process_cmdline", "pid": "7", "cmdline": "ICLOUD /start"}, "MATCH"), ({"type": "process_cmdline", "pid": "7", "cmdline": "x"}, "MISMATCH"), ({"type": "process_cmdline_contains", "pid": "7", "contains": "/START", "process": "cmd.exe"}, "MISMATCH"), ({"type": "process_cmdline_empty", "pid": "8"}, "MATCH"), ({"type": "process_cmdline_empty", "pid": "7"}, "MISMATCH"),
    ({"type": "process_dll_loaded", "pid": "7", "path": "c:\\w\\x.dll"}, "MATCH"), ({"type": "dll_loaded", "dll_name": "X.DLL"}, "MATCH"), ({"type": "dll_loaded", "dll_name": "y.dll"}, "MISMATCH"), ({"type": "process_privilege_enabled", "pid": "7", "privilege": "se_debug_privilege"}, "MISMATCH"), ({"type": "process_privilege_enabled", "pid": "8", "privilege": "SeDebugPrivilege"}, None),
    ({"type": "process_privilege", "pid": "7", "privilege": "SeDebugPrivilege"}, "MATCH"), ({"type": "process_privilege", "privilege": "SeDebugPrivilege"}, None), ({"type": "process_account_sid", "pid": "7", "sid": "s-1-5-18", "account": "system"}, "MATCH"), ({"type": "process_account_sid", "pid": "7", "sid": "s-1-5-18", "account": "ann"}, "MISMATCH"),
    ({"type": "service", "service_name": "spooler", "state": "running"}, "MATCH"), ({"type": "service_state", "service_name": "spooler", "state": "stopped"}, "MISMATCH"), ({"type": "service_binary", "service_name": "spooler", "binary": "x.exe"}, None), ({"type": "scheduled_task", "task_name": "updater", "action": "RUN.exe"}, "MATCH"), ({"type": "scheduled_task", "task_name": "updater", "hidden": "true"}, None), ({"type": "scheduled_task", "task_name": "none"}, "MISMATCH"),
    ({"type": "event_log", "event_id": "7045", "contains": "EVIL"}, "MATCH"), ({"type": "event_log", "event_id": "1"}, "MISMATCH"), ({"type": "srum_usage", "application": "RUN.exe", "min_bytes_total": "4000", "user": "ann"}, "MATCH"), ({"type": "srum_usage", "application": "run.exe", "min_bytes_total": "6000"}, "MISMATCH"), ({"type": "srum_usage", "min_bytes_total": "100"}, "MATCH"),
    ({"type": "powershell_command", "ttp_tag": "download_cradle"}, "MATCH"), ({"type": "powershell_command", "ttp_tag": "download"}, "MATCH"), ({"type": "powershell_command", "ttp_tag": "down"}, "MISMATCH"), ({"type": "powershell_command"}, None), ({"type": "decoded_string", "ttp_tag": "decoded_string"}, "MISMATCH"), ({"type": "envvar", "variable": "path", "value": "c:\\bin"}, "MATCH"),
    ({"type": "process_envvar", "pid": "7", "process": "cmd.exe", "variable": "path"}, "MISMATCH"), ({"type": "rdp_artifact", "host": "SRV1"}, "MATCH"), ({"type": "rdp_artifact", "contains": "ab"}, None), ({"type": "kernel_ssdt_entry", "index": "3", "module": "ODD.sys"}, "MATCH"), ({"type": "kernel_ssdt_entry", "status": "x"}, None), ({"type": "wmi_subscription", "consumer": "x1"}, None),
    ({"type": "child_process", "child_pid": "70", "parent_pid": "1"}, None), ({"type": "child_process", "child_pid": "9", "parent_pid": "1"}, None), ({"type": "connection", "pid": "0", "foreign_addr": "9.9.9.9", "foreign_port": "53"}, "MATCH"),
    ({"type": "typed_fact", "fact_type": "sid_fact", "pid": "7"}, "MATCH"), ({"type": "typed_fact", "fact_type": "usb_device_fact", "pid": "7"}, None), ({"type": "unheard of", "pid": "7"}, None), ({"pid": "7"}, None),
]


def tables(spark):
    typed = spark.createDataFrame(FACTS, "fact_id string, fact_type string, fields map<string,string>")
    made = spark.createDataFrame([(1, i, c) for i, (c, _) in enumerate(CLAIMS)], "finding_id long, claim_no int, claim map<string,string>")
    return made, typed


def test_every_kind_of_claim(spark):
    made, typed = tables(spark)
    got = {r.claim_no: r.verdict for r in claims.check(made, typed).collect()}
    assert {i: (c, got[i]) for i, (c, want) in enumerate(CLAIMS) if got[i] != want} == {}
    assert claims.check(made.where("false"), typed).count() == 0
    assert {r.verdict for r in claims.check(made, typed.where("false")).collect()} == {None, "MISMATCH"}


def test_equal_claims_meet_the_facts_once(spark, monkeypatch):
    made, typed = tables(spark)
    many = made.select(F.expr("explode(sequence(1L, 40L))").alias("finding_id"), "claim_no", F.map_from_entries(F.reverse(F.map_entries("claim"))).alias("claim")).union(made)
    judged, asked = [], claims.asked
    monkeypatch.setattr(claims, "asked", lambda some: (judged.append(some.count()), asked(some))[1])
    got = claims.check(many.repartition(5), typed).collect()
    assert len(got) == 41 * len(CLAIMS) and all(r.verdict == CLAIMS[r.claim_no][1] and r.claim == CLAIMS[r.claim_no][0] and r.type == r.claim.get("type") for r in got)
    assert judged == [len({tuple(sorted(c.items())) for c, _ in CLAIMS})]


def test_contents_are_told_apart(spark):
    told = [{"type": "pid", "pid": None, "process": "a"}, {"type": "pid", "pid": "a", "process": None}, {"type": "pid", "pid": "a"}, {"type": "pid", "pid": "a", "process": ""}, {"type": "pid", "pida": ""}, {}]
    made = spark.createDataFrame([(i, c) for i, c in enumerate([*told, None])], "n int, claim map<string,string>").select("n", "claim", claims.content(F.col("claim")).alias("content"))
    assert len({bytes(r.content) for r in made.where("n < 6").collect()}) == len(told) and made.where("n = 6").first().content is None
    assert claims.different(made.select("claim")).count() == len(told)
    checked = claims.check(made.select(F.lit(1).alias("finding_id"), F.col("n").alias("claim_no"), "claim"), tables(spark)[1])
    assert checked.where("verdict IS NULL").count() == len(told) + 1


def claims_checked(spark, sf, monkeypatch, query):
    """(finding_id, claim_no, type) of the claims that a query gives to the check."""
    class Enough(Exception):
        pass

    def check(made, typed):
        raise Enough(made.selectExpr("finding_id", "claim_no", "claim['type'] AS type").collect())

    monkeypatch.setattr(claims, "check", check)
    try:
        catalogue.queries()[query](spark, sf).collect()
    except Enough as found:
        return [tuple(r) for r in found.args[0]]


def test_rescue_checks_what_it_asks_for(spark, sf, monkeypatch):
    checked = claims_checked(spark, sf, monkeypatch, "claim_rescue")
    assert sorted(f for f, _, _ in checked) == list(range(0, 150, 5)) and {t for _, _, t in checked} == {"mystery"}


@pytest.mark.parametrize("query", ["finding_status", "finding_status_strict", "validation_totals"])
def test_status_checks_what_it_asks_for(spark, sf, monkeypatch, query):
    checked = claims_checked(spark, sf, monkeypatch, query)
    kept = lambda f, i, t: f % 5 == 0 if t == "mystery" else i % 12 == f % 12
    assert {f for f, _, _ in checked} == set(range(150)) and all(kept(*r) for r in checked)
    assert len(checked) == len(set(checked)) == sum(f % 5 == 0 for f in range(150)) + sum(i % 12 == f % 12 for f in range(150) for i in range(34))


def test_rescue_of_equal_claims(spark, monkeypatch):
    """Findings that name the same entities have them looked up once, and each takes its first claim's first index."""
    said = [{"type": "what", "path": "nowhere"}, {"type": "pid", "pid": "7", "ip": "9.9.9.9"}, {"type": "what", "value": "spooler"}, {"type": "what", "pid": "7", "ip": "9.9.9.9"}]
    rows = [(f, i, said[i], said[i]["type"], None) for f in range(1, 21) for i in ((0, 1, 2) if f % 2 else (2, 3))] + [(21, 0, said[0], "what", None), (22, 0, None, None, None), (23, 1, said[1], "pid", "MISMATCH")]
    checked = spark.createDataFrame(rows, "finding_id long, claim_no int, claim map<string,string>, type string, verdict string")
    statuses = spark.createDataFrame([(f, "UNRESOLVED") for f in range(1, 24)], "finding_id long, status string")
    judged, asked = [], claims.asked
    monkeypatch.setattr(claims, "asked", lambda some: (judged.append(some.count()), asked(some))[1])
    got = {r.finding_id: (r.index_name, r.key) for r in claims.rescued(checked, statuses, tables(spark)[1]).collect()}
    assert got == {f: ("by_pid", "7") if f % 2 else ("by_service_name", "spooler") for f in range(1, 21)}
    assert judged == [3]


def test_finding_status(spark):
    rows = [(1, "pid", "MATCH"), (1, "path", None), (2, "pid", "MATCH"), (2, "hash", "MISMATCH"), (3, "path", None), (4, "pid", "MATCH"), (4, "what", None), (5, "pid", "MATCH"), (5, "hash", "MATCH"), (5, "service", "MATCH")]
    checked = spark.createDataFrame(rows, "finding_id long, type string, verdict string")
    findings = spark.createDataFrame([(i,) for i in range(1, 7)], "finding_id long")
    of = lambda strict: {r.finding_id: r.status for r in claims.finding_status(findings, checked, strict).collect()}
    assert of(False) == {1: "MATCH", 2: "MISMATCH", 3: "UNRESOLVED", 4: "UNRESOLVED", 5: "MATCH", 6: "UNRESOLVED"}
    assert of(True)[1] == "MISMATCH" and of(True)[5] == "MATCH"


def test_nulls_keep_their_place_in_a_signature(spark):
    rows = spark.createDataFrame([("a", None, "b", "s", 1), ("a", "b", None, "s", 2), ("a", "b", None, "t", 3)], "x string, y string, z string, source string, id long")
    merged = facts.merge(rows, ["x", "y", "z"], "source", "id").collect()
    assert sorted((r.merge_count, r.sources, r.first_record) for r in merged) == [(1, "s", 1), (2, "s,t", 2)]


def test_titles_and_partition(spark):
    titles = [(1, "rundll32.exe (PID 1111) loads a dll", "suspicious_needs_review"), (2, "rundll32.exe (PID 2222) loads a dll", "benign_or_false_positive"), (3, "Two words", "benign_or_false_positive"), (4, "rundll32.exe (PID 9) loads a dll", "confirmed_malicious_atomic")]
    moved = reconcile.reconcile_titles(spark.createDataFrame(titles, "finding_id long, title string, bucket string")).collect()
    assert [(r.finding_id, r.to_bucket) for r in moved] == [(2, "suspicious_needs_review")]
    placed = spark.createDataFrame([(1, "suspicious_needs_review"), (2, "odd"), (2, "benign_or_false_positive"), (7, "benign_or_false_positive")], "finding_id long, bucket string")
    faults = disposition.partition_faults(placed, spark.createDataFrame([(1,), (2,), (3,)], "finding_id long")).collect()
    assert sorted((r.finding_id, r.fault) for r in faults) == [(2, "several"), (2, "unknown_bucket"), (3, "absent"), (7, "orphan")]


def test_parents(spark):
    rows = [(4, 0, "System", 0, 1), (10, 4, "smss.exe", 1, 2), (20, 10, "csrss.exe", 2, 3), (30, 10, "wininit.exe", 2, 4), (40, 30, "lsass.exe", 3, 5), (50, 20, "svchost.exe", 5, 6), (60, 70, "svchost.exe", 5, 7), (70, 30, "services.exe", 9, 8), (80, 999, "lsass.exe", 4, 9)]
    processes = spark.createDataFrame(rows, "pid long, ppid long, name string, created long, ordinal long").selectExpr("pid", "ppid", "name", "timestamp_seconds(created) AS created", "cast(null AS timestamp) AS ended", "ordinal")
    found = corroborate.odd_parents(processes).collect()
    assert [(r.pid, r.parent, r.reason) for r in found] == [(50, "csrss.exe", "parent_older_than_child")]
