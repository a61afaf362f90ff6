"""Claims as told and as checks expect them."""

from quarry.operators import claim_forms

CASES = [
    ({"type": "process", "pid": " 7", "process_name": "C:\\W\\a.exe"}, "", {"type": "pid", "pid": " 7", "process": "a.exe"}),
    ({"type": "pid", "pid": "seven"}, "", None),
    ({"type": "file", "hash": "ab", "path": "C:/x/y.exe"}, "", {"type": "hash", "sha1": "ab", "filename": "y.exe", "value": "C:/x/y.exe"}),
    ({"type": "raw", "value": "Event ID: 4688 seen"}, "", {"type": "event_log", "value": "Event ID: 4688 seen", "event_id": "4688"}),
    ({"type": "raw", "value": "C:/event 12/x"}, "", {"type": "path", "value": "C:/event 12/x"}),
    ({"type": "path", "event_id": "7045"}, "", {"type": "event_log", "event_id": "7045", "value": "Event 7045"}),
    ({"type": "path", "registry_path": " HKLM/x "}, "", {"type": "path", "registry_path": " HKLM/x ", "value": "HKLM/x"}),
    ({"type": "artifact", "artifact": "evil.exe privilege SeDebugPrivilege disabled"}, "", {"type": "process_privilege_enabled", "artifact": "evil.exe privilege SeDebugPrivilege disabled", "value": "evil.exe privilege SeDebugPrivilege disabled", "privilege_name": "SeDebugPrivilege", "process": "evil.exe", "enabled": "false"}),
    ({"type": "process_privilege", "value": "Outlook with SeTcbPrivilege"}, "", {"type": "process_privilege", "value": "Outlook with SeTcbPrivilege", "process": "Outlook"}),
    ({"type": "path", "value": "network peer 203.0.113.9"}, "", {"type": "connection", "value": "network peer 203.0.113.9", "foreign_addr": "203.0.113.9"}),
    ({"type": "path", "value": "version 1.2.3.4 of it"}, "", {"type": "path", "value": "version 1.2.3.4 of it"}),
    ({"type": "path", "value": "8.8.8.8"}, "", {"type": "connection", "value": "8.8.8.8", "foreign_addr": "8.8.8.8"}),
    ({"type": "path", "value": "Spooler"}, "New SERVICE found", {"type": "service", "value": "Spooler", "service_name": "Spooler", "rescued_from": "bare_token_path"}),
    ({"type": "path", "value": "lsass"}, "hidden in psxview", {"type": "process_exists", "value": "lsass", "process": "lsass", "rescued_from": "bare_token_path"}),
    ({"type": "path", "value": "lsass"}, "nothing", {"type": "path", "value": "lsass"}),
    ({"type": "ip", "remote_ip": "1.1.1.1", "remote_port": "53", "pid": "x", "process_name": "d.exe"}, "", {"type": "connection", "foreign_addr": "1.1.1.1", "foreign_port": "53", "process": "d.exe"}),
    ({"type": "connection", "foreign": "[::1]:8080"}, "", {"type": "connection", "foreign_addr": "[::1]", "foreign_port": "8080"}),
    ({"type": "connection", "foreign": "9.9.9.9:443"}, "", {"type": "connection", "foreign_addr": "9.9.9.9", "foreign_port": "443"}),
    ({"type": "connection", "foreign": "a.example"}, "", {"type": "connection", "foreign_addr": "a.example"}),
    ({"type": "connection", "foreign": "fe80::1", "pid": "4"}, "", {"type": "connection", "pid": "4"}),
    ({"type": "connection", "pid": "0"}, "", None),
    ({"type": "execution", "value": "2024-01-01"}, "", {"type": "timestamp", "timestamp": "2024-01-01"}),
    ({"type": "path", "filename": "x.txt"}, "", {"type": "path", "filename": "x.txt", "value": "x.txt"}),
    ({"pid": "7"}, "", {"pid": "7"}), (None, "", None), ({"type": "service", "service_name": "s"}, "", {"type": "service", "service_name": "s"}),
]


def test_claims_take_their_form(spark):
    df = spark.createDataFrame([(1, i, c, x) for i, (c, x, _) in enumerate(CASES)], "finding_id long, claim_no int, claim map<string,string>, context string")
    got = {r.claim_no: r.claim for r in claim_forms.normalised(df).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert claim_forms.normalised(df.where("false")).count() == 0


def test_actor_and_time(spark):
    from quarry.operators import actors

    rows = [
        (1, "t", None, None, [{"type": "USER", "username": "system", "account": " Ann "}], None, None, ("Ann", "", "Who: Ann")),
        (2, "C:/Users/Public/x", "D:\\users\\bob.k\\y 2024-02-03 10:11", None, [], "2023-01-01T00:00:00Z", "ctx", ("bob.k", "2023-01-01T00:00:00", "Who: bob.k · When: 2023-01-01T00:00:00 UTC")),
        (3, "myusers/eve", None, None, [{"type": "pid", "pid": "9", "first_run": "on 2022-05-06"}], None, None, ("carl", "2022-05-06", "Who: carl · When: 2022-05-06 UTC")),
        (4, "pid=12 and PID: 9", None, None, None, None, "SYSTEM/service context", ("carl", "", "Who: carl")),
        (5, "pid=12", None, None, None, None, "SYSTEM/service context", ("", "", "Who: SYSTEM/service context")),
        (6, None, None, "seen 2021-01-02", None, None, None, ("", "2021-01-02", "When: 2021-01-02 UTC")), (7, None, None, None, None, None, None, ("", "", ""))]
    df = spark.createDataFrame([r[:7] for r in rows], "finding_id long, title string, description string, raw_excerpt string, claims array<map<string,string>>, timestamp string, execution_context string")
    sids = spark.createDataFrame([(9, "S-1-5-18", "SYSTEM", 1), (9, "S-1-5-21-1-2-3-1001", "HOST\\carl", 2), (9, "S-1-5-21-1-2-3-1002", "dan", 3), (12, "S-1-5-21-1-2-3-513", "Users", 4)], "pid long, sid string, name string, ordinal long")
    assert {r.finding_id: (r.actor, r.at, r.label) for r in actors.labelled(df, sids).collect()} == {r[0]: r[7] for r in rows}
    assert actors.labelled(df.where("false"), sids).count() == 0


def test_consensus_of_members(spark):
    from quarry.operators import consensus

    pid = lambda *ps: [{"type": "pid", "pid": p} for p in ps]
    rows = [(1, "a", 0, 0, pid("7", "8"), None, "t"), (2, "b", 1, 0, pid("8"), None, "t"), (3, "b", 1, 1, [], "Art", "Title"), (4, "a", 0, 1, [], "art", "title "), (5, "c", 2, 0, None, None, None)]
    df = spark.createDataFrame([(*r[:4], r[4] or [], *r[5:]) for r in rows], "finding_id long, member string, member_no int, finding_no int, claims array<map<string,string>>, artifact string, title string")
    found = consensus.marked(df)
    assert {(r.fp, r.finding_id, r.survivor_from, tuple(r.discovered_by), r.unique_to, r.n) for r in consensus.merged(found).collect()} == {
        ("pid:7", 1, "a", ("a",), "a", 1), ("pid:8", 1, "a", ("a", "b"), None, 2), ("desc:art|title", 4, "a", ("a", "b"), None, 2), ("uid:5", 5, "c", ("c",), "c", 1)}
    assert {(r.finding_id, r.member, r.survivor_from) for r in consensus.dropped(found).collect()} == {(2, "b", "a"), (3, "b", "a")}
    assert {tuple(r) for r in consensus.members(df, found).collect()} == {("a", 2, 3, 1), ("b", 2, 0, 0), ("c", 1, 1, 1)}


def test_encryption_burst(spark):
    from quarry.operators import entities

    def found(files):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(files)], "id long, path string")
        return [(r.extension, r.n_files, r.original_types, r.ids) for r in entities.encryption_burst(df, "path", "id", kept=2).collect()]

    burst = [f"C:\\d\\f{i}.{e}.LOCKED" for i, e in enumerate(["docx", "xlsx", "pdf", "pdf"])]
    assert found([*burst, "a.docx.zip", "b.exe.locked", "c.locked", None, "d.docx.too-odd"]) == [("locked", 4, ["docx", "pdf", "xlsx"], [0, 1])]
    assert found([b.replace("pdf", "docx") for b in burst]) == [] and found([None]) == []
    # four groups of like size: none stands out
    assert found([f"f.{e}.{x}" for x in ("aa", "bb", "cc", "dd") for e in ("docx", "xlsx", "pdf")]) == []
    many = [f"f.{e}.{x}" for x in "abcdefgh" for e in ("docx", "xlsx", "pdf")]
    assert found([*many, *burst * 9])[0][:2] == ("locked", 36)
