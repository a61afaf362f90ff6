"""Envelopes, ragged CSV, trees, sources that stand for others, digests, state and packages on small files."""

import json

from quarry.operators import compilers
from quarry.sources import readers, sinks


def test_envelopes(spark, tmp_path):
    for i, e in enumerate([{"tool_name": "a", "output": [{"x": 1}, {"x": 2}]}, {"tool_name": "b", "records": [{"x": 3}], "record_count": 9}, {"tool_name": "c", "output": {"events": [{"x": 4}]}}, {"tool_name": "d", "output": [], "error": "timeout"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(e))
    assert sorted((r.tool, r.record_index) for r in readers.json_records(spark, f"file://{tmp_path}").collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    found = readers.envelopes(spark.read.text(f"file://{tmp_path}", wholetext=True))
    assert {r.tool: r.declared for r in found.collect()} == {"a": 2, "b": 9, "c": 1, "d": 0}
    assert [r.tool for r in readers.failed(found).collect()] == ["d"]


def test_ragged_csv_and_tree(spark):
    lines = spark.createDataFrame([("Progress 100",), ("pid,name,args",), ("4,System",), ("7,a.exe,-x, -y",), ("",)], "value string")
    assert sorted(map(tuple, readers.ragged_csv(lines, ["pid", "name", "args"]).collect())) == [("4", "System", ""), ("7", "a.exe", "-x, -y")]
    told = ["Volatility 3 Framework 2, x", "Progress: 1, 2", "", "PID,Name,Args", '4,"Sys, tem",-x', '5,"say ""hi""","a",b', "6", 'C 7,plain "q",z']
    table = readers.ragged_csv(spark.createDataFrame([(x,) for x in told], "value string").coalesce(1))
    assert table.columns == ["PID", "Name", "Args"] and [tuple(r) for r in table.collect()] == [("4", "Sys, tem", "-x"), ("5", 'say "hi"', "a,b"), ("6", "", ""), ("C 7", 'plain "q"', "z")]
    assert readers.ragged_csv(spark.createDataFrame([("no header",)], "value string"), ["a", "b"]).count() == 0
    deep = {"PID": 0}
    for i in range(1, 70):
        deep = {"PID": i, "__children": [deep]}
    assert readers.flat_tree(spark.createDataFrame([(json.dumps(deep),)], "record string")).count() == 70
    tree = {"PID": 1, "__children": [{"PID": 2, "__children": [{"PID": 3, "__children": []}]}, {"PID": 4, "__children": []}]}
    flat = readers.flat_tree(spark.createDataFrame([(json.dumps(tree),)], "record string")).collect()
    assert sorted((json.loads(r.record)["PID"], r.depth) for r in flat) == [("1", 0), ("2", 1), ("3", 2), ("4", 1)]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("run_mftecmd", 1), ("extract_mft_timeline", 2), ("other", 3)], "tool string, n long")
    assert sorted(r.n for r in readers.unique_sources(rows, ["extract_mft_timeline", "run_mftecmd"]).collect()) == [2, 3]
    assert [r.fallback_alias_of for r in readers.first_source(spark, rows.where("false"), rows.limit(1), "vol_pstree").collect()] == ["vol_pstree"]
    assert [r.fallback_alias_of for r in readers.first_source(spark, rows.limit(1), rows, "vol_pstree").collect()] == [None]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.txt").write_text("one")
    before = spark.createDataFrame(readers.digests(spark, f"file://{tmp_path}/in").collect())
    (tmp_path / "in/A.txt").write_text("two")
    (tmp_path / "in/b.txt").write_text("new")
    after = readers.digests(spark, f"file://{tmp_path}/in")
    assert sorted(r.change for r in readers.changed(before, after).collect()) == ["added", "modified"]
    assert readers.matching_name(after, "IN\\a.TXT").count() == 1
    sinks.write_state(rows, f"file://{tmp_path}/state", "facts", before)
    assert sinks.read_state(spark, f"file://{tmp_path}/state", "facts", before).count() == 3
    assert sinks.read_state(spark, f"file://{tmp_path}/state", "facts", after) is None and sinks.read_state(spark, f"file://{tmp_path}/state", "none", before) is None


def test_package(spark, tmp_path):
    df = spark.createDataFrame([("ann@example.org at 10.1.2.3", "C:\\Users\\ann\\x S-1-5-21-1-2-3-500"), ("nothing", None)], "a string, b string")
    manifest = sinks.write_package({"t": df}, f"file://{tmp_path}/p", {"t": ["a", "b"]}).collect()
    assert [(r.name, r.n_rows) for r in manifest] == [("t", 2)]
    written = spark.read.json(f"file://{tmp_path}/p/t")
    assert sorted(r.a for r in written.collect()) == ["<mail> at <address>", "nothing"] and sinks.leaks(written, ["a", "b"]).isEmpty() and sinks.leaks(df, ["a", "b"]).count() == 1


def test_more_families(spark):
    rows = [("vol_ldrmodules", 1, {"Pid": 7, "InLoad": "True", "InMem": "False", "MappedPath": ""}), ("vol_ldrmodules", 2, {"Pid": 7, "InLoad": "True", "MappedPath": "C:\\x.dll"}), ("run_lecmd", 3, {"LocalPath": "C:\\A\\b.exe"}), ("run_jlecmd", 4, {}), ("run_mftecmd", 5, {"FileName": "f", "SI<FN": "True"}), ("parse_rdp_artifacts", 6, {"source_ip": "10.0.0.1"}), ("run_yara", 7, {"rule": "r", "target": "/x"}),
        ("parse_powershell_transcripts", 8, {"command": "Get-ChildItem"}), ("parse_powershell_transcripts", 9, {"command": "Invoke-Mimikatz"}), ("parse_powershell_transcripts", 10, {"command": "powershell dir", "urls": "http://x"})]
    records = spark.createDataFrame([(t, n, json.dumps(r)) for t, n, r in rows], "tool string, record_no long, record string")
    made = compilers.script_facts(compilers.unbacked_modules(compilers.compile_records(records)))
    got = {r.record_no: r for r in made.collect()}
    assert {n: r.drop_reason for n, r in got.items()} == {1: None, 2: "ldrmodules_backed_or_not_loaded", 3: None, 4: "empty_record", 5: None, 6: None, 7: None, 8: "no_powershell_signal_noise", 9: None, 10: None}
    assert got[9].fields["ttp_tags"] == "invoke_mimikatz" and got[3].fields["normalized_path"] == "c:/a/b.exe"
    assert [r.record_no for r in made.where(compilers.timestomped()).collect()] == [5]
    assert sorted(r.record_no for r in compilers.of_process(records, 7).collect()) == [1, 2]
    times = spark.createDataFrame([(1, "2024-01-05T10:00", None), (2, "2023-01-01", "2024-02-01"), (3, None, None)], "id long, a string, b string")
    assert [r.id for r in compilers.in_window(times, ["a", "b"], "2024-01-05", "2024-01-31").collect()] == [1]


def test_rules_that_were_wrong(spark):
    """Both kinds of addresses, tools of memory, techniques on one line, narratives by parents and children, titles that artifacts stand for."""
    import ipaddress

    from pyspark.sql import functions as F

    from quarry.functions import normalise, tags
    from quarry.operators import corroborate, disposition

    ips = ["2607:f8b0:4004:800::200e", "::1", "::", "fe80::1", "fc00::9", "ff02::1", "2001:db8::1", "2002:1::", "::ffff:8.8.8.8", "2a00:1450::8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "8.8.8.8", "10.0.0.1", "::2", "1::2::3", "x", None]
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", normalise.public_by_registry(F.col("ip")).alias("p")).collect()

    def public(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False
        return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_unspecified)

    assert {r.ip: r.p for r in rows} == {x: public(x) for x in ips}
    said = spark.createDataFrame([("powershell -NoP x -w hidden",), ("-NoProfile\n-W Hidden",), ("-w hidden\r-nop",)], "t string").select(tags.shell_tags(F.col("t")).alias("g")).collect()
    assert ["no_profile_hidden" in r.g for r in said] == [True, False, True]
    tools = [(["vol_svcscan", "get_amcache"], "HIGH"), (["vol_ssdt", "get_amcache"], "LOW"), (["vol_envars", "parse_event_logs"], "HIGH")]
    found = spark.createDataFrame([("LOW", t, [], dict.fromkeys(t, 1), False, want) for t, want in tools], "confidence string, source_tools array<string>, claim_tools array<string>, tool_rows map<string,int>, false_positive boolean, want string")
    assert all(r.got == r.want for r in found.select(corroborate.calibrated(F.lit("full"), F.lit(False)).alias("got"), "want").collect())
    claims = [({"parent_process": "a", "child_process": "b"}, {"process": "c"}), ({"parent_pid": "1", "child_pid": "2"}, {"pid": "3"}), ({"process": "A", "image_name": "a"}, {"pid": "x"})]
    stories = spark.createDataFrame([(list(c), "t", "full attack chain", None, None, False, False, []) for c in claims], "claims array<map<string,string>>, title string, description string, finding_type string, evidence_type string, is_synthesis boolean, deterministic boolean, signals array<string>")
    assert [r.s for r in stories.select(disposition.synthesis().alias("s")).collect()] == [["processes"], ["description", "pids"], []]
