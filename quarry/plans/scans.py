"""Compiling, windows, envelopes, trees, indicators and JSON over texts made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import texts as X
from quarry.operators import compilers
from quarry.sources import readers, sinks

from .catalogue import query

#: Tool: (a record as SQL over a supplier, the reason for which every third is dropped).
_TOOLS = {
    "vol_pstree": ("named_struct('PID', if(s_suppkey % 3 = 0, null, s_suppkey), 'PPID', 4, 'ImageFileName', if(s_suppkey % 3 = 0, ' ', s_name))", "missing_pid_or_name"), "vol_netscan": ("named_struct('PID', if(s_suppkey % 3 = 0, null, s_suppkey), 'ForeignPort', 443)", "no_pid_or_endpoint"),
    "run_lecmd": ("named_struct('LocalPath', if(s_suppkey % 3 = 0, '', s_name), 'Arguments', '-x')", "empty_record"), "run_jlecmd": ("named_struct('Path', if(s_suppkey % 3 = 0, '', s_name))", "empty_record"), "run_appcompatcacheparser": ("named_struct('Path', if(s_suppkey % 3 = 0, '', s_name), 'Executed', 'Yes')", "missing_path"),
    "run_yara": ("named_struct('rule', if(s_suppkey % 3 = 0, '', 'r'), 'target', if(s_suppkey % 3 = 0, '', s_name))", "empty_yara_record"), "sleuthkit_fls": ("named_struct('path', if(s_suppkey % 3 = 0, '', s_name))", "fls_path_empty"), "sleuthkit_mactime": ("named_struct('path', if(s_suppkey % 3 = 0, '', s_name))", "mactime_path_empty"),
    "run_mftecmd": ("named_struct('FileName', if(s_suppkey % 3 = 0, '', s_name))", "missing_locator"), "vol_userassist": ("named_struct('Path', if(s_suppkey % 3 = 0, '', s_name))", "no_hive_or_path"), "vol_callbacks": ("named_struct('Type', if(s_suppkey % 3 = 0, '', 'x'))", "no_type_or_module"),
    "parse_rdp_artifacts": ("named_struct('event_id', if(s_suppkey % 3 = 0, '', '1149'))", "empty_record"), "parse_wmi_subscription": ("named_struct('type', if(s_suppkey % 3 = 0, '', '__EventFilter'))", "empty_wmi_record"), "vol_ldrmodules": ("named_struct('Pid', s_suppkey, 'InLoad', if(s_suppkey % 3 = 0, 'False', 'True'), 'MappedPath', '')", "ldrmodules_backed_or_not_loaded"),
    "parse_powershell_transcripts": ("named_struct('command', if(s_suppkey % 3 = 0, s_name, 'Invoke-Mimikatz'))", "no_powershell_signal_noise"),
}


def _records(t):
    one = lambda tool, e: F.struct(F.lit(tool).alias("tool"), F.to_json(F.expr(e)).alias("record"))
    return t("supplier").select(F.col("s_suppkey").alias("record_no"), F.explode(F.array(*(one(k, e) for k, (e, _) in _TOOLS.items()))).alias("r")).select("record_no", "r.*")


@query(" UNION ALL ".join(f"SELECT '{k}' AS tool, count(*) AS record_count, count(*) FILTER (s_suppkey % 3 <> 0) AS compiled_count, count(*) FILTER (s_suppkey % 3 = 0) AS dropped_count, '{why}' AS reason FROM supplier" for k, (_, why) in _TOOLS.items()))
def compile_families(t):
    made = compilers.script_facts(compilers.unbacked_modules(compilers.compile_records(_records(t))))
    return compilers.ledger(made).select("tool", "record_count", "compiled_count", "dropped_count", F.map_keys("dropped")[0].alias("reason"))


@query("SELECT s_suppkey AS record_no, 'vol_ldrmodules' AS tool FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 7, 'vol_netscan' UNION ALL SELECT 7, 'vol_pstree'")
def pid_filter(t):
    return compilers.of_process(_records(t), 7).select("record_no", "tool")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' OR CAST(l_shipdate AS DATE) + 30 BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def date_windows(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("a"), F.date_add(F.col("l_shipdate").cast("date"), 30).cast("string").alias("b"))
    return compilers.in_window(lines, ["a", "b"], "1996-01-01", "1996-03-31").select("l_orderkey", "l_linenumber")


@query("SELECT 't' || n_nationkey AS tool, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE 2 END AS records, CAST(CASE WHEN n_nationkey % 4 = 1 THEN 9 WHEN n_nationkey % 4 = 3 THEN 0 ELSE 2 END AS BIGINT) AS declared, n_nationkey % 4 = 3 AS failed FROM nation")
def envelope_records(t):
    name = F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))
    body = F.element_at(F.array(*map(F.lit, ['"output": [{"a": 1}, {"a": 2}]', '"records": [{"a": 1}, {"a": 2}], "record_count": 9', '"output": {"entries": [1, 2]}', '"output": [], "error": "timeout"'])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    found = readers.envelopes(t("nation").select(F.concat(F.lit('{"tool_name": "'), name, F.lit('", '), body, F.lit("}")).alias("value")))
    return found.select("tool", F.size("records").alias("records"), "declared", ((F.coalesce("error", F.lit("")) != "") & (F.size("records") == 0)).alias("failed"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def tree_flatten(t):
    members = lambda df, by, make: df.groupBy(by).agg(F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(make))), F.lit("]")).alias("inner"))
    node = lambda name, inner: F.concat(F.lit('{"id": "'), name, F.lit('", "__children": '), F.coalesce(inner, F.lit("[]")), F.lit("}"))
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    low = members(t("supplier"), "s_nationkey", node(text("s", "s_suppkey"), F.lit("[]"))).withColumnRenamed("s_nationkey", "n_nationkey")
    middle = members(t("nation").join(low, "n_nationkey", "left"), "n_regionkey", node(text("n", "n_nationkey"), F.col("inner"))).withColumnRenamed("n_regionkey", "r_regionkey")
    trees = t("region").join(middle, "r_regionkey", "left").select(node(text("", "r_regionkey"), F.col("inner")).alias("record"))
    return readers.flat_tree(trees).select(F.get_json_object("record", "$.id").alias("id"), "depth")


_LINE = "'see http://h' || s_suppkey || '.example.com:8081/a.exe, then 10.0.' || (s_suppkey % 300) || '.7:445 and fe80::1:' || (s_suppkey % 9) || ' or mail u' || s_suppkey || '@corp.example.org; also www.site' || s_suppkey || '.net run.exe 1.02.3.4'"


@query(f"""SELECT kind, value, count(*) AS n FROM (SELECT unnest(['url', 'domain', 'port', 'ipv6', 'mail', 'domain', 'port', CASE WHEN s_suppkey % 300 <= 255 THEN 'ipv4' END]) AS kind,
    unnest(['http://h' || s_suppkey || '.example.com:8081/a.exe', 'h' || s_suppkey || '.example.com', '8081', 'fe80::1:' || (s_suppkey % 9), 'u' || s_suppkey || '@corp.example.org', 'www.site' || s_suppkey || '.net', '445', '10.0.' || (s_suppkey % 300) || '.7']) AS value FROM supplier) WHERE kind IS NOT NULL GROUP BY 1, 2""")
def indicator_extract(t):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    line = F.concat(F.lit("see http://h"), text(k), F.lit(".example.com:8081/a.exe, then 10.0."), text(k % 300), F.lit(".7:445 and fe80::1:"), text(k % 9), F.lit(" or mail u"), text(k), F.lit("@corp.example.org; also www.site"), text(k), F.lit(".net run.exe 1.02.3.4"))
    return t("supplier").select(F.explode(X.indicators(line)).alias("i")).select("i.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 2 THEN 2 WHEN s_suppkey % 4 = 3 THEN 0 ELSE 1 END AS items FROM supplier")
def json_repair(t):
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('```json\n{"name": "'), name, F.lit('", "findings": [{"a": 1},]}\n```'))).when(k % 4 == 1, F.concat(F.lit("Here it is: {'name': '"), name, F.lit("', \"findings\": [{'a': {'b': 1}}]} as asked")))
        .when(k % 4 == 2, F.concat(F.lit('{"name": "'), name, F.lit('", "findings": [{"a": 1}, {"b": {"c": 2}}]}'))).otherwise("nothing at all")
    )
    return t("supplier").select("s_suppkey", X.lenient(text, "struct<name:string>")["name"].alias("name"), F.size(X.rescued_items(text)).alias("items"))


@query("""SELECT s_suppkey, path, value FROM (SELECT s_suppkey, unnest(['a', 'b.0', 'b.1.c', 'b.1.d.e']) AS path, unnest([s_name, '1', CAST(s_nationkey AS VARCHAR), 'deep']) AS value FROM supplier)""")
def json_leaves(t):
    value = F.concat(F.lit('{"a": "'), F.col("s_name"), F.lit('", "n": null, "b": [1, {"c": '), F.col("s_nationkey").cast("string"), F.lit(', "d": {"e": "deep"}}]}'))
    return X.leaves(t("supplier").select("s_suppkey", value.alias("v")), "s_suppkey", "v")


@query("SELECT c_custkey, 'from <mail> at <address> in C:\\Users\\<user>\\x' AS text FROM customer")
def redacted_texts(t):
    made = F.concat(F.lit("from u"), F.col("c_custkey").cast("string"), F.lit("@corp.example.org at 10.0.0."), (F.col("c_custkey") % 256).cast("string"), F.lit(" in C:\\Users\\n"), F.col("c_nationkey").cast("string"), F.lit("\\x"))
    return sinks.redacted(t("customer").select("c_custkey", made.alias("text")), ["text"])
