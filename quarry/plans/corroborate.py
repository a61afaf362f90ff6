"""Ancestry, users, corroboration and confidence over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import corroborate as C

from .catalogue import query
from .scalars import pick, sql_list

_NAMES = ["svchost.exe", "lsass.exe", "csrss.exe", "services.exe", "winlogon.exe", "cmd.exe", "SMSS.exe"]
_PROC = f"(SELECT o_custkey AS pid, o_custkey // 2 AS ppid, {sql_list(_NAMES)}[o_orderkey % 7 + 1] AS name, o_orderdate AS created, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS ended, o_orderkey AS ordinal FROM orders)"


@query(f"""WITH p AS {_PROC}, l AS (SELECT pid AS ppid, arg_max(name, ordinal) AS parent, max_by({{'c': created, 'e': ended}}, ordinal) AS x FROM p GROUP BY 1), o AS (SELECT pid, arg_max(created, ordinal) AS c_created FROM p GROUP BY 1),
    m AS (SELECT p.pid, p.name, p.ppid, l.parent, x.c AS pc, x.e AS pe, c_created, CASE WHEN lower(p.name) IN ('lsass.exe', 'services.exe') THEN ['winlogon.exe'] WHEN lower(p.name) = 'svchost.exe' THEN ['services.exe'] WHEN lower(p.name) IN ('csrss.exe', 'winlogon.exe') THEN ['smss.exe'] WHEN lower(p.name) = 'smss.exe' THEN ['system', 'registry', 'smss.exe'] END AS expected FROM p JOIN l USING (ppid) JOIN o ON o.pid = p.pid)
    SELECT pid, name, ppid, parent, array_to_string(expected, ',') AS expected, CASE WHEN pc < c_created THEN 'parent_older_than_child' ELSE 'parent_create_time_equal_unverifiable' END AS reason FROM m
    WHERE expected IS NOT NULL AND NOT list_contains(expected, lower(parent)) AND NOT pc > c_created AND NOT coalesce(pe < c_created, false) AND NOT (pc = c_created AND list_contains(expected, 'smss.exe'))""")
def ancestry_violations(t):
    o = t("orders")
    made = o.select(F.col("o_custkey").alias("pid"), F.floor(F.col("o_custkey") / 2).alias("ppid"), pick(_NAMES, "o_orderkey").alias("name"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.when(F.col("o_orderkey") % 5 == 0, F.expr("cast(o_orderdate as timestamp_ntz) + INTERVAL 40 DAY")).alias("ended"), F.col("o_orderkey").alias("ordinal"))
    return C.odd_parents(made).select("pid", "name", "ppid", "parent", F.array_join("expected", ",").alias("expected"), "reason")


@query("""SELECT o_custkey AS pid, count(*) AS n FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'a.exe' WHEN 1 THEN 'b.exe' ELSE 'c' END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '' END AS e FROM orders) WHERE name LIKE '%.exe' AND coalesce(e, '') = '' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1""")
def hidden_processes(t):
    scanned = t("orders").select(F.col("o_custkey").alias("pid"), pick(["a.exe", "b.exe", "c"], "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "N/A").when(F.col("o_orderkey") % 4 == 1, "").alias("exit_time"))
    listed = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("pid"))
    return C.hidden(listed, scanned).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


_TOOLS = ["vol_pstree", "get_amcache", "parse_event_logs", "run_mftecmd", "run_lecmd"]
_FACT = f"(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'process_fact' ELSE 'file_execution_fact' END AS fact_type, {sql_list(_TOOLS)}[p_partkey % 5 + 1] AS tool, p_size AS f, p_partkey % 3 AS how FROM part)"


@query(f"""WITH hits AS (SELECT DISTINCT c_custkey, fact_type, tool FROM customer JOIN {_FACT} ON c_custkey % 60 = f AND (how < 2 OR c_custkey % 2 = 0)),
    g AS (SELECT c_custkey, list_sort(list(DISTINCT tool)) AS found, list_sort(list(DISTINCT fact_type)) AS families FROM hits GROUP BY 1),
    k AS (SELECT c_custkey AS finding_id, list_filter(found, lambda t: t <> 'vol_pstree') AS new_tools, families, list_sort(list_distinct(list_transform(list_append(found, 'vol_pstree'), lambda t: CASE t WHEN 'vol_pstree' THEN 'M' WHEN 'get_amcache' THEN 'A' WHEN 'parse_event_logs' THEN 'E' WHEN 'run_mftecmd' THEN 'T' ELSE 'D' END))) AS kinds FROM g)
    SELECT finding_id, array_to_string(new_tools, ',') AS new_tools, array_to_string(families, ',') AS families, array_to_string(kinds, ',') AS kinds FROM k WHERE len(new_tools) > 0 AND len(kinds) >= 3""")
def cross_artifact_corroboration(t):
    k = F.col("c_custkey")
    file = F.concat(F.lit("my file"), (k % 60).cast("string"), F.lit(".exe"))
    hashes = F.when(k % 2 == 0, F.array(F.sha1((k % 60).cast("string")))).otherwise(F.array().cast("array<string>"))
    findings = t("customer").select(k.alias("finding_id"), F.array(F.concat(F.lit("C:\\X\\"), file)).alias("paths"), hashes.alias("hashes"), F.array().cast("array<string>").alias("services"), F.array(F.lit("vol_pstree")).alias("source_tools"))
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    facts = t("part").select(
        F.when(p % 4 == 0, "process_fact").otherwise("file_execution_fact").alias("fact_type"), pick(_TOOLS, "p_partkey").alias("source_tool"), F.when(p % 3 == 0, F.concat(F.lit("c:/x/MY FILE"), size, F.lit(".exe"))).alias("path"), F.when(p % 3 == 2, F.sha1(size)).alias("hash"), F.lit("").alias("service"),
        F.when(p % 3 == 1, F.concat(F.lit('started "D:\\tmp\\my file'), size, F.lit('.EXE", ok'))).alias("text"))
    found = C.corroborated(findings, facts)
    return found.select("finding_id", *(F.array_join(c, ",").alias(c) for c in ("new_tools", "families", "kinds")))


_SID = "CASE o_orderkey % 3 WHEN 0 THEN 'S-1-5-21-1-2-3-1001' WHEN 1 THEN 'S-1-5-18' ELSE 'S-1-5-21-9' END"
_NAME = "CASE o_orderkey % 5 WHEN 0 THEN 'DOM\\' || o_orderpriority WHEN 1 THEN 'HOST$' ELSE 'u' || (o_orderkey % 4) END"
_USER = "CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' ELSE 'u' || (o_orderkey % 4) END"


def _sids(t):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("DOM\\"), F.col("o_orderpriority"))).when(k % 5 == 1, "HOST$").otherwise(F.concat(F.lit("u"), (k % 4).cast("string")))
    return t("orders").select(F.col("o_custkey").alias("pid"), F.concat(F.lit(" P"), (F.col("o_custkey") % 50).cast("string"), F.lit(".exe")).alias("process"), pick(["S-1-5-21-1-2-3-1001", "S-1-5-18", "S-1-5-21-9"], "o_orderkey").alias("sid"), name.alias("name"), k.alias("ordinal"))


@query(f"SELECT o_custkey AS pid, arg_min({_USER}, o_orderkey) AS user FROM orders WHERE o_orderkey % 3 <> 1 AND {_USER} <> '' GROUP BY 1")
def pid_user_map(t):
    return C.pid_users(_sids(t))


@query(f"""SELECT process, coalesce(u, '') AS user, CASE WHEN u IS NULL THEN 'system_service' ELSE 'user' END AS context FROM (SELECT 'p' || (o_custkey % 50) || '.exe' AS process, arg_min({_USER}, o_orderkey) FILTER (o_orderkey % 3 <> 1 AND {_USER} <> '') AS u FROM orders GROUP BY 1)""")
def process_user_context(t):
    return C.process_contexts(_sids(t))


@query(f"SELECT 'p' || (o_custkey % 50) || '.exe' AS image, arg_min({_USER}, o_orderkey) AS user FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderkey % 2 = 0 AND {_USER} <> '' GROUP BY 1")
def launch_users(t):
    events = _sids(t).select(F.when(F.col("ordinal") % 2 == 0, "4688").otherwise("4689").alias("event_id"), "sid", F.col("name").alias("user"), F.concat(F.lit("C:\\Bin\\"), F.trim("process")).alias("image"), "ordinal")
    return C.launchers(events)


@query(f"""SELECT lower({_USER}) AS user, CAST(o_orderkey % 12 AS INTEGER) AS logon_type, strftime(min(o_orderdate), '%Y-%m-%d') AS first_time, arg_min('10.0.0.' || (o_custkey % 9), o_orderdate) FILTER (o_custkey % 9 > 4) IS NOT NULL AS has_ip, count(*) AS n FROM orders
    WHERE o_orderkey % 3 <> 1 AND o_orderkey % 12 IN (2, 7, 10, 11) AND o_orderkey % 7 <> 0 AND {_USER} <> '' GROUP BY 1, 2""")
def human_logons(t):
    rows = t("orders").select("o_orderkey", "o_orderdate", "o_custkey").join(_sids(t).select(F.col("ordinal").alias("o_orderkey"), "sid", F.col("name").alias("user")), "o_orderkey")
    events = rows.select(F.when(F.col("o_orderkey") % 7 == 0, "4634").otherwise("4624").alias("event_id"), "sid", "user", (F.col("o_orderkey") % 12).cast("int").alias("logon_type"), F.col("o_orderdate").alias("at"), F.when(F.col("o_custkey") % 9 > 4, F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 9).cast("string"))).otherwise("127.0.0.1").alias("ip"))
    return C.human_logons(events).select("user", "logon_type", F.date_format("first_time", "yyyy-MM-dd").alias("first_time"), F.col("source_ip").isNotNull().alias("has_ip"), "n")


@query("""SELECT CASE WHEN a.s_name IS NOT NULL THEN a.s_name WHEN ps <> 0 THEN 'AppId:' || ps ELSE '' END AS application, coalesce(u.s_name, '') AS user, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM (SELECT l_suppkey * (l_linenumber % 3) AS ps, l_partkey AS us, l_linenumber FROM lineitem) LEFT JOIN supplier a ON a.s_suppkey = ps LEFT JOIN supplier u ON u.s_suppkey = us GROUP BY 1, 2""")
def usage_names(t):
    usage = t("lineitem").select((F.col("l_suppkey") * (F.col("l_linenumber") % 3)).alias("app_id"), F.col("l_partkey").alias("user_id"), F.col("l_linenumber").alias("bytes"))
    named = C.usage_named(usage, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return named.groupBy("application", "user").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query("""WITH u AS (SELECT c_custkey, c_nationkey AS domain, CASE c_custkey % 3 WHEN 0 THEN 'NAME' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || 'X~' || (c_custkey % 2 + 1) ELSE 'name' || chr(CAST(97 + c_custkey % 26 AS INTEGER)) || '.x.' || c_custkey END AS name FROM customer),
    l AS (SELECT domain, upper(substr(replace(name, '.', ''), 1, 6)) AS pre, count(*) AS n, min(name) AS long FROM u WHERE NOT contains(name, '~') GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT c_custkey, coalesce(long, name) AS canonical FROM u LEFT JOIN l ON l.domain = u.domain AND name LIKE '%~1' AND pre = split_part(name, '~', 1)""")
def short_name_merge(t):
    k = F.col("c_custkey")
    letter = lambda base: F.chr((k % 26 + base).cast("int"))
    name = F.when(k % 3 == 0, F.concat(F.lit("NAME"), letter(65), F.lit("X~"), (k % 2 + 1).cast("string"))).otherwise(F.concat(F.lit("name"), letter(97), F.lit(".x."), k.cast("string")))
    return C.short_names(t("customer").select("c_custkey", F.col("c_nationkey").alias("domain"), name.alias("name"))).select("c_custkey", "canonical")


_RISK = "25 * least(b, 3) + 15 * least(p, 3) + 10 * least(c, 3) + 5 * least(s, 5) + CASE WHEN f > 0 AND l > 0 THEN 8 ELSE 0 END + CASE WHEN n >= 5000 THEN 50 WHEN n >= 1000 THEN 30 WHEN n >= 100 THEN 15 ELSE 0 END + CASE WHEN n >= 100 AND n = m AND m2 > 0 AND m >= 2 * m2 THEN 20 ELSE 0 END + CASE WHEN u % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN u % 4 = 0 THEN 20 ELSE 0 END"
_USERS = "(SELECT user_id AS u, count(*) FILTER (event_type = 'error') % 5 AS b, count(*) FILTER (event_type = 'purchase') % 5 AS p, count(*) FILTER (event_type = 'signup') % 4 AS c, count(*) % 7 AS s, count(*) FILTER (event_type = 'view') % 2 AS f, count(*) FILTER (event_type = 'click') AS l, count(*) * (user_id % 3) * 40 AS n FROM events GROUP BY 1)"


@query(f"""SELECT u AS user, CAST({_RISK} AS BIGINT) AS risk, CASE WHEN {_RISK} >= 86 THEN 'CRITICAL' WHEN {_RISK} >= 61 THEN 'HIGH' WHEN {_RISK} >= 31 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM {_USERS}, (SELECT max(n) AS m, min(n) AS m2 FROM (SELECT n FROM {_USERS} ORDER BY n DESC LIMIT 2))""")
def user_risk_tiers(t):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    users = t("events").groupBy(F.col("user_id").alias("user")).agg((of("error") % 5).alias("n_bad_pids"), (of("purchase") % 5).alias("n_privileged"), (of("signup") % 4).alias("n_credential"), (F.count(F.lit(1)) % 7).alias("n_staged"), (of("view") % 2).alias("n_failed"), of("click").alias("n_logons"), F.count(F.lit(1)).alias("n"))
    users = users.select("*", (F.col("n") * (F.col("user") % 3) * 40).alias("n_scripts"), (F.col("user") % 5 == 0).alias("entry_role"), (F.col("user") % 4 == 0).alias("persistence_role"))
    return C.user_risk(users).select("user", "risk", "tier")


@query("SELECT o_custkey AS user, count(DISTINCT l_partkey) AS n_assets FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20")
def data_collections(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("path"))
    return C.collections(t("orders").select("o_orderkey", F.col("o_custkey").alias("user")).join(lines, "o_orderkey"))


_TEXTS = ["Mimikatz run", "whoami seen", "a listening port", "nothing", "pwdumpx.exe", "wmi then powershell"]
_LISTS = [["vol_pstree"], ["vol_pstree", "get_amcache"], ["vol_malfind", "vol_ldrmodules", "vol_threads"], ["vol_netscan", "run_lecmd", "vol_getsids"], ["run_yara"], ["ghost_tool", "parse_registry"]]
_SAID = ["HIGH", "MEDIUM", "LOW", "SPECULATIVE"]


@query(f"""SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 17 = 0 THEN 'LOW' WHEN lift THEN 'HIGH' WHEN list_position(lv, said) > list_position(lv, top) THEN top ELSE said END AS confidence FROM (SELECT *, ['UNRESOLVED', 'SPECULATIVE', 'LOW', 'MEDIUM', 'HIGH'] AS lv,
    CASE WHEN n = 3 THEN CASE WHEN trust <> 'full' THEN 'MEDIUM' ELSE 'HIGH' END WHEN n >= 1 THEN 'MEDIUM' ELSE 'SPECULATIVE' END AS top, i = 1 OR (i = 2 AND mem AND trust = 'full') AS lift FROM (SELECT o_orderkey, o_custkey % 6 AS i, {sql_list(_SAID)}[o_orderkey % 4 + 1] AS said, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'degraded' END AS trust, o_orderkey % 2 = 0 AS mem, [1, 2, 1, 3, 0, 1][o_custkey % 6 + 1] AS n FROM orders))""")
def confidence_calibration(t):
    lists = F.array(*(F.array(*map(F.lit, x)) for x in _LISTS))
    rows = F.create_map(*(x for tools in _LISTS for tool in tools for x in (F.lit(tool), F.lit(0 if tool == "ghost_tool" else 5)) if tool not in ("vol_pstree", "vol_malfind")), F.lit("vol_pstree"), F.lit(9), F.lit("vol_malfind"), F.lit(9))
    k = F.col("o_orderkey")
    made = t("orders").select(k.alias("finding_id"), pick(_SAID, "o_orderkey").alias("confidence"), F.element_at(lists, (F.col("o_custkey") % 6 + 1).cast("int")).alias("source_tools"), F.array().cast("array<string>").alias("claim_tools"), rows.alias("tool_rows"), (k % 17 == 0).alias("false_positive"), F.when(k % 3 == 0, "full").otherwise("degraded").alias("trust"), (k % 2 == 0).alias("memory_only"))
    return made.select("finding_id", C.calibrated(F.col("trust"), F.col("memory_only")).alias("confidence"))


@query(f"""SELECT o_orderkey AS finding_id, sev AS severity, CASE conf WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'HIGH' THEN CASE WHEN sev IN ('CRITICAL', 'HIGH') THEN sev ELSE 'HIGH' END ELSE 'LOW' END AS clamped FROM (SELECT o_orderkey, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'CRITICAL', 'HIGH'][o_orderkey % 6 + 1] AS sev, {sql_list(_SAID)}[o_custkey % 4 + 1] AS conf FROM orders)""")
def severity_levels(t):
    made = t("orders").select("o_orderkey", pick(_TEXTS, "o_orderkey").alias("text"), pick(_SAID, "o_custkey").alias("conf"))
    rated = made.withColumn("severity", C.severity_of(F.col("text")))
    return rated.select(F.col("o_orderkey").alias("finding_id"), "severity", C.clamped(F.col("severity"), F.col("conf")).alias("clamped"))


@query("SELECT CASE WHEN count(*) = 0 THEN 'degraded' WHEN count(*) FILTER (p_size % 10 = 0) > 5 THEN 'untrusted' WHEN count(*) FILTER (p_size % 10 = 0) > 0 THEN 'degraded' ELSE 'full' END AS trust, count(*) FILTER (p_size % 10 = 0) AS hooked FROM part")
def kernel_trust(t):
    return C.kernel_trust(t("part").select(F.when(F.col("p_size") % 10 == 0, "Other.sys").when(F.col("p_size") % 3 == 0, "NTOSKRNL.exe").when(F.col("p_size") % 3 == 1, "win32kfull").alias("module")))


@query("""SELECT 'tool' || n_nationkey AS tool, CASE WHEN n_nationkey % 5 = 0 THEN 'not_run' WHEN n_nationkey % 5 = 1 THEN 'failed' ELSE 'no_records' END AS reason FROM nation WHERE n_nationkey % 5 < 3""")
def silent_tools(t):
    tool, k = F.concat(F.lit("tool"), F.col("n_nationkey").cast("string")).alias("tool"), F.col("n_nationkey")
    outputs = t("nation").where("n_nationkey % 5 > 0").select(tool, F.when(k % 5 < 3, 0).otherwise(4).alias("record_count"), F.when(k % 5 == 1, "timeout").alias("error"))
    return C.silent_tools(t("nation").select(tool), outputs)


@query("""SELECT c_custkey AS finding_id, array_to_string(list_filter(['t' || c_nationkey, 'x', 't' || (c_custkey % 25)], lambda t: t <> 'x' AND CAST(substr(t, 2) AS INTEGER) % 3 <> 0), ',') AS source_tools, array_to_string(list_filter(['t' || c_nationkey, 'x', 't' || (c_custkey % 25)], lambda t: t = 'x' OR CAST(replace(substr(t, 2), 'x', '0') AS INTEGER) % 3 = 0), ',') AS dropped FROM (SELECT c_custkey, c_nationkey FROM customer)""".replace("CAST(substr(t, 2) AS INTEGER)", "TRY_CAST(substr(t, 2) AS INTEGER)").replace("CAST(replace(substr(t, 2), 'x', '0') AS INTEGER)", "TRY_CAST(substr(t, 2) AS INTEGER)"))
def tool_hits(t):
    text = lambda c: F.concat(F.lit("t"), c.cast("string"))
    findings = t("customer").select(F.col("c_custkey").alias("finding_id"), F.array(text(F.col("c_nationkey")), F.lit("x"), text(F.col("c_custkey") % 25)).alias("source_tools"))
    hits = t("nation").select(text(F.col("n_nationkey")).alias("tool"), (F.col("n_nationkey") % 3).alias("n"))
    return C.hit_tools(findings, hits).select("finding_id", *(F.array_join(c, ",").alias(c) for c in ("source_tools", "dropped")))


@query("""WITH e AS (SELECT list('z' || c_custkey) AS known FROM customer WHERE c_custkey % 9 = 0),
    c AS (SELECT p_partkey AS id, p_size AS score, list_distinct(['b' || p_brand || (p_partkey % 30), 'z' || (p_partkey % 211)]) AS tokens FROM part),
    o AS (SELECT list({'ids': [id], 'tokens': tokens} ORDER BY score DESC, id) AS cs FROM c, e WHERE NOT list_has_any(tokens, known))
    SELECT unnest(list_reduce(cs, lambda a, c: CASE WHEN list_has_any(a.tokens, c.tokens) THEN a ELSE {'ids': list_concat(a.ids, c.ids), 'tokens': list_concat(a.tokens, c.tokens)} END).ids) AS candidate_id FROM o""")
def fresh_candidates(t):
    k = F.col("p_partkey")
    tokens = F.array(F.concat(F.lit("b"), F.col("p_brand"), (k % 30).cast("string")), F.concat(F.lit("z"), (k % 211).cast("string")))
    found = t("part").select(k.alias("candidate_id"), tokens.alias("tokens"), F.col("p_size").alias("score"))
    return C.fresh(found, t("customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("z"), F.col("c_custkey").cast("string")).alias("token"))).select("candidate_id")
