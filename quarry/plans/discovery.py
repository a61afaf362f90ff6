"""Emission of candidates, selection in turn, names in texts, frequent items: queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import host
from quarry.operators import accounts, actors, budget, chains, claim_forms, consensus, emission, entities, fact_index, frequent, mentions, routing, selection
from quarry.operators.graph import shared_dir
from quarry.plans.catalogue import query
from quarry.sources import byte_ranges
from quarry.streaming import accumulate

_CANDIDATES = """c AS (SELECT p_partkey AS id, p_size AS score, CASE WHEN p_partkey % 4 = 3 THEN 'ip:10.0.0.' || (p_partkey % 250) ELSE 'path:c:/x/' || replace(p_name, ' ', '_') || '.EXE' END AS entity_key,
        p_type AS behaviour, list_distinct(['k' || (p_partkey * 7919 % 900), p_brand || p_size]) AS tokens, 'tool' || (p_partkey % 5) AS tool FROM part),
    e AS (SELECT list('k' || (s_suppkey * 3)) AS known FROM supplier WHERE s_nationkey < 20),
    o AS (SELECT c.*, list_has_any(tokens, known) AS seen FROM c, e),
    q AS (SELECT list({'ids': [id], 'tokens': tokens} ORDER BY score DESC, entity_key DESC, id) AS cs FROM o WHERE NOT seen),
    s AS (SELECT unnest(list_reduce(cs, lambda a, c: CASE WHEN list_has_any(a.tokens, c.tokens) THEN a ELSE {'ids': list_concat(a.ids, c.ids), 'tokens': list_concat(a.tokens, c.tokens)} END).ids) AS id FROM q),
    t AS (SELECT o.*, first_value(id) OVER (PARTITION BY CASE WHEN entity_key LIKE 'path:%' THEN behaviour || lower(entity_key) ELSE CAST(id AS VARCHAR) END ORDER BY score DESC, entity_key DESC, id) AS representative FROM o JOIN s USING (id))"""


def _candidates(t):
    k = F.col("p_partkey")
    key = F.when(k % 4 == 3, F.concat(F.lit("ip:10.0.0."), (k % 250).cast("string"))).otherwise(F.concat(F.lit("path:c:/x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".EXE")))
    tokens = F.array(F.concat(F.lit("k"), (k * 7919 % 900).cast("string")), F.concat("p_brand", F.col("p_size").cast("string")))
    candidates = t("part").select(k.alias("candidate_id"), F.col("p_size").alias("score"), key.alias("entity_key"), F.col("p_type").alias("behaviour"), tokens.alias("tokens"), F.array(F.concat(F.lit("tool"), (k % 5).cast("string"))).alias("source_tools"))
    return candidates, t("supplier").where("s_nationkey < 20").select(F.concat(F.lit("k"), (F.col("s_suppkey") * 3).cast("string")).alias("token"))


@query(f"""WITH {_CANDIDATES} SELECT o.id AS candidate_id, CASE WHEN o.seen THEN 'known' WHEN representative IS NULL THEN 'beaten' WHEN representative = o.id THEN 'emitted' ELSE 'collapsed' END AS standing, coalesce(representative, -1) AS representative FROM o LEFT JOIN t ON t.id = o.id""")
def candidate_emission(t):
    return emission.emitted(*_candidates(t)).withColumn("representative", F.coalesce("representative", F.lit(-1)))


@query(f"""WITH {_CANDIDATES} SELECT representative AS candidate_id, count(*) AS instances, array_to_string(list_sort(list(DISTINCT tool)), ',') AS source_tools FROM t GROUP BY 1""")
def emitted_representatives(t):
    candidates, existing = _candidates(t)
    found = emission.representatives(candidates, emission.emitted(candidates, existing))
    return found.withColumn("source_tools", F.array_join("source_tools", ","))


_DEALT = """k AS (SELECT *, event_type IN ('error', 'purchase') AS high, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events),
    b AS (SELECT *, r - CASE WHEN high THEN 40 ELSE 0 END AS beyond FROM k),
    p AS (SELECT *, CASE WHEN high AND r = 1 THEN 0 WHEN high AND r <= 40 THEN 1 ELSE 2 END AS phase FROM b WHERE beyond <= 60),
    d AS (SELECT *, row_number() OVER (ORDER BY phase, CASE phase WHEN 0 THEN 0 WHEN 1 THEN (r - 2) // 7 ELSE (beyond - 1) // 7 END, event_type, r) AS position FROM p QUALIFY position <= 250)"""


def _dealt(t):
    return selection.round_robin(t("events"), "event_type", "ts", "event_id", ["error", "purchase"], 40, 60, 7, 250)


@query(f"WITH {_DEALT} SELECT event_id, event_type, phase, position FROM d")
def event_round_robin(t):
    return _dealt(t).select("event_id", "event_type", "phase", "position")


@query(f"""WITH {_DEALT} SELECT event_type AS key, count(*) AS source, count(position) AS kept, count(*) - count(position) AS dropped, event_type IN ('error', 'purchase') AND count(position) = 0 AS starved
    FROM events LEFT JOIN (SELECT event_id, position FROM d) USING (event_id) GROUP BY 1""")
def event_dealt_report(t):
    return selection.dealt_report(t("events"), _dealt(t), "event_type", ["error", "purchase"])


@query("""WITH n AS (SELECT DISTINCT lower(substr(text, CAST(1 + item_id % 11 AS INTEGER), CAST(2 + item_id % 12 AS INTEGER))) AS name FROM benchmark)
    SELECT doc_id, name FROM documents, n WHERE contains(lower(text), name)""")
def name_mentions(t):
    k = F.col("item_id")
    names = t("benchmark").select(F.substring("text", (1 + k % 11).cast("int"), (2 + k % 12).cast("int")).alias("name"))
    return mentions.mentions(t("documents").select(F.col("doc_id").alias("id"), "text"), names).select(F.col("id").alias("doc_id"), "name")


@query("""WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM n QUALIFY rank <= 25""")
def frequent_words(t):
    words = t("documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return frequent.top(words, "lang", "word", 25)


_KEY = [f"(k{i} * {b} + CAST('0x' || substr(md5(name), {1 + 7 * i}, 7) AS BIGINT)) % {chains.PRIME} AS k{i}" for i, b in enumerate(chains.BASES)]


@query(f"""WITH RECURSIVE p AS (SELECT o_orderkey AS id, o_orderkey % 4000 AS pid, (o_orderkey * 31 + o_custkey) % 4000 AS ppid, lower(o_orderpriority || '.exe') AS name, o_orderdate + to_microseconds(o_orderkey) AS began FROM orders),
    u AS (SELECT c.id, c.name, CASE WHEN x.id <> c.id THEN x.id END AS parent FROM p c ASOF LEFT JOIN p x ON x.pid = c.ppid AND x.began <= c.began),
    w(id, length, root, names, {", ".join(f"k{i}" for i in range(4))}) AS (
        SELECT id, 1, id, [name], {", ".join(_KEY)} FROM (SELECT *, {", ".join(f"CAST(0 AS BIGINT) AS k{i}" for i in range(4))} FROM u WHERE parent IS NULL) UNION ALL
        SELECT u.id, length + 1, root, list_append(names, name), {", ".join(_KEY)} FROM u JOIN w ON u.parent = w.id)
    SELECT id, CAST(length AS BIGINT) AS length, root, array_to_string(names[-{chains.TAIL}:], '->') AS tail, {" || ".join(f"lower(lpad(to_hex(k{i}), 8, '0'))" for i in range(4))} AS chain_key, false AS cyclic FROM w""")
def process_chains(t):
    k = F.col("o_orderkey")
    began = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k)
    return chains.chains(t("orders").select(k.alias("id"), (k % 4000).alias("pid"), ((k * 31 + F.col("o_custkey")) % 4000).alias("ppid"), F.concat("o_orderpriority", F.lit(".exe")).alias("name"), began.alias("created")))


@query(r"SELECT match, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '@[a-z0-9]{1,20}\.')) AS match FROM documents) GROUP BY 1")
def byte_pattern_scan(t):
    texts = t("documents").select("text")
    folder = shared_dir(texts.sparkSession)
    texts.write.text(folder)
    found = byte_ranges.patterns(texts.sparkSession, folder, r"@[a-z0-9]{1,20}\.", 22, 1 << 20)
    return found.groupBy(F.decode("match", "UTF-8").alias("match")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= CASE event_type WHEN 'error' THEN 400 WHEN 'purchase' THEN 7 ELSE 90 END""")
def stream_first_arrivals(t):
    events = t("events").select("event_id", "event_type")
    spark = events.sparkSession
    source, sink, at = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    events.write.parquet(source)
    before = spark.conf.get(accumulate.PROVIDER[0])
    accumulate.ready(spark)
    try:
        stream = spark.readStream.schema(events.schema).parquet(source)
        first = accumulate.first_arrivals(stream, "event_type", "event_id", {"error": 400, "purchase": 7}, 90)
        first.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(accumulate.PROVIDER[0], before)
    return spark.read.schema(first.schema).parquet(sink)


@query(r"""WITH s AS (SELECT 'host' AS kind, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '') AS value, 'tool' || (page_id % 6) AS tool, split_part(url, '/', 4) AS source, CASE WHEN url LIKE '%?%' THEN 'asked' ELSE 'plain' END AS class, page_id FROM pages),
    d AS (SELECT DISTINCT value, source FROM s), r AS (SELECT value, list(source ORDER BY source)[1:4] AS sources FROM d GROUP BY 1), o AS (SELECT value, list_sort(list(DISTINCT tool))[1:4] AS tools, count(*) AS n, arg_min(class, page_id) AS first_class FROM s GROUP BY 1)
    SELECT 'host' AS kind, value, n, first_class, array_to_string(tools, ',') AS tools, array_to_string(sources, ',') AS sources FROM o JOIN r USING (value)""")
def indicator_sightings(t):
    url = F.col("url")
    seen = t("pages").select(F.lit("host").alias("kind"), host(url).alias("value"), F.concat(F.lit("tool"), (F.col("page_id") % 6).cast("string")).alias("tool"), F.coalesce(F.get(F.split(url, "/"), 3), F.lit("")).alias("source"), F.when(F.contains(url, F.lit("?")), "asked").otherwise("plain").alias("class"), F.col("page_id").alias("ordinal"))
    found = accumulate.gathered(seen, 4)
    return found.select("kind", "value", "n", "first_class", *(F.array_join(c, ",").alias(c) for c in ("tools", "sources")))


_SEEN = """z AS (SELECT c_custkey AS k, 'u' || lpad(CAST(c_custkey % 700 AS VARCHAR), 4, '0') || 'x.tail' AS long, 'u' || lpad(CAST(c_custkey % 700 AS VARCHAR), 4, '0') || 'x~1' AS short, c_custkey % 700 AS u FROM customer),
    s AS (SELECT 'vol_getsids' AS tool, 'corp' AS domain, long AS name, CASE WHEN u % 3 = 0 THEN 'S-1-5-21-1-2-3-' || u END AS sid, k AS pid, NULL AS event FROM z WHERE u % 5 <> 0
        UNION ALL SELECT 'parse_event_logs', '', long, NULL, NULL, CASE WHEN k % 2 = 0 THEN 4672 ELSE 4624 END FROM z UNION ALL SELECT 'vol_pstree', '', long, NULL, k, NULL FROM z WHERE k % 4 = 0
        UNION ALL SELECT 'vol_handles', '', short, NULL, k, NULL FROM z WHERE k % 7 = 0 UNION ALL SELECT 'parse_rdp_artifacts', 'corp', long, NULL, NULL, NULL FROM z WHERE k % 13 = 0 UNION ALL SELECT 'parse_powershell_transcripts', CASE WHEN k % 2 = 0 THEN 'corp' ELSE 'lab' END, 'admin', NULL, NULL, NULL FROM z WHERE k % 11 = 0),
    n AS (SELECT domain, name, count(DISTINCT sid) AS sids, max(sid) AS sid FROM s GROUP BY ALL), e AS (SELECT *, CASE sids WHEN 1 THEN 'sid:' || sid ELSE 'name:' || CASE WHEN domain <> '' THEN domain || chr(92) ELSE '' END || name END AS entity FROM n),
    h AS (SELECT name, max(entity) AS home FROM e WHERE domain <> '' GROUP BY 1 HAVING count(DISTINCT entity) = 1), f AS (SELECT e.*, CASE WHEN domain = '' THEN coalesce(home, entity) ELSE entity END AS root FROM e LEFT JOIN h USING (name)),
    l AS (SELECT domain, upper(substr(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'), 1, 6)) AS stem, max(root) AS far FROM f WHERE NOT contains(name, '~') GROUP BY ALL HAVING count(DISTINCT name) = 1),
    w AS (SELECT f.domain, f.name, coalesce(CASE WHEN f.name LIKE '%~1' THEN far END, root) AS account FROM f LEFT JOIN l ON l.domain = f.domain AND l.stem = upper(split_part(f.name, '~', 1))),
    m AS (SELECT s.*, account, CASE WHEN account LIKE 'sid:%' THEN substr(account, 5) END AS its FROM s JOIN w USING (domain, name))"""


def _sightings(t):
    k, c = F.col("k"), t("customer")
    u = F.col("c_custkey") % 700
    stem = F.concat(F.lit("U"), F.lpad(u.cast("string"), 4, "0"), F.lit("x"))
    z = c.select(F.col("c_custkey").alias("k"), u.alias("u"), F.concat(stem, F.lit(".tail")).alias("long"), F.concat(F.lit("D:\\users\\"), stem, F.lit("~1\\b")).alias("short"))
    sid = F.when(F.col("u") % 3 == 0, F.concat(F.lit("S-1-5-21-1-2-3-"), F.col("u").cast("string"))).otherwise("S-1-5-18")
    parts = [
        accounts.in_fields(z.where("u % 5 <> 0").withColumn("raw", F.concat(F.lit("CORP\\"), "long")), "vol_getsids", ["raw"], "k", sid=sid, pid=k),
        accounts.in_messages(z.withColumn("said", F.concat(F.lit("Account Name:  "), "long", F.lit(", granted"))), "parse_event_logs", "said", "k", F.when(k % 2 == 0, "4672").otherwise("4624")),
        accounts.in_paths(z.where("k % 4 = 0").withColumn("cmd", F.concat(F.lit("run c:\\Users\\"), "long", F.lit("\\a.exe"))), "vol_pstree", ["cmd"], "k", pid=k),
        accounts.in_paths(z.where("k % 7 = 0"), "vol_handles", ["short"], "k", pid=k, pseudo=False),
        accounts.in_fields(z.where("k % 13 = 0").withColumn("raw", F.concat(F.lit("CORP\\"), "long")), "parse_rdp_artifacts", ["raw"], "k"),
        accounts.in_fields(z.where("k % 11 = 0").withColumn("raw", F.when(k % 2 == 0, "corp/admin").otherwise("LAB\\Admin")), "parse_powershell_transcripts", ["raw"], "k"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_SEEN} SELECT account, max(its) AS sid, array_to_string(list_sort(list(DISTINCT CASE WHEN domain <> '' THEN domain || chr(92) ELSE '' END || name)), ',') AS names, array_to_string(list_sort(list(DISTINCT tool)), ',') AS source_tools,
    count(DISTINCT CASE WHEN sid IS NOT DISTINCT FROM its THEN pid END) AS n_pids, count(*) FILTER (tool = 'parse_event_logs') AS event_count, count(*) FILTER (event = 4672) AS n_privileged, count(*) FILTER (tool LIKE '%transcripts') AS script_count, count(*) FILTER (tool LIKE '%rdp%') AS remote_count FROM m GROUP BY 1""")
def account_union(t):
    found = accounts.accounts(_sightings(t))
    return found.select("account", "sid", *(F.array_join(c, ",").alias(c) for c in ("names", "source_tools")), "n_pids", "event_count", "n_privileged", "script_count", "remote_count")


@query(f"""WITH {_SEEN}, b AS (SELECT account, count(DISTINCT pid) AS bad FROM m WHERE sid IS NOT NULL AND pid % 10 = 0 GROUP BY 1), g AS (SELECT account, count(*) FILTER (event = 4672) AS granted, bool_or(domain = 'lab') AS script FROM m GROUP BY 1)
    SELECT account, script OR bad IS NOT NULL OR granted >= 3 AS passes, coalesce(bad, 0) AS n_bad_pids FROM g LEFT JOIN b USING (account)""")
def account_strict_gate(t):
    seen = _sightings(t)
    bad = t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("pid"))
    suspicious = seen.where("domain = 'lab'").select("domain", "name").distinct()
    return accounts.strict(accounts.accounts(seen), seen, bad, suspicious)


@query("""WITH r AS (SELECT doc_id, source, length(text) // 100 AS size, CAST(substr(source, 4) AS BIGINT) % 3 AS priority, sum(length(text) // 100) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents),
    s AS (SELECT source, any_value(priority) AS priority, list_sort(list(DISTINCT upto) FILTER (upto <= 3000)) AS steps FROM r GROUP BY 1 HAVING count(*) FILTER (upto <= 3000) > 0),
    q AS (SELECT list({'source': source, 'left': CAST(3000 AS HUGEINT), 'steps': steps, 'taken': CAST([] AS STRUCT(source VARCHAR, upto HUGEINT)[])} ORDER BY priority DESC, source) AS all_ FROM s),
    f AS (SELECT list_reduce(list_prepend({'source': '', 'left': CAST(3000 AS HUGEINT), 'steps': CAST([] AS HUGEINT[]), 'taken': CAST([] AS STRUCT(source VARCHAR, upto HUGEINT)[])}, all_), lambda a, s: CASE WHEN list_max(list_filter(s.steps, lambda x: x <= a.left - 20)) IS NULL THEN a ELSE
        {'source': '', 'left': a.left - 20 - list_max(list_filter(s.steps, lambda x: x <= a.left - 20)), 'steps': CAST([] AS HUGEINT[]), 'taken': list_append(a.taken, {'source': s.source, 'upto': list_max(list_filter(s.steps, lambda x: x <= a.left - 20))})} END).taken AS taken FROM q),
    g AS (SELECT unnest(taken) AS t FROM f)
    SELECT doc_id, r.source, CAST(upto AS BIGINT) AS used FROM r JOIN g ON r.source = t.source WHERE r.upto <= t.upto""")
def budget_by_source(t):
    size = F.floor(F.char_length("text") / 100)
    records = t("documents").select("doc_id", "source", F.substring("source", 4, 9).cast("long").alias("number"), size.alias("size")).withColumn("priority", F.col("number") % 3)
    return budget.within_budget(records, "source", "priority", "doc_id", "size", 3000, 20).select("doc_id", "source", "used")


@query(r"""WITH h AS (SELECT DISTINCT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS name FROM pages), s AS (SELECT DISTINCT array_to_string(string_split(name, '.')[CASE WHEN page_id % 3 = 0 THEN -2 ELSE -1 END:], '.') AS suffix FROM h),
    n AS (SELECT DISTINCT name, string_split(name, '.') AS ls FROM h), m AS (SELECT n.*, suffix, len(string_split(suffix, '.')) AS k FROM n JOIN s ON name = suffix OR ends_with(name, '.' || suffix)),
    b AS (SELECT name, arg_max(suffix, k) AS suffix, max(k) AS k FROM m GROUP BY 1)
    SELECT n.name, suffix, CASE WHEN len(ls) > k THEN array_to_string(ls[-(k + 1):], '.') END AS registrable FROM n LEFT JOIN b USING (name)""")
def registrable_domains(t):
    name = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1))
    hosts = t("pages").select("page_id", name.alias("name"))
    labels = F.split("name", r"\.")
    suffix = F.array_join(F.when(F.col("page_id") % 3 == 0, F.slice(labels, -2, 2)).otherwise(F.slice(labels, -1, 1)), ".")
    return budget.registrable(hosts, hosts.select(suffix.alias("suffix")))


@query("""WITH i AS (SELECT 'by_supplier' AS index_name, CAST(l_suppkey AS VARCHAR) AS key, l_orderkey, l_linenumber, l_returnflag FROM lineitem UNION ALL SELECT 'by_part', CAST(l_partkey AS VARCHAR), l_orderkey, l_linenumber, l_returnflag FROM lineitem),
    c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 2 = 0 THEN 'by_supplier' ELSE 'by_part' END AS index_name, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 50 < 7)
    SELECT claim_id, index_name, key, count(*) AS n_facts, min(l_returnflag) AS least_mode FROM c JOIN i USING (index_name, key) GROUP BY ALL""")
def stored_index_lookup(t):
    facts = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), "l_suppkey", "l_partkey", "l_returnflag")
    table = fact_index.write_index(facts, {"by_supplier": F.col("l_suppkey"), "by_part": F.col("l_partkey")}, "fact_id", ["l_returnflag"])
    k = F.col("o_orderkey")
    claims = t("orders").where(k % 50 < 7).select(k.alias("claim_id"), F.when(k % 2 == 0, "by_supplier").otherwise("by_part").alias("index_name"), F.col("o_custkey").cast("string").alias("key"))
    found = fact_index.lookup(claims, table)
    return found.groupBy("claim_id", "index_name", "key").agg(F.count(F.lit(1)).alias("n_facts"), F.min("l_returnflag").alias("least_mode"))


_SAID = ["listens on 127.0.0.1:80", "peer 8.8.8.8 of localhost", "beacon to 10.1.2.3", "seen at ::1", "PID: 77 wrote", "quiet", "peer 999.1.1.1"]
_JUDGED = ["confirmed_benign", None, "malicious", "FP ", "inconclusive", None, None, None]
_SIGNED = [None, "rwx_memory_region_with_unusual_protection", "dga_domain"]


@query(f"""WITH f AS (SELECT c_custkey AS id, ['{"', '".join(_SAID)}'][c_custkey % 7 + 1] AS said, lower(trim(coalesce([{", ".join("NULL" if v is None else f"'{v}'" for v in _JUDGED)}][c_custkey // 7 % 8 + 1], ''))) AS v, [NULL, 'w', 's'][c_custkey // 5 % 3 + 1] AS signal, CAST(c_nationkey AS VARCHAR) || CAST(c_custkey % 9 AS VARCHAR) AS pid FROM customer),
    g AS (SELECT *, v IN ('confirmed_benign', 'fp') AS benign, v <> 'malicious' AND coalesce(signal, '') <> 's' AS open, said LIKE 'listens%' OR said LIKE 'seen%' AS local, said LIKE '%8.8.8.8%' AS peer FROM f),
    e AS (SELECT id, benign, unnest(CASE WHEN said LIKE 'PID%' THEN [pid, '77'] ELSE [pid] END) AS pid FROM g), c AS (SELECT DISTINCT pid FROM e WHERE benign AND pid <> '0'), r AS (SELECT DISTINCT id FROM e JOIN c USING (pid))
    SELECT id AS finding_id, CASE WHEN open AND benign AND local THEN 'loopback_benign' WHEN open AND NOT benign AND NOT peer AND r.id IS NOT NULL THEN 'entity_benign_propagation' END AS reason FROM g LEFT JOIN r USING (id)""")
def benign_routing(t):
    k = F.col("c_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.expr(at).cast("int"))
    claims = F.array(F.create_map(F.lit("type"), F.lit("pid"), F.lit("pid"), F.concat(F.col("c_nationkey").cast("string"), (k % 9).cast("string"))))
    signal = pick(_SIGNED, "c_custkey DIV 5 % 3 + 1")
    findings = t("customer").select(
        k.alias("finding_id"), F.lit("t").alias("title"), pick(_SAID, "c_custkey % 7 + 1").alias("description"), F.lit(None).cast("string").alias("raw_excerpt"), claims.alias("claims"), pick(_JUDGED, "c_custkey DIV 7 % 8 + 1").alias("verdict"),
        F.lit(None).cast("boolean").alias("false_positive"), F.array_compact(F.array(signal)).alias("signals"))
    return routing.routed(findings)


@query(r"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'peer 10.' || c_nationkey || '.0.' || (c_custkey % 300) AS peer FROM customer)
    SELECT k AS finding_id, 0 AS claim_no, CASE WHEN k % 300 < 256 THEN 'foreign_addr=' || substr(peer, 6) || ';type=connection;value=' || peer ELSE 'type=path;value=' || peer END AS claim FROM c
    UNION ALL SELECT k, 1, 'pid=' || k || ';process=p' || n || '.exe;type=pid' FROM c WHERE k % 3 <> 0
    UNION ALL SELECT k, 2, 'artifact=event ' || (k % 50) || ';event_id=' || (k % 50) || ';type=event_log;value=event ' || (k % 50) FROM c
    UNION ALL SELECT k, 3, CASE WHEN k % 2 = 0 THEN 'rescued_from=bare_token_path;service_name=svc' || n || ';type=service' ELSE 'process=svc' || n || ';rescued_from=bare_token_path;type=process_exists' END || ';value=svc' || n FROM c""")
def claim_forms_told(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = lambda **v: F.create_map(*(x for name, c in v.items() for x in (F.lit(name), c if not isinstance(c, str) else F.lit(c))))
    told = [
        text(type="raw", value=F.concat(F.lit("peer 10."), n, F.lit(".0."), (k % 300).cast("string"))), text(type="process", pid=F.when(k % 3 == 0, "x").otherwise(k.cast("string")), process_name=F.concat(F.lit("C:\\d\\p"), n, F.lit(".exe"))),
        text(type="artifact", artifact=F.concat(F.lit("event "), (k % 50).cast("string"))), text(type="path", value=F.concat(F.lit("svc"), n))]
    claims = t("customer").select(k.alias("finding_id"), F.when(k % 2 == 0, "a service").otherwise("a view").alias("context"), F.posexplode(F.array(*told)).alias("claim_no", "claim"))
    found = claim_forms.normalised(claims)
    pairs = F.array_sort(F.transform(F.map_entries("claim"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("finding_id", "claim_no", F.array_join(pairs, ";").alias("said")).withColumnRenamed("said", "claim")


@query(r"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 5 AS m, CAST(o_custkey AS VARCHAR) AS pid, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
    s AS (SELECT CAST(c_custkey AS VARCHAR) AS pid, 'user' || c_nationkey AS name FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 7),
    w AS (SELECT id, m, day, coalesce(CASE m WHEN 0 THEN 'Ann' || (id % 9) WHEN 1 THEN 'bob' || (id % 4) END, CASE WHEN m IN (2, 3) THEN s.name END, '') AS actor, CASE m WHEN 4 THEN '' ELSE day END AS "at" FROM c LEFT JOIN s USING (pid))
    SELECT id AS finding_id, actor, "at", concat_ws(' · ', 'Who: ' || CASE WHEN actor <> '' THEN actor WHEN m = 3 THEN 'service context' END, CASE WHEN "at" <> '' THEN 'When: ' || "at" || ' UTC' END) AS label FROM w""")
def actor_time_labels(t):
    k = F.col("o_orderkey")
    m, pid, day = k % 5, F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = lambda v: F.create_map(*(x for n, c in v.items() for x in (F.lit(n), c)))
    none = F.lit(None).cast("string")
    account = text({"type": F.lit("user_account"), "username": F.lit("SYSTEM"), "value": F.concat(F.lit(" Ann"), (k % 9).cast("string")), "created": F.concat(day, F.lit("x"))})
    claims = F.when(m == 0, F.array(account)).when(m == 2, F.array(text({"type": F.lit("pid"), "pid": pid, "create_time": F.concat(F.lit("at "), day)})))
    said = F.when(m == 1, F.concat(F.lit("ran C:\\Users\\bob"), (k % 4).cast("string"), F.lit("\\a.exe on "), day)).when(m == 3, F.concat(F.lit("PID: "), pid, F.lit(" wrote"))).otherwise("myusers/x")
    findings = t("orders").select(k.alias("finding_id"), F.lit("t").alias("title"), said.alias("description"), none.alias("raw_excerpt"), claims.alias("claims"), F.when(m == 3, day).alias("timestamp"), F.when(m == 3, "service context").alias("execution_context"))
    c = F.col("c_custkey")
    name = F.when(F.col("c_nationkey") == 7, "SYSTEM").otherwise(F.concat(F.lit("DOM/user"), F.col("c_nationkey").cast("string")))
    sids = t("customer").select(c.alias("pid"), F.when(c % 3 == 0, "S-1-5-21-1-2-3-1001").when(c % 3 == 1, "S-1-5-21-1-2-3-513").otherwise("S-1-5-18").alias("sid"), name.alias("name"), c.alias("ordinal"))
    return actors.labelled(findings, sids)


_VOICES = """f AS (SELECT o_orderkey AS id, o_orderpriority AS member, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS no, CASE o_custkey % 4 WHEN 0 THEN 'pid:' || (o_custkey % 900) WHEN 1 THEN 'ip:10.0.0.' || o_custkey WHEN 2 THEN 'desc:art' || (o_custkey % 600) || '|a title' ELSE 'uid:' || o_orderkey END AS fp FROM orders),
    g AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY no, id) AS r, first_value(member) OVER (PARTITION BY fp ORDER BY no, id) AS lead FROM f)"""


def _voices(t):
    k = F.col("o_custkey")
    claim = lambda name, value: F.array(F.create_map(F.lit("type"), F.lit("x"), F.lit(name), value))
    claims = F.when(k % 4 == 0, claim("pid", (k % 900).cast("string"))).when(k % 4 == 1, claim("foreign_addr", F.concat(F.lit("10.0.0."), k.cast("string")))).otherwise(F.array().cast("array<map<string,string>>"))
    rows = t("orders").select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("member"), F.substring("o_orderpriority", 1, 1).cast("int").alias("member_no"), F.col("o_orderkey").alias("finding_no"), claims.alias("claims"),
        F.when(k % 4 == 2, F.concat(F.lit("Art"), (k % 600).cast("string"))).alias("artifact"), F.when(k % 4 == 2, "A title").alias("title"))
    return rows, consensus.marked(rows)


@query(f"""WITH {_VOICES} SELECT fp, min(id) FILTER (r = 1) AS finding_id, any_value(lead) AS survivor_from, array_to_string(list_sort(list(DISTINCT member)), ',') AS discovered_by, coalesce(CASE WHEN count(DISTINCT member) = 1 THEN any_value(member) END, '') AS unique_to, count(*) AS n FROM g GROUP BY 1""")
def consensus_merged(t):
    found = consensus.merged(_voices(t)[1])
    return found.withColumns({"discovered_by": F.array_join("discovered_by", ","), "unique_to": F.coalesce("unique_to", F.lit(""))})


@query(f"WITH {_VOICES} SELECT id AS finding_id, member, fp, lead AS survivor_from FROM g WHERE r > 1")
def consensus_dropped(t):
    return consensus.dropped(_voices(t)[1]).drop("subject")


@query(f"""WITH {_VOICES}, u AS (SELECT fp, any_value(lead) AS lead, count(DISTINCT member) AS k FROM g GROUP BY 1), s AS (SELECT lead AS member, count(*) AS n_survivors, count(*) FILTER (k = 1) AS n_unique FROM u GROUP BY 1)
    SELECT member, count(*) AS n_findings, coalesce(any_value(n_survivors), 0) AS n_survivors, coalesce(any_value(n_unique), 0) AS n_unique FROM f LEFT JOIN s USING (member) GROUP BY 1""")
def consensus_members(t):
    return consensus.members(*_voices(t))


@query("""WITH f AS (SELECT o_orderkey AS id, ['docx', 'xlsx', 'pdf', 'txt', 'exe'][o_custkey % 5 + 1] AS own, CASE WHEN o_custkey % 3 = 0 THEN 'locked' WHEN o_custkey % 7 = 0 THEN 'zip' ELSE 'e' || (o_custkey % 40) END AS extension FROM orders),
    n AS (SELECT * FROM f WHERE own <> 'exe' AND extension <> 'zip'), s AS (SELECT extension, count(*) AS n_files, list_sort(list(DISTINCT own)) AS original_types FROM n GROUP BY 1 HAVING count(DISTINCT own) >= 3),
    b AS (SELECT * FROM s WHERE n_files > (SELECT CASE WHEN count(*) >= 4 THEN avg(n_files) + 2 * stddev_pop(n_files) ELSE 0 END FROM s) ORDER BY n_files DESC, extension DESC LIMIT 1)
    SELECT extension, n_files, array_to_string(original_types, ',') AS original_types, (SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM n JOIN b USING (extension) ORDER BY id LIMIT 20)) AS ids FROM b""")
def encryption_burst(t):
    k = F.col("o_custkey")
    own = F.element_at(F.array(*map(F.lit, ["docx", "XLSX", "pdf", "txt", "exe"])), (k % 5 + 1).cast("int"))
    new = F.when(k % 3 == 0, "locked").when(k % 7 == 0, "zip").otherwise(F.concat(F.lit("e"), (k % 40).cast("string")))
    files = t("orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(".", F.concat(F.lit("C:\\d.x\\f"), k.cast("string")), own, new).alias("path"))
    found = entities.encryption_burst(files, "path", "id")
    return found.select("extension", "n_files", F.array_join("original_types", ",").alias("original_types"), F.array_join("ids", ",").alias("ids"))
