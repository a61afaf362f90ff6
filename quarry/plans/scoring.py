"""The scoring table and candidates over facts made of the suppliers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import scoring

from .catalogue import query
from .scalars import sql_list

#: (fact type, fields as SQL over a part, tool, points, signal) of facts made of parts; every kind has one rule that fires and one that does not.
_KINDS = [
    ("memory_injection_fact", {"pid": "p_size + 10"}, "vol_malfind", 100, "memory_injection"), ("process_fact", {"pid": "p_size + 10", "path": "'C:\\\\Temp\\\\a.exe'"}, "vol_pstree", 55, "process_from_staging_path"), ("process_fact", {"pid": "p_size + 10", "path": "'C:\\\\ProgramData\\\\notes.txt'"}, "vol_pstree", 0, ""),
    ("registry_persistence_fact", {"service_name": "concat('s', p_size)", "value_name": "'ImagePath'", "value_data": "'C:\\\\Users\\\\Public\\\\b.exe'"}, "parse_registry_persistence", 85, "registry_points_to_staging_path"), ("registry_persistence_fact", {"service_name": "concat('s', p_size)", "value_name": "'Start'", "value_data": "'C:\\\\Users\\\\u\\\\Downloads\\\\b.exe'"}, "parse_registry_persistence", 0, ""),
    ("usb_device_fact", {"path": "concat('usb', p_size)"}, "parse_usb_history", 30, "removable_media_connection"), ("event_log_fact", {"pid": "p_size + 10", "event_id": "'4648'"}, "parse_event_logs", 40, "explicit_credential_logon"), ("network_connection_fact", {"pid": "p_size + 10", "dst_ip": "'8.8.4.4'", "dst_port": "'443'"}, "vol_netscan", 55, "public_remote_peer"),
    ("psxview_fact", {"pid": "p_size + 10", "pslist": "'False'", "psscan": "'True'"}, "vol_psxview", 80, "process_view_inconsistency"), ("sid_fact", {"pid": "p_size + 10", "sid": "'S-1-5-19'", "process_name": "'cmd.exe'"}, "vol_getsids", 70, "service_account_interactive_execution"),
    ("powershell_command_fact", {"path": "concat('ps', p_size)", "ttp_tags": "'download_cradle'"}, "parse_powershell_transcripts", 210, "powershell_download_cradle"), ("scheduled_task_fact", {"task_name": "concat('t', p_size)", "hidden": "'True'", "actions": "'x'"}, "parse_scheduled_tasks_disk", 35, "hidden_scheduled_task"),
]


def _facts(t):
    one = lambda kind, fields: F.struct(F.lit(kind).alias("fact_type"), F.create_map(*(x for n, e in fields.items() for x in (F.lit(n), F.expr(e).cast("string")))).alias("fields"))
    made = F.element_at(F.array(*(one(k, f) for k, f, *_ in _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    tool = F.element_at(F.array(*(F.lit(x[2]) for x in _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("fact_id"), made.alias("m"), tool.alias("source_tool")).select("fact_id", "m.fact_type", "m.fields", "source_tool")


_SIGNAL = sql_list([k[4] for k in _KINDS])
_POINTS = sql_list([k[3] for k in _KINDS])
_I = f"p_partkey % {len(_KINDS)} + 1"


@query(f"SELECT p_partkey AS fact_id, {_POINTS}[{_I}] AS score, contains({_SIGNAL}[{_I}], '') AND {_SIGNAL}[{_I}] <> '' AS scored FROM part")
def fact_scores(t):
    return scoring.with_score(_facts(t)).select("fact_id", "score", (F.size("scored") > 0).alias("scored"))


#: Facts about a process and the candidates of processes: kinds of the list above with a process number.
_PID = [i for i, k in enumerate(_KINDS) if "pid" in k[1]]
_C = f"""WITH f AS (SELECT p_partkey AS fact_id, {_I} AS i, p_size + 10 AS pid, {_POINTS}[{_I}] AS points, {_SIGNAL}[{_I}] AS signal, {sql_list([k[2] for k in _KINDS])}[{_I}] AS tool, {sql_list([k[0] for k in _KINDS])}[{_I}] AS kind FROM part WHERE {_I} IN ({", ".join(str(i + 1) for i in _PID)})),
    w AS (SELECT pid, count(DISTINCT tool) AS tools, count(DISTINCT kind) AS kinds FROM f GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY pid, signal, tool, kind ORDER BY fact_id) AS k FROM f WHERE points > 0),
    s AS (SELECT pid, sum(least(points, 100)) AS points, count(*) AS n FROM r WHERE k <= 4 GROUP BY 1)"""


@query(f"""{_C} SELECT 'pid:' || pid AS entity_key, CAST(points + CASE WHEN tools >= 2 THEN 35 ELSE 0 END + CASE WHEN kinds >= 2 THEN 30 ELSE 0 END + CASE WHEN n >= 3 THEN 10 ELSE 0 END AS BIGINT) AS score, n AS n_supports FROM w JOIN s USING (pid) WHERE points + CASE WHEN tools >= 2 THEN 35 ELSE 0 END + CASE WHEN kinds >= 2 THEN 30 ELSE 0 END + CASE WHEN n >= 3 THEN 10 ELSE 0 END >= 35""")
def entity_candidates(t):
    found = scoring.candidates(_facts(t))
    return found.where("entity_key LIKE 'pid:%'").select("entity_key", "score", "n_supports")


@query(f"""{_C} SELECT count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM w JOIN s USING (pid) WHERE points + CASE WHEN tools >= 2 THEN 35 ELSE 0 END + CASE WHEN kinds >= 2 THEN 30 ELSE 0 END + CASE WHEN n >= 3 THEN 10 ELSE 0 END >= 80 AND pid IN (SELECT pid FROM f WHERE signal IN ('memory_injection', 'process_from_staging_path', 'process_view_inconsistency'))""")
def ready_candidates(t):
    found = scoring.candidates(_facts(t)).where("entity_key LIKE 'pid:%' AND ready AND exists(signals, s -> s IN ('memory_injection', 'process_from_staging_path', 'process_view_inconsistency'))")
    bonus = F.when(F.size("source_tools") >= 2, 35).otherwise(0) + F.when(F.size("fact_types") >= 2, 30).otherwise(0) + F.when(F.col("n_supports") >= 3, 10).otherwise(0)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score") - bonus).alias("points"))
