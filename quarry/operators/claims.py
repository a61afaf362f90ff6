"""Checks of claims against typed facts.

A claim is a map of names to texts with a ``type``; a fact is a row (fact_id, fact_type, fields).  Every type of
claim has a rule: which facts it looks at, under which keys, how the process must agree, and what else must hold.  Rules
are a small table that is broadcast: a claim's keys are exploded and joined to the facts' keys, each pair is judged by one expression over its rule, and
verdicts come from one grouping by claim.  A verdict is MATCH, MISMATCH, or null where the facts cannot tell.  It depends on what a claim says
and not on who says it, so claims that say the same meet the facts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions.columns import computed

from .graph import saved

MATCH, MISMATCH = "MATCH", "MISMATCH"
#: Claims that differ, up to this count (about 20 MB), are broadcast to the facts; above it both sides are shuffled by key.
MOST_BROADCAST = 50_000
#: Verdicts of claims that differ, up to this count (16 bytes and a word each), are broadcast to all claims; above it both sides are shuffled.
MOST_VERDICTS = 300_000

_PID, _OWNER = ["pid", "process_id"], ["process_name", "process", "image_name"]
_WHO = ["process", "process_name", "image_name"]
_VALUE = ["value", "artifact", "path", "filename"]
_PATH = ["path", "value", "artifact"]
_MODULE, _MODULE_PATH = ["dll_name", "module", "name", "dll"], ["dll_path", "path", "value", "artifact"]
_PRIVILEGE = ["privilege", "privilege_name", "name"]
_SID, _ACCOUNT = ["sid", "security_identifier", "sid_string"], ["account", "account_name", "sid_name", "name", "user", "username"]
_SLOT = ["index", "ssdt_index", "entry"]
_SERVICE, _STATE, _BINARY = ["service_name", "service", "name", "value"], ["state", "service_state", "status"], ["binary_path", "binary", "service_binary", "image_path", "path"]
_LISTED, _LISTED_IN = ["path", "file_path", "normalized_path", "value", "artifact", "name", "filename"], ["contains", "path_contains", "name_contains", "file_contains"]
_TASK, _ACTION = ["task_name", "name", "task", "task_path", "path", "value", "artifact"], ["action_contains", "action", "contains", "command", "exec", "arguments"]
_FILED, _FILED_IN = ["path", "file_path", "filename", "normalized_path", "value", "artifact"], ["contains", "path_contains", "file_contains"]
_RDP_PATH = ["path", "file_path", "source_path", "target_path", "normalized_path", "value", "artifact"]
_VARIABLE, _DATA, _DATA_IN = ["variable", "variable_name", "envvar", "envvar_name", "name"], ["value", "env_value", "data"], ["contains", "value_contains", "env_contains"]
_APP, _USER = ["application_path", "path", "application", "value", "artifact"], ["user", "username"]
_LINE, _LINE_IN = ["cmdline", "command_line", "command", "args", "value"], ["contains", "cmdline_contains", "argument_contains", "argument", "needle", "value"]
_HANDLE_TYPE, _HANDLE_IN = ["handle_type", "type_name", "object_type"], ["contains", "handle_contains", "name_contains"]
_DECODED_TAG = ["ttp_tag", "tag", "decoded_ttp_tag"]
_RDP = [["contains", "artifact_contains", "path_contains"], ["username", "user", "account", "account_name", "sid"], ["host", "remote_host", "server", "remote_server", "address", "remote_address", "ip", "remote_ip"], ["artifact_type", "rdp_artifact_type", "kind", "category"], ["timestamp", "time", "datetime", "last_connected"]]
_WMI = [["name", "subscription"], ["filter", "filter_name"], ["consumer", "consumer_name"], ["query", "wql"], ["command", "script", "action"], ["namespace"], ["artifact_type", "kind", "class"], ["user", "username", "sid"], ["path", "value", "artifact"]]


def _w(names, op, facts=(), form="text", tells=False, const="", alternative=False):
    """A condition: the claim's names, how its text (or ``const``) is compared with the fact's names (all without any), in which form, whether facts without the text cannot tell, whether one of several is enough."""
    return (list(names), const, op, list(facts), form, tells, alternative)


def _k(index, names, form="text", unless=(), const=""):
    """A key: the index and the claim's names whose text (or ``const``) is looked up, if none of ``unless`` is there."""
    return (index, list(names), form, list(unless), const)


def _rule(facts, keys, wanted=(), needs=(), long=(), nothing=None, failing=MISMATCH, process=(), unnamed=False):
    """A rule: fact types, keys, conditions, lists of names of each of which one must be there, names whose text must be so long, verdicts without facts and for
    facts that do not hold what is wanted, the fact's names of its process, and whether unnamed facts count beside named ones."""
    return (list(facts), list(keys), list(wanted), [list(n) for n in needs], [(list(n), k) for n, k in long], nothing, failing, list(process), unnamed)


def _contain(names, facts=()):
    return _w(names, "contains", facts)


def _rules() -> dict[tuple[str, ...], tuple]:
    pid = _k("by_pid", _PID, "number")
    every = lambda kind: _k("all", [], unless=_PID, const=kind)
    someone = _PID + _WHO
    handle = [_w(_HANDLE_TYPE, "eq", ["handle_type"]), _w(["handle_name", "name", "object_name"], "eq", ["handle_name"]), _contain(_HANDLE_IN, ["handle_name", "handle_type", "process_name"]), _w(["granted_access"], "eq", ["granted_access", "access"], "number")]
    kernel = [_w(["module", "driver", "target_module"], "eq", ["module"], "leaf"), _w(["symbol", "function", "syscall", "routine"], "eq", ["symbol"]), _w(["status", "verdict", "state"], "eq", ["status"])]
    slots = [_k("by_slot", _SLOT, "number"), _k("all", [], unless=_SLOT, const="ssdt_integrity_fact")]
    entry = _SLOT + ["module", "driver", "target_module", "symbol", "function", "syscall", "routine"]
    service = [_w(["display_name"], "eq", ["display", "display_name"]), _w(_PID, "eq", ["pid"], "number"), _w(_STATE, "eq", ["state"], tells=True), _w(_BINARY, "path_or_leaf", ["binary", "path"], "path", tells=True)]
    by_service = [_k("by_service_name", _SERVICE), _k("by_pid", _PID, "number", unless=_SERVICE)]
    task = [_contain(_ACTION), _w(["hidden"], "flag", ["hidden"], tells=True), _w(["enabled"], "flag", ["enabled"], tells=True)]
    line = [pid, every("process_cmdline_fact")]
    module = _w(_MODULE, "any_leaf", ["dll_name", "path"], "leaf")
    privilege, has = [pid, every("privilege_fact")], _w(_PRIVILEGE, "eq", ["privilege"], "letters")
    sids = [pid, every("sid_fact")]
    variables, held = [pid, every("environment_variable_fact")], [_w(_VARIABLE, "eq", ["variable"]), _w(_DATA, "eq", ["value"]), _contain(_DATA_IN, ["variable", "value"])]
    timeline = [_contain(_FILED_IN), _contain(["timestamp", "time", "datetime", "timestamp_minute", "date"]), _contain(["event_type", "event", "action", "operation", "reason"])]
    usage = [_w(_APP, "path_or_any_leaf", ["normalized_path", "application_path", "application"], "path"), _w(_USER, "eq", ["user"]), _w(["sid", "user_sid"], "eq", ["sid"]), _contain(["table"], ["table"]), _w(["remote_ip", "destination_ip", "ip"], "eq", ["remote_ip"]), _w(["timestamp", "ts"], "eq", ["timestamp"], "minute"), _w(["min_bytes_total", "bytes_total_min", "bytes_min"], "at_least", ["bytes_total"], "number")]
    env = dict(process=_OWNER, unnamed=True)
    return {
        ("pid",): _rule(["process_fact", "memory_injection_fact", "network_connection_fact"], [pid]),
        ("process_exists",): _rule(["process_fact", "memory_injection_fact", "psxview_fact"], [pid, _k("by_name", ["process", "value"], "prefix")], failing=None),
        ("child_process",): _rule(["process_relationship_fact", "process_fact"], [_k("by_pid", ["child_pid"], "number")], [_w(["parent_pid"], "eq", ["parent_pid"], "number")], needs=[["parent_pid"]]),
        ("connection",): _rule(["network_connection_fact"], [pid, _k("by_ip", ["foreign_addr", "remote_addr"], "address", unless=_PID)], [_w(["foreign_addr", "remote_addr"], "eq", ["dst_ip"], "address"), _w(["foreign_port", "remote_port"], "eq_or_none", ["dst_port"], "number")]),
        ("hash",): _rule(["file_execution_fact"], [_k("by_hash", ["sha1"])], [_w(["filename"], "name", ["normalized_path", "path"], "leaf")]),
        ("path", "artifact", "raw"): _rule([], [_k("by_tail", _VALUE, "tail"), _k("by_leaf", _VALUE, "file"), _k("by_registry_path", _VALUE, "registry"), _k("by_task_name", _VALUE), _k("by_service_name", _VALUE), _k("by_ip", _VALUE, "quad"), _k("by_event_id", _VALUE, "number")], failing=None),
        ("srum_usage",): _rule(["srum_usage_fact"], [_k("by_app", _APP, "leaf"), _k("by_user", _USER, unless=_APP), _k("by_sid", ["sid", "user_sid"], unless=_APP + _USER), _k("all", [], unless=_APP + _USER + ["sid", "user_sid"], const="srum_usage_fact")], usage, nothing=MISMATCH),
        ("powershell_command",): _rule(["powershell_command_fact"], [_k("by_tag_head", ["ttp_tag"], "head"), _k("by_user", ["user"], unless=["ttp_tag"]), _k("by_ip", ["ip"], unless=["ttp_tag", "user"]), _k("by_url_host", ["url_host"], unless=["ttp_tag", "user", "ip"])],
            [_w(["ttp_tag"], "tag", ["ttp_tag"])], needs=[["ttp_tag", "user", "ip", "url_host"]], nothing=MISMATCH),
        ("decoded_string",): _rule(["decoded_string_fact"], [_k("by_ttp_tag", _DECODED_TAG)], [_contain(["contains", "decoded_contains", "payload_contains"], ["decoded_preview", "decoded", "original", "raw_excerpt"])], nothing=MISMATCH),
        ("event_log",): _rule(["event_log_fact"], [_k("by_event_id", ["event_id"])], [_contain(["contains", "image_path", "service_name"], ["raw_excerpt", "artifact", "message"])], needs=[["event_id"]], nothing=MISMATCH),
        ("appcompatcache",): _rule(["appcompatcache_execution_fact"], [_k("by_path", _PATH, "path")], [_w(["executed"], "flag_if_true", ["executed"])], needs=[_PATH], nothing=MISMATCH),
        ("process_cmdline",): _rule(["process_cmdline_fact"], line, [_w(_LINE, "eq", ["cmdline", "args"], "line")], process=_OWNER),
        ("process_cmdline_contains",): _rule(["process_cmdline_fact"], line, [_w(_LINE_IN, "within", ["cmdline", "args"], "line")], needs=[_LINE_IN], process=_OWNER),
        ("process_cmdline_empty",): _rule(["process_cmdline_fact"], line, [_w([], "empty", ["cmdline", "args"], const="asked")], process=_OWNER),
        ("process_handle",): _rule(["handle_fact"], [pid], handle, process=_OWNER), ("process_handle_type",): _rule(["handle_fact"], [pid], handle, needs=[_HANDLE_TYPE], process=_OWNER), ("process_handle_contains",): _rule(["handle_fact"], [pid], handle, needs=[_HANDLE_IN], process=_OWNER),
        ("process_dll_loaded",): _rule(["dll_load_fact"], [pid], [_w(_MODULE, "any_leaf", ["dll_name", "path"], "leaf", alternative=True), _w(_MODULE_PATH, "eq", ["path"], "path", alternative=True)], needs=[_MODULE + _MODULE_PATH], **env),
        ("dll_loaded",): _rule(["dll_load_fact"], [pid, every("dll_load_fact")], [module], needs=[_MODULE], **env), ("dll_path_loaded",): _rule(["dll_load_fact"], [pid, every("dll_load_fact")], [_w(_MODULE_PATH, "eq", ["path"], "path")], needs=[_MODULE_PATH], **env),
        ("process_privilege",): _rule(["privilege_fact"], privilege, [has, _w(["enabled"], "enabled", ["enabled", "attributes"], tells=True)], needs=[_PRIVILEGE, someone], **env),
        ("process_privilege_enabled",): _rule(["privilege_fact"], privilege, [has, _w([], "enabled", ["enabled", "attributes"], tells=True, const="true")], needs=[_PRIVILEGE, someone], **env),
        ("process_sid",): _rule(["sid_fact"], sids, [_w(_SID, "eq", ["sid"])], needs=[_SID, someone], **env), ("process_account_sid",): _rule(["sid_fact"], sids, [_w(_SID, "eq", ["sid"]), _w(_ACCOUNT, "eq", ["account", "user"], "leaf")], needs=[_SID + _ACCOUNT, someone], **env),
        ("ssdt_integrity",): _rule(["ssdt_integrity_fact"], slots, kernel, needs=[entry + ["status", "verdict", "state"]]), ("kernel_ssdt_entry",): _rule(["ssdt_integrity_fact"], slots, kernel, needs=[entry]),
        ("service",): _rule(["service_fact"], [*by_service, _k("all", [], unless=_SERVICE + _PID, const="service_fact")], service, needs=[_SERVICE + _PID + _BINARY + ["display_name"]]),
        ("service_state",): _rule(["service_fact"], by_service, service, needs=[_STATE]), ("service_binary",): _rule(["service_fact"], [*by_service, _k("all", [], unless=_SERVICE + _PID, const="service_fact")], service, needs=[_BINARY]),
        ("filesystem_listing", "file_object"): _rule(["filesystem_listing_fact"], [_k("by_path", _LISTED, "path"), _k("all", [], unless=_LISTED, const="filesystem_listing_fact")], [_contain(_LISTED_IN)], needs=[_LISTED + _LISTED_IN], nothing=MISMATCH),
        ("scheduled_task",): _rule(["scheduled_task_fact"], [_k("by_task_name", _TASK), _k("all", [], unless=_TASK, const="scheduled_task_fact")], task, needs=[_TASK + _ACTION], nothing=MISMATCH), ("scheduled_task_action",): _rule(["scheduled_task_fact"], [_k("by_task_name", _TASK), _k("all", [], unless=_TASK, const="scheduled_task_fact")], task, needs=[_ACTION], nothing=MISMATCH),
        ("filesystem_timeline", "mft_timeline"): _rule(["filesystem_timeline_fact"], [_k("by_path", _FILED, "path"), _k("all", [], unless=_FILED, const="filesystem_timeline_fact")], timeline, needs=[_FILED + _FILED_IN], long=[(_FILED_IN, 3)], nothing=MISMATCH),
        ("rdp_artifact",): _rule(["rdp_artifact_fact"], [_k("by_path", _RDP_PATH, "path"), _k("all", [], unless=_RDP_PATH, const="rdp_artifact_fact")], list(map(_contain, _RDP)), needs=[_RDP_PATH + sum(_RDP, [])], long=[(_RDP[0], 3)], nothing=MISMATCH),
        ("wmi_subscription",): _rule(["wmi_subscription_fact"], [_k("all", [], const="wmi_subscription_fact")], list(map(_contain, [*_WMI, ["contains"]])), needs=[sum(_WMI, []) + ["contains"]], long=[*((n, 2) for n in _WMI), (["contains"], 3)]),
        ("process_envvar",): _rule(["environment_variable_fact"], variables, held, needs=[_VARIABLE + _DATA + _DATA_IN, someone], **env), ("process_envvar_contains",): _rule(["environment_variable_fact"], variables, held, needs=[_DATA_IN, someone], **env), ("envvar",): _rule(["environment_variable_fact"], variables, held, needs=[_VARIABLE + _DATA + _DATA_IN], **env),
        ("typed_fact",): _rule([], [pid, _k("by_ip", ["foreign_addr", "ip", "local_addr", "remote_addr", "dst_ip", "src_ip"], "address"), _k("by_port", ["port", "foreign_port", "local_port", "remote_port", "dst_port"]), _k("by_hash", ["hash", "sha1", "sha256", "sha256_hash"]), _k("by_event_id", ["event_id"]),
            _k("by_path", _PATH, "path"), _k("by_registry_path", _PATH, "registry"), _k("by_task_name", _PATH), _k("by_service_name", _PATH), _k("by_fact_signature", ["fact_signature"])], [_w(["fact_type"], "type")], needs=[["fact_type"]], failing=None),
    }


def table(spark: SparkSession) -> DataFrame:
    """The rules, one row for each type of claim."""
    rows = [(t, *rule) for types, rule in _rules().items() for t in types]
    return spark.createDataFrame(rows, """type string, of array<string>, keys array<struct<index_name string, names array<string>, form string, unless array<string>, const string>>,
        wanted array<struct<names array<string>, const string, op string, facts array<string>, form string, tells boolean, alternative boolean>>, needs array<array<string>>, long array<struct<names array<string>, least int>>,
        nothing string, failing string, owner array<string>, unnamed boolean""")


def _first(texts: Column, names: Column) -> Column:
    """First text of these names in a map that is not blank, trimmed; '' without one."""
    found = F.filter(F.transform(names, lambda n: N.stripped(F.try_element_at(texts, n))), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def known(*names: str) -> Column:
    """The same of a fact's fields."""
    return _first(F.col("fields"), F.array(*map(F.lit, names)))


def said(*names: str) -> Column:
    return _first(F.col("claim"), F.array(*map(F.lit, names)))


def _formed(text: Column, form: Column) -> Column:
    """A text in the form in which it is looked up or compared."""
    path = lambda: N.path_of_fact(text)
    number = F.coalesce(N.whole(text).cast("string"), F.lit(""))
    return (
        F.when(form == "text", F.lower(text)).when(form == "number", number).when(form == "path", path()).when(form == "leaf", N.leaf(path())).when(form == "tail", N.without_drive(path())).when(form == "file", F.regexp_extract(path(), r"(?:^|/)([^/]*\.[a-z0-9]{1,8})$", 1))
        .when(form == "registry", N.path_of_fact(F.regexp_replace(text, "(?i)^reg:", ""))).when(form == "quad", F.when(N.is_quad(text), text).otherwise("")).when(form == "address", F.regexp_replace(F.lower(text), r"^\[|\]$|(?<=\.[0-9]{1,3}):[0-9]+$", "")).when(form == "line", N.command_line(text))
        .when(form == "letters", F.regexp_replace(F.lower(text), "[^a-z0-9]", "")).when(form == "minute", N.time_minute(text)).when(form == "head", F.regexp_extract(F.lower(text), "^([^_]*)", 1)).when(form == "prefix", F.when(text.rlike(r"[\s/\\]"), "").otherwise(F.substring(F.lower(text), 1, 5))).otherwise(text)
    )


def _flag(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("1", "true", "yes", "enabled", "enable"), True).when(low.isin("0", "false", "no", "disabled", "disable"), False)


def _enabled(text: Column) -> Column:
    """State of a privilege, from a flag or from its attributes."""
    return F.coalesce(_flag(text), F.when(F.contains(F.lower(text), F.lit("enabled")), True).when(text != "", False))


def _holds(w: Column) -> Column:
    """Whether the fact of a pair holds condition ``w`` (op, facts, form, value: the claim's text, formed)."""
    fields = F.col("fields")
    fact = _first(fields, w["facts"])
    every = F.lower(F.concat_ws(" ", F.when(F.size(w["facts"]) > 0, F.transform(w["facts"], lambda n: F.try_element_at(fields, n))).otherwise(F.map_values(fields))))
    formed, value, op = _formed(fact, w["form"]), w["value"], w["op"]
    leaves = F.transform(w["facts"], lambda n: F.lower(N.leaf(N.path_of_fact(F.try_element_at(fields, n)))))
    return (
        F.when(op == "eq", formed == value).when(op == "contains", F.contains(every, F.lower(value))).when(op == "within", F.contains(formed, value)).when(op == "eq_or_none", (fact == "") | (formed == value))
        .when(op == "path_or_leaf", (formed == value) | (~F.contains(value, F.lit("/")) & (N.leaf(formed) == value))).when(op == "path_or_any_leaf", (formed == value) | (N.leaf(formed) == N.leaf(value))).when(op == "any_leaf", F.array_contains(leaves, value))
        .when(op == "name", N.names_match(N.leaf(N.path_of_fact(fact)), value)).when(op == "at_least", F.coalesce(N.whole(fact), F.lit(0)) >= N.whole(value)).when(op == "flag", _flag(fact) == _flag(value)).when(op == "flag_if_true", F.coalesce(~_flag(value), F.lit(True)) | _flag(fact)).when(op == "enabled", _enabled(fact) == _flag(value))
        .when(op == "empty", fact == "").when(op == "type", F.lower("fact_type") == value).when(op == "tag", (F.lower(fact) == value) | F.startswith(F.lower(fact), F.concat(value, F.lit("_"))) | F.startswith(value, F.concat(F.lower(fact), F.lit("_"))))
    )


#: Fact types that show that a file was there.
FILE_FACTS = ("filesystem_listing_fact", "file_execution_fact", "appcompatcache_execution_fact", "lnk_execution_fact", "jumplist_fact", "string_artifact_fact")


def keyed(facts: DataFrame) -> DataFrame:
    """(index_name, key, fact_id, fact_type, fields): every fact under each of its keys."""
    made = computed(facts.select("fact_id", "fact_type", "fields"), path=N.path_of_fact(known("normalized_path", "path", "file_path", "target_path")), tag=F.lower(known("ttp_tag")))
    file, path = F.col("fact_type").isin(*FILE_FACTS), F.col("path")
    of = lambda kind, c: F.when(F.col("fact_type") == kind, c).otherwise("")
    number = lambda *n: F.coalesce(N.whole(known(*n)).cast("string"), F.lit(""))
    keys = {
        "by_pid": number("pid"), "by_ip": known("dst_ip", "ip", "remote_ip"), "by_port": known("dst_port", "port"), "by_hash": F.lower(known("sha1", "sha256", "hash")), "by_event_id": known("event_id"), "by_path": path, "by_registry_path": N.path_of_fact(known("registry_path")),
        "by_task_name": F.lower(known("task_name")), "by_service_name": F.lower(known("service_name")), "by_ttp_tag": F.col("tag"), "by_tag_head": F.regexp_extract("tag", "^([^_]*)", 1), "by_url_host": known("url_host"), "by_user": F.lower(known("user")), "by_fact_signature": F.col("fact_id"),
        "by_sid": of("srum_usage_fact", F.lower(known("sid"))), "by_app": of("srum_usage_fact", N.leaf(N.path_of_fact(known("normalized_path", "application_path", "application")))), "by_slot": of("ssdt_integrity_fact", number("index")),
        "by_tail": F.when(file, N.without_drive(path)).otherwise(""), "by_leaf": F.when(file, N.leaf(path)).otherwise(""), "by_name": F.when(F.col("fact_type").isin("process_fact", "psxview_fact"), F.substring(F.lower(known("process_name", "image_name", "name")), 1, 5)).otherwise(""), "all": F.col("fact_type"),
    }
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("index_name"), c.alias("key")) for n, c in keys.items())), lambda e: e["key"] != "")
    return made.select("fact_id", "fact_type", "fields", F.explode(entries).alias("e")).select("e.index_name", "e.key", "fact_id", "fact_type", "fields")


def _all_said(claim: Column) -> Column:
    """All that a claim says, in the order of its names."""
    return F.sort_array(F.map_entries(claim))


def content(claim: Column) -> Column:
    """128 bits of the SHA-256 of all that a claim says."""
    return F.unhex(F.substring(F.sha2(F.to_json(_all_said(claim)), 256), 1, 32))


def different(claims: DataFrame) -> DataFrame:
    """(content, claim) of ``claims`` (claim) that say something, each content once."""
    # whole contents are the key, so that tasks fold their own rows before the shuffle and nothing rests on a digest
    once = claims.select(_all_said(F.col("claim")).alias("told")).where("told IS NOT NULL").distinct()
    return once.select(F.map_from_entries("told").alias("claim")).select(content(F.col("claim")).alias("content"), "claim")


def asked(claims: DataFrame) -> DataFrame:
    """``claims`` (claim, and what else they have) with their type's rule: ``entries`` (its keys, '' left out), ``wanted`` (conditions that are asked, with ``value``), ``enough`` (whether the claim says enough)."""
    typed = computed(claims, type=F.try_element_at("claim", F.lit("type")))
    ruled = typed.join(F.broadcast(table(claims.sparkSession)), "type", "left")  # as many rows as types
    # a connection of process 0 is one whose process isn't told
    known_pid = lambda k, v: ~(k.isin(*_PID) & F.trim(v).isin("", "0"))
    claim = F.when(F.col("type") == "connection", F.map_filter("claim", known_pid)).otherwise(F.col("claim"))
    text = lambda x: F.when(x["const"] != "", x["const"]).otherwise(_first(claim, x["names"]))
    entries = F.transform(F.filter("keys", lambda k: _first(claim, k["unless"]) == ""), lambda k: F.struct(k["index_name"].alias("index_name"), F.when(k["const"] != "", k["const"]).otherwise(_formed(_first(claim, k["names"]), k["form"])).alias("key")))
    wanted = F.transform("wanted", lambda w: F.struct(w["op"].alias("op"), w["facts"].alias("facts"), w["form"].alias("form"), w["tells"].alias("tells"), w["alternative"].alias("alternative"), _formed(text(w), F.when(w["op"].isin("contains", "flag", "flag_if_true", "enabled", "at_least", "empty"), "raw").otherwise(w["form"])).alias("value")))
    long = F.forall("long", lambda n: (_first(claim, n["names"]) == "") | (F.length(_first(claim, n["names"])) >= n["least"]))
    enough = F.forall("needs", lambda n: _first(claim, n) != "") & long
    return computed(ruled, entries=F.filter(entries, lambda e: e["key"] != ""), wanted=F.filter(wanted, lambda w: (w["value"] != "") & ~((w["op"] == "at_least") & (w["value"] == "0")) & ~((w["op"] == "eq_or_none") & (w["value"] == "0"))), enough=F.coalesce(enough, F.lit(False)))


def check(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims`` (finding_id, claim_no, claim) with ``type`` and ``verdict``.

    Types without a rule, and claims that say too little, have no verdict.  Claims that differ meet the facts, by (index, key)
    only; each claim's pairs are folded before they are gathered, so a key with many facts costs their number, not their square.
    All claims get the verdict of their content.
    """
    none = F.lit(None).cast("string")
    ready = saved(asked(different(claims)).select("content", "claim", "type", "of", "entries", "wanted", "owner", "enough", "failing", "nothing", "unnamed"))
    n = ready.count()
    asking = ready.where("enough").select("content", "claim", "of", "wanted", "owner", F.explode("entries").alias("e")).select("*", "e.index_name", "e.key").drop("e")
    if n <= MOST_BROADCAST:
        asking = F.broadcast(asking)
    pairs = keyed(facts).join(asking, ["index_name", "key"]).where("size(of) = 0 OR array_contains(of, fact_type)")
    # the process: 2 agrees, 1 is not named, 0 is another
    made = computed(pairs, process=said(*_WHO), named=_first(F.col("fields"), F.col("owner")), results=F.transform("wanted", lambda w: F.struct(F.coalesce(_holds(w), F.lit(False)).alias("ok"), w["tells"].alias("tells"), w["alternative"].alias("alternative"), (w["tells"] & (_first(F.col("fields"), w["facts"]) == "")).alias("blind"))))
    some, strict = F.filter("results", lambda r: r["alternative"]), F.filter("results", lambda r: ~r["alternative"])
    either = (F.size(some) == 0) | F.exists(some, lambda r: r["ok"])
    name = F.when(F.col("fact_type") == "network_connection_fact", known("owner")).otherwise(known("process_name", "image_name"))
    judged = computed(made, who=F.when((F.col("process") == "") | (F.size("owner") == 0), 2).when(F.col("named") == "", 1).when(N.names_match(F.col("named"), F.col("process")), 2).otherwise(0), fits=either & F.forall(strict, lambda r: r["ok"]), base=either & F.forall(strict, lambda r: r["ok"] | r["tells"]), blind=F.exists("results", lambda r: r["blind"]), name=F.lower(name))
    judged = judged.select("content", "fact_id", "fact_type", "who", "fits", "base", "blind", "name", ((F.col("name") != "") & ~N.names_match(F.col("name"), F.col("process"))).alias("other"))
    of = lambda k, c: F.bool_or((F.col("who") == k) & c)
    folded = judged.groupBy("content").agg(
        *(F.bool_or(F.col("who") == k).alias(f"n{k}") for k in (0, 1, 2)), *(of(k, F.col(c)).alias(f"{c}{k}") for k in (1, 2) for c in ("fits", "base")), *(of(k, F.col("base") & ~F.col("blind")).alias(f"tells{k}") for k in (1, 2)),
        F.min(F.nullif("name", F.lit(""))).alias("least_name"), F.max(F.nullif("name", F.lit(""))).alias("last_name"), F.bool_or((F.col("name") != "") & ~F.col("other")).alias("same_name"), F.min_by("other", F.when(F.col("fits"), F.col("fact_id"))).alias("first_other"), F.bool_or("fits").alias("any_fits"),
        F.bool_or(F.col("fact_type") == "process_fact").alias("has_process"), F.bool_or(F.col("fact_type") == "process_relationship_fact").alias("has_parent"), F.bool_or((F.col("fact_type") == "process_relationship_fact") & F.col("fits")).alias("parent_fits"))
    found = ready.select("content", "claim", "type", "enough", "failing", "nothing", "unnamed").join(folded, "content", "left")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    of_class = lambda k: F.when(sure(f"fits{k}"), MATCH).when(sure(f"base{k}") & ~sure(f"tells{k}"), none).otherwise(F.col("failing"))
    both = F.when(sure("fits1") | sure("fits2"), MATCH).when((sure("base1") | sure("base2")) & ~(sure("tells1") | sure("tells2")), none).otherwise(F.col("failing"))
    plain = F.when(~(sure("n0") | sure("n1") | sure("n2")), F.col("nothing")).when(F.col("unnamed"), F.when(~(sure("n1") | sure("n2")), MISMATCH).otherwise(both)).when(sure("n2"), of_class(2)).when(sure("n0"), MISMATCH).otherwise(of_class(1))
    process = said(*_WHO)
    pid = F.when(F.col("least_name").isNull(), none).when((process == "") | sure("same_name") | (F.col("least_name") != F.col("last_name")), MATCH).otherwise(MISMATCH)
    connection = F.when(F.col("any_fits").isNull(), none).when(~F.col("any_fits"), MISMATCH).when((process != "") & sure("first_other"), MISMATCH).otherwise(MATCH)
    # who is whose parent is told by relationships alone, of processes that are known
    child = F.when(~(sure("has_process") & sure("has_parent")), none).when(sure("parent_fits"), MATCH).otherwise(MISMATCH)
    exists = F.when(sure("n2") & (N.whole(said("pid")).isNotNull() | sure("same_name")), MATCH)
    generic = (F.col("type") == "decoded_string") & F.lower(said(*_DECODED_TAG)).isin("", "decoded_string")
    out = F.when(~F.col("enough"), none).when(generic, MISMATCH).when(F.col("type") == "pid", pid).when(F.col("type") == "connection", connection).when(F.col("type") == "process_exists", exists).when(F.col("type") == "child_process", child).otherwise(plain)
    verdicts = saved(found.select("content", out.alias("verdict")))
    if n <= MOST_VERDICTS:
        verdicts = F.broadcast(verdicts)
    told = claims.select("finding_id", "claim_no", "claim", content(F.col("claim")).alias("content"))
    return told.join(verdicts, "content", "left").select("finding_id", "claim_no", "claim", F.try_element_at("claim", F.lit("type")).alias("type"), "verdict")


#: Claim types that are known without a check of their own.
UNCHECKED = ("timestamp",)


def finding_status(findings: DataFrame, checked: DataFrame, strict: bool = False) -> DataFrame:
    """(finding_id, status, n_checks, n_match) of every finding.

    A type that nobody knows leaves a finding UNRESOLVED; one MISMATCH fails it; it is a MATCH when all verdicts are (three at
    least if ``strict``), and UNRESOLVED without any.
    """
    kinds = [t for types in _rules() for t in types] + list(UNCHECKED)
    sums = checked.groupBy("finding_id").agg(
        F.bool_or(F.col("type").isNull() | ~F.col("type").isin(kinds)).alias("odd"), F.count("verdict").alias("n"), F.count_if(F.col("verdict") == MATCH).alias("m"), F.count_if(F.col("verdict") == MISMATCH).alias("w"))
    joined = findings.select("finding_id").distinct().join(sums, "finding_id", "left")
    status = F.when(F.coalesce("odd", F.lit(False)) | (F.coalesce("n", F.lit(0)) == 0), "UNRESOLVED").when(F.col("w") > 0, MISMATCH).when(F.lit(strict) & (F.col("m") < 3), MISMATCH).otherwise(MATCH)
    count = lambda c: F.when(F.coalesce("odd", F.lit(False)), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return joined.select("finding_id", status.alias("status"), count("n").alias("n_checks"), count("m").alias("n_match"))


def rescued(checked: DataFrame, statuses: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, index_name, key) of unresolved findings one of whose claims names an entity that some fact has: the first in the order of indexes."""
    order = ["by_pid", "by_ip", "by_port", "by_hash", "by_event_id", "by_path", "by_registry_path", "by_task_name", "by_service_name", "by_fact_signature"]
    blocked = checked.where("verdict IS NULL OR verdict <> 'MISMATCH'").join(statuses.where("status = 'UNRESOLVED'").select("finding_id"), "finding_id")
    # what a claim names is what a claim of a typed fact would look up
    as_typed = saved(blocked.select("finding_id", "claim_no", F.map_concat(F.map_filter("claim", lambda k, v: k != "type"), F.create_map(F.lit("type"), F.lit("typed_fact"))).alias("claim")))
    wanted = asked(different(as_typed)).select("content", F.explode("entries").alias("e")).select("content", "e.*")
    have = keyed(facts).select("index_name", "key").distinct()
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("index_name")).alias("n")
    first = wanted.join(have, ["index_name", "key"]).groupBy("content").agg(F.min(F.struct(rank, "index_name", "key")).alias("b"))
    told = as_typed.select("finding_id", "claim_no", content(F.col("claim")).alias("content"))
    return told.join(first, "content").groupBy("finding_id").agg(F.min(F.struct("claim_no", "b")).alias("c")).select("finding_id", "c.b.index_name", "c.b.key")
