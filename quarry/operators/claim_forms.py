"""Claims as they are told, brought into the form that checks expect.

Each step rewrites a claim's map by what is there and by the shape of its texts: names of types, values under other names,
claims of paths that really name an event, a privilege, a peer, a service or a process, and the names that each type's check reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions.columns import computed

# Other names of types, types whose check reads a value, names under which a value may stand, and shapes of texts.
TYPE_ALIASES = {"process": "pid", "network": "connection", "execution": "timestamp", "file": "hash", "port": "connection", "ip": "connection", "address": "connection", "artifact": "path", "raw": "path"}
VALUE_TYPES = ["path", "artifact", "raw", "hash", "connection", "url", "event_log", "srum_usage", "typed_fact"]
VALUE_NAMES = ["registry_path", "key", "url", "path", "file", "filename", "name", "text", "artifact"]
EVENT_ID = r"(?i)\bevent\s*(?:id)?\s*[:#]?\s*(\d{1,5})\b"
PRIVILEGE = r"\bSe[A-Z][A-Za-z]{2,}(?:Privilege)?\b"
PROCESS_FILE = r"(?i)\b([A-Za-z0-9_.\-]+\.exe)\b"
BARE_TOKEN = r"^[A-Za-z][A-Za-z0-9_\-]{2,31}$"
LEADING_TOKEN = r"^([A-Za-z][A-Za-z0-9_.\-]{2,31})\b"
IPV4 = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
NETWORK_CUE = r"(?i)\b(?:peer|ip|external|connection|c2|netscan|address|remote|inbound|outbound|egress|beacon|host)\b"
PROCESS_CUES = ["process", "psxview", "pslist", "view", "hiding", "hidden", "persistence"]
LOOSE = ["path", "raw", "artifact"]


def _get(name: str) -> Column:
    """A claim's text under a name as it is; '' without one."""
    return F.coalesce(F.try_element_at("claim", F.lit(name)), F.lit(""))


def _first(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(_get(n)), F.lit("")) for n in names), F.lit(""))


def _type() -> Column:
    return _get("type")


def _put(values: dict[str, Column], drop: tuple[str, ...] = ()) -> Column:
    """The claim with these texts in place of what it has under their names (null ones change nothing), and without others."""
    new = F.map_filter(F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v.cast("string")))), lambda k, v: v.isNotNull())
    kept = F.map_filter("claim", lambda k, v: ~F.map_contains_key(new, k) & ~k.isin(list(drop) or [""]))
    return F.map_concat(kept, new)


def _absent(name: str, value: Column) -> Column:
    """``value`` where the claim has nothing under a name."""
    return F.when(~F.map_contains_key("claim", name), value)


def _step(df: DataFrame, when: Column, values: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    return computed(df, claim=F.when(F.coalesce(when, F.lit(False)), _put(values, drop)).otherwise(F.col("claim")))


def _renamed(df: DataFrame, when: Column, old: str, new: str) -> DataFrame:
    """Text under ``old`` goes to ``new`` if nothing is there."""
    return _step(df, when & F.map_contains_key("claim", old) & ~F.map_contains_key("claim", new), {new: _get(old)}, (old,))


def _ipv4(text: Column) -> Column:
    """The first four numbers up to 255 of a text; null without any."""
    return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(IPV4), 1), lambda ip: F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255)), F.lit(1))


def _loose(df: DataFrame) -> DataFrame:
    """Claims of paths that are claims of something else by their texts."""
    loose = _type().isin(LOOSE)
    plain = lambda c: ~F.lower(c).rlike(r"/|\\|\.exe")
    number = lambda n: F.when(plain(_get(n)), F.nullif(F.regexp_extract(_get(n), EVENT_ID, 1), F.lit("")))
    event = F.coalesce(number("value"), number("artifact"))
    df = _step(df, _type().isin("path", "raw") & (_get("event_id") == "") & event.isNotNull(), {"type": F.lit("event_log"), "event_id": event.cast("int")})
    said = F.concat_ws(" ", *(_get(n) for n in ("value", "artifact", "text", "name", "title")))
    low, named = F.lower(said), F.regexp_extract(said, PRIVILEGE, 0)
    program = F.nullif(F.regexp_extract(said, PROCESS_FILE, 1), F.lit(""))
    df = _step(df, loose & (named != "") & low.rlike("privileg|enabled|disabled"), {
        "type": F.lit("process_privilege_enabled"), "privilege_name": _absent("privilege_name", named), "process": F.when(_get("process") == "", program), "enabled": _absent("enabled", F.when(F.contains(low, F.lit("disabled")), "false").otherwise("true"))})
    told = F.concat_ws(" ", *(_get(n) for n in ("value", "artifact", "text", "name")))
    ip = _ipv4(told)
    df = _step(df, loose & (_get("foreign_addr") == "") & ip.isNotNull() & ((F.trim(_get("value")) == ip) | told.rlike(NETWORK_CUE)), {"type": F.lit("connection"), "foreign_addr": ip, "value": _absent("value", ip)})
    lead = lambda n: F.regexp_extract(F.trim(_get(n)), LEADING_TOKEN, 1)
    owner = F.coalesce(*(F.when((lead(n) != "") & ~lead(n).rlike("^" + PRIVILEGE), lead(n)) for n in ("value", "artifact", "text", "name")))
    nobody = (_get("process") == "") & (_get("process_name") == "") & (_get("pid") == "")
    df = _step(df, _type().isin("process_privilege", "process_privilege_enabled") & nobody & owner.isNotNull(), {"process": owner})
    token = F.trim(_get("value"))
    bare = loose & F.map_contains_key("claim", "value") & token.rlike(BARE_TOKEN)
    about = F.lower(F.concat_ws(" ", F.coalesce("context", F.lit("")), _get("artifact")))
    service = F.contains(about, F.lit("service"))
    df = _step(df, bare & service, {"type": F.lit("service"), "service_name": _absent("service_name", token), "rescued_from": F.lit("bare_token_path")})
    return _step(df, bare & ~service & about.rlike("|".join(PROCESS_CUES)), {"type": F.lit("process_exists"), "process": _absent("process", token), "rescued_from": F.lit("bare_token_path")})


def normalised(claims: DataFrame) -> DataFrame:
    """(finding_id, claim_no, claim) of claims (finding_id, claim_no, claim, context) in the form that checks expect.

    ``context`` is the finding's own prose.  Left out are null claims, claims of a process whose number is none, and connections without process and
    peer.  A text that is there is never overwritten, but for names that give way to others.
    """
    base = lambda c: F.regexp_extract(F.translate(c, "/", "\\"), r"([^\\]*)$", 1)
    df = claims.where("claim IS NOT NULL").select("finding_id", "claim_no", "claim", F.lower(F.coalesce("context", F.lit(""))).alias("context"))
    alias = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    df = _step(df, F.map_contains_key(alias, _type()), {"type": F.try_element_at(alias, _type())})
    has_value = F.trim(_get("value")) != ""
    df = _step(df, (_get("event_id") != "") & _type().isin(LOOSE), {"type": F.lit("event_log"), "value": F.when(~has_value, F.concat(F.lit("Event "), F.trim(_get("event_id"))))})
    df = _step(df, ~has_value & _type().isin(VALUE_TYPES) & (_first(*VALUE_NAMES) != ""), {"value": _first(*VALUE_NAMES)})
    df = _loose(df)
    is_ = lambda t: _type() == t
    whole = N.whole(_get("pid"))
    df = _renamed(df, is_("pid"), "process_name", "process")
    df = _step(df, is_("pid") & F.map_contains_key("claim", "process"), {"process": base(_get("process"))})
    df = df.where(~F.coalesce(is_("pid") & F.map_contains_key("claim", "pid") & whole.isNull(), F.lit(False)))
    for old, new in (("hash", "sha1"), ("path", "filename"), ("file", "filename")):
        df = _renamed(df, is_("hash"), old, new)
    df = _step(df, is_("hash") & F.map_contains_key("claim", "filename"), {"filename": base(_get("filename"))})
    df = computed(df, claim=F.when(is_("connection") & whole.isNull(), F.map_filter("claim", lambda k, v: k != "pid")).otherwise(F.col("claim")))
    peer = _first("foreign_addr", "remote_addr", "foreign_ip", "remote_ip", "foreign")
    df = df.where(~F.coalesce(is_("connection") & (F.coalesce(whole, F.lit(0)) == 0) & (peer == ""), F.lit(False)))
    for old, new in (("process_name", "process"), ("foreign_ip", "foreign_addr"), ("remote_addr", "foreign_addr"), ("remote_ip", "foreign_addr"), ("remote_port", "foreign_port")):
        df = _renamed(df, is_("connection"), old, new)
    ends = _get("foreign")
    colons = F.length(ends) - F.length(F.replace(ends, F.lit(":"), F.lit("")))
    six = F.startswith(ends, F.lit("[")) & F.contains(ends, F.lit("]:"))
    address = F.when(six, F.concat(F.substring_index(ends, "]:", 1), F.lit("]"))).when(colons == 1, F.nullif(F.substring_index(ends, ":", 1), F.lit(""))).when((colons == 0) & (ends != ""), ends)
    port = F.when(six, F.substring_index(ends, "]:", -1)).when((colons == 1) & address.isNotNull(), F.substring_index(ends, ":", -1)).try_cast("int")
    df = _step(df, is_("connection") & F.map_contains_key("claim", "foreign") & ~F.map_contains_key("claim", "foreign_addr"), {"foreign_addr": address, "foreign_port": port}, ("foreign",))
    df = _renamed(df, is_("timestamp"), "value", "timestamp")
    df = _step(df, is_("path") & (_get("value") == "") & (_first("artifact", "path", "filename") != ""), {"value": F.coalesce(*(F.when(F.trim(_get(n)) != "", _get(n)) for n in ("artifact", "path", "filename")))})
    return df.select("finding_id", "claim_no", "claim")
