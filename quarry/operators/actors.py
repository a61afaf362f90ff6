"""Who and when: the account and the time that a finding tells of, or that its processes' owners tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vocabulary as V

# Names that are no person's, the shapes of profile folders, accounts, process numbers and dates, and names of times.
NO_ACTORS = ["", "-", "system", "localsystem", "local service", "localservice", "network service", "networkservice", "public", "default", "default user", "defaultapppool", "all users"]
PROFILE = r"(?i)(?<![A-Za-z0-9])users[\\/]([^\\/]+)"
USER_SID = r"(?i)^S-1-5-21-\d+-\d+-\d+-(\d+)$"
PID_TOLD = r"(?i)\bpid[:= ]\s*(\d{1,7})\b"
DATE = r"(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)"
ACCOUNT_CLAIMS, ACCOUNT_NAMES = ["user_account", "user", "account"], ["username", "user", "account", "value"]
PID_NAMES = ["pid", "process_id", "parent_pid", "ppid"]
TIMES = ["timestamp", "time_created", "timecreated", "create_time", "createtime", "created", "first_run", "last_run", "lastrun", "execution_time", "event_time", "when", "time", "date"]


def person(name: Column) -> Column:
    """A name, trimmed, if it can be a person's account; else null."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(bare.rlike(V.USER_NAME) & ~F.lower(bare).isin(NO_ACTORS), bare)


def _first(texts: Column) -> Column:
    return F.try_element_at(F.array_compact(texts), F.lit(1))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def owners(sids: DataFrame) -> DataFrame:
    """(pid, user): the first person of rows (pid, sid, name, ordinal) that owns a process: accounts of numbers from 1000 on, and 500."""
    number = F.regexp_extract(F.trim("sid"), USER_SID, 1).try_cast("long")
    bare = F.regexp_extract(F.translate(F.trim("name"), "/", "\\"), r"([^\\]*)$", 1)
    known = sids.where((number >= 1000) | (number == 500)).select(F.trim(F.col("pid").cast("string")).alias("pid"), person(bare).alias("user"), "ordinal").where("user IS NOT NULL AND pid IS NOT NULL")
    return known.groupBy("pid").agg(F.min_by("user", "ordinal").alias("user"))


def labelled(findings: DataFrame, sids: DataFrame) -> DataFrame:
    """(finding_id, actor, at, label) of findings (finding_id, title, description, raw_excerpt, claims, timestamp, execution_context).

    The actor is the first that holds: an account that a claim names, a profile folder in a text, the owner of the least of the finding's process numbers
    that a person owns.  The time is the finding's own, a claim's, or the first date in a text.  ``label`` puts both together; without an actor it
    names the context in which the process ran.  What isn't known is ''.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    claims = F.coalesce("claims", F.array().cast("array<map<string,string>>"))
    told = findings.select("finding_id", claims.alias("claims"), some("timestamp").alias("own"), some("execution_context").alias("context"), F.array(some("title"), some("description"), some("raw_excerpt")).alias("prose"))
    texts = F.concat("prose", F.flatten(F.transform("claims", lambda c: F.map_values(c))))
    told = told.withColumn("texts", F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""))
    get = lambda c, n: F.try_element_at(c, F.lit(n))
    named = _first(F.flatten(F.transform(F.filter("claims", lambda c: F.lower(get(c, "type")).isin(ACCOUNT_CLAIMS)), lambda c: F.array(*(person(get(c, n)) for n in ACCOUNT_NAMES)))))
    housed = _first(F.transform("texts", lambda x: person(_found(x, PROFILE))))
    pids = F.array_distinct(F.concat(F.flatten(F.transform("claims", lambda c: F.array(*(_found(get(c, n), r"^([0-9]+)$") for n in PID_NAMES)))), F.flatten(F.transform("texts", lambda x: F.regexp_extract_all(x, F.lit(PID_TOLD), 1)))))
    when = F.coalesce(_found(F.col("own"), DATE), _first(F.flatten(F.transform("claims", lambda c: F.array(*(_found(get(c, n), DATE) for n in TIMES))))), _first(F.transform("texts", lambda x: _found(x, DATE))), F.lit(""))
    read = told.select("finding_id", "context", F.coalesce(named, housed).alias("named"), when.alias("at"), F.array_compact(pids).alias("pids"))
    owned = read.where("named IS NULL").select("finding_id", F.explode("pids").alias("pid")).join(owners(sids), "pid").groupBy("finding_id").agg(F.min_by("user", F.col("pid").try_cast("long")).alias("owner"))
    met = read.join(owned, "finding_id", "left").withColumn("actor", F.coalesce("named", "owner", F.lit("")))
    who = F.coalesce(F.nullif("actor", F.lit("")), F.nullif(F.trim("context"), F.lit("")))
    label = F.concat_ws(" · ", F.concat(F.lit("Who: "), who), F.when(F.col("at") != "", F.concat(F.lit("When: "), "at", F.lit(" UTC"))))
    return met.select("finding_id", "actor", "at", label.alias("label"))
