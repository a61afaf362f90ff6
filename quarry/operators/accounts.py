"""Accounts as entities: what many tools call a user, joined without ever joining two security identifiers.

Sightings name an account by domain, name and perhaps SID.  Entities are joined in three steps, each a star of aliases around one
target: names to the one SID they are seen with, names without domain to the one domain that has the name, and short (8.3)
names to the one long name that they can stand for.  In a star only aliases without a SID, or with the target's, join; where the
target has none, aliases with a SID join only if it is the same one.  So no chain of aliases leads from one SID to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vocabulary as V
from quarry.operators.corroborate import human
from quarry.operators.graph import saved

#: Columns of a sighting.
SIGHTING = ["tool", "domain", "name", "sid", "pid", "path", "event_id", "ordinal"]
PATHS = 5


def parsed(raw: Column) -> Column:
    """(domain, name) of ``DOMAIN\\name`` or a plain name, lower case; null for what can't be an account or is nobody's."""
    text = F.trim(raw)
    mark = F.when(F.contains(text, F.lit("\\")), F.lit("\\")).when(F.contains(text, F.lit("/")) & ~F.startswith(text, F.lit("/")), F.lit("/"))
    cut = F.when(mark.isNotNull(), F.instr(text, "\\")).otherwise(0)
    cut = F.when(mark == "/", F.instr(text, "/")).otherwise(cut)
    domain = F.lower(F.trim(F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(F.lit(""))))
    name = F.lower(F.trim(F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(text)))
    fine = name.rlike(V.USER_NAME) & ((domain == "") | domain.rlike(V.USER_NAME)) & ~name.isin(V.NO_USERS)
    return F.when(fine, F.struct(domain.alias("domain"), name.alias("name")))


def _as_sightings(df: DataFrame, tool: Column, **given: Column) -> DataFrame:
    kinds = {"sid": "string", "pid": "long", "path": "string", "event_id": "string", "ordinal": "long"}
    own = {c: given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()}
    return df.select(tool.alias("tool"), given["domain"].alias("domain"), given["name"].alias("name"), *own.values())


def in_paths(records: DataFrame, tool: str, columns: list[str], ordinal: str, pid: Column | None = None, pseudo: bool = True) -> DataFrame:
    """Sightings of the users whose profile folders ``columns`` of a tool's records name; ``pseudo`` tells whether folders of nobody count."""
    each = records.withColumn("_text", F.explode(F.array(*columns)))
    found = each.withColumn("_name", F.explode(F.transform(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(V.USER_FOLDER), 1), lambda n: F.lower(F.trim(n))))).where("_name <> ''")
    found = found if pseudo else found.where(~F.col("_name").isin(V.PSEUDO_USERS))
    return _as_sightings(found, F.lit(tool), domain=F.lit(""), name=F.col("_name"), path=F.substring(F.lower("_text"), 1, 160), ordinal=F.col(ordinal), pid=F.lit(None) if pid is None else pid)


def in_fields(records: DataFrame, tool: str, columns: list[str], ordinal: str, event_id: Column | None = None, sid: Column | None = None, pid: Column | None = None) -> DataFrame:
    """Sightings of the accounts that ``columns`` of a tool's records name, as ``DOMAIN\\name`` or plain."""
    none = F.lit(None)
    met = records.withColumn("_who", F.explode(F.array(*(parsed(F.col(c)) for c in columns)))).where("_who IS NOT NULL")
    account = F.when(human(sid), F.upper(F.trim(sid))) if sid is not None else none
    return _as_sightings(met, F.lit(tool), domain=F.col("_who.domain"), name=F.col("_who.name"), ordinal=F.col(ordinal), event_id=none if event_id is None else event_id, sid=account, pid=none if pid is None else pid)


def in_messages(records: DataFrame, tool: str, message: str, ordinal: str, event_id: Column | None = None) -> DataFrame:
    """Sightings of the accounts that messages tell, as XML data or as ``Account Name: ...``."""
    text = F.coalesce(message, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(V.XML_ACCOUNT), 2), F.regexp_extract_all(text, F.lit(V.TOLD_ACCOUNT), 1))
    return in_fields(records.withColumn("_told", F.explode(found)), tool, ["_told"], ordinal, event_id)


def _joined(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entities`` (entity, sid, root) after the ``aliases`` (entity, target) that may join did; targets are no aliases themselves."""
    sids = entities.select("entity", "sid")
    star = aliases.join(sids, "entity").join(sids.select(F.col("entity").alias("target"), F.col("sid").alias("target_sid")), "target")
    # what the star agrees on: the target's SID, or the only one that its aliases have
    one = star.groupBy("target").agg(F.first("target_sid").alias("own"), F.countDistinct("sid").alias("n"), F.max("sid").alias("only"))
    agreed = one.select("target", F.coalesce("own", F.when(F.col("n") == 1, F.col("only"))).alias("agreed"))
    fit = star.join(agreed, "target").where("sid IS NULL OR sid = agreed").select(F.col("entity").alias("root"), F.col("target").alias("to"), "agreed")
    moved = entities.join(fit, "root", "left")
    made = moved.select("entity", F.coalesce("sid", "agreed").alias("sid"), F.coalesce("to", "root").alias("root"))
    # a target takes over the SID of the aliases that joined it
    given = fit.groupBy("to").agg(F.max("agreed").alias("given")).withColumnRenamed("to", "root")
    return saved(made.join(given, "root", "left").select("entity", F.coalesce("sid", "given").alias("sid"), "root"))


def resolved(sightings: DataFrame) -> DataFrame:
    """(domain, name, seen_sid, account, sid) of every identity and SID seen together: the account it belongs to, and that account's SID.

    An identity seen with several SIDs stays apart from all of them where no SID is told.
    """
    keys = saved(sightings.select("domain", "name", "sid").distinct())
    label = lambda d, n: F.concat(F.lit("name:"), F.when(F.col(d) != "", F.concat(F.col(d), F.lit("\\"))).otherwise(F.lit("")), F.col(n))
    named = keys.groupBy("domain", "name").agg(F.countDistinct("sid").alias("n_sids"), F.max("sid").alias("only"))
    # an identity with one SID is that SID's; with several, its sightings without SID are an entity of their own
    names = saved(named.select("domain", "name", F.when(F.col("n_sids") == 1, F.concat(F.lit("sid:"), "only")).otherwise(label("domain", "name")).alias("entity"), F.when(F.col("n_sids") == 1, F.col("only")).alias("sid"), (F.col("n_sids") > 1).alias("torn")))
    seen = keys.where("sid IS NOT NULL").select(F.concat(F.lit("sid:"), "sid").alias("entity"), "sid")
    entities = saved(names.select("entity", "sid").union(seen).distinct().withColumn("root", F.col("entity")))
    whole = names.where("NOT torn")
    # names without domain
    homes = whole.where("domain <> ''").groupBy("name").agg(F.countDistinct("entity").alias("n"), F.max("entity").alias("target")).where("n = 1")
    bare = whole.where("domain = ''").join(homes, "name").where("entity <> target").select("entity", "target").distinct()
    step = _joined(entities, bare.join(bare.select(F.col("target").alias("entity")), "entity", "left_anti"))
    # short names
    at = whole.join(step.select("entity", "root"), "entity").select("domain", "name", F.col("root").alias("entity"))
    stem = F.upper(F.substring(F.regexp_replace("name", r"[^A-Za-z0-9$%'_@{}!#()&^-]", ""), 1, 6))
    long = at.where(~F.contains("name", F.lit("~"))).groupBy("domain", stem.alias("stem")).agg(F.countDistinct("name").alias("n"), F.max("entity").alias("target")).where("n = 1")
    short = at.select("domain", "entity", F.when(F.regexp_extract("name", V.SHORT_NAME, 2).try_cast("long") == 1, F.upper(F.regexp_extract("name", V.SHORT_NAME, 1))).alias("stem")).where("stem <> ''")
    pairs = short.join(long, ["domain", "stem"]).where("entity <> target").groupBy("entity").agg(F.min("target").alias("target"), F.countDistinct("target").alias("k")).where("k = 1").drop("k")
    pairs = saved(pairs)
    last = _joined(step, pairs.join(pairs.select(F.col("target").alias("entity")), "entity", "left_anti"))
    entity = F.when(F.col("k.sid").isNotNull(), F.concat(F.lit("sid:"), "k.sid")).otherwise(F.col("n.entity"))
    found = keys.alias("k").join(names.alias("n"), ["domain", "name"]).select("domain", "name", F.col("k.sid").alias("seen_sid"), entity.alias("entity"))
    ends = last.join(last.select(F.col("entity").alias("root"), F.col("sid").alias("root_sid")), "root").select("entity", F.col("root").alias("account"), F.coalesce("root_sid", "sid").alias("sid"))
    return found.join(ends, "entity").select("domain", "name", "seen_sid", "account", "sid")


def accounts(sightings: DataFrame) -> DataFrame:
    """One row an account: account, domain, username, sid, names, source_tools, n_pids, paths, event_count, n_privileged, script_count, remote_count.

    The first long name by name stands for the account.  Processes count only where they are seen with the account's SID, or where it has none:
    a short name's processes must not become another's.  ``paths`` has the least few.  Null SIDs are unknown.
    """
    who = saved(resolved(sightings))
    met = sightings.withColumnRenamed("sid", "seen_sid").alias("s").join(who.alias("w"), (F.col("s.domain") == F.col("w.domain")) & (F.col("s.name") == F.col("w.name")) & F.col("s.seen_sid").eqNullSafe(F.col("w.seen_sid"))).select("s.*", "w.account", "w.sid")
    of = lambda tools: F.sum(F.col("tool").isin(tools).cast("long"))
    mine = F.when(F.col("seen_sid").eqNullSafe(F.col("sid")), F.col("pid"))
    shown = F.min(F.struct(F.contains("name", F.lit("~")), F.col("domain") == "", "domain", "name")).alias("first")
    sums = met.groupBy("account").agg(
        shown, F.max("sid").alias("sid"), F.array_sort(F.collect_set("tool")).alias("source_tools"), F.countDistinct(mine).alias("n_pids"), of(["parse_event_logs"]).alias("event_count"),
        F.sum((F.trim("event_id") == "4672").cast("long")).alias("n_privileged"), of(["parse_powershell_transcripts"]).alias("script_count"), of(["parse_rdp_artifacts"]).alias("remote_count"))
    names = who.groupBy("account").agg(F.array_sort(F.collect_set(F.when(F.col("domain") != "", F.concat("domain", F.lit("\\"), "name")).otherwise(F.col("name")))).alias("names"))
    from pyspark.sql.window import Window

    few = met.where("path IS NOT NULL").select("account", "path").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("account").orderBy("path"))).where(F.col("_r") <= PATHS)
    paths = few.groupBy("account").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    out = sums.join(names, "account").join(paths, "account", "left")
    return out.select("account", "first.domain", F.col("first.name").alias("username"), "sid", "names", "source_tools", "n_pids", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "event_count", F.coalesce("n_privileged", F.lit(0)).alias("n_privileged"), "script_count", "remote_count")


def strict(found: DataFrame, sightings: DataFrame, bad_pids: DataFrame, suspicious: DataFrame, least: int = 3) -> DataFrame:
    """(account, passes, n_bad_pids) of ``accounts``: whether an account may be called compromised without doubt.

    It ran a suspicious script (``suspicious`` (domain, name)), its SID owns a process of a confirmed finding (``bad_pids`` (pid)), or it was granted
    special privileges ``least`` times.  A profile folder in a path is not enough.
    """
    who = saved(resolved(sightings))
    owned = sightings.where("sid IS NOT NULL").join(bad_pids.select("pid").distinct(), "pid", "left_semi").withColumnRenamed("sid", "seen_sid")
    bad = owned.join(who.where("seen_sid IS NOT NULL").select("seen_sid", "account").distinct(), "seen_sid").groupBy("account").agg(F.countDistinct("pid").alias("n_bad_pids"))
    script = suspicious.join(who.select("domain", "name", "account"), ["domain", "name"]).select("account").distinct().withColumn("script", F.lit(True))
    met = found.join(bad, "account", "left").join(script, "account", "left")
    n = F.coalesce("n_bad_pids", F.lit(0))
    return met.select("account", (F.coalesce("script", F.lit(False)) | (n > 0) | (F.col("n_privileged") >= least)).alias("passes"), n.alias("n_bad_pids"))
