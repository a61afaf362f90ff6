"""One thing, one verdict: identities of findings, deduplication, and reconciliation across buckets.

Findings that share an identity are joined by connected components; groups are folded by key before anything is joined back, so a key that
many findings share costs its number of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalise as N
from quarry.functions.columns import computed

from .disposition import BENIGN, CONFIRMED, INCONCLUSIVE, INJECTION_TOOLS, REVIEW, SYNTHESIS
from .graph import connected_components

HASHES, PATHS = ["sha1", "sha256", "md5", "hash"], ["value", "path", "artifact", "file"]
NAMED = ["value", "name", "path", "registry_path", "registry_key", "key", "artifact"]
HASH = "^[a-fA-F0-9]{32}(?:[a-fA-F0-9]{8})?(?:[a-fA-F0-9]{24})?$"
EXECUTABLE = r"(?i)\.(?:exe|dll|sys|ps1|scr)$"
HIVE = "^(?:hklm|hkcu|hku|hkcr|hkey[_a-z]*)\\b"
LABELLED_HIVE = "^[a-z ]{1,40}?\\b((?:hklm|hkcu|hku|hkcr|hkey[_a-z]*)\\b.*)$"


def _of(claim: Column, name: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at(claim, F.lit(name))), F.lit(""))


def _each(names: list[str], make) -> Column:
    """What ``make`` gives for the texts of these names of all claims, without nulls."""
    return F.array_compact(F.flatten(F.transform("claims", lambda c: F.array(*(make(_of(c, n)) for n in names)))))


def exact_keys() -> Column:
    """Identities of a finding (claims, source_tools, raw_excerpt, seen_at, artifact): hashes, full paths of executables with and without drive,
    registry keys, events (number, second, address), services, and processes with their whole behaviour."""
    path = lambda v: F.when(v.rlike(EXECUTABLE) & F.contains(N.path_of_dedup(v), F.lit("/")), F.concat(F.lit("p:"), N.path_of_dedup(v)))
    bare = lambda v: F.when(v.rlike(EXECUTABLE) & F.contains(N.without_drive(N.path_of_dedup(v)), F.lit("/")), F.concat(F.lit("p:"), N.without_drive(N.path_of_dedup(v))))
    key = lambda v: F.when(N.path_of_dedup(v).rlike(HIVE), N.path_of_dedup(v)).otherwise(F.regexp_extract(N.path_of_dedup(v), LABELLED_HIVE, 1))
    deep = lambda v: F.when(F.length(F.regexp_replace(key(v), "[^/]", "")) >= 3, F.concat(F.lit("r:"), key(v)))
    at = N.time_second(F.coalesce("seen_at", F.lit("")))
    at = F.when(at != "", at).otherwise(N.time_second("artifact"))
    address = F.when(F.coalesce(F.trim("artifact"), F.lit("")).rlike(N.QUAD), F.trim("artifact")).otherwise("")
    events = F.when(at != "", F.transform(_each(["event_id"], lambda v: F.nullif(v, F.lit(""))), lambda e: F.concat(F.lit("evt:"), F.concat_ws("|", e, at, address))))
    service = lambda v: F.when(v.rlike("^[A-Za-z][A-Za-z0-9_.$-]{1,39}$"), F.concat(F.lit("svc:"), F.lower(v)))
    texts = F.concat(_each(NAMED, lambda v: F.nullif(v, F.lit(""))), F.array(F.coalesce("raw_excerpt", F.lit(""))))
    tail = F.transform(texts, lambda v: F.regexp_extract(N.path_of_dedup(v), r"/services/([a-z][a-z0-9_.$-]{1,39})(?:/|$)", 1))
    spoken = F.transform(texts, lambda v: F.lower(F.regexp_extract(v, r"(?i)service\s*name\s*[:|]\s*([A-Za-z][A-Za-z0-9_.$-]{1,39})", 1)))
    services = F.concat(_each(["service_name", "service"], service), F.transform(F.filter(F.concat(tail, spoken), lambda s: (F.length(s) >= 2) & ~s.rlike("^[0-9]+$")), lambda s: F.concat(F.lit("svc:"), s)))
    sorted_set = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(a, lambda x: x != ""))), ",")
    of_all = lambda n: F.transform("claims", lambda c: F.lower(_of(c, n)))
    injected = F.arrays_overlap(F.transform("source_tools", lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, INJECTION_TOOLS)))
    peers = sorted_set(F.transform("claims", lambda c: F.when(N.public_by_octets(_of(c, "dst_ip")), _of(c, "dst_ip")).otherwise("")))
    whole = F.concat(F.lit("|t:"), sorted_set(of_all("ttp_tag")), F.lit(";c:"), sorted_set(of_all("type")), F.lit("|inj:"), F.when(injected, "1").otherwise("0"), F.lit("|peers:"), peers)
    name = lambda c: F.lower(F.coalesce(F.nullif(_of(c, "process"), F.lit("")), _of(c, "process_name")))
    processes = F.array_compact(F.transform("claims", lambda c: F.when((_of(c, "pid") != "") & (name(c) != ""), F.concat(F.lit("proc:"), name(c), F.lit("|"), _of(c, "pid"), whole))))
    hashes = _each(HASHES, lambda v: F.when(v.rlike(HASH), F.concat(F.lit("h:"), F.lower(v))))
    parts = (hashes, _each(PATHS, path), _each(PATHS, bare), _each(NAMED, deep), F.coalesce(events, F.array().cast("array<string>")), services, processes)
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _grouped(keyed: DataFrame) -> DataFrame:
    """(finding_id, group) of the findings that share keys with others; ``keyed`` has (finding_id, keys)."""
    pairs = keyed.select("finding_id", F.explode("keys").alias("key"))
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    edges = pairs.join(shared, "key").select(F.concat(F.lit("f"), F.col("finding_id").cast("string")).alias("a"), F.concat(F.lit("k"), F.col("key")).alias("b"))
    names = keyed.select("finding_id", F.concat(F.lit("f"), F.col("finding_id").cast("string")).alias("node"))
    return names.join(connected_components(edges), "node").select("finding_id", F.col("component").alias("group"))


def dedup_within(findings: DataFrame, bucket: str) -> DataFrame:
    """(finding_id, merged_into) of the findings of a bucket that give way to one with the same identity: of most tools, then most claims, then the least id.

    ``findings`` has finding_id, bucket, keys, n_tools, n_claims.
    """
    own = findings.where(F.col("bucket") == bucket)
    placed = own.join(_grouped(own.select("finding_id", "keys")), "finding_id")
    best = placed.groupBy("group").agg(F.min_by("finding_id", F.struct(-F.col("n_tools"), -F.col("n_claims"), F.col("finding_id"))).alias("merged_into"))
    return placed.join(best, "group").where("finding_id <> merged_into").select("finding_id", "merged_into")


def dedup_across(findings: DataFrame, absorb_benign: bool = True) -> DataFrame:
    """(finding_id, from_bucket, merged_into, into_bucket) of findings whose identity stands in a higher bucket too: confirmed, then review, then (if absorbed) benign.

    Groups within one bucket are left alone.
    """
    order = [CONFIRMED, REVIEW, *([BENIGN] if absorb_benign else [])]
    rank = F.create_map(*(x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))))
    own = findings.where(F.col("bucket").isin(order)).withColumn("rank", rank[F.col("bucket")])
    placed = own.join(_grouped(own.select("finding_id", "keys")), "finding_id")
    best = placed.groupBy("group").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min_by(F.struct("finding_id", "bucket"), F.struct("rank", -F.col("n_tools"), -F.col("n_claims"), F.col("finding_id"))).alias("b")).where("low < high")
    return placed.join(best.select("group", F.col("b.finding_id").alias("merged_into"), F.col("b.bucket").alias("into_bucket")), "group").where("finding_id <> merged_into").select("finding_id", F.col("bucket").alias("from_bucket"), "merged_into", "into_bucket")


def title_shape(title: Column) -> Column:
    """A title without numbers, hashes and signs; '' below three words."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"\b(?:pid|sha1|sha256|md5|ppid)\b[:\s]*[0-9a-f]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\b0x[0-9a-f]+\b|\b[0-9a-f]{8,}\b", " "), "[0-9]+", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z ]+", " "), r"\s+", " "))
    return F.when(F.size(F.split(t, " ")) >= 3, t).otherwise("")


def reconcile_titles(findings: DataFrame) -> DataFrame:
    """(finding_id, from_bucket, to_bucket) of findings whose title's shape stands in several buckets: all but confirmed ones and narratives go to the most careful bucket of the group.

    A confirmed sibling lifts benign and inconclusive groups to review.
    """
    shaped = findings.withColumn("shape", title_shape(F.col("title"))).where("shape <> ''")
    has = lambda b: F.bool_or(F.col("bucket") == b)
    groups = shaped.groupBy("shape").agg(F.countDistinct("bucket").alias("n"), has(CONFIRMED).alias("c"), has(REVIEW).alias("r"), has(INCONCLUSIVE).alias("i"), has(BENIGN).alias("b")).where("n > 1")
    target = F.when(F.col("r"), REVIEW).when((F.col("i") | F.col("b")) & F.col("c"), REVIEW).when(F.col("i"), INCONCLUSIVE).when(F.col("b"), BENIGN).otherwise(REVIEW)
    moved = shaped.join(groups.select("shape", target.alias("to_bucket")), "shape").where(~F.col("bucket").isin(CONFIRMED, SYNTHESIS) & (F.col("bucket") != F.col("to_bucket")))
    return moved.select("finding_id", F.col("bucket").alias("from_bucket"), "to_bucket")


def _by_key(findings: DataFrame, *aggregates: Column) -> DataFrame:
    """Findings exploded by key, each with its key's aggregates."""
    pairs = findings.withColumn("key", F.explode("keys"))
    return pairs.join(pairs.groupBy("key").agg(*aggregates), "key")


def escalate(findings: DataFrame) -> DataFrame:
    """(finding_id, key): benign findings that share a key with one elsewhere go to review; adjudicated ones only if that one is confirmed. ``key`` is the least such."""
    scoped = findings.where(F.col("bucket").isin(CONFIRMED, REVIEW, INCONCLUSIVE, BENIGN))
    met = _by_key(scoped, F.bool_or(F.col("bucket") != BENIGN).alias("elsewhere"), F.bool_or(F.col("bucket") == CONFIRMED).alias("confirmed"))
    each = met.where((F.col("bucket") == BENIGN) & F.col("elsewhere")).groupBy("finding_id").agg(F.min("key").alias("key"), F.bool_or("confirmed").alias("confirmed"), F.bool_or("adjudicated").alias("adjudicated"))
    return each.where(~F.col("adjudicated") | F.col("confirmed")).select("finding_id", "key")


def demote_weak(findings: DataFrame) -> DataFrame:
    """``findings`` whose confirmed ones of low severity and low confidence went to review (``demoted``)."""
    weak = (F.col("bucket") == CONFIRMED) & F.upper(F.trim("severity")).isin("LOW", "INFO", "INFORMATIONAL") & F.upper(F.trim("confidence")).isin("LOW", "SPECULATIVE")
    weak = F.coalesce(weak, F.lit(False))
    return findings.withColumns({"demoted": weak, "bucket": F.when(weak, REVIEW).otherwise(F.col("bucket"))})


def settle_split(findings: DataFrame) -> DataFrame:
    """(finding_id, from_bucket, to_bucket) where an entity stands both in the benign table and in the findings' table.

    With strong benign and no strong malicious evidence, siblings without own malice go to benign and confirmed ones to review; else
    weak benign and inconclusive siblings go to review.  Review wins over benign for findings of several entities.
    """
    scoped = findings.where(F.col("bucket").isin(CONFIRMED, REVIEW, INCONCLUSIVE, BENIGN))
    table = F.col("bucket").isin(CONFIRMED, REVIEW)
    met = _by_key(scoped, F.bool_or(F.col("bucket") == BENIGN).alias("low"), F.bool_or(table).alias("high"), F.bool_or("malice").alias("any_malice"), F.bool_or("strong_benign").alias("any_benign")).where("low AND high")
    wins = F.col("any_benign") & ~F.col("any_malice")
    asked = F.when(wins & table & ~F.col("malice"), F.when(F.col("bucket") == CONFIRMED, REVIEW).otherwise(BENIGN)).when(~wins & F.col("bucket").isin(BENIGN, INCONCLUSIVE) & ~F.col("strong_benign"), REVIEW)
    each = met.select("finding_id", "bucket", asked.alias("asked")).where("asked IS NOT NULL").groupBy("finding_id", "bucket").agg(F.bool_or(F.col("asked") == REVIEW).alias("review"))
    return each.select("finding_id", F.col("bucket").alias("from_bucket"), F.when(F.col("review"), REVIEW).otherwise(BENIGN).alias("to_bucket")).where("from_bucket <> to_bucket")


def ledger(records: DataFrame) -> DataFrame:
    """One row an entity of verdict records (entity_key, scope, verdict, finding_id): sorted verdicts and the number of findings. Unknown verdicts are left out."""
    known = records.where(F.col("verdict").isin("malicious", "benign", "inconclusive"))
    flags = known.groupBy("entity_key", "scope").agg(*(F.bool_or(F.col("verdict") == v).alias(v) for v in ("malicious", "benign", "inconclusive")), F.countDistinct("finding_id").alias("n_findings"))
    return flags


def contradictions(book: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_key, scope, conflict_type, routing_decision) of a ``ledger``.

    Direct: malicious beside benign or inconclusive on one entity.  Tension: a malicious chain (``members``: chain_key, entity_key) has a process that
    was called benign or inconclusive and is in no direct conflict.
    """
    mild = F.col("benign") | F.col("inconclusive")
    routed = F.when(F.col("scope").isin("process", "file", "network"), "blocked_from_confirmed_atomic").otherwise("flagged_for_review")
    direct = book.where(F.col("malicious") & mild).select("entity_key", "scope", F.lit("direct_entity_verdict_conflict").alias("conflict_type"), routed.alias("routing_decision"))
    chains = book.where((F.col("scope") == "chain") & F.col("malicious")).select(F.col("entity_key").alias("chain_key"))
    tense = members.join(chains, "chain_key", "left_semi").select("entity_key").distinct().join(book.where((F.col("scope") == "process") & mild & ~F.col("malicious")), "entity_key")
    return direct.unionByName(tense.select("entity_key", "scope", F.lit("chain_member_tension").alias("conflict_type"), F.lit("blocked_from_confirmed_atomic").alias("routing_decision")))


def contradiction_routes(findings: DataFrame, book: DataFrame) -> DataFrame:
    """(finding_id, action) of findings in movable buckets that touch an entity of the ledger ``book``.

    Mixed entities lead to review; benign-only ones to benign, unless the finding also touches a malicious-only entity (then review); malicious-only
    ones stay, and so do findings whose split is justified.
    """
    marks = book.where("malicious OR benign").select(F.col("entity_key").alias("key"), (F.col("malicious") & F.col("benign")).alias("mixed"), (F.col("benign") & ~F.col("malicious")).alias("good"), (F.col("malicious") & ~F.col("benign")).alias("bad"))
    movable = findings.where(F.col("bucket").isin(CONFIRMED, REVIEW, BENIGN)).select("finding_id", "bucket", "split_justified", F.explode("keys").alias("key"))
    each = movable.join(marks, "key").groupBy("finding_id", "bucket", "split_justified").agg(*(F.bool_or(c).alias(c) for c in ("mixed", "good", "bad")))
    here = F.col("bucket") == REVIEW
    action = (
        F.when(F.col("split_justified"), "preserve_split_justified").when(F.col("mixed"), F.when(here, "already_review_mixed_entity").otherwise("move_to_review_mixed_entity"))
        .when(F.col("good") & F.col("bad"), F.when(here, "already_review_refuted_subset").otherwise("move_to_review_refuted_subset"))
        .when(F.col("good"), F.when(F.col("bucket") == BENIGN, "already_benign").otherwise("move_to_benign_refuted_entity")).otherwise("preserve_pure_malicious_entity")
    )
    return each.select("finding_id", action.alias("action"))


def benign_only_demotions(findings: DataFrame, book: DataFrame) -> DataFrame:
    """(finding_id, key) of confirmed findings with a process that was only ever called benign, and none called malicious."""
    marks = book.where("scope = 'process'").select(F.col("entity_key").alias("key"), "benign", "malicious")
    each = findings.where(F.col("bucket") == CONFIRMED).select("finding_id", F.explode("keys").alias("key")).join(marks, "key").groupBy("finding_id").agg(F.min(F.when(F.col("benign") & ~F.col("malicious"), F.col("key"))).alias("key"), F.bool_or("malicious").alias("bad"))
    return each.where(F.col("key").isNotNull() & ~F.col("bad")).select("finding_id", "key")


def dependent_narratives(narratives: DataFrame, moved: DataFrame) -> DataFrame:
    """(finding_id, cited) of narratives (finding_id, text) that cite a moved finding (``label``): the sorted labels."""
    cited = narratives.select("finding_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(F[0-9]{2,4})"), 1))).alias("label"))
    return cited.join(moved.select("label"), "label").groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("cited"))


def may_merge(pairs: DataFrame) -> DataFrame:
    """``pairs`` (title_a, text_a, keys_a, pids_a and the same of b) with ``allowed``: a shared key or two shared title words, and no entities that exclude each other."""
    ips = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), 1))
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z]+")), lambda w: F.length(w) >= 4)
    made = computed(pairs, _a=ips(F.col("text_a")), _b=ips(F.col("text_b")))
    conflict = apart(F.col("_a"), F.col("_b")) | apart(F.col("pids_a"), F.col("pids_b"))
    alike = F.arrays_overlap("keys_a", "keys_b") | (F.size(F.array_intersect(words(F.col("title_a")), words(F.col("title_b")))) >= 2)
    return made.withColumn("allowed", ~conflict & alike).drop("_a", "_b")


def fingerprint() -> Column:
    """Identity of a finding (claims, artifact, title, finding_id) across reporters: process, address and hash entities; else paths; else its text; else itself."""
    entity = lambda c: F.array(
        F.when(_of(c, "pid") != "", F.concat(F.lit("pid:"), _of(c, "pid"))), F.when(_of(c, "process") != "", F.concat(F.lit("proc:"), F.substring(F.lower(_of(c, "process")), 1, 14))),
        F.when(_of(c, "foreign_addr") != "", F.concat(F.lit("ip:"), _of(c, "foreign_addr"))), F.when(_of(c, "sha1") != "", F.concat(F.lit("hash:"), F.lower(_of(c, "sha1")))))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.flatten(a)))), "|")
    strong = joined(F.transform("claims", entity))
    paths = joined(F.transform("claims", lambda c: F.array(F.when(_of(c, "path") != "", F.concat(F.lit("path:"), N.path_of_ensemble(_of(c, "path")))))))
    text = F.regexp_replace(F.concat_ws("|", F.lower(F.trim(F.coalesce("artifact", F.lit("")))), F.lower(F.trim(F.coalesce("title", F.lit(""))))), r"^\|+|\|+$", "")
    return F.when(strong != "", strong).when(paths != "", paths).when(text != "", F.concat(F.lit("desc:"), F.substring(text, 1, 120))).otherwise(F.concat(F.lit("uid:"), F.col("finding_id").cast("string")))


def split_subjects(findings: DataFrame) -> DataFrame:
    """One row for each process of a finding, with its own claims and those of no process; findings about a relation between processes stay whole."""
    pid = lambda c: F.nullif(_of(c, "pid"), F.lit(""))
    pids = F.array_distinct(F.array_compact(F.transform("claims", pid)))
    related = F.exists("claims", lambda c: _of(c, "type").isin("child_process", "parent_process", "process_relationship", "parent_child"))
    subjects = F.when((F.size(pids) > 1) & ~related, pids).otherwise(F.array(F.lit(None).cast("string")))
    cut = findings.withColumn("subject", F.explode(subjects))
    return cut.withColumn("claims", F.when(F.col("subject").isNull(), F.col("claims")).otherwise(F.filter("claims", lambda c: (_of(c, "pid") == F.col("subject")) | (_of(c, "pid") == ""))))
