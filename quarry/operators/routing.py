"""Findings that are routed to benign: by their own verdict where they speak of this host alone, or by what was judged of their processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.disposition import HISTORY, WEAK

# Verdicts, and the patterns of addresses and process numbers in texts.
BENIGN = ["confirmed_benign", "likely_fp", "benign", "false_positive", "fp"]
MALICIOUS = ["confirmed_malicious", "malicious"]
PRIVATE_NET = r"\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b"
LOOPBACK = r"(?i)\b127\.0\.0\.1\b|::1\b|\blocalhost\b"
ANY_NET = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PID_IN_TEXT = r"(?i)\bpid[:=]?\s*(\d{1,7})\b"


def _ips(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_NET), 0)


def _inside(ip: Column) -> Column:
    return F.startswith(ip, F.lit("127.")) | (ip == "0.0.0.0")


def loopback_only(text: Column) -> Column:
    """A text that names this host and no other address."""
    return text.rlike(LOOPBACK) & ~text.rlike(PRIVATE_NET) & F.forall(_ips(text), _inside)


def outside_peer(text: Column) -> Column:
    """A text that names a public address of four numbers."""
    fine = lambda ip: ~_inside(ip) & ~ip.rlike("^" + PRIVATE_NET) & F.forall(F.split(ip, r"\."), lambda p: p.cast("int") <= 255)
    return F.exists(_ips(text), fine)


def routed(findings: DataFrame) -> DataFrame:
    """(finding_id, reason) of every finding (finding_id, title, description, raw_excerpt, claims, verdict, false_positive, signals); null reasons stay where they are.

    A finding with a malicious verdict, or with a signal that is neither weak alone nor history, is never routed.  ``loopback_benign``: its
    verdict is benign and it speaks of this host alone.  ``entity_benign_propagation``: it has no benign verdict, one of its processes is in a finding that
    has, and it names no public peer, which that verdict didn't judge.  Process numbers come from claims and texts; 0 and blanks count for nothing.
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    claims = F.coalesce("claims", F.array().cast("array<map<string,string>>"))
    text = F.concat_ws(" ", some("title"), some("description"), some("raw_excerpt"), F.array_join(F.transform(claims, lambda c: F.array_join(F.map_values(c), " ")), " "))
    low = F.lower(F.trim(some("verdict")))
    told = findings.select("finding_id", text.alias("text"), claims.alias("claims"), (low.isin(BENIGN) | F.coalesce("false_positive", F.lit(False))).alias("benign"), low.isin(MALICIOUS).alias("malicious"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"))
    pids = F.concat(F.transform("claims", lambda c: F.trim(some(F.try_element_at(c, F.lit("pid"))))), F.regexp_extract_all("text", F.lit(PID_IN_TEXT), 1))
    pids = F.filter(F.array_distinct(pids), lambda p: ~p.isin("", "0"))
    strong = F.size(F.array_except("signals", F.array(*map(F.lit, WEAK + HISTORY)))) > 0
    judged = told.select("finding_id", "benign", (~F.col("malicious") & ~strong).alias("open"), loopback_only(F.col("text")).alias("local"), outside_peer(F.col("text")).alias("peer"), pids.alias("pids"))
    each = judged.select("finding_id", "benign", F.explode("pids").alias("pid"))
    cleared = each.where("benign").select("pid").distinct()
    reached = each.where("NOT benign").join(cleared, "pid", "left_semi").select("finding_id").distinct().withColumn("reached", F.lit(True))
    met = judged.join(reached, "finding_id", "left")
    reason = F.when(F.col("open") & F.col("benign") & F.col("local"), "loopback_benign").when(F.col("open") & ~F.col("benign") & F.coalesce("reached", F.lit(False)) & ~F.col("peer"), "entity_benign_propagation")
    return met.select("finding_id", reason.alias("reason"))
