"""Findings of several reporters merged by what they are about, with who found each and what was dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.reconcile import fingerprint, split_subjects


def marked(findings: DataFrame) -> DataFrame:
    """Findings (finding_id, member, member_no, finding_no, claims, artifact, title) cut into single subjects, with ``fp`` and ``place``, the order in which they come."""
    cut = split_subjects(findings)
    place = F.struct("member_no", "finding_no", F.coalesce("subject", F.lit("")).alias("subject"))
    return cut.withColumns({"fp": fingerprint(), "place": place})


def merged(found: DataFrame) -> DataFrame:
    """(fp, finding_id, survivor_from, discovered_by, unique_to, n) of ``marked`` findings: one for each fingerprint, the first to come.

    ``discovered_by`` has the sorted members, ``unique_to`` the only one if there is one, ``n`` counts all.  Members are few, so sets of them are bounded.
    """
    own = found.groupBy("fp").agg(F.min_by(F.struct("finding_id", "member"), "place").alias("first"), F.array_sort(F.collect_set("member")).alias("discovered_by"), F.count(F.lit(1)).alias("n"))
    alone = F.when(F.size("discovered_by") == 1, F.get("discovered_by", F.lit(0)))
    return own.select("fp", "first.finding_id", F.col("first.member").alias("survivor_from"), "discovered_by", alone.alias("unique_to"), "n")


def dropped(found: DataFrame) -> DataFrame:
    """(finding_id, subject, member, fp, survivor_from) of the ``marked`` findings that another of the same fingerprint stands for."""
    first = found.groupBy("fp").agg(F.min("place").alias("kept"), F.min_by("member", "place").alias("survivor_from"))
    return found.join(first, "fp").where(F.col("place") != F.col("kept")).select("finding_id", "subject", "member", "fp", "survivor_from")


def members(findings: DataFrame, found: DataFrame) -> DataFrame:
    """(member, n_findings, n_survivors, n_unique) of each member."""
    told = findings.groupBy("member").agg(F.count(F.lit(1)).alias("n_findings"))
    kept = merged(found)
    survivors = kept.groupBy(F.col("survivor_from").alias("member")).agg(F.count(F.lit(1)).alias("n_survivors"), F.count("unique_to").alias("n_unique"))
    return told.join(survivors, "member", "left").select("member", "n_findings", F.coalesce("n_survivors", F.lit(0)).alias("n_survivors"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))
