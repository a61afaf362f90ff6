"""Emission of candidates as findings: a greedy choice made in parallel rounds, and the collapse of repeated behaviours.

In order, a candidate is taken if it shares no token with what was taken before.  A candidate that is the best of all its
tokens is taken whatever the others do, and all that share a token with it are not: that is a round, and all such candidates
are decided at once.  Candidates that hang together only in long chains need many rounds, so after a few of them each
connected rest of a bounded size is decided by one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vocabulary as V
from quarry.operators.graph import connected_components, saved

#: Rounds before connected rests are decided one by one, and the most (candidate, token) rows of such a rest.
ROUNDS, REST = 5, 100_000


def binary_of(entity_key: str):
    """File name of the first program in an entity key's value, lower case; '' where it names none."""
    key = F.coalesce(F.col(entity_key), F.lit(""))
    value = F.when(F.contains(key, F.lit(":")), F.regexp_extract(key, r"(?s)^[^:]*:(.*)$", 1)).otherwise(key)
    return F.lower(F.trim(F.regexp_extract(value, V.PROGRAM_FILE, 1)))


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """What a connected rest (rows of candidate_id, score, entity_key, token) takes, one after the other."""
    tokens = rows.groupby("candidate_id")["token"].agg(list)
    order = rows.drop_duplicates("candidate_id").sort_values("candidate_id").sort_values(["score", "entity_key"], ascending=False, kind="stable")
    seen: set = set()
    taken = []
    for c in order["candidate_id"].tolist():
        if seen.isdisjoint(tokens[c]):
            taken.append(c)
            seen.update(tokens[c])
    return pd.DataFrame({"candidate_id": pd.Series(taken, dtype="int64")})


def greedy(pairs: DataFrame) -> DataFrame:
    """Saved (candidate_id) that a loop over the candidates takes: by score and entity key from the top, then by the least id.

    ``pairs`` has distinct rows (candidate_id, score, entity_key, token); score and entity key belong to the candidate.
    """
    rank = F.struct("score", "entity_key", -F.col("candidate_id"))
    open_, taken, turn = saved(pairs), [], 0
    while not open_.isEmpty():
        turn += 1
        if turn % ROUNDS:
            best = open_.groupBy("token").agg(F.max(rank).alias("best"))
            won = saved(open_.join(best, "token").groupBy("candidate_id").agg(F.bool_and(rank == F.col("best")).alias("won")).where("won").select("candidate_id"))
            spent = open_.join(won, "candidate_id", "left_semi").select("token").distinct()
            gone = open_.join(spent, "token", "left_semi").select("candidate_id").distinct()
        else:
            least = open_.groupBy("token").agg(F.min("candidate_id").alias("b"))
            parts = connected_components(open_.join(least, "token").select(F.col("candidate_id").alias("a"), "b").distinct())
            held = saved(open_.join(parts.withColumnRenamed("node", "candidate_id"), "candidate_id"))
            fit = held.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= REST).select("component")
            rest = saved(held.join(fit, "component"))
            won = saved(rest.groupBy("component").applyInPandas(lambda rows: in_order(rows), "candidate_id long"))
            gone = rest.select("candidate_id").distinct()
        taken.append(won)
        open_ = saved(open_.join(gone, "candidate_id", "left_anti"))
    found = pairs.select("candidate_id").where("false")
    for won in taken:
        found = found.unionByName(won)
    return saved(found)


def emitted(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(candidate_id, standing, representative) of every candidate (candidate_id, score, entity_key, behaviour, tokens).

    ``standing`` is ``no_tokens``, ``known`` (it shares a token with ``existing`` (token) findings), ``beaten`` (with a better
    candidate that is taken), ``emitted``, or ``collapsed``: taken as one more instance of the same behaviour by the same program, for which its
    first stands (``representative``).  Tokens of collapsed candidates are spent like those of emitted ones.  A null score counts as 0.
    """
    c = saved(candidates.select("candidate_id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("entity_key", F.lit("")).alias("entity_key"), "behaviour", F.array_compact(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens")))
    pairs = c.select("candidate_id", "score", "entity_key", F.explode("tokens").alias("token"))
    known = saved(pairs.join(existing.select("token").distinct(), "token", "left_semi").select("candidate_id").distinct())
    taken = greedy(pairs.join(known, "candidate_id", "left_anti"))
    program = binary_of("entity_key")
    alike = F.when(program != "", F.concat_ws("|", "behaviour", program)).otherwise(F.concat(F.lit("#"), F.col("candidate_id").cast("string")))
    chosen = c.join(taken, "candidate_id").withColumn("alike", alike)
    first = chosen.groupBy("alike").agg(F.max_by("candidate_id", F.struct("score", "entity_key", -F.col("candidate_id"))).alias("representative"))
    named = chosen.join(first, "alike").select("candidate_id", "representative")
    marked = c.join(known.withColumn("known", F.lit(True)), "candidate_id", "left").join(named, "candidate_id", "left")
    standing = F.when(F.size("tokens") == 0, "no_tokens").when(F.col("known"), "known").when(F.col("representative").isNull(), "beaten").when(F.col("representative") == F.col("candidate_id"), "emitted").otherwise("collapsed")
    return marked.select("candidate_id", standing.alias("standing"), "representative")


def representatives(candidates: DataFrame, standings: DataFrame) -> DataFrame:
    """(candidate_id, instances, source_tools) of the emitted candidates: how many they stand for, and the tools of all of these."""
    held = candidates.select("candidate_id", "source_tools").join(standings.where("representative IS NOT NULL"), "candidate_id")
    tools = held.select("representative", F.explode_outer("source_tools").alias("tool")).groupBy("representative").agg(F.array_sort(F.collect_set("tool")).alias("source_tools"))
    counts = held.groupBy("representative").agg(F.count(F.lit(1)).alias("instances"))
    return counts.join(tools, "representative").select(F.col("representative").alias("candidate_id"), "instances", "source_tools")
