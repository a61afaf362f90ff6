"""Joins of findings with evidence: ordered attempts, time neighbourhoods, three-valued checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_within(first: DataFrame, then: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs (key, t1, t2) with t1 <= t2 <= t1 + seconds.

    Time is cut into stretches of ``seconds``; a row meets its own and the next stretch
    only, so the join is an equi-join on (key, stretch), not on the key's whole history.
    """
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    left = first.select(key, F.col(ts).alias("t1"), F.explode(F.array(at(ts), at(ts) + 1)).alias("s"))
    right = then.select(key, F.col(ts).alias("t2"), at(ts).alias("s"))
    return left.join(right, [key, "s"]).where((F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.make_interval(secs=F.lit(seconds)))).select(key, "t1", "t2")


def first_attempt(df: DataFrame, key: str, attempts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``df`` with ``bound_to``: the first attempt (name, table, its key) that holds the key, else ``none``."""
    out, found = df, []
    for name, table, column in attempts:
        flag = f"_{name}"
        out = out.join(table.select(F.col(column).alias(key)).distinct().withColumn(flag, F.lit(name)), key, "left")
        found.append(F.col(flag))
    return out.withColumn("bound_to", F.coalesce(*found, F.lit("none"))).drop(*(f"_{n}" for n, _, _ in attempts))


def claim_status(claims: DataFrame, evidence: DataFrame, key: str, condition: str) -> DataFrame:
    """MATCH or MISMATCH where there is evidence, UNRESOLVED where there is none."""
    joined = claims.join(evidence.withColumn("_seen", F.lit(True)), key, "left")
    return joined.withColumn("status", F.when(F.col("_seen").isNull(), "UNRESOLVED").when(F.expr(condition), "MATCH").otherwise("MISMATCH")).drop("_seen")
