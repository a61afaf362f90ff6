"""The index of facts as a stored layout: a table in buckets of (index, key), so lookups don't shuffle facts.

Facts are written once, under each of their keys, hashed into buckets and sorted; a lookup shuffles only the claims, to the
buckets as they lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import shared_dir


def write_index(facts: DataFrame, keys: dict[str, Column], fact_id: str, carried: list[str], buckets: int | None = None) -> str:
    """Name of a new table (index_name, key, fact_id, the columns ``carried``) in the shared folder, in buckets of (index_name, key).

    There are at least as many buckets as shuffle partitions, so the planner has no reason to deal the facts out anew.  Null keys are left out.
    """
    spark: SparkSession = facts.sparkSession
    n = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = F.array(*(F.struct(F.lit(name).alias("index_name"), c.cast("string").alias("key")) for name, c in keys.items()))
    rows = facts.select(F.explode(entries).alias("e"), F.col(fact_id).alias("fact_id"), *carried).select("e.*", "fact_id", *carried).where("key IS NOT NULL")
    name = f"fact_index_{uuid.uuid4().hex}"
    # one task writes a bucket, so there is one file for each
    rows.repartition(n, "index_name", "key").write.bucketBy(n, "index_name", "key").sortBy("index_name", "key").option("path", shared_dir(spark)).saveAsTable(name)
    return name


def lookup(claims: DataFrame, table: str, how: str = "inner") -> DataFrame:
    """``claims`` (index_name, key, ...) joined with the facts of the index ``table`` under that key; null keys find nothing."""
    return claims.join(claims.sparkSession.table(table).hint("merge"), ["index_name", "key"], how)


