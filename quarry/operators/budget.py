"""A budget shared by prioritised sources, and the longest known suffix of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.facts import running
from quarry.operators.graph import saved
from quarry.operators.mentions import small


def within_budget(records: DataFrame, source: str, priority: str, ordinal: str, size: str, budget: int, header: int = 0) -> DataFrame:
    """Records that fit a budget: sources of higher priority (then the lesser name) take first, each whole or as long a beginning as fits.

    A source that takes anything pays ``header`` once; what a cut source leaves goes to the next.  ``ordinal`` numbers a source's records
    uniquely in whole numbers; a null size counts as 0.  Running sums go by source in stretches, and only beginnings that fit the whole
    budget are gathered, so what decides is at most as many numbers a source as the budget has units.
    """
    sized = records.withColumn("_size", F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0)))
    summed = saved(running(sized, source, ordinal, F.col("_size"), "_upto"))
    steps = summed.where(F.col("_upto") <= budget).groupBy(source, "_upto").agg(F.lit(1).alias("_one"))
    ranked = summed.groupBy(source).agg(F.max(priority).alias("_priority"))
    lists = ranked.join(steps.groupBy(source).agg(F.array_sort(F.collect_list("_upto")).alias("_steps")), source)
    row = lists.agg(F.array_sort(F.collect_list(F.struct((-F.col("_priority")).alias("order"), F.col(source).alias("source"), F.col("_steps").alias("steps")))).alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() AS array<struct<source:string,upto:long>>)").alias("taken"))

    def take(state, s):
        room = state["left"] - header
        upto = F.array_max(F.filter(s["steps"], lambda x: x <= room))
        new = F.struct(s["source"].cast("string").alias("source"), upto.alias("upto"))
        return F.when((room < 0) | upto.isNull(), state).otherwise(F.struct((room - upto).alias("left"), F.concat(state["taken"], F.array(new)).alias("taken")))

    given = row.select(F.explode(F.aggregate("all", start, take)["taken"]).alias("t")).select(F.col("t.source").alias("_source"), F.col("t.upto").alias("_limit"))
    met = summed.join(F.broadcast(given), F.col(source).cast("string") == F.col("_source"))  # a row a source
    return met.where(F.col("_upto") <= F.col("_limit")).select(*records.columns, F.col("_upto").alias("used"))


def registrable(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(name, suffix, registrable) of the distinct names of ``names`` (name): the longest suffix of ``suffixes`` (suffix), and it with the label before.

    Names and suffixes are compared in lower case without dots at their ends.  ``suffix`` is null for names that end in none;
    ``registrable`` is null for those, and for names that are a suffix themselves.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^\.+|\.+$", "")
    own = names.select(bare(F.col("name")).alias("name")).where("name <> ''").distinct()
    known = saved(suffixes.select(bare(F.col("suffix")).alias("suffix")).where("suffix <> ''").distinct())
    labels = F.filter(F.split("name", r"\."), lambda x: x != "")
    ends = own.select("name", labels.alias("labels")).select("name", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    ends = ends.withColumn("suffix", F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), "."))
    longest = ends.join(small(known), "suffix").groupBy("name").agg(F.max(F.struct("k", "suffix", "labels")).alias("best"))
    size = F.size("best.labels")
    with_one = F.when(size > F.col("best.k"), F.array_join(F.slice("best.labels", size - F.col("best.k"), F.col("best.k") + 1), "."))
    return own.join(longest, "name", "left").select("name", F.col("best.suffix").alias("suffix"), with_one.alias("registrable"))
