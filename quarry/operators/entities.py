"""Entity grouping: scores, caps, outliers, bursts, stratified and budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import vocabulary as V

from .facts import running


def scores(facts: DataFrame, entity: str, kind: str, weights: dict[str, int], cap: int = 4) -> DataFrame:
    """Score, facts and kinds of each entity: a kind counts ``cap`` times at most, many kinds add a bonus."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col(kind)], F.lit(0))
    kinds = facts.groupBy(entity, kind).agg(F.count(F.lit(1)).alias("n"))
    parts = kinds.withColumn("part", F.least("n", F.lit(cap)) * weight)
    return parts.groupBy(entity).agg((F.sum("part") + F.when(F.count(F.lit(1)) >= 3, 3).otherwise(0)).cast("long").alias("score"), F.sum("n").alias("n_facts"), F.count(F.lit(1)).alias("n_kinds"))


def ordered_cap(candidates: DataFrame, entity: str, order: list, k: int) -> DataFrame:
    """All candidates with ``kept``: the first ``k`` in order; nothing is lost."""
    top = candidates.orderBy(*order).limit(k).select(entity, F.lit(True).alias("_top"))
    return candidates.join(F.broadcast(top), entity, "left").withColumn("kept", F.coalesce("_top", F.lit(False))).drop("_top")  # k rows are broadcast


def outliers(df: DataFrame, value: str, least: int = 8, sigmas: float = 2.0) -> DataFrame:
    """Rows with ``is_outlier``: above mean + sigmas * population deviation of at least ``least`` rows."""
    stats = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(stats)).withColumn("is_outlier", (F.col("_n") >= least) & (F.col(value) > F.col("_m") + sigmas * F.col("_s"))).drop("_m", "_s", "_n")  # one row is broadcast


def dominant(df: DataFrame, group: str, kind: str, item: str, least: int = 3) -> DataFrame:
    """The most frequent kind of each group, if it spans ``least`` distinct items."""
    counts = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("n_items"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", "n_items", kind)).alias("b")).select(group, "b.*")
    return best.where(F.col("n_items") >= least)


def stratified_top(df: DataFrame, stratum: str, order: list, limits: dict[str, int], default: int) -> DataFrame:
    """The first rows of each stratum: its own limit, or the default."""
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col(stratum)], F.lit(default))
    most = max([default, *limits.values()])
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.where(F.col("rank") <= most).where(F.col("rank") <= limit)


def budget_prefix(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, while their sizes add up to ``budget`` at most."""
    return running(df, key, order, F.col(size), "used").where(F.col("used") <= budget)


def presence(df: DataFrame, entity: str, kind: str, kinds: list[str]) -> DataFrame:
    """Which kinds of record each entity is seen in."""
    return df.groupBy(entity).agg(*(F.bool_or(F.col(kind) == k).alias(f"in_{k}") for k in kinds))


def best_by_rank(df: DataFrame, key: str, rank: list, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the row that comes first in ``rank`` (least struct) for each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*rank)).alias("b")).select(key, "b.*")


def encryption_burst(facts: DataFrame, path: str, ordinal: str, kinds: int = 3, groups: int = 4, sigmas: float = 2.0, kept: int = 20) -> DataFrame:
    """(extension, n_files, original_types, ids) of the one foreign extension that was appended to files of ``kinds`` data types and stands out; no row without one.

    With ``groups`` such extensions or more it has more files than their mean and ``sigmas`` population deviations; with fewer, the most.  Of equal counts the
    extension that comes last by name is taken.  ``ids`` are the first few by ``ordinal``.  Null paths name no file.
    """
    parts = F.split(F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)), r"\.")
    own, new = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    named = facts.select(F.col(ordinal).alias("id"), own.alias("own"), new.alias("extension"), F.size(parts).alias("k")).where((F.col("k") >= 3) & F.col("own").isin(V.DATA_EXTENSIONS) & F.col("extension").rlike("^[a-z0-9]{1,12}$") & ~F.col("extension").isin(V.DATA_EXTENSIONS))
    # as many types as the fixed list has, at most
    sums = named.groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_set("own")).alias("original_types")).where(F.size("original_types") >= kinds)
    line = F.when(F.count(F.lit(1)) >= groups, F.avg("n_files") + sigmas * F.stddev_pop("n_files")).otherwise(0.0)
    best = sums.agg(F.max(F.struct("n_files", "extension", "original_types")).alias("b"), line.alias("line")).where(F.col("b.n_files") > F.col("line")).select("b.extension", "b.n_files", "b.original_types")
    first = named.join(F.broadcast(best.select("extension")), "extension").select("id").orderBy("id").limit(kept)  # one row
    return best.join(F.broadcast(first.agg(F.array_sort(F.collect_list("id")).alias("ids"))))  # one row each
