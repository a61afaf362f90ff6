"""Heavy hitters: the most frequent items of each group, exactly, by a sketch and a second pass.

A sketch of bounded size names candidates; their exact counts are made in a second pass that shuffles no more rows than the sketches
hold.  An item that a sketch doesn't hold is at most as frequent as the sketch's error, so where the last item kept is above
that, the result is proven.  Groups that are not proven get a larger sketch, and in the end a plain count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.graph import saved
from quarry.operators.mentions import small

#: Items of the first sketch, by how much a next one is larger, and the largest.
TRACKED, GROWTH, MOST = 2_000, 8, 128_000


def counted(rows: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """(by, item, n, rank) of the ``k`` most frequent items of each group, by a count of all; ties by the item."""
    n = rows.groupBy(by, item).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), item))).where(F.col("rank") <= k)


def top(rows: DataFrame, by: str, item: str, k: int, tracked: int = TRACKED, most: int = MOST) -> DataFrame:
    """(by, item, n, rank) of the ``k`` most frequent items of each group of ``rows``; null items and null groups don't count.

    Equal counts are ordered by the item.
    """
    rows = rows.select(by, item).where(F.col(by).isNotNull() & F.col(item).isNotNull())
    parts, open_ = [], rows
    while True:
        # the sketch keeps at least this many counters, and errs by at most 3.5 rows a counter
        counters = tracked / 0.75
        sketch = saved(open_.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), F.expr(f"approx_top_k({item}, {tracked}, {tracked})").alias("_held")))
        held = sketch.select(by, F.explode("_held.item").alias(item))  # at most ``tracked`` rows a group
        exact = saved(open_.join(small(held), [by, item], "left_semi").groupBy(by, item).agg(F.count(F.lit(1)).alias("n")))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), item))).where(F.col("rank") <= k)
        # nothing else is in the group, or nothing else can be as frequent as the last one kept
        whole = exact.groupBy(by).agg(F.sum("n").alias("_sum")).join(sketch.select(by, "_rows"), by).where("_sum = _rows").select(by)
        last = ranked.where(F.col("rank") == k).join(sketch.select(by, "_rows"), by).where(F.col("n") > F.col("_rows") * 3.5 / counters).select(by)
        made = saved(ranked.join(whole.union(last).distinct(), by, "left_semi"))
        parts.append(made)
        done = saved(made.select(by).distinct())
        left = saved(sketch.select(by).join(done, by, "left_anti"))
        if left.isEmpty():
            break
        open_ = rows.join(left, by, "left_semi")
        tracked *= GROWTH
        if tracked > most:
            parts.append(counted(open_, by, item, k))
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
