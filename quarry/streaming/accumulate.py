"""Accumulation as records arrive: keyed state that outlives batches and restarts.

A key's state is of bounded size, and so is what a task holds of a batch: rows are taken in order from a heap no larger than what the key may still take.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting of a session whose streams keep such state.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ready(spark: SparkSession) -> None:
    """Keep state in RocksDB from now on; call it before a stream with keyed state starts."""
    spark.conf.set(*PROVIDER)


class Arrivals(StatefulProcessor):
    """Lets the first rows of each key through, numbered, as many as its limit."""

    def __init__(self, key: str, ordinal: str, limits: dict[str, int], default: int):
        self.key, self.ordinal, self.limits, self.default = key, ordinal, limits, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        had = self.taken.get()[0] if self.taken.exists() else 0
        left = self.limits.get(key[0], self.default) - had
        if left <= 0:
            return
        first = pd.DataFrame()
        for part in rows:
            first = pd.concat([first, part]).nsmallest(left, self.ordinal, keep="first")
        if len(first):
            self.taken.update((had + len(first),))
            yield first.assign(rank=range(had + 1, had + len(first) + 1))

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, key: str, ordinal: str, limits: dict[str, int], default: int) -> DataFrame:
    """Rows of a stream with ``rank``: the first of each key, as many as its own limit or the default; null keys are ''.

    A batch's rows arrive in the order of the number ``ordinal``, and after those of earlier batches: over all batches these are the rows that
    ``selection.arrival_cap`` keeps of the whole table.  For append mode.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", rank long"
    keyed = stream.withColumn(key, F.coalesce(key, F.lit("")))
    return keyed.groupBy(key).transformWithStateInPandas(Arrivals(key, ordinal, limits, default), kind, "Append", "None")


class Indicators(StatefulProcessor):
    """Counts a key's sightings and keeps its first class and the least of its tools and sources, up to a limit each."""

    def __init__(self, keys: list[str], most: int):
        self.keys, self.most = keys, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, first_at long, first_class string")
        self.lists = {c: handle.getMapState(c, "name string", "n long") for c in ("tool", "source")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, first_at, first = self.sums.get() if self.sums.exists() else (0, None, None)
        new: dict[str, set] = {"tool": set(), "source": set()}
        for part in rows:
            n += len(part)
            at = part["ordinal"].idxmin()
            if first_at is None or part["ordinal"][at] < first_at:
                first_at, first = int(part["ordinal"][at]), part["first_class"][at]
            for c, names in new.items():
                # a name that isn't among the least of what came can't be among the least of all
                names.update(heapq.nsmallest(self.most, set(part[c].dropna()) | names))
                new[c] = set(heapq.nsmallest(self.most, names))
        self.sums.update((n, first_at, first))
        out = {k: [v] for k, v in zip(self.keys, key)} | {"n": [n], "first_class": [first]}
        for c, names in new.items():
            held = {k[0] for k in self.lists[c].keys()}
            kept = set(heapq.nsmallest(self.most, held | names))
            for gone in held - kept:
                self.lists[c].removeKey((gone,))
            for name in kept - held:
                self.lists[c].updateValue((name,), (1,))
            out[f"{c}s"] = [sorted(kept)]
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def indicators(stream: DataFrame, most: int = 20) -> DataFrame:
    """(kind, value, n, first_class, tools, sources) of a stream of sightings (kind, value, tool, source, class, ordinal).

    Each batch gives the new state of the indicators it touches (update mode): sightings so far, the class of the first by ``ordinal``, and up to
    ``most`` tools and sources, the least by name.  Over all batches the last state of each is what ``gathered`` says of the whole table.
    """
    rows = stream.select("kind", "value", "tool", "source", F.col("class").alias("first_class"), F.col("ordinal").cast("long").alias("ordinal")).where("kind IS NOT NULL AND value IS NOT NULL")
    kind = "kind string, value string, n long, first_class string, tools array<string>, sources array<string>"
    return rows.groupBy("kind", "value").transformWithStateInPandas(Indicators(["kind", "value"], most), kind, "Update", "None")


def gathered(sightings: DataFrame, most: int = 20) -> DataFrame:
    """What ``indicators`` comes to, of a whole table.

    Names are made distinct and ranked before they are gathered, so an indicator that most rows show is no unbounded list.
    """
    from pyspark.sql.window import Window

    rows = sightings.where("kind IS NOT NULL AND value IS NOT NULL")
    out = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min_by("class", "ordinal").alias("first_class"))
    for c in ("tool", "source"):
        names = rows.where(F.col(c).isNotNull()).select("kind", "value", c).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("kind", "value").orderBy(c))).where(F.col("rank") <= most)
        out = out.join(names.groupBy("kind", "value").agg(F.array_sort(F.collect_list(c)).alias(f"{c}s")), ["kind", "value"], "left")
    return out.select("kind", "value", "n", "first_class", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tools", "sources")))
