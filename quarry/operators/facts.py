"""Fact store: compiling with drop reasons, coverage, signature merge, numbering, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.columns import first_of


def compile_facts(records: DataFrame, reasons: list[tuple[str, str]]) -> DataFrame:
    """Records with ``outcome``: the first drop reason that holds, else ``compiled``."""
    return records.withColumn("outcome", first_of(reasons, "compiled"))


def coverage(compiled: DataFrame, by: str) -> DataFrame:
    """Ledger by source: every record is compiled or dropped."""
    done = F.sum(F.when(F.col("outcome") == "compiled", 1).otherwise(0))
    return compiled.groupBy(by).agg(F.count(F.lit(1)).alias("record_count"), done.alias("compiled_count"), (F.count(F.lit(1)) - done).alias("dropped_count"))


def signature(kind: str, entity: str, parts: list[str]) -> Column:
    """SHA-1 of a fact's type, entity and artefact parts, the parts joined by bars; a null part is empty and keeps its place."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha1(F.concat_ws("::", text(kind), text(entity), F.concat_ws("|", *map(text, parts))))


def merge_facts(facts: DataFrame, kind: str, entity: str, parts: list[str], tool: str, ref: str, excerpt: str, ordinal: str, refs: int = 64, excerpts: int = 3) -> DataFrame:
    """One row for each signature: the first row by ``ordinal`` stands for it, with the sorted tools, up to ``refs`` sorted references (``truncated`` tells of more), the first
    distinct excerpts, and ``merge_count``.  References and excerpts are made distinct and numbered before they are gathered, so a signature that most facts share is no unbounded list.
    """
    signed = facts.withColumn("signature", signature(kind, entity, parts))
    own = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("merge_count"), F.array_sort(F.collect_set(tool)).alias("source_tools"), F.min_by(F.struct(*facts.columns), ordinal).alias("first"))
    first = lambda order, n: F.row_number().over(Window.partitionBy("signature").orderBy(order)) <= n
    distinct = signed.groupBy("signature", F.col(ref).alias("ref")).agg(F.lit(1))
    # one more than is kept tells whether there are more; the constant lets each task keep that many before they are shuffled
    ranked = distinct.withColumn("at", F.row_number().over(Window.partitionBy("signature").orderBy("ref"))).where(F.col("at") <= refs + 1)
    kept = ranked.groupBy("signature").agg(F.array_sort(F.collect_list(F.when(F.col("at") <= refs, F.col("ref")))).alias("record_refs"), (F.max("at") > refs).alias("truncated"))
    said = signed.where(F.col(excerpt).isNotNull()).groupBy("signature", F.col(excerpt).alias("excerpt")).agg(F.min(ordinal).alias("at"))
    said = said.withColumn("ok", first("at", excerpts)).where("ok").groupBy("signature").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "excerpt"))), lambda x: x["excerpt"]).alias("raw_excerpts"))
    return own.join(kept, "signature").join(said, "signature", "left").select("signature", "merge_count", "source_tools", "record_refs", "truncated", "raw_excerpts", "first.*")


def merge(facts: DataFrame, parts: list[str], source: str, record: str) -> DataFrame:
    """One row for each SHA-1 signature of ``parts`` (a null one is empty and keeps its place): count, sorted sources, least record."""
    signed = facts.withColumn("signature", F.sha1(F.concat_ws("::", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))))
    return signed.groupBy("signature").agg(F.count(F.lit(1)).alias("merge_count"), F.concat_ws(",", F.array_sort(F.collect_set(source))).alias("sources"), F.min(record).alias("first_record"))


def running(df: DataFrame, key: str, order: str, amount, name: str, width: int = 4096) -> DataFrame:
    """Running sum of ``amount`` by ``key`` in the order of the whole-number column ``order``.

    Two levels: sums of (key, stretch of ``order``) are summed up over the few stretches, and rows
    only within their stretch, so a key that holds most rows is not one task's work.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_amount", amount)
    sums = cut.groupBy(key, "_stretch").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(key, "_stretch").orderBy(order)
    return cut.join(sums, [key, "_stretch"]).withColumn(name, F.col("_before") + F.sum("_amount").over(inner)).drop("_stretch", "_amount", "_before")


def number(facts: DataFrame, key: str, order: str, name: str = "fact_no") -> DataFrame:
    """Numbers from 1 within ``key`` in the order of a unique whole-number column."""
    return running(facts, key, order, F.lit(1), name)


def inverted_index(facts: DataFrame, keys: dict[str, object], fact_id: str) -> DataFrame:
    """(index_name, key, fact_id): every fact under each of its keys."""
    entries = F.array(*(F.struct(F.lit(n).alias("index_name"), c.cast("string").alias("key")) for n, c in keys.items()))
    return facts.select(F.explode(entries).alias("e"), F.col(fact_id).alias("fact_id")).select("e.*", "fact_id").where("key IS NOT NULL")
