"""Canonical exact digests of documents, in DataFrame functions alone.

A text is brought to Unicode compatibility composition, case-folded, composed again, its
white space runs become single blanks, and both ends are trimmed.  The canonical text
is digested by two chained xxhash64 (128 bits).  Rows with equal digests are compared byte
by byte: an aggregate keeps the least and the greatest canonical text of each digest
that occurs more than once, which differ only if the bucket holds different texts; such a
bucket's fingerprints are extended by SHA-512.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import aside, partitions, stored, with_small

#: Buckets of neighbouring doc_ids, at most.
MOST_BUCKETS = 10_000


def canonical(text: Column) -> Column:
    """Canonical form of a text; null and empty texts, and white space alone, give ''."""
    text = F.coalesce(text, F.lit(""))
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    full = F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(full, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """128 bits of chained xxhash64 as lowercase hex."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(form)), part(F.xxhash64(F.lit(1), form)))


def mixed_digests(docs: DataFrame) -> DataFrame:
    """Digests whose bucket holds more than one canonical text (as good as always none), stored.

    Buckets of one row need no comparison, so only texts of repeated digests are shuffled;
    equal texts are combined before, so a hot bucket costs one row a task.
    """
    forms = docs.select(canonical(F.col("text")).alias("form")).withColumn("digest", digest(F.col("form")))
    repeated = stored(forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("repeated")))
    kept = with_small(forms, repeated, "digest", "inner")
    ends = kept.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest"))
    return stored(ends.where("least <> greatest").select("digest", F.lit(True).alias("mixed")))


def fingerprints(docs: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (one of that name is replaced).

    Texts with equal canonical forms have equal fingerprints, others different ones.
    Null texts count as empty; repeated rows keep their rows; an empty table stays empty.
    ``mixed`` is what ``mixed_digests`` gave for a table that covers ``docs``.
    """
    mixed = mixed_digests(docs) if mixed is None else mixed
    out = docs.withColumn("fingerprint", digest(canonical(F.col("text"))))
    return split_mixed(out, mixed, {"fingerprint": F.col("text")})


def split_mixed(df: DataFrame, mixed: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Extend fingerprints (column -> its text) whose digest is in ``mixed``."""
    if mixed.isEmpty():
        return df
    for name, text in texts.items():
        df = with_small(df, mixed.withColumnRenamed("digest", name).withColumnRenamed("mixed", "_mixed"), name)
        df = df.withColumn(name, F.when(F.col("_mixed"), F.concat(F.col(name), F.lit("-"), F.sha2(canonical(text), 512))).otherwise(F.col(name))).drop("_mixed")
    return df


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``next_<column>`` of the row that follows in descending doc_id; the first follows the last.

    doc_ids are cut into buckets whose upper ends are real doc_ids found by a quantile
    sketch, so each bucket's first row is known; a copy of it is sent to the bucket
    above, and every bucket finds its neighbours alone.  Null doc_ids come last, equal
    doc_ids are ordered by the first of ``columns``.
    """
    names = docs.columns
    docs, own = aside(docs, ["_key", "_bucket", "_edge", "_to", "_b", "_copy"])
    columns = [own.get(c, c) for c in columns]
    n = max(1, min(MOST_BUCKETS, 4 * partitions(docs.sparkSession)))
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = keyed.agg(F.percentile_approx("_key", F.array(*[F.lit(i / n) for i in range(1, n + 1)]), F.lit(10 * n)).alias("q")).first()["q"] or [0]
    top = keyed.agg(F.max("_key")).first()[0]
    cuts = sorted({*cuts, top if top is not None else 0})
    array = "array(" + ",".join(f"{c}L" if c != -(2**63) else "-9223372036854775807L - 1L" for c in cuts) + ")"
    steps = ",".join(str(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1))
    # how many cuts lie below the key
    below = f"aggregate(array({steps}), 0, (a, s) -> CASE WHEN a + s <= {len(cuts)} AND _key > element_at({array}, a + s) THEN a + s ELSE a END)"
    keyed = keyed.withColumn("_bucket", F.expr(below)).withColumn("_edge", F.expr(f"_key = element_at({array}, _bucket + 1)"))
    last = len(cuts) - 1
    copies = F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy")),
        F.when(F.col("_edge"), F.struct(F.when(F.col("_bucket") < last, F.col("_bucket") + 1).otherwise(F.lit(0)).alias("b"), F.when(F.col("_bucket") < last, F.lit(1)).otherwise(F.lit(2)).alias("copy"))),
    )
    dealt = keyed.withColumn("_to", F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumns({"_b": F.col("_to.b"), "_copy": F.col("_to.copy")})
    order = Window.partitionBy("_b").orderBy(F.when(F.col("_copy") == 2, 1).otherwise(0), F.desc("_key"), F.col(columns[0]))
    back = {v: k for k, v in own.items()}
    found = dealt.withColumns({f"next_{back.get(c, c)}": F.lead(c).over(order) for c in columns}).where("_copy = 0")
    return found.select(*(F.col(own.get(c, c)).alias(c) for c in names), *(f"next_{back.get(c, c)}" for c in columns))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, fingerprint, next_fingerprint, edited, edited_fingerprint) of every row.

    The edited text is the text whose last half gave way to the beginning of the next
    document's.
    """
    mixed = mixed_digests(docs)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = split_mixed(base.withColumn("fingerprint", digest(canonical(F.col("text")))), mixed, {"fingerprint": F.col("text")})
    paired = with_next(base, ["text", "fingerprint"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = paired.withColumn("edited", new).withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))
    return split_mixed(out, mixed, {"edited_fingerprint": F.col("edited")})
