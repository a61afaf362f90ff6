"""Helpers shared by the corpus operators: shared storage, host joins, batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a fixed-width table that may be broadcast (about 10 MB at 200 bytes a row).
BROADCAST_ROWS = 50_000
#: The same for tables of two or three numbers.
NARROW_ROWS = 300_000
#: Rows of 64 bits that a sketch of keys has at most.
SKETCH_WORDS = 1 << 18
#: Bytes of an Arrow batch in the registered queries and the pipeline.
BATCH_BYTES = 3 << 20
#: Narrow rows of a range of a sorted table.
RANGE_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, for a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below the shared checkpoint folder of this session.

    ``spark.checkpoint.dir`` names it.  Only a local session may go without: it gets a temporary folder.
    On a cluster a folder of the driver's machine would lose data, so there it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif re.match(r"local(\[|$)", context.master):
            base = "file://" + tempfile.mkdtemp(prefix="quarry-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    elif "://" not in base:
        base = "file://" + base
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI, with the names that Hadoop has for object stores."""
    import pyarrow.fs as pafs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    for name, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        if uri.startswith(name):
            uri = plain + uri[len(name):]
    return pafs.FileSystem.from_uri(uri)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_small(df: DataFrame, table: DataFrame, key: str | list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join the stored fixed-width ``table`` (one row per key) to ``df``.

    It is broadcast only when its counted rows are at most ``most``; beyond
    that it is a sort-merge join, whose hot keys adaptive execution splits.
    """
    rows = table.count()
    return df.join(F.broadcast(table) if rows <= most else table.hint("merge"), key, how)


def _bit(key: str):
    """(word, bit in it) of a key in a sketch."""
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(64 * SKETCH_WORDS))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def sketch(keys: DataFrame, key: str) -> DataFrame:
    """Stored (_word, _bits): one bit for every value of the whole number ``key``, in ``SKETCH_WORDS`` rows at most whatever the size of ``keys``."""
    word, bit = _bit(key)
    return stored(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def parted(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be in the sketch ``held``, rows whose key is not).

    The second part has no partner in the sketch's table, so a join needs to shuffle the first alone; that has all rows with a
    partner, and others by the share of bits that are set.
    """
    word, bit = _bit(key)
    at, bits = unused(df, "_word"), unused(df, "_bits")
    marked = df.withColumn(at, word).join(F.broadcast(held.toDF(at, bits)), at, "left")
    there = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit) != 0
    return marked.where(there).drop(at, bits), marked.where(~there).drop(at, bits)


def sized(table: DataFrame, rows_each: int = NARROW_ROWS) -> DataFrame:
    """The stored narrow ``table`` in one partition for every ``rows_each`` of its counted rows."""
    return table.coalesce(max(1, -(-table.count() // rows_each)))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``: both sides of a Python worker hold whole batches of texts.

    For the sessions of registered queries and the pipeline; operators leave a user's session as it is
    (Spark's own bound is 64 MB).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` whose columns of these names have others meanwhile, and which (old name -> new one)."""
    new = {}
    for c in df.columns:
        if c.lower() in names:
            new[c] = unused(df, f"_own{c}")
            df = df.withColumnRenamed(c, new[c])
    return df, new


def fresh_worker() -> None:
    """Give back what earlier tasks of other operators left in a reused Python worker."""
    import ctypes
    import gc

    import pyarrow as pa

    from . import bpe

    bpe.forget_encoders()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run):
    """``run`` (batches to batches) that gives back its memory when it ends: an idle worker keeps what it has."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            fresh_worker()

    return whole


def in_order(df: DataFrame, key: list[str], order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``df`` with ``_at``, their number from 0 within ``key`` in ``order``, and, for each column of ``sums``, its running sum ``_sum_<column>``.

    Rows go to ranges of (key, order); every range numbers its rows alone and adds what lower ranges hold of its first
    key, so a key with most of the rows is many tasks' work.  Only a range's first key begins below it: that table has a row a
    range at most.  Rows that are equal in both are told apart by their place in the stored table.  Key columns aren't null.
    """
    held = stored(df.withColumn("_tie", F.monotonically_increasing_id()))
    n = max(partitions(df.sparkSession), -(-held.count() // RANGE_ROWS))
    ranged = stored(held.repartitionByRange(n, *key, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    own = ranged.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_total_{c}") for c in sums))
    lower = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = stored(own.select("_range", *key, F.sum("_n").over(lower).alias("_before"), *(F.sum(f"_total_{c}").over(lower).alias(f"_before_{c}") for c in sums)).where("_before IS NOT NULL"))
    here = Window.partitionBy("_range", *key).orderBy(*order, "_tie")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(begun), ["_range", *key], "left")
    at = F.coalesce("_before", F.lit(0)) + F.row_number().over(here) - 1
    return placed.select(*df.columns, at.alias("_at"), *((F.coalesce(f"_before_{c}", F.lit(0)) + F.sum(c).over(upto)).alias(f"_sum_{c}") for c in sums))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes, limit: int):
    """Consecutive (begin, end) ranges whose sizes add up to about ``limit``, one row at least."""
    begin, total = 0, 0
    for at, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, at
            begin, total = at, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
