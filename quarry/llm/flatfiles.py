"""Token counts of flat token files without an index: a separator scan.

A flat file is its documents' ids on end, each closed by an end-of-document id, cut into
blocks at arbitrary places.  Every block is searched for the end id by one array
comparison; a prefix scan over the blocks' small summaries (tokens, separators, place
of the last separator) gives what lies before each block, so lengths of documents
that cross blocks are right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_vocabulary, encoded_blocks
from .common import file_system, stored

#: First id that the vocabulary leaves free, so no text holds it.
END_ID = 49408
BLOCK_TOKENS = 1 << 19
#: Blocks that one window of the scan's lower level spans.
SPAN = 512


def write_blocks(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat files of all rows as a compressed table (file, block, ids, closing), one file a partition.

    ``ids`` are little-endian unsigned 16-bit; ``closing`` names the documents whose end lies in the block,
    in order, for naming the scan's finds; the scan itself reads ``ids`` alone.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        import itertools

        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        file, block, held, size, names, at = TaskContext.get().partitionId(), 0, [], 0, [], 0

        def cut(ids, closing):
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "ids": pa.array([ids.astype("<u2").tobytes()], pa.binary()), "closing": pa.array([closing], pa.list_(pa.int64()))})

        for keys, ids, ends in encoded_blocks(itertools.chain([first], batches), path, speculate=False):
            # the end id behind each document's ids
            n = len(ends) - 1
            flat = np.insert(ids, ends[1:], end_id)
            held.append(flat)
            closes = size + ends[1:] + np.arange(n)  # places of the ends in what is held
            names += zip(closes.tolist(), keys.to_pylist())
            size += len(flat)
            if size >= block_tokens:
                joined = np.concatenate(held)
                while size >= block_tokens:
                    cutting = next((i for i, (p, _) in enumerate(names) if p >= block_tokens), len(names))
                    yield cut(joined[:block_tokens], [k for _, k in names[:cutting]])
                    joined, size, block = joined[block_tokens:], size - block_tokens, block + 1
                    names = [(p - block_tokens, k) for p, k in names[cutting:]]
                held = [joined]
        if size:
            yield cut(np.concatenate(held), [k for _, k in names])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "file long, block long, ids binary, closing array<long>"))


def read_files(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, ids) of real flat files of any size: ranges of bytes, dealt to tasks, each read by itself.

    ``path`` must be on a file system that the tasks can open (local, HDFS, or an object store).  An empty file has no block; the bytes of a broken
    last id, fewer than ``token_bytes``, are left out.
    """
    step = block_tokens * token_bytes
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the listing alone
    at = F.explode(F.expr(f"sequence(0L, length - length % {token_bytes} - 1, {step}L)"))
    ranges = files.where(F.col("length") >= token_bytes).select("path", (F.col("length") - F.col("length") % token_bytes).alias("size"), at.alias("at"))
    dealt = ranges.repartition("path", "at")

    def run(batches):
        for batch in batches:
            for name, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "at"))):
                fs, place = file_system(name)
                with fs.open_input_file(place) as stream:
                    stream.seek(begin)
                    ids = stream.read(min(step, size - begin))
                yield pa.RecordBatch.from_pydict({"path": [name], "block": pa.array([begin // step], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return dealt.mapInArrow(run, "path string, block long, ids binary").select(F.xxhash64("path").alias("file"), "block", "ids")


def summaries(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """``blocks`` without ids, with ``tokens`` and ``ends`` (places of separators in the block); bytes behind the last whole id do not count."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x or b"", dtype, len(x or b"") // width) for x in batch.column("ids").to_pylist()]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in found], pa.int64()), pa.array([np.flatnonzero(x == end_id) for x in found], pa.list_(pa.int64()))], names=[*(n for n in batch.schema.names if n != "ids"), "tokens", "ends"])

    kept = [(n, t) for n, t in blocks.dtypes if n != "ids"]
    return blocks.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept) + ", tokens long, ends array<long>")


def lengths(found: DataFrame, span: int = SPAN) -> DataFrame:
    """(file, ordinal, start, n_tokens[, doc_id]) of every document in the scanned blocks.

    ``n_tokens`` counts the ids before the separator.  The prefix scan has two levels, so
    no window holds more than ``span`` blocks or their sums: within spans, then over them.  Ids after
    the last separator of a file belong to no document and are left out.
    """
    wide = found.withColumn("_span", F.floor(F.col("block") / span))
    small = wide.select("file", "_span", "block", "tokens", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    inner = Window.partitionBy("file", "_span").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = small.withColumns({"t0": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "s0": F.coalesce(F.sum("n").over(before), F.lit(0))})
    local = local.withColumn("l0", F.last(F.col("last") + F.col("t0"), True).over(before))
    sums = small.groupBy("file", "_span").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    ends = local.groupBy("file", "_span").agg(F.max(F.col("last") + F.col("t0")).alias("last"))
    outer = Window.partitionBy("file").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.join(ends, ["file", "_span"]).withColumns({"T": F.coalesce(F.sum("tokens").over(outer), F.lit(0)), "S": F.coalesce(F.sum("n").over(outer), F.lit(0))})
    spans = spans.withColumn("L", F.last(F.col("last") + F.col("T"), True).over(outer)).select("file", "_span", "T", "S", "L")
    base = local.join(spans, ["file", "_span"]).select("file", "block", (F.col("t0") + F.col("T")).alias("t0"), (F.col("s0") + F.col("S")).alias("s0"), F.coalesce(F.col("l0") + F.col("T"), F.col("L"), F.lit(-1)).alias("l0"))
    joined = found.join(base, ["file", "block"])
    named = "closing" in found.columns
    each = joined.select("file", "t0", "s0", "l0", "ends", *(["closing"] * named), F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("l0") + 1).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + F.col("t0") + 1)
    out = [F.col("file"), (F.col("s0") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("t0") + F.col("end") - start).alias("n_tokens")]
    return each.select(*([F.element_at("closing", F.col("k") + 1).alias("doc_id")] * named), *out)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, span: int = SPAN) -> DataFrame:
    """Write flat files of all rows and scan them: (doc_id, file, ordinal, start, n_tokens).

    Null and empty texts have no tokens; repeated rows are documents each; a null doc_id
    stays null; an empty table gives an empty result; other columns are ignored.
    """
    blocks = write_blocks(docs, vocabulary, block_tokens=block_tokens)
    return lengths(stored(summaries(blocks)), span)
