"""Training-order materialisation: a keyed permutation gives every sequence its slot.

Documents are tokenised and put on end within a scan partition, an end id after each, and cut into
sequences of one length, which are stored once, packed.  Counts of the partitions give each its range of sequence numbers; a
keyed Feistel network over the next power of four, walked until the value is in
range, maps numbers to slots one to one.  Slots are dealt in ranges: a task writes neighbouring shards in
order, and every shard, a fixed number of slots of fixed stride, is one raw file of
little-endian unsigned 16-bit ids that can be read from any slot on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoded_blocks
from .common import file_system, partitions, shared_dir, stored

ROUNDS = 6
#: Shards of a task on large inputs.
SHARDS_A_TASK = 16
#: Ids that the vocabulary leaves free: after each document, and behind the last document of a scan partition.
END_ID, PAD_ID = 49408, 49409
ID_BYTES = 2
DOCS = "array<struct<doc_id:long,start:long,n_tokens:long,place:long>>"


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """Slots in [0, total) of sequence numbers in [0, total): a keyed permutation."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            with np.errstate(over="ignore"):
                f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ f >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (f >> np.uint64(32) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str | None = None, length: int = 4096) -> DataFrame:
    """Stored (part, number, ids, docs) of all rows: sequence ``number`` of scan partition ``part``.

    ``ids`` are packed by zstd; ``docs`` are the pieces (doc_id, start in the document, n_tokens, place in the sequence).
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        import itertools

        import zstandard
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        part, number, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3).compress
        held, held_from = np.empty(0, "<u2"), 0
        keys, begins, stop = pa.array([], pa.int64()), np.empty(0, np.int64), 0  # documents of what is held, and where the last ends

        def emit(n):
            nonlocal held, held_from, keys, begins, number
            end = held_from + n * length
            # a piece begins with a document or a sequence
            cuts = np.union1d(begins[begins < min(end, stop)], np.arange(held_from, min(end, stop), length))
            cuts = cuts[cuts >= held_from]
            owner = np.searchsorted(begins, cuts, side="right") - 1
            sizes = np.diff(np.append(cuts, min(end, stop)))
            fields = [keys.take(pa.array(owner)), pa.array(cuts - begins[owner]), pa.array(sizes), pa.array((cuts - held_from) % length)]
            pieces = pa.StructArray.from_arrays(fields, names=["doc_id", "start", "n_tokens", "place"])
            bounds = np.searchsorted((cuts - held_from) // length, np.arange(n + 1))
            ids = np.full(n * length, PAD_ID, "<u2")
            ids[: len(held[: n * length])] = held[: n * length]
            raw = ids.tobytes()
            out = pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int64)), "number": pa.array(np.arange(number, number + n)), "ids": pa.array([pack(raw[i * length * ID_BYTES : (i + 1) * length * ID_BYTES]) for i in range(n)], pa.binary()), "docs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces)})
            number, held, held_from = number + n, held[n * length :], end
            going = max(0, int(np.searchsorted(begins, end, side="right")) - 1)
            keys, begins = keys.slice(going), begins[going:]
            return out

        for names, ids, ends in encoded_blocks(itertools.chain([first], batches), path, speculate=False):
            fresh = np.insert(ids, ends[1:], END_ID).astype("<u2")
            keys = pa.concat_arrays([keys, names.cast(pa.int64())])
            begins = np.concatenate([begins, stop + ends[:-1] + np.arange(len(ends) - 1)])
            stop += len(fresh)
            held = np.concatenate([held, fresh])
            if len(held) >= length:
                yield emit(len(held) // length)
        if len(held):
            yield emit(1)

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"part long, number long, ids binary, docs {DOCS}"))


def write_shards(docs: DataFrame, vocabulary: str | None = None, key: int = 20, length: int = 4096, shard_slots: int = 2048) -> tuple[DataFrame, str]:
    """Write the ids of all rows in training order; (manifest, folder).

    The manifest has a row for each sequence and document in it: (doc_id, slot, shard, path (of the shard's file), offset
    (byte of the sequence in it), sequence, start (id of the document), n_tokens, place (in the sequence)).
    Files are written under another name and renamed when whole; a task that is run
    again gives the same files and leaves one that is there as it is.  Null and empty texts have the end id alone; rows with equal
    or null doc_ids are documents each; a text of any length is cut, none is dropped; other columns are ignored; an empty table writes nothing.
    """
    spark = docs.sparkSession
    cut = sequences(docs, vocabulary, length)
    base, total = {}, 0
    for part, n in sorted(cut.groupBy("part").count().collect()):  # a row for each scan partition
        base[part] = total
        total += n
    shared = spark.sparkContext.broadcast(base)
    folder = shared_dir(spark)

    def place(batches):
        for batch in batches:
            numbers = batch.column("number").to_numpy() + np.fromiter(map(shared.value.__getitem__, batch.column("part").to_pylist()), np.int64, batch.num_rows)
            slot = slots(numbers, total, key)
            yield pa.RecordBatch.from_pydict({"sequence": pa.array(numbers), "slot": pa.array(slot), "shard": pa.array(slot // shard_slots), "ids": batch.column("ids"), "docs": batch.column("docs")})

    shards = max(1, -(-total // shard_slots))
    tasks = min(shards, max(4 * partitions(spark), shards // SHARDS_A_TASK))  # a task's share does not grow with the input
    placed = cut.mapInArrow(place, f"sequence long, slot long, shard long, ids binary, docs {DOCS}")
    # slots are known to be 0 to total - 1, so ranges need no sample
    dealt = placed.repartitionById(tasks, F.expr(f"cast(floor(shard * {tasks}L / {shards}L) as int)")).sortWithinPartitions("slot")

    def write(batches):
        import uuid

        import zstandard

        fs, root = file_system(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        shard, stream, held = None, None, ""

        def close():
            if stream is not None:
                stream.close()
                whole = f"{root}/shard-{shard:08d}.bin"
                if fs.get_file_info(whole).is_file:
                    fs.delete_file(held)  # an earlier try of this task wrote the same file
                else:
                    fs.move(held, whole)

        try:
            for batch in batches:
                for s, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                    if s != shard:
                        close()
                        fs.create_dir(f"{root}/_unfinished", recursive=True)
                        shard, held = s, f"{root}/_unfinished/{uuid.uuid4().hex}"
                        stream = fs.open_output_stream(held)
                    stream.write(unpack(ids))
                yield batch.drop_columns(["ids"])
            close()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
                fs.delete_file(held)
            raise

    manifest = stored(dealt.mapInArrow(write, f"sequence long, slot long, shard long, docs {DOCS}"))
    if total:
        fs, root = file_system(folder)
        fs.delete_dir(f"{root}/_unfinished")  # with what lost tasks left
    each = manifest.withColumn("d", F.explode("docs"))
    path = F.concat(F.lit(f"{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    return each.select("d.doc_id", "slot", "shard", path.alias("path"), (F.col("slot") % shard_slots * length * ID_BYTES).alias("offset"), "sequence", "d.start", "d.n_tokens", "d.place"), folder


def read_shards(spark: SparkSession, folder: str, length: int = 4096, shard_slots: int = 2048, first_slot: int = 0) -> DataFrame:
    """(slot, ids) of the shards in ``folder`` from ``first_slot`` on: ids are ``length`` little-endian unsigned 16-bit integers.

    Earlier shards are not opened.
    """
    stride = length * ID_BYTES

    def run(batches):
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                fs, at = file_system(path)
                slot = max(first_slot, shard * shard_slots)
                with fs.open_input_file(at) as stream:
                    stream.seek((slot - shard * shard_slots) * stride)
                    while raw := stream.read(256 * stride):
                        n = len(raw) // stride
                        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(slot, slot + n)), "ids": pa.array([raw[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())})
                        slot += n

    # the listing alone: contents are read by the tasks, from the first slot on
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
    return files.select(shard.alias("shard"), "path").where(F.col("shard") >= first_slot // shard_slots).mapInArrow(run, "slot long, ids binary")


def read_from(folder: str, slot: int = 0, length: int = 4096, shard_slots: int = 2048):
    """Sequences (arrays of ids) from ``slot`` on, one after the other: what a trainer that resumes reads."""
    fs, root = file_system(folder)
    shard, stride = slot // shard_slots, length * ID_BYTES
    while fs.get_file_info(f"{root}/shard-{shard:08d}.bin").is_file:
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as stream:
            stream.seek((slot - shard * shard_slots) * stride)
            while raw := stream.read(stride):
                yield np.frombuffer(raw, "<u2")
        shard += 1
        slot = shard * shard_slots
