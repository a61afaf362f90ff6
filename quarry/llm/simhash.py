"""SimHash near-duplicates by exact comparison of tiles.

A text's 64 bits are majority votes of its three-word shingles' XXH64.  Equal fingerprints are one node.  A tile holds the
nodes with equal population counts in each of four 16-bit parts; two fingerprints at a distance of at most the radius have counts
that differ by no more in sum, so of a tile's partners only those within the radius are met (129 of 83,521 at radius 3), and no
link is lost.  Tiles are cut into blocks by a hash; a pair of blocks is compared whole in numpy, by exclusive-or and bit
counts, and gives a spanning forest of its links: fewer edges than it has nodes, however many pairs are near.  Components of all
edges are the classes.

The work is that of comparing about 5 % of all pairs of different fingerprints, so it grows with their square; bounded groups
spread it over any number of tasks.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, fresh_worker, stored, tidy, with_small
from .near_duplicates import components

SHINGLE, SEED, RADIUS, PARTS = 3, 42, 3, 4
#: Fingerprints of a block, as a mean, and comparisons made at once.
BLOCK, AT_ONCE = 4096, 1 << 20
#: Shingles whose bits are counted at once.
STRETCH = 50_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits of a text: those that over half of its shingles' hashes have; of a text without words, none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(k, len(words))
    starts, ends = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist(), ends[k - 1 :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), STRETCH):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STRETCH], ends[at : at + STRETCH])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        fresh_worker()
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def near(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Edges (n x 2 values) that join every pair of ``a`` and ``b`` within the radius: a spanning forest of these links."""
    both = np.concatenate([a, b])
    label = np.arange(len(both))
    rows, held = max(1, AT_ONCE // max(1, len(b))), []
    for at in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        apart = a[at + x] != b[y]
        x, y = x[apart] + at, y[apart] + len(a)
        if len(x):
            # links of the stretch between what is still apart, one for each node and turn
            while True:
                lx, ly = label[x], label[y]
                open_ = lx != ly
                if not open_.any():
                    break
                x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
                high, low = np.maximum(lx, ly), np.minimum(lx, ly)
                first = np.unique(high, return_index=True)[1]
                held.append(np.stack([x[first], y[first]], 1))
                to = np.arange(len(both))
                to[high[first]] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
    return both[np.concatenate(held)] if held else np.empty((0, 2), both.dtype)


def tile(fp: str = "fp") -> str:
    """SQL of a fingerprint's tile: five bits for the population count of each part."""
    width = 64 // PARTS
    return " + ".join(f"shiftleft(bit_count(shiftrightunsigned({fp}, {width * p}) & {(1 << width) - 1}), {5 * p})" for p in range(PARTS))


def offsets(radius: int = RADIUS) -> list[int]:
    """What may lie between the tiles of two near fingerprints, each pair of tiles once, its own left out."""
    steps = (s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius)
    return sorted(d for s in steps if (d := sum(x << 5 * p for p, x in enumerate(s))) > 0)


def linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stored edges (a, b) that join all of the stored, distinct ``nodes`` (fp) within the radius."""
    tiled = nodes.select("fp", F.expr(tile()).alias("tile"))
    # at most 17 ** 4 = 83,521 rows of two numbers, whatever the table
    sizes = stored(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    dealt = tiled.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    blocks = stored(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps"), F.first("blocks").alias("blocks")))
    way = ",".join(map(str, offsets(radius)))
    other = F.explode(F.expr(f"transform(array({way}), d -> tile + d)")).alias("to_tile")
    beside = blocks.select("tile", "block", other).join(F.broadcast(sizes.select(F.col("tile").alias("to_tile"), F.col("blocks").alias("n"))), "to_tile")
    beside = beside.select("tile", "block", "to_tile", F.explode(F.expr("sequence(0L, n - 1)")).alias("to_block"))
    within = blocks.select("tile", "block", F.col("tile").alias("to_tile"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("to_block"))
    pairs = beside.unionByName(within).join(blocks.select("tile", "block", "fps"), ["tile", "block"])
    pairs = pairs.join(blocks.select(F.col("tile").alias("to_tile"), F.col("block").alias("to_block"), F.col("fps").alias("to_fps")), ["to_tile", "to_block"])

    def run(batches):
        fresh_worker()
        for batch in batches:
            found = [np.empty((0, 2), np.uint64)]
            for a, b in zip(batch.column("fps"), batch.column("to_fps")):
                found.append(near(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)), radius))
            edges = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return stored(pairs.select("fps", "to_fps").mapInArrow(tidy(run), "a long, b long").distinct())


def find(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: ``fp`` the fingerprint as a signed number, ``component_id`` the least doc_id that links reach.

    Null and empty texts, and those without words, have fingerprint zero and link like others; a text with fewer words than a
    shingle is one shingle.  Rows without doc_id link, but name no component: where none of it has an id, that is null.
    Repeated rows are repeated; other columns are ignored; an empty table gives an empty result.
    """
    mark = stored(marked(docs))
    nodes = stored(mark.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(linked(nodes.select("fp"), radius))
    named = with_small(nodes, labels.withColumnRenamed("node", "fp"), "fp", "left", NARROW_ROWS).withColumn("label", F.coalesce("label", "fp"))
    named = stored(named)
    least = stored(with_small(named, labels.select(F.col("node").alias("fp")), "fp", "inner", NARROW_ROWS).groupBy("label").agg(F.min("first").alias("least")))
    ids = stored(with_small(named, least, "label", "left", NARROW_ROWS).select("fp", F.coalesce("least", "first").alias("component_id")))
    return with_small(mark, ids, "fp", "inner", NARROW_ROWS).select("doc_id", "fp", "component_id")
