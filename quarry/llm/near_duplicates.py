"""Near-duplicates by ProbMinHash, banding and verification.

Texts are five-word shingles, weighted by 1 + ln(count in the text).  In ProbMinHash every shingle is a
Poisson process whose rate is its weight; arrivals hit random slots, each slot keeps its earliest shingle, and a
shingle stops when its next arrival is later than every slot's.  Equal slots of two texts estimate their
probability Jaccard similarity.  Two texts are linked where that, verified on whole weighted shingles, reaches the
threshold, or where their plain Jaccard similarity does: a line that is repeated unequally often lowers the first
but not the second.  So texts that repeat shingles are sketched a second time with equal rates; for all others both sketches are the
same, and both kinds of bands share their buckets.  In a bucket every text is paired with two
centres only, never with all others; pairs are verified, and
verified links are joined to classes.  In buckets that then hold several classes the texts outside the
largest class are paired with a centre of that class.  What still shares a bucket
without sharing a class is compared in blocks of bounded size, inside tasks that give links only, so no
link of a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import NARROW_ROWS, fresh_worker, sized, stored, tidy, unused, with_small

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of a block.
BLOCK = 256
SLOTS = BANDS * ROWS
#: Equal slots, of ``SLOTS``, below which (in both sketches) two texts of a block are not compared whole.  Slots are independent, each equal
#: with the probability of the similarity, so a pair at 0.8 has fewer with a chance of 1 in 10^13.
LEAST_SLOTS = 60


def shingles(batch_hashes: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, index of their text), repeated ones included.

    A text of fewer than ``k`` words has one shingle of all its words; no words, none.
    """
    n = np.diff(ends)
    owner = words.owners(ends)
    rolled = words.rolling(batch_hashes, k)
    inside = owner[: len(rolled)] == owner[k - 1 : k - 1 + len(rolled)] if len(rolled) else np.empty(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    few = np.array([xxhash.xxh64_intdigest(batch_hashes[ends[i] : ends[i + 1]].tobytes(), seed=1) for i in short], np.uint64)
    return np.concatenate([rolled[inside], few]), np.concatenate([owner[: len(rolled)][inside], short])


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text), ordered by text and hash, and how often each occurs."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]) if len(hashes) else np.empty(0, bool)
    counts = np.diff(np.concatenate([np.flatnonzero(first), [len(hashes)]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], text[first], counts


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(hashes: np.ndarray, text: np.ndarray, rate: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """ProbMinHash signatures (n_texts x slots) of distinct shingles (hash, text) that arrive at these rates."""
    best = np.full(n_texts * slots, np.inf)
    kept = np.zeros(n_texts * slots, np.uint64)
    time, turn = np.zeros(len(hashes)), 0
    while len(hashes):
        turn += 1
        with np.errstate(over="ignore"):
            noise = words.mix(hashes + words.GOLDEN * np.uint64(turn))
        time = time - np.log(((noise >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / rate
        slot = text * slots + ((noise & np.uint64(0xFFFF)).astype(np.int64) * slots >> 16)
        early = time < best[slot]
        s, t = slot[early], time[early]
        np.minimum.at(best, s, t)
        won = best[s] == t
        kept[s[won]] = hashes[early][won]
        if turn % 4 == 1 or len(hashes) < 20000:
            latest = best.reshape(n_texts, slots).max(1)
        go = time < latest[text]
        hashes, text, rate, time = hashes[go], text[go], rate[go], time[go]
    return kept.reshape(n_texts, slots)


def sketches(hashes: np.ndarray, text: np.ndarray, counts: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted signatures of all texts, numbers of the texts that repeat a shingle, signatures of these by equal rates)."""
    again = np.zeros(n_texts, bool)
    again[text[counts > 1]] = True
    place = np.cumsum(again) - 1
    own = again[text]
    plain = signatures(hashes[own], place[text[own]], np.ones(own.sum()), int(again.sum()), SLOTS)
    return signatures(hashes, text, weights(counts), n_texts, SLOTS), np.flatnonzero(again), plain


def buckets(whole: np.ndarray, again: np.ndarray, plain: np.ndarray) -> list[np.ndarray]:
    """Distinct bucket hashes of every text: 24 of its signature, and up to 24 more where it has two."""

    def hashed(sig):
        with np.errstate(over="ignore"):
            return words.mix(words.rolling_rows(sig.reshape(len(sig), BANDS, ROWS)) + words.GOLDEN * np.arange(BANDS, dtype=np.uint64))

    out = list(hashed(whole))
    for i, more in zip(again, hashed(plain)):
        out[i] = np.unique(np.concatenate([out[i], more]))
    return out


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, k1, k2, bands) of every row: 128 bits of its words, and its bucket hashes.

    Equal word sequences have equal keys.  A text without words has no bands.
    """

    def run(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                n = len(ends) - 1
                keys = np.array([[xxhash.xxh64_intdigest(hashes[a:b].tobytes(), seed=s) for s in (2, 3)] for a, b in zip(ends, ends[1:])], np.uint64).reshape(n, 2)
                bands = buckets(*sketches(*counted(*shingles(hashes, ends)), n))
                some = np.diff(ends) > 0
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "text_hash": part.column("text_hash"), "k1": keys[:, 0].view(np.int64), "k2": keys[:, 1].view(np.int64), "bands": pa.array([b.view(np.int64) if s else [] for b, s in zip(bands, some)], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(run), "doc_id long, text_hash long, k1 long, k2 long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of stored ``edges`` (a, b): the least node it is joined to.

    Each round takes the least label around every node, then the label of its label; each is
    cut off as a stored table, so a round costs the same and survives lost executors.
    """
    both = sized(stored(sized(edges).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = with_small(both, labels.withColumnRenamed("node", "b"), "b", "inner", NARROW_ROWS).groupBy("a").agg(F.min("label").alias("near"))
        step = with_small(around.withColumnRenamed("a", "node"), labels, "node", "inner", NARROW_ROWS)
        step = stored(step.select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        if step.where("label <> old").isEmpty():
            return labels
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = stored(with_small(step, jump, "label", "left", NARROW_ROWS).select("node", F.least("label", F.coalesce("up", "label")).alias("label")))


def sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (node, s, c, sig, bands) of the stored ``nodes``: the shingle set, a byte of every slot, and the bucket hashes.

    ``c`` counts the shingles of a text that repeats some and is empty for all others; only such a text has two signatures.
    Made anew from the text of the first document of each node.
    """
    wanted = stored(with_small(classes, nodes, "node", "inner", NARROW_ROWS).select("node", F.col("first").alias("doc_id"), "k1", "k2"))

    def make(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                n = len(ends) - 1
                keys = np.array([[xxhash.xxh64_intdigest(hashes[a:b].tobytes(), seed=s) for s in (2, 3)] for a, b in zip(ends, ends[1:])], np.uint64).reshape(n, 2).view(np.int64)
                right = (keys[:, 0] == part.column("k1").to_numpy()) & (keys[:, 1] == part.column("k2").to_numpy())
                value, text = shingles(hashes, ends)
                whole, again, plain = sketches(*counted(value, text), n)
                bands = buckets(whole, again, plain)
                sig = [x.tobytes() for x in whole.astype(np.uint8)]
                for i, more in zip(again, plain.astype(np.uint8)):
                    sig[i] += more.tobytes()
                value, text, counts = counted((value >> np.uint64(32)).astype(np.uint32), text)
                cut = np.searchsorted(text, np.arange(n + 1))
                counts = [x.astype(np.uint32).tobytes() if (x > 1).any() else b"" for x in (counts[a:b] for a, b in zip(cut, cut[1:]))]
                at = np.flatnonzero(right)
                binary = lambda values: pa.array([values(i) for i in at], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"node": part.column("node").take(pa.array(at)), "s": binary(lambda i: value[cut[i] : cut[i + 1]].tobytes()), "c": binary(lambda i: counts[i]), "sig": binary(lambda i: sig[i]), "bands": binary(lambda i: bands[i].tobytes())})  # noqa: B023

    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    found = with_small(texts, wanted, "doc_id", "inner", NARROW_ROWS).select("node", "k1", "k2", "text").mapInArrow(tidy(make), "node long, s binary, c binary, sig binary, bands binary")
    return stored(found.dropDuplicates(["node"]))


def probability_jaccard(x: np.ndarray, y: np.ndarray, x_rest: float, y_rest: float) -> float:
    """Probability Jaccard similarity of two weighted sets: weights ``x`` and ``y`` of what they share, sums of all else of each.

    Sum over the shared i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); ordered by x_j / y_j, each j is on one side of that maximum.
    """
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    upper = x_rest + np.cumsum(x[::-1])[::-1]
    lower = y_rest + np.cumsum(y) - y
    return float((1 / (upper / x + lower / y)).sum())


def likeness(one: tuple[bytes, bytes], other: tuple[bytes, bytes], least: float) -> float:
    """Plain Jaccard similarity of two texts (``s``, ``c`` of each) where it is ``least`` or more, else their probability Jaccard similarity."""
    x, m, y, n = (np.frombuffer(v, np.uint32) for v in (*one, *other))
    even = not len(m) and not len(n)
    if even and min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    union = len(x) + len(y) - len(both)
    if even or len(both) >= least * union:
        return len(both) / union if union else 0.0
    wx, wy = (weights(c) if len(c) else np.ones(len(v)) for v, c in ((x, m), (y, n)))
    return probability_jaccard(wx[i], wy[j], wx.sum() - wx[i].sum(), wy.sum() - wy[j].sum())


def verified(made: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Stored (a, b, likeness) of nodes that are that similar on their whole shingles, of stored candidate ``pairs``.

    ``made`` has the sets.  A hot centre's set meets its many partners in a sort-merge join that adaptive execution splits.
    """

    def compare(batches):
        for batch in batches:
            found = np.array([likeness((s, c), (t, d), similarity) for s, c, t, d in zip(*(batch.column(x).to_pylist() for x in ("s", "c", "t", "d")))], np.float64)
            good = pa.array(found >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(found).filter(good)], names=["a", "b", "likeness"])

    joined = pairs.join(made.select(F.col("node").alias("a"), "s", "c"), "a").join(made.select(F.col("node").alias("b"), F.col("s").alias("t"), F.col("c").alias("d")), "b")
    return stored(joined.select("a", "b", "s", "c", "t", "d").mapInArrow(tidy(compare), "a long, b long, likeness double"))


def links(members: list[dict], bucket: int, similarity: float) -> list[tuple[int, int, float]]:
    """Links (nodes, likeness) that join the classes of ``members`` (side, node, label, sig, bands, s, c) of one pair of blocks of a bucket.

    Sides 0 and 1 meet each other; where there is no side 1, side 0 meets itself.  A pair is looked at in
    the least bucket that it shares, and only while its classes are apart.
    """
    members = sorted(members, key=lambda m: (m["side"], m["node"]))
    labels = [m["label"] for m in members]
    up = {x: x for x in labels}
    if len(up) < 2:
        return []

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # a text with one signature has it in place of the second, and buckets fill up with themselves
    sig = np.frombuffer(b"".join((m["sig"] * 2)[: 2 * SLOTS] for m in members), np.uint8).reshape(len(members), 2, SLOTS)
    bands = np.frombuffer(b"".join((m["bands"] * 2)[: 16 * BANDS] for m in members), np.uint64).reshape(len(members), 2 * BANDS)
    here = np.array([bucket], np.int64).view(np.uint64)[0]
    whole = [(m["s"], m["c"]) for m in members]
    side = np.array([m["side"] for m in members])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    name = np.array(labels)
    out = []
    for i in left.tolist():
        others = right if len(right) else left[left > i]
        others = others[name[others] != name[i]]
        others = others[((sig[others] == sig[i]).sum(2) >= LEAST_SLOTS).any(1)]
        lower = np.isin(bands[others], bands[i]) & (bands[others] < here)
        for j in others[~lower.any(1)].tolist():
            a, b = top(labels[i]), top(labels[j])
            if a != b:
                found = likeness(whole[i], whole[j], similarity)
                if found >= similarity:
                    up[a] = b
                    out.append((members[i]["node"], members[j]["node"], found))
    return out


def mixed(own: DataFrame) -> DataFrame:
    """Stored (bucket, main, centre, mains, rests) of the buckets of ``own`` (node, bucket, label) that hold several classes.

    ``main`` is the largest class of the bucket, ``centre`` its least node there, ``mains`` and ``rests`` count its members and the others.
    """
    sizes = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label", "centre")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return stored(sizes.select("bucket", F.col("m.label").alias("main"), F.col("m.centre").alias("centre"), F.col("m.n").alias("mains"), (F.col("all") - F.col("m.n")).alias("rests")))


def crossed(made: DataFrame, own: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Stored links (a, b, likeness) of nodes that join all members of a bucket that are in different classes.

    ``own`` has (node, bucket, label), ``buckets`` is what ``mixed`` gave.  In a bucket, members of its largest class meet the others,
    and the others meet each other, in blocks of about ``BLOCK`` texts by a hash; a group is one pair of
    blocks, so its size is bounded, and it gives fewer links than it has members.  A bucket of no more than ``BLOCK`` texts is one group.
    """
    blocks = buckets.select("bucket", "main", (F.col("mains") + F.col("rests") <= BLOCK).alias("one"), F.ceil(F.col("mains") / BLOCK).alias("mains"), F.ceil(F.col("rests") / BLOCK).alias("rests"))
    members = with_small(own, blocks, "bucket", "inner", NARROW_ROWS)
    to = """CASE WHEN one THEN array(named_struct('inner', true, 'x', 0L, 'y', 0L, 'side', 0))
        WHEN label = main THEN transform(sequence(0L, rests - 1), i -> named_struct('inner', false, 'x', i, 'y', pmod(xxhash64(node, 1), mains), 'side', 1))
        ELSE concat(transform(sequence(0L, rests - 1), i -> named_struct('inner', true, 'x', least(i, pmod(xxhash64(node, 1), rests)), 'y', greatest(i, pmod(xxhash64(node, 1), rests)), 'side', if(i < pmod(xxhash64(node, 1), rests), 1, 0))),
            transform(sequence(0L, mains - 1), j -> named_struct('inner', false, 'x', pmod(xxhash64(node, 1), rests), 'y', j, 'side', 0))) END"""
    dealt = stored(members.select("bucket", "node", "label", F.explode(F.expr(to)).alias("to")).select("bucket", "node", "label", "to.*"))
    grouped = dealt.join(made, "node").groupBy("bucket", "inner", "x", "y").agg(F.collect_list(F.struct("side", "node", "label", "sig", "bands", "s", "c")).alias("members"))

    def run(batches):
        fresh_worker()
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                found += links(batch.column("members")[k].as_py(), batch.column("bucket")[k].as_py(), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

    return stored(grouped.select("bucket", "members").mapInArrow(tidy(run), "a long, b long, likeness double"))


def contracted(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Stored (node, label) after the labels of ``labels`` went over into those of ``step`` (components of labels)."""
    moved = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = with_small(labels, moved, "label", "left", NARROW_ROWS).select("node", F.coalesce("to", "label").alias("label"))
    fresh = with_small(step, labels.select("node"), "node", "left_anti", NARROW_ROWS)
    return stored(known.unionByName(fresh))


def find(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of, linked_to, likeness, n_links, k1, k2, text_hash) of every distinct (doc_id, text) of the table.

    ``class_id`` is the least doc_id of the near-duplicate class, ``copy_of`` the least of
    the exact copies (equal words).  ``linked_to`` is the document by which a row hangs on its class, and ``likeness`` how alike they are: for a copy
    ``copy_of`` and 1, else the most alike (then least) of the verified links of its text, null without any; ``n_links`` counts these links.  Rows without words, null texts too, are classes of their own; rows
    without doc_id take part as a document whose id is unknown: they join no class of
    others and stay; repeated rows give one row.  Texts of any length are taken whole; other columns are
    ignored; an empty table gives an empty result.
    """
    mark = stored(marked(docs))
    some = mark.where("size(bands) > 0 AND doc_id IS NOT NULL")
    # equal words have equal bands: a class has the bands of any of its copies
    exact = stored(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    # a node is 64 bits of the key; the rare keys that share them take other bits
    shared = stored(exact.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", F.lit(True).alias("shared")))
    if shared.isEmpty():
        exact = exact.withColumn("node", F.col("k1"))
    else:
        exact = stored(with_small(exact, shared, "k1").withColumn("node", F.when(F.col("shared"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("shared"))
    banded = exact.select("node", F.explode("bands").alias("bucket"))
    exact = exact.drop("bands")
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    placed = stored(banded.join(crowded, "bucket"))
    made = sets(docs, exact, stored(placed.select("node").distinct()))
    ordered = lambda p: p.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    tried = stored(ordered(placed.select("node", F.explode(F.filter(F.array("low", "high"), lambda c: c != F.col("node"))).alias("centre"))))
    near = verified(made, tried, similarity)
    labels = components(near.select("a", "b"))
    named = lambda: with_small(placed, labels, "node", "left", NARROW_ROWS).select("node", "bucket", F.coalesce("label", "node").alias("label"))
    # texts outside the largest class of their bucket against a centre of that class
    outside = with_small(named(), mixed(named()), "bucket", "inner", NARROW_ROWS).where("label <> main").select("node", "centre")
    new = stored(with_small(ordered(outside), tried, ["a", "b"], "left_anti", NARROW_ROWS))
    to_labels = lambda p: stored(with_small(with_small(p, labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left", NARROW_ROWS), labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left", NARROW_ROWS).select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    more = verified(made, new, similarity)
    labels = contracted(labels, components(to_labels(more)))
    # the exact way for the rest: members of a bucket that are still apart
    own = stored(named())
    rest = crossed(made, own, mixed(own), similarity)
    labels = contracted(labels, components(to_labels(rest)))
    classes = with_small(exact, labels, "node", "left", NARROW_ROWS).withColumn("label", F.coalesce("label", "node"))
    least = stored(with_small(exact, labels, "node", "inner", NARROW_ROWS).groupBy("label").agg(F.min("first").alias("class_id")))
    classes = with_small(classes, least, "label", "left", NARROW_ROWS).withColumn("class_id", F.coalesce("class_id", "first"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "likeness"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "likeness"))
    every = near.unionByName(more).unionByName(rest).select(F.explode(ends).alias("e")).select("e.*")
    other = stored(exact.join(made.select("node"), "node", "left_semi").select(F.col("node").alias("other"), F.col("first").alias("other_first")))
    best = F.max(F.struct("likeness", (-F.col("other_first")).alias("least")))
    hung = stored(with_small(every, other, "other", "inner", NARROW_ROWS).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"), best.alias("best")).select("node", "n_links", "best.likeness", (-F.col("best.least")).alias("linked_to")))
    classes = with_small(classes, hung, "node", "left", NARROW_ROWS)
    classes = stored(classes.select("k1", "k2", "class_id", F.col("first").alias("copy_of"), "linked_to", "likeness", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    whole = mark.select("doc_id", "text_hash", "k1", "k2", (F.size("bands") > 0).alias("some")).distinct()
    joined = whole.join(classes, ["k1", "k2"], "left")
    alone = ~F.col("some") | F.col("doc_id").isNull()
    copy = ~alone & (F.col("doc_id") != F.col("copy_of"))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(copy, F.col("copy_of")).when(~alone, F.col("linked_to")).alias("linked_to"),
        F.when(copy, F.lit(1.0)).when(~alone, F.col("likeness")).alias("likeness"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "k1", "k2", "text_hash",
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that stay when each class keeps the document of its least doc_id.

    Rows without words or doc_id stay; of rows that repeat a kept document's id and text all stay; columns stay as they are.
    """
    mark = unused(docs, "_text_hash")
    gone = find(docs, similarity).where("doc_id IS NOT NULL AND class_id <> doc_id").select("doc_id", F.col("text_hash").alias(mark))
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    return with_small(keyed, stored(gone), ["doc_id", mark], "left_anti").select(*docs.columns)
