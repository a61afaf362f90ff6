"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

Seeds are minimizers: of every stretch of ``WINDOW`` k-mers of words the least by hash.  The
document of the least doc_id that holds a seed is its anchor, and every other occurrence is
matched to its first place in the anchor alone, so a seed that thousands share gives thousands of matches, not
their square.  Matches of a document are chained for each anchor: a match extends the best chain
that ends before it on both sides, found with a Fenwick tree of prefix maxima, at a cost
for the gap.  Chains are cut into segments by tiles of the anchor, joined to the anchor's words and
aligned word by word, with extension over both ends.  The aligned chain is cut into the stretches that are
long and alike enough, so passages with an unlike gap between are found each.

The anchor of a seed may hold only a part of what two other documents share.  Stretches whose seeds are shared
but that lie in no passage are therefore searched again by all their runs of ``LEAST_WORDS`` words, each
matched to the least document that holds the whole run: of a run that a lower document repeats word by word at most
``WINDOW - 1`` words at either end are lost, and those only where a passage with another document covers the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import NARROW_ROWS, fresh_worker, parted, sketch, stored, tidy, unused, with_small

K, WINDOW = 8, 16
#: Cost of a word of gap, on each side, in words gained.
GAP_COST = 0.1
#: Words of a tile of an anchor, and of margin around segments and tiles.
TILE, MARGIN = 256, 64
#: Segments that are aligned with one copy of a tile.
SEGMENTS_A_COPY = 500
#: A passage has so many words at least, and this share of them equal.
LEAST_WORDS, LEAST_EQUAL = 50, 0.8


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """Minimum or maximum of every ``n`` in a row, by doubling."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = least(x[: len(x) - step], x[step:])
        span += step
    return x


def minimizers(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in the text, places it stands for beyond) of the seeds of all texts, every place of a repeated seed.

    Of a seed that follows itself, as in a line repeated on end, one place in ``WINDOW`` words is enough; it stands for those after it.
    """
    owner = words.owners(ends)
    rolled = words.rolling(hashes, K)
    if not len(rolled):
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    inside = owner[: len(rolled)] == owner[K - 1 :]
    top = np.uint64(2**64 - 1)
    value = np.where(inside, np.minimum(rolled, top - np.uint64(1)), top)
    wide = np.concatenate([np.full(WINDOW - 1, top), value, np.full(WINDOW - 1, top)])
    # a k-mer is a seed if it is the least of some window around it
    chosen = _sliding(_sliding(wide, WINDOW, np.minimum), WINDOW, np.maximum) == value
    at = np.flatnonzero(chosen & inside)
    seed, text = rolled[at], owner[at]
    place = at - ends[text]
    again = np.zeros(len(at), bool)
    again[1:] = (seed[1:] == seed[:-1]) & (text[1:] == text[:-1]) & (place[1:] // WINDOW == place[:-1] // WINDOW)
    first = np.flatnonzero(~again)
    more = place[np.append(first[1:], len(at)) - 1] - place[first] if len(at) else place
    return seed[first], text[first], place[first], more


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, place, more) of all rows."""

    def run(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                seed, text, place, more = minimizers(hashes, ends)
                yield pa.RecordBatch.from_pydict({"seed": seed.view(np.int64), "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(text)), "place": pa.array(place.astype(np.int32)), "more": pa.array(more.astype(np.int8))})

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "seed long, doc_id long, place int, more byte")


def chains(place: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Chains (indices of matches in order) of matches between two documents, sorted by (place, other)."""
    n = len(place)
    gap, shift = np.diff(place), np.diff(other)
    if n == 1 or (gap == shift).all() and (2 * GAP_COST * gap <= K).all() and (gap > 0).all():
        return [np.arange(n)]  # one diagonal without wide gaps: each match extends the one before
    rank = np.unique(other, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree = [(-1e18, -1)] * (size + 1)  # Fenwick tree: prefix maxima of score + cost so far
    score, before = [0.0] * n, [-1] * n
    place_l, other_l, rank_l = place.tolist(), other.tolist(), rank.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and place_l[j] == place_l[i]:  # matches at one place can't extend each other
            r, best = rank_l[j] - 1, (-1e18, -1)
            while r:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - GAP_COST * (place_l[j] + other_l[j])
            if best[1] >= 0 and gain > 0:
                # overlapping seeds add their new words only
                b = best[1]
                score[j], before[j] = gain + min(K, place_l[j] - place_l[b], other_l[j] - other_l[b]), b
            else:
                score[j] = float(K)
            j += 1
        for m in range(i, j):
            r, entry = rank_l[m], (score[m] + GAP_COST * (place_l[m] + other_l[m]), m)
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: -score[m]):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        if path:
            out.append(np.array(path[::-1]))
    return out


#: Ways over a difference, the smallest first: (words passed on one side, on the other).
STEPS = sorted(((a, b) for a in range(5) for b in range(5) if a + b), key=lambda s: (max(s), s[0] != s[1], s))
#: Equal words that must follow a difference.
AGREE = 4


def _extend(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """Pieces (words, words of the other, equal words) by which two stretches go on alike from their
    beginnings, over differences of a few words that are followed by equal ones."""
    i = j = 0
    out = []
    while True:
        n = min(len(own) - i, len(other) - j)
        differ = np.flatnonzero(own[i : i + n] != other[j : j + n])
        run = int(differ[0]) if len(differ) else n
        if run:
            out.append((run, run, run))
        i, j = i + run, j + run
        for a, b in STEPS if run < n else ():
            x, y = own[i + a : i + a + AGREE], other[j + b : j + b + AGREE]
            if len(x) == len(y) == AGREE and (x == y).all():
                out.append((a, b, 0))
                i, j = i + a, j + b
                break
        else:
            return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Words that a global alignment of two short stretches leaves equal (longest common subsequence)."""
    if len(x) == len(y):
        straight = int((x == y).sum())
        if straight >= 0.7 * len(x):
            return straight
    row = np.zeros(len(y) + 1, np.int64)
    for a in x:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (y == a))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _parted(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Pieces of two stretches between seeds: one where they are alike, else what goes on alike from both ends and the rest."""
    both = _common(x, y)
    if both >= LEAST_EQUAL * len(x):
        return [(len(x), len(y), both)]
    head = _extend(x, y)
    i, j, first = (sum(c) for c in zip((0, 0, 0), *head))
    tail = _extend(x[i:][::-1], y[j:][::-1])[::-1]
    k, m, last = (sum(c) for c in zip((0, 0, 0), *tail))
    return [*head, (len(x) - i - k, len(y) - j - m, max(0, min(len(x) - i - k, both - first - last))), *tail]


def align(places: np.ndarray, others: np.ndarray, own: np.ndarray, own_from: int, tile: np.ndarray, tile_from: int) -> tuple[int, int, np.ndarray]:
    """(start, other start, pieces on end) of one segment; a piece has words, words of the other, equal words."""
    p, q = places - own_from, others - tile_from
    before = _extend(own[: p[0]][::-1], tile[: q[0]][::-1])[::-1]
    pieces = list(before)
    for k in range(len(p) - 1):
        a, b = own[p[k] : p[k + 1]], tile[q[k] : q[k + 1]]
        pieces += [(len(a), len(b), len(a))] if len(a) == len(b) and (a == b).all() else _parted(a, b)
    pieces += [(K, K, K), *_extend(own[p[-1] + K :], tile[q[-1] + K :])]
    x = np.array(pieces, np.int32).reshape(-1, 3)
    # equal pieces in a row are one
    same = (x[:, 0] == x[:, 2]) & (x[:, 1] == x[:, 2])
    x = np.add.reduceat(x, np.flatnonzero(np.concatenate([[True], ~(same[1:] & same[:-1])])), axis=0).astype(np.int32)
    return int(places[0]) - sum(w for w, _, _ in before), int(others[0]) - sum(w for _, w, _ in before), x


def whole_chain(parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Rows (start, end, other start, other end, equal words) without overlap or hole, of the segments (as ``align`` gives them) of a chain."""
    out = []
    for s, o, pieces in sorted(parts, key=lambda part: part[:2]):
        for n, m, equal in pieces.tolist():
            e, oe = s + n, o + m
            begin, other = s, o
            if out and begin < out[-1][1]:  # extensions over the ends of segments overlap
                begin = min(out[-1][1], e)
                other, equal = min(o + begin - s, oe), min(equal, e - begin)
            elif out and begin > out[-1][1]:
                out.append((out[-1][1], begin, out[-1][3], max(other, out[-1][3]), 0))
            if begin < e:
                out.append((begin, e, other, oe, equal))
            s, o = e, oe
    return np.array(out, np.int64).reshape(-1, 5)


def stretches(rows: np.ndarray, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (start, end, other start, other end, equal words) of a chain's ``rows`` that are long and alike enough.

    They cover every row that lies in any such stretch from one alike row to another; few overlap.
    """
    length, equal = rows[:, 1] - rows[:, 0], rows[:, 4]
    gain = 1000 * equal - round(1000 * LEAST_EQUAL) * length
    total = np.concatenate([[0], np.cumsum(gain)])
    alike = np.flatnonzero(gain >= 0)
    # the farthest end after which the sum is no lower than before the beginning: suffix maxima fall
    after = np.maximum.accumulate(total[alike + 1][::-1])[::-1]
    far = np.searchsorted(-after, -total[alike], side="right") - 1
    known, out = np.concatenate([[0], np.cumsum(equal)]), []
    found = [(i, alike[f]) for i, f in zip(alike, far) if f >= 0 and alike[f] >= i and rows[alike[f], 1] - rows[i, 0] >= least_words]
    k, covered = 0, -1
    while k < len(found):
        if found[k][1] <= covered:
            k += 1
            continue
        limit, best = max(covered, found[k][0]), found[k]
        while k < len(found) and found[k][0] <= limit:
            best = max(best, found[k], key=lambda f: f[1])
            k += 1
        i, j = best
        covered = j
        out.append((int(rows[i, 0]), int(rows[j, 1]), int(rows[i, 2]), int(rows[j, 3]), int(known[j + 1] - known[i])))
    return out


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


SEGMENT = "doc_id long, anchor long, chain int, tile long, places binary, others binary, own binary, own_from int"


def segments(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Chains of each document cut by anchor tiles, each with the document's own words around it.

    ``matches``: (doc_id, m array<struct<anchor, place, other>>), one row a document; its
    size is bounded by the document's own seeds.
    """

    def run(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                rows = {name: [] for name in ("doc_id", "anchor", "chain", "tile", "places", "others", "own", "own_from")}
                lists = part.column("m")
                flat = lists.flatten()
                anchor, place, other = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                brief = _short(hashes)
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = brief[ends[i] : ends[i + 1]]
                    a, p, q = anchor[cut[i] : cut[i + 1]], place[cut[i] : cut[i + 1]], other[cut[i] : cut[i + 1]]
                    order = np.lexsort((q, p, a))
                    a, p, q = a[order], p[order], q[order]
                    bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
                    number = 0
                    for lo, hi in zip(bounds, [*bounds[1:], len(a)]):
                        for chain in chains(p[lo:hi], q[lo:hi]):
                            cp, cq = p[lo:hi][chain], q[lo:hi][chain]
                            tiles = cq // TILE
                            turn = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
                            for u, v in zip(turn, [*turn[1:], len(cp)]):
                                # the first match of the next tile, if near, closes the gap between segments
                                sp, sq = cp[u:v], cq[u:v]
                                if v < len(cp) and cq[v] + K <= (tiles[u] + 1) * TILE + MARGIN:
                                    sp, sq = np.append(sp, cp[v]), np.append(sq, cq[v])
                                start = max(0, int(sp[0]) - MARGIN)
                                for name, value in zip(rows, (doc, int(a[lo]), number, int(tiles[u]), sp.astype(np.int32).tobytes(), sq.astype(np.int32).tobytes(), own[start : int(sp[-1]) + K + MARGIN].tobytes(), start)):
                                    rows[name].append(value)
                            number += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(rows.items(), kinds)})

    few, _ = parted(docs.select("doc_id", "text"), sketch(matches, "doc_id"), "doc_id")  # so texts of others are not shuffled
    return few.join(matches, "doc_id").mapInArrow(tidy(run), SEGMENT)


def tiles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, tile, words) of the documents in ``wanted`` (anchor): tiles with margins."""

    def run(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                brief = _short(hashes)
                names, numbers, parts = [], [], []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = brief[ends[i] : ends[i + 1]]
                    for t in range(-(-len(own) // TILE)):
                        names.append(doc)
                        numbers.append(t)
                        parts.append(own[max(0, t * TILE - MARGIN) : (t + 1) * TILE + MARGIN + K].tobytes())
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(names, pa.int64()), "tile": pa.array(numbers, pa.int64()), "words": pa.array(parts, pa.binary())})

    few, _ = parted(docs.select("doc_id", "text"), sketch(wanted, "anchor"), "doc_id")
    mine = with_small(few, wanted.withColumnRenamed("anchor", "doc_id"), "doc_id", "inner")
    return mine.select("doc_id", "text").mapInArrow(tidy(run), "anchor long, tile long, words binary").dropDuplicates(["anchor", "tile"])


def repeated(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, chosen) of the doc_ids with several texts, whose ``chosen`` has the least hash."""
    texts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("chosen"), F.max(F.xxhash64("text")).alias("last"))
    return stored(texts.where("chosen <> last").select("doc_id", "chosen"))


def _chosen(docs: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows with a doc_id, without the other texts of a repeated one."""
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    return rows if several.isEmpty() else with_small(rows, several, "doc_id").where("chosen IS NULL OR chosen = xxhash64(text)").select("doc_id", "text")


def open_stretches(matches: DataFrame, passages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, begin, end), places of seeds, where a run of ``least_words`` words may be shared and seeds lie in no passage.

    In a run of equal words every window of k-mers inside has the same seed on both sides, so
    a seed follows the other within a window, and the outer ones lie within a window of the run's ends.  Where all seeds lie in passages,
    fewer than ``WINDOW`` words at either end of a run may stay uncovered; that is not searched again.
    """
    least = least_words - K + 1

    def run(batches):
        for batch in batches:
            docs, begins, ends = [], [], []
            for doc, m, spans in zip(batch.column("doc_id").to_pylist(), batch.column("m"), batch.column("spans").to_pylist()):
                anchor, place, more = (m.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("anchor", "place", "more"))
                p, at = np.unique(place, return_index=True)
                last = p + more[at]
                covered = np.zeros(int(last.max()) + least_words + 1, np.int32)
                for x in spans or ():
                    covered[min(x["start"], len(covered) - 1)] += 1
                    covered[min(x["end"], len(covered) - 1)] -= 1
                free = np.concatenate([[0], np.cumsum(np.cumsum(covered) == 0)])
                turn = np.flatnonzero(p[1:] - last[:-1] > WINDOW)
                for u, v in zip(np.concatenate([[0], turn + 1]), np.concatenate([turn, [len(p) - 1]])):
                    # such a run begins within a window before the first seed, and ends within one behind the last
                    if int(p[u]) - WINDOW + 1 <= int(last[v]) - (least - WINDOW) and free[int(last[v]) + K] > free[int(p[u])]:
                        docs.append(doc)
                        begins.append(int(p[u]))
                        ends.append(int(p[v]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "begin": pa.array(begins, pa.int64()), "end": pa.array(ends, pa.int64())})

    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return matches.join(spans, "doc_id", "left").mapInArrow(tidy(run), "doc_id long, begin long, end long")


def runs(docs: DataFrame, places: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(run, doc_id, place): hashes of the runs of ``least_words`` words around the ``places`` (doc_id, at array of places of seeds)."""

    def make(batches):
        fresh_worker()
        for batch in batches:
            for part, hashes, ends in words.blocks(batch):
                rolled = words.rolling(hashes, least_words)
                found, texts, starts = [], [], []
                for i, at in enumerate(part.column("at")):
                    n = ends[i + 1] - ends[i] - least_words + 1
                    if n <= 0:
                        continue
                    at = at.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    near = np.zeros(n + 1, np.int32)
                    np.add.at(near, np.clip(at - (least_words - K), 0, n), 1)
                    np.add.at(near, np.clip(at + 1, 0, n), -1)
                    x = np.flatnonzero(np.cumsum(near[:n]) > 0)
                    found.append(rolled[ends[i] + x])
                    texts.append(np.full(len(x), i))
                    starts.append(x)
                if found:
                    yield pa.RecordBatch.from_pydict({"run": pa.array(np.concatenate(found).view(np.int64)), "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(np.concatenate(texts))), "place": pa.array(np.concatenate(starts).astype(np.int32))})

    few, _ = parted(docs, sketch(places, "doc_id"), "doc_id")
    return few.join(places.hint("merge"), "doc_id").select("doc_id", "text", "at").mapInArrow(tidy(make), "run long, doc_id long, place int")


def chained(places: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``places`` (doc_id, at array<struct<place, more>>) as (doc_id, at array of places) that lie in chains long enough for a run."""
    span = least_words - K + 1 - 2 * WINDOW + 1

    def keep(batches):
        for batch in batches:
            docs, out = [], []
            for doc, at in zip(batch.column("doc_id").to_pylist(), batch.column("at")):
                place, more = (at.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "more"))
                p, first = np.unique(place, return_index=True)
                last = p + more[first]
                turn = np.flatnonzero(p[1:] - last[:-1] > WINDOW)
                begin, end = np.concatenate([[0], turn + 1]), np.concatenate([turn, [len(p) - 1]])
                good = last[end] - p[begin] >= span
                if good.any():
                    docs.append(doc)
                    out.append(p[np.repeat(good, end - begin + 1)].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "at": pa.array(out, pa.list_(pa.int32()))})

    return places.mapInArrow(tidy(keep), "doc_id long, at array<int>")


PASSAGE = "doc_id long, start long, end long, anchor long, anchor_start long, anchor_end long, equal_words long"


def rerun(docs: DataFrame, shared: DataFrame, matches: DataFrame, passages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of equal words of which ``passages`` leave a window uncovered, each matched to the least document with the whole run; the longest first, each with words that none before it covers.

    ``shared`` (seed, doc_id, place, more) has the seeds of several documents: all seeds inside a run that two documents hold are among them.
    """
    stretch = stored(open_stretches(matches, passages, least_words))
    inside = with_small(shared, stretch, "doc_id", "inner", NARROW_ROWS).where("place BETWEEN begin AND end")
    wanted = stored(inside.select("seed").distinct())
    held = with_small(shared, wanted, "seed", "inner", NARROW_ROWS)
    places = stored(chained(held.groupBy("doc_id").agg(F.collect_list(F.struct("place", "more")).alias("at")), least_words))
    found = stored(runs(docs, places, least_words))
    low = found.groupBy("run").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("run", F.col("first.doc_id").alias("anchor"), F.col("first.place").alias("other"))
    matched = found.join(low, "run").where("doc_id <> anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "other")).alias("m"))
    known = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def merge(batches):
        for batch in batches:
            out = []
            for doc, m, spans in zip(batch.column("doc_id").to_pylist(), batch.column("m"), batch.column("spans").to_pylist()):
                anchor, place, other = (m.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("anchor", "place", "other"))
                order = np.lexsort((other, place, anchor))
                a, p, q = anchor[order], place[order], other[order]
                # runs of one anchor that meet are one passage, whose words all lie in runs
                first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) > least_words)]))
                last = np.append(first[1:] - 1, len(p) - 1)
                taken = np.zeros(int(p.max()) + least_words + 1, np.int32)
                for x in spans or ():
                    taken[min(x["start"], len(taken) - 1)] += 1
                    taken[min(x["end"], len(taken) - 1)] -= 1
                known = np.cumsum(taken) > 0
                done = known.copy()
                for u, v in sorted(zip(first.tolist(), last.tolist()), key=lambda r: (p[r[0]] - p[r[1]], p[r[0]], a[r[0]])):
                    begin, end = int(p[u]), int(p[v]) + least_words
                    if (~known[begin:end]).sum() >= WINDOW and not done[begin:end].all():
                        done[begin:end] = True
                        out.append((doc, begin, end, int(a[u]), int(q[u : v + 1].min()), int(q[u : v + 1].max()) + least_words, end - begin))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=["doc_id", "start", "end", "anchor", "anchor_start", "anchor_end", "equal_words"])

    return matched.join(known, "doc_id", "left").mapInArrow(tidy(merge), PASSAGE)


def find(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages (doc_id, start, end, anchor, anchor_start, anchor_end, equal_words), in words.

    Each is a stretch of ``doc_id`` that is found, alike in at least ``LEAST_EQUAL`` of its
    words, in ``anchor``, a document of a lower id.  Null and empty texts, and rows without
    doc_id, have none; equal rows of one doc_id count as one document, and of a doc_id with several texts that of the least hash counts;
    texts of any length are searched whole; other columns are ignored.
    """
    texts = _chosen(docs, repeated(docs))
    every = stored(seeds(texts))
    # one shuffle of all seeds; most are of one document and of no further use
    holders = Window.partitionBy("seed").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = every.select("*", F.first("doc_id").over(holders).alias("anchor"), F.first("place").over(holders).alias("other"), F.last("doc_id").over(holders).alias("last"))
    shared = stored(low.where("anchor < last").drop("last"))
    matches = stored(shared.where("doc_id <> anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "other", "more")).alias("m")))
    cut = stored(segments(texts, matches))
    # a tile that many segments meet has copies, one for so many of them
    hot = stored(cut.groupBy("anchor", "tile").agg(F.ceil(F.count(F.lit(1)) / SEGMENTS_A_COPY).alias("copies")).where("copies > 1"))
    tiled = tiles(texts, stored(cut.select("anchor").distinct()))
    copied = with_small(tiled, hot, ["anchor", "tile"]).withColumn("copy", F.explode(F.expr("sequence(0L, coalesce(copies, 1L) - 1)"))).drop("copies")
    dealt = with_small(cut, hot, ["anchor", "tile"]).withColumn("copy", F.expr("pmod(xxhash64(doc_id, chain), coalesce(copies, 1L))")).drop("copies")

    def run(batches):
        fresh_worker()
        for batch in batches:
            starts, others, pieces = [], [], []
            for p, q, own, own_from, words_, t in zip(*(batch.column(c).to_pylist() for c in ("places", "others", "own", "own_from", "words", "tile"))):
                s, o, x = align(np.frombuffer(p, np.int32), np.frombuffer(q, np.int32), np.frombuffer(own, np.uint32), own_from, np.frombuffer(words_, np.uint32), max(0, t * TILE - MARGIN))
                starts.append(s)
                others.append(o)
                pieces.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("anchor"), batch.column("chain"), pa.array(starts, pa.int64()), pa.array(others, pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "anchor", "chain", "s", "os", "pieces"])

    def judge(batches):
        for batch in batches:
            at, out = [], []
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                good = stretches(whole_chain([(x["s"], x["os"], np.frombuffer(x["pieces"], np.int32).reshape(-1, 3)) for x in parts]), least_words)
                at += [k] * len(good)
                out += good
            values, rows = np.array(out, np.int64).reshape(-1, 5), batch.take(pa.array(at, pa.int64()))
            cols = {"doc_id": rows.column("doc_id"), "start": values[:, 0], "end": values[:, 1], "anchor": rows.column("anchor"), "anchor_start": values[:, 2], "anchor_end": values[:, 3], "equal_words": values[:, 4]}
            yield pa.RecordBatch.from_pydict({n: pa.array(v) if isinstance(v, np.ndarray) else v for n, v in cols.items()})

    aligned = dealt.join(copied, ["anchor", "tile", "copy"]).mapInArrow(tidy(run), "doc_id long, anchor long, chain int, s long, os long, pieces binary")
    # a chain may pass a gap that is not alike: it is cut where no long and alike stretch goes on
    whole = aligned.groupBy("doc_id", "anchor", "chain").agg(F.collect_list(F.struct("s", "os", "pieces")).alias("parts"))
    passages = stored(whole.mapInArrow(tidy(judge), PASSAGE))
    return passages.unionByName(rerun(texts, shared.drop("anchor", "other"), matches, passages, least_words))


def remove(docs: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``docs`` whose repeated passages are cut from all documents but the anchor.

    Rows stay, also those of which nothing is left; rows without passages, and the texts of a repeated doc_id that ``find`` leaves out, are unchanged;
    columns stay as they are.
    """
    passages = find(docs) if passages is None else passages
    cut = unused(docs, "_spans")
    spans = stored(passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(cut)))
    several = repeated(docs)

    def run(batches):
        fresh_worker()
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            out = []
            for text, spans_ in zip(texts.to_pylist(), batch.column(cut).to_pylist()):
                if not spans_ or not text:
                    out.append(text)
                    continue
                parts = words.split_as_written(text)
                at, kept = 0, []
                for s in sorted(spans_, key=lambda s: (s["start"], s["end"])):
                    if s["end"] <= at or s["start"] >= len(parts):
                        continue
                    begin = max(at, s["start"])
                    kept.append((at, begin))
                    at = min(s["end"], len(parts))
                kept.append((at, len(parts)))
                out.append("".join(text[parts[a][0] : parts[b - 1][1] if b < len(parts) else len(text)] + (" " if b < len(parts) else "") for a, b in kept if a < b))
            names = [n for n in batch.schema.names if n != cut]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    some, others = parted(docs, sketch(spans, "doc_id"), "doc_id")  # texts without passages are neither shuffled nor split
    joined = some.join(spans, "doc_id", "left")
    if not several.isEmpty():
        mark = unused(joined, "_chosen")
        joined = with_small(joined, several.withColumnRenamed("chosen", mark), "doc_id").withColumn(cut, F.when(F.col(mark).isNull() | (F.col(mark) == F.xxhash64("text")), F.col(cut)))
    return joined.select(*docs.columns, cut).mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)).union(others)
