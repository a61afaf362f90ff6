import math
import random
from collections import Counter, defaultdict

import numpy as np

from quarry.llm import common, near_duplicates, queries, substrings


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shingle_weights(text):
    w = (text or "").lower().split()
    runs = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {s: 1 + math.log(n) for s, n in runs.items()}


def brute_probability_jaccard(x, y):
    """By its definition: every shared shingle against all shingles."""
    names = sorted(x.keys() | y.keys())
    a, b = (np.array([v.get(k, 0.0) for k in names]) for v in (x, y))
    return sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero((a > 0) & (b > 0)))


def brute_likeness(x, y):
    """Plain Jaccard similarity of two weighted sets where it is 0.8 or more, else probability Jaccard similarity."""
    n = len(x.keys() & y.keys())
    union = len(x) + len(y) - n
    if n >= 0.8 * union:
        return n / union
    return brute_probability_jaccard(x, y) if n and (max(x.values()) > 1 or max(y.values()) > 1) else n / max(union, 1)


def brute_classes(docs, similarity=0.8):
    """Least doc_id of each connected component of all pairs that are similar enough, by either measure."""
    sets = {d: shingle_weights(t) for d, t in docs}
    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for d, s in sets.items():
        for e in sorted({e for x in s for e in at[x] if e < d}):
            a, b = root(d), root(e)
            if a != b and brute_likeness(s, sets[e]) >= similarity:
                up[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def check_hold(rows, texts):
    """Every row hangs on its class by a pair that is as alike as it says."""
    for r in rows:
        if r.linked_to is None:
            assert r.n_links == 0 and r.likeness is None
        elif r.copy_of != r.doc_id:
            assert (r.linked_to, r.likeness) == (r.copy_of, 1.0) and texts[r.doc_id].lower().split() == texts[r.copy_of].lower().split()
        else:
            assert r.n_links > 0 and r.likeness >= 0.8 and r.linked_to != r.doc_id
            assert abs(r.likeness - brute_likeness(shingle_weights(texts[r.doc_id]), shingle_weights(texts[r.linked_to]))) < 1e-9


def test_op10_equals_brute_force(spark, sf, docs):
    rows = queries.op10_near_duplicates(spark, sf).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes([(d["doc_id"], d["text"]) for d in docs])
    check_hold(rows, {d["doc_id"]: d["text"] or "" for d in docs})


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_drifting_and_hot_groups(spark):
    """A chain of edits, a group of hundreds of edits of one text, copies, and lone texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(12):
        rows.append((i, " ".join(base)))
        base = list(base)
        base[rng.randrange(200)] = f"new{i}"
    hot = [rng.choice(words) for _ in range(120)]
    for i in range(300):
        edit = list(hot)
        edit[rng.randrange(120)] = f"e{i}"
        rows.append((100 + i, " ".join(edit)))
    rows += [(500 + i, "the same words in every copy of this text") for i in range(200)]
    rows += [(800 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in near_duplicates.find(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert all(r.linked_to == 500 and r.likeness == 1 for r in near_duplicates.find(frame(spark, rows)).where("doc_id > 500 AND doc_id < 700").collect())
    kept = near_duplicates.keep_one(frame(spark, rows)).count()
    assert kept == len(set(got.values()))


def test_links_between_classes_that_share_a_bucket(spark):
    """A family around the threshold: most pairs share buckets, few are similar enough, and centres meet few of these."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(240)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.choice((3, 5, 7, 9))):
            text[rng.randrange(240)] = f"edit{rng.randrange(60)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.class_id for r in near_duplicates.find(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 20 and len(set(got.values())) < 400


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_duplicates.find(odd).collect()
    by = {(r.doc_id, r.k1): r.class_id for r in rows}
    assert {c for (d, _), c in by.items() if d in (1, 7)} == {1}  # both texts of id 7 have the words of 1
    assert by[next(k for k in by if k[0] is None)] is None
    assert all(c == d for (d, _), c in by.items() if d in (2, 3, 4, 5, 6))
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert near_duplicates.find(empty).count() == 0 and near_duplicates.keep_one(empty).count() == 0


def covered(passages):
    out = defaultdict(set)
    for r in passages:
        out[r.doc_id].update(range(r.start, r.end))
    return out


def test_op5_covers_all_exact_repeats(spark, sf, docs):
    """Every word of a run of 50 words that a lower document holds lies in a found passage."""
    passages = queries.op5_substrings(spark, sf).collect()
    found, seen, missed, total = covered(passages), {}, 0, 0
    texts = {d["doc_id"]: (d["text"] or "").lower().split() for d in docs}
    for d in sorted(texts):
        w, own = texts[d], set()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if seen.setdefault(run, d) != d:
                own.update(range(i, i + 50))
        total += len(own)
        missed += len(own - found[d])
    assert total > 0 and missed == 0
    for p in passages:
        assert p.anchor < p.doc_id and p.end - p.start >= 50
        a, b = texts[p.doc_id][p.start : p.end], set(texts[p.anchor][p.anchor_start : p.anchor_end])
        assert len(a) == p.end - p.start and sum(x in b for x in a) >= 0.8 * len(a)


def test_fuzzy_passages_and_removal(spark):
    rng = random.Random(7)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage = noise(120)
    fuzzy = list(passage)
    for at in (15, 40, 41, 70, 95):
        fuzzy[at] = "changed"
    del fuzzy[60]
    fuzzy.insert(30, "added")
    rows = [(1, " ".join(noise(40) + passage + noise(30))), (2, " ".join(noise(25) + fuzzy + noise(60))), (3, " ".join(noise(300))), (4, " ".join(noise(10) + passage[:30] + noise(10)))]
    rows += [(10 + i, " ".join(noise(20) + passage + noise(20))) for i in range(60)]
    df = frame(spark, rows)
    spans = covered(substrings.find(df).collect())
    assert set(spans) == {2, *range(10, 70)}
    assert len(spans[2] & set(range(25, 25 + 120))) >= 110 and len(spans[2]) <= 130
    assert all(spans[10 + i] == set(range(20, 140)) for i in range(60))
    left = {r.doc_id: r.text.split() for r in substrings.remove(df).collect()}
    assert len(left) == len(rows) and left[1] == rows[0][1].split() and left[3] == rows[2][1].split() and left[4] == rows[3][1].split()
    assert left[10] == rows[4][1].split()[:20] + rows[4][1].split()[140:]


def test_chain_equals_quadratic_search():
    """The Fenwick tree finds as good a best chain as trying every predecessor."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 40
        p, q = rng.integers(0, 60, n) * substrings.K, rng.integers(0, 60, n) * substrings.K
        order = np.lexsort((q, p))
        p, q = p[order], q[order]
        gain = lambda i, j: -substrings.GAP_COST * (p[j] - p[i] + q[j] - q[i])
        parts = substrings.chains(p, q)
        assert sorted(np.concatenate(parts).tolist()) == list(range(n))
        for c in parts:
            assert (np.diff(p[c]) > 0).all() and (np.diff(q[c]) > 0).all()
        best = [float(substrings.K)] * n
        value = lambda c: substrings.K + sum(gain(i, j) + min(substrings.K, p[j] - p[i], q[j] - q[i]) for i, j in zip(c, c[1:]))
        for j in range(n):
            links = [(best[i] + gain(i, j), i) for i in range(j) if p[i] < p[j] and q[i] < q[j]]
            if links and max(links)[0] > 0:
                g, i = max(links)
                best[j] = g + min(substrings.K, p[j] - p[i], q[j] - q[i])
        assert abs(max(value(c) for c in parts) - max(best)) < 1e-6


def test_substrings_of_odd_rows(odd, empty):
    assert substrings.find(odd).count() == 0
    left = substrings.remove(odd)
    assert left.columns == odd.columns and sorted(str(r.text) for r in left.collect()) == sorted(str(r.text) for r in odd.collect())
    assert substrings.find(empty).count() == 0 and substrings.remove(empty).count() == 0


def repeats(rows, n=50):
    """Places of the words in runs of ``n`` that a document of a lower id holds, by brute force."""
    seen, out = {}, defaultdict(set)
    for d, text in sorted(rows):
        w = text.split()
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), d) != d:
                out[d].update(range(i, i + n))
    return out


def test_passages_with_a_gap_between(spark):
    """Two passages of one anchor, in order, with unrelated words between: each is found, and the gap is not."""
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i, (a, gap, b) in enumerate([(60, 100, 60), (60, 200, 60), (100, 300, 100), (40, 19, 40), (60, 30, 200), (51, 70, 400), (300, 90, 55)]):
        x, y = noise(a), noise(b)
        rows += [(2 * i, " ".join(noise(30) + x + noise(gap) + y + noise(20))), (2 * i + 1, " ".join(noise(10) + x + noise(gap) + y + noise(40)))]
    passages = substrings.find(frame(spark, rows)).collect()
    got, want = covered(passages), repeats(rows)
    assert all(got[d] >= want[d] for d in want) and got[7] == set(range(10, 10 + 99))
    assert all(len(got[d]) <= len(want[d]) + 4 for d in (1, 3, 5))
    assert all(p.equal_words >= 0.8 * (p.end - p.start) >= 40 for p in passages)


def test_stretches_equal_all_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(1, 12)
        length = rng.integers(1, 40, n)
        equal = np.where(rng.random(n) < 0.6, length, (length * rng.random(n)).astype(int))
        ends = np.cumsum(length)
        rows = np.stack([ends - length, ends, ends - length, ends, equal], 1)
        want = set()
        for i in range(n):
            for j in range(i, n):
                size = ends[j] - ends[i] + length[i]
                if size >= 50 and 5 * equal[i : j + 1].sum() >= 4 * size and min(5 * equal[k] - 4 * length[k] for k in (i, j)) >= 0:
                    want.update(range(ends[i] - length[i], ends[j]))
        got = set()
        for s, e, _, _, same in substrings.stretches(rows, 50):
            assert e - s >= 50 and 5 * same >= 4 * (e - s)
            got.update(range(s, e))
        assert got == want


def test_passages_that_a_document_repeats(spark):
    """Every occurrence of a passage in a document is found and cut, also after lines that hold parts of it."""
    rng = random.Random(13)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    x, line = noise(60), noise(15)
    rows = [(1, noise(30) + x + noise(20)), (2, x + noise(90) + x + noise(70) + x), (3, x + x + noise(10) + x[20:] + x), (4, noise(5) + x[:12] + noise(30) + x[30:45] + noise(30) + x + noise(9))]
    rows += [(5, line * 8 + noise(40)), (6, noise(20) + line * 30 + noise(30) + line * 5), (7, ["word"] * 3000), (8, noise(12) + ["word"] * 2000 + noise(12))]
    rows = [(d, " ".join(w)) for d, w in rows]
    df = frame(spark, rows)
    got, want = covered(substrings.find(df).collect()), repeats(rows)
    assert all(got[d] >= want[d] for d in want) and set(got) == set(want) == {2, 3, 4, 6, 8}
    left = {r.doc_id: r.text.split() for r in substrings.remove(df).collect()}
    assert left[2] == rows[1][1].split()[60:150] + rows[1][1].split()[210:280]


def test_a_pair_is_looked_at_in_its_least_shared_bucket():
    """Equal bytes of slots decide nothing: buckets are told by whole hashes, so a collision of one byte loses no link."""
    sig = np.arange(near_duplicates.SLOTS, dtype=np.uint8)
    hashes = np.arange(near_duplicates.BANDS, dtype=np.uint64)
    other = hashes + np.uint64(1000)
    other[3], other[7] = hashes[3], hashes[7]
    s = np.arange(100, dtype=np.uint32).tobytes()
    member = lambda label, h: {"side": 0, "node": label, "label": label, "sig": sig.tobytes(), "bands": h.tobytes(), "s": s, "c": b""}
    pair = [member(1, hashes), member(2, other)]
    assert near_duplicates.links(pair, 3, 0.8) == [(1, 2, 1.0)]
    assert near_duplicates.links(pair, 7, 0.8) == []


def test_probability_jaccard_and_its_estimate():
    """The sum by ranks equals the definition, and slots that are equal estimate it, whatever the scale of the weights."""
    rng = np.random.default_rng(3)
    for n in (1, 7, 200):
        counts = rng.integers(1, 40, (2, n))
        counts[0, : n // 4] = counts[1, n // 4 : n // 3] = 0
        x, y = ({i: 1 + math.log(c) for i, c in enumerate(row) if c} for row in counts)
        both = sorted(x.keys() & y.keys())
        got = near_duplicates.probability_jaccard(np.array([x[i] for i in both]), np.array([y[i] for i in both]), sum(v for i, v in x.items() if i not in y), sum(v for i, v in y.items() if i not in x))
        want = brute_probability_jaccard(x, y)
        assert abs(got - want) < 1e-9
        names = near_duplicates.words.mix(np.arange(n, dtype=np.uint64) + np.uint64(99))
        sig = [near_duplicates.signatures(names[list(v)], np.zeros(len(v), np.int64), scale * np.array(list(v.values())), 1, 4000)[0] for v, scale in ((x, 1), (y, 3))]
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_texts_that_weights_alone_link(spark):
    """Texts that share lines said many times and differ in words said once: over the threshold by weights, under it without."""
    rng = random.Random(29)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows, plain = [], 0
    for i in range(60):
        line, own = noise(40), (3, 9, 14, 30)[i % 4]
        rows += [(2 * i + k, " ".join(line * (20, 20 + 10 * (i % 3))[k] + noise(own))) for k in (0, 1)]
        x, y = (shingle_set(t) for _, t in rows[-2:])
        plain += len(x & y) >= 0.8 * len(x | y)
    found = near_duplicates.find(frame(spark, rows)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in found} == want
    assert 120 - len(set(want.values())) >= plain + 10 and len(set(want.values())) > 60
    check_hold(found, dict(rows))


def test_near_copies_with_unequal_repeats(spark):
    """Pairs over the threshold whose counts differ widely, and pairs under it, by brute force."""
    rng = random.Random(17)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(120):
        own, line = noise(45 + i % 20), noise(15)
        rows += [(2 * i, " ".join(own + line)), (2 * i + 1, " ".join(own + line * (10, 30, 100, 300)[i % 4] + noise(25 * (i % 5 == 4))))]
    found = near_duplicates.find(frame(spark, rows)).collect()
    got, want = {r.doc_id: r.class_id for r in found}, brute_classes(rows)
    check_hold(found, dict(rows))
    assert got == want and 120 < len(set(want.values())) < 160


def test_passages_whose_parts_stand_in_lower_documents(spark):
    """Two documents share 60 to 120 words; documents of lower ids hold their parts, each below 50 words, in any order."""
    rng = random.Random(23)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows, d = [], 0
    for size, part in ((60, 15), (60, 30), (120, 24), (120, 40), (50, 25), (51, 49), (200, 33)):
        x = noise(size)
        parts = [x[i : i + part] for i in range(0, size, part)]
        rng.shuffle(parts)
        rows.append((d, [w for p in parts for w in noise(7) + p]))
        rows += [(d + 1 + i, noise(20) + p + noise(20)) for i, p in enumerate(parts)]
        d += len(parts) + 1
        rows += [(d, noise(30) + x + noise(25)), (d + 1, noise(12) + x + noise(40)), (d + 2, x + noise(10) + x)]
        d += 3
    rows = [(d, " ".join(w)) for d, w in rows]
    passages, texts = substrings.find(frame(spark, rows)).collect(), {d: t.split() for d, t in rows}
    got, want = covered(passages), repeats(rows)
    assert all(got[d] >= want[d] for d in want) and len(set(got) - set(want)) <= 3
    for p in passages:  # beyond runs, parts that an anchor holds in the same order, alike enough
        held = set(texts[p.anchor][p.anchor_start : p.anchor_end])
        assert sum(x in held for x in texts[p.doc_id][p.start : p.end]) >= 0.8 * (p.end - p.start) >= 40


def test_hot_tiles_and_repeated_ids(spark, monkeypatch):
    """Many documents against one tile, which has copies; of a doc_id with two texts one counts, the same in every run."""
    monkeypatch.setattr(substrings, "SEGMENTS_A_COPY", 7)
    rng = random.Random(29)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    x = noise(80)
    rows = [(i, " ".join(noise(9) + x + noise(11))) for i in range(60)] + [(7, " ".join(noise(200)))]
    chosen = {}
    got = covered(substrings.find(frame(spark, rows)).collect())
    assert all(got[i] == set(range(9, 89)) for i in range(1, 60) if i != 7) and got[7] in (set(), set(range(9, 89)))
    left = [sorted((r.doc_id, r.text) for r in substrings.remove(frame(spark, order)).collect()) for order in (rows, rows[::-1])]
    assert left[0] == left[1] and len(left[0]) == 61
    chosen = [t for d, t in left[0] if d == 7]
    assert rows[-1][1] in chosen


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_passages_are_not_shuffled(spark, monkeypatch):
    """Of texts of which few share a passage, no more than those and the seeds, once, go through shuffles, whatever the size of the tables."""
    monkeypatch.setattr(substrings, "NARROW_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substrings, "with_small", lambda df, table, key, how="left", most=0, join=common.with_small: join(df, table, key, how, 0))
    rng = random.Random(31)
    noise = lambda n: [f"{rng.randrange(16**12):012x}" for _ in range(n)]
    x = noise(60)
    rows = [(i, " ".join(noise(150) + x * (i % 50 == 7) + noise(150))) for i in range(1000)] + [(None, " ".join(x))]
    df, before = common.stored(frame(spark, rows)), shuffled(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = {r.doc_id: r.text for r in substrings.remove(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = dict(rows)
    for i, text in texts.items():
        assert left[i] == (" ".join(text.split()[:150] + text.split()[210:]) if i and i % 50 == 7 and i > 7 else text)
    assert shuffled(spark) - before < 0.5 * sum(len(t) for t in texts.values())


def test_sketch_of_keys_loses_no_partner(spark, monkeypatch):
    """Every key of the table is told as one that may be there, null and narrow keys too; few others are, until the bounded sketch is full."""
    df = spark.range(-3000, 3000).selectExpr("CAST(nullif(id, 7) AS int) AS doc_id", "id AS _word", "'x' AS _bits")
    keys = spark.range(-3000, 3000, 10).withColumnRenamed("id", "k")
    for rows, most in ((1 << 18, 20), (64, 1500), (1, 5400)):
        monkeypatch.setattr(common, "SKETCH_WORDS", rows)
        held = common.sketch(keys, "k")
        some, others = (p.collect() for p in common.parted(df, held, "doc_id"))
        assert held.count() <= rows and some and set(some[0].asDict()) == {"doc_id", "_word", "_bits"}
        assert sorted(r._word for r in some + others) == list(range(-3000, 3000))
        assert {r.doc_id for r in some} >= {r.k for r in keys.collect()} and len(some) - 600 <= most
