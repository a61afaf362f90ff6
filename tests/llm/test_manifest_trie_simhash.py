"""SimHash components, Merkle proofs and the prefix trie against brute force."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from quarry.llm import merkle, prefix_trie, queries, simhash


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# SimHash ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_components(fps, ids, radius=3):
    """Least id that each row reaches; rows without id name nothing."""
    label = list(range(len(fps)))

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius).tolist():
            a, b = top(i), top(i + 1 + j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_op11_equals_brute_force(spark, sf, docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, sf).collect())
    fps, ids = [brute_fingerprint(d["text"]) for d in docs], [d["doc_id"] for d in docs]
    assert got == sorted(zip(ids, (f"{f:016x}" for f in fps), brute_components(fps, ids)))
    assert len({c for _, _, c in got}) < len(got)


def test_simhash_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    fps, ids = [brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]
    want = list(zip(ids, fps, brute_components(fps, ids)))
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.find(odd).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.find(empty).count() == 0


def test_long_text_counts_whole(monkeypatch):
    text = " ".join(f"w{random.Random(1).random()}{i}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STRETCH", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_near_links_of_dense_groups(spark, monkeypatch):
    """Balls of near fingerprints, a chain at the radius, and lone ones; blocks of four and stretches of few pairs."""
    rng = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = []
    for _ in range(5):
        centre = rng.getrandbits(64)
        fps += [centre] + [flip(centre, rng.randint(1, 2)) for _ in range(60)]
    chain = rng.getrandbits(64)
    for _ in range(40):
        fps.append(chain)
        chain = flip(chain, 3)
    fps += [rng.getrandbits(64) for _ in range(100)]
    fps = list(dict.fromkeys(fps))
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "AT_ONCE", 16)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.linked(nodes).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    label = {f: f for f in fps}
    for _ in fps:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = brute_components(fps, fps)
    groups = lambda of: {frozenset(f for f in fps if of[f] == c) for c in set(of.values())}
    assert groups(label) == groups(dict(zip(fps, want)))


# Merkle manifest -------------------------------------------------------------------------------------------------------


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    """(level's other node or None, whether it is left) up to the root."""
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append((level[other] if other < len(level) else None, other < i))
        i >>= 1
    return out


def brute_manifest(rows, tampered):
    """{(doc_id, leaf): set of (subroot, root, proof, folded_root)} of rows like dicts."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*(code(r[f]) for f in merkle.FIELDS))
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([n[2] for n in sorted(langs[x], key=lambda n: n[:3])]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = defaultdict(list)
    for at, x in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(langs[x], key=lambda n: n[:3])):
            way = siblings(trees[x], i) + siblings(top, at)
            now = leaf(tampered(r))
            for other, left in way:
                now = h(now) if other is None else h(other, now) if left else h(now, other)
            out[r["doc_id"], own].append((trees[x][-1][0], top[-1][0], h(*(o for o, _ in way if o)), now))
    return {k: sorted(v) for k, v in out.items()}


def tampered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
    return r | {"n_chars": r["n_chars"] + 1} if hit and r["n_chars"] is not None else r


def proofs(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id, r.leaf].append((r.subroot, r.root, r.proof_sha256, r.folded_root))
        assert r.verified == (r.folded_root == r.root)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block,fan", [(1 << 12, 64), (3, 2)])
def test_op12_equals_brute_force(spark, sf, docs, monkeypatch, block, fan):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = queries.op12_merkle_manifest(spark, sf).collect()
    assert proofs(rows) == brute_manifest(docs, tampered)
    assert 0 < sum(not r.verified for r in rows) < len(rows) / 3


@pytest.mark.parametrize("block", [1, 2, 5])
def test_manifest_of_odd_rows(odd, empty, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", 2)
    rows = merkle.manifest(odd.unionByName(odd)).collect()
    want = brute_manifest([r.asDict() for r in odd.unionByName(odd).collect()], lambda r: r)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.leaf].append((r.subroot, r.root, h(*(s[1:] for s in r.proof)), r.folded_root))
        assert r.verified and merkle.fold(r.leaf, r.proof) == r.root
    assert {k: sorted(v) for k, v in got.items()} == want
    assert merkle.manifest(empty).count() == 0
    lone = merkle.manifest(odd.where("doc_id = 3")).collect()
    assert len(lone) == 1 and lone[0].leaf == lone[0].subroot == lone[0].root and not lone[0].proof


def test_merging_forests_is_associative():
    """However blocks of leaves are cut and grouped, the same nodes are left."""
    rng = random.Random(2)
    for _ in range(40):
        sizes = {t: rng.randint(1, 9) for t in range(rng.randint(1, 5))}
        leaves = [(t, 0, i) for t in sizes for i in range(sizes[t])]
        forests = [{k: h(str(k))} for k in leaves]
        sizes[merkle.TOP] = len(sizes)
        whole = merkle.merged(forests, sizes)[0]
        while len(forests) > 1:
            i, j = sorted(rng.sample(range(len(forests)), 2))
            b, a = forests.pop(j), forests.pop(i)
            forests.append(merkle.merged([a, b], sizes)[0])
        assert forests[0] == whole and len(whole) == 1 and next(iter(whole))[0] == merkle.TOP


# prefix trie -----------------------------------------------------------------------------------------------------------


def brute_turns(rows):
    convs = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            convs[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    # turns of one number in the order of their digests
    key = lambda t: (t[0], t[1], h(f"{len(t[2].encode())}:{t[2]}{t[3]}"))
    return {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in convs.items()}


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        n = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:n] + turns[n:]
    return out


def brute_trie(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = set(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ids = ",".join(map(str, sorted(ends[p])))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], h(ids)))
    return out


def test_op13_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = queries.op13_prefix_trie(spark, sf).collect()
    want = brute_trie(brute_rebuilt(brute_turns([r.asDict() for r in rows])))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def made(spark, convs, extra=()):
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    return spark.createDataFrame(rows + list(extra), "conv_id long, turn long, role string, text string")


def test_trie_of_deep_hot_and_copied_conversations(spark, monkeypatch):
    """Long common beginnings over many stretches, copies of one conversation, chains on chains."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    monkeypatch.setattr("quarry.llm.common.RANGE_ROWS", 50)
    rng = random.Random(4)
    spine = [("user", f"turn {i} é") for i in range(40)]
    convs = {}
    for c in rng.sample(range(1, 2000), 120):
        kind = rng.random()
        cut = rng.randrange(41)
        tail = [("user", rng.choice("xyz")) for _ in range(rng.randrange(5))]
        convs[c] = spine if kind < 0.3 else spine[:cut] + tail if kind < 0.8 else tail or [("system", "")]
    odd = [(None, 1, "user", "without a conversation"), (5000, None, None, None), (5000, None, "user", "b"), (5000, 3, "user", "a"), (5000, 3, "user", "a")]
    table = made(spark, convs, odd)
    want = brute_trie(brute_turns([r.asDict() for r in table.collect()]))
    got = prefix_trie.trie(table).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rebuilding_short_and_absent_bases(spark):
    rng = random.Random(9)
    convs = {c: [(rng.choice(["user", None]), rng.choice(["a", "bb", None]))] * rng.randrange(1, 11) for c in rng.sample(range(400), 150)}
    table = made(spark, convs)
    want = brute_trie(brute_rebuilt(brute_turns([r.asDict() for r in table.collect()])))
    assert {tuple(r) for r in prefix_trie.nodes(*prefix_trie.rebuilt(*prefix_trie.numbered(table))).collect()} == want
    none = table.where("false")
    assert prefix_trie.trie(none).count() == 0 and prefix_trie.nodes(*prefix_trie.rebuilt(*prefix_trie.numbered(none))).count() == 0
