import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quarry.llm import flatfiles, language, queries, training_order


def test_op9_held_out_accuracy(spark, sf):
    """Trained on the smallest table, tested on documents of a larger one."""
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    other = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200")
    rows = language.identify(other, model).select("lang", "language", "kept").collect()
    kept = [r for r in rows if r.kept]
    assert len(kept) >= 0.98 * len(rows)
    assert sum(r.lang == r.language for r in kept) >= 0.97 * len(kept)


def test_op9(spark, sf, docs):
    rows = queries.op9_language_id(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.kept for r in rows) >= 0.97 * len(rows)


def test_fusion(spark, sf):
    """Markup and host decide where the text alone does not; junk is rejected."""
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    german = next(d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist() if d["lang"] == "de")
    rows = [(i, german, "https://seite.example.de/a") for i in range(30)]
    rows += [(100, "a b c d", "https://seite.example.de/b"), (101, '<html lang="fr"> a b', "x"), (102, "12345 !!! ###", "y"), (103, None, None), (104, "漢字 仮名 漢字", "z")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, source string"), model).collect()}
    assert got[0].language == "de" and got[0].kept
    assert got[100].language == "de" and got[101].language == "fr"
    assert not got[102].kept and not got[103].kept and not got[104].kept


def test_language_of_odd_rows(odd, empty):
    out = language.identify(odd)
    assert out.columns == [*odd.columns, "language", "confidence", "kept"] and out.count() == odd.count()
    assert language.identify(empty).count() == 0


def test_op3_equals_library(spark, sf, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, sf).collect()}
    assert got == {d["doc_id"]: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}


def test_scan_stitches_blocks(spark, tmp_path):
    """Real flat files, blocks of all sizes, against a search of the whole file."""
    rng = np.random.default_rng(2)
    want = []
    for f in range(3):
        ids = rng.integers(0, 50, 997).astype("<u2")
        ids[400:700] = 1  # a document longer than several blocks
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 7)
        want += np.diff(np.concatenate([[-1], ends])).tolist()
    for block, span in ((13, 3), (64, 2), (2000, 5)):
        found = flatfiles.summaries(flatfiles.read_files(spark, f"file://{tmp_path}", block_tokens=block), 7)
        rows = flatfiles.lengths(found, span).collect()
        assert sorted(r.n_tokens + 1 for r in rows) == sorted(want)
        files = defaultdict(list)
        for r in rows:
            files[r.file].append(r)
        for x in files.values():
            x.sort(key=lambda r: r.ordinal)
            assert [r.ordinal for r in x] == list(range(len(x)))
            assert all(a.start + a.n_tokens + 1 == b.start for a, b in zip(x, x[1:])) and x[0].start == 0


def test_broken_last_id_and_empty_file(spark, tmp_path):
    ids = np.array([5, 6, 7, 8, 7, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes() + b"x")
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(b"y")
    for block in (1, 2, 100):
        rows = flatfiles.lengths(flatfiles.summaries(flatfiles.read_files(spark, f"file://{tmp_path}", block_tokens=block), 7), 2).collect()
        assert sorted((r.start, r.n_tokens) for r in rows) == [(0, 2), (3, 1)]
    cut = spark.createDataFrame([(1, 0, bytearray(ids.tobytes() + b"z"))], "file long, block long, ids binary")
    assert flatfiles.summaries(cut, 7).first().tokens == 6


def test_posterior_by_hand(spark):
    """Text, markup and host priors of the fusion against the same sums in numpy."""
    import re

    rng = np.random.default_rng(3)
    languages, table = ["aa", "bb", "cc"], np.log(rng.dirichlet(np.ones(3), language.BUCKETS)).astype(np.float32)
    words = ["haus", "maison", "casa", "house", "talo"]
    rows = [(i, " ".join(rng.choice(words, 3 + i % 9)) + ('<html class="' + "x" * 300 + f'" lang="{languages[i % 3]}">' if i % 4 == 0 else ""), f"https://h{i % 5}.{'de' if i % 2 else 'fr'}/x", 1.5) for i in range(60)]
    import pyarrow as pa

    fits, means, ns = [], [], []
    for _, text, _, _ in rows:
        bucket, _ = language.trigrams(pa.array([text]))
        sums = np.array([table[bucket, k].sum(dtype=np.float64) for k in range(3)])
        fits.append(sums / len(bucket) * language.TEMPER * min(len(bucket), language.MOST_TRIGRAMS))
        ns.append(len(bucket))
        declared = re.search(r'lang="(..)"', text)
        if declared:
            wrong = (1 - language.DECLARED_RIGHT) / 2
            fits[-1] = fits[-1] + np.log([language.DECLARED_RIGHT if x == declared[1] else wrong + 1e-6 for x in languages])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    hosts, suffixes = defaultdict(lambda: np.zeros(3)), defaultdict(lambda: np.zeros(3))
    names = [(r[2].split("/")[2], r[2].split("/")[2].split(".")[1]) for r in rows]
    for (host, suffix), fit, n in zip(names, fits, ns):
        if n >= language.LEAST_TRIGRAMS:
            hosts[host] += soft(fit)
            suffixes[suffix] += soft(fit)
    world = sum(suffixes.values()) + 1
    world = world / world.sum()
    s = language.SMOOTHING
    wide = {k: (v + s * world) / (v.sum() + s) for k, v in suffixes.items()}
    prior = {h: (hosts[h] + s * wide[x]) / (hosts[h].sum() + s) for h, x in names}
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, source string, _fit double"), (languages, table)).collect()}
    for (i, _, _, _), (host, _), fit in zip(rows, names, fits):
        want = soft(fit + np.log(prior[host]))
        assert got[i].language == languages[int(want.argmax())] and abs(got[i].confidence - want.max()) < 1e-3 and got[i]["_fit"] == 1.5


def test_counts_of_odd_rows(odd, empty):
    from .conftest import TEXTS

    rows = flatfiles.count_tokens(odd, block_tokens=100, span=2).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in TEXTS)
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 0
    assert flatfiles.count_tokens(empty).count() == 0


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 20):
            got = training_order.slots(np.arange(total), total, key)
            assert sorted(got.tolist()) == list(range(total))
    assert training_order.slots(np.arange(1000), 1000, 1).tolist() != training_order.slots(np.arange(1000), 1000, 2).tolist()


def read_back(manifest, folder, length, shard_slots):
    """Ids of the documents put together from the shards by the manifest."""
    import os

    root = folder.removeprefix("file://")
    parts, shards = defaultdict(list), {}
    for r in manifest:
        if r.shard not in shards:
            shards[r.shard] = np.fromfile(r.path.removeprefix("file://"), "<u2")
        assert r.offset == r.slot % shard_slots * length * 2 and r.shard == r.slot // shard_slots
        at = r.offset // 2 + r.place
        parts[r.doc_id].append((r.sequence, r.place, r.start, shards[r.shard][at : at + r.n_tokens].tolist()))
    assert sorted(os.listdir(root)) == sorted(x for s in shards for x in (f".shard-{s:08d}.bin.crc", f"shard-{s:08d}.bin") if os.path.exists(os.path.join(root, x)))
    slots = {r.slot for r in manifest}
    assert slots == set(range(len(slots)))
    assert sum(map(len, shards.values())) == len(slots) * length
    return {k: [i for p in sorted(v) for i in p[3]] for k, v in parts.items()}


def library_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return [t.encode(x or "", add_special_tokens=False).ids + [training_order.END_ID] for x in texts]


def test_op6_round_trip(spark, sf, docs):
    """Shards hold the library's ids, and a reader goes on from any slot."""
    source = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    manifest, folder = training_order.write_shards(source, length=256, shard_slots=16)
    rows = manifest.collect()
    assert read_back(rows, folder, 256, 16) == dict(zip((d["doc_id"] for d in docs), library_ids(d["text"] for d in docs)))
    n = max(r.slot for r in rows) + 1
    every = {r.slot: r.ids for r in training_order.read_shards(spark, folder, 256, 16).collect()}
    assert sorted(every) == list(range(n))
    for first in (0, 7, 16, 37, n - 1, n):
        got = training_order.read_shards(spark, folder, 256, 16, first).collect()
        assert {r.slot: r.ids for r in got} == {s: x for s, x in every.items() if s >= first}
        if first < n:
            assert [x.tobytes() for x in training_order.read_from(folder, first, 256, 16)] == [every[s] for s in range(first, n)]
    assert queries.op6_training_order(spark, sf).select("doc_id").distinct().count() == len(docs)


def test_order_of_odd_rows(odd, empty):
    from .conftest import TEXTS

    manifest, folder = training_order.write_shards(odd, length=64, shard_slots=8)
    rows = manifest.collect()
    alone = [r for r in rows if r.doc_id != 7]
    got = read_back(rows, folder, 64, 8)
    want = dict(zip((k for k, _ in TEXTS), library_ids(t for _, t in TEXTS)))
    assert {k: v for k, v in got.items() if k != 7} == {k: v for k, v in want.items() if k != 7} and alone
    assert len(got[7]) == sum(len(x) for (k, _), x in zip(TEXTS, library_ids(t for _, t in TEXTS)) if k == 7)
    assert training_order.write_shards(empty)[0].count() == 0


def test_pipeline(spark, sf, docs):
    """Every stage's rows against the operators' own brute-force tests: schema, order, whole input."""
    import corpus_pipeline

    df, columns = spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        if name != "packing":
            assert df.columns == columns, name
            df = spark.createDataFrame(df.toPandas().to_dict("records"), spark.read.parquet(f"{sf}/documents.parquet").schema)
        sizes.append(df.count())
    from .test_near_and_repeats import brute_classes

    kept = {r.doc_id for r in queries.op9_language_id(spark, sf).collect() if r.kept}
    assert sizes[0] == len(kept)
    assert sizes[1] == len(set(brute_classes([(d["doc_id"], d["text"]) for d in docs if d["doc_id"] in kept]).values()))
    assert sizes[2] == sizes[3] == sizes[1]
    assert {r.doc_id for r in df.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    json.dumps(sizes)


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, sf):
    """Stages keep columns, and rows without ids or texts go only where a stage rejects them."""
    import corpus_pipeline

    for table in (odd, empty, odd.where("doc_id IS NULL OR text IS NULL")):
        df = table
        for name, stage in corpus_pipeline.STAGES:
            before, df = df, stage(spark, df, sf)
            if name == "packing":
                assert {r.doc_id for r in df.collect()} == {r.doc_id for r in before.collect()}
                continue
            assert df.columns == table.columns, name
            df = spark.createDataFrame(df.collect(), table.schema)
            assert df.count() <= before.count() and (name in ("language ID", "near-duplicates") or df.count() == before.count())
