import hashlib
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import fingerprints, quality, queries, secrets


def measured(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(odd, empty):
    from .conftest import TEXTS

    got = [tuple(r)[2:7] for r in quality.judge(odd).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got) == sorted(measured(t) for _, t in TEXTS)
    assert quality.judge(empty).count() == 0


def test_op2(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, m = got[d["doc_id"]], measured(d["text"])
        assert tuple(r)[1:6] == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)


def test_strict_host(spark):
    bad = [(i, "ab#c$ d%e " * 40 + str(i), "en", "bad", 0) for i in range(40)]
    good = [(100 + i, " ".join(f"word{i}x{k}" for k in range(60)), "en", f"good{i % 9}", 0) for i in range(200)]
    one = [(999, " ".join(f"w#{k}" for k in range(60)), "en", "good1", 0), (998, " ".join(f"clean{k}" for k in range(60)), "en", "bad", 0)]
    kept = {r.doc_id: (r.kept, r.host_failed) for r in quality.judge(spark.createDataFrame(bad + good + one, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(kept[i][1] for i in range(40)) and all(kept[100 + i][0] for i in range(200))
    assert kept[999][0] and kept[998][0]


def folded(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def test_op4(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, sf).collect()}
    order = sorted(docs, key=lambda d: -d["doc_id"])
    assert len(got) == len(docs)
    prints = {}
    for d, nxt in zip(order, [*order[1:], order[0]]):
        t, u, r = d["text"] or "", nxt["text"] or "", got[d["doc_id"]]
        edit = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r.near_next == float(folded(t) == folded(u)) and r.near_edited == float(folded(t) == folded(edit))
        assert prints.setdefault(folded(t), r.fingerprint) == r.fingerprint and prints.setdefault(folded(edit), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_odd_rows(odd, empty):
    from .conftest import TEXTS

    rows = fingerprints.fingerprints(odd).select("text", "fingerprint").collect()
    assert len(rows) == len(TEXTS)
    prints = {}
    for r in rows:
        assert prints.setdefault(folded(r.text), r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.edited(odd).count() == len(TEXTS) and fingerprints.edited(empty).count() == 0


def test_mixed_buckets_split(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "text string, fingerprint string")
    mixed = spark.createDataFrame([("x", True)], "digest string, mixed boolean")
    got = {r.text: r.fingerprint for r in fingerprints.split_mixed(df, mixed, {"fingerprint": F.col("text")}).collect()}
    assert got["c"] == "y" and got["a"] != got["b"] and got["a"].startswith("x-")


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[1]) >= 8)
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_op7(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op7_secrets(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = base_spans(d["text"] or ""), got[d["doc_id"]]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secrets_of_odd_rows(spark, sf, odd, empty):
    from .conftest import TEXTS

    ratios = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    found = secrets.find(odd, ratios)
    rows = found.select("text", "spans").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert [tuple(s) for s in r.spans if s.kind < 3] == base_spans(r.text or "")
    random = next(r for r in rows if r.text and r.text.startswith("kq9Zt7"))
    assert [tuple(s) for s in random.spans] == [(0, 3, 24)]
    masked = [r.text for r in secrets.mask(found).collect()]
    assert "<secret> plain_snake_case_identifier_name" in masked and None in masked
    assert not any("AKIA" in (t or "") for t in masked)
    assert secrets.find(empty, ratios).count() == 0
    assert len(secrets.train(empty)) == len(ratios)


def test_models_hold_out(spark, sf):
    """Held-out accuracy on other random strings and other identifiers."""
    import base64
    import random

    rng = random.Random(5)
    noise = [base64.b64encode(rng.randbytes(24)).decode() for _ in range(200)] + [rng.randbytes(16).hex().upper() for _ in range(100)]
    plain = ["_".join(rng.choice(["user", "account", "total", "index", "document", "window", "length", "parse"]) for _ in range(4)) for _ in range(300)]
    ratios = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    df = spark.createDataFrame(list(enumerate(noise + plain)), "doc_id long, text string")
    hit = {r.doc_id for r in secrets.find(df, ratios).where("size(spans) > 0").collect()}
    assert len([i for i in hit if i < 200]) >= 190
    assert len([i for i in hit if i >= 300]) <= 3
