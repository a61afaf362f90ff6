"""Greedy emission, selection in turn, names in texts and frequent items against plain loops."""

import random
import re
from collections import Counter

import pytest

from quarry.operators import corroborate, emission, frequent, mentions, selection


def loop(candidates, seen):
    """What a loop takes of (id, score, key, tokens)."""
    seen, taken = set(seen), []
    for i, _, _, tokens in sorted(sorted(candidates), key=lambda c: (c[1], c[2]), reverse=True):
        if tokens and seen.isdisjoint(tokens):
            taken.append(i)
            seen |= set(tokens)
    return taken


def frame(spark, candidates, behaviour="b"):
    rows = [(i, s, k, behaviour, list(t), ["t1"]) for i, s, k, t in candidates]
    return spark.createDataFrame(rows, "candidate_id long, score int, entity_key string, behaviour string, tokens array<string>, source_tools array<string>")


def tokens_of(spark, tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


@pytest.mark.parametrize("rest", [100_000, 5])
def test_greedy_equals_a_loop(spark, monkeypatch, rest):
    monkeypatch.setattr(emission, "REST", rest)
    rng = random.Random(rest)
    some = [(i, rng.randrange(6), f"ip:{rng.randrange(40)}", {f"t{rng.randrange(120)}" for _ in range(rng.randrange(4))}) for i in range(150)]
    some += [(200 + i, 50, "ip:hot", {"hot", f"t{i}"}) for i in range(60)]
    # a chain in which every candidate waits for the one before
    some += [(300 + i, 1000 - i, "ip:chain", {f"c{i}", f"c{i + 1}"}) for i in range(25)]
    got = emission.emitted(frame(spark, some), tokens_of(spark, ["t3", "t4"])).collect()
    assert sorted(r.candidate_id for r in got if r.standing == "emitted") == sorted(loop([c for c in some if not c[3] & {"t3", "t4"}], []))
    assert {r.candidate_id for r in got if r.standing == "known"} == {i for i, _, _, t in some if t & {"t3", "t4"}}
    assert {r.candidate_id for r in got if r.standing == "no_tokens"} == {i for i, _, _, t in some if not t}
    assert len(got) == len(some)


def test_a_candidate_beaten_only_by_a_beaten_one_is_kept(spark):
    three = [(1, 30, "", {"x"}), (2, 20, "", {"x", "y"}), (3, 10, "", {"y"})]
    assert sorted(r.candidate_id for r in corroborate.fresh(frame(spark, three), tokens_of(spark, ["z"])).collect()) == [1, 3]


def test_repeated_behaviours_collapse(spark):
    rows = [(1, 9, r"path:C:\a\Evil.exe -x", {"a"}), (2, 8, "path:d:/b/evil.EXE", {"b"}), (3, 7, "path:d:/b/evil.exe", {"b"}), (4, 6, "path:c:/other.exe", {"c"}), (5, 5, "ip:8.8.8.8", {"d"}), (6, 4, "ip:8.8.8.9", {"e"}), (7, 3, None, {"f"})]
    candidates = frame(spark, rows)
    got = emission.emitted(candidates, tokens_of(spark, []))
    assert {r.candidate_id: (r.standing, r.representative) for r in got.collect()} == {
        1: ("emitted", 1), 2: ("collapsed", 1), 3: ("beaten", None), 4: ("emitted", 4), 5: ("emitted", 5), 6: ("emitted", 6), 7: ("emitted", 7)}
    assert {r.candidate_id: (r.instances, r.source_tools) for r in emission.representatives(candidates, got).collect()}[1] == (2, ["t1"])
    assert emission.emitted(candidates.where("false"), tokens_of(spark, [])).count() == 0


def turns(records, high, reserve, others, chunk, most):
    """Played turn by turn: (phase, id)."""
    by = {}
    for i, key, t in records:
        by.setdefault(key or "", []).append((i, t))
    for rows in by.values():
        rows.sort(key=lambda r: r[0])
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0), reverse=True)
    at, out = dict.fromkeys(by, 0), []

    def take(key, n, phase):
        n = max(0, min(n, most - len(out), len(by[key]) - at[key]))
        out.extend((phase, i) for i, _ in by[key][at[key] : at[key] + n])
        at[key] += n
        return n

    present = sorted(k for k in by if k in high)
    for k in present:
        take(k, min(1, reserve), 0)
    while sum([take(k, min(chunk, reserve - at[k]), 1) for k in present]):
        pass
    held = {k: at[k] for k in present}
    while sum([take(k, min(chunk, others - at[k] + held.get(k, 0)), 2) for k in sorted(by)]):
        pass
    return out


@pytest.mark.parametrize("reserve,others,chunk,most", [(10, 7, 3, 60), (5, 5, 4, 8), (0, 3, 2, 100), (30, 0, 50, 100), (1, 50, 7, 500)])
def test_round_robin_equals_its_turns(spark, reserve, others, chunk, most):
    rng = random.Random(most)
    records = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(20)])) for i in range(300)] + [(900, "lone", 3)]
    df = spark.createDataFrame(records, "id long, k string, t int")
    kept = selection.round_robin(df, "k", "t", "id", ["b", "d", "absent", "lone"], reserve, others, chunk, most)
    want = turns(records, {"b", "d", "lone"}, reserve, others, chunk, most)
    assert [(r.phase, r.id) for r in sorted(kept.collect(), key=lambda r: r.position)] == want
    got = {r.key: (r.source, r.kept, r.starved) for r in selection.dealt_report(df, kept, "k", ["b", "d", "lone"]).collect()}
    sizes, ids = Counter(k or "" for _, k, _ in records), {i: k or "" for i, k, _ in records}
    held = Counter(ids[i] for _, i in want)
    assert got == {k: (n, held[k], k in ("b", "d", "lone") and not held[k]) for k, n in sizes.items()}


def test_round_robin_limits_each_key_before_the_shuffle(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = selection.round_robin(events, "event_type", "ts", "event_id", ["error"], 40, 60, 7, 250)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("stretch", [1 << 16, 5])
def test_mentions_equal_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(mentions, "STRETCH", stretch)
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abAB .-é") for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, None), (91, ""), (92, "x\\E.exe\nmy file.exe"), (93, "a" * 500)]
    names = ["a", "ba", "ab a", "B-a", "a.b", "éa", "aaaa", "x\\E.exe", "my file.exe", "file", "absent name", "", None, "ab a", " "]
    args = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    low = {n.lower() for n in names if n}
    plain = {(i, n) for i, t in texts for n in low if t and n in t.lower()}
    assert {tuple(r) for r in mentions.mentions(*args).collect()} == plain
    edge = mentions.NAME_BORDER
    alone = {(i, n) for i, n in plain if re.search(f"(?:^|[^{edge}]){re.escape(n)}(?:[^{edge}]|$)", dict(texts)[i].lower())}
    assert {tuple(r) for r in mentions.mentions(*args, edge).collect()} == alone and len(alone) < len(plain)
    assert mentions.mentions(args[0], args[1].where("false")).count() == 0


def test_names_of_files_in_texts_corroborate(spark):
    findings = spark.createDataFrame([(1, ["C:\\X\\my file.exe"], [], [], ["vol_pstree"]), (2, ["C:\\X\\ile.exe"], [], [], ["vol_pstree"])], "finding_id long, paths array<string>, hashes array<string>, services array<string>, source_tools array<string>")
    facts = spark.createDataFrame([("event_log_fact", "parse_event_logs", None, None, None, "ran 'MY FILE.exe', done"), ("x_fact", "get_amcache", None, None, None, "my file.exe"), ("y_fact", "run_mftecmd", None, None, None, "my file.exe.bak")], "fact_type string, source_tool string, path string, hash string, service string, text string")
    got = corroborate.corroborated(findings, facts).collect()
    assert [(r.finding_id, r.new_tools, r.families) for r in got] == [(1, ["get_amcache", "parse_event_logs"], ["event_log_fact", "x_fact"])]


@pytest.mark.parametrize("tracked,most", [(2000, 128_000), (8, 64), (8, 8)])
def test_frequent_items_are_exact(spark, tracked, most):
    rng = random.Random(tracked)
    rows = [("skewed", f"w{int(rng.paretovariate(0.6)) % 3000}") for _ in range(8000)] + [("flat", f"v{i % 500}") for i in range(3000)] + [("few", "x"), ("few", "y"), ("few", "x"), ("few", None), (None, "z")]
    df = spark.createDataFrame(rows, "g string, w string")
    want = set()
    for g in ("skewed", "flat", "few"):
        counts = Counter(w for k, w in rows if k == g and w is not None)
        want |= {(g, w, n, i + 1) for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {tuple(r) for r in frequent.top(df, "g", "w", 5, tracked, most).collect()} == want
    assert frequent.top(df.where("false"), "g", "w", 5).count() == 0
