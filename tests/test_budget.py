"""A budget over sources, and suffixes of names, against loops."""

import random

import pytest

from quarry.operators import budget, fact_index


@pytest.mark.parametrize("total,header", [(100, 0), (100, 7), (3, 5), (0, 0), (10_000, 1)])
def test_budget_equals_a_loop(spark, total, header):
    rng = random.Random(total + header)
    rows = [(i, f"s{rng.randrange(6)}", rng.choice([None, 0, 3, 9, 40])) for i in range(60)] + [(100 + i, "huge", 500) for i in range(3)]
    rank = {"s0": 9, "s1": 1, "huge": 8, "s2": 8}
    left, want = total, set()
    for s in sorted({r[1] for r in rows}, key=lambda s: (-rank.get(s, 5), s)):
        room, used, kept = left - header, 0, []
        for i, _, n in sorted(r for r in rows if r[1] == s):
            used += n or 0
            if used > room:
                used -= n or 0
                break
            kept.append(i)
        if kept:
            left = room - used
            want |= set(kept)
    df = spark.createDataFrame([(i, s, n, rank.get(s, 5)) for i, s, n in rows], "i long, s string, n int, p int")
    assert {r.i for r in budget.within_budget(df, "s", "p", "i", "n", total, header).collect()} == want
    assert budget.within_budget(df.where("false"), "s", "p", "i", "n", total).count() == 0


def test_longest_suffix(spark):
    names = spark.createDataFrame([(n,) for n in ["a.b.co.uk", "co.uk", "uk", "x.uk", "A.Example.COM.", "nothing", "file.exe", None, "", "b.city.kawasaki.jp"]], "name string")
    suffixes = spark.createDataFrame([(s,) for s in ["uk", "co.uk", ".com", "jp", "kawasaki.jp", None]], "suffix string")
    got = {r.name: (r.suffix, r.registrable) for r in budget.registrable(names, suffixes).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", None), "uk": ("uk", None), "x.uk": ("uk", "x.uk"), "a.example.com": ("com", "example.com"), "nothing": (None, None), "file.exe": (None, None), "b.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp")}


def test_lookups_in_a_stored_index_shuffle_no_facts(spark):
    from pyspark.sql import functions as F

    facts = spark.range(500).select(F.col("id").alias("fact_id"), (F.col("id") % 7).alias("pid"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), (F.col("id") % 5).cast("string"))).alias("path"))
    table = fact_index.write_index(facts, {"by_pid": F.col("pid"), "by_path": F.col("path")}, "fact_id", ["path"])
    claims = spark.createDataFrame([(1, "by_pid", "3"), (2, "by_path", "p4"), (3, "by_pid", "99"), (4, "by_path", None)], "claim_id long, index_name string, key string")
    found = fact_index.lookup(claims, table)
    want = {(1, i) for i in range(500) if i % 7 == 3} | {(2, i) for i in range(500) if i % 3 == 0 and i % 5 == 4}
    assert {(r.claim_id, r.fact_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
