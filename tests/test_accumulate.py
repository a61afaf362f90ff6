"""Streams with keyed state against the batch operators, with a restart between batches."""

import random

import pytest

from quarry.operators import selection
from quarry.streaming import accumulate


@pytest.fixture
def state(spark):
    before = spark.conf.get(accumulate.PROVIDER[0])
    accumulate.ready(spark)
    yield
    spark.conf.set(accumulate.PROVIDER[0], before)


def play(spark, tmp_path, batches, make, mode):
    """Rows of every batch; the query is stopped and goes on from its checkpoint after each."""
    out = []
    for i, rows in enumerate(batches):
        rows.write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
        held = []
        query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).foreachBatch(lambda df, _, held=held: held.extend(df.collect())).start()
        query.awaitTermination(120)
        assert query.exception() is None
        out.append(held)
    return out


def test_first_arrivals_over_batches_and_restarts(spark, tmp_path, state):
    rng = random.Random(3)
    rows = [(i, rng.choice(["System", "Security", "Other", None]), f"m{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "ordinal long, channel string, message string")
    parts = [df.where(f"ordinal BETWEEN {a} AND {a + 79}") for a in (0, 80, 160)]
    limits = {"Security": 50, "System": 3}
    got = play(spark, tmp_path, parts, lambda s: accumulate.first_arrivals(s, "channel", "ordinal", limits, 25), "append")
    want = selection.arrival_cap(df.fillna({"channel": ""}), "channel", "ordinal", limits, 25)
    key = lambda r: (r.channel, r.rank, r.ordinal, r.message)
    assert sorted(key(r) for held in got for r in held) == sorted(key(r) for r in want.collect())
    assert [sum(r.channel == "System" for r in held) for held in got] == [3, 0, 0] and any(r.channel == "Security" for r in got[2])


def test_indicators_over_batches_and_restarts(spark, tmp_path, state):
    rng = random.Random(5)
    rows = [(i, "domain" if i % 3 else "ip", f"v{rng.randrange(6)}", rng.choice(["a", "b", "c", None]), f"s{rng.randrange(40)}", rng.choice(["public", "vendor"])) for i in range(200)]
    rows.append((500, None, "v1", "a", "s", "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ordinal long, kind string, value string, tool string, source string, class string")
    parts = [df.where(c) for c in ("ordinal % 3 = 1", "ordinal % 3 = 2", "ordinal % 3 = 0")]
    last = {}
    for held in play(spark, tmp_path, parts, lambda s: accumulate.indicators(s, 5), "update"):
        last |= {(r.kind, r.value): tuple(r) for r in held}
    assert last == {(r.kind, r.value): tuple(r) for r in accumulate.gathered(df, 5).collect()}
    assert accumulate.gathered(df.where("false")).count() == 0
