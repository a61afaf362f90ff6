"""Process chains against loops; records of binary files whatever the ranges."""

import hashlib
import random
import re
import struct

import pytest

from quarry.operators import chains
from quarry.sources import byte_ranges


def key_of(names):
    out = ""
    for i, base in enumerate(chains.BASES):
        k = 0
        for n in names:
            k = (k * base + int(hashlib.md5(n.encode()).hexdigest()[7 * i : 7 * i + 7], 16)) % chains.PRIME
        out += f"{k:08x}"
    return out


def loop(rows):
    """{id: (length, root, tail, key)} of rows (id, pid, ppid, name, created) without circles."""
    at = lambda r: float("-inf") if r[4] is None else r[4]
    up, by = {}, {r[0]: r for r in rows}
    for r in rows:
        known = [x for x in rows if x[1] == r[2] and at(x) <= at(r)]
        best = max(known, key=lambda x: (at(x), x[0]), default=None)
        up[r[0]] = best[0] if best and best[0] != r[0] else None
    out = {}
    for r in rows:
        path = [r[0]]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        names = [by[i][3] for i in reversed(path)]
        out[r[0]] = (len(path), path[-1], "->".join(names[-chains.TAIL :]), key_of(names))
    return out


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "id long, pid long, ppid long, name string, created double").withColumn("created", F.timestamp_seconds("created"))


def test_chains_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(60), rng.randrange(60), rng.choice(["a.exe", "b.exe", "c.exe"]), float(i) if rng.random() < 0.9 else None) for i in range(150)]
    # unknown times come before all, so among them circles may be: these have known parents only
    rows = [(i, p, q if t is not None else 1000, n, t) for i, p, q, n, t in rows]
    got = {r.id: (r.length, r.root, r.tail, r.chain_key) for r in chains.chains(frame(spark, rows)).collect()}
    assert got == loop(rows) and max(v[0] for v in got.values()) > 3
    assert chains.chains(frame(spark, rows).where("false")).count() == 0


def test_long_chain_and_circle(spark):
    rows = [(i, i, i - 1, f"p{i % 7}.exe", float(i)) for i in range(1, 10_001)]
    rows += [(20_001, 20_001, 20_003, "x.exe", 5.0), (20_002, 20_002, 20_001, "y.exe", 5.0), (20_003, 20_003, 20_002, "z.exe", 5.0), (20_004, 20_004, 20_003, "w.exe", 6.0), (20_005, 20_005, 20_005, "self.exe", 6.0)]
    got = {r.id: r for r in chains.chains(frame(spark, rows)).collect()}
    assert (got[10_000].length, got[10_000].root) == (10_000, 1) and got[10_000].chain_key == key_of([f"p{i % 7}.exe" for i in range(1, 10_001)])
    assert [(got[i].length, got[i].root, got[i].tail, got[i].cyclic) for i in (20_001, 20_002, 20_003, 20_004, 20_005)] == [
        (1, 20_001, "x.exe", True), (2, 20_001, "x.exe->y.exe", True), (3, 20_001, "x.exe->y.exe->z.exe", True), (4, 20_001, "x.exe->y.exe->z.exe->w.exe", True), (1, 20_005, "self.exe", False)]
    assert not got[10_000].cyclic


@pytest.mark.parametrize("step", [1, 7, 64, 100_000])
def test_patterns_in_any_ranges(spark, tmp_path, step):
    rng = random.Random(1)
    data = bytes(rng.choice(b"AB\x00\xff") for _ in range(400)) + b"AAAA" + b"B" * 40
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.bin").write_bytes(data)
    (tmp_path / "x" / "empty.bin").write_bytes(b"")
    (tmp_path / "x" / "_SUCCESS").write_bytes(b"AB")
    got = byte_ranges.patterns(spark, f"file://{tmp_path}/x", "A[AB]{1,8}", 6, step).collect()
    want = [(at, m.group()) for at in range(len(data)) if (m := re.compile(b"A[AB]{1,8}", re.S).match(data, at, at + 6))]
    assert sorted((r.offset, bytes(r.match)) for r in got) == want


def record(number, event_id, when, provider, computer, strings, kind=4):
    wide = lambda s: (s + "\0").encode("utf-16-le")
    head = byte_ranges.EVENT_HEAD.size
    body = wide(provider) + wide(computer)
    body += b"\0" * (-len(body) % 4)
    at = head + len(body)
    body += b"".join(map(wide, strings))
    body += b"\0" * (-len(body) % 4)
    size = head + len(body) + 4
    return byte_ranges.EVENT_HEAD.pack(size, b"LfLe", number, when, when, event_id | 0x40000000, kind, len(strings), 0, 0, 0, at, 0, 0, 0, 0) + body + struct.pack("<I", size)


@pytest.mark.parametrize("step", [13, 200, 1 << 20])
def test_old_event_logs_in_any_ranges(spark, tmp_path, step):
    head = struct.pack("<I4sIIIIIIIIII", 0x30, b"LfLe", 1, 1, 0x30, 0, 1, 0, 0, 0, 0, 0x30)
    data = head + b"".join(record(i, 500 + i, 1_000_000_000 + i, "Säge", "HOST", [f"text {i}", "", "LfLe " * i]) for i in range(6)) + b"LfLe torn" + record(9, 529, 0, "P", "", [])[:-2]
    (tmp_path / "SecEvent.Evt").write_bytes(data)
    got = sorted(byte_ranges.old_event_logs(spark, f"{tmp_path}/SecEvent.Evt", step).collect(), key=lambda r: r.offset)
    assert [(r.channel, r.number, r.event_id, r.provider, r.computer) for r in got] == [("SecEvent", i, 500 + i, "Säge", "HOST") for i in range(6)]
    assert got[2].message == "text 2 | LfLe LfLe " and got[0].time_created == "2001-09-09T01:46:40" and got[0].offset == 0x30
