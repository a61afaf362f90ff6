"""Bounded-space online packing of token ids into fixed windows.

Every partition keeps ``open_windows`` windows.  A document's ids are cut at the window
length; a rest goes to the window that it fits best.  When none fits, the fullest window
is topped up with the beginning of the rest and emitted.  At the end the open windows
are merged, fullest first; what remains, below one window, is cut at its binary digits,
so it takes a few short windows of a power of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, encoded_blocks

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Windows of one partition; ``add`` and ``close`` give pieces (key, start, total, sequence, offset, ids)."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.sequence = window, 0
        self.pieces = [[] for _ in range(open_windows)]
        self.free = sorted((window, i) for i in range(open_windows))

    def _emit(self, pieces):
        offset = 0
        for key, start, total, ids in pieces:
            yield key, start, total, self.sequence, offset, ids
            offset += len(ids)
        self.sequence += 1

    def add(self, key, ids):
        total, at = len(ids), 0
        while total - at >= self.window:
            yield from self._emit([(key, at, total, ids[at : at + self.window])])
            at += self.window
        if at == total:
            return
        rest = ids[at:].copy()
        best = bisect_left(self.free, (len(rest), -1))
        if best == len(self.free):
            # none fits: fill the fullest, emit it and begin anew in its place
            room, w = self.free.pop(0)
            self.pieces[w].append((key, at, total, rest[:room]))
            yield from self._emit(self.pieces[w])
            self.pieces[w] = []
            at, rest = at + room, rest[room:]
            insort(self.free, (self.window, w))
            best = bisect_left(self.free, (len(rest), -1))
        room, w = self.free.pop(best)
        self.pieces[w].append((key, at, total, rest))
        if room == len(rest):
            yield from self._emit(self.pieces[w])
            self.pieces[w], room = [], self.window + len(rest)
        insort(self.free, (room - len(rest), w))

    def close(self):
        left = [p for _, w in self.free for p in self.pieces[w]]
        tokens = sum(len(p[3]) for p in left)
        sizes = [self.window] * (tokens // self.window)
        sizes += [1 << b for b in range(self.window.bit_length(), -1, -1) if tokens % self.window >> b & 1]
        left.reverse()
        for size in sizes:
            window = []
            while size:
                key, start, total, ids = left.pop()
                window.append((key, start, total, ids[:size]))
                if len(ids) > size:
                    left.append((key, start + size, total, ids[size:]))
                size -= len(window[-1][3])
            yield from self._emit(window)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, open_windows: int = 64, end_id: int = 2) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows.

    A document's ids are those of its text and ``end_id``; a null or empty text has the
    end alone.  ``ids`` are little-endian unsigned 32-bit.  ``sequence_id`` holds the
    partition in its upper half, so the job needs no shuffle and a task that runs again
    gives the same rows.  Each row is packed by itself, repeated ones too; columns other
    than doc_id and text are ignored; a text of any length is cut, none is dropped.
    """
    path = vocabulary or default_vocabulary()

    def batch(partition, rows):
        keys, starts, totals, sequences, offsets, parts = zip(*rows)
        base = partition << 32
        columns = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "length": pa.array(map(len, parts), pa.int64()), "doc_tokens": pa.array(totals, pa.int64()), "sequence_id": pa.array([base + s for s in sequences], pa.int64()), "offset": pa.array(offsets, pa.int64()), "ids": pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        import itertools

        import numpy as np
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        partition, packer, rows = TaskContext.get().partitionId(), Packer(window, open_windows), []
        end = np.array([end_id], np.uint32)
        for keys, ids, ends in encoded_blocks(itertools.chain([first], batches), path, speculate=False):
            ends = ends.tolist()
            for key, a, b in zip(keys.to_pylist(), ends, ends[1:]):
                rows.extend(packer.add(key, np.concatenate([ids[a:b], end])))
            if rows:
                yield batch(partition, rows)
                rows = []
        rows.extend(packer.close())
        if rows:
            yield batch(partition, rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
