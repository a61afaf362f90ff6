"""Binary sources read in ranges of bytes: a file of any size is many tasks' work.

Each task reads one range and a little beyond it, as much as the longest record.  A record belongs to the range in which it
starts and is matched against no more than the longest record's bytes from there, so the records are the same
whatever the ranges are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 16 << 20
# The mark of a record of an old event log, the fields of its head, and how long a record may be.
EVENT_MARK = b"LfLe"
EVENT_HEAD = struct.Struct("<I4sIIIIHHHHIIIIII")
LONGEST_EVENT = 1 << 16
MESSAGE = 200


def _open(path: str):
    """(pyarrow file system, path in it) of a URI or a plain path."""
    import pyarrow.fs as pafs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    for name, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        path = plain + path[len(name) :] if path.startswith(name) else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def starts(pattern: str, data: bytes, own: int, longest: int) -> Iterator[tuple[int, bytes]]:
    """(place, match) at every place below ``own`` where the pattern matches within ``longest`` bytes; matches may overlap."""
    ahead, whole = re.compile(b"(?=" + pattern.encode("latin-1") + b")", re.S), re.compile(pattern.encode("latin-1"), re.S)
    for found in ahead.finditer(data):
        at = found.start()
        if at >= own:
            return
        match = whole.match(data, at, at + longest)
        if match:
            yield at, match.group()


def event(data: bytes, at: int) -> tuple | None:
    """Fields of the record of an old event log that starts at a place, if one does: (number, event_id, written, provider, computer, message)."""
    if len(data) - at < EVENT_HEAD.size:
        return None
    size, mark, number, _, written, event_id, _, n_strings, _, _, _, strings_at, *_ = EVENT_HEAD.unpack_from(data, at)
    if mark != EVENT_MARK or not EVENT_HEAD.size + 4 <= size <= LONGEST_EVENT or at + size > len(data) or data[at + size - 4 : at + size] != data[at : at + 4]:
        return None
    texts = lambda begin, end: data[begin : end - (end - begin) % 2].decode("utf-16-le", "replace").split("\0")
    names = (texts(at + EVENT_HEAD.size, at + size - 4) + ["", ""])[:2]
    said = texts(at + strings_at, at + size - 4)[:n_strings] if n_strings and EVENT_HEAD.size <= strings_at < size else []
    when = datetime.fromtimestamp(written, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return number, event_id & 0xFFFF, when, names[0], names[1], " | ".join(s for s in said if s)[:MESSAGE]


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.root, self.step = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        """Ranges of a file, or of all files below a folder whose names don't begin with a dot or an underscore."""
        import pyarrow.fs as pafs

        fs, path = _open(self.root)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.type == pafs.FileType.File and (f is info or f.base_name[:1] not in "._")), key=lambda f: f.path)
        return [Range(f.path, at, min(at + self.step, f.size)) for f in files for at in range(0, f.size, self.step)]

    def data(self, part: Range, beyond: int) -> bytes:
        fs, _ = _open(self.root)
        with fs.open_input_file(part.path) as f:
            return f.read_at(part.end - part.begin + beyond, part.begin)


class PatternReader(RangeReader):
    def read(self, partition: Range) -> Iterator[tuple]:
        longest = int(self.options["longest"])
        for at, match in starts(self.options["pattern"], self.data(partition, longest), partition.end - partition.begin, longest):
            yield partition.path, partition.begin + at, match


class EventReader(RangeReader):
    def read(self, partition: Range) -> Iterator[tuple]:
        data, own = self.data(partition, LONGEST_EVENT), partition.end - partition.begin
        channel = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        at = data.find(EVENT_MARK, 4)
        # a mark in the first four bytes belongs to a record of the range before
        while at != -1 and at - 4 < own:
            record = event(data, at - 4)
            if record:
                yield partition.path, partition.begin + at - 4, channel, *record
            at = data.find(EVENT_MARK, at + 1)


class BytePatterns(DataSource):
    """Format ``byte_patterns``: options path, pattern (of bytes), longest (bytes of a match) and range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "byte_patterns"

    def schema(self) -> str:
        return "path string, offset long, match binary"

    def reader(self, schema) -> DataSourceReader:
        return PatternReader(dict(self.options))


class OldEventLogs(DataSource):
    """Format ``old_event_logs``: records of event logs of the old binary form; options path and range."""

    @classmethod
    def name(cls) -> str:
        return "old_event_logs"

    def schema(self) -> str:
        return "path string, offset long, channel string, number long, event_id int, time_created string, provider string, computer string, message string"

    def reader(self, schema) -> DataSourceReader:
        return EventReader(dict(self.options))


def patterns(spark: SparkSession, path: str, pattern: str, longest: int, step: int = RANGE) -> DataFrame:
    """(path, offset, match) of every place of a file, or of the files below a folder, where a pattern of bytes matches.

    Matches may overlap; of one that could be longer the first ``longest`` bytes decide.  Empty files have none.
    """
    spark.dataSource.register(BytePatterns)
    return spark.read.format("byte_patterns").option("pattern", pattern).option("longest", longest).option("range", step).load(path)


def old_event_logs(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """Records of old event logs: a record is where its mark, its length and the length's repetition at its end agree."""
    spark.dataSource.register(OldEventLogs)
    return spark.read.format("old_event_logs").option("range", step).load(path)
