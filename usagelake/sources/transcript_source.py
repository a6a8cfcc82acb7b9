"""Growing transcript files as a Spark data source, read from the byte where the last batch stopped.

The offset of a stream names every file with the bytes read of it and a hash of their head. A file
that grew is read from there on; one that shrank or begins with other bytes was rewritten and is
read from its start; an unfinished last line waits for its line feed. A large file is dealt over
tasks, small ones share a task. Files are reached through ``pyarrow.fs``, on the driver for
listings, heads and ends, in the tasks for lines.

    register(spark)
    lines = spark.readStream.format("transcripts").option("path", folder).load()

The format can also be read as a batch: everything that is there, by the same rules.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed value: bytes of a file's head that tell whether it was rewritten.
HEAD_BYTES = 4096
#: Bytes of text in a task, and bytes read at once.
SPLIT, READ = 64 << 20, 1 << 20
SCHEMA = "value string, source_path string, file_size long, modified_at timestamp, at long"


@dataclass
class Range:
    """Lines of a file that start in [start, end); the file's new bytes end at ``stop``."""

    path: str
    start: int
    end: int
    stop: int
    whole_lines: bool
    size: int
    modified: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class Files:
    """The transcript files below a folder."""

    def __init__(self, path: str, pattern: str, split: int):
        self.path, self.pattern, self.split = path, pattern, split
        self._seen: dict[str, tuple] = {}

    def _system(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path[5:]}")
        return fs.LocalFileSystem(), self.path

    def offset(self) -> dict[str, list]:
        """Every file: bytes up to its last line feed, length and hash of their head, size and age.

        Only files whose size or age changed since the last call are opened.
        """
        from pyarrow import fs

        system, root = self._system()
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.pattern):
                continue
            mark = (info.size, info.mtime_ns)
            old = self._seen.get(info.path)
            if old is None or old[0] != mark:
                with system.open_input_file(info.path) as file:
                    end = _last_line_end(file, info.size)
                    head = min(HEAD_BYTES, end)
                    entry = [end, head, _head(file, head), info.size, (info.mtime_ns or 0) // 1000]
                old = (mark, entry)
            found[info.path] = old
        self._seen = found
        return {path: entry for path, (_, entry) in sorted(found.items())}

    def ranges(self, start: dict[str, list], end: dict[str, list]) -> list[Ranges]:
        """What was added or rewritten between two offsets, in parts of about ``split`` bytes."""
        system, _ = self._system()
        new = []
        for path, (stop, head, digest, size, modified) in end.items():
            at = 0
            if path in start:
                at, old_head, old_digest = start[path][:3]
                if at == stop and (old_head, old_digest) == (head, digest):
                    continue
                if old_head != head and at <= stop:
                    with system.open_input_file(path) as file:
                        digest = _head(file, old_head)
                if stop < at or digest != old_digest:
                    at = 0
            for part in range(at, stop, self.split):
                new.append(Range(path, part, min(part + self.split, stop), stop, part == at, size, modified))
        return _packed(new, self.split)

    def lines(self, ranges: list[Range]) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        for r in ranges:
            with system.open_input_file(r.path) as file:
                for values, places in _lines(file, r):
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(values, pa.string()), pa.array([r.path] * n, pa.string()),
                        pa.array([r.size] * n, pa.int64()), pa.array([r.modified] * n, pa.timestamp("us", "UTC")),
                        pa.array(places, pa.int64())],
                        names=["value", "source_path", "file_size", "modified_at", "at"])


def _head(file, length: int) -> str:
    file.seek(0)
    return hashlib.sha256(file.read(length)).hexdigest()


def _last_line_end(file, size: int) -> int:
    """Place behind the last line feed; 0 if there is none."""
    at = size
    while at > 0:
        start = max(0, at - READ)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def _packed(ranges: list[Range], split: int) -> list[Ranges]:
    packed, held, size = [], [], 0
    for r in ranges:
        if held and size + r.end - r.start > split:
            packed.append(Ranges(held))
            held, size = [], 0
        held.append(r)
        size += r.end - r.start
    return [*packed, Ranges(held)] if held else packed


def _lines(file, r: Range) -> Iterator[tuple[list[str], list[int]]]:
    """Lines that start in the range, some at a time; the last one may end behind it."""
    at = r.start if r.whole_lines else r.start - 1
    file.seek(at)
    held, place, skip = [], at, not r.whole_lines
    while at < r.end:
        chunk = file.read(min(READ, r.stop - place))
        if not chunk:
            return
        place += len(chunk)
        held.append(chunk)
        if b"\n" not in chunk:
            continue
        parts = b"".join(held).split(b"\n")
        held = [parts.pop()]
        values, places = [], []
        for line in parts:
            if skip:
                skip = False
            elif at < r.end:
                values.append(line.decode("utf-8", "replace"))
                places.append(at)
            at += len(line) + 1
        if values:
            yield values, places


class TranscriptReader(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self):
        return self.files.ranges({}, self.files.offset()) or [Ranges([])]

    def read(self, partition):
        return self.files.lines(partition.ranges)


class TranscriptStreamReader(DataSourceStreamReader):
    def __init__(self, files: Files):
        self.files = files

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return self.files.offset()

    def partitions(self, start, end):
        return self.files.ranges(start, end) or [Ranges([])]

    def read(self, partition):
        return self.files.lines(partition.ranges)


class TranscriptSource(DataSource):
    """Format ``transcripts``; options: path, pattern (``*.jsonl``), split (bytes in a task)."""

    @classmethod
    def name(cls):
        return "transcripts"

    def schema(self):
        return SCHEMA

    def _files(self) -> Files:
        if not self.options.get("path"):
            raise ValueError("transcripts need the option path")
        return Files(self.options["path"], self.options.get("pattern", "*.jsonl"), int(self.options.get("split", SPLIT)))

    def reader(self, schema):
        return TranscriptReader(self._files())

    def streamReader(self, schema):
        return TranscriptStreamReader(self._files())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptSource)
