"""Lines of text files with their numbers, read by a data source that cuts the files itself.

Where Spark's own sources begin a new split depends on the cores it has when a scan is planned, so a pass
that counts and a pass that reads may disagree.  Here a file is cut at multiples of a fixed number of
bytes, whatever the cluster: lines are counted per range, and the reading pass numbers them inside its
tasks.  No line is written or moved for its number.

A line belongs to the range that holds its first byte.  Lines of white space only do not count, as in
JSON lines.  Compressed files (gzip, bzip2) are one range each.

This module is pickled by value with the data source, so executors need no copy of the package.
"""

from __future__ import annotations

import bz2
import gzip
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
PACKED = {".gz": gzip.open, ".bz2": bz2.open}


def open_file(uri: str):
    """A binary file for reading: by the local file system, or by one that Arrow knows."""
    scheme, _, path = uri.rpartition(":")
    if scheme in ("", "file"):
        raw = open(path, "rb")
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        raw = system.open_input_file(path)
    unpack = PACKED.get(uri[uri.rfind(".") :])
    return unpack(raw) if unpack else raw


def can_open(uri: str) -> bool:
    """Whether Python reads such files; some stores and codecs only Spark can."""
    try:
        open_file(uri).close()
    except Exception:  # noqa: BLE001  (whatever a file system's library raises)
        return False
    return not re.search(r"\.(zst|lz4|snappy|deflate|lzo)$", uri)


def lines_of_range(uri: str, start: int, end: int | None) -> Iterator[bytes]:
    """The lines whose first byte lies in ``[start, end)``; a carriage return ends a line, too."""
    with open_file(uri) as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        while end is None or at < end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            for part in line.splitlines():
                if part.strip(b" \t\r\n"):
                    yield part


class _Range(InputPartition):
    def __init__(self, file: int, uri: str, start: int, end: int | None):
        super().__init__((file, start))
        self.file, self.uri, self.start, self.end = file, uri, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.size = int(options["range"])
        self.counting = options["counting"] == "true"

    def partitions(self) -> list[_Range]:
        found = []
        for i, (uri, length) in enumerate(self.files):
            if uri[uri.rfind(".") :] in PACKED:
                found.append(_Range(i, uri, 0, None))
            else:
                found += [_Range(i, uri, a, a + self.size) for a in range(0, max(length, 1), self.size)]
        return found

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if self.counting:
            n = sum(1 for _ in lines_of_range(part.uri, part.start, part.end))
            yield self._batch(part, [n], [None])
            return
        first, held, size = 0, [], 0
        for line in lines_of_range(part.uri, part.start, part.end):
            held.append(line.decode("utf-8", "replace"))
            size += len(line)
            if size >= BATCH_BYTES:
                yield self._batch(part, range(first, first + len(held)), held)
                first, held, size = first + len(held), [], 0
        if held:
            yield self._batch(part, range(first, first + len(held)), held)

    def _batch(self, part: _Range, numbers, texts: list) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part.file] * n, pa.int64()),
                pa.array([part.start] * n, pa.int64()),
                pa.array(numbers, pa.int64()),
                pa.array(texts, pa.string()),
            ],
            names=["file", "start", "number", "line"],
        )


class RangedLines(DataSource):
    """``(file, start, number, line)``: number of the file, first byte of the range, number in the range.

    With ``counting`` one row per range, whose ``number`` is that of its lines.
    """

    @classmethod
    def name(cls) -> str:
        return "textmill_lines"

    def schema(self) -> str:
        return "file long, start long, number long, line string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
