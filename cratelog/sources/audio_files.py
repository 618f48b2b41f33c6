"""Audio files as a data source of byte ranges.

A file is split by its size alone, before anything of it is read. A task reads the file's header, some kilobytes, seeks to the
chunks whose first bytes lie in its range, and reads no others; so one file is read by several tasks, and
none holds more than a chunk. Many small ranges are dealt to few tasks, neighbours to different ones, so there are as many tasks as
the bytes ask for, not as there are files. Filters on path and first_frame are applied before samples are read.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import files, riff, wav

#: Bytes of a file that one task reads, unless option ``split`` says otherwise.
SPLIT = 64 << 20
#: Tasks among which ranges are dealt if there are more of them; more tasks only if each would get over SPLIT bytes.
TASKS = 256
#: Chunks other than the samples are read if they are no larger.
_SMALL = 1 << 20
#: Headers in a batch.
_ROWS = 1024


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What one task reads, range by range."""

    ranges: list[Range]


def dealt(ranges: list[Range], most: int) -> list[InputPartition]:
    """Ranges as they are if there are at most so many, else in turn to that many tasks."""
    return list(ranges) if len(ranges) <= most else [Ranges(ranges[k::most]) for k in range(most)]


def read_header(f, size: int) -> dict:
    """As wav.header, from a seekable file, reading chunk heads and small chunks only; also ``chunks``, the bodies read."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"FORM") or len(head) < 12:
        raise ValueError("not a RIFF/WAVE file")
    order, data = ("<", b"data") if head[:4] == b"RIFF" else (">", b"SSND")
    kept, at, place = head, 12, None
    while at + 8 <= size:
        f.seek(at)
        name = f.read(8)
        own = min(struct.unpack(f"{order}I", name[4:])[0], size - at - 8)
        if name[:4] == data:
            lead = f.read(8) if data == b"SSND" else b""
            skip = 8 + struct.unpack(">I", lead[:4])[0] if lead else 0
            place = at + 8 + skip, own - skip
            kept += name[:4] + struct.pack(f"{order}I", len(lead)) + lead
        elif own <= _SMALL:
            body = f.read(own)
            kept += name + body + b"\0" * (own % 2)
        at += 8 + own + own % 2
    if place is None:
        raise ValueError("no usable format and data in the file")
    found = wav.header(kept)
    found["at"], found["size"] = place
    found["frames"] = found["size"] // (found["channels"] * found["bit_depth"] // 8)
    found["chunks"] = list(riff.walk(kept, 12, len(kept))) if order == "<" else []
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict, headers: bool):
        self.path, self.glob, self.headers = options["path"], options.get("glob", "*.{wav,aif,aiff}"), headers
        self.chunk, self.overlap, self.split = int(options.get("chunk", 1 << 18)), int(options.get("overlap", 0)), int(options.get("split", SPLIT))
        self.mono = str(options.get("mono", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if type(f) in kinds else None
            if name == "path" and type(f) in (EqualTo, In) or name == "first_frame" and not self.headers and type(f) is not In:
                self.tests.append((name, kinds[type(f)], f.value))
            else:
                yield f

    def _passes(self, name: str, value) -> bool:
        by = {"==": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(by[sign](value, want) for n, sign, want in self.tests if n == name)

    def partitions(self) -> list[InputPartition]:
        system, root = files.filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        start, _, rest = self.glob.partition("{")
        inner, _, tail = rest.partition("}")
        patterns = [start + x + tail for x in inner.split(",")] if rest else [self.glob]
        out: list[Range] = []
        for i in sorted(found, key=lambda i: i.path):
            if i.type == fs.FileType.File and any(fnmatch.fnmatch(i.base_name, p) for p in patterns) and self._passes("path", i.path):
                step = i.size if self.headers else self.split
                out += [Range(i.path, i.size, a, min(a + step, i.size)) for a in range(0, max(i.size, 1), max(step, 1))]
        return dealt(out, max(TASKS, 0 if self.headers else -(-sum(r.last - r.first for r in out) // SPLIT)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = files.filesystem(self.path)
        ranges = partition.ranges if isinstance(partition, Ranges) else [partition]
        if self.headers:
            for k in range(0, len(ranges), _ROWS):
                yield self._headers(system, ranges[k : k + _ROWS])
            return
        for r in ranges:
            yield from self._chunks(system, r)

    def _chunks(self, system: fs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(partition.path) as f:
            h = read_header(f, partition.size)
            width = h["channels"] * h["bit_depth"] // 8
            whole = max(1, -(-h["frames"] // self.chunk))
            step = self.chunk * width
            # the chunks whose first byte lies in the range; the first range also has those before it
            k0 = 0 if partition.first == 0 else max(0, -(-(partition.first - h["at"]) // step))
            k1 = min(whole, max(0, -(-(partition.last - h["at"]) // step))) if partition.last < partition.size else whole
            for k in range(k0, k1):
                first = k * self.chunk
                if not self._passes("first_frame", first):
                    continue
                n = min(self.chunk + self.overlap, h["frames"] - first)
                f.seek(h["at"] + first * width)
                y = wav.decode(f.read(n * width), h | {"at": 0, "frames": n})
                y = y.mean(axis=1) if self.mono else y.ravel()
                row = [[partition.path], [k], [first], [h["sample_rate"]], [1 if self.mono else h["channels"]], [y.astype(np.float32)]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["path", "chunk", "first_frame", "sample_rate", "channels", "samples"])

    def _headers(self, system: fs.FileSystem, ranges: list[Range]) -> pa.RecordBatch:
        rows = []
        for r in ranges:
            try:
                with system.open_input_file(r.path) as f:
                    h, error = read_header(f, r.size), None
            except (ValueError, struct.error) as e:
                h, error = {"tags": {}}, str(e)
            length = h["frames"] / h["sample_rate"] if h.get("sample_rate") else None
            rows.append([r.path, r.size, *(h.get(c) for c in ("sample_rate", "channels", "bit_depth", "frames")), length, list(h["tags"].items()), error])
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in wav.HEADERS.replace("map<string,string>", "map").split(", ")])


class AudioFiles(DataSource):
    """Format ``audio_files``: rows of chunks. Options: path, glob, chunk (frames), overlap (frames of the next chunk that are read too), split (bytes), mono."""

    @classmethod
    def name(cls) -> str:
        return "audio_files"

    def schema(self) -> str:
        return wav.CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)


class AudioHeaders(DataSource):
    """Format ``audio_headers``: a row a file; one that can't be read has its error and nulls. Options: path, glob."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return wav.HEADERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)
