"""RIFF/WAVE and AIFF: files to rows of samples, headers and tags, and rows back to files.

A file becomes rows of at most ``chunk`` frames, read in byte ranges (see audio_files). Operators in
chunks work on these; ``whole`` joins a recording's rows for the stages that need all of it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from . import files

# The INFO chunk's ids of the standard tags.
INFO_TAGS = {"title": "INAM", "artist": "IART", "album": "IPRD", "comment": "ICMT", "copyright": "ICOP", "software": "ISFT", "genre": "IGNR", "tracknumber": "ITRK", "date": "ICRD", "license": "ILIC"}
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
CHUNKS = "path string, chunk int, first_frame long, sample_rate int, channels int, samples array<float>"
HEADERS = "path string, bytes long, sample_rate int, channels int, bit_depth int, frames long, duration double, tags map<string,string>, error string"


def riff_chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(id, start, size) of each chunk; a size past the end is cut there."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(data):
        size = min(struct.unpack_from("<I", data, at + 4)[0], len(data) - at - 8)
        yield data[at : at + 4].decode("latin-1"), at + 8, size
        at += 8 + size + size % 2


def _aiff_header(data: bytes) -> dict:
    """Format and place of the samples of an AIFF file of plain PCM."""
    if data[8:12] != b"AIFF":
        raise ValueError("not a plain AIFF file")
    found, at = {"tags": {}, "code": _PCM, "big": True}, 12
    while at + 8 <= len(data):
        size = min(struct.unpack_from(">I", data, at + 4)[0], len(data) - at - 8)
        if data[at : at + 4] == b"COMM":
            found["channels"], _, found["bit_depth"], power, mantissa = struct.unpack_from(">hIhHQ", data, at + 8)
            found["sample_rate"] = round(mantissa * 2.0 ** ((power & 0x7FFF) - 16446))
        elif data[at : at + 4] == b"SSND":
            offset = struct.unpack_from(">I", data, at + 8)[0]
            found["at"], found["size"] = at + 16 + offset, size - 8 - offset
        at += 8 + size + size % 2
    if not {"at", "channels"} <= found.keys() or not found["channels"] or found["bit_depth"] % 8:
        raise ValueError("no usable format and data in the file")
    found["frames"] = found["size"] // (found["channels"] * found["bit_depth"] // 8)
    return found


def header(data: bytes) -> dict:
    """Format, place of the samples and tags."""
    if data[:4] == b"FORM":
        return _aiff_header(data)
    found: dict = {"tags": {}}
    names = {v: k for k, v in INFO_TAGS.items()}
    for kind, at, size in riff_chunks(data):
        if kind == "fmt ":
            code, found["channels"], found["sample_rate"], _, _, found["bit_depth"] = struct.unpack_from("<HHIIHH", data, at)
            found["code"] = struct.unpack_from("<H", data, at + 24)[0] if code == _EXTENSIBLE and size >= 26 else code
        elif kind == "data":
            found["at"], found["size"] = at, size
        elif kind == "LIST" and data[at : at + 4] == b"INFO":
            k = at + 4
            while k + 8 <= at + size:
                n = struct.unpack_from("<I", data, k + 4)[0]
                if (name := names.get(data[k : k + 4].decode("latin-1"))) is not None:
                    found["tags"][name] = data[k + 8 : k + 8 + n].rstrip(b"\0").decode("utf-8", "replace")
                k += 8 + n + n % 2
    if not {"at", "code"} <= found.keys() or not found["channels"] or found["bit_depth"] % 8:
        raise ValueError("no usable format and data in the file")
    found["frames"] = found["size"] // (found["channels"] * found["bit_depth"] // 8)
    return found


def decode(data: bytes, h: dict, first: int = 0, frames: int | None = None) -> np.ndarray:
    """float32 samples [frames, channels] in -1 to 1."""
    width = h["bit_depth"] // 8
    frames = h["frames"] - first if frames is None else min(frames, h["frames"] - first)
    raw = np.frombuffer(data, np.uint8, frames * h["channels"] * width, h["at"] + first * h["channels"] * width)
    if h["code"] == _FLOAT:
        out = raw.view(f"<f{width}").astype(np.float32)
    elif h["code"] == _PCM and width in (1, 2, 3, 4):
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)[:, :: -1 if h.get("big") else 1]
        out = (wide.view("<i4").ravel() / 2.0**31 if width > 1 or h.get("big") else (raw.astype(float) - 128) / 128).astype(np.float32)
    else:
        raise ValueError(f"unsupported format {h['code']} with {h['bit_depth']} bits")
    return out.reshape(-1, h["channels"])


def pcm(samples: np.ndarray, depth: int) -> bytes:
    """Samples as little-endian whole numbers of 16, 24 or 32 bits; halves go to the even number."""
    whole = np.clip(np.rint(np.asarray(samples, float) * 2.0 ** (depth - 1)), -(2.0 ** (depth - 1)), 2.0 ** (depth - 1) - 1).astype("<i4")
    return whole.ravel().view(np.uint8).reshape(-1, 4)[:, : depth // 8].tobytes()


def framed(body: bytes, rate: int, channels: int, depth: int, more: bytes = b"") -> bytes:
    """A WAV file of PCM bytes, with more chunks behind them."""
    width = channels * depth // 8
    inner = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, _PCM, channels, rate, rate * width, width, depth) + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2) + more
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def encode(samples: np.ndarray, rate: int, depth: int = 24, tags: dict[str, str] | None = None, more: bytes = b"") -> bytes:
    """A file of PCM samples [frames] or [frames, channels]; a depth other than 16, 24 and 32 becomes 24. more: see riff.write."""
    depth = depth if depth in (16, 24, 32) else 24
    y = np.atleast_2d(np.asarray(samples, float).T).T
    info = b""
    for name, value in (tags or {}).items():
        if name in INFO_TAGS and value:
            text = value.encode() + b"\0"
            info += INFO_TAGS[name].encode() + struct.pack("<I", len(text)) + text + b"\0" * (len(text) % 2)
    if info:
        more = b"LIST" + struct.pack("<I", len(info) + 4) + b"INFO" + info + more
    return framed(pcm(y, depth), rate, y.shape[1], depth, more)


def _source(spark: SparkSession, kind: str, path: str, **options):
    from . import audio_files

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (audio_files.AudioFiles, audio_files.AudioHeaders):
        spark.dataSource.register(source)
    return spark.read.format(kind).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_headers(spark: SparkSession, path: str, glob: str = "*.{wav,aif,aiff}") -> DataFrame:
    """A row a file, of which only the header is read; one that can't be read has its error and nulls."""
    return _source(spark, "audio_headers", path, glob=glob)


def headers(rows: DataFrame) -> DataFrame:
    """The headers of files (path, content)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("sample_rate", "channels", "bit_depth", "frames")
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("path", "bytes", *names, "duration", "tags", "error")}
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    h, error = header(data), None
                except (ValueError, struct.error) as e:
                    h, error = {"tags": {}}, str(e)
                out["path"].append(p)
                out["bytes"].append(len(data))
                for k in names:
                    out[k].append(h.get(k))
                out["duration"].append(h["frames"] / h["sample_rate"] if h.get("sample_rate") else None)
                out["tags"].append(list(h["tags"].items()))
                out["error"].append(error)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.select("path", "content").mapInArrow(run, HEADERS)


def read_audio(spark: SparkSession, path: str, glob: str = "*.{wav,aif,aiff}", mono: bool = True, chunk: int = 1 << 18, overlap: int = 0, split: int = 64 << 20) -> DataFrame:
    """The chunks of all files below a path; a file is read by a task for each ``split`` bytes of it. See audio_files; chunks.tiles gives them their neighbours' frames."""
    return _source(spark, "audio_files", path, glob=glob, mono=mono, chunk=chunk, overlap=overlap, split=split)


def whole(parts: DataFrame, rate: int | None = None) -> DataFrame:
    """(path, sample_rate, samples): each recording's chunks (without overlap) joined, at another sample rate if given.

    Its samples are one row then, as the stages want it: four bytes for each, 320 MB for half an hour at 44.1 kHz.
    """
    rows = F.sort_array(F.collect_list(F.struct("chunk", "samples")))
    made = parts.groupBy("path").agg(F.max("sample_rate").alias("sample_rate"), F.flatten(F.transform(rows, lambda c: c["samples"])).alias("samples"))
    return made if rate is None else resampled(made, "path", rate)


def resampled(buffers: DataFrame, key: str, rate: int) -> DataFrame:
    """(key, sample_rate, samples) at one sample rate."""
    kind = buffers.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            for i, (a, e, own) in enumerate(zip(offsets[:-1], offsets[1:], b.column(1).to_pylist(), strict=True)):
                y = dsp.resample(values[a:e], own, rate).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([rate], pa.int32()), pa.array([y], pa.list_(pa.float32()))], names=[key, "sample_rate", "samples"])

    return buffers.select(key, F.col("sample_rate").cast("int"), "samples").mapInArrow(run, f"{key} {kind}, sample_rate int, samples array<float>")


def chunks(rows: DataFrame, mono: bool = True, chunk: int = 1 << 18, overlap: int = 0) -> DataFrame:
    """Rows of up to chunk + overlap frames; the overlap repeats the next chunk's first frames.

    mono: the mean of the channels; else samples are interleaved. Unreadable files fail.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = header(data)
                for k in range(max(1, -(-h["frames"] // chunk))):
                    y = decode(data, h, k * chunk, chunk + overlap)
                    y = y.mean(axis=1) if mono else y.ravel()
                    row = [[p], [k], [k * chunk], [h["sample_rate"]], [1 if mono else h["channels"]], [y.astype(np.float32)]]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["path", "chunk", "first_frame", "sample_rate", "channels", "samples"])

    return rows.select("path", "content").mapInArrow(run, CHUNKS)


def to_wav(rows: DataFrame, depth: int = 24, tags: str | None = None) -> DataFrame:
    """(name, wav) from rows of name, sample_rate and samples (mono); tags names a column of standard tags (a map)."""
    about = F.col(tags) if tags else F.lit(None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            each = zip(offsets[:-1], offsets[1:], b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)
            made = [encode(values[a:e], rate, depth, dict(t or [])) for a, e, rate, t in each]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["name", "wav"])

    return rows.select("name", "sample_rate", "samples", about.cast("map<string,string>").alias("tags")).mapInArrow(run, "name string, wav binary")


def joined(parts: DataFrame, key: str, depth: int = 24) -> DataFrame:
    """(key, wav): a mono PCM file of each key's chunks (key, first_frame, sample_rate, samples). Samples become bytes where they lie; a file is one row."""
    kind, depth = parts.schema[key].dataType.simpleString(), depth if depth in (16, 24, 32) else 24

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            made = [pcm(values[a:e], depth) for a, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], names=[key, "first_frame", "sample_rate", "body"])

    def bind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, rate in enumerate(b.column(1).to_pylist()):
                body = b"".join(x["body"] for x in b.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([framed(body, rate, 1, depth)], pa.binary())], names=[key, "wav"])

    pieces = parts.select(key, F.col("first_frame").cast("bigint").alias("first_frame"), F.col("sample_rate").cast("int").alias("sample_rate"), F.col("samples").cast("array<float>").alias("samples"))
    pieces = pieces.mapInArrow(run, f"{key} {kind}, first_frame long, sample_rate int, body binary")
    packed = pieces.groupBy(key).agg(F.max("sample_rate").alias("sample_rate"), F.sort_array(F.collect_list(F.struct("first_frame", "body"))).alias("bodies"))
    return packed.mapInArrow(bind, f"{key} {kind}, wav binary")


def export(rows: DataFrame, folder: str) -> int:
    """Write (name, wav) rows as name.wav below a folder that all executors share, see files.write; how many were written. Folders in names are kept; two rows of one name are an error."""
    return files.write(rows.select(F.concat("name", F.lit(".wav")).alias("name"), F.col("wav").alias("body")), folder)


def sine(seconds: float, hz: Column, rate: int = 44_100, level: float = 0.5) -> Column:
    """Samples of a sine tone."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1)), lambda i: F.sin(i * hz * (2 * np.pi / rate)) * level)


def drum_hit(seconds: float, hz: Column, rate: int = 44_100, decay: float = 20.0) -> Column:
    """A tone that dies away."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1)), lambda i: F.sin(i * hz * (2 * np.pi / rate)) * F.exp(i * F.lit(-decay / rate)))


def beat_loop(bpm: float, beats: int = 16, rate: int = 44_100) -> Column:
    """So many beats of drum hits, the first of each bar lower."""
    step = int(60 / bpm * rate)
    hz = lambda i: F.when((i / step).cast("int") % 4 == 0, 60.0).otherwise(180.0)
    return F.transform(F.sequence(F.lit(0), F.lit(step * beats - 1)), lambda i: F.sin(i % step * hz(i) * (2 * np.pi / rate)) * F.exp(i % step * F.lit(-20.0 / rate)))
