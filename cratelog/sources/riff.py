"""What a WAV file says beside its samples: cue points, their labels, notes and regions, sampler and instrument settings.

Chunks refer to each other by the cue points' numbers; a marker here is a cue point with all that refers to it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "struct<id long, at long, label string, note string, length long, purpose string, text string>"
SAMPLER = "struct<unity_note int, pitch_fraction long, period_ns long, loops array<struct<id long, type int, start long, end long, fraction long, count long>>>"
INSTRUMENT = "struct<unshifted_note int, fine_tune int, gain int, low_note int, high_note int, low_velocity int, high_velocity int>"
MARKS = f"markers array<{MARKER}>, sampler {SAMPLER}, instrument {INSTRUMENT}"
_MARKER, _LOOP = ("id", "at", "label", "note", "length", "purpose", "text"), ("id", "type", "start", "end", "fraction", "count")
_INSTRUMENT = ("unshifted_note", "fine_tune", "gain", "low_note", "high_note", "low_velocity", "high_velocity")


def walk(data: bytes, at: int, end: int) -> Iterator[tuple[str, bytes]]:
    """(id, body) of each chunk between two places; a size past the end is cut there."""
    while at + 8 <= end:
        size = min(struct.unpack_from("<I", data, at + 4)[0], end - at - 8)
        yield data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _text(body: bytes) -> str:
    return body.rstrip(b"\0").decode("utf-8", "replace")


def marks(chunks: Iterable[tuple[str, bytes]]) -> dict:
    """markers in the order of their places, sampler and instrument (None if there is none) of a file's chunks."""
    found: dict[int, dict] = {}
    out: dict = {"sampler": None, "instrument": None}
    own = lambda n: found.setdefault(n, {"id": n, "at": None, "label": None, "note": None, "length": None, "purpose": None, "text": None})
    for kind, body in chunks:
        if kind == "cue " and len(body) >= 4:
            for k in range(min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 24)):
                n, *_, at = struct.unpack_from("<II4sIII", body, 4 + 24 * k)
                own(n)["at"] = at
        elif kind == "LIST" and body[:4] == b"adtl":
            for part, inner in walk(body, 4, len(body)):
                if part in ("labl", "note") and len(inner) >= 4:
                    own(struct.unpack_from("<I", inner)[0])["label" if part == "labl" else "note"] = _text(inner[4:])
                elif part == "ltxt" and len(inner) >= 20:
                    n, length, purpose = struct.unpack_from("<II4s", inner)
                    own(n).update(length=length, purpose=purpose.decode("latin-1").rstrip("\0 "), text=_text(inner[20:]))
        elif kind == "smpl" and len(body) >= 36:
            _, _, period, note, fraction, _, _, count, _ = struct.unpack_from("<9I", body)
            loops = [dict(zip(_LOOP, struct.unpack_from("<6I", body, 36 + 24 * k), strict=True)) for k in range(min(count, (len(body) - 36) // 24))]
            out["sampler"] = {"unity_note": note, "pitch_fraction": fraction, "period_ns": period, "loops": loops}
        elif kind == "inst" and len(body) >= 7:
            out["instrument"] = dict(zip(_INSTRUMENT, struct.unpack_from("<BbbBBBB", body), strict=True))
    out["markers"] = sorted((m for m in found.values() if m["at"] is not None), key=lambda m: (m["at"], m["id"]))
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write(markers: Iterable[Mapping] = (), sampler: Mapping | None = None, instrument: Mapping | None = None) -> bytes:
    """The chunks that say this, to be put behind a file's samples (see wav.framed)."""
    markers, out, notes = list(markers), b"", b""
    if markers:
        out += _chunk(b"cue ", struct.pack("<I", len(markers)) + b"".join(struct.pack("<II4sIII", m["id"], m["at"], b"data", 0, 0, m["at"]) for m in markers))
    for m in markers:
        for kind, text in ((b"labl", m.get("label")), (b"note", m.get("note"))):
            if text is not None:
                notes += _chunk(kind, struct.pack("<I", m["id"]) + text.encode() + b"\0")
        if m.get("length") is not None:
            text = m.get("text")
            notes += _chunk(b"ltxt", struct.pack("<II4sHHHH", m["id"], m["length"], (m.get("purpose") or "rgn ").encode()[:4].ljust(4), 0, 0, 0, 0) + (text.encode() + b"\0" if text else b""))
    if notes:
        out += _chunk(b"LIST", b"adtl" + notes)
    if sampler:
        loops = list(sampler.get("loops") or ())
        head = struct.pack("<9I", 0, 0, sampler.get("period_ns") or 0, sampler["unity_note"], sampler.get("pitch_fraction") or 0, 0, 0, len(loops), 0)
        out += _chunk(b"smpl", head + b"".join(struct.pack("<6I", *(x.get(c) or 0 for c in _LOOP)) for x in loops))
    if instrument:
        out += _chunk(b"inst", struct.pack("<BbbBBBB", *(instrument[c] for c in _INSTRUMENT)))
    return out


def marked(rows: DataFrame) -> DataFrame:
    """(path, markers, sampler, instrument, labels) of WAV files (path, content); none of it for what is no WAV file. labels: those of the markers, in their order."""
    kinds = pa.schema([("m", pa.list_(pa.struct([("id", pa.int64()), ("at", pa.int64()), ("label", pa.string()), ("note", pa.string()), ("length", pa.int64()), ("purpose", pa.string()), ("text", pa.string())])))]).types[0]
    loop = pa.struct([("id", pa.int64()), ("type", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("fraction", pa.int64()), ("count", pa.int64())])
    sampler = pa.struct([("unity_note", pa.int32()), ("pitch_fraction", pa.int64()), ("period_ns", pa.int64()), ("loops", pa.list_(loop))])
    instrument = pa.struct([(c, pa.int32()) for c in _INSTRUMENT])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [marks(walk(d, 12, len(d)) if d is not None and d[:4] == b"RIFF" else ()) for d in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[c] for m in made], t) for c, t in (("markers", kinds), ("sampler", sampler), ("instrument", instrument)))], names=["path", "markers", "sampler", "instrument"])

    out = rows.select("path", "content").mapInArrow(run, f"path string, {MARKS}")
    return out.withColumn("labels", F.filter(F.transform("markers", lambda m: m["label"]), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
