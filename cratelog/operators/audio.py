"""Features of audio buffers by numeric kernels, and the decisions made from them in SQL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, signal
from ..functions.arithmetic import fix_tempo
from ..functions.text import note_name

FEATURES = "centroid double, flatness double, tempo double, chroma array<double>, onsets array<double>, spectrum array<double>, stability double"


def sample_arrays(column: pa.Array) -> list[np.ndarray]:
    """Each row's samples, without a Python number for each of them; null is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:e] if ok else values[:0] for a, e, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist(), strict=True)]


#: Rows whose features a task holds at a time.
_ROWS = 256


def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of them is not held for thousands of rows."""
    for b in batches:
        for k in range(0, b.num_rows, _ROWS):
            yield b.slice(k, _ROWS)


def features(buffers: DataFrame, key: str = "id", p: dsp.OnsetParams = dsp.OnsetParams()) -> DataFrame:
    """(key and features) of rows of key, sample_rate and samples. One map-only stage over whole recordings; see chunks for long ones."""
    kind = buffers.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out: list[list] = [[] for _ in range(7)]
            for rate, y in zip(b.column(1).to_pylist(), sample_arrays(b.column(2)), strict=True):
                x = dsp.onset_envelope(y, rate)
                row = (*dsp.shape(y, rate), dsp.tempo(y, rate, envelope=x), dsp.chroma(y, rate), dsp.onsets(y, rate, p, envelope=x if p == dsp.OnsetParams() else None), dsp.mean_spectrum(y), dsp.spectral_change(y, rate))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.float64(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=[b.schema.names[0], "centroid", "flatness", "tempo", "chroma", "onsets", "spectrum", "stability"])

    return buffers.select(key, "sample_rate", "samples").mapInArrow(run, f"{key} {kind}, {FEATURES}")


def key_name(chroma: Column) -> Column:
    """Tonic by the strongest pitch class (first if equal), with m if the minor third outweighs the major; '' if silent."""
    top = F.array_max(chroma)
    tonic = (F.array_position(chroma, top) - 1).cast("int")
    third = lambda n: F.get(chroma, (tonic + n) % 12)
    return F.when(F.coalesce(top, F.lit(0.0)) <= 0, "").otherwise(F.concat(note_name(tonic), F.when(third(4) > third(3), "").otherwise("m")))


def described(made: DataFrame) -> DataFrame:
    """Features with the octave-corrected tempo (120 if none was found) and the key."""
    return made.withColumn("bpm", F.when(F.col("tempo") > 0, fix_tempo(F.col("tempo"))).otherwise(120.0)).withColumn("key", key_name(F.col("chroma")))


def onset_rows(made: DataFrame, key: str = "id") -> DataFrame:
    """(key, onset, t), one row an onset."""
    return made.select(key, F.posexplode("onsets").alias("onset", "t"))


def beat_times(buffers: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, sample_rate, duration, bpm, beats) of rows of key, sample_rate and samples. One map-only stage.

    A tempo that can't be told is taken as 120, the rest within an octave of 40 to 200.
    """
    kind = buffers.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (rate, y) in enumerate(zip(b.column(1).to_pylist(), sample_arrays(b.column(2)), strict=True)):
                x = dsp.onset_envelope(y, rate) if rate else np.zeros(0)
                bpm = dsp.octave(dsp.tempo(y, rate, envelope=x)) if rate else 120.0
                found = dsp.beats(y, rate, bpm, envelope=x) if rate else np.zeros(0)
                row = [pa.array([rate], pa.int32()), pa.array([len(y) / rate if rate else 0.0]), pa.array([bpm]), pa.array([found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *row], names=[b.schema.names[0], "sample_rate", "duration", "bpm", "beats"])

    return buffers.select(key, F.col("sample_rate").cast("int"), "samples").mapInArrow(run, f"{key} {kind}, sample_rate int, duration double, bpm double, beats array<double>")


def segment_features(cuts: DataFrame, *keys: str) -> DataFrame:
    """keys and (centroid, flatness, rms, peak) of rows of keys, sample_rate and samples; zeros for empty ones."""
    kinds = ", ".join(f"{k} {cuts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            made = [dsp.shape(y, rate) for rate, y in zip(b.column(len(keys)).to_pylist(), sample_arrays(b.column(len(keys) + 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[k] for m in made], pa.float64()) for k in (0, 1))], names=[*b.schema.names, "centroid", "flatness"])

    samples = cuts.schema["samples"].dataType.simpleString()
    made = cuts.select(*keys, F.col("sample_rate").cast("int"), "samples").mapInArrow(run, f"{kinds}, sample_rate int, samples {samples}, centroid double, flatness double")
    level = lambda f: F.when(F.size("samples") > 0, f(F.col("samples"))).otherwise(0.0)
    return made.select(*keys, "centroid", "flatness", level(signal.rms).alias("rms"), level(signal.peak).alias("peak"))


def crossings(rows: DataFrame, at: str, reach: int = 1024) -> DataFrame:
    """rows (with samples) with ``quiet``, the nearest zero crossing on its quieter side (else the quietest sample), and ``after``, the first sample after the nearest (else ``at``)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = b.column(b.schema.get_field_index(at)).to_pylist()
            ys = sample_arrays(b.column(b.schema.get_field_index("samples")))
            pairs = [(dsp.snap_to_crossing(y, a, reach), dsp.crossing_near(y, a, reach)) for y, a in zip(ys, where, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))], names=[*b.schema.names, "quiet", "after"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, quiet long, after long")


def gated(buffers: DataFrame, amount: float = 1.0, threshold_db: float = -60.0, auto_threshold: bool = True) -> DataFrame:
    """buffers with samples under the threshold turned down; auto raises it to 6 dB over the first 50 ms."""
    y = F.col("samples")
    at = signal.gate_threshold(y, F.col("sample_rate"), least=threshold_db) if auto_threshold else F.lit(threshold_db)
    return buffers.withColumn("samples", F.when(F.size(y) > 0, signal.noise_gate(y, at, amount)).otherwise(y))


def record(files: DataFrame, made: DataFrame, found: DataFrame, key: str = "recording_id", loop_from: float = 0.7) -> DataFrame:
    """All that is known of each file: length, format, tempo, key, levels, loops, onsets.

    files: key, sample_rate, channels, bit_depth, samples; made: ``described`` features; found: the
    loops of loops.search. is_loop if the best of them is surer than ``loop_from``.
    """
    fields = ("rank", "loop_start", "loop_end", "confidence", "start_time", "end_time", "bars", "bpm")
    some = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("loop_candidates"))
    y = F.col("samples")
    measured = files.select(key, (F.size(y) / F.col("sample_rate")).alias("duration"), "sample_rate", "channels", "bit_depth", signal.loudness(y).alias("loudness"), signal.dynamic_range(y).alias("dynamic_range"))
    joined = measured.join(made.select(key, "bpm", "key", F.col("onsets").alias("transient_positions")), key, "left").join(some, key, "left")
    best = F.get("loop_candidates", F.lit(0))
    return joined.withColumns({"loop_points": best, "is_loop": F.coalesce(best["confidence"] > loop_from, F.lit(False))})
