"""Kernels over chunks of recordings: no row holds more than a chunk and its surroundings.

A recording is rows of its keys, first_frame, sample_rate and samples, cut anywhere. ``tiles`` deals them
anew on a fixed grid, each tile with as many frames of its neighbours as a kernel looks at; what a
tile yields is a partial sum, a stretch of a slower signal, or events, and those are merged by key.
A recording without samples has no tiles and so no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dsp, filters
from .audio import few, sample_arrays

#: Frames of a tile; a multiple of all hops.
TILE = 1 << 18
_KINDS = {"binary": pa.binary(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64())}


def mapped(rows: DataFrame, made: dict[str, str], f: Callable[..., tuple], *inputs: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows without ``drop``, with the columns ``made`` (name to SQL type) of f(*inputs), row by row. Arrays of numbers come as numpy arrays. Map-only."""
    keep = [c for c in rows.columns if c not in (*drop, *made)]
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            columns = [b.column(b.schema.get_field_index(c)) for c in inputs]
            number = lambda c: pa.types.is_list(c.type) and (pa.types.is_floating(c.type.value_type) or pa.types.is_integer(c.type.value_type))
            values = [sample_arrays(c) if number(c) else c.to_pylist() for c in columns]
            each = [f(*v) for v in zip(*values, strict=True)]
            new = [pa.array([e[k] for e in each], _KINDS[t]) for k, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *made])

    return rows.mapInArrow(run, schema)


def tiles(rows: DataFrame, *keys: str, size: int = TILE, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, tile, sample_rate, n_frames, first, samples): frames ``tile * size - before`` to ``(tile + 1) * size + after`` as far as there are any, from frame ``first`` on.

    n_frames is the recording's length. One shuffle; the parts that neighbours share are sent to both.
    """
    n = F.size("samples")
    of = rows.where(n > 0).withColumn("tile", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("first_frame") - after) / size)), F.floor((F.col("first_frame") + n - 1 + before) / size))))
    lo = F.greatest(F.col("first_frame"), F.col("tile") * size - before)
    hi = F.least(F.col("first_frame") + n, (F.col("tile") + 1) * size + after)
    piece = of.select(*keys, "tile", "sample_rate", lo.alias("lo"), F.slice("samples", (lo - F.col("first_frame") + 1).cast("int"), (hi - lo).cast("int")).alias("piece")).where(F.size("piece") > 0)
    whole = piece.groupBy(*keys, "tile").agg(F.max("sample_rate").alias("sample_rate"), F.sort_array(F.collect_list(F.struct("lo", "piece"))).alias("parts"))
    length = rows.where(n > 0).groupBy(*keys).agg(F.max(F.col("first_frame") + n).alias("n_frames"))
    out = whole.join(length, list(keys)).where(F.col("tile") * size <= F.col("n_frames"))
    return out.select(*keys, "tile", "sample_rate", "n_frames", F.get("parts", F.lit(0))["lo"].alias("first"), F.flatten(F.transform("parts", lambda p: p["piece"])).alias("samples"))


def as_chunks(rows: DataFrame) -> DataFrame:
    """rows of whole recordings as chunks of their own."""
    return rows if "first_frame" in rows.columns else rows.withColumn("first_frame", F.lit(0).cast("bigint"))


def cut(spans: DataFrame, rows: DataFrame, *keys: str, size: int = TILE) -> DataFrame:
    """spans (keys, first_sample, last_sample and more) with sample_rate and samples of what they hold of a recording; spans without a frame in it are left out.

    A span meets the tiles that it touches, so a row is never more than a tile or a span.
    """
    bounds = [*keys, "first_sample", "last_sample"]
    asked = spans.where("last_sample > first_sample").select(*bounds).distinct()
    touched = asked.withColumn("tile", F.explode(F.sequence(F.floor(F.greatest("first_sample", F.lit(0)) / size), F.floor((F.col("last_sample") - 1) / size))))
    met = tiles(rows, *keys, size=size).join(touched, [*keys, "tile"])
    lo, hi = F.greatest("first_sample", "first"), F.least(F.col("last_sample"), F.col("first") + F.size("samples"))
    piece = met.where(hi > lo).select(*bounds, "sample_rate", lo.alias("lo"), F.slice("samples", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    whole = piece.groupBy(*bounds).agg(F.max("sample_rate").alias("sample_rate"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"])).alias("samples"))
    return spans.join(whole, bounds)


def equalized(rows: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """rows with filtered samples (array<float>). plan: keys, filter, hz, gain_db (see spectral.eq_plan); recordings without a plan stay as they are.

    Each chunk tells what it makes of a filter at rest; from those states, one small row a chunk, follows the
    state with which each chunk begins. Chunks may have any sizes, but no gaps.
    """
    steps = plan.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("filter", "hz", "gain_db"))).alias("steps"))
    own = rows.join(steps, list(keys), "left")

    def run_of(steps, rate) -> filters.Cascade:
        return filters.cascade(filters.sections([tuple(s.values()) for s in steps], rate))

    def left(samples, rate, steps) -> tuple:
        return len(samples), run_of(steps, rate).filtered(samples)[1]

    some = own.where("steps IS NOT NULL").select(*keys, "first_frame", "sample_rate", "samples", "steps")
    moved = mapped(some, {"n": "bigint", "moved": "array<double>"}, left, "samples", "sample_rate", "steps", drop=("samples", "steps"))
    chain = moved.groupBy(*keys).agg(F.max("sample_rate").alias("sample_rate"), F.sort_array(F.collect_list(F.struct("first_frame", "n", "moved"))).alias("chain")).join(steps, list(keys))

    def starts(chain, rate, steps) -> tuple:
        """The state before each chunk, one after another."""
        c = run_of(steps, rate)
        state, out, powers = np.zeros(c.order), [], {}
        for x in chain:
            out.append(state)
            if x["n"] not in powers:
                powers[x["n"]] = c.power(x["n"])
            state = powers[x["n"]] @ state + np.array(x["moved"])
        return [x["first_frame"] for x in chain], np.concatenate([*out, np.zeros(0)])

    begun = mapped(chain, {"at": "array<bigint>", "states": "array<double>"}, starts, "chain", "sample_rate", "steps", drop=("chain", "sample_rate", "steps"))
    width = (F.size("states") / F.size("at")).cast("int")
    begun = begun.select(*keys, F.posexplode("at").alias("k", "first_frame"), "states", width.alias("width")).select(*keys, "first_frame", F.slice("states", F.col("k") * F.col("width") + 1, F.col("width")).alias("state"))

    def played(samples, rate, steps, state) -> tuple:
        return ((samples if steps is None else run_of(steps, rate).filtered(samples, state)[0]).astype(np.float32),)

    joined = own.join(begun, [*keys, "first_frame"], "left")
    return mapped(joined, {"samples": "array<float>"}, played, "samples", "sample_rate", "steps", "state", drop=("steps", "state")).select(*rows.columns)


def _windows(samples: np.ndarray, first: int, t0: int, t1: int, hop: int, n_fft: int) -> np.ndarray:
    """What the centred windows of frames t0 to t1 look at; zeros beyond the ends."""
    start, stop = t0 * hop - n_fft // 2, (t1 - 1) * hop + n_fft - n_fft // 2
    lead = max(0, first - start)
    part = samples[max(0, start - first) : max(0, stop - first)]
    return np.pad(part, (lead, max(0, stop - start - lead - len(part))))


def _own(tile: int, size: int, n_frames: int, hop: int) -> tuple[int, int]:
    """The frames of the centred transform whose centre is in a tile; the last may be centred on the recording's end."""
    return -(-tile * size // hop), min(-(-(tile + 1) * size // hop), n_frames // hop + 1)


def spectral_features(rows: DataFrame, *keys: str, size: int = TILE, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(keys, centroid, flatness, spectrum, n_frames): of each recording, as dsp.shape and dsp.mean_spectrum tell of a whole buffer."""

    def sums(samples, rate, tile, first, n_frames) -> tuple:
        t0, t1 = _own(tile, size, n_frames, hop)
        if t1 <= t0:
            return np.zeros(n_fft // 2 + 1), 0, 0.0, 0.0, False
        f, total, centroid, flat, loud = np.fft.rfftfreq(n_fft, 1 / rate), 0.0, 0.0, 0.0, False
        for s in dsp.spectra(_windows(samples, first, t0, t1, hop, n_fft), n_fft, hop, centred=False):
            power, loud = np.maximum(s**2, 1e-10), loud or bool(s.any())
            total = total + s.sum(axis=1)
            centroid += float((f @ s / np.maximum(s.sum(axis=0), 1e-10)).sum())
            flat += float((np.exp(np.log(power).mean(axis=0)) / power.mean(axis=0)).sum())
        return total, t1 - t0, centroid, flat, loud

    parts = mapped(
        tiles(rows, *keys, size=size, before=n_fft // 2, after=n_fft // 2), {"bins": "array<double>", "n": "bigint", "c": "double", "f": "double", "loud": "boolean"}, sums,
        "samples", "sample_rate", "tile", "first", "n_frames", drop=("samples", "first", "sample_rate", "tile"),
    )
    bins = parts.select(*keys, "n", F.posexplode("bins").alias("bin", "v")).groupBy(*keys, "bin").agg((F.sum("v") / F.sum("n")).alias("v"))
    spectrum = bins.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda x: x["v"]).alias("spectrum"))
    mean = lambda c: F.when(F.bool_or("loud"), F.sum(c) / F.sum("n")).otherwise(0.0)
    return parts.groupBy(*keys).agg(mean("c").alias("centroid"), mean("f").alias("flatness"), F.max("n_frames").alias("n_frames")).join(spectrum, list(keys)).select(*keys, "centroid", "flatness", "spectrum", "n_frames")


def chroma(rows: DataFrame, *keys: str, size: int = TILE, highest: int = 96_000) -> DataFrame:
    """(keys, chroma): of each recording, as dsp.chroma tells of a whole buffer; sample rates up to ``highest``."""
    halo = dsp.chroma_reach(highest)

    def sums(samples, rate, tile, first, n_frames) -> tuple:
        t0, t1 = _own(tile, size, n_frames, dsp.CQT_HOP)
        return (dsp.chroma_sums(samples, rate, t0, t1, first),)

    parts = mapped(tiles(rows, *keys, size=size, before=halo, after=halo), {"chroma": "array<double>"}, sums, "samples", "sample_rate", "tile", "first", "n_frames", drop=("samples", "tile", "first", "sample_rate"))
    each = parts.select(*keys, "n_frames", F.posexplode("chroma").alias("k", "v")).groupBy(*keys, "n_frames", "k").agg(F.sum("v").alias("v"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"] / (F.floor(F.col("n_frames") / dsp.CQT_HOP) + 1))
    return each.groupBy(*keys, "n_frames").agg(mean.alias("chroma")).select(*keys, "chroma")


def envelope(rows: DataFrame, *keys: str, size: int = TILE, p: dsp.OnsetParams = dsp.OnsetParams()) -> DataFrame:
    """The onset envelope as a signal of its own: keys, first_frame (in hops), sample_rate (the audio's), samples; at most 1."""
    step = -(-size // p.hop) * p.hop

    def flux(samples, rate, tile, first, n_frames) -> tuple:
        t0, t1 = _own(tile, step, n_frames, p.hop)
        lead = min(t0, 1)
        return t0, dsp.flux(_windows(samples, first, t0 - lead, t1, p.hop, p.n_fft), rate, p, centred=False)[lead:] if t1 > t0 else np.zeros(0)

    halo = p.n_fft // 2 + p.hop
    made = mapped(tiles(rows, *keys, size=step, before=halo, after=halo), {"first_frame": "bigint", "samples": "array<double>"}, flux, "samples", "sample_rate", "tile", "first", "n_frames", drop=("tile", "first", "n_frames"))
    made = made.where(F.size("samples") > 0)
    top = made.groupBy(*keys).agg(F.max(F.array_max("samples")).alias("top"))
    return made.join(top, list(keys)).select(*keys, "first_frame", "sample_rate", F.when(F.col("top") > 0, F.transform("samples", lambda v: v / F.col("top"))).otherwise(F.col("samples")).alias("samples"))


def onsets(rows: DataFrame, *keys: str, size: int = TILE, p: dsp.OnsetParams = dsp.OnsetParams()) -> DataFrame:
    """(keys, t): onset times in seconds, as dsp.onsets tells of a whole buffer. rows are read twice."""
    curve = envelope(rows, *keys, size=size, p=p)
    around = max(p.pre_max, p.post_max, p.pre_avg, p.post_avg, 1)
    span = max(size // p.hop, around)

    def events(x, tile, first, n_frames) -> tuple:
        """Peaks and low points of the tile's own frames."""
        a, e = tile * span - first, min((tile + 1) * span, n_frames) - first
        peaks, lows = (found[(found >= a) & (found < e)] for found in (dsp.peak_candidates(x, p), dsp.low_points(x)))
        return peaks + first, lows + first

    cut = tiles(curve, *keys, size=span, before=around, after=around)
    told = mapped(cut, {"peaks": "array<bigint>", "lows": "array<bigint>"}, events, "samples", "tile", "first", "n_frames", drop=("samples", "tile", "first", "n_frames"))
    peaks = told.groupBy(*keys).agg(F.max("sample_rate").alias("sample_rate"), F.array_sort(F.flatten(F.collect_list("peaks"))).alias("peaks"))
    peaks = mapped(peaks, {"kept": "array<bigint>"}, lambda x: (dsp.kept_apart(x, p.wait),), "peaks", drop=("peaks",)).select(*keys, "sample_rate", F.explode("kept").alias("frame"))
    if p.backtrack:
        if p.energy == "rms":
            level = _levels(rows, keys, size, p)
            lows = mapped(tiles(level, *keys, size=span, before=1, after=1), {"lows": "array<bigint>"}, lambda x, tile, first, n: (events(x, tile, first, n)[1],), "samples", "tile", "first", "n_frames", drop=("samples", "tile", "first", "n_frames"))
        else:
            lows = told
        low = lows.select(*keys, F.explode("lows").alias("frame")).select(*keys, "frame", F.lit(0).alias("kind"), F.col("frame").alias("low"), F.lit(None).cast("int").alias("sample_rate"))
        both = low.unionByName(peaks.select(*keys, "frame", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("low"), "sample_rate"))
        before = F.last("low", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0))
        peaks = both.withColumn("low", F.coalesce(before, F.lit(0))).where("kind = 1").select(*keys, "sample_rate", F.col("low").alias("frame"))
    at = peaks.select(*keys, "sample_rate", (F.col("frame") * p.hop).alias("at")).distinct()
    reach = 1024 if p.snap else 0
    near = tiles(rows, *keys, size=size, before=reach, after=reach)
    asked = at.groupBy(*keys, F.floor(F.col("at") / size).alias("tile")).agg(F.collect_list("at").alias("ats"))
    found = near.join(asked, [*keys, "tile"])

    def snapped(samples, first, n_frames, ats) -> tuple:
        inside = [int(a) for a in ats if a < n_frames]
        return ([first + dsp.snap_to_crossing(samples, a - first) for a in inside] if p.snap else inside,)

    out = mapped(found, {"at": "array<bigint>"}, snapped, "samples", "first", "n_frames", "ats", drop=("samples", "first", "n_frames", "ats", "tile"))
    return out.select(*keys, "sample_rate", F.explode("at").alias("at")).distinct().select(*keys, (F.col("at") / F.col("sample_rate")).alias("t"))


def _levels(rows: DataFrame, keys: tuple[str, ...], size: int, p: dsp.OnsetParams) -> DataFrame:
    """The root mean square of each frame's window, as a signal."""
    step = -(-size // p.hop) * p.hop

    def level(samples, tile, first, n_frames) -> tuple:
        t0, t1 = _own(tile, step, n_frames, p.hop)
        return t0, dsp.frame_levels(_windows(samples, first, t0, t1, p.hop, p.n_fft), p, centred=False) if t1 > t0 else np.zeros(0)

    made = mapped(tiles(rows, *keys, size=step, before=p.n_fft // 2, after=p.n_fft // 2), {"first_frame": "bigint", "samples": "array<double>"}, level, "samples", "tile", "first", "n_frames", drop=("tile", "first", "n_frames"))
    return made.where(F.size("samples") > 0)


def tempo(rows: DataFrame, *keys: str, size: int = TILE) -> DataFrame:
    """(keys, tempo, beats): as dsp.tempo and dsp.beats tell of a whole buffer. A recording's envelope, one value for 256 frames, is one row here."""
    curve = envelope(rows, *keys, size=size)
    whole = curve.groupBy(*keys).agg(F.max("sample_rate").alias("sample_rate"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first_frame", "samples"))), lambda c: c["samples"])).alias("x"))

    def told(x, rate) -> tuple:
        bpm = dsp.tempo(None, rate, envelope=x)
        return bpm, dsp.beats(None, rate, dsp.octave(bpm), envelope=x)

    return mapped(whole, {"tempo": "double", "beats": "array<double>"}, told, "x", "sample_rate", drop=("x", "sample_rate"))


def resampled(rows: DataFrame, rate: int, *keys: str, size: int = TILE) -> DataFrame:
    """rows at another sample rate, as dsp.resample makes of a whole buffer."""
    rates = [r[0] for r in rows.select("sample_rate").distinct().collect()]  # as many as there are sample rates
    out = rows.where(F.col("sample_rate") == rate).select(*keys, "first_frame", F.col("sample_rate").cast("int").alias("sample_rate"), F.col("samples").cast("array<float>").alias("samples"))
    for have in rates:
        if have == rate:
            continue
        halo = dsp.resample_reach(have, rate) + 2

        def play(samples, tile, first, n_frames, have=have) -> tuple:
            last = min((tile + 1) * size, n_frames)
            j0, j1 = -(-tile * size * rate // have), min(-(-last * rate // have), n_frames * rate // have)
            return j0, dsp.resample_at(samples, have, rate, j0, max(j0, j1), first).astype(np.float32)

        cut = tiles(rows.where(F.col("sample_rate") == have), *keys, size=size, before=halo, after=halo)
        made = mapped(cut, {"first_frame": "bigint", "samples": "array<float>"}, play, "samples", "tile", "first", "n_frames", drop=("tile", "first", "n_frames", "sample_rate"))
        out = out.unionByName(made.where(F.size("samples") > 0).select(*keys, "first_frame", F.lit(rate).alias("sample_rate"), "samples"))
    return out
