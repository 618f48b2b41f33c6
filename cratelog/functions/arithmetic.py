"""Levels, musical time and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -120.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def to_db(level: Column, floor: float = SILENCE_DB) -> Column:
    return F.when(level > 0, F.log10(level) * 20).otherwise(floor)


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [0, 1]; 0 if either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, clamp(dot(a, b) / scale)).otherwise(0.0)


def bars_to_beats(bars: Column, meter: Column) -> Column:
    parts = F.split(meter, "/")
    return bars * F.floor(F.get(parts, F.lit(0)).cast("bigint") * 4 / F.get(parts, F.lit(1)).cast("bigint"))


def bar_seconds(bpm: Column, beats: int = 4) -> Column:
    return F.when(bpm > 0, beats * 60.0 / bpm).otherwise(2.0)


def snap(ticks: Column, grid: Column) -> Column:
    """The nearest multiple of grid; halfway goes to the even multiple."""
    return (F.rint(ticks / grid) * grid).cast("bigint")


def overlap_ratio(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Overlap over the shorter length; 0 if that has no length."""
    shorter = F.least(end - start, end2 - start2)
    shared = F.greatest(F.lit(0.0), F.least(end, end2) - F.greatest(start, start2))
    return F.when(shorter > 0, shared / shorter).otherwise(0.0)


def fix_tempo(bpm: Column) -> Column:
    """One octave up under 40, one down over 200."""
    return F.when((bpm > 0) & (bpm < 40), bpm * 2).when(bpm > 200, bpm / 2).otherwise(bpm)


def bar_fit(bars: Column, bpm: Column) -> Column:
    """How near a length is to 1, 2, 4, 8 or 16 bars; 0.3 without a tempo."""
    off = F.array_min(F.array(*[F.abs(bars - n) for n in (1, 2, 4, 8, 16)]))
    return F.when(bpm <= 0, 0.3).otherwise(clamp(1 - off / F.greatest(bars, F.lit(1.0))))


def seconds_to_samples(seconds: Column, rate: Column) -> Column:
    """Truncating."""
    return (seconds * rate).cast("bigint")


def percent_done(count: Column, target: Column) -> Column:
    """min(100, truncated percentage); a target of nothing is done."""
    return F.when(target <= 0, 100).otherwise(F.least(F.lit(100), (count / target * 100).cast("int")))
