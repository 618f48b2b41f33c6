"""Signals held as arrays of samples: levels, noise, quality, shaping. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import SILENCE_DB, clamp, from_db, to_db

#: Settings of a quality report; levels in dB, ratios of full scale.
CLIP_LEVEL, SILENT_DB, DC_LEVEL, MIN_RANGE_DB, MIN_SNR_DB, PASS_SCORE = 0.99, -60.0, 0.01, 6.0, 10.0, 0.5


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def magnitudes(y: Column) -> Column:
    return F.transform(y, lambda v: F.abs(v.cast("double")))


def peak(y: Column) -> Column:
    return F.array_max(magnitudes(y))


def rms(y: Column) -> Column:
    return F.sqrt(_sum(F.transform(y, lambda v: v.cast("double") * v)) / F.size(y))


def mean(y: Column) -> Column:
    return _sum(F.transform(y, lambda v: v.cast("double"))) / F.size(y)


def quantile(values: Column, q: float) -> Column:
    """Exact, with linear interpolation."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (at - low)

    return let(F.array_sort(values), between)


def clip_count(y: Column, level: float = CLIP_LEVEL) -> Column:
    return F.size(F.filter(y, lambda v: F.abs(v) >= level))


def crossings(y: Column) -> Column:
    """Changes of sign, zero being a sign of its own."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(y) - 1, F.lit(1))), lambda i: F.signum(F.get(y, i)) != F.signum(F.get(y, i - 1))))


def zero_crossing_rate(y: Column) -> Column:
    return crossings(y) / F.size(y)


def frame_levels(y: Column, frame: Column) -> Column:
    """RMS of each whole frame."""
    count = F.floor(F.size(y) / frame).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: rms(F.slice(y, k * frame + 1, frame)))


def snr(y: Column, longest: int = 1024, least: int = 1024) -> Column:
    """Mean level of the upper half of the frames over that of the lowest tenth, in dB.

    0 for fewer than ``least`` samples or one frame; 96 if the quiet frames are silent.
    """
    frame = F.least(F.lit(longest), F.floor(F.size(y) / 4).cast("int"))

    def halves(levels: Column) -> Column:
        k = F.size(levels)
        quiet = F.greatest(F.lit(1), F.floor(k / 10).cast("int"))
        upper = F.slice(levels, F.floor(k / 2).cast("int") + 1, k)
        return F.struct((_sum(F.slice(levels, F.lit(1), quiet)) / quiet).alias("noise"), (_sum(upper) / F.size(upper)).alias("signal"))

    def ratio(m: Column) -> Column:
        return F.when(m["noise"] <= 0, F.when(m["signal"] > 0, 96.0).otherwise(0.0)).when(m["signal"] <= m["noise"], 0.0).otherwise(F.log10(m["signal"] / m["noise"]) * 20)

    value = let(let(F.array_sort(frame_levels(y, frame)), halves), ratio)
    return F.when((F.size(y) < least) | (F.size(y) < 8), 0.0).otherwise(value)


def quality_report(y: Column, least: int = 1024, clip_level: float = CLIP_LEVEL) -> Column:
    """Struct of levels, noise, flags, issues and the score; an empty signal is silent with score 0."""
    empty, measurable = F.coalesce(F.size(y), F.lit(0)) <= 0, F.size(y) >= max(least, 8)
    measured = F.struct(
        to_db(peak(y)).alias("peak"), to_db(rms(y)).alias("rms"), to_db(quantile(magnitudes(y), 0.05)).alias("low"), clip_count(y, clip_level).alias("clips"),
        mean(y).alias("dc"), snr(y, least=least).alias("snr"), zero_crossing_rate(y).alias("zcr"),
    )

    def derived(m: Column) -> Column:
        silent, spread, ratio, clips = m["rms"] < SILENT_DB, m["peak"] - m["low"], m["clips"] / F.size(y), m["clips"] > 0
        offset = F.abs(m["dc"]) > DC_LEVEL
        issues = F.array(F.when(silent, "silent"), F.when(clips, "clipping"), F.when(offset, "dc offset"), F.when((spread < MIN_RANGE_DB) & ~silent, "low dynamic range"), F.when(measurable & (m["snr"] < MIN_SNR_DB) & ~silent, "low snr"))
        return F.struct(
            m["peak"].alias("peak_db"), m["rms"].alias("rms_db"), m["low"].alias("noise_floor_db"), m["clips"].alias("clip_count"), ratio.alias("clip_ratio"),
            m["dc"].alias("dc_offset"), spread.alias("dynamic_range_db"), m["snr"].alias("snr_db"), m["zcr"].alias("zero_crossing_rate"), silent.alias("is_silent"),
            clips.alias("has_clipping"), offset.alias("has_dc_offset"), F.filter(issues, lambda i: i.isNotNull()).alias("issues"),
            quality_score(silent, ratio, m["dc"], spread, m["snr"]).alias("score"),
        )

    made = let(measured, derived)
    none = F.struct(
        *[F.lit(SILENCE_DB).alias(n) for n in ("peak_db", "rms_db", "noise_floor_db")], F.lit(0).alias("clip_count"), *[F.lit(0.0).alias(n) for n in ("clip_ratio", "dc_offset", "dynamic_range_db", "snr_db", "zero_crossing_rate")],
        F.lit(True).alias("is_silent"), F.lit(False).alias("has_clipping"), F.lit(False).alias("has_dc_offset"), F.array(F.lit("silent")).alias("issues"), F.lit(0.0).alias("score"),
    )
    return F.when(empty, none).otherwise(made)


def quality_score(silent: Column, clip_ratio: Column, dc: Column, dynamic_db: Column, snr_db: Column) -> Column:
    """Parts of 30 (not silent), 25 (no clipping), 10 (no offset), 20 (range) and 15 (noise), with partial credit."""
    parts = (
        F.when(~silent, 30).otherwise(0)
        + F.when(clip_ratio == 0, 25).when(clip_ratio < 0.001, 15).when(clip_ratio < 0.01, 5).otherwise(0)
        + F.when(F.abs(dc) <= DC_LEVEL, 10).when(F.abs(dc) < 5 * DC_LEVEL, 5).otherwise(0)
        + F.when(dynamic_db >= MIN_RANGE_DB, 20).when(dynamic_db >= MIN_RANGE_DB / 2, 10).otherwise(0)
        + F.when(snr_db >= MIN_SNR_DB, 15).when(snr_db >= MIN_SNR_DB / 2, 7).otherwise(0)
    )
    return F.round(parts / 100, 3)


def rounded(report: str) -> list[Column]:
    """A report's numbers as they are written out; halves go to the even digit."""
    digits = {"peak_db": 2, "rms_db": 2, "noise_floor_db": 2, "clip_ratio": 6, "dc_offset": 6, "dynamic_range_db": 2, "snr_db": 2, "zero_crossing_rate": 4, "score": 3}
    return [F.bround(F.col(f"{report}.{k}"), d).alias(k) for k, d in digits.items()]


def noise_gate(y: Column, threshold_db: Column, amount: float = 1.0) -> Column:
    gated = lambda level: F.transform(y, lambda v: F.when(F.abs(v) < level, v * F.lit(1.0 - amount)).otherwise(v.cast("double")))
    return let(from_db(threshold_db), gated)


def gate_threshold(y: Column, rate: int | Column, lead: float = 0.05, above: float = 6.0, least: float = -60.0) -> Column:
    """dB: ``least``, or what the first ``lead`` seconds hold plus ``above`` if that is more."""
    n = (rate * F.lit(lead)).cast("int") if isinstance(rate, Column) else F.lit(int(lead * rate))
    head = rms(F.slice(y, 1, n))
    return F.when((F.size(y) > n) & (head > 0), F.greatest(F.lit(least), to_db(head) + above)).otherwise(least)


def normalize(y: Column, target_db: float = -14.0) -> Column:
    scaled = lambda top: F.transform(y, lambda v: F.when(top > 0, v.cast("double") / top * 10 ** (target_db / 20)).otherwise(v.cast("double")))
    return let(peak(y), scaled)


def fades(y: Column, fade_in: int | Column, fade_out: int | Column) -> Column:
    """Linear ramps of so many samples, ends included; scaled down together if longer than the signal."""
    ramps = [k if isinstance(k, Column) else F.lit(k) for k in (fade_in, fade_out)]
    n, both = F.size(y), ramps[0] + ramps[1]
    scale = F.when((n < both) & (both > 0), n / both).otherwise(1.0)
    a, b = (F.floor(scale * k).cast("int") for k in ramps)

    def gain(v: Column, i: Column) -> Column:
        left = n - 1 - i
        up = F.when(i < a, F.when(a > 1, i / (a - 1)).otherwise(0.0)).otherwise(1.0)
        down = F.when(left < b, F.when(b > 1, left / (b - 1)).otherwise(1.0)).otherwise(1.0)
        return v.cast("double") * up * down

    return F.transform(y, gain)


def second_differences(y: Column) -> Column:
    return F.transform(F.sequence(F.lit(2), F.size(y) - 1), lambda i: F.abs(F.get(y, i).cast("double") - F.get(y, i - 1) * F.lit(2.0) + F.get(y, i - 2)))


def has_click(y: Column, level: float = 0.1, ratio: float = 5.0, around: int = 20) -> Column:
    """Whether the largest second difference is over level and over ratio times the mean around it."""
    d = second_differences(y)
    top = F.array_max(d)
    at = F.array_position(d, top).cast("int") - 1
    first = F.greatest(F.lit(0), at - around)
    near = F.slice(d, first + 1, F.least(F.size(d), at + around) - first)
    return F.when(F.size(y) < 3, False).otherwise((top > level) & (top > ratio * _sum(near) / F.size(near)))


def rms_consistency(y: Column, frames: int = 16) -> Column:
    """1 - population deviation over mean of the frames' levels, within [0, 1]; 0.3 if too short or silent."""
    size = F.floor(F.size(y) / frames).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: rms(F.slice(y, k * size + 1, size)))

    def steady(x: Column) -> Column:
        m = _sum(x) / frames
        deviation = let(m, lambda c: F.sqrt(_sum(F.transform(x, lambda v: (v - c) * (v - c))) / frames))
        return F.when(m < 1e-10, 0.3).otherwise(clamp(1 - deviation / m))

    return F.when(F.size(y) < frames, 0.3).otherwise(let(levels, steady))


def crosses_near(y: Column, at: Column, reach: int) -> Column:
    """Whether the sign changes within reach samples of a position."""
    first = F.greatest(F.lit(0), at - reach)
    last = F.least(F.size(y), at + reach) - 1
    turns = lambda i: F.coalesce((i > first) & (i <= last) & (F.signum(F.get(y, i)) != F.signum(F.get(y, i - 1))), F.lit(False))
    return F.exists(F.sequence(first + 1, F.greatest(first + 1, last)), turns)


def loudness(y: Column) -> Column:
    """Level in dB; -120 for silence or no samples."""
    return F.when(F.size(y) > 0, to_db(rms(y))).otherwise(SILENCE_DB)


def dynamic_range(y: Column) -> Column:
    """Peak over the 5 % quantile of magnitudes, in dB; 0 if that quantile is nothing (a quality report has -120 there)."""
    low = quantile(magnitudes(y), 0.05)
    return F.when((F.size(y) > 0) & (low > 0), F.log10(peak(y) / low) * 20).otherwise(0.0)
