"""Loop search: beat pairs a whole number of bars apart, seven scores, and the best that don't overlap."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.arithmetic import bar_fit, bar_seconds, clamp, overlap_ratio, seconds_to_samples
from .audio import beat_times, sample_arrays

BAR_COUNTS = (1, 2, 4, 8, 16)
# The scores and their weights.
WEIGHTS = {"beat_alignment": 0.20, "spectral_similarity": 0.25, "duration_quantization": 0.20, "zero_crossing_cleanliness": 0.05, "rms_energy_consistency": 0.10, "onset_regularity": 0.10, "spectral_stability": 0.10}
CAP = 200


def bar_pairs(beats: DataFrame, key: str = "recording_id", tolerance: float = 0.15, shortest: float = 0.5, longest: float = 32.0, cap: int | None = CAP) -> DataFrame:
    """(key, bars, i, j, start_time, end_time): later beats within tolerance of 1, 2, 4, 8 or 16 bars.

    beats: key, i (0-based order), t, bpm. The band join is an equi-join on time cells half a bar
    wide: a start asks the cells that its end may lie in. Per key the first ``cap`` by (bars, i, j)
    are kept, as the search defines it.
    """
    bar = bar_seconds(F.col("bpm"))
    wide = beats.withColumn("bar", bar).withColumn("cell", F.floor(F.col("t") / (F.col("bar") / 2)))
    starts = wide.select(key, F.col("i"), F.col("t").alias("start_time"), "bar", F.explode(F.array(*map(F.lit, BAR_COUNTS))).alias("bars"))
    starts = starts.where((F.col("bars") * F.col("bar")).between(shortest, longest))
    aim, slack = F.col("start_time") + F.col("bars") * F.col("bar"), F.col("bar") * tolerance
    half = F.col("bar") / 2
    asked = starts.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((aim - slack) / half), F.floor((aim + slack) / half)))))
    ends = wide.select(key, F.col("i").alias("j"), F.col("t").alias("end_time"), "cell")
    gap = F.abs(F.col("end_time") - F.col("start_time") - F.col("bars") * F.col("bar"))
    found = asked.join(ends, [key, "cell"]).where((F.col("j") > F.col("i")) & (gap <= F.col("bar") * tolerance)).select(key, "bars", "i", "j", "start_time", "end_time")
    if cap is None:
        return found
    n = F.row_number().over(Window.partitionBy(key).orderBy("bars", "i", "j"))
    return found.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")


def grid_candidates(recordings: DataFrame, key: str = "recording_id", shortest: float = 0.5, longest: float = 32.0, cap: int | None = CAP) -> DataFrame:
    """Where there are fewer than four beats: every bar a start, for each length that fits; all if cap is None. recordings: key, duration, bpm."""
    wide = recordings.withColumn("bar", bar_seconds(F.col("bpm"))).select("*", F.explode(F.array(*map(F.lit, BAR_COUNTS))).alias("bars"))
    length = F.col("bars") * F.col("bar")
    fits = wide.where(length.between(shortest, longest) & (length <= F.col("duration")))
    steps = F.floor((F.col("duration") - length) / F.col("bar")).cast("int")
    each = fits.select("*", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    found = each.select(key, "bars", (F.col("k") * F.col("bar")).alias("start_time"), (F.col("k") * F.col("bar") + length).alias("end_time"))
    if cap is None:
        return found
    n = F.row_number().over(Window.partitionBy(key).orderBy("bars", "start_time"))
    return found.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")


def beat_alignment(start: Column, end: Column, beats: Column) -> Column:
    """How near each end is to a beat (beats: an array of times), in beat periods, on average; 0.3 without beats."""
    near = lambda t: F.array_min(F.transform(beats, lambda b: F.abs(b - t)))
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(beats) - 1, F.lit(1))), lambda i: F.get(beats, i) - F.get(beats, i - 1)))
    n = F.size(beats) - 1
    middle = (F.get(gaps, F.floor((n - 1) / 2).cast("int")) + F.get(gaps, F.floor(n / 2).cast("int"))) / 2
    period = F.when(F.size(beats) > 1, middle).otherwise(0.5)
    score = lambda t: clamp(1 - near(t) / F.greatest(period, F.lit(1e-9)))
    return F.when(F.size(beats) == 0, 0.3).otherwise((score(start) + score(end)) / 2)


def onset_regularity(gaps: DataFrame, key: str) -> DataFrame:
    """(key, onset_regularity): 1 - variation of the gaps between onsets; 0.3 if there are none."""
    mean, deviation = F.avg("gap"), F.stddev_pop("gap")
    return gaps.groupBy(key).agg(F.when((F.count("gap") == 0) | (mean < 1e-10), 0.3).otherwise(clamp(1 - deviation / mean)).alias("onset_regularity"))


def overall(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum, clamped; given weights replace the defaults by name and are not normalised."""
    w = WEIGHTS | (weights or {})
    total = F.lit(0.0)
    for name, weight in w.items():
        total = total + scores[name] * weight
    return clamp(total)


def duration_score(bars: Column, bpm: Column) -> Column:
    return bar_fit(bars, bpm)


class Chosen:
    """Intervals by start, in classes of length within a factor of two, so that what an interval may meet is a short stretch of each class."""

    def __init__(self, overlap: float):
        self.overlap, self.classes = overlap, {}

    def add(self, start: float, end: float) -> bool:
        """Take an interval unless it overlaps one of those taken by more, in shares of the shorter; whether it was taken."""
        for size, (starts, ends) in self.classes.items():
            k = bisect.bisect_left(starts, start - 2.0**size)
            while k < len(starts) and starts[k] < end:
                shorter = min(end - start, ends[k] - starts[k])
                if shorter > 0 and (min(end, ends[k]) - max(start, starts[k])) / shorter > self.overlap:
                    return False
                k += 1
        starts, ends = self.classes.setdefault(math.frexp(end - start)[1] if end > start else -1100, ([], []))
        k = bisect.bisect_left(starts, start)
        starts.insert(k, start)
        ends.insert(k, end)
        return True


def select_best(scored: DataFrame, key: str = "recording_id", n: int = 5, least: float = 0.3, overlap: float = 0.5) -> DataFrame:
    """(key, rank, idx, start_time, end_time, score): greedy best first, skipping what overlaps a chosen one by more.

    scored: key, idx, start_time, end_time, score. Equal scores keep the order of idx. A key's candidates
    stream through in the order of their scores; only the chosen are held, and each candidate looks at few of them.
    """
    kind = scored.schema[key].dataType.simpleString()
    index = scored.schema["idx"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rank, chosen = None, 0, Chosen(overlap)
        for b in batches:
            kept, ranks = [], []
            for i, (k, start, end) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if k != own or not rank and not chosen.classes:
                    own, rank, chosen = k, 0, Chosen(overlap)
                if rank < n and chosen.add(start, end):
                    rank += 1
                    kept.append(i)
                    ranks.append(rank)
            rows = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ranks, pa.int32()), *rows.columns[1:]], names=[key, "rank", "idx", "start_time", "end_time", "score"])

    some = scored.where(F.col("score") >= least).select(key, "idx", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.col("score").cast("double").alias("score"))
    return some.repartition(key).sortWithinPartitions(key, F.desc("score"), "idx").mapInArrow(run, f"{key} {kind}, rank int, idx {index}, start_time double, end_time double, score double")


_HEARD = ("spectral_similarity", "zero_crossing_cleanliness", "rms_energy_consistency", "onset_regularity", "spectral_stability")


def candidates(timed: DataFrame, key: str = "recording_id", cap: int | None = CAP) -> DataFrame:
    """(key, bars, start_time, end_time): bar pairs of beats, or the bar grid where there are fewer than four. timed: see audio.beat_times."""
    few = F.size("beats") < 4
    rows = timed.where(~few).select(key, "bpm", F.posexplode("beats").alias("i", "t"))
    return bar_pairs(rows, key, cap=cap).select(key, "bars", "start_time", "end_time").unionByName(grid_candidates(timed.where(few).select(key, "duration", "bpm"), key, cap=cap))


def heard(buffers: DataFrame, found: DataFrame, key: str = "recording_id") -> DataFrame:
    """found (key, idx, loop_start, loop_end) with the five scores that need the audio; empty candidates are left out.

    A recording's candidates are few by the search's cap, so they travel as one array beside its samples.
    """
    kind = buffers.schema[key].dataType.simpleString()
    packed = found.where("loop_end > loop_start").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "loop_start", "loop_end"))).alias("c"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (rate, y, rows) in enumerate(zip(b.column(1).to_pylist(), sample_arrays(b.column(2)), b.column(3).to_pylist(), strict=True)):
                scores = np.array([dsp.loop_features(y, rate, r["loop_start"], min(len(y), r["loop_end"])) for r in rows])
                own = b.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array([r["idx"] for r in rows], pa.int32()), *map(pa.array, scores.T.copy())], names=[b.schema.names[0], "idx", *_HEARD])

    kinds = f"{key} {kind}, idx int, " + ", ".join(f"{n} double" for n in _HEARD)
    return buffers.select(key, F.col("sample_rate").cast("int"), "samples").join(packed, key).mapInArrow(run, kinds)


def search(buffers: DataFrame, timed: DataFrame | None = None, key: str = "recording_id", n: int = 5, least: float = 0.3, overlap: float = 0.5, weights: dict[str, float] | None = None, cap: int | None = CAP) -> DataFrame:
    """(key, rank, loop_start, loop_end, start_time, end_time, bars, bpm, confidence): the best loops of each recording.

    buffers: key, sample_rate, samples. timed (see audio.beat_times) is read several times: give a
    written table of it for long audio. Recordings without candidates have no row.
    """
    timed = beat_times(buffers, key) if timed is None else timed
    order = F.row_number().over(Window.partitionBy(key).orderBy("bars", "start_time", "end_time")) - 1
    each = candidates(timed, key, cap).withColumn("idx", order).join(timed, key)
    placed = each.withColumns({"loop_start": seconds_to_samples(F.col("start_time"), F.col("sample_rate")), "loop_end": seconds_to_samples(F.col("end_time"), F.col("sample_rate"))})
    length = (F.col("end_time") - F.col("start_time")) / bar_seconds(F.col("bpm"))
    by_time = {"beat_alignment": beat_alignment(F.col("start_time"), F.col("end_time"), F.col("beats")), "duration_quantization": duration_score(length, F.col("bpm"))}
    known = placed.withColumns(by_time).drop("beats", "duration").join(heard(buffers, placed.select(key, "idx", "loop_start", "loop_end"), key), [key, "idx"])
    scored = known.withColumn("score", overall({name: F.col(name) for name in WEIGHTS}, weights))
    best = select_best(scored.select(key, "idx", "start_time", "end_time", "score"), key, n, least, overlap)
    return best.join(scored.select(key, "idx", "loop_start", "loop_end", length.alias("bars"), "bpm"), [key, "idx"]).select(key, "rank", "loop_start", "loop_end", "start_time", "end_time", "bars", "bpm", F.col("score").alias("confidence"))
