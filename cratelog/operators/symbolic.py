"""Symbolic events on a tick lattice: quantizing to a loop, fitness, and the best of several attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import clamp, snap


def quantize(events: DataFrame, grid: int, strict: bool = True) -> DataFrame:
    """events (kind, start, dur, loop_len in ticks) with notes snapped to the grid, and clipped and dropped flags.

    Notes past the loop's end are clipped, if not strict only those that reach less than a grid step past it;
    notes without length are dropped (one may be both). Controls stay where they are; strict
    mode drops those from the loop's end on.
    """
    note, size = F.col("kind") == "note", F.col("loop_len")
    start = F.when(note, snap(F.col("start"), F.lit(grid))).otherwise(F.col("start"))
    past = start + F.col("dur") - size
    clipped = note & (past > 0) & (F.lit(True) if strict else past < grid)
    dur = F.when(clipped, size - start).otherwise(F.col("dur"))
    dropped = F.when(note, dur <= 0).otherwise(F.lit(strict) & (start >= size))
    return events.withColumns({"q_start": start, "q_dur": dur, "clipped": clipped, "dropped": dropped})


def quantize_counts(quantized: DataFrame, key: str) -> DataFrame:
    return quantized.groupBy(key).agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("clipped").alias("clipped"), F.count_if("dropped").alias("dropped"))


def fitness(notes: DataFrame, key: str, loops: DataFrame | None = None) -> DataFrame:
    """(key, fitness): 0.4 notes within the loop, 0.3 a downbeat, 0.3 activity in the last quarter.

    notes: key, start, dur, loop_len, whole (ticks of a whole note). loops gives the keys of all loops, of which
    those without notes have fitness 0.
    """
    end, size, n = F.col("start") + F.col("dur"), F.col("loop_len"), F.count(F.lit(1))
    inside = F.count_if(end <= size) / n
    downbeat = F.bool_or(F.col("start") * 16 <= F.col("whole")).cast("int")
    tail = F.count_if((end > size * F.lit(0.75)) & (F.col("start") < size))
    active = F.least(F.lit(1.0), tail / F.greatest(F.lit(1), F.floor(n / 4)))
    found = notes.groupBy(key).agg(clamp(inside * 0.4 + downbeat * 0.3 + active * 0.3).alias("fitness"))
    return found if loops is None else loops.select(key).distinct().join(found, key, "left").select(key, F.coalesce("fitness", F.lit(0.0)).alias("fitness"))


def best_attempt(attempts: DataFrame, key: str, enough: float = 0.7) -> DataFrame:
    """The attempt that a search stopping at ``enough`` returns: the best made, the earlier if equal.

    attempts: key, attempt, fitness. Attempts after the first that is good enough are never made.
    """
    before = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    made = attempts.withColumn("__done", F.coalesce(F.max(F.col("fitness")).over(before) >= enough, F.lit(False))).where("NOT __done").drop("__done")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fitness"), "attempt"))
    return made.withColumn("__n", first).where("__n = 1").drop("__n")


#: Semitones above the tonic in a natural minor scale.
SCALE = (0, 2, 3, 5, 7, 8, 10)
TICKS = 960


def variations(jobs: DataFrame, count: int = 4) -> DataFrame:
    """Each job count times, with label and seed of its own. jobs: label, seed."""
    each = jobs.withColumn("variation", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return each.withColumns({"label": F.concat("label", F.lit("_var"), F.col("variation")), "seed": (F.col("seed") + F.col("variation") - 1).cast("bigint")})


def stand_in_notes(jobs: DataFrame, voices: int = 1, density: float = 0.7, root: int = 48) -> DataFrame:
    """jobs' rows with a note each (kind, voice, start, dur, pitch, velocity, loop_len, whole): random loops for tests and dry runs.

    A stand-in for an external generator, not a copy of any. jobs: seed, beats. Eighth notes of a
    scale are drawn by a hash of seed, voice and step, so a seed always gives the same loop.
    """
    step = TICKS // 2
    grid = jobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(voices - 1))).alias("voice")).where("beats > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("beats") * 2 - 1).cast("int"))).alias("step"))
    draw = lambda what, n: F.pmod(F.xxhash64("seed", "voice", "step", F.lit(what)), F.lit(n))
    kept = grid.where(draw("there", 1000) < int(density * 1000))
    pitch = F.lit(root) + F.col("voice") * 12 + F.element_at(F.array(*map(F.lit, SCALE)), (draw("pitch", len(SCALE)) + 1).cast("int"))
    return kept.withColumns({
        "kind": F.lit("note"), "start": (F.col("step") * step).cast("bigint"), "dur": ((draw("length", 2) + 1) * step).cast("bigint"), "pitch": pitch.cast("int"),
        "velocity": (draw("velocity", 48) + 64).cast("int"), "loop_len": (F.col("beats") * TICKS).cast("bigint"), "whole": F.lit(4 * TICKS).cast("bigint"),
    }).drop("step")
