"""From onsets to slices: planning, classification, validity and quality control.

Windows run by recording, so a recording is the unit of parallel work; long ones stay cheap, as
all rules look at neighbouring rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal, tags
from ..functions.text import slice_name
from . import audio, chunks


def numeric_onsets(onsets: DataFrame, column: str = "t") -> DataFrame:
    """Onsets that are numbers; whatever else is dropped."""
    value = F.expr(f"try_cast({column} AS double)")
    return onsets.withColumn(column, value).where(F.col(column).isNotNull() & ~F.isnan(column))


def one_shots(onsets: DataFrame, shortest: float = 0.05, longest: float = 10.0, key: str = "recording_id") -> DataFrame:
    """(key, segment, start_time, end_time): to the next onset, at least shortest and at most longest long.

    A lengthened segment may reach into the next; the last one is as long as allowed.
    """
    w = Window.partitionBy(key).orderBy("t")
    end = F.least(F.coalesce(F.lead("t").over(w), F.col("t") + longest), F.col("t") + longest)
    return onsets.select(key, (F.row_number().over(w) - 1).alias("segment"), F.col("t").alias("start_time"), F.greatest(end, F.col("t") + shortest).alias("end_time"))


def between_onsets(onsets: DataFrame, durations: DataFrame, key: str = "recording_id", near: float = 0.1) -> DataFrame:
    """(key, start_time, end_time) between neighbours, with 0 and the duration added unless an onset is near."""
    ends = onsets.groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).join(durations, key)
    extra = ends.where(F.col("lo") > near).select(key, F.lit(0.0).alias("t")).unionByName(ends.where(F.col("hi") < F.col("duration") - near).select(key, F.col("duration").alias("t")))
    w = Window.partitionBy(key).orderBy("t")
    return onsets.select(key, "t").unionByName(extra).select(key, F.col("t").alias("start_time"), F.lead("t").over(w).alias("end_time")).where("end_time IS NOT NULL")


def whole_loop(onsets: DataFrame, key: str = "recording_id") -> DataFrame:
    """The fallback of loop planning: one loop from 0 to a second past the last onset."""
    return onsets.groupBy(key).agg((F.max("t") + 1.0).alias("end_time")).select(key, F.lit(0.0).alias("start_time"), "end_time", F.lit("loop").alias("type"), F.lit(0.5).alias("confidence"))


def plan(onsets: DataFrame, project_type: str, key: str = "recording_id") -> DataFrame:
    """Segments as the project's type wants them: loops for instruments, else one-shots."""
    if project_type == "virtual_instrument":
        return whole_loop(onsets, key)
    return one_shots(onsets, key=key).select(key, "start_time", "end_time", F.lit("one_shot").alias("type"), F.lit(1.0).alias("confidence"))


def duration_class(duration: Column, ambient: float = 5.0, one_shot: float = 2.0, loop: tuple[float, float] = (0.5, 32.0)) -> Column:
    """Struct of type and confidence; the order of the tests matters."""
    kind = F.when(duration >= ambient, "ambient").when(duration <= one_shot, "one_shot").when(duration.between(*loop), "loop").otherwise("unknown")
    sure = F.when(kind == "ambient", 0.85).when(kind == "one_shot", 0.9).when(kind == "loop", 0.8).otherwise(0.5)
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def drum_type(centroid: Column, flatness: Column) -> Column:
    return (
        F.when((centroid < 1800) & (flatness < 0.01), "kick")
        .when(centroid > 5000, "hihat")
        .when(flatness > 0.01, "snare").when(flatness < 0.01, "tom").otherwise("perc")
    )


def drum_tags(drum: Column, duration: Column) -> Column:
    """Tags of a drum type; a hi-hat is open from 0.3 seconds on, bound left out."""
    hat = F.when(drum == "hihat", F.when(duration > 0.3, "open_hat").otherwise("closed_hat"))
    return F.filter(F.array(F.when(drum != "perc", "drum"), drum, hat), lambda t: t.isNotNull())


def character(flatness: Column) -> Column:
    return F.when(flatness < 0.005, "tonal").when(flatness > 0.05, "noisy").otherwise("hybrid")


def described(rows: DataFrame, **lengths) -> DataFrame:
    """rows (start_time, end_time, centroid, flatness, rms) with type, confidence, instrument_type, character and tags.

    Rows without features (null) keep what their length says. lengths: see duration_class.
    """
    length = F.col("end_time") - F.col("start_time")
    made = rows.withColumn("c_", duration_class(length, **lengths)).withColumns({"type": F.col("c_.type"), "confidence": F.col("c_.confidence")}).drop("c_")
    shot = F.col("type") == "one_shot"
    drum = F.when(shot & F.col("centroid").isNotNull(), drum_type(F.col("centroid"), F.col("flatness")))
    made = made.withColumns({"instrument_type": drum, "character": F.when(F.col("flatness").isNotNull(), character(F.col("flatness")))})
    heard = F.concat(F.when(shot, F.concat(F.array(F.lit("one_shot")), drum_tags(F.col("instrument_type"), length))).otherwise(F.array().cast("array<string>")), sound_tags(F.col("flatness"), F.col("rms")))
    return made.withColumn("tags", F.when(F.col("flatness").isNotNull(), heard))


def heard_segments(rows: DataFrame, buffers: DataFrame, key: str = "recording_id") -> DataFrame:
    """rows (key, start_time, end_time) with centroid, flatness, rms and peak of what they cut out of buffers (key, sample_rate, samples, and first_frame if in chunks).

    Empty segments have nulls.
    """
    parts = chunks.as_chunks(buffers)
    rates = parts.groupBy(key).agg(F.max("sample_rate").alias("rate_"))
    at = lambda t: F.greatest(F.lit(0).cast("bigint"), (F.col(t) * F.col("rate_")).cast("bigint"))
    spans = rows.select(key, "start_time", "end_time").distinct().join(rates, key).select(key, "start_time", "end_time", at("start_time").alias("first_sample"), at("end_time").alias("last_sample"))
    heard = chunks.cut(spans, parts, key)
    return rows.join(audio.segment_features(heard, key, "start_time", "end_time"), [key, "start_time", "end_time"], "left")


def point_bounds(json: Column) -> Column:
    """Struct of start_time and end_time of a slice point: of keys start and end where these are present, even if null, else of start_time and end_time."""
    one = lambda k: F.when(tags.has_key(json, k), tags.get(json, k)).otherwise(tags.get(json, f"{k}_time")).try_cast("double")
    return F.struct(one("start").alias("start_time"), one("end").alias("end_time"))


def sound_tags(flatness: Column, level: Column) -> Column:
    """tonal or noisy, high or low energy; what is in between has no tag."""
    found = F.array(F.when(flatness < 0.005, "tonal").when(flatness > 0.05, "noisy"), F.when(level > 0.1, "high_energy").when(level < 0.01, "low_energy"))
    return F.filter(found, lambda t: t.isNotNull())


def slices(points: DataFrame, recordings: DataFrame, key: str = "recording_id", shortest: float = 0.1, longest: float = 10.0) -> DataFrame:
    """Valid slices: both ends given, within the audio, not empty, and of an allowed length (bounds allowed).

    points: key, idx, start_time, end_time; recordings: key, base, sample_rate, n_samples. The name
    counts all points. duration is as planned, audio_duration what is left in the audio.
    """
    joined = points.where("start_time IS NOT NULL AND end_time IS NOT NULL").join(recordings, key)
    rate = F.col("sample_rate")
    first = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n_samples"), (F.col("start_time") * rate).cast("bigint")))
    last = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n_samples"), (F.col("end_time") * rate).cast("bigint")))
    made = joined.select(key, "idx", slice_name(F.col("base"), F.col("idx")).alias("name"), "start_time", (F.col("end_time") - F.col("start_time")).alias("duration"), first.alias("first_sample"), last.alias("last_sample"), ((last - first) / rate).alias("audio_duration"))
    return made.where((F.col("first_sample") < F.col("last_sample")) & F.col("audio_duration").between(shortest, longest))


def quality_control(samples: DataFrame, reject: bool = True, least: float = 0.5) -> DataFrame:
    """samples (with file_path and score) with qc_status; failed ones are left out if reject.

    Samples without a file are not looked at and pass through.
    """
    failed = F.col("file_path").isNotNull() & (F.col("score") < least)
    status = F.when(F.col("file_path").isNull(), "unchecked").when(failed, "failed").otherwise("passed")
    judged = samples.withColumn("qc_status", status)
    return judged.where("qc_status <> 'failed'") if reject else judged


def drum_thresholds(features: DataFrame) -> DataFrame:
    """(category, n, and least, greatest and mean centroid, flatness and duration)."""
    of = ("centroid", "flatness", "duration")
    return features.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{c}") for c in of for p, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def propose_cuts(stats: DataFrame) -> DataFrame:
    """One row of proposed limits, null where a category is missing.

    A kick's centroid ends midway between its own greatest and the others' least, if there are snares or
    hi-hats; a hi-hat's begins midway between the others' greatest and its own least, or a fifth
    under its own where there are no others. A snare's flatness begins a tenth under its least.
    """
    pick = lambda cat, c: F.max(F.when(F.col("category") == cat, F.col(c)))
    top, low = pick("kick", "max_centroid"), pick("hihat", "min_centroid")
    over, under = F.min(F.when(F.col("category") != "kick", F.col("min_centroid"))), F.max(F.when(F.col("category") != "hihat", F.col("max_centroid")))
    return stats.agg(
        F.when(F.count_if(F.col("category").isin("snare", "hihat")) > 0, (top + over) / 2).alias("kick_centroid"),
        F.coalesce((low + under) / 2, low * 0.8).alias("hat_centroid"), (pick("snare", "min_flatness") * 0.9).alias("snare_flatness"),
    )


def measured(made: DataFrame, buffers: DataFrame, key: str = "recording_id", least: int = 1024) -> DataFrame:
    """Slices with their samples, score and quality report, cut from buffers (key, sample_rate, samples, and first_frame if in chunks); the name is the file's."""
    cut = chunks.cut(made, chunks.as_chunks(buffers), key).select(key, *[c for c in made.columns if c != key], "sample_rate", "samples")
    out = cut.withColumn("quality_report", signal.quality_report(F.col("samples"), least=least))
    return out.withColumns({"score": F.col("quality_report.score"), "file_path": F.concat("name", F.lit(".wav"))})
