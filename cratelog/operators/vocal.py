"""Vocal stabs: gaps, issues, counts, and the layout of the repaired file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.text import clip_text, processed_name
from .audio import features, key_name, sample_arrays

IDEAL_COUNTS = (2, 4, 8, 16, 32, 64)
SILENCE_MS = 75.0


def stabs(onsets: DataFrame, lengths: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, stab, start_sample, end_sample): each to the next onset, the last to the end. lengths: key, n_samples."""
    w = Window.partitionBy(key).orderBy("start_sample")
    return onsets.join(lengths, key).select(key, (F.row_number().over(w) - 1).alias("stab"), "start_sample", F.coalesce(F.lead("start_sample").over(w), F.col("n_samples")).alias("end_sample"))


def gaps(rows: DataFrame, key: str = "file_id", start: str = "start_ms", end: str = "end_ms", least: float = SILENCE_MS) -> DataFrame:
    """rows with gap_ms to the next stab and gap_issue; the last stab of a file has neither."""
    gap = F.lead(start).over(Window.partitionBy(key).orderBy(start, end)) - F.col(end)
    issue = F.when(gap <= 0, "no silence or overlap").when(gap < least, "silence too short")
    return rows.withColumn("gap_ms", gap).withColumn("gap_issue", issue)


def silence(with_gaps: DataFrame, key: str = "file_id", least: float = SILENCE_MS) -> DataFrame:
    """(key, stabs, average_silence_ms, short_gaps): null average for one stab, 0 if no two have a gap."""
    positive = F.when(F.col("gap_ms") > 0, F.col("gap_ms"))
    average = F.when(F.count(F.lit(1)) > 1, F.coalesce(F.avg(positive), F.lit(0.0)))
    return with_gaps.groupBy(key).agg(F.count(F.lit(1)).alias("stabs"), average.alias("average_silence_ms"), F.count_if(F.col("gap_ms") < least).alias("short_gaps"))


def count_is_ideal(count: Column) -> Column:
    return count.isin(*IDEAL_COUNTS)


def stab_issues(start: Column, end: Column, clean_start: Column, clean_end: Column, clicks: Column) -> Column:
    """Issues of one stab, each named once."""
    issues = F.array(
        F.when(end <= start, "zero length"), F.when(~clean_start, "no zero crossing at start"),
        F.when(~clean_end, "no zero crossing at end"), F.when(clicks, "clicks or pops"),
    )
    return F.array_distinct(F.filter(issues, lambda i: i.isNotNull()))


def metadata_issues(tempo: Column, key: Column, labels: Column) -> Column:
    issues = F.array(F.when(F.coalesce(tempo, F.lit(0.0)) <= 0, "tempo missing"), F.when(F.coalesce(key, F.lit("")) == "", "key missing"), F.when(F.coalesce(F.size(labels), F.lit(0)) < 1, "cue labels missing"))
    return F.filter(issues, lambda i: i.isNotNull())


def layout(rows: DataFrame, key: str, order: tuple[str, ...], length: str, silence: int) -> DataFrame:
    """rows with out_start and out_end in the output, in which silence follows every stab but the last."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(length) + silence).over(before), F.lit(0))
    return rows.withColumn("out_start", start.cast("bigint")).withColumn("out_end", (F.col("out_start") + F.col(length)).cast("bigint"))


def repair(files: DataFrame, key: str = "file_id", silence_ms: float = SILENCE_MS, reach_ms: float = 10.0) -> DataFrame:
    """(key, sample_rate, samples, stabs): stabs moved to zero crossings and laid out with silence between them.

    files: key, sample_rate, samples, stabs (array of start_sample and end_sample, in order). A stab
    that a move leaves without length gets 10 ms, if the audio has them; others without are dropped.
    Silence follows every stab left but the last of those given. A file without usable stabs stays as it is.
    """
    kind = files.schema[key].dataType.simpleString()
    stab = pa.list_(pa.struct([("start_sample", pa.int64()), ("end_sample", pa.int64()), ("duration_ms", pa.float64())]))

    def moved(y: np.ndarray, rate: int, first: int, last: int) -> tuple[int, int]:
        first = max(0, min(first, len(y) - 1))
        last = max(first, min(last, len(y)))
        if last > first:
            reach = int(reach_ms / 1000 * rate) // 2
            first, last = dsp.crossing_near(y, first, reach), dsp.crossing_near(y, last, reach)
            if last <= first:
                last = min(first + int(0.01 * rate), len(y))
        return first, last

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (rate, y, rows) in enumerate(zip(b.column(1).to_pylist(), sample_arrays(b.column(2)), b.column(3).to_pylist(), strict=True)):
                parts, at, out = [], 0, []
                quiet = np.zeros(int(silence_ms / 1000 * rate))
                for n, r in enumerate(rows or []):
                    first, last = moved(y, rate, r["start_sample"], r["end_sample"])
                    if last <= first:
                        continue
                    parts.append(y[first:last])
                    out.append({"start_sample": at, "end_sample": at + last - first, "duration_ms": (last - first) / rate * 1000})
                    at += last - first
                    if n < len(rows) - 1:
                        parts.append(quiet)
                        at += len(quiet)
                whole = np.concatenate(parts) if parts else y
                cols = [b.column(0).slice(i, 1), pa.array([rate], pa.int32()), pa.array([whole], pa.list_(pa.float64())), pa.array([out], stab)]
                yield pa.RecordBatch.from_arrays(cols, names=[b.schema.names[0], "sample_rate", "samples", "stabs"])

    given = files.select(key, F.col("sample_rate").cast("int"), "samples", "stabs")
    return given.mapInArrow(run, f"{key} {kind}, sample_rate int, samples array<double>, stabs array<struct<start_sample:bigint,end_sample:bigint,duration_ms:double>>")


STABS = "array<struct<start_sample:bigint,end_sample:bigint,clean_start:boolean,clean_end:boolean,click:boolean>>"


def marked_stabs(files: DataFrame, key: str, reach_ms: float = 10.0) -> DataFrame:
    """(key, stabs) of rows of key, sample_rate, samples, onsets and stabs (null: from onset to onset, the last to the end).

    Each stab is told whether the sign changes near its ends and whether it holds a click. One map-only stage.
    """
    kind = files.schema[key].dataType.simpleString()
    names = ("start_sample", "end_sample", "clean_start", "clean_end", "click")
    made = pa.list_(pa.struct([(n, pa.int64() if n.endswith("sample") else pa.bool_()) for n in names]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rate, y, onsets, given in zip(b.column(1).to_pylist(), sample_arrays(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                begins = sorted({int(t * rate) for t in onsets or []})
                pairs = [(s["start_sample"], s["end_sample"]) for s in given] if given else list(zip(begins, [*begins[1:], len(y)], strict=True))
                reach = int(rate * reach_ms / 2000)
                flags = [(a, e, dsp.crosses(y, a, reach), dsp.crosses(y, e, reach), dsp.clicks(y[a:e])) for a, e in pairs]
                out.append([dict(zip(names, f, strict=True)) for f in flags])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, made)], names=[b.schema.names[0], "stabs"])

    return files.select(key, F.col("sample_rate").cast("int"), "samples", "onsets", "stabs").mapInArrow(run, f"{key} {kind}, stabs {STABS}")


def evaluate(files: DataFrame, key: str = "file_id", least: float = SILENCE_MS, reach_ms: float = 10.0) -> DataFrame:
    """files with stabs, average_silence_ms, key_name, tempo and issues of each vocal-chop file.

    files: key, sample_rate, samples and labels (cue names). Stabs reach from onset to onset, so
    they have no silence between them unless files brings stabs of its own.
    """
    if "stabs" not in files.columns:
        files = files.withColumn("stabs", F.lit(None).cast("array<struct<start_sample:bigint,end_sample:bigint>>"))
    heard = features(files.select(key, "sample_rate", "samples"), key).select(key, "onsets", "tempo", key_name(F.col("chroma")).alias("key_name"))
    joined = files.join(heard, key)
    joined = joined.drop("stabs", "onsets").join(marked_stabs(joined, key, reach_ms), key)
    ms = lambda n: n * 1000.0 / F.col("sample_rate")
    gap = F.transform(F.sequence(F.lit(0), F.greatest(F.size("stabs") - 2, F.lit(0))), lambda i: ms(F.get("stabs", i + 1)["start_sample"] - F.get(F.col("stabs"), i)["end_sample"]))
    gaps_of = F.when(F.size("stabs") > 1, gap).otherwise(F.array().cast("array<double>"))
    positive = F.filter(gaps_of, lambda v: v > 0)
    mean = F.aggregate(positive, F.lit(0.0), lambda s, v: s + v) / F.size(positive)
    each = F.flatten(F.transform("stabs", lambda s: stab_issues(s["start_sample"], s["end_sample"], s["clean_start"], s["clean_end"], s["click"])))
    between = F.filter(F.transform(gaps_of, lambda g: F.when(g <= 0, "no silence or overlap").when(g < least, "silence too short")), lambda i: i.isNotNull())
    whole = F.filter(F.array(F.when(~count_is_ideal(F.size("stabs")), "number of stabs is no power of two")), lambda i: i.isNotNull())
    return joined.withColumns({
        "average_silence_ms": F.when(F.size("stabs") > 1, F.when(F.size(positive) > 0, mean).otherwise(0.0)),
        "issues": F.array_distinct(F.concat(whole, each, between, metadata_issues(F.col("tempo"), F.col("key_name"), F.col("labels")))),
    })


def perfected(files: DataFrame, key: str = "file_id", silence_ms: float = SILENCE_MS) -> DataFrame:
    """(key, name, sample_rate, samples, tags, issues): evaluated, repaired, and with the comment that says what was found.

    files: key, name, sample_rate, samples, labels, tags (map). The name gets the suffix of a finished file.
    """
    judged = evaluate(files, key, silence_ms)
    fixed = repair(judged.select(key, "sample_rate", "samples", "stabs"), key, silence_ms).select(key, F.col("samples").alias("fixed"), F.size("stabs").alias("n"))
    said = comment(F.col("n"), F.col("average_silence_ms"), F.col("issues"))
    tags_of = F.map_concat(F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k != "comment"), F.create_map(F.lit("comment"), said))
    return judged.join(fixed, key).select(key, processed_name(F.col("name"), "_perfected").alias("name"), "sample_rate", F.col("fixed").alias("samples"), tags_of.alias("tags"), "issues")


def comment(stabs: Column, average_silence_ms: Column, issues: Column) -> Column:
    """The text that goes into a repaired file's comment tag."""
    return F.concat_ws(
        "; ", F.concat(F.lit("Stabs: "), stabs.cast("string")),
        F.when(average_silence_ms.isNotNull(), F.format_string("Average silence: %.1f ms", average_silence_ms)),
        F.when(F.size(issues) > 0, F.concat(F.lit("Issues: "), F.array_join(F.transform(issues, lambda i: clip_text(i)), ", "))),
    )
