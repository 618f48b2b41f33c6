"""Chains of DataFrame transforms whose input and output kinds are checked before anything runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp, signal
from ..functions.text import WORD_STARTS, clip_text
from ..operators import audio, chunks, exports, loops, segments, vocal
from ..sources import wav

#: Kinds of tables that stages pass on.
FILE, AUDIO, ONSETS, SEGMENTS, SLICES, SAMPLES, LOOPS = "file_path", "audio", "onset_times", "segments", "slice_points", "list_of_sample_data", "loop_candidates"
PRESETS, CHOPS = "preset_files", "vocal_chops"
#: How onsets are told; peaks are picked in frames of the envelope.
ONSET_PARAMS = {"sr": 44_100, "hop_length": 256, "n_fft": 2048, "snap_to_zero_crossing": True}
DETECTION = {"units": "samples", "backtrack": True, "energy": None, "fmin": 20.0, "fmax": 20_000.0, "aggregate": "mean", "delta": 0.07, "wait": 5, "pre_max": 5, "post_max": 5, "pre_avg": 10, "post_avg": 10}


@dataclass(frozen=True)
class Stage:
    """A transform of one kind of table into another. defaults: its parameters; a call's replace them, but those in ``nested`` are merged key by key."""

    name: str
    takes: str
    gives: str
    run: Callable[..., DataFrame]
    defaults: Mapping[str, object] = field(default_factory=dict)
    description: str = ""
    nested: tuple[str, ...] = ("detection_params",)


@dataclass(frozen=True)
class Result:
    data: DataFrame
    kind: str
    stages: list[str]


class Registry:
    def __init__(self, *stages: Stage):
        self.stages: dict[str, Stage] = {}
        for s in stages:
            self.add(s)

    def add(self, stage: Stage) -> Stage:
        if not isinstance(stage, Stage):
            raise TypeError(f"{stage!r} is not a Stage")
        self.stages[stage.name] = stage
        return stage

    def resolve(self, chain: Sequence[Mapping], kind: str) -> list[tuple[Stage, dict]]:
        """The chain's stages with their parameters, or the first fault: ValueError for an unknown stage, TypeError for a kind that doesn't fit."""
        out = []
        for step in chain:
            if step["stage_name"] not in self.stages:
                raise ValueError(f"unknown stage: {step['stage_name']}")
            stage = self.stages[step["stage_name"]]
            if stage.takes != kind:
                raise TypeError(f"{stage.name} takes {stage.takes}, not {kind}")
            out.append((stage, merged(stage.defaults, step.get("params") or {}, stage.nested)))
            kind = stage.gives
        return out

    def faults(self, chain: Sequence[Mapping], kind: str) -> list[str]:
        """All places where a chain does not compose, reading on as if each stage had been given what it takes."""
        found = []
        for step in chain:
            stage = self.stages.get(step["stage_name"])
            if stage is None:
                found.append(f"unknown stage: {step['stage_name']}")
                continue
            if stage.takes != kind:
                found.append(f"{stage.name} takes {stage.takes}, not {kind}")
            kind = stage.gives
        return found

    def run(self, chain: Sequence[Mapping], data: DataFrame, kind: str) -> Result:
        """One lazy plan of all stages."""
        steps = self.resolve(chain, kind)
        for stage, params in steps:
            data = data.transform(lambda df, s=stage, p=params: s.run(df, **p))
        return Result(data, steps[-1][0].gives if steps else kind, [s.name for s, _ in steps])


def snake(name: str) -> str:
    """A class-like workflow name as a key."""
    return re.sub("_+", "_", re.sub(WORD_STARTS, "_", name)).lower()


def merged(base: Mapping, over: Mapping, nested: Sequence[str] = ()) -> dict:
    """base with the values of over; the mappings named in ``nested`` get over's keys instead of being replaced."""
    both = {k: {**base[k], **over[k]} for k in nested if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping)}
    return {**base, **over, **both}


def _onsets(rows: DataFrame, sr: int | None, hop_length: int, n_fft: int, snap_to_zero_crossing: bool, detection_params: Mapping) -> DataFrame:
    """(recording_id, t) of audio, whole or in chunks, at the sample rate ``sr`` (None: as it is). units says how positions are counted inside: samples or frames."""
    told = dict(detection_params)
    if told.pop("units", "samples") not in ("samples", "frames", None):
        raise ValueError("units must be samples or frames")
    p = dsp.OnsetParams(hop=hop_length, n_fft=n_fft, snap=snap_to_zero_crossing, **told)
    parts = chunks.as_chunks(rows).select("recording_id", "first_frame", "sample_rate", "samples")
    return chunks.onsets(parts if sr is None else chunks.resampled(parts, sr, "recording_id"), "recording_id", p=p)


def _classify(rows: DataFrame, buffers: DataFrame | None, enable_spectral_analysis: bool = True, **p) -> DataFrame:
    """Type and confidence by length; with audio at hand also instrument, character and tags."""
    if enable_spectral_analysis and buffers is not None:
        return segments.described(segments.heard_segments(rows, buffers), **p)
    made = rows.withColumn("c_", segments.duration_class(F.col("end_time") - F.col("start_time"), **p))
    return made.withColumns({"type": F.col("c_.type"), "confidence": F.col("c_.confidence")}).drop("c_")


def _faded(rows: DataFrame, fade_in_ms: float = 0.0, fade_out_ms: float = 0.0) -> DataFrame:
    """Samples with linear fades at both ends."""
    n = lambda ms: F.floor(F.col("sample_rate") * F.lit(ms / 1000)).cast("int")
    return rows.withColumn("samples", signal.fades(F.col("samples"), n(fade_in_ms), n(fade_out_ms)))


def _written(rows: DataFrame, folder: str | None = None, bit_depth: int = 24, normalize: bool = True) -> DataFrame:
    """The slices as files below a folder (None: nothing is written), at full scale if normalized, one folder a recording; file_path says where."""
    if folder is None:
        return rows
    placed = rows.withColumn("file_path", F.concat(F.lit(folder.rstrip("/")), F.lit("/"), F.col("recording_id").cast("string"), F.lit("/"), "name", F.lit(".wav")))
    y = F.when(F.size("samples") > 0, signal.normalize(F.col("samples"), 0.0)).otherwise(F.col("samples").cast("array<double>")) if normalize else F.col("samples")
    wav.export(wav.to_wav(placed.select(F.concat(F.col("recording_id").cast("string"), F.lit("/"), "name").alias("name"), "sample_rate", y.alias("samples")), bit_depth), folder)
    return placed


def _points(rows: DataFrame) -> DataFrame:
    """Slice points with start_time and end_time; of a JSON column ``point`` its start and end, where present, else its start_time and end_time."""
    if "point" not in rows.columns:
        return rows
    bounds = segments.point_bounds(F.col("point"))
    return rows.withColumns({"start_time": bounds["start_time"], "end_time": bounds["end_time"]})


def _preset(rows: DataFrame, root_note: int = 60, instrument_name: str = "Instrument") -> DataFrame:
    """A preset of the slices of each recording, a key for each from the root note upwards."""
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("idx")) - 1
    zones = rows.select("recording_id", F.lit(instrument_name).alias("group"), F.lit(0).alias("lo_vel"), F.lit(127).alias("hi_vel"), (F.lit(root_note) + nth).alias("root_note"), F.concat("name", F.lit(".wav")).alias("path"))
    return exports.preset_files(zones.withColumns({"lo_key": F.col("root_note"), "hi_key": F.col("root_note")}), "recording_id")


def _as_points(rows: DataFrame) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_time", "end_time")) - 1
    return rows.withColumn("idx", idx).withColumn("type", F.coalesce("type", F.lit("one_shot")))


#: The order of the whole segmentation.
INTELLIGENT_SLICING = [{"stage_name": n} for n in ("slice_planning", "segment_classification", "slice_points", "slicing")]


def segmentation(recordings: DataFrame | None = None, buffers: DataFrame | None = None) -> Registry:
    """The stages from audio to checked slices and loops. recordings: see segments.slices; buffers: recording_id, sample_rate, samples.

    Audio is rows of recording_id, sample_rate and samples.
    """
    made = Registry(
        Stage("noise_reduction", AUDIO, AUDIO, lambda df, **p: audio.gated(df, **p), {"amount": 1.0, "threshold_db": -60.0, "auto_threshold": True}),
        Stage("onset_detection", AUDIO, ONSETS, _onsets, {**ONSET_PARAMS, "detection_params": DETECTION}),
        Stage("loop_detection", AUDIO, LOOPS, lambda df, **p: loops.search(df, **p), {"n": 5, "least": 0.3, "overlap": 0.5}),
        Stage("slice_planning", ONSETS, SEGMENTS, lambda df, project_type: segments.plan(segments.numeric_onsets(df), project_type), {"project_type": "sample_pack"}),
        Stage("segment_classification", SEGMENTS, SEGMENTS, lambda df, **p: _classify(df, buffers, **p), {"enable_spectral_analysis": True}),
        Stage("slice_points", SEGMENTS, SLICES, _as_points),
        Stage("slicing", SLICES, SAMPLES, lambda df, **p: segments.slices(_points(df), recordings, **p)),
        Stage("quality_measurement", SAMPLES, SAMPLES, lambda df, **p: segments.measured(df, buffers, **p)),
        Stage("fades", SAMPLES, SAMPLES, _faded, {"fade_in_ms": 2.0, "fade_out_ms": 2.0}),
        Stage("slice_files", SAMPLES, SAMPLES, _written, {"folder": None, "bit_depth": 24, "normalize": True}),
        Stage("sampler_export", SAMPLES, PRESETS, _preset, {"root_note": 60, "instrument_name": "Instrument"}),
        Stage("vocal_evaluation", CHOPS, CHOPS, vocal.evaluate),
        Stage("vocal_perfection", CHOPS, CHOPS, vocal.perfected),
        Stage("quality_control", SAMPLES, SAMPLES, lambda df, **p: segments.quality_control(df, **p), {"reject": True, "least": 0.5}),
    )

    def intelligent(df: DataFrame, **params) -> DataFrame:
        """params: the parameters of its stages, by their names."""
        steps = [{"stage_name": "onset_detection"}, *INTELLIGENT_SLICING]
        return made.run([s | {"params": params.get(s["stage_name"])} for s in steps], df, AUDIO).data

    made.add(Stage("intelligent_slicing", AUDIO, SAMPLES, intelligent))
    return made


@dataclass(frozen=True)
class Workflow:
    """A named chain, from the kind of table that it takes."""

    name: str
    takes: str
    chain: Sequence[Mapping]
    description: str = ""


class Workflows:
    """Workflows by the snake form of their names; a later one of the same name replaces the earlier."""

    def __init__(self, registry: Registry, *workflows: Workflow):
        self.registry = registry
        self.workflows: dict[str, Workflow] = {}
        for w in workflows:
            self.add(w)

    def add(self, workflow: Workflow) -> Workflow:
        if not isinstance(workflow, Workflow):
            raise TypeError(f"{workflow!r} is not a Workflow")
        self.workflows[snake(workflow.name)] = workflow
        return workflow

    def run(self, name: str, data: DataFrame, context: Mapping[str, Mapping] | None = None) -> Result:
        """One lazy plan; slice_files with a folder runs at once. context: parameters by stage, which replace the chain's own."""
        if snake(name) not in self.workflows:
            raise ValueError(f"unknown workflow: {name}")
        w = self.workflows[snake(name)]
        steps = [s | {"params": {**(s.get("params") or {}), **(context or {}).get(s["stage_name"], {})}} for s in w.chain]
        return self.registry.run(steps, data, w.takes)


def _steps(*names: str) -> list[dict]:
    return [{"stage_name": n} for n in names]


def workflows(recordings: DataFrame | None = None, buffers: DataFrame | None = None) -> Workflows:
    """The catalogue's workflows over the stages of ``segmentation``."""
    gate = {"stage_name": "noise_reduction", "params": {"amount": 0.1}}
    return Workflows(
        segmentation(recordings, buffers),
        Workflow("ExampleSlicing", AUDIO, _steps("onset_detection", "slice_planning", "slice_points", "slicing"), "onsets to slices"),
        Workflow("SliceFiles", AUDIO, _steps("onset_detection", "slice_planning", "slice_points", "slicing", "quality_measurement", "fades", "slice_files"), "onsets to faded slices in files"),
        Workflow("SamplePack", AUDIO, [gate, *_steps("onset_detection", *(s["stage_name"] for s in INTELLIGENT_SLICING), "quality_measurement", "fades", "quality_control", "slice_files")], "noise gate to checked, classified, faded slices, written if a folder is given"),
        Workflow("AudioIngestion", AUDIO, _steps("intelligent_slicing"), "classified slices in one stage"),
        Workflow("DecentSamplerCreation", AUDIO, [*_steps("onset_detection", "slice_planning", "slice_points", "slicing"), {"stage_name": "sampler_export"}], "slices to a sampler preset"),
        Workflow("VocalChopPerfection", CHOPS, _steps("vocal_perfection"), "evaluated, repaired and tagged vocal chops"),
        Workflow("LoopSearch", AUDIO, _steps("noise_reduction", "loop_detection"), "the best loops of each recording"),
    )


def issue_report(issues) -> object:
    """One comment line of an array of issues, each cut at 100 characters."""
    return F.array_join(F.transform(issues, lambda i: clip_text(i)), "; ")
