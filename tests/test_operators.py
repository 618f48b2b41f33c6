"""Small cases with results worked out by hand."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cratelog import schema
from cratelog.functions import arithmetic, dsp, signal, tags, text
from cratelog.operators import audio, catalogue, chunks, exports, loops, manifest, segments, symbolic, vocal
from cratelog.plans import chain
from cratelog.sources import wav


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("required", "asset", "expected"),
    [
        ("{}", '{"a":1}', False), ("{oops", '{"a":1}', False), ('{"instrument":"Bass"}', '{"instrument":"bass"}', True), ('{"bpm":120}', '{"bpm":120.0}', True),
        ('{"bpm":100}', '{"bpm":1e2}', True), ('{"bpm":"120"}', '{"bpm":120}', False), ('{"x":null}', '{"x":null}', True), ('{"x":null}', "{}", False),
        ('{"t":true}', '{"t":1}', True), ('{"l":["A"]}', '{"l":["a"]}', False), ('{"a":1,"b":"x"}', '{"a":1,"b":"X","c":2}', True), ('{"a":1,"b":"x"}', '{"a":1}', False),
    ],
)
def test_tag_match(spark, required, asset, expected):
    rules = spark.createDataFrame([(1, 1, required)], "project_id int, rule_id int, required_tags_json string")
    assets = spark.createDataFrame([(1, "sample", 5, asset)], "project_id int, kind string, asset_id int, tags_json string")
    assert (manifest.match(rules, assets).count() == 1) is expected


def test_progress_of_projects(spark):
    projects = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    manifests = spark.createDataFrame([(1,), (2,)], "project_id int")
    rules = spark.createDataFrame([(1, 1, 3, '{"a":1}'), (1, 2, 0, '{"b":1}')], "project_id int, rule_id int, target_count int, required_tags_json string")
    assets = spark.createDataFrame([(1, "sample", 9, '{"a":1}'), (1, "midi", 9, "{}")], "project_id int, kind string, asset_id int, tags_json string")
    matches = manifest.match(rules, assets)
    status = manifest.rule_status(rules, matches)
    assert {(r.rule_id, r.progress, r.is_fulfilled) for r in status.collect()} == {(1, 33, False), (2, 100, True)}
    got = {r.project_id: (r.progress, r.message) for r in manifest.project_progress(projects, manifests, status).collect()}
    assert got == {1: (66, None), 2: (100, "no rules"), 3: (0, "no manifest")}
    assert [r.kind for r in manifest.unassigned(assets, matches).collect()] == ["midi"]


def test_tolerant_and_strict_json(spark):
    for bad in (None, "", "{oops", "[1]", "3"):
        assert one(spark, F.to_json(tags.parse(F.lit(bad).cast("string")))) == "{}"
    assert one(spark, tags.merge(F.lit('{"b":1,"a":"x"}'), F.lit('{"b":{"c":2}}'))) == '{"a":"x","b":{"c":2}}'
    assert one(spark, tags.get(F.lit('{"k":null}'), "k", "d")) is None
    assert one(spark, tags.get(F.lit("{}"), "k", "d")) == "d"
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        one(spark, F.to_json(tags.parse_strict(F.lit("{oops"))))


def test_names(spark):
    assert one(spark, text.sanitize(F.lit(" Bässe/№1? "))) == "Bässe__1_"
    assert one(spark, text.sanitize(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, text.sanitize_filename(F.lit("My Synth (2)!.mid"))) == "My_Synth_2.mid"
    assert one(spark, text.stem(F.lit("/a/b.c/take.1.wav"))) == "take.1"
    assert one(spark, text.camel_to_snake(F.lit("SamplePackWorkflow"))) == chain.snake("SamplePackWorkflow") == "sample_pack_workflow"
    assert one(spark, text.bit_depth(F.lit("PCM_24"))) == 24
    assert one(spark, text.bit_depth(F.lit("ULAW"))) is None


def test_one_shots(spark):
    onsets = spark.createDataFrame([(1, t) for t in (0.0, 0.5, 1.0, 1.5, 2.0)] + [(2, 0.0), (2, 0.01)], "recording_id int, t double")
    got = segments.one_shots(onsets).orderBy("recording_id", "segment").collect()
    assert [r.end_time for r in got[:5]] == [0.5, 1.0, 1.5, 2.0, 12.0]
    assert all(r.end_time - r.start_time >= 0.05 - 1e-12 for r in got)
    assert segments.one_shots(onsets.where("false")).count() == 0
    assert segments.whole_loop(spark.createDataFrame([(1, float(t)) for t in range(4)], "recording_id int, t double")).first().asDict() == {"recording_id": 1, "start_time": 0.0, "end_time": 4.0, "type": "loop", "confidence": 0.5}


@pytest.mark.parametrize(("seconds", "ambient", "expected"), [(6.0, 5.0, ("ambient", 0.85)), (1.5, 5.0, ("one_shot", 0.9)), (3.0, 5.0, ("loop", 0.8)), (40.0, 50.0, ("unknown", 0.5))])
def test_duration_class(spark, seconds, ambient, expected):
    assert tuple(one(spark, segments.duration_class(F.lit(seconds), ambient))) == expected


def test_drum_tags(spark):
    drum = segments.drum_type(F.lit(6000.0), F.lit(0.02))
    assert one(spark, segments.drum_tags(drum, F.lit(0.4))) == ["drum", "hihat", "open_hat"]
    assert one(spark, segments.drum_tags(segments.drum_type(F.lit(3000.0), F.lit(0.01)), F.lit(0.1))) == ["perc"]
    assert abs(sum(loops.WEIGHTS.values()) - 1) < 1e-9


def report(spark, y, **k):
    return spark.createDataFrame([([float(v) for v in y],)], "y array<double>").select(signal.quality_report(F.col("y"), **k).alias("r")).first()["r"]


def test_quality_of_signals(spark):
    t = np.arange(4410) / 44100
    tone = report(spark, 0.5 * np.sin(2 * np.pi * 440 * t))
    assert not tone.has_clipping and not tone.is_silent and not tone.has_dc_offset
    assert 0.01 < tone.zero_crossing_rate < 0.05
    assert abs(tone.peak_db - 20 * math.log10(0.5)) < 0.01
    silent = report(spark, np.zeros(2048))
    assert silent.is_silent and silent.score == 0.35
    assert report(spark, []).score == 0.0
    assert report(spark, np.ones(100)).has_clipping
    assert abs(report(spark, np.full(100, 0.1)).dc_offset - 0.1) < 1e-9
    assert report(spark, [0.5]).clip_count == 0


def test_signal_to_noise(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=5000) * np.repeat(rng.random(50), 100)
    frame = 1024
    levels = np.sort(np.sqrt((y[: 4 * frame].reshape(-1, frame) ** 2).mean(axis=1)))
    want = 20 * math.log10(levels[2:].mean() / levels[:1].mean())
    assert abs(report(spark, y).snr_db - want) < 1e-6


def test_shaping(spark):
    y = F.array(*[F.lit(v) for v in (0.1, -0.2, 0.3, -0.4, 0.5)])
    assert one(spark, signal.noise_gate(y, F.lit(-10.0))) == [0, 0, 0, -0.4, 0.5]
    faded = spark.range(1).select(signal.fades(F.array_repeat(F.lit(1.0), 100), 10, 10).alias("x")).first()["x"]
    assert faded[0] == 0 and faded[-1] == 0 and faded[50] == 1 and all(np.diff(faded[:10]) > 0)
    assert max(map(abs, one(spark, signal.normalize(y)))) == pytest.approx(10 ** (-14 / 20))
    spike = [0.0] * 50 + [0.9] + [0.0] * 50
    assert spark.createDataFrame([(spike,)], "y array<double>").select(signal.has_click(F.col("y"))).first()[0]
    assert one(spark, signal.has_click(F.array(F.lit(1.0)))) is False


def test_musical_time(spark):
    assert one(spark, arithmetic.bars_to_beats(F.lit(4), F.lit("6/8"))) == 12
    assert [one(spark, arithmetic.snap(F.lit(v), F.lit(10))) for v in (4, 5, 15, 16)] == [0, 0, 20, 20]
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert [one(spark, arithmetic.cosine(*p)) for p in ((a, a), (a, b), (a, F.array(F.lit(0.0), F.lit(0.0))))] == [1, 0, 0]
    assert one(spark, arithmetic.bar_fit(F.lit(4.0), F.lit(120.0))) > 0.9 > one(spark, arithmetic.bar_fit(F.lit(3.5), F.lit(120.0)))
    assert one(spark, arithmetic.to_db(F.lit(0.0))) == -120
    assert one(spark, arithmetic.clamp(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    ("rows", "least", "expected"),
    [
        ([(0, 2, 0.5), (4, 6, 0.9), (8, 10, 0.7)], 0.3, [0.9, 0.7, 0.5]), ([(0, 2, 0.1), (4, 6, 0.2), (8, 10, 0.8)], 0.5, [0.8]),
        ([(0, 4, 0.9), (0, 4, 0.7)], 0.3, [0.9]), ([(0, 0, 0.9), (0, 0, 0.9)], 0.3, [0.9, 0.9]),
    ],
)
def test_select_best(spark, rows, least, expected):
    frame = spark.createDataFrame([(1, i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], "recording_id int, idx int, start_time double, end_time double, score double")
    got = loops.select_best(frame, least=least).orderBy("rank").collect()
    assert [r.score for r in got] == expected
    assert [r["rank"] for r in got] == list(range(1, len(expected) + 1))


def test_grid_candidates(spark):
    rows = spark.createDataFrame([(1, 8.0, 120.0)], "recording_id int, duration double, bpm double")
    got = loops.grid_candidates(rows).groupBy("bars").count().orderBy("bars").collect()
    assert [(r.bars, r["count"]) for r in got] == [(1, 4), (2, 3), (4, 1)]


def test_vocal_and_symbolic(spark):
    rows = spark.createDataFrame([(1, 0.0, 100.0), (1, 150.0, 200.0), (1, 200.0, 260.0), (2, 0.0, 5.0)], "file_id int, start_ms double, end_ms double")
    got = {r.file_id: (r.stabs, r.average_silence_ms, r.short_gaps) for r in vocal.silence(vocal.gaps(rows)).collect()}
    assert got == {1: (3, 50.0, 2), 2: (1, None, 0)}
    events = spark.createDataFrame([("note", 7, 20, 96), ("note", 90, 20, 96), ("note", 95, 5, 96), ("control", 96, 0, 96)], "kind string, start long, dur long, loop_len long")
    q = symbolic.quantize(events, 12).collect()
    assert [(r.q_start, r.q_dur, r.clipped, r.dropped) for r in q] == [(12, 20, False, False), (96, 0, True, True), (96, 0, True, True), (96, 0, False, True)]
    tries = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.8), (1, 3, 0.9), (2, 1, 0.4), (2, 2, 0.4)], "k int, attempt int, fitness double")
    assert {(r.k, r.attempt) for r in symbolic.best_attempt(tries, "k").collect()} == {(1, 2), (2, 1)}


def test_chain(spark):
    onsets = spark.createDataFrame([(1, 0.0), (1, 0.5)], "recording_id long, t double")
    recordings = spark.createDataFrame([(1, "a", 8000, 80000)], "recording_id long, base string, sample_rate int, n_samples long")
    registry = chain.segmentation(recordings)
    made = registry.run(chain.INTELLIGENT_SLICING, onsets, chain.ONSETS)
    assert made.kind == chain.SAMPLES and made.data.count() == 2
    with pytest.raises(ValueError, match="unknown stage"):
        registry.run([{"stage_name": "nope"}], onsets, chain.ONSETS)
    with pytest.raises(TypeError, match="takes"):
        registry.run([{"stage_name": "slicing"}], onsets, chain.ONSETS)
    assert len(registry.faults([{"stage_name": "slicing"}, {"stage_name": "nope"}], chain.FILE)) == 2


def test_wav_round_trip(spark, tmp_path):
    y = np.sin(np.arange(3000) / 20) * 0.8
    for depth in (16, 24, 32, 8):
        data = wav.encode(y, 8000, depth, {"title": "Übung", "mood": "x"})
        h = wav.header(data)
        assert (h["frames"], h["sample_rate"], h["bit_depth"], h["tags"]) == (3000, 8000, depth if depth > 8 else 24, {"title": "Übung"})
        assert np.abs(wav.decode(data, h)[:, 0] - y).max() < 2.0**-14
    (tmp_path / "a.wav").write_bytes(wav.encode(np.column_stack([y, -y]), 8000, 16))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    heads = {r.path[-5:]: r for r in wav.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.wav"].duration == 0.375 and heads["b.wav"].error
    (tmp_path / "b.wav").unlink()
    rows = wav.read_audio(spark, str(tmp_path), chunk=1000, overlap=10).orderBy("chunk").collect()
    assert [len(r.samples) for r in rows] == [1010, 1010, 1000] and max(map(abs, rows[0].samples)) < 1e-4


def test_kernels(spark):
    rate = 8000
    tone = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    assert np.argmax(dsp.chroma(tone, rate)) == 9
    assert dsp.mfcc(tone, rate).shape[0] == 13
    clicks = np.zeros(8 * rate)
    clicks[:: rate // 2] = 1.0
    clicks = np.convolve(clicks, np.exp(-np.arange(200) / 20))[: 8 * rate]
    assert abs(dsp.tempo(clicks, rate) - 120) < 8
    assert dsp.snap_to_crossing(np.array([1.0, 0.5, -0.1, -1.0]), 0) == 2
    assert dsp.snap_to_crossing(np.array([3.0, 1.0, 2.0]), 0) == 1
    assert dsp.shape(np.zeros(0), rate) == (0.0, 0.0)
    minor = F.array(*[F.lit(float(v)) for v in (9, 0, 0, 5, 1, 0, 0, 4, 0, 0, 0, 0)])
    assert one(spark, audio.key_name(minor)) == "Cm"


def test_catalogue(spark):
    rows = schema.with_defaults("samples", spark.createDataFrame([(1, 7)], "id int, recording_id int"))
    assert rows.schema.simpleString() == schema.TABLES["samples"].simpleString() and rows.first().status == "pending"
    with pytest.raises(Exception, match="is not a project_type"):
        schema.check_enum(spark.createDataFrame([("x",)], "t string"), "t", "project_type").collect()
    tables = {"projects": spark.createDataFrame([(1,), (2,)], "id int"), "recordings": spark.createDataFrame([(5, 1), (6, 2)], "id int, project_id int"), "samples": spark.createDataFrame([(8, 5), (9, 6)], "id int, recording_id int")}
    left = schema.cascade(tables, spark.createDataFrame([(2,)], "id int"))
    assert [r.id for r in left["samples"].collect()] == [9]
    devices = schema.with_defaults("midi_devices", spark.createDataFrame([(3, "A")], "id int, name string"))
    got = catalogue.upsert_devices(devices, spark.createDataFrame([("A",), ("B",), ("B",)], "name string"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    assert {(r.id, r.name) for r in got.collect()} == {(3, "A"), (4, "B")}
    assert 'rootNote="60"' in exports.preset_xml([{"group": "g", "lo_vel": 0, "hi_vel": 127, "path": "a.wav", "root_note": 60, "lo_key": 60, "hi_key": 61}])


def _parses(rows) -> list[int]:
    """How often each line of the optimized plan parses JSON, the last step first."""
    return [line.lower().count("parsejson") for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines()]


def test_tags_are_parsed_once_a_row(spark):
    rows = spark.createDataFrame([('{"a":1}', '{"b":2}')], "a string, b string")
    merged, got = rows.select(tags.merge(F.col("a"), F.col("b"))), rows.select(tags.get(F.col("a"), "k", "d"))
    assert 0 < sum(_parses(merged)) <= 4 and 0 < sum(_parses(got)) <= 2  # its kind and its content


def test_jobs_of_a_rule_read_its_tags_once(spark):
    rules = spark.createDataFrame([(1, "Deep Bass", 3, '{"key":"D","tempo":"99.5"}'), (2, "x", 0, None), (3, "Pad", 1, '{"key":null}')], "rule_id int, name string, target_count int, required_tags_json string")
    jobs = manifest.generation_jobs(rules)
    got = sorted((r.rule_id, r.i, r.label, r.seed, r.key, r.tempo, r.engine) for r in jobs.collect())
    assert got == [(1, i, f"Deep_Bass_v{i + 1}", 42 + i, "D", 99.5, "bass") for i in range(3)] + [(3, 0, "Pad_v1", 42, None, 120.0, "bass")]
    lines = jobs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any(_parses(jobs)[: next(k for k, line in enumerate(lines) if "Generate" in line)])


def test_features_are_made_in_small_pieces(spark, monkeypatch):
    """However many rows a batch has, what is made of them is handed on every few rows."""
    rows, kept = spark.createDataFrame([(1, 8000, [0.5])], "id long, sample_rate int, samples array<double>"), []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: kept.append(f) or self)
    audio.features(rows)
    chunks.mapped(rows, {"n": "bigint"}, lambda y: (len(y),), "samples")
    y = np.random.default_rng(0).uniform(-1, 1, (600, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([8000] * 600, pa.int32()), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "sample_rate", "samples"])
    for made in (list(f([batch])) for f in kept):
        assert len(made) > 1 and max(b.num_rows for b in made) <= 256 and [i for b in made for i in b.column(0).to_pylist()] == list(range(600))
    want = [dsp.mean_spectrum(v) for v in y]
    assert np.allclose([v for b in kept[0]([batch]) for v in b.column(6).to_pylist()], want)


def test_kit_reads_tags_once_for_matching(spark):
    """Planning a kit makes each asset's tags twice, to match them and to have those of a rule's first sample, and few rules are sent to the assets."""
    made, n = spark.sparkContext.accumulator(0), 300

    def tagged(i):
        made.add(1)
        return '{"a":"x","song":"S/1"}' if i % 3 else '{"b":1}'

    asset_id = F.col("id").alias("asset_id")
    assets = spark.range(n).select(F.lit(1).alias("project_id"), F.lit("sample").alias("kind"), asset_id, F.udf(tagged, "string")("id").alias("tags_json"), F.lit(".wav").alias("ext"), F.format_string("/in/%s.wav", "id").alias("file_path"))
    ids = spark.range(1).select(F.lit(1).alias("project_id"), F.lit(7).alias("rule_id"))
    rules = ids.select("*", F.lit("Hits").alias("name"), F.lit(None).cast("string").alias("category"), F.lit('{"a":"X"}').alias("required_tags_json"))
    paths = exports.kit_paths(rules, manifest.match(rules, assets), assets)
    lines = paths._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("BroadcastHashJoin" in line and line.count("tag#") == 2 and "Inner" in line for line in lines)
    got = {r.asset_id: (r.rule_id, r.path) for r in paths.collect()}
    hits = [i for i in range(n) if i % 3]
    assert got == {i: (None, f"Unassigned/{i}.wav") for i in range(0, n, 3)} | {i: (7, f"S_1/Other/Hits_{k}.wav") for k, i in enumerate(hits, 1)}
    assert made.value <= 2 * n
