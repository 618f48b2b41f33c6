"""Cases in which a rule's wording matters: bins that clash, clipped notes, limits, names, files and workflows."""

import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelog.functions import dsp, signal, text
from cratelog.operators import audio, catalogue, exports, loops, segments, spectral, symbolic, vocal
from cratelog.plans import chain
from cratelog.sources import wav

RATE = 8000


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def floats(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_clash_takes_the_loudest_bin_of_the_other(spark):
    got = one(spark, spectral.clash(floats(0.25, 1), floats(1, 0.5)))
    assert (got.bin, got.strength) == (0, 1.0)
    assert one(spark, spectral.clash(floats(0.1, 1), floats(1, 0.2))) is None


def test_quantize_bounds(spark):
    rows = spark.createDataFrame([("control", 3790, 0, 3840), ("control", 3840, 0, 3840), ("note", 3600, 360, 3840), ("note", 3600, 359, 3840), ("note", 3900, 10, 3840)], "kind string, start long, dur long, loop_len long")
    strict = [(r.q_start, r.q_dur, r.clipped, r.dropped) for r in symbolic.quantize(rows, 120).collect()]
    assert strict == [(3790, 0, False, False), (3840, 0, False, True), (3600, 240, True, False), (3600, 240, True, False), (3840, 0, True, True)]
    loose = [(r.q_dur, r.clipped, r.dropped) for r in symbolic.quantize(rows, 120, strict=False).collect()]
    assert loose == [(0, False, False), (0, False, False), (360, False, False), (240, True, False), (0, True, True)]


def test_fitness_of_no_notes(spark):
    notes = spark.createDataFrame([(1, 0, 960, 3840, 3840)], "k int, start long, dur long, loop_len long, whole long")
    got = {r.k: r.fitness for r in symbolic.fitness(notes, "k", spark.createDataFrame([(1,), (2,)], "k int")).collect()}
    assert got == {1: 0.7, 2: 0.0}


def test_beat_alignment_clamps_each_end(spark):
    assert one(spark, loops.beat_alignment(F.lit(0.0), F.lit(6.0), floats(0, 1, 2, 3))) == 0.5
    assert one(spark, loops.beat_alignment(F.lit(0.0), F.lit(6.0), F.array().cast("array<double>"))) == 0.3


def test_proposed_limits(spark):
    columns = "category string, min_centroid double, max_centroid double, min_flatness double"
    of = lambda *rows: tuple(segments.propose_cuts(spark.createDataFrame(rows, columns)).first())
    assert of(("kick", 100.0, 900.0, 0.0), ("snare", 1500.0, 3000.0, 0.02), ("hihat", 5000.0, 9000.0, 0.3)) == (1200.0, 4000.0, pytest.approx(0.018))
    assert of(("kick", 100.0, 900.0, 0.0), ("tom", 500.0, 1000.0, 0.0)) == (None, None, None)
    assert of(("hihat", 5000.0, 9000.0, 0.3)) == (None, 4000.0, None)


@pytest.mark.parametrize(("name", "key"), [("My_Class", "my_class"), ("a__b", "a_b"), ("VST3PluginStage", "vst3_plugin_stage"), ("SamplePack", "sample_pack")])
def test_snake(spark, name, key):
    assert chain.snake(name) == key == one(spark, text.camel_to_snake(F.lit(name)))


def test_measured_noise_of_zero_is_an_issue(spark):
    flat = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.when(i % 2 == 0, 0.5).otherwise(-0.5))
    assert "low snr" in one(spark, signal.quality_report(flat))["issues"]
    short = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.when(i % 2 == 0, 0.5).otherwise(-0.5))
    assert "low snr" not in one(spark, signal.quality_report(short))["issues"]


def test_preset_keeps_empty_groups(spark):
    rows = spark.createDataFrame([(7, "soft", 0, 63, 60, "/x/a.wav", 60, 62), (7, "loud", 64, 127, None, None, None, None)], "project_id int, group string, lo_vel int, hi_vel int, root_note int, path string, lo_key int, hi_key int")
    xml = exports.preset_files(rows).first().xml
    assert xml.count("<group ") == 2 and 'path="Samples/a.wav" rootNote="60" loKey="60" hiKey="62"' in xml


def test_midi_files(spark):
    notes = spark.createDataFrame([("a", 0, 480, 60, 90), ("a", 480, 480, 60, 90), ("b", 200, 1, 64, 1)], "label string, start long, dur long, pitch int, velocity int")
    got = {r.label: r for r in exports.midi_files(notes, "label").collect()}
    body = bytes(got["a"].midi)
    assert body[:14] == b"MThd" + struct.pack(">IHHH", 6, 0, 1, 960) and base64.b64decode(got["a"].file_data) == body
    assert body[22:] == bytes([0, 0x90, 60, 100, 0x83, 0x60, 0x80, 60, 0, 0, 0x90, 60, 100, 0x83, 0x60, 0x80, 60, 0, 0, 0xFF, 0x2F, 0])
    assert struct.unpack(">I", body[18:22])[0] == len(body) - 22


def test_guards_and_orders(spark):
    projects = spark.createDataFrame([(1, "sample_pack"), (2, None)], "id long, project_type string")
    with pytest.raises(Exception, match="not a construction_kit"):
        catalogue.of_type(projects, "construction_kit").collect()
    assert catalogue.of_type(projects.where("id = 1"), "sample_pack").count() == 1
    files = spark.createDataFrame([(1, 5, "2024-01-02"), (2, 5, "2024-01-01"), (3, 6, "2024-01-01")], "id long, capture_session_id long, created_at string")
    assert [r.id for r in catalogue.midi_files_of(files, 5).collect()] == [2, 1]
    assert catalogue.first_of(files).first().id == 1


def test_aiff(spark, tmp_path):
    y = (np.sin(np.arange(500) / 9) * 20_000).astype(">i2")
    comm = struct.pack(">hIh", 1, 500, 16) + struct.pack(">hQ", 16383 + 12, 8000 << 51)
    ssnd = struct.pack(">II", 0, 0) + y.tobytes()
    body = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(ssnd)) + ssnd
    (tmp_path / "a.aiff").write_bytes(b"FORM" + struct.pack(">I", len(body)) + body)
    (tmp_path / "b.wav").write_bytes(wav.encode(y / 32768, 8000, 16))
    rows = {r.path[-6:]: r for r in wav.whole(wav.read_audio(spark, str(tmp_path), chunk=64)).collect()}
    assert rows["a.aiff"[-6:]].sample_rate == 8000 and len(rows["a.aiff"[-6:]].samples) == 500
    assert np.allclose(rows["a.aiff"[-6:]].samples, y / 32768, atol=1e-6) and np.allclose(rows["/b.wav"[-6:]].samples, y / 32768, atol=1e-4)


def test_resampled_tone():
    y = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    up = dsp.resample(y, 8000, 11_025)
    want = np.sin(2 * np.pi * 440 * np.arange(len(up)) / 11_025)
    assert len(up) == 11_025 and np.abs(up - want)[200:-200].max() < 0.01
    assert np.abs(dsp.resample(np.sin(2 * np.pi * 3500 * np.arange(8000) / 8000), 8000, 4000))[100:-100].max() < 0.05


def test_kernels_in_blocks():
    y = np.random.default_rng(0).normal(size=60_000)
    whole = np.concatenate(list(dsp.spectra(y, 2048, 512, block=10_000)), axis=1)
    parts = np.concatenate(list(dsp.spectra(y, 2048, 512, block=7)), axis=1)
    assert np.allclose(whole, parts) and np.allclose(dsp.mean_spectrum(y), whole.mean(axis=1))
    x = np.random.default_rng(1).random(400)
    plain, last = [], -6
    for i, v in enumerate(x):
        if v == x[max(0, i - 5) : i + 6].max() and v >= x[max(0, i - 10) : i + 11].mean() + 0.07 and i - last > 5:
            plain.append(i)
            last = i
    assert dsp.pick_peaks(x).tolist() == plain


def test_export_is_distributed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 8000, [0.0, 0.5], {"title": "x"}), ("b", 8000, [0.1], None)], "name string, sample_rate int, samples array<double>, about map<string,string>")
    files = wav.to_wav(rows, 16, "about")
    assert wav.export(files, str(tmp_path)) == wav.export(files, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    assert wav.header((tmp_path / "a.wav").read_bytes())["tags"] == {"title": "x"}


@pytest.fixture(scope="module")
def hits(spark):
    y = np.zeros(4 * RATE)
    for k in range(4):
        y[k * RATE : k * RATE + 1000] = np.sin(2 * np.pi * 60 * np.arange(1000) / RATE) * np.exp(-np.arange(1000) / 300)
    return spark.createDataFrame([(1, RATE, y.tolist())], "recording_id long, sample_rate int, samples array<double>")


def test_classification_hears_the_segments(spark, hits):
    rows = spark.createDataFrame([(1, 0.0, 0.12), (1, 1.0, 1.12), (1, 9.0, 9.5)], "recording_id long, start_time double, end_time double")
    got = {r.start_time: r for r in chain.segmentation(None, hits).run([{"stage_name": "segment_classification"}], rows, chain.SEGMENTS).data.collect()}
    assert got[0.0].instrument_type == "kick" and got[0.0].tags[:3] == ["one_shot", "drum", "kick"] and got[0.0].character == "tonal"
    assert got[9.0].type == "one_shot" and got[9.0].instrument_type is None and got[9.0].tags is None  # no audio there


def test_preset_and_faded_workflows(spark, hits):
    recordings = hits.select("recording_id", F.lit("take").alias("base"), "sample_rate", F.size("samples").cast("long").alias("n_samples"))
    flows = chain.workflows(recordings, hits)
    made = flows.run("DecentSamplerCreation", hits)
    xml = made.data.first().xml
    assert made.kind == chain.PRESETS and xml.count("<sample ") >= 3 and 'path="Samples/take_slice_001.wav" rootNote="60"' in xml
    cut = segments.measured(segments.slices(spark.createDataFrame([(1, 0, 0.0, 1.0)], "recording_id long, idx int, start_time double, end_time double"), recordings), hits)
    faded = chain.segmentation(recordings, hits).run([{"stage_name": "fades"}], cut, chain.SAMPLES).data.first().samples
    assert faded[0] == 0 and faded[-1] == 0 and len(faded) == RATE
    deep = chain.merged({"a": {"x": 1, "y": 2}, "b": 1, "c": {"z": 1}}, {"a": {"y": 3}, "c": {}}, ("a",))
    assert deep == {"a": {"x": 1, "y": 3}, "b": 1, "c": {}}
    picky = flows.run("ExampleSlicing", hits, {"onset_detection": {"detection_params": {"delta": 2.0}}})
    assert picky.data.count() == 0 < flows.run("ExampleSlicing", hits).data.count()


def test_vocal_chops(spark, hits):
    files = hits.select(F.col("recording_id").alias("file_id"), F.lit("/in/chop_denoised.wav").alias("name"), "sample_rate", "samples", F.array(F.lit("ah")).alias("labels"), F.create_map(F.lit("title"), F.lit("t"), F.lit("comment"), F.lit("old")).alias("tags"))
    judged = vocal.evaluate(files).first()
    assert len(judged.stabs) >= 3 and judged.average_silence_ms == 0.0 and "no silence or overlap" in judged.issues and "cue labels missing" not in judged.issues
    made = chain.workflows().run("vocal_chop_perfection", files)
    row = made.data.first()
    assert row.name == "chop_perfected" and row.tags["title"] == "t" and row.tags["comment"].startswith("Stabs: ") and len(row.samples) > 0
    assert wav.header(bytes(wav.to_wav(made.data, tags="tags").first().wav))["tags"]["comment"] == row.tags["comment"]


def test_crossings_and_features_of_empty_buffers(spark):
    rows = spark.createDataFrame([(1, 0, RATE, []), (2, 1, RATE, [1.0, 0.5, -0.1])], "id long, p int, sample_rate int, samples array<double>")
    assert {r.id: (r.quiet, r.after) for r in audio.crossings(rows, "p").collect()} == {1: (0, 0), 2: (2, 2)}
    assert {r.id: r.centroid for r in audio.segment_features(rows, "id").collect()}[1] == 0.0
