"""Loop search, repair, kits, metadata and workflows on small made-up audio."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cratelog.functions import dsp, signal
from cratelog.operators import audio, catalogue, exports, loops, ordered, symbolic, vocal
from cratelog.plans import chain
from cratelog.sources import wav

RATE = 8000


@pytest.fixture(scope="module")
def clicks():
    y = np.zeros(16 * RATE // 2)
    y[:: RATE // 2] = 1.0
    return np.convolve(y, np.exp(-np.arange(200) / 20) * np.sin(np.arange(200) / 2))[: len(y)]


@pytest.fixture(scope="module")
def buffers(spark, clicks):
    rows = [(1, RATE, clicks.tolist()), (2, RATE, np.zeros(2 * RATE).tolist()), (3, RATE, [])]
    return spark.createDataFrame(rows, "recording_id long, sample_rate int, samples array<double>").cache()


def test_beats_and_steadiness(clicks):
    found = dsp.beats(clicks, RATE, 120.0)
    assert len(found) >= 12 and np.abs(np.diff(found) - 0.5).max() < 0.1
    assert len(dsp.beats(np.zeros(RATE), RATE, 120.0)) == 0
    assert dsp.steadiness(np.zeros(0)) == 0.3 and dsp.steadiness(np.ones(5)) == 1
    assert [dsp.octave(b) for b in (0, 30, 120, 220)] == [120, 60, 120, 110]
    y = np.array([1.0, 1, 1, -1, -1, 1])
    assert [dsp.crossing_near(y, 1, 3), dsp.crossing_near(y, 4, 2), dsp.crossing_near(y, 1, 1)] == [3, 3, 1]  # of two equally near, the earlier


def test_loop_search(spark, buffers):
    found = loops.search(buffers).orderBy("recording_id", "rank").collect()
    own = [r for r in found if r.recording_id == 1]
    assert 1 <= len(own) <= 5 and [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert own[0].confidence == max(r.confidence for r in own) and own[0].confidence > 0.5
    assert all(r.loop_end > r.loop_start and r.loop_start == int(r.start_time * RATE) for r in found)
    assert not [r for r in found if r.recording_id == 3]
    assert loops.search(buffers, n=1).groupBy("recording_id").count().where("count > 1").isEmpty()
    assert loops.search(buffers.limit(0)).count() == 0


def test_loop_scores_weigh_as_told(spark, buffers):
    none = dict.fromkeys(loops.WEIGHTS, 0.0)
    assert loops.search(buffers, least=0.0, weights=none).where("confidence <> 0").isEmpty()


def test_record(spark, buffers):
    files = buffers.withColumns({"channels": F.lit(1), "bit_depth": F.lit(24)})
    made = audio.described(audio.features(buffers, "recording_id"))
    rows = {r.recording_id: r for r in audio.record(files, made, loops.search(buffers)).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].duration == 8.0 and rows[1].loop_points.rank == 1 and rows[1].loop_candidates
    assert rows[1].is_loop == (rows[1].loop_points.confidence > 0.7)
    assert (rows[2].loudness, rows[2].dynamic_range) == (-120, 0) and rows[3].loudness == -120 and not rows[3].is_loop


def test_levels(spark):
    y = [0.0] * 10 + [0.5] * 90
    got = spark.createDataFrame([(y,), ([0.25, -0.5],), ([],)], "y array<double>").select(signal.loudness(F.col("y")).alias("l"), signal.dynamic_range(F.col("y")).alias("d")).collect()
    assert got[0].l == pytest.approx(20 * math.log10(math.sqrt(0.9) * 0.5)) and got[0].d == 0
    assert got[1].d == pytest.approx(20 * math.log10(0.5 / np.percentile([0.25, 0.5], 5)))
    assert (got[2].l, got[2].d) == (-120, 0)


def test_repair(spark):
    y = np.sin(2 * np.pi * 100 * np.arange(4000) / RATE + 0.1)
    rows = [
        (1, RATE, y.tolist(), [(105, 900), (1500, 1500), (2010, 9000)]), (2, RATE, y.tolist(), []), (3, RATE, y.tolist(), None), (4, RATE, [], [(0, 5)]),
    ]
    files = spark.createDataFrame(rows, "file_id int, sample_rate int, samples array<double>, stabs array<struct<start_sample:int,end_sample:int>>")
    got = {r.file_id: r for r in vocal.repair(files).collect()}
    first, second = got[1].stabs
    assert first.start_sample == 0 and second.start_sample == first.end_sample + 600  # a dropped stab has no silence
    assert len(got[1].samples) == second.end_sample and second.duration_ms == pytest.approx((second.end_sample - second.start_sample) / 8)
    assert got[1].samples[first.end_sample : second.start_sample] == [0.0] * 600
    assert abs(got[1].samples[0]) < 0.1
    assert got[2].samples == y.tolist() == got[3].samples and got[2].stabs == [] and got[4].samples == []
    text = spark.range(1).select(vocal.comment(F.lit(2), F.lit(75.0), F.array(F.lit("x" * 120))).alias("c")).first().c
    assert text.startswith("Stabs: 2; Average silence: 75.0 ms; Issues: " + "x" * 100 + "...")


def test_kits(spark, tmp_path):
    rng = np.random.default_rng(1)
    bodies = {(p, f"Song/Verse/take_{k}.wav"): rng.bytes(3000) for p in (1, 2) for k in range(5)}
    files = spark.createDataFrame([(p, path, b) for (p, path), b in bodies.items()] + [(1, "Song/gone.wav", None), (None, "x", b"x")], "project_id int, path string, content binary")
    assert exports.save_kits(files, str(tmp_path)) == exports.save_kits(files, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.zip", "2.zip"]
    for p in (1, 2):
        z = zipfile.ZipFile(io.BytesIO((tmp_path / f"{p}.zip").read_bytes()))
        assert z.testzip() is None
        assert {n: z.read(n) for n in z.namelist()} == {path: b for (q, path), b in bodies.items() if q == p}
    parts = exports.zip_parts(exports.zip_members(files)).where("project_id = 1").orderBy("at").collect()
    assert len(parts) == 11 and b"".join(p.body for p in parts) == (tmp_path / "1.zip").read_bytes() and all(a.at + len(a.body) == b.at for a, b in zip(parts, parts[1:], strict=False))
    with pytest.raises(ValueError, match="one path"):
        exports.save_kits(files.unionAll(files.where("project_id = 1")), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.zip", "2.zip"] and exports.save_kits(files.limit(0), str(tmp_path)) == 0
    assert spark.range(1).select(exports.midi_content(F.lit("TVRoZA==")).alias("m")).first().m == b"MThd"


def test_generated_rows_are_numbered_in_order(spark):
    """More loops than are sampled for bounds of ranges: still no number is missing or given twice, and both tables agree."""
    n = 60_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = spark.range(0, n, 1, 8).select((n - 1 - F.col("id")).alias("project_id"), F.lit("loop").alias("label"), F.base64(F.encode(F.concat(F.lit("x"), n - 1 - F.col("id")), "UTF-8")).alias("file_data"))
    sessions, rows = exports.generated_rows(files, spark.createDataFrame([(7, "Internal")], "id long, name string"), "Internal", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), 500, 100)
    both = rows.select("id", "capture_session_id", F.col("file_data").cast("string").alias("body")).join(sessions.select(F.col("id").alias("capture_session_id"), "project_id"), "capture_session_id")
    right = (F.col("body") == F.concat(F.lit("x"), "project_id")) & (F.col("id") == F.col("project_id") + 100) & (F.col("capture_session_id") == F.col("project_id") + 500)
    found = both.where(right).count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == n


def test_running_sums_within_keys(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("at"), (F.col("id") % 10).alias("v"))
    got = ordered.running(ordered.runs(rows, "k", "at"), ("k", "at"), ("k",), before=F.col("v"), n=F.lit(1))
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("k", "at", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"), F.count("v").over(w).alias("n"))
    assert sorted(got.select("k", "at", "before", "n").collect()) == sorted(want.collect())


def test_mapping_items_of_one_id(spark):
    """Of two items with one id the first by the next column, in whatever order they come."""
    samples = spark.createDataFrame([(1,), (2,)], "id long")
    rows = [(10, 1, 9, 3, 0, 0, 62), (10, 1, 4, 2, 0, 0, 61), (11, 1, 1, 5, 0, 0, 60), (10, 2, 4, 2, 0, 0, 61), (10, 2, 9, 3, 0, 0, 62)]
    items = spark.createDataFrame(rows, "id long, sample_id long, supplier long, velocity_group_id long, key_range_start int, key_range_end int, root_note int").coalesce(1)
    assert {(r.sample_id, r.velocity_group_id, r.root_note) for r in catalogue.key_zones(samples, items).collect()} == {(1, 2, 61), (2, 2, 61)}


def test_one_large_zip_is_placed_by_many_tasks(spark, tmp_path):
    """No window has all members of a project, and the zip is whole."""
    files = spark.range(0, 3000, 1, 5).select(F.lit(1).alias("project_id"), F.concat(F.lit("Song/Verse/"), "id", F.lit(".txt")).alias("path"), F.encode(F.repeat(F.col("id").cast("string"), F.lit(9)), "UTF-8").alias("content"))
    parts = exports.zip_parts(exports.zip_members(files), folder=str(tmp_path))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert all("run_" in line for line in plan.splitlines() if "Window [" in line and "path#" in line)
    z = zipfile.ZipFile(io.BytesIO(b"".join(p.body for p in parts.orderBy("at").collect())))
    assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {f"Song/Verse/{k}.txt": str(k).encode() * 9 for k in range(3000)}


def test_presets_and_folders(spark):
    rows = spark.createDataFrame([(7, "soft", 0, 63, 60, "a.wav", 60, 62), (7, "loud", 64, 127, 60, "b.wav", 60, 62)], "project_id int, group string, lo_vel int, hi_vel int, root_note int, path string, lo_key int, hi_key int")
    xml = exports.preset_files(rows).first().xml
    assert xml.count("<group ") == 2 and 'path="Samples/b.wav"' in xml
    projects = spark.createDataFrame([(1, "virtual_instrument"), (2, "sample_pack")], "id int, project_type string")
    assert exports.project_folders(projects, "/x").groupBy("project_id").count().orderBy("project_id").collect() == [(1, 8), (2, 3)]
    with pytest.raises(Exception, match="is not a project_type"):
        exports.project_folders(spark.createDataFrame([(1, "opera")], "id int, project_type string"), "/x").collect()


def test_updates_and_lookups(spark, tmp_path):
    rows = spark.createDataFrame([(1, "pending", '{"a":1}'), (2, "pending", None), (3, "done", '{"k":1}')], "id long, status string, metadata_json string")
    patches = spark.createDataFrame([(1, "done", '{"b":2}'), (2, None, '{"c":3}'), (3, None, None), (9, "x", None)], rows.schema)
    got = {r.id: (r.status, r.metadata_json) for r in catalogue.update(rows, patches).collect()}
    assert got == {1: ("done", '{"a":1,"b":2}'), 2: ("pending", '{"c":3}'), 3: ("done", '{"k":1}')}
    devices = spark.createDataFrame([(4, "A"), (5, "B")], "id long, name string")
    assert [r.device_id for r in catalogue.device_ids(devices, spark.createDataFrame([("A",), ("Z",), (None,)], "name string")).collect()] == [4]
    with pytest.raises(Exception, match="none of the named devices"):
        catalogue.device_ids(devices, spark.createDataFrame([("Z",)], "name string")).collect()
    jobs = spark.createDataFrame([(1, 2)], "generation_id long, rendering_id long")
    config = spark.createDataFrame([(1, "g"), (2, "r")], "id long, name string")
    made = catalogue.render_jobs(jobs, config, config).first()
    assert (made.generation.name, made.rendering.name) == ("g", "r")
    with pytest.raises(Exception, match="configuration not found"):
        catalogue.render_jobs(jobs, config, config.limit(0)).collect()
    (tmp_path / "a.wav").write_bytes(wav.encode(np.zeros(800), RATE, 16, {"title": "T"}))
    one = catalogue.ingest(wav.read_headers(spark, str(tmp_path)), 7, 100, F.current_timestamp()).first()
    assert (one.id, one.project_id, one.duration, one.status) == (100, 7, 0.1, "uploaded")
    (tmp_path / "a.wav").write_bytes(b"no")
    with pytest.raises(Exception, match="not readable"):
        catalogue.ingest(wav.read_headers(spark, str(tmp_path)), 7, 100, F.current_timestamp()).collect()


def test_loop_entries_and_stand_ins(spark):
    rows = spark.createDataFrame([("L_v1", 120.0, "C", "4/4", 4, "bass", 11, 2.0, '{"key":"D"}')], "label string, tempo double, key string, meter string, bars int, engine string, midi_file_id long, tail double, tags_json string")
    got = {r.kind: r for r in catalogue.loop_entries(rows).collect()}
    assert got["sample"].duration == 10.0 and '"key":"D"' in got["sample"].metadata_json and '"engine":"bass"' in got["recording"].metadata_json
    jobs = symbolic.variations(spark.createDataFrame([("x", 42, 16)], "label string, seed long, beats int"), 3)
    assert [(r.label, r.seed) for r in jobs.orderBy("seed").collect()] == [("x_var1", 42), ("x_var2", 43), ("x_var3", 44)]
    notes = symbolic.stand_in_notes(jobs, voices=2)
    assert sorted(notes.collect()) == sorted(symbolic.stand_in_notes(jobs, voices=2).collect())
    fit = symbolic.fitness(notes, "label").collect()
    assert len(fit) == 3 and all(0 < r.fitness <= 1 for r in fit)


def test_workflows(spark, buffers):
    recordings = buffers.select("recording_id", F.lit("take").alias("base"), "sample_rate", F.size("samples").cast("long").alias("n_samples"))
    flows = chain.workflows(recordings, buffers)
    made = flows.run("SamplePack", buffers, {"quality_control": {"least": 0.0}})
    assert made.kind == chain.SAMPLES and made.stages[0] == "noise_reduction"
    rows = made.data.collect()
    assert rows and {r.recording_id for r in rows} == {1} and all(len(r.samples) == r.last_sample - r.first_sample for r in rows)
    assert flows.run("audio_ingestion", buffers).data.count() == flows.run("example_slicing", buffers).data.count() > 0
    assert flows.run("loop_search", buffers).kind == chain.LOOPS
    with pytest.raises(ValueError, match="unknown workflow"):
        flows.run("nope", buffers)
    with pytest.raises(TypeError, match="is not a Workflow"):
        flows.add("nope")


def test_issue_report(spark):
    got = spark.range(1).select(chain.issue_report(F.array(F.lit("short"), F.lit("y" * 101))).alias("r")).first().r
    assert got == "short; " + "y" * 100 + "..."
