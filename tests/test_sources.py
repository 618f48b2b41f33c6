"""Audio files in byte ranges, what files say beside their samples, rarest tags, many loops."""

import bisect
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelog.operators import loops, manifest, vocal
from cratelog.sources import audio_files, riff, wav


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("audio"), np.random.default_rng(3)
    made = {"a.wav": (r.uniform(-1, 1, 5000), 16), "sub/b.wav": (r.uniform(-1, 1, (3000, 2)), 24), "c.wav": (np.zeros(0), 16)}
    (d / "sub").mkdir()
    for name, (y, depth) in made.items():
        (d / name).write_bytes(wav.encode(y, 8000, depth, {"title": name}, riff.write([{"id": 1, "at": 5, "label": "ah"}])))
    (d / "bad.wav").write_bytes(b"nonsense")
    (d / "notes.txt").write_bytes(b"x")
    return d, made


@pytest.mark.parametrize(("chunk", "split"), [(100, 64), (1000, 777), (999, 1 << 20), (1 << 18, 50)])
def test_ranges_cover_every_frame_once(spark, folder, chunk, split):
    d, made = folder
    rows = wav.read_audio(spark, str(d), "[abc].wav", chunk=chunk, split=split)
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.removeprefix(f"{d}/"), []).append(r)
    for name in ("a.wav", "sub/b.wav"):
        parts = sorted(got[name], key=lambda r: r.first_frame)
        assert [p.chunk for p in parts] == list(range(len(parts))) and [p.first_frame for p in parts] == [k * chunk for k in range(len(parts))]
        y = np.concatenate([p.samples for p in parts])
        want = made[name][0] if made[name][0].ndim == 1 else made[name][0].mean(axis=1)
        assert np.allclose(y, want, atol=1e-4)
    assert len(got["c.wav"]) == 1 and got["c.wav"][0].samples == []
    if split < 100:
        assert rows.rdd.getNumPartitions() > 100


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Ranges of a file are dealt to different tasks, but there are no more tasks than TASKS for small files."""
    for k in range(400):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.full(64, k / 400), 8000, 16))
    rows, heads = wav.read_audio(spark, str(tmp_path), chunk=16, split=100), wav.read_headers(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == heads.rdd.getNumPartitions() == audio_files.TASKS
    got = rows.groupBy("path").agg(F.sum(F.size("samples")).alias("n"), F.count("*").alias("chunks"))
    assert got.where("n = 64 AND chunks = 4").count() == got.count() == heads.where("frames = 64 AND error IS NULL").count() == 400
    parts = audio_files._Reader({"path": str(tmp_path), "split": "100"}, False).partitions()
    assert all(len({r.path for r in p.ranges}) == len(p.ranges) for p in parts)


def test_filters_are_applied_before_reading(spark, folder, monkeypatch):
    d, _ = folder
    rows = wav.read_audio(spark, str(d), "[ab].wav", chunk=1000)
    some = rows.where((F.col("path") == f"{d}/a.wav") & (F.col("first_frame") >= 2000) & (F.col("first_frame") < 4000))
    assert sorted(r.first_frame for r in some.collect()) == [2000, 3000]
    reader = audio_files._Reader({"path": str(d), "glob": "*.wav", "chunk": "1000"}, False)
    left = list(reader.pushFilters([audio_files.EqualTo(("path",), f"{d}/a.wav"), audio_files.GreaterThanOrEqual(("first_frame",), 2000), audio_files.LessThan(("chunk",), 3)]))
    assert [f.attribute for f in left] == [("chunk",)]
    (part,) = reader.partitions()
    assert part.path.endswith("a.wav") and [b.column(2)[0].as_py() for b in reader.read(part)] == [2000, 3000, 4000]


def test_headers_read_little(spark, folder, tmp_path):
    d, _ = folder
    rows = {r.path.removeprefix(f"{d}/"): r for r in wav.read_headers(spark, str(d)).collect()}
    assert set(rows) == {"a.wav", "sub/b.wav", "c.wav", "bad.wav"}
    assert (rows["sub/b.wav"].channels, rows["sub/b.wav"].bit_depth, rows["sub/b.wav"].frames, rows["a.wav"].tags) == (2, 24, 3000, {"title": "a.wav"})
    assert rows["bad.wav"].error and rows["bad.wav"].frames is None and rows["a.wav"].duration == 5000 / 8000
    big = wav.encode(np.zeros(2_000_000), 8000, 16, {"title": "big"})

    class Counting:
        def __init__(self):
            self.at = self.n = 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.n += n
            self.at += n
            return big[self.at - n : self.at]

    f = Counting()
    h = audio_files.read_header(f, len(big))
    assert h["frames"] == 2_000_000 and h["tags"] == {"title": "big"} and f.n < 4096


MARKERS = [{"id": 7, "at": 100, "label": "ah", "note": "soft", "length": 50, "purpose": "rgn", "text": "vérse"}, {"id": 2, "at": 900, "label": " ", "note": None, "length": None, "purpose": None, "text": None}, {"id": 3, "at": 40, "label": "oh", "note": None, "length": None, "purpose": None, "text": None}]
SAMPLER = {"unity_note": 60, "pitch_fraction": 5, "period_ns": 22675, "loops": [{"id": 0, "type": 0, "start": 10, "end": 500, "fraction": 0, "count": 0}, {"id": 1, "type": 1, "start": 20, "end": 30, "fraction": 1, "count": 4}]}
INSTRUMENT = {"unshifted_note": 60, "fine_tune": -3, "gain": -6, "low_note": 10, "high_note": 100, "low_velocity": 1, "high_velocity": 127}


def test_marks_there_and_back(spark):
    data = wav.encode(np.zeros(1000), 8000, 16, {"title": "t"}, riff.write(MARKERS, SAMPLER, INSTRUMENT))
    assert wav.header(data)["tags"] == {"title": "t"} and wav.header(data)["frames"] == 1000
    found = riff.marks(riff.walk(data, 12, len(data)))
    assert found == {"markers": sorted(MARKERS, key=lambda m: m["at"]), "sampler": SAMPLER, "instrument": INSTRUMENT}
    rows = spark.createDataFrame([("a", data), ("b", b"RIFF"), ("c", data[:60]), ("d", None)], "path string, content binary")
    got = {r.path: r for r in riff.marked(rows).collect()}
    assert [m.asDict() for m in got["a"].markers] == found["markers"] and got["a"].sampler.asDict(True) == SAMPLER and got["a"].instrument.asDict() == INSTRUMENT
    assert got["a"].labels == ["oh", "ah"] and got["b"].labels == got["c"].labels == got["d"].labels == [] and got["b"].sampler is None
    issues = riff.marked(rows).select("path", vocal.metadata_issues(F.lit(120.0), F.lit("C"), F.col("labels")).alias("issues"))
    assert {r.path: r.issues for r in issues.collect()} == {"a": [], "b": ["cue labels missing"], "c": ["cue labels missing"], "d": ["cue labels missing"]}
    assert riff.write() == b""


def test_rules_meet_assets_on_their_rarest_tag(spark):
    """A tag that every asset has makes no pairs for rules that also ask for a rare one."""
    n = 2000
    assets = spark.range(n).select(F.lit(1).alias("project_id"), F.lit("sample").alias("kind"), F.col("id").alias("asset_id"), F.to_json(F.struct(F.lit("yes").alias("common"), F.lit(1).alias("also"), F.concat(F.lit("n"), F.col("id")).alias("name"))).alias("tags_json"))
    rules = spark.range(300).select(F.lit(1).alias("project_id"), F.col("id").alias("rule_id"), F.to_json(F.struct(F.lit("YES").alias("common"), F.lit(1.0).alias("also"), F.concat(F.lit("N"), F.col("id")).alias("name"))).alias("required_tags_json"))
    more = spark.createDataFrame([(1, 1000, '{"common": "yes"}'), (1, 1001, '{"common": "yes", "none": 1}'), (1, 1002, "{}"), (2, 1003, '{"common": "yes"}')], "project_id int, rule_id long, required_tags_json string")
    found = manifest.match(rules.unionAll(more), assets)
    counts = {r.rule_id: r["count"] for r in found.groupBy("rule_id").count().collect()}
    assert counts == {**dict.fromkeys(range(300), 1), 1000: n}
    assert manifest.meetings(rules.unionAll(more), assets).count() == 300 + n


def plain_best(rows, n, overlap):
    chosen = []
    for s, a, b in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(chosen) < n and all(min(b - a, d - c) <= 0 or (min(b, d) - max(a, c)) / min(b - a, d - c) <= overlap for _, c, d in chosen):
            chosen.append((s, a, b))
    return chosen


def test_intervals_in_an_index(spark):
    r = random.Random(7)
    rows = [(k % 3, i, a, a + r.choice([0.0, 0.5, 1, 2, 4, 8, 30]), r.random()) for k in range(3) for i, a in enumerate(r.uniform(0, 200) for _ in range(300))]
    frame = spark.createDataFrame(rows, "recording_id long, idx int, start_time double, end_time double, score double")
    for n, overlap in ((5, 0.5), (1000, 0.5), (1000, 0.0)):
        got = loops.select_best(frame, n=n, least=0.3, overlap=overlap).collect()
        for k in range(3):
            own = sorted((g for g in got if g.recording_id == k), key=lambda g: g["rank"])
            want = plain_best([(s, a, b) for key, _, a, b, s in rows if key == k and s >= 0.3], n, overlap)
            assert [g["rank"] for g in own] == list(range(1, len(own) + 1)) and [(g.score, g.start_time, g.end_time) for g in own] == want
    chosen, began = loops.Chosen(0.5), time.time()
    spans = [(r.uniform(0, 1e6), r.choice([1, 2, 4, 8, 16])) for _ in range(200_000)]
    assert sum(chosen.add(a, a + n) for a, n in spans) > 50_000 and time.time() - began < 30
    assert all(list(s) == sorted(s) and bisect.bisect(s, -1) == 0 for s, _ in chosen.classes.values())
