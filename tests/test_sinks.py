"""Files, tables and kits that are written, and what may not happen to them."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelog.functions import dsp, filters
from cratelog.operators import chunks, exports, segments
from cratelog.plans import chain
from cratelog.sources import files, tables, wav

from .test_chunks import direct


def tree(path):
    return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_names_keep_their_folders(spark, tmp_path):
    rows = spark.createDataFrame([(n, 8000, [0.5]) for n in ("a/take_slice_001", "b/take_slice_001", "take_slice_001", "/c/./x")], "name string, sample_rate int, samples array<double>")
    assert wav.export(wav.to_wav(rows, 16), str(tmp_path)) == 4
    assert set(tree(tmp_path)) == {"a/take_slice_001.wav", "b/take_slice_001.wav", "take_slice_001.wav", "c/x.wav"}
    before = tree(tmp_path)
    with pytest.raises(ValueError, match="one file: take_slice_001.wav"):
        wav.export(wav.to_wav(rows.unionAll(rows.where("name = 'take_slice_001'")), 24), str(tmp_path))
    assert tree(tmp_path) == before and not list(tmp_path.glob("_staging*"))
    with pytest.raises(Exception, match="not a name below"):
        wav.export(wav.to_wav(rows.withColumn("name", F.lit("../x")).limit(1)), str(tmp_path))
    assert files.write(rows.select("name", F.lit(b"x").alias("body")).limit(0), str(tmp_path)) == 0
    assert files.write(spark.createDataFrame([("u", b"1")], "name string, body binary"), f"file://{tmp_path}") == 1 and (tmp_path / "u").read_bytes() == b"1"


def test_tables(spark, tmp_path):
    at, schema = str(tmp_path / "rules"), "id long, name string, manifest_id long"
    rows = spark.createDataFrame([(k, f"r{k}", k % 3) for k in range(9)], schema)
    assert tables.read(spark, at, schema).count() == 0
    tables.append(rows, at, "manifest_id")
    before = tree(tmp_path / "rules")
    tables.replace_partitions(spark.createDataFrame([(100, "new", 1)], schema), at, "manifest_id", [1])
    after = tree(tmp_path / "rules")
    kept = {k: v for k, v in before.items() if "manifest_id=1" not in k}
    assert {k: v for k, v in after.items() if "manifest_id=1" not in k} == kept
    assert sorted(r.id for r in tables.read(spark, at, schema).collect()) == [0, 2, 3, 5, 6, 8, 100]
    tables.replace_partitions(rows.limit(0), at, "manifest_id", [1])
    assert sorted(r.id for r in tables.read(spark, at, schema).collect()) == [0, 2, 3, 5, 6, 8]
    assert {k: v for k, v in tree(tmp_path / "rules").items()} == kept
    with pytest.raises(ValueError, match="not among"):
        tables.replace_partitions(rows, at, "manifest_id", [0])
    for _ in range(2):  # a repeated call changes nothing
        tables.upsert(spark.createDataFrame([(3, "changed", 0), (33, "added", 0)], schema), at, "manifest_id", "id")
        assert sorted((r.id, r.name) for r in tables.read(spark, at, schema).collect()) == sorted([(0, "r0"), (2, "r2"), (3, "changed"), (5, "r5"), (6, "r6"), (8, "r8"), (33, "added")])
    assert {k: v for k, v in tree(tmp_path / "rules").items() if "manifest_id=2" in k} == {k: v for k, v in kept.items() if "manifest_id=2" in k}
    with pytest.raises(ValueError, match="one key"):
        tables.upsert(rows.unionAll(rows), at, "manifest_id", "id")
    assert [p.name for p in tmp_path.iterdir()] == ["rules"]


def test_equalized_kit(spark):
    """A pad under a bass loses its lows and what the bass masks; the bass, a lone stem and what is unassigned stay as they are."""
    t = np.arange(6000) / 44_100
    pad, bass = 0.3 * np.sin(2 * np.pi * 220 * t) + 0.3 * np.sin(2 * np.pi * 60 * t), 0.6 * np.sin(2 * np.pi * 220 * t)
    low, half = 0.5 * np.sin(2 * np.pi * 220 * t), 0.4 * np.sin(2 * np.pi * 220 * np.arange(3000) / 22_050)
    rows = [
        (1, "Song/Verse/Pad_1.wav", wav.encode(pad, 44_100, 24)), (1, "Song/Verse/Bass_1.wav", wav.encode(bass, 44_100, 16)), (1, "Song/Verse/notes.mid", b"MThd"), (1, "Song/Chorus/Pad_1.wav", wav.encode(pad, 44_100, 16)),
        (1, "Unassigned/Pad.wav", wav.encode(pad, 44_100, 16)), (2, "Song/Verse/Vocal_1.wav", wav.encode(low, 44_100, 16)), (2, "Song/Verse/Pad_2.wav", wav.encode(half, 22_050, 16)), (1, "Song/Verse/broken.wav", b"RIFF"), (1, "Song/Verse/none.wav", None),
    ]
    files_ = spark.createDataFrame(rows, "project_id int, path string, content binary")
    made = {(r.project_id, r.path): r.content for r in exports.equalized_kit(files_).collect()}
    assert len(made) == len(rows)
    changed = {(1, "Song/Verse/Pad_1.wav"), (2, "Song/Verse/Pad_2.wav"), (2, "Song/Verse/Vocal_1.wav")}
    for p, path, content in rows:
        if (p, path) not in changed:
            assert (made[(p, path)] if content is None else bytes(made[(p, path)])) == content
    read = lambda p, path: wav.decode(bytes(made[(p, path)]), wav.header(bytes(made[(p, path)])))[:, 0]
    spectrum = dsp.mean_spectrum(wav.decode(rows[0][2], wav.header(rows[0][2]))[:, 0])
    other = dsp.mean_spectrum(bass)
    clash = int(np.argmax(np.where((other / other.max() > 0.3) & (spectrum / spectrum.max() > 0.2), other, 0)))
    want = direct(pad, filters.sections([("highpass", 100.0, 0.0), ("peak", clash * 44_100 / 2048, -3.0)], 44_100))
    assert np.allclose(read(1, "Song/Verse/Pad_1.wav"), want, atol=1e-4)
    assert np.allclose(read(2, "Song/Verse/Vocal_1.wav"), direct(low, filters.sections([("highpass", 100.0, 0.0)], 44_100)), atol=1e-4)
    assert wav.header(bytes(made[(2, "Song/Verse/Pad_2.wav")]))["sample_rate"] == 44_100 and len(read(2, "Song/Verse/Pad_2.wav")) == 6000


def test_joined_and_aiff(spark):
    y = np.random.default_rng(0).uniform(-1, 1, 1000)
    rows = spark.createDataFrame([("a", k, 8000, y[k : k + 300].tolist()) for k in range(0, 1000, 300)], "key string, first_frame long, sample_rate int, samples array<double>")
    assert bytes(wav.joined(rows, "key", 16).first().wav) == wav.encode(y.astype(np.float32), 8000, 16)
    import struct

    body = struct.pack(">II", 5, 0) + b"junk!" + np.array([1, -2, 3], ">i2").tobytes()
    aiff = b"FORM" + struct.pack(">I", 0) + b"AIFF" + b"COMM" + struct.pack(">IhIhHQ", 18, 1, 3, 16, 16383 + 13, 8000 << 50) + b"SSND" + struct.pack(">I", len(body)) + body
    assert np.allclose(wav.decode(aiff, wav.header(aiff))[:, 0] * 32768, [1, -2, 3])


def test_zip_numbers_beyond_four_gigabytes():
    """Members past 4 GiB, and more of them than 16 bits can count."""
    path, body = "é/a.txt", b"hello" * 100
    member, check, packed = exports._deflated(path, body)
    entry = exports._listed(path, check, packed, len(body), 1 << 33)
    assert len(entry) == 46 + len(path.encode()) + 12
    whole = member + exports._listed(path, check, packed, len(body), 0)
    end = exports._closing(1, len(whole) - len(member), len(member))
    assert zipfile.ZipFile(io.BytesIO(whole + end)).read(path) == body
    assert len(exports._closing(70_000, 10, 10)) == 22 + 56 + 20


def test_slices_in_files(spark, tmp_path):
    """The workflow's slices are on disk, begin and end at 0, are at full scale, and there are as many as rows."""
    rate = 8000
    y = np.zeros(3 * rate)
    for k in range(6):
        y[k * rate // 2 + 50 : k * rate // 2 + 1050] = 0.4 * np.sin(np.arange(1000) / 3) * np.exp(-np.arange(1000) / 300)
    buffers = spark.createDataFrame([(k, rate, y.tolist()) for k in (1, 2)], "recording_id long, sample_rate int, samples array<double>")
    recordings = buffers.select("recording_id", F.lit("take").alias("base"), "sample_rate", F.size("samples").cast("long").alias("n_samples"))
    made = chain.workflows(recordings, buffers).run("SliceFiles", buffers, {"slice_files": {"folder": str(tmp_path)}, "onset_detection": {"sr": None}}).data
    paths = sorted(r.file_path for r in made.select("file_path").collect())
    assert len(paths) >= 8 and paths == sorted(str(p) for p in tmp_path.rglob("*.wav")) and {p.split("/")[-2] for p in paths} == {"1", "2"}
    for p in paths:
        data = open(p, "rb").read()
        h = wav.header(data)
        z = wav.decode(data, h)[:, 0]
        assert (h["bit_depth"], h["sample_rate"]) == (24, rate) and z[0] == 0 == z[-1] and np.isclose(np.abs(z).max(), 1, atol=1e-6) and h["frames"] >= 800
    assert "fades" in [s["stage_name"] for s in chain.workflows().workflows["sample_pack"].chain]
    points = spark.createDataFrame([(1, 0, '{"start": 0.5, "end": 1.0}', 9.0, 9.5), (1, 1, '{"start_time": 1.0, "end_time": 1.5, "end": null}', 9.0, 9.5), (1, 2, '{"start_time": 1.0, "end_time": 1.5}', 0.0, 0.5)], "recording_id long, idx int, point string, start_time double, end_time double")
    cut = chain.segmentation(recordings, buffers).run([{"stage_name": "slicing"}], points, chain.SLICES).data.orderBy("idx").collect()
    assert [(r.idx, r.start_time, r.duration) for r in cut] == [(0, 0.5, 0.5), (2, 1.0, 0.5)]
    assert segments.measured(chain.segmentation(recordings, buffers).run([{"stage_name": "slicing"}], points, chain.SLICES).data, chunks.as_chunks(buffers)).count() == 2
