"""Kernels over chunks of any size against the same over whole recordings."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratelog.functions import dsp, filters
from cratelog.operators import chunks, segments
from cratelog.plans import chain

RATE = 8000


def signals():
    r = np.random.default_rng(5)
    hits = np.zeros(5 * RATE)
    hits[1000 :: RATE // 2] = 1.0
    hits = np.convolve(hits, np.exp(-np.arange(400) / 60) * np.sin(np.arange(400) / 3))[: 5 * RATE] + r.normal(size=5 * RATE) * 0.01
    return {1: hits, 2: r.normal(size=4096) * np.linspace(0, 1, 4096), 3: np.zeros(3000), 4: r.normal(size=50), 5: r.normal(size=512 * 16)}


def pieces(spark, size):
    rows = [(k, a, RATE, y[a : a + size].tolist()) for k, y in signals().items() for a in range(0, len(y), size)]
    return spark.createDataFrame(rows, "id long, first_frame long, sample_rate int, samples array<double>").repartition(3)


def direct(u, parts):
    """Every sample by the filters' recursion."""
    for b0, b1, b2, a1, a2 in parts:
        x1 = x2 = y1 = y2 = 0.0
        out = np.zeros(len(u))
        for i, x in enumerate(u):
            out[i] = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = x, x1, out[i], y1
        u = out
    return u


PLAN = [("highpass", 100.0, 0.0), ("peak", 1000.0, -3.0), ("peak", 2500.0, -3.0)]


@pytest.mark.parametrize("size", [1, 37, 256, 1000, 50_000])
def test_cascade(size):
    u = signals()[1][:3000]
    c, state, out = filters.cascade(filters.sections(PLAN, RATE)), None, []
    for a in range(0, len(u), size):
        y, state = c.filtered(u[a : a + size], state)
        out.append(y)
    assert np.allclose(np.concatenate(out), direct(u, filters.sections(PLAN, RATE)), atol=1e-12)


def test_filters_do_what_they_say():
    level = lambda hz, parts: np.abs(filters.Cascade(parts).filtered(np.sin(2 * np.pi * hz * np.arange(RATE) / RATE))[0][RATE // 2 :]).max()
    assert abs(20 * np.log10(level(1000, filters.sections(PLAN[1:2], RATE))) + 3) < 0.05 and level(100, filters.sections(PLAN[1:2], RATE)) > 0.97
    assert level(10, filters.sections(PLAN[:1], RATE)) < 0.12 and level(2000, filters.sections(PLAN[:1], RATE)) > 0.97
    assert filters.sections([("peak", 5000.0, -3.0)], RATE) == ()


@pytest.mark.parametrize("size", [300, 4096, 100_000])
def test_equalized(spark, size):
    plan = spark.createDataFrame([(k, *s) for k in (1, 2, 4) for s in PLAN], "id long, filter string, hz double, gain_db double")
    rows = pieces(spark, size)
    out = chunks.equalized(rows, plan, "id")
    assert out.columns == rows.columns
    got = {k: np.concatenate([r.samples for r in sorted(v, key=lambda r: r.first_frame)]) for k, v in grouped(out.collect()).items()}
    for k, y in signals().items():
        assert np.allclose(got[k], direct(y, filters.sections(PLAN, RATE)) if k in (1, 2, 4) else y, atol=1e-6)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.id, []).append(r)
    return out


@pytest.mark.parametrize(("size", "tile"), [(700, 2048), (100_000, 4096), (5000, 1 << 18)])
def test_features_of_chunks(spark, size, tile):
    rows = pieces(spark, size)
    made = {r.id: r for r in chunks.spectral_features(rows, "id", size=tile).collect()}
    for k, y in signals().items():
        assert np.allclose((made[k].centroid, made[k].flatness), dsp.shape(y, RATE), rtol=1e-9)
        assert np.allclose(made[k].spectrum, dsp.mean_spectrum(y), rtol=1e-9) and made[k].n_frames == len(y)
    timed = {r.id: r for r in chunks.tempo(rows, "id", size=tile).collect()}
    curves = {k: np.concatenate([r.samples for r in sorted(v, key=lambda r: r.first_frame)]) for k, v in grouped(chunks.envelope(rows, "id", size=tile).collect()).items()}
    for k, y in signals().items():
        x = dsp.onset_envelope(y, RATE)
        assert np.allclose(curves[k], x, atol=1e-9)
        assert np.isclose(timed[k].tempo, dsp.tempo(y, RATE)) and np.allclose(timed[k].beats, dsp.beats(y, RATE, dsp.octave(timed[k].tempo)))


@pytest.mark.parametrize("p", [dsp.OnsetParams(), dsp.OnsetParams(hop=128, energy="rms", wait=0, delta=0.01), dsp.OnsetParams(backtrack=False, snap=False, aggregate="median", n_fft=1024)])
def test_onsets_of_chunks(spark, p):
    rows = pieces(spark, 1500)
    for tile in (2048, 1 << 18):
        got = grouped(chunks.onsets(rows, "id", size=tile, p=p).collect())
        for k, y in signals().items():
            assert np.allclose(sorted(r.t for r in got.get(k, [])), dsp.onsets(y, RATE, p))
    assert len(got[1]) >= 8


@pytest.mark.parametrize("change", [{"sr": 8000}, {"hop_length": 512}, {"n_fft": 1024}, {"snap_to_zero_crossing": False}, *({"detection_params": d} for d in (
    {"backtrack": False}, {"energy": "rms"}, {"fmin": 2000.0}, {"fmax": 1000.0}, {"aggregate": "max"}, {"delta": 0.3}, {"wait": 60}, {"pre_max": 60}, {"post_max": 60}, {"pre_avg": 1, "delta": 0.2}, {"post_avg": 1, "delta": 0.2}))])
def test_every_onset_parameter_matters(change):
    """Each parameter of the stage changes what is found in a busy signal."""
    r = np.random.default_rng(1)
    y = np.zeros(4 * 11_025)
    for at, hz in zip(np.sort(r.integers(0, len(y) - 800, 60)), r.uniform(60, 5000, 60), strict=True):
        y[at : at + 800] += r.uniform(0.05, 1) * np.sin(2 * np.pi * hz * np.arange(800) / 11_025 + 1) * np.exp(-np.arange(800) / 200)

    def found(sr, hop_length, n_fft, snap_to_zero_crossing, detection_params):
        told = {k: v for k, v in detection_params.items() if k != "units"}
        p = dsp.OnsetParams(hop=hop_length, n_fft=n_fft, snap=snap_to_zero_crossing, **told)
        return dsp.onsets(dsp.resample(y, 11_025, sr), sr, p)

    base = {**chain.ONSET_PARAMS, "detection_params": chain.DETECTION}
    one, two = found(**base), found(**chain.merged(base, change, ("detection_params",)))
    assert len(one) > 5 and (len(one) != len(two) or not np.allclose(one, two))


def test_onset_stage_takes_all_parameters(spark):
    rows = pieces(spark, 3000).withColumnRenamed("id", "recording_id")
    steps = [{"stage_name": "onset_detection", "params": {"sr": None, "detection_params": {"fmin": 20.0, "units": "frames", "wait": 3}}}]
    got = chain.segmentation().run(steps, rows, chain.AUDIO).data.where("recording_id = 1").collect()
    p = dsp.OnsetParams(**{k: v for k, v in (chain.DETECTION | {"wait": 3}).items() if k != "units"})
    assert np.allclose(sorted(r.t for r in got), dsp.onsets(signals()[1], RATE, p))
    with pytest.raises(TypeError):
        chain.segmentation().run([{"stage_name": "onset_detection", "params": {"detection_params": {"nonsense": 1}}}], rows, chain.AUDIO)
    with pytest.raises(ValueError, match="units"):
        chain.segmentation().run([{"stage_name": "onset_detection", "params": {"detection_params": {"units": "time"}}}], rows, chain.AUDIO)


def test_cut_and_resampled(spark):
    y = signals()
    spans = spark.createDataFrame([(1, 0, 5000, "a"), (1, 2999, 3001, "b"), (1, 39_000, 90_000, "c"), (2, 10, 10, "d"), (4, 60, 70, "e"), (1, 0, 5000, "f")], "id long, first_sample long, last_sample long, what string")
    got = {r.what: r.samples for r in chunks.cut(spans, pieces(spark, 1111), "id", size=1000).collect()}
    assert set(got) == {"a", "b", "c", "f"} and np.allclose(got["a"], y[1][:5000]) and np.allclose(got["b"], y[1][2999:3001]) and np.allclose(got["c"], y[1][39_000:]) and got["a"] == got["f"]
    for wanted in (11_025, 4000):
        out = grouped(chunks.resampled(pieces(spark, 999), wanted, "id", size=2048).collect())
        for k, v in y.items():
            made = np.concatenate([r.samples for r in sorted(out[k], key=lambda r: r.first_frame)])
            assert np.allclose(made, dsp.resample(v, RATE, wanted), atol=1e-6)
    same = segments.heard_segments(spark.createDataFrame([(1, 0.1, 0.4), (1, 9.0, 9.5)], "id long, start_time double, end_time double"), pieces(spark, 777), "id").orderBy("start_time").collect()
    assert np.isclose(same[0].centroid, dsp.shape(y[1][800:3200], RATE)[0]) and same[1].centroid is None
    assert chunks.onsets(pieces(spark, 777).where(F.lit(False)), "id").count() == 0


def test_params_are_checked():
    with pytest.raises(ValueError, match="aggregate"):
        dsp.OnsetParams(aggregate="sum")
    assert dataclasses.replace(dsp.OnsetParams(), hop=1).hop == 1


@pytest.mark.parametrize("rate", [8000, 44_100])
def test_tones_and_thirds_from_c2_up(rate):
    """Each tone is told by its pitch class, and each triad by its root and its third."""
    t = np.arange(rate) / rate
    tone = lambda note: np.sin(2 * np.pi * 440 * 2 ** ((note - 69) / 12) * t)
    for note in range(36, 96, 5 if rate > 8000 else 1):
        assert dsp.chroma(tone(note), rate).argmax() == note % 12
    for root in range(48, 72):
        for third in (3, 4):
            c = dsp.chroma(tone(root) + 0.7 * tone(root + third) + 0.5 * tone(root + 7), rate)
            assert c.argmax() == root % 12 and (c[(root + 4) % 12] > c[(root + 3) % 12]) == (third == 4)
    assert not dsp.chroma(np.zeros(rate), rate).any() and not dsp.chroma(np.zeros(0), rate).any()


def test_chroma_of_chunks(spark):
    rows = pieces(spark, 3000)
    for tile in (4096, 1 << 18):
        got = {r.id: r.chroma for r in chunks.chroma(rows, "id", size=tile, highest=RATE).collect()}
        for k, y in signals().items():
            assert np.allclose(got[k], dsp.chroma(y, RATE), atol=1e-6)
