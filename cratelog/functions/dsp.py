"""Numeric kernels for what needs a spectrum or a search over samples. They emit features only;
what is decided from these is left to column expressions.

Derived from the public definitions of each feature; not bit-equal to any audio library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from math import gcd

import numpy as np


@dataclass(frozen=True)
class OnsetParams:
    """How onsets are told. The envelope: hop, n_fft, fmin, fmax, n_mels, aggregate (mean, median or max over bands).
    Its peaks: see pick_peaks. backtrack: to the low point before, of the envelope or of ``energy`` ("rms"); snap: to a zero crossing."""

    hop: int = 256
    n_fft: int = 2048
    fmin: float = 0.0
    fmax: float | None = None
    n_mels: int = 40
    aggregate: str = "mean"
    pre_max: int = 5
    post_max: int = 5
    pre_avg: int = 10
    post_avg: int = 10
    delta: float = 0.07
    wait: int = 5
    backtrack: bool = True
    energy: str | None = None
    snap: bool = True

    def __post_init__(self) -> None:
        if self.aggregate not in _AGGREGATES or self.energy not in (None, "rms"):
            raise ValueError(f"unknown aggregate or energy: {self.aggregate}, {self.energy}")


_AGGREGATES = {"mean": np.mean, "median": np.median, "max": np.max}


def spectra(y: np.ndarray, n_fft: int = 2048, hop: int = 512, block: int = 2048, centred: bool = True) -> Iterator[np.ndarray]:
    """Magnitudes [bins, frames] of Hann windows, a block of frames at a time; centred: with half a window of silence at both ends."""
    y = np.asarray(y, np.float32 if np.asarray(y).dtype == np.float32 else float)
    pad = np.pad(y, n_fft // 2) if centred else y
    frames = np.lib.stride_tricks.sliding_window_view(pad, n_fft)[::hop] if len(pad) >= n_fft else np.zeros((0, n_fft))
    window = np.hanning(n_fft + 1)[:-1]
    for k in range(0, len(frames), block):
        yield np.abs(np.fft.rfft(frames[k : k + block] * window, axis=1)).T


def mean_spectrum(y: np.ndarray, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """The average magnitude of each bin; zeros for an empty buffer."""
    total, n = np.zeros(n_fft // 2 + 1), 0
    for s in spectra(y, n_fft, hop) if len(y) else ():
        total, n = total + s.sum(axis=1), n + s.shape[1]
    return total / max(n, 1)


def mel_filters(rate: int, n_fft: int, bands: int = 40, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(to_mel(fmin), to_mel(min(fmax or rate / 2, rate / 2)), bands + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrum(y: np.ndarray, rate: int, n_fft: int = 2048, hop: int = 512, bands: int = 40) -> np.ndarray:
    filters = mel_filters(rate, n_fft, bands)
    return np.concatenate([np.zeros((bands, 0)), *(filters @ s**2 for s in spectra(y, n_fft, hop))], axis=1)


def mfcc(y: np.ndarray, rate: int, count: int = 13, n_fft: int = 512, hop: int = 128) -> np.ndarray:
    logs = np.log(mel_spectrum(y, rate, n_fft, hop) + 1e-10)
    k = np.arange(logs.shape[0])
    return np.cos(np.pi / len(k) * (k + 0.5) * np.arange(count)[:, None]) @ logs


#: The constant-Q transform: from C1 so many octaves of twelve, a frame every so many samples.
LOWEST, OCTAVES, CQT_HOP = 32.703195662574829, 7, 512
_HALF = np.sinc((np.arange(65) - 32) / 2) * np.hanning(67)[1:-1]
_HALF /= _HALF.sum()


@cache
def constant_q_kernels(lowest: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectra of windowed tones of an octave from ``lowest`` up, cut to the bins that hold anything: (kernels, their bins)."""
    hz = lowest * 2.0 ** (np.arange(12) / 12)
    lengths = np.ceil(rate / (hz * (2 ** (1 / 12) - 1))).astype(int)
    size = 1 << int(lengths.max() - 1).bit_length()
    tones = np.zeros((12, size), complex)
    for k, n in enumerate(lengths):
        at = np.arange(n) - n // 2
        if hz[k] < rate / 2:
            tones[k, size // 2 + at] = np.hanning(n + 2)[1:-1] * np.exp(2j * np.pi * hz[k] / rate * at) / n
    spectra_ = np.conj(np.fft.fft(tones))[:, : size // 2 + 1] / size * 2
    used = np.flatnonzero(np.abs(spectra_).max(axis=0) > 1e-3 * np.abs(spectra_).max())
    return spectra_[:, used], used


def halved(y: np.ndarray) -> np.ndarray:
    """y at half its sample rate; sample k stays where sample 2k was."""
    return np.convolve(y, _HALF)[32 : 32 + len(y)][::2] if len(y) else y


def chroma_reach(rate: float) -> int:
    """How many samples to either side of a frame its chroma depends on, at most; a multiple of what the lowest octave's samples stand for."""
    return -(-int(rate / LOWEST * 17 / 2 * 2.1 + 64 * 2**OCTAVES) // 2**OCTAVES) * 2**OCTAVES


def chroma_sums(y: np.ndarray, rate: float, t0: int, t1: int, first: int = 0) -> np.ndarray:
    """The sum over frames t0 to t1 of their chroma, each at most 1: magnitudes of the constant-Q bins by pitch class, C first.

    y is a signal from sample ``first`` on (a multiple of 2 ** OCTAVES); an octave down is the same
    transform of the signal at half the rate, as soon as that holds it.
    """
    total, step = np.zeros((12, max(t1 - t0, 0))), 1
    y = np.asarray(y, float)
    for octave_ in reversed(range(OCTAVES)):
        low = LOWEST * 2.0**octave_
        while rate / step / 2 >= 5 * low and step < 2**OCTAVES:  # well above twice the octave's highest tone
            y, step = halved(y), step * 2
        if low < rate / 2 / step:
            kernels, used = constant_q_kernels(low, rate / step)
            size = 1 << int(np.ceil(rate / step / (low * (2 ** (1 / 12) - 1))) - 1).bit_length()
            centres = (np.arange(t0, t1) * CQT_HOP - first) // step
            pad = np.pad(y, (size, size + CQT_HOP))
            for k in range(0, len(centres), 256):
                at = np.minimum(centres[k : k + 256], len(y)) + size - size // 2
                frames = np.fft.rfft(pad[at[:, None] + np.arange(size)], axis=1)[:, used]
                total[:, k : k + len(at)] += np.abs(kernels @ frames.T)
    top = total.max(axis=0, initial=0.0)
    return (total / np.where(top > 1e-7, top, np.inf)).sum(axis=1)


def chroma(y: np.ndarray, rate: int) -> np.ndarray:
    """The mean chroma of the 12 pitch classes, C first; zeros for an empty or silent buffer."""
    frames = len(y) // CQT_HOP + 1
    return chroma_sums(y, rate, 0, frames) / frames if len(y) else np.zeros(12)


def flux(y: np.ndarray, rate: int, p: OnsetParams = OnsetParams(), centred: bool = True) -> np.ndarray:
    """Positive change of the log mel spectrum from frame to frame; 0 for the first."""
    bank = mel_filters(rate, p.n_fft, p.n_mels, p.fmin, p.fmax)
    logs = np.log1p(100 * np.concatenate([np.zeros((p.n_mels, 0)), *(bank @ s**2 for s in spectra(y, p.n_fft, p.hop, centred=centred))], axis=1))
    return _AGGREGATES[p.aggregate](np.maximum(np.diff(logs, axis=1, prepend=logs[:, :1]), 0), axis=0)


def onset_envelope(y: np.ndarray, rate: int, p: OnsetParams = OnsetParams()) -> np.ndarray:
    """The flux, at most 1."""
    x = flux(y, rate, p)
    return x / x.max() if x.size and x.max() > 0 else x


def frame_levels(y: np.ndarray, p: OnsetParams = OnsetParams(), centred: bool = True) -> np.ndarray:
    """The root mean square of each frame's window."""
    pad = np.pad(np.asarray(y, float), p.n_fft // 2) if centred else np.asarray(y, float)
    frames = np.lib.stride_tricks.sliding_window_view(pad, p.n_fft)[:: p.hop] if len(pad) >= p.n_fft else np.zeros((0, p.n_fft))
    return np.sqrt(np.concatenate([np.zeros(0), *((frames[k : k + 2048] ** 2).mean(axis=1) for k in range(0, len(frames), 2048))]))


def peak_candidates(x: np.ndarray, p: OnsetParams = OnsetParams()) -> np.ndarray:
    """Frames that are the maximum around them and exceed the mean around them by delta."""
    if not len(x):
        return np.zeros(0, int)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, (p.pre_max, p.post_max), constant_values=-np.inf), p.pre_max + p.post_max + 1).max(axis=1)
    width = p.pre_avg + p.post_avg + 1
    total = np.lib.stride_tricks.sliding_window_view(np.pad(x, (p.pre_avg, p.post_avg)), width).sum(axis=1)
    at = np.arange(len(x))
    held = np.minimum(at + p.post_avg + 1, len(x)) - np.maximum(at - p.pre_avg, 0)
    return np.flatnonzero((x == near) & (x >= total / held + p.delta))


def kept_apart(frames: np.ndarray, wait: int) -> np.ndarray:
    """Ascending frames without those that come within ``wait`` of the last one kept."""
    out = [-wait - 1]
    for i in np.asarray(frames).tolist():
        if i - out[-1] > wait:
            out.append(i)
    return np.array(out[1:], int)


def pick_peaks(x: np.ndarray, p: OnsetParams = OnsetParams()) -> np.ndarray:
    """Candidates that keep their distance."""
    return kept_apart(peak_candidates(x, p), p.wait)


def low_points(x: np.ndarray) -> np.ndarray:
    """Local minima; of a level stretch the last frame."""
    return np.flatnonzero((x[1:-1] <= x[:-2]) & (x[1:-1] < x[2:])) + 1 if len(x) > 2 else np.zeros(0, int)


def backtrack(peaks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each peak moved to the local minimum before it."""
    lows = np.r_[0, low_points(x)]
    return lows[np.searchsorted(lows, peaks, "right") - 1] if len(peaks) else peaks


def snap_to_crossing(y: np.ndarray, at: int, reach: int = 1024) -> int:
    """The nearest zero crossing within reach, on the quieter side (right if equal); else the quietest sample."""
    first = max(0, at - reach)
    part = np.asarray(y[first : at + reach])
    if not len(part):
        return at
    turns = np.flatnonzero(np.sign(part[:-1]) != np.sign(part[1:]))
    if not len(turns):
        return first + int(np.argmin(np.abs(part)))
    k = int(turns[np.argmin(np.abs(turns + first - at))])
    return first + (k if abs(part[k]) < abs(part[k + 1]) else k + 1)


def onsets(y: np.ndarray, rate: int, p: OnsetParams = OnsetParams(), envelope: np.ndarray | None = None) -> np.ndarray:
    """Onset times in seconds, moved back to where the sound begins and to a zero crossing."""
    x = onset_envelope(y, rate, p) if envelope is None else envelope
    at = pick_peaks(x, p)
    if p.backtrack:
        at = backtrack(at, frame_levels(y, p) if p.energy == "rms" else x)
    at = [int(a) for a in at * p.hop if a < len(y)]
    return np.unique([snap_to_crossing(y, a) for a in at] if p.snap else at) / rate


def tempo(y: np.ndarray, rate: int, hop: int = 256, envelope: np.ndarray | None = None) -> float:
    """Beats a minute by the envelope's autocorrelation, weighted towards 120; 0 if there is none."""
    x = onset_envelope(y, rate, OnsetParams(hop=hop)) if envelope is None else envelope
    x = x - x.mean() if x.size else x
    power = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)] if x.size > 1 else np.zeros(1)
    lags = np.arange(1, len(power))
    bpm = 60 * rate / hop / np.maximum(lags, 1)
    use = (bpm > 20) & (bpm < 320)
    if not use.any() or power[0] <= 0:
        return 0.0
    prior = np.exp(-0.5 * np.log2(bpm[use] / 120) ** 2)
    return float(bpm[use][np.argmax(power[1:][use] * prior)])


def shape(y: np.ndarray, rate: int) -> tuple[float, float]:
    """Mean spectral centroid (Hz) and flatness; zeros for an empty or silent buffer."""
    f, centroids, flatness, loud = np.fft.rfftfreq(2048, 1 / rate), [], [], False
    for s in spectra(y) if len(y) else ():
        power, loud = np.maximum(s**2, 1e-10), loud or bool(s.any())
        centroids.append(f @ s / np.maximum(s.sum(axis=0), 1e-10))
        flatness.append(np.exp(np.log(power).mean(axis=0)) / power.mean(axis=0))
    return (float(np.concatenate(centroids).mean()), float(np.concatenate(flatness).mean())) if loud else (0.0, 0.0)


def spectral_change(y: np.ndarray, rate: int) -> float:
    """1 - mean change of the mel spectrum over its mean, within [0, 1]; 0.3 for under two frames."""
    m = mel_spectrum(y, rate)
    return 0.3 if m.shape[1] < 2 else float(np.clip(1 - np.abs(np.diff(m, axis=1)).mean() / (m.mean() + 1e-10), 0, 1))


def octave(bpm: float) -> float:
    """One octave up under 40, one down over 200; 120 if there is none."""
    if bpm <= 0:
        return 120.0
    return bpm * 2 if bpm < 40 else bpm / 2 if bpm > 200 else bpm


def beats(y: np.ndarray, rate: int, bpm: float, hop: int = 256, tightness: float = 100.0, envelope: np.ndarray | None = None) -> np.ndarray:
    """Beat times: the chain of frames about a beat apart that gathers the most onset strength (Ellis, 2007)."""
    x = onset_envelope(y, rate, OnsetParams(hop=hop)) if envelope is None else envelope
    period = 60 * rate / hop / bpm if bpm > 0 else 0.0
    if period < 2 or not x.any():
        return np.zeros(0)
    lags = np.arange(max(1, int(period / 2)), int(2 * period) + 1)
    cost = tightness * np.log(lags / period) ** 2
    best, came = x / (x.std() + 1e-10), np.full(len(x), -1)
    for i in range(int(lags[0]), len(x)):
        n = int(np.searchsorted(lags, i, "right"))
        before = best[i - lags[:n]] - cost[:n]
        k = int(np.argmax(before))
        if before[k] > 0:
            best[i] += before[k]
            came[i] = i - lags[k]
    first = max(0, len(x) - int(round(period)))
    at, chain = first + int(np.argmax(best[first:])), []
    while at >= 0:
        chain.append(at)
        at = came[at]
    return np.array(chain[::-1]) * hop / rate


def resample_reach(rate: int, wanted: int, reach: int = 16) -> int:
    """How many samples to either side ``resample`` looks at."""
    return int(np.ceil(reach / min(1.0, wanted / rate)))


@lru_cache(maxsize=8)
def _sinc_table(rate: int, wanted: int) -> np.ndarray:
    """The windowed sinc of each place between samples that an output sample can have."""
    scale, half, places = min(1.0, wanted / rate), resample_reach(rate, wanted), wanted // gcd(rate, wanted)
    off = np.arange(places)[:, None] / places - np.arange(-half, half + 1)
    return scale * np.sinc(scale * off) * np.where(np.abs(off) <= half, 0.5 + 0.5 * np.cos(np.pi * off / half), 0)


def resample_at(y: np.ndarray, rate: int, wanted: int, first: int, last: int, origin: int = 0, block: int = 1 << 16) -> np.ndarray:
    """Samples first to last at another rate, of a signal of which y is the part from frame ``origin`` on; silence beyond it."""
    half, out, table = resample_reach(rate, wanted), [np.zeros(0)], _sinc_table(rate, wanted)
    step, places = rate // gcd(rate, wanted), len(table)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(y, float), half + 1), 2 * half + 1)
    for k in range(first, last, block):
        at = np.arange(k, min(last, k + block), dtype=np.int64) * step
        out.append(np.einsum("ij,ij->i", near[at // places - origin + 1], table[at % places]))
    return np.concatenate(out)


def resample(y: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """y at another sample rate, by a windowed sinc that keeps what both rates can hold."""
    return np.asarray(y, float) if rate == wanted or not len(y) else resample_at(y, rate, wanted, 0, len(y) * wanted // rate)


def crossing_near(y: np.ndarray, at: int, reach: int) -> int:
    """The first sample after the nearest change of sign within reach (the earlier if equal); else ``at`` itself."""
    first, last = max(0, at - reach), min(len(y), at + reach)
    negative = np.signbit(y[first:last])
    turns = np.flatnonzero(negative[1:] != negative[:-1]) + 1 if last > first else np.zeros(0, int)
    return first + int(turns[np.argmin(np.abs(turns + first - at))]) if len(turns) else at


def crosses(y: np.ndarray, at: int, reach: int) -> bool:
    """Whether the sign changes within reach samples of a position."""
    near = np.sign(y[max(0, at - reach) : max(0, at + reach)])
    return bool(np.any(near[1:] != near[:-1]))


def clicks(y: np.ndarray, level: float = 0.1, ratio: float = 5.0, around: int = 20) -> bool:
    """Whether the largest second difference is over level and over ratio times the mean around it."""
    if len(y) < 3:
        return False
    d = np.abs(np.diff(y, 2))
    at = int(np.argmax(d))
    return bool(d[at] > level and d[at] > ratio * d[max(0, at - around) : at + around].mean())


def steadiness(values: np.ndarray) -> float:
    """1 - variation of the values, within [0, 1]; 0.3 for none or if they are next to nothing."""
    if not len(values) or values.mean() < 1e-10:
        return 0.3
    return float(np.clip(1 - values.std() / values.mean(), 0, 1))


def loop_features(y: np.ndarray, rate: int, first: int, last: int) -> tuple[float, float, float, float, float]:
    """Of y[first:last]: likeness of its ends, crossings at its ends, steadiness of level and of onset gaps, spectral stability."""
    part = y[first:last]
    w = max(int(0.05 * rate), 512)
    alike = 0.0
    if len(part) >= 2 * w:
        a, b = (mfcc(e, rate).mean(axis=1) for e in (part[:w], part[-w:]))
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        alike = float(np.clip(a @ b / scale, 0, 1)) if scale > 0 else 0.0
    reach = max(1, int(0.005 * rate) // 2)
    clean = 0.0
    for at in (first, last):
        negative = np.signbit(y[max(0, at - reach) : at + reach])
        clean += 0.5 * bool(np.any(negative[1:] != negative[:-1]))
    frame = len(part) // 16
    level = steadiness(np.sqrt((part[: 16 * frame].reshape(16, frame) ** 2).mean(axis=1))) if frame else 0.3
    found = pick_peaks(onset_envelope(part, rate)) if len(part) else np.zeros(0)
    return alike, clean, level, steadiness(np.diff(found)), spectral_change(part, rate)
