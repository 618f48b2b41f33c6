"""Language ID: a byte convolutional network over fixed-length windows.

A text is cut into windows of ``width`` bytes that overlap by the widest filter less one, so
each byte n-gram lies whole in a window. Filters of several widths, max pooling and a softmax
give each window log-probabilities; a text's are the mean over all its windows, weighted by
the bytes in them. A filter over one-hot bytes is a sum of table rows, so scoring is numpy
gathers and training touches only the rows at the pooled maxima.

Texts that are null or have no letter get ``und`` with score 0, and so does every text if no
language could be learned. Of equally likely languages the first in sorted order is returned.
Repeated rows are told once each, an empty table gives none. A text is taken whole: a very long one
needs some fifty times its size in a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case, plus, text_slices

UNKNOWN = "und"
_TAPS = (2, 3, 4)


@dataclass(frozen=True)
class CnnParams:
    """``docs_per_lang`` and ``windows_per_doc`` bound what the fit reads."""

    width: int = 256
    filters: int = 12
    epochs: int = 6
    batch: int = 64
    rate: float = 0.08
    docs_per_lang: int = 500
    windows_per_doc: int = 4


@dataclass(frozen=True)
class ByteCnn:
    """Tables: for each filter width, (taps, 256, filters); the dense layer maps all filters to langs."""

    langs: list[str]
    width: int
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @property
    def stride(self) -> int:
        return self.width - max(_TAPS) + 1

    def compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables over byte pairs: the first two taps of all widths, tap three, taps three and four."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        two, three, four = self.tables
        first = np.concatenate([pair(t[0], t[1]) for t in self.tables], axis=1) + self.bias
        return first.astype(np.float32), three[2].astype(np.float32), pair(four[2], four[3]).astype(np.float32)


def windows(data: np.ndarray, offsets: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window bytes padded with zeros, row of each window, bytes in each window)."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - (width - stride)) // stride)), 0)
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * stride
    length = np.minimum(width, offsets[1:][row] - start)
    at = start[:, None] + np.arange(width)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[np.arange(width) >= length[:, None]] = 0
    return out, row, length


def fit(samples: dict[str, np.ndarray], p: CnnParams = CnnParams()) -> ByteCnn:
    """Adagrad on the cross-entropy; each language weighs the same."""
    langs = sorted(samples)
    rng, f, n = np.random.default_rng(5), p.filters, len(langs)
    net = ByteCnn(langs, p.width, [rng.normal(0, 0.3, (w, 256, f)) for w in _TAPS], np.zeros(f * len(_TAPS)), rng.normal(0, 0.2, (f * len(_TAPS), n)), np.zeros(n))
    if n < 2:
        return net
    x = np.concatenate([samples[k] for k in langs])
    y = np.repeat(np.arange(n), [len(samples[k]) for k in langs])
    weight = (len(y) / n / np.bincount(y))[y]
    values = [*net.tables, net.bias, net.dense, net.dense_bias]
    speed = [np.full(v.shape, 1e-2) for v in values]
    for _ in range(p.epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // p.batch)):
            b = x[at].astype(np.int64)
            pooled, where = [], []
            for t in net.tables:
                out = sum(t[k][b[:, k : p.width - len(t) + 1 + k]] for k in range(len(t)))
                arg = out.argmax(1)
                where.append(arg)
                pooled.append(np.take_along_axis(out, arg[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.dense + net.dense_bias
            q = np.exp(logits - logits.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), y[at]] -= 1
            q *= weight[at][:, None] / len(at)
            back = (q @ net.dense.T) * (raw > 0)
            grads = []
            for k, t in enumerate(net.tables):
                g, own = np.zeros(t.shape), back[:, k * f : (k + 1) * f]
                for tap in range(len(t)):
                    np.add.at(g[tap], (np.take_along_axis(b, where[k] + tap, 1), np.arange(f)), own)
                grads.append(g)
            for v, s, g in zip(values, speed, [*grads, back.sum(0), hidden.T @ q, q.sum(0)], strict=True):
                s += g * g
                v -= p.rate * g / np.sqrt(s)
    return net


def train(docs: DataFrame, usable: Column, p: CnnParams = CnnParams()) -> ByteCnn:
    """Fit on windows of at most ``docs_per_lang`` documents of each non-null lang for which ``usable`` holds."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit({}, p)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * p.docs_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    net = ByteCnn([], p.width, [], np.zeros(0), np.zeros(0), np.zeros(0))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, rows = b.column(0).to_pylist(), {"lang": [], "window": []}
            for first, _, data, offsets in text_slices(b.column(1)):
                w, row, _ = windows(fold_case(data), offsets, p.width, net.stride)
                for i in np.unique(row):
                    own = np.flatnonzero(row == i)
                    for k in own[np.unique(np.linspace(0, len(own) - 1, p.windows_per_doc).astype(int))]:
                        rows["lang"].append(langs[first + i])
                        rows["window"].append(w[k].tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("window", pa.binary())]))

    drawn = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(cut, "lang string, window binary")
    got: dict[str, list[bytes]] = {}
    for r in drawn.orderBy("lang", F.xxhash64("window"), "window").collect():
        got.setdefault(r["lang"], []).append(bytes(r["window"]))
    most = p.docs_per_lang * p.windows_per_doc
    return fit({k: np.frombuffer(b"".join(v[:most]), np.uint8).reshape(-1, p.width) for k, v in got.items()}, p)


def has_letter(column: pa.Array) -> np.ndarray:
    """True for texts with a letter of any script."""
    out = np.zeros(len(column), bool)
    for first, end, data, offsets in text_slices(column):
        ascii_letters = np.concatenate([[0], np.cumsum((fold_case(data) - np.uint8(97)) < 26)])
        found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
            found[i] = any(map(str.isalpha, column[first + i].as_py() or ""))
        out[first:end] = found
    return out


def predict(net: ByteCnn, compiled: tuple, column: pa.Array, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language, its probability) of each text."""
    logs, weight = np.zeros((len(column), len(net.langs))), np.zeros(len(column))
    two_taps, tap3, taps34 = compiled
    f = net.tables[0].shape[2]
    for first, _, data, offsets in text_slices(column):
        all_windows, rows, length = windows(fold_case(data), offsets, net.width, net.stride)
        for k in range(0, len(rows), block):
            b = all_windows[k : k + block].astype(np.int32)
            pairs = b[:, :-1] << 8 | b[:, 1:]
            out = two_taps[pairs]
            out[:, :-1, f : 2 * f] += tap3[b[:, 2:]]
            out[:, :-2, 2 * f :] += taps34[pairs[:, 2:]]
            pooled = np.concatenate([out[:, :, :f].max(1), out[:, :-1, f : 2 * f].max(1), out[:, :-2, 2 * f :].max(1)], axis=1)
            logits = np.maximum(pooled, 0) @ net.dense + net.dense_bias
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            at, own = first + rows[k : k + block], length[k : k + block].astype(float)
            np.add.at(logs, at, logits * own[:, None])
            np.add.at(weight, at, own)
    logs /= np.maximum(weight, 1)[:, None]
    q = np.exp(logs - logs.max(1, keepdims=True))
    return q.argmax(1), q.max(1) / q.sum(1)


def identify(docs: DataFrame, net: ByteCnn, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the predicted language and its probability, in place of columns of those names. One map-only stage."""
    docs = docs.drop(name, score)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        compiled = own.compiled() if len(own.langs) else None
        names = np.array([*own.langs, UNKNOWN], object)
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(b.schema.get_field_index("text"))
            best, p = np.full(len(column), len(own.langs)), np.zeros(len(column))
            if compiled:
                ok = has_letter(column)
                best, p = predict(own, compiled, column)
                best, p = np.where(ok, best, len(own.langs)), np.where(ok, p, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best], pa.string()), pa.array(p)], names=[*b.schema.names, name, score])

    return docs.mapInArrow(run, plus(docs.schema, **{name: "string", score: "double"}))
