"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a row of statistics (byte classes, word and line shapes, repetition). The
boosted trees are complete binary trees kept as flat arrays, so a whole Arrow batch walks all
trees by numpy indexing.

Null and empty texts have all statistics zero and are scored like any other. Without labelled
rows, or with one class only, the score is the (smoothed) share of label 1. Of several texts with one
labelled doc_id one teaches; repeated rows are scored once each; an empty table gives none. A text
is taken whole: a very long one needs some fifty times its size in a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import fold_case, mix, plus, text_slices, word_bounds, word_hashes
from .toxicity import labelled_rows

#: Byte classes whose shares are statistics.
_CLASSES = {
    "upper": np.r_[65:91], "lower": np.r_[97:123], "digit": np.r_[48:58], "newline": [10], "blank": [9, 32],
    "stop": [33, 63, 46], "bang": [33], "comma": [44, 58, 59], "bar": [124], "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 126],
    "bracket": [40, 41, 91, 93, 123, 125], "quote": [34, 39, 96], "slash": [47, 92], "control": np.r_[0:9, 14:32, 127], "wide": np.r_[128:256],
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _MEMBER[_v, _k] = 1
_LINE = np.zeros(256, bool)
_LINE[10] = True
_END = np.zeros(256, bool)
_END[[33, 46, 58, 63]] = True


@dataclass(frozen=True)
class BoostParams:
    """``max_rows`` and ``max_bytes`` bound the labelled sample that the fit reads."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.12
    l2: float = 2.0
    min_rows: int = 8
    max_rows: int = 12_000
    max_bytes: int = 1 << 30


@dataclass(frozen=True)
class Trees:
    """Complete trees: node k's children are 2k+1 (x <= threshold) and 2k+2; leaves come level-last."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of document statistics for each text."""
    parts = [_slice_statistics(data, offsets) for _, _, data, offsets in text_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, _slice_statistics(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]))


def _repeats(row: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many values are distinct and how often the most frequent one occurs."""
    _, first, count = np.unique(mix(hashed + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[first], count)
    return np.bincount(row[first], minlength=n), top


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    byte_row = np.repeat(np.arange(n), size)
    counts = np.bincount(byte_row << 8 | data, minlength=256 * n).reshape(n, 256)
    share = lambda x, of: x / np.maximum(of, 1)
    p = share(counts, size[:, None])
    entropy = -np.sum(p * np.log2(np.where(p > 0, p, 1)), axis=1)

    starts, ends, before = word_bounds(data, offsets)
    words, length = np.diff(before), ends - starts
    row = np.repeat(np.arange(n), words)
    per_row = lambda x, at=row: np.bincount(at, weights=x, minlength=n)
    hashed = word_hashes(fold_case(data), starts, ends)
    distinct, top = _repeats(row, hashed, n)
    same_row = row[1:] == row[:-1]
    pair_row, pair = row[1:][same_row], mix(hashed[:-1] * np.uint64(3) + hashed[1:])[same_row]
    pairs, top_pair = _repeats(pair_row, pair, n)
    runs = per_row((hashed[1:] == hashed[:-1])[same_row], pair_row)
    mean = share(per_row(length), words)
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    last = data[ends - 1]
    symbol_end = (last >= 33) & (last <= 47) & ~np.isin(last, [33, 44, 46, 39, 34, 41])
    second = data[np.minimum(starts + 1, ends - 1)]
    shout = capital & (length > 1) & (second >= 65) & (second <= 90)

    line_starts, line_ends, line_before = word_bounds(data, offsets, _LINE)
    lines, line_len = np.diff(line_before), line_ends - line_starts
    line_row = np.repeat(np.arange(n), lines)
    line_distinct, _ = _repeats(line_row, word_hashes(data, line_starts, line_ends), n)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), entropy, mean,
        np.sqrt(np.maximum(share(per_row(length.astype(float) ** 2), words) - mean**2, 0)),
        share(per_row(length <= 2), words), share(per_row(length >= 12), words), share(per_row(length >= 20), words),
        share(per_row(capital), words), share(per_row(shout), words), share(per_row(_END[last]), words), share(per_row(symbol_end), words),
        share(distinct, words), share(top, words), share(pairs, words - 1), share(top_pair, words), share(runs, words),
        share(line_distinct, lines), share(per_row(line_len, line_row), lines), share(per_row(line_len < 30, line_row), lines),
        share(per_row(_END[data[line_ends - 1]] if len(line_ends) else np.zeros(0), line_row), lines), share(words, lines),
    ]
    return np.column_stack([*columns, p @ _MEMBER])


def quantile_bins(x: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(edges of each column's quantile bins, bin of each value)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    return edges, np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, bins: int, l2: float, min_rows: float, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, thresholds, leaf of each row) of a complete tree with the best split of each node.

    allowed: for a number of nodes, which columns each may split on.
    """
    cols, inner = binned.shape[1], 2**depth - 1
    node, feature, threshold = np.zeros(len(g), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
    cut = np.full(inner, bins)
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        slot = (((node - first)[:, None] * cols + np.arange(cols)) * bins + binned).ravel()
        gl, hl = (np.bincount(slot, weights=np.repeat(v, cols), minlength=n * cols * bins).reshape(n, cols, bins).cumsum(2) for v in (g, h[0]))
        nl = np.bincount(slot, weights=np.repeat(h[1], cols), minlength=n * cols * bins).reshape(n, cols, bins).cumsum(2)
        gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain = np.where((nl >= min_rows) & (nt - nl >= min_rows), gain, 0.0)
        if allowed is not None:
            gain = gain * allowed(n)[:, :, None]
        gain = gain.reshape(n, -1)
        best = gain.argmax(1)
        for k in range(n):
            f, b = divmod(int(best[k]), bins)
            if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                feature[first + k], threshold[first + k], cut[first + k] = f, edges[f][b], b
        node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
    return feature, threshold, node - inner


def fit_trees(x: np.ndarray, y: np.ndarray, p: BoostParams = BoostParams()) -> Trees:
    """Gradient boosting on the logistic loss; splits are searched among quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(share / (1 - share))), 2**p.depth - 1
    if len(y) < 2 * p.min_rows or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges, binned = quantile_bins(x, p.bins)
    margin, features, thresholds, leaves = np.full(len(y), base), [], [], []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        feature, threshold, at = grow(binned, edges, g, (h, np.ones(len(y))), p.depth, p.bins, p.l2, p.min_rows)
        leaf = -p.rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + p.l2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, p: BoostParams = BoostParams()) -> Trees:
    """Fit on at most ``max_rows`` labelled rows for which ``usable`` holds; only their statistics reach the driver."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(statistics(b.column(1))), pa.list_(pa.float64())), b.column(2)], names=["rank", "x", "label"])

    chosen = labelled_rows(docs, labels, label, usable, p.max_rows, p.max_bytes)
    rows = chosen.mapInArrow(measure, "rank int, x array<double>, label int").dropDuplicates(["rank"]).toArrow().sort_by("rank")
    if not rows.num_rows:
        return fit_trees(np.zeros((0, 1)), np.zeros(0), p)
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return fit_trees(x, rows["label"].to_numpy().astype(float), p)


def score(docs: DataFrame, trees: Trees, name: str = "quality_score") -> DataFrame:
    """docs with a double column ``name`` (0 to 1), in place of one of that name. One map-only stage."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.predict(statistics(b.column(b.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, plus(docs.schema, **{name: "double"}))
