"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its hashed words, word stems, word pairs and pairs with one or two words
between; a word or stem that makes up a notable share of the text adds a feature of its own.
Each weight has its own learning rate, and the L1 penalty leaves most weights at exactly zero,
so the fitted model is two short arrays that a broadcast carries to every task.

Null and empty texts have only the bias. Without labelled rows the score is 0.5 everywhere. Of
several texts with one labelled doc_id one teaches; repeated rows are scored once each; an empty table
gives none. A text is taken whole: a very long one needs some forty times its size in a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fold_case, mix, plus, span_hashes, text_slices, word_bounds, word_hashes

_SKIPS = (1, 2, 3)
#: Bytes of the word beginnings that count as stems of inflected words.
_STEMS = (4, 5, 6, 7, 8)
#: Shares of a text's words from which a word or stem is dense there, and the shift of their features.
_SHARES = (0.006, 0.012)
_STEP = 0x3C6EF
#: Bytes of text whose features are held together; each byte takes some 200 while they are sorted.
_TOGETHER = 1 << 18
#: A word here is a run of letters, digits and non-ASCII bytes.
_BREAK = np.ones(256, bool)
_BREAK[np.r_[48:58, 65:91, 97:123, 128:256]] = False


@dataclass(frozen=True)
class FtrlParams:
    """``max_rows`` and ``max_bytes`` bound the labelled sample that the fit reads; it is passed at least three times, and a small one until ``steps`` updates are made.

    Rate (alpha) and penalty (l1) are those of ``grid`` with the best mean of the two labels' shares told right at
    ``threshold``, over ``folds`` folds of the sample; of equal ones the first. An empty grid leaves alpha and l1 as given.
    """

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    grid: tuple[tuple[float, float], ...] = ((0.5, 4.0), (2.0, 4.0), (0.5, 1.0), (2.0, 1.0))
    folds: int = 2
    threshold: float = 0.7
    steps: int = 18_000
    max_rows: int = 6_000
    max_bytes: int = 32 << 20


@dataclass(frozen=True)
class LinearModel:
    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, row of each occurrence, its hashed feature, whether it is a word or stem)."""
    shift = np.uint64(64 - bits)
    for first, end, data, offsets in text_slices(column, _TOGETHER):
        starts, ends, before = word_bounds(data, offsets, _BREAK)
        data = fold_case(data)
        words = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(end - first), np.diff(before))
        rows, hashed = [row], [words >> shift]
        for k in _STEMS:
            long = ends - starts > k
            rows.append(row[long])
            hashed.append(mix(span_hashes(data, starts[long], starts[long] + k) + np.uint64(k)) >> shift)
        single = sum(map(len, rows))
        for k in _SKIPS:
            if len(words) > k:
                same = row[k:] == row[:-k]
                pair = mix(words[:-k] * np.uint64(2 * k + 1) + (words[k:] ^ np.uint64(k * 0x51ED270B)))
                rows.append(row[k:][same])
                hashed.append(pair[same] >> shift)
        rows = np.concatenate(rows)
        yield first, np.diff(before), rows, np.concatenate(hashed).astype(np.int64), np.arange(len(rows)) < single


def levels(size: np.ndarray, rows: np.ndarray, hashed: np.ndarray, single: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each once: presence, and for words and stems that they are dense in the text."""
    ids, count = np.unique((rows.astype(np.int64) << 1 | single) << bits | hashed, return_counts=True)
    row, one, feature = ids >> bits + 1, (ids >> bits & 1).astype(bool), ids & (1 << bits) - 1
    out = [(row, feature)]
    for k, share in enumerate(_SHARES, 1):
        dense = one & (count >= share * size[row])
        out.append((row[dense], feature[dense] + k * _STEP & (1 << bits) - 1))
    ids = np.unique(np.concatenate([r << bits | f for r, f in out]))
    return ids >> bits, ids & (1 << bits) - 1


def fit(texts: list[str], labels: np.ndarray, p: FtrlParams = FtrlParams()) -> LinearModel:
    """Per-coordinate FTRL-proximal, one document at a time in a fixed shuffled order."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias, held, counts = 1 << p.bits, [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    for first, size, rows, hashed, single in features(pa.array(texts, pa.string()), p.bits):
        rows, hashed = levels(size, rows, hashed, single, p.bits)
        counts[first : first + len(size)] = np.bincount(rows, minlength=len(size))
        held.append(hashed.astype(np.int32))
    every, ends = np.concatenate(held), np.cumsum(counts)
    del held

    def weights(x: np.ndarray) -> np.ndarray:
        zx, free = z[x], np.where(x == bias, 0.0, p.l1)
        return np.where(np.abs(zx) <= free, 0.0, -(zx - np.sign(zx) * free) / ((p.beta + np.sqrt(n[x])) / p.alpha + p.l2))

    rng = np.random.default_rng(7)
    for _ in range(max(3, -(-p.steps // max(1, len(texts))))):
        for i in rng.permutation(len(texts)):
            x = np.append(every[ends[i] - counts[i] : ends[i]], bias)
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / p.alpha
            z[x] += g - sigma * w
            n[x] += g * g
    all_weights = weights(np.arange(bias + 1))
    index = np.flatnonzero(all_weights[:bias])
    return LinearModel(p.bits, float(all_weights[bias]), index, all_weights[index].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, p: FtrlParams = FtrlParams()) -> LinearModel:
    """Fit, in one task, on at most ``max_rows`` labelled rows for which ``usable`` holds, the same rows on every run.

    Of several labels for one doc_id the largest counts; rows without label, key or text teach nothing.
    """
    sample = checkpoint(labelled_rows(docs, labels, label, usable, p.max_rows, p.max_bytes).dropDuplicates(["rank"]))
    p = chosen(sample, p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(rows).sort_by("rank") if rows else pa.table({"text": [], "label": []})
        m = fit(table["text"].to_pylist(), table["label"].to_numpy().astype(float), p)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.index.astype(np.int32)], pa.list_(pa.int32())), pa.array([m.weight], pa.list_(pa.float32()))], names=["bias", "index", "weight"])

    got = sample.repartition(1).mapInArrow(run, "bias double, index array<int>, weight array<float>").toArrow()
    if not got.num_rows:
        return LinearModel(p.bits, 0.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy()
    return LinearModel(p.bits, got["bias"][0].as_py(), flat("index").astype(np.int64), flat("weight"))


def chosen(sample: DataFrame, p: FtrlParams) -> FtrlParams:
    """p with the rate and penalty that cross-validation on the sample (rank, text, label) picks; a task for each pair of them and fold."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        job, texts, y = table["job"][0].as_py(), table["text"].to_pylist(), table["label"].to_numpy().astype(float)
        alpha, l1 = p.grid[job // p.folds]
        out = table["rank"].to_numpy() % p.folds == job % p.folds
        model = fit([t for t, o in zip(texts, out.tolist(), strict=True) if not o], y[~out], replace(p, alpha=alpha, l1=l1))
        said = score_column(model, pa.array([t for t, o in zip(texts, out.tolist(), strict=True) if o], pa.string()), model.dense()) >= p.threshold
        return pa.table({"job": [job] * 2, "label": [0, 1], "right": [int((said[y[out] == k] == k).sum()) for k in (0, 1)], "n": [int((y[out] == k).sum()) for k in (0, 1)]})

    if len(p.grid) < 2:
        return replace(p, alpha=p.grid[0][0], l1=p.grid[0][1]) if p.grid else p
    jobs = sample.withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(len(p.grid) * p.folds - 1))))
    told = jobs.repartition(len(p.grid) * p.folds, "job").groupBy("job").applyInArrow(judge, "job long, label long, right long, n long").collect()  # two rows for each job
    right, n = np.zeros((len(p.grid), 2)), np.zeros((len(p.grid), 2))
    for r in told:
        right[r["job"] // p.folds, r["label"]] += r["right"]
        n[r["job"] // p.folds, r["label"]] += r["n"]
    alpha, l1 = p.grid[int(np.argmax((right / np.maximum(n, 1)).sum(axis=1)))]
    return replace(p, alpha=alpha, l1=l1)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """(rank, text, label) of a bounded sample of labelled documents, once each: the first by a hash of the key, as
    long as all their texts together have at most ``max_bytes``. Only keys and lengths are sorted.
    """
    rank = lambda c: F.struct(F.xxhash64(c.cast("string")), c)
    chosen = (
        labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(rank(F.col("doc_id"))).limit(max_rows)
    )
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("h"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("h", F.octet_length("text").alias("bytes"))).alias("one"))
    before = Window.orderBy(rank(F.col("doc_id")))
    taken = sizes.select("doc_id", "label", "one.h", F.sum("one.bytes").over(before).alias("sum"), F.row_number().over(before).alias("rank")).where(F.col("sum") <= max_bytes)
    return texts.join(F.broadcast(taken.select("doc_id", "h", "label", "rank")), ["doc_id", "h"]).select("rank", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, max_bytes: int = 32 << 20) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of labelled_rows, in their order."""
    rows = labelled_rows(docs, labels, label, usable, max_rows, max_bytes).dropDuplicates(["rank"]).toArrow().sort_by("rank")
    return rows["text"].to_pylist(), rows["label"].to_numpy().astype(float)


def score_column(model: LinearModel, column: pa.Array, weights: np.ndarray) -> np.ndarray:
    total = np.full(len(column), model.bias)
    any_level = weights != 0
    for k in range(1, len(_SHARES) + 1):
        any_level |= np.roll(weights, -k * _STEP) != 0
    for first, size, rows, hashed, single in features(column, model.bits):
        on = any_level[hashed]
        row, feature = levels(size, rows[on], hashed[on], single[on], model.bits)
        np.add.at(total, first + row, weights[feature])
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: LinearModel, name: str = "toxicity") -> DataFrame:
    """docs with a double column ``name`` (0 to 1), in place of one of that name; the other columns pass through. One map-only stage."""
    docs = docs.drop(name)
    schema = plus(docs.schema, **{name: "double"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.dense()
        for b in batches:
            if b.num_rows:
                s = score_column(shared.value, b.column(b.schema.get_field_index("text")), weights)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
