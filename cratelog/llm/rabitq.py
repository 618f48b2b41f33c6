"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred and rotated, and only the signs are kept, packed, with two scalars: the
distance from the centre, and the inner product of the rotated unit vector with its code. A
query's components are rounded to a few bits, so its inner product with a code is a sum of bit
counts of packed words. From it the inner product with the vector itself is estimated without bias,
with an error bound of ``epsilon`` standard deviations and what the rounding adds at most. A query
first computes the exact distances of the best estimates of a batch of rows; after that, only of rows that could by
their bound still be nearer than its k nearest so far.

The index is fitted (centre) on a bounded sample, holds every row, and is written once. Rows stay where
they are: a block of at most ``queries`` query vectors is broadcast, each task returns the
k nearest of its rows to each, and the block's result is written before the next is read. So neither the plan nor the driver
grows with the number of queries; the shuffle grows with queries times tasks; the work grows with
queries times rows, since vectors without clusters give no index anything to skip.
Copies of one vector count once in a batch, with the k + 1 smallest ids, which is exact.

Rows whose id is null, or whose vector is null, zero, of another length than most, or holds null
or non-finite numbers take no part. Ties go to the smaller id. Of several vectors for one query id the smallest is asked;
a candidate that comes twice is found twice. Other columns than key and vector play no part, an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_folder, scratch, stored

FOUND = "query_id long, vec_id long, score double, rank int"


@dataclass(frozen=True)
class CodeParams:
    """``sample`` bounds the rows that the centre is fitted on, ``queries`` those of a broadcast, ``bits`` are those of a query's components."""

    k: int = 10
    epsilon: float = 4.0
    first: int = 64
    bits: int = 6
    queries: int = 4_096
    sample: int = 4_096


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(3).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, zeros after the last."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance from the centre, inner product of unit vector and code)."""
    y = (x - centre) @ turn
    norm = np.linalg.norm(y, axis=1)
    fit = np.abs(y).sum(1) / np.sqrt(x.shape[1]) / np.maximum(norm, 1e-300)
    return packed(y > 0), norm, np.where(norm > 0, fit, 1.0)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, the squares added in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d].astype(float) - float(q[d])) ** 2
    return np.sqrt(total)


@dataclass(frozen=True)
class Queries:
    """Query vectors, and their rotated components as bit planes: about low + step * the sum of 2**b over the planes that have a bit."""

    ids: np.ndarray
    vectors: np.ndarray
    norm: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    whole: np.ndarray
    rounding: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, bits: int) -> Queries:
        y = (vectors - centre) @ turn
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / (2**bits - 1), 1e-300)
        level = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
        near = low[:, None] + step[:, None] * level
        planes = np.stack([packed(level >> b & 1) for b in range(bits)], axis=1)
        return Queries(ids, vectors, np.linalg.norm(y, axis=1), planes, low, step, near.sum(axis=1), np.abs(near - y).sum(axis=1))

    def products(self, j: int, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of query j's rounded components with codes of +1 and -1."""
        total = np.zeros(len(codes))
        for b, plane in enumerate(self.planes[j]):
            total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) * float(1 << b)
        return 2 * (self.low[j] * ones + self.step[j] * total) - self.whole[j]


class Nearest:
    """The k nearest rows so far to each query."""

    def __init__(self, q: Queries, p: CodeParams):
        self.q, self.p = q, p
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q.ids)
        self.distances: list[np.ndarray] = [np.zeros(0)] * len(q.ids)

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        p, dim = self.p, x.shape[1]
        keep = _few_copies(ids, x, p.k)
        ids, x, codes, norm, fit = ids[keep], x[keep], codes[keep], norm[keep], fit[keep]
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        spread = p.epsilon * np.sqrt(np.maximum(1 - fit**2, 0)) / np.maximum(fit, 1e-12) / np.sqrt(max(dim - 1, 1))
        scale = norm / (np.sqrt(dim) * np.maximum(fit, 1e-12))
        for j, own in enumerate(self.q.ids):
            estimate = norm**2 + self.q.norm[j] ** 2 - 2 * scale * self.q.products(j, codes, ones)
            slack = 2 * norm * spread * self.q.norm[j] + 2 * scale * self.q.rounding[j]
            other = ids != own
            estimate[~other] = np.inf
            if len(self.ids[j]) < p.k:
                best = np.argpartition(estimate, p.first)[: p.first] if len(ids) > p.first else np.arange(len(ids))
                distance = np.sort(exact(x[best[other[best]]], self.q.vectors[j]))
                reach = distance[p.k - 1] if len(distance) >= p.k else np.inf
            else:
                reach = self.distances[j][-1]
            best = np.flatnonzero((estimate - slack <= reach**2 * (1 + 1e-9)) & other)
            if len(best):
                found, at = np.r_[self.ids[j], ids[best]], np.r_[self.distances[j], exact(x[best], self.q.vectors[j])]
                top = np.lexsort((found, at))[: p.k]
                self.ids[j], self.distances[j] = found[top], at[top]


def _few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers that leave of each vector the k + 1 copies of the smallest ids."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, which = np.unique(rows, return_inverse=True)
    copy = np.argsort(which, kind="stable")
    begin = np.r_[True, which[copy][1:] != which[copy][:-1]]
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(begin, np.arange(len(ids)), 0))
    return order[np.sort(copy[place <= k])]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vector: str) -> Column:
    broken = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def index(rows: DataFrame, p: CodeParams = CodeParams(), key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
    """(written table of id, v, code, norm and fit of every usable row; dimension, centre, rotation)."""
    valid = rows.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    valid = valid.where(F.size("v") == dim)
    sample = [r["v"] for r in valid.orderBy(F.xxhash64("id"), "id").limit(p.sample).select("v").collect()]
    centre, turn = np.mean(np.array(sample, float), axis=0) if sample else np.zeros(dim), rotation(dim)
    shared = rows.sparkSession.sparkContext.broadcast((centre, turn))
    kind = rows.schema[vector].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        for b in batches:
            if b.num_rows:
                codes, norm, fit = encode(_matrix(b.column(1), dim).astype(float), centre, turn)
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, words, pa.array(norm), pa.array(fit)], names=["id", "v", "code", "norm", "fit"])

    return checkpoint(valid.mapInArrow(run, f"id long, v {kind}, code array<long>, norm double, fit double")), dim, centre, turn


def search(rows: DataFrame, is_query: Column, p: CodeParams = CodeParams(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows nearest to each query row, its own id left out."""
    coded, dim, centre, turn = index(rows, p, key, vector)
    asked = rows.where(is_query & F.col(key).isNotNull() & usable(vector) & (F.size(vector) == dim)).groupBy(F.col(key).cast("long").alias("query_id")).agg(F.min(vector).alias("q"))
    spark, folder = rows.sparkSession, f"{checkpoint_folder(rows.sparkSession)}/nearest-{uuid.uuid4().hex}"

    def near(shared: Broadcast) -> DataFrame:
        """The k nearest of each query of a block among the rows of each task."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(shared.value, p)
            for b in batches:
                if b.num_rows:
                    codes = _matrix(b.column(2), -(-dim // 64)).view(np.uint64)
                    found.add(b.column(0).to_numpy(), _matrix(b.column(1), dim), codes, b.column(3).to_numpy(), b.column(4).to_numpy())
            sizes = [len(i) for i in found.ids]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found.q.ids, sizes)), pa.array(np.concatenate(found.ids)), pa.array(np.concatenate(found.distances))], names=["query_id", "vec_id", "score"])

        every = coded.mapInArrow(run, "query_id long, vec_id long, score double")
        return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= p.k)

    spark.createDataFrame([], FOUND).write.parquet(folder)
    with scratch(spark, "nearest-queries") as at:
        asked = stored(asked, f"{at}/asked")
        blocks = max(1, -(-asked.count() // p.queries))
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).write.partitionBy("block").parquet(f"{at}/blocks")
        dealt = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in asked.schema)}, block long").parquet(f"{at}/blocks")
        for k in range(blocks):  # one block is with the driver and the tasks at a time; its result is written, then it is freed
            own = dealt.where(F.col("block") == k).select("query_id", "q").toArrow()
            if own.num_rows:
                shared = spark.sparkContext.broadcast(Queries.of(own["query_id"].to_numpy(), _matrix(own["q"], dim).astype(float), centre, turn, p.bits))
                near(shared).write.mode("append").parquet(folder)
                shared.destroy()
    return spark.read.schema(FOUND).parquet(folder).select("query_id", "rank", "vec_id", "score")
