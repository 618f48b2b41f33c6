"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a kernel looks at together; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: compressed, and no task runs twice for it."""
    return stored(df, f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written to the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for tables in the shared folder, deleted with them at the end."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at a path."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def in_fold(key: str, folds: int, fold: int) -> Column:
    """True if crc32 of the key's text leaves ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return _FOLD[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all) of the words of every row."""
    inside = ~separator[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    start[at] = inside[at]
    at = offsets[1:][filled] - 1
    end[at] = inside[at]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, by a prefix sum of a polynomial."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashed ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _MULTIPLIER) -> np.ndarray:
    return span_hashes(data, starts, ends, base)


def plus(schema: T.StructType, **columns: str) -> T.StructType:
    """The schema with more columns, given by name and type."""
    return T.StructType([*schema.fields, *(T.StructField(k, T.DoubleType() if v == "double" else T.StringType()) for k, v in columns.items())])


def one_thread() -> None:
    """Keep numeric and tokenizer libraries from starting threads beside Spark's own tasks."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and written intermediate tables, as the session names it.

    Where none is named, a local session gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder
