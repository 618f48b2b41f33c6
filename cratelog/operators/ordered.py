"""Running sums over rows in one order, without all rows in one task.

Rows are dealt by ranges of the order and written once with the number of their range, since bounds of ranges are sampled
and another evaluation may draw others. What stands before a row is then what its own range has before it, and the sums of the ranges before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def written(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """rows, written once to a folder, the shared one unless another is given."""
    path = f"{folder or shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def runs(rows: DataFrame, *order: str, folder: str | None = None) -> DataFrame:
    """rows with run_; all rows of a run come before those of the next. Written once."""
    return written(rows.repartitionByRange(*order).withColumn("run_", F.spark_partition_id()), "runs", folder)


def running(rows: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """rows of ``runs`` with, for each of values, its sum (long) over the rows before in this order, within those that agree in ``by``, the first of order."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    within, between = Window.partitionBy("run_", *by).orderBy(*order), Window.partitionBy(*by).orderBy("run_")
    sums = rows.groupBy("run_", *by).agg(*[F.sum(c).alias(f"{n}__all") for n, c in values.items()])
    bases = sums.select("run_", *by, *[before(f"{n}__all", between).alias(f"{n}__base") for n in values])
    own = rows.withColumns({n: before(c, within) for n, c in values.items()}).join(bases, ["run_", *by])
    return own.withColumns({n: F.col(n) + F.col(f"{n}__base") for n in values}).drop(*[f"{n}__base" for n in values])
