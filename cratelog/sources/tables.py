"""Catalogue tables as Parquet folders, partitioned by a column: appended to, replaced by partition, merged by key.

Only the partitions concerned are written; the files of the others stay as they are. New rows are written to a staging
folder first, so a table can be read while it is replaced, and a failure before the last step changes nothing.
A repeated call gives the same table. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table; empty if nothing was ever written."""
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str, by: str) -> None:
    rows.write.partitionBy(by).mode("append").parquet(path)


def _replace(rows: DataFrame, path: str, by: str, gone: list) -> None:
    """Make rows the content of their partitions, and delete the partitions ``gone`` that have none."""
    spark, staging = rows.sparkSession, f"{path.rstrip('/')}_staging-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staging)
        made = spark.read.schema(rows.schema).parquet(staging)
        filled = {r[0] for r in made.select(by).distinct().collect()}
        made.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for value in gone:
            if value not in filled:
                files.delete(spark, f"{path.rstrip('/')}/{by}={value}")
    finally:
        files.delete(spark, staging)


def replace_partitions(rows: DataFrame, path: str, by: str, values: list) -> None:
    """The partitions of these values (numbers or plain words) hold exactly rows afterwards, none if there are none; a row of another value is an error."""
    if not rows.where(F.col(by).isNull() | ~F.col(by).isin(values)).isEmpty():
        raise ValueError(f"rows whose {by} is not among {values}")
    _replace(rows, path, by, values)


def upsert(rows: DataFrame, path: str, by: str, *keys: str) -> None:
    """Rows replace those of the same keys in their partition, or are added; of rows with one key, an error. A key stays in its partition."""
    spark = rows.sparkSession
    if not rows.groupBy(by, *keys).count().where("count > 1").isEmpty():
        raise ValueError("several rows for one key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    touched = rows.select(by).distinct()
    old = read(spark, path, schema).select(*rows.columns).join(touched, by, "left_semi")
    _replace(old.join(rows, [by, *keys], "left_anti").select(*rows.columns).unionByName(rows), path, by, [])
