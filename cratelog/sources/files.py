"""Files written by tasks to a folder that all executors share, and committed together.

Each task writes its files into a staging folder below the target, and says where. When all are there,
names that two rows want are an error and nothing is changed; else the files are renamed into place. What failed
tasks left goes with the staging folder. Folders may be on any file system that both Spark and pyarrow know.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file with Spark's own file systems; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def relative(name: str) -> str:
    """A file's name below the target folder; one that leads out of it is an error."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise ValueError(f"not a name below the folder: {name!r}")
    return "/".join(parts)


def write(rows: DataFrame, folder: str) -> int:
    """Write (name, body) rows as files; how many there are now of them. Existing files of the same names are replaced."""
    spark, staging = rows.sparkSession, f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(staging)
        system.create_dir(root, recursive=True)
        for b in batches:
            names = [relative(n) for n in b.column(0).to_pylist()]
            parts = [f"{root}/{uuid.uuid4().hex}.part" for _ in names]
            for part, body in zip(parts, b.column(1), strict=True):
                with system.open_output_stream(part) as out:
                    out.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["name", "part"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for b in batches:
            for name, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                target = f"{root.rstrip('/')}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                if system.get_file_info(part).type == fs.FileType.File:  # else an earlier attempt of this task has moved it
                    system.move(part, target)
                elif system.get_file_info(target).type != fs.FileType.File:
                    raise FileNotFoundError(part)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        rows.select("name", "body").mapInArrow(put, "name string, part string").write.parquet(f"{staging}/list")
        made = spark.read.schema("name string, part string").parquet(f"{staging}/list")
        twice = made.groupBy("name").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"several rows for one file: {', '.join(r['name'] for r in twice)}")
        return made.mapInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        delete(spark, staging)
