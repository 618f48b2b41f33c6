"""A corpus clean-up: toxic documents and near copies go, then benchmark leaks, then secrets are
masked, and what is left is packed for training.

Each stage gets the session, the documents that its predecessor kept and the folder of the other
tables. All but the last return the columns of documents.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratelog.llm import decontam, neardup, packing, secrets, toxicity
from cratelog.llm.common import checkpoint_folder, fresh, read_table, remove

TOXIC = 0.7
_runs = itertools.count()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; learns from the labels of those at hand."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), "toxic", F.lit(True))
    (name,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of copies and near copies: five-word runs, similarity from 0.8."""
    return neardup.representatives(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    names = fresh(docs, "n_words", "contaminated_spans", "contaminated_items")
    found = decontam.scan(docs, read_table(spark, sf_dir, "benchmark"), 10, names=tuple(names))
    return found.where(F.size(names[1]) == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars of the masked text."""
    forest = secrets.train(secrets.labelled_findings(spark))
    out = secrets.redact(docs, forest, "source")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written as Parquet and read again by the next, and go once that has written its own."""
    docs, folder, before = read_table(spark, sf_dir, "documents"), checkpoint_folder(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/corpus-{spark.sparkContext.applicationId}-{next(_runs)}-{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Packing and the two classifiers are not expressible in SQL; tests compare run() with a plain version.
ORACLE_SQL = None
