"""Reading input tables and writing intermediate ones where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and Spark runs on this machine alone (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="segno-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/segno-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; a null text counts as an empty one."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, y: one 0/1 label for each document that has any (the majority; a tie is 1)."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("double").alias("y"))
    )


def held_out() -> F.Column:
    """True for the rows whose crc32(doc_id as text) mod 5 is 0; they are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_sample(labels: DataFrame, name: str, most: int) -> DataFrame:
    """At most `most` labelled documents (doc_id, y) to learn from, the first by a hash of doc_id."""
    return one_label(labels, name).where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
