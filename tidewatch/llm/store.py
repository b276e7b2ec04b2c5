"""Intermediate tables in the cluster's shared folder. They cut lineage and survive the loss of executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local session may leave it unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidewatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def drop(df: DataFrame) -> None:
    """Remove a table that save() wrote and nothing reads any more."""
    path = getattr(df, "_saved_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def prepare(spark: SparkSession) -> SparkSession:
    """Texts are long: a Python worker gets few rows at a time, so that a batch stays at some megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine; TOKENIZER_DIR overrides the installed package."""
    root = os.environ.get("TOKENIZER_DIR")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
