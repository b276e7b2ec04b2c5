"""Session construction for local runs; on a cluster the caller's session is used as is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may leave it unset and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of a task that orders events: its sorts and windows hold up to 60 KB for each.
PART_ROWS = 25_000
#: What a task reads after a shuffle whose size Spark chooses.
READ_BYTES = "8m"


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys into parts of about PART_ROWS of its ``rows`` rows, so that a task's memory does not grow with the table.

    Spark joins shuffled parts until they hold 64 MB, counted before windows and collected rows make them many times as large.
    A part of a given number stays as it is; later shuffles of the session get as many parts at least, of READ_BYTES at most.
    Joins by these keys and more columns keep the parts as well, where Spark would deal the wide rows anew for each.
    """
    spark = df.sparkSession
    parts = max(1, -(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, rows // 1000))
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", READ_BYTES)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # longer methods, as of 59 features in one row, are never compiled by the JVM
    return df.repartition(parts, *keys)


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later jobs read as Parquet in the cluster's shared checkpoint folder.
    Survives losing executors, unlike a cached one; later jobs read only the columns they need."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidewatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidewatch", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tidewatch_shipped = True
    return spark
