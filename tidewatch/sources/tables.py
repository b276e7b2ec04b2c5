"""Access-event tables: schemas, reads with validation and quarantine, writes, fitted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import ANOMALY_CLASSES, AUTH_METHODS, ENTITY_TYPES, SCHEMA_VERSION
from tidewatch.functions import scalar as S

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("geo_city", T.StringType()),
        T.StructField("geo_lat", T.DoubleType()),
        T.StructField("geo_lon", T.DoubleType()),
        T.StructField("resource_accessed", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("auth_success", T.BooleanType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("command_sequence", T.ArrayType(T.StringType())),
        T.StructField("device_os", T.StringType()),
        T.StructField("device_mac", T.StringType()),
        T.StructField("device_protocol", T.StringType()),
        T.StructField("device_user_agent", T.StringType()),
        T.StructField("bytes_out", T.DoubleType()),
        T.StructField("bytes_in", T.DoubleType()),
        T.StructField("split", T.StringType()),
    ]
)
LABEL = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("stage", T.LongType()),
        T.StructField("split", T.StringType()),
    ]
)
TRUTH = ("label", "is_anomaly", "campaign_id", "stage")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(EVENT).parquet(path)
    return df.withColumn("ts_us", F.unix_micros("timestamp"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).parquet(path)


def read_split(events: DataFrame, split: str) -> DataFrame:
    """One split. Order is carried by (timestamp, event_id) in the windows, never by a global sort."""
    part = events.filter(F.col("split") == split)
    if part.limit(1).count() == 0:
        raise ValueError(f"no events in split '{split}'")
    return part


def nest(flat: DataFrame) -> DataFrame:
    rest = [c for c in flat.columns if not c.startswith(("geo_", "device_"))]
    return flat.select(
        *rest,
        F.struct(
            F.col("geo_country").alias("country"),
            F.col("geo_city").alias("city"),
            F.col("geo_lat").alias("lat"),
            F.col("geo_lon").alias("lon"),
        ).alias("geo"),
        F.struct(
            F.col("device_os").alias("os"),
            F.lower(F.trim("device_mac")).alias("mac"),
            F.col("device_protocol").alias("protocol"),
            F.col("device_user_agent").alias("user_agent"),
        ).alias("device_fingerprint"),
    )


def flatten(nested: DataFrame) -> DataFrame:
    rest = [c for c in nested.columns if c not in ("geo", "device_fingerprint")]
    return nested.select(
        *rest,
        *[F.col(f"geo.{n}").alias(f"geo_{n}") for n in ("country", "city", "lat", "lon")],
        *[F.col(f"device_fingerprint.{n}").alias(f"device_{n}") for n in ("os", "mac", "protocol", "user_agent")],
    )


def truth_of(events: DataFrame) -> DataFrame:
    """The truth table of labelled events; an absent label is 'normal'."""
    label = F.coalesce(F.col("label"), F.lit("normal"))
    return events.select(
        "event_id", label.alias("label"), (label != "normal").alias("is_anomaly"),
        "campaign_id", F.col("stage").cast("bigint").alias("stage"), "split",
    )


def strip_truth(events: DataFrame) -> DataFrame:
    return events.drop(*TRUTH)


def rejections() -> Column:
    """Array of reasons an event is invalid; empty when it is fine."""
    c = F.col
    rules = {
        "lat": ~F.coalesce(c("geo_lat").between(-90, 90), F.lit(False)),
        "lon": ~F.coalesce(c("geo_lon").between(-180, 180), F.lit(False)),
        "bytes_out": F.coalesce(c("bytes_out"), F.lit(0.0)) < 0,
        "bytes_in": F.coalesce(c("bytes_in"), F.lit(0.0)) < 0,
        "session_duration": F.coalesce(c("session_duration"), F.lit(0.0)) < 0,
        "entity_type": ~F.coalesce(c("entity_type").isin(*ENTITY_TYPES), F.lit(False)),
        "auth_method": ~F.coalesce(c("auth_method").isin(*AUTH_METHODS), F.lit(False)),
        "entity_id": F.coalesce(F.trim("entity_id"), F.lit("")) == "",
        "source_ip": F.coalesce(F.trim("source_ip"), F.lit("")) == "",
        "resource_accessed": F.coalesce(F.trim("resource_accessed"), F.lit("")) == "",
        "timestamp": c("ts_us").isNull(),
    }
    marks = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return F.filter(marks, lambda m: m.isNotNull())


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with a ``reasons`` array)."""
    checked = events.withColumn("reasons", rejections())
    return (
        checked.filter(F.size("reasons") == 0).drop("reasons"),
        checked.filter(F.size("reasons") > 0),
    )


def coerce(raw: DataFrame) -> DataFrame:
    """Lenient typing of an all-text table; values that cannot be read become null."""
    floats = ("geo_lat", "geo_lon", "session_duration", "bytes_out", "bytes_in")
    return raw.select(
        *[
            S.coerce_float(F.col(n)).alias(n) if n in floats
            else S.coerce_bool(F.col(n)).alias(n) if n == "auth_success"
            else F.col(n)
            for n in raw.columns
        ]
    )


def write_dataset(events: DataFrame, labels: DataFrame, path: str) -> None:
    """Events and truth go to separate tables, so feature jobs cannot read labels by accident."""
    strip_truth(events).write.mode("overwrite").partitionBy("split").parquet(f"{path}/events")
    labels.write.mode("overwrite").partitionBy("split").parquet(f"{path}/labels")


def save_state(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Each fitted table in its own folder, then a one-row manifest written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = spark.createDataFrame(
        [(SCHEMA_VERSION, sorted(tables))], "schema_version int, tables array<string>"
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    row = spark.read.parquet(f"{path}/manifest").first()
    if row.schema_version != SCHEMA_VERSION:
        raise ValueError(f"fitted state has schema {row.schema_version}, this build needs {SCHEMA_VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in row.tables}


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Last write wins per key, as a mergeable aggregate (no per-key sort)."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_last")).select(key, "_last.*")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ANOMALY_CLASSES)), "class_index int, label string")
