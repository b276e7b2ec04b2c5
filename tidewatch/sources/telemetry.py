"""Adapter: reads the generic ``events`` table as access telemetry.

Deterministic and arithmetic only, so that the same table can be stated in plain SQL for checking
(:data:`tidewatch.catalog.sql.EVENTS`). Ten users are folded into one entity. A fifth of the entities gets another id
before COLD_FROM_US, so that its later one starts cold; every row of the table is read.
"""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import time_split

# Fixed values: (index, lat, lon, country, city) of the places telemetry comes from.
PLACES = (
    (0, 12.9716, 77.5946, "India", "Bengaluru"),
    (1, 51.5074, -0.1278, "United Kingdom", "London"),
    (2, 1.3521, 103.8198, "Singapore", "Singapore"),
    (3, 40.7128, -74.0060, "United States", "New York"),
    (4, -23.5505, -46.6333, "Brazil", "Sao Paulo"),
    (5, 6.5244, 3.3792, "Nigeria", "Lagos"),
    (6, 50.4501, 30.5234, "Ukraine", "Kyiv"),
    (7, 4.7110, -74.0721, "Colombia", "Bogota"),
)
SESSION_SECONDS = 14400
COLD_FROM_US = 1706486400000000  # 2024-01-29 00:00 UTC: cold entities start here
WEEK_SECONDS = 604800


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def split_bounds(us_min: int, us_max: int) -> tuple[int, int]:
    span = us_max - us_min
    return us_min + span * 60 // 100, us_min + span * 80 // 100


def load_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load_raw(spark, sf_dir)
    lo, hi = raw.agg(F.min("ts"), F.max("ts")).first()
    us = [int(t.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 + t.microsecond for t in (lo, hi)]
    train_end, val_end = split_bounds(*us)

    base = raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr("user_id div 10").alias("ent"),
    )
    k, ent = F.col("k"), F.col("ent")
    early = F.when((ent % 5 == 1) & (F.col("ts_us") < COLD_FROM_US), "_old").otherwise("")
    who = F.concat(ent.cast("string"), early)
    place = F.when(k >= 97, (ent + 1 + F.col("event_id") % 7) % 8).otherwise(ent % 8).cast("int")
    session = F.concat_ws("_", ent.cast("string"), F.expr(f"(ts_us div 1000000) div {SESSION_SECONDS}").cast("string"))
    label = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), "brute_force")
        .when(F.col("value") > 150, "low_and_slow_exfil")
        .when(k >= 98, "impossible_travel")
        .otherwise("normal")
    )
    week = F.expr(f"(ts_us div 1000000) div {WEEK_SECONDS}")
    df = base.withColumn("session_id", session).withColumn("label", label).withColumn("place", place)
    recent = Window.partitionBy("session_id").orderBy("ts_us", "event_id").rowsBetween(-4, 0)
    return df.select(
        "event_id",
        F.concat(F.lit("ent_"), who).alias("entity_id"),
        _pick(("user", "service_account", "edge_device"), (ent % 3).cast("int")).alias("entity_type"),
        "timestamp",
        "ts_us",
        F.concat_ws(
            ".", F.lit("10"), (ent % 200).cast("string"), (k % 4).cast("string"), (F.col("event_id") % 250).cast("string")
        ).alias("source_ip"),
        _pick([p[3] for p in PLACES], F.col("place")).alias("geo_country"),
        _pick([p[4] for p in PLACES], F.col("place")).alias("geo_city"),
        _pick([p[1] for p in PLACES], F.col("place")).alias("geo_lat"),
        _pick([p[2] for p in PLACES], F.col("place")).alias("geo_lon"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), (k % 10).cast("string")).alias("resource_accessed"),
        _pick(("password", "token", "certificate", "biometric", "mfa"), k % 5).alias("auth_method"),
        (F.col("event_type") != "error").alias("auth_success"),
        "session_id",
        (k * F.lit(10.0)).alias("session_duration"),
        F.collect_list("event_type").over(recent).alias("command_sequence"),
        _pick(("linux", "windows", "macos"), k % 3).alias("device_os"),
        F.concat(F.lit("02:00:"), (ent * 7 + F.expr("k div 33")).cast("string")).alias("device_mac"),
        _pick(("https", "ssh", "mqtt", "rdp"), k % 4).alias("device_protocol"),
        F.concat(F.lit("agent/"), (k % 3).cast("string")).alias("device_user_agent"),
        (F.col("value") * 1000).alias("bytes_out"),
        (F.col("value") * 100).alias("bytes_in"),
        "value",
        "label",
        F.when(
            F.col("label") != "normal", F.concat_ws("_", F.lit("c"), who, week.cast("string"))
        ).alias("campaign_id"),
        F.when(F.col("label") != "normal", (k % 4).cast("bigint")).alias("stage"),
        time_split(F.col("ts_us"), F.lit(train_end), F.lit(val_end)).alias("split"),
    )
