"""Structured Streaming jobs: ingest with dead letters, keyed feature and drift state, campaigns,
idempotent upserts, live summaries, replay, late-event routing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions import scalar as S
from tidewatch.operators.drift import Monitor
from tidewatch.sources.tables import EVENT, latest_by, rejections

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than executor memory needs the disk-backed store with its own checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- ingest -------------------------------------------------------------------------------------- #

PLACE, DEVICE, FLOATS = ("country", "city", "lat", "lon"), ("os", "mac", "protocol", "user_agent"), ("session_duration", "bytes_out", "bytes_in")
#: Every value is read as text and typed afterwards; flat place and device fields are taken under their own names.
MESSAGE = (
    "event_id string, entity_id string, entity_type string, timestamp string, source_ip string, geo struct<country string, city string, lat string, lon string>, "
    "device_fingerprint struct<os string, mac string, protocol string, user_agent string>, resource_accessed string, auth_method string, auth_success string, "
    "session_id string, session_duration string, command_sequence array<string>, bytes_out string, bytes_in string, split string, "
    + ", ".join([*(f"geo_{n} string" for n in PLACE), *(f"device_{n} string" for n in DEVICE)]) + ", _corrupt string"
)


def parse_messages(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text -> typed event columns plus ``reasons`` (why a message cannot be used) and the columns named in keep.

    Place and device may be nested (``geo``, ``device_fingerprint``) or flat. Numbers and flags may come as text such as
    "1,234", "83%" or "yes". An absent event id is made from the message's own text, so a replay gives it again; absent
    success counts as true, absent volumes and durations as zero, absent commands as none.
    """
    e = raw.withColumn("_e", F.from_json(F.col(column).cast("string"), MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    e = e.select(F.col(column).cast("string").alias("raw"), *keep, "_e.*").withColumn("_broken", F.col("_corrupt").isNotNull() | F.col("raw").isNull())
    flat = e.select("*", *[F.coalesce(F.col(f"geo.{n}"), F.col(f"geo_{n}")).alias(f"_geo_{n}") for n in PLACE],
                    *[F.coalesce(F.col(f"device_fingerprint.{n}"), F.col(f"device_{n}")).alias(f"_device_{n}") for n in DEVICE])
    flat = flat.drop(*(f"geo_{n}" for n in PLACE), *(f"device_{n}" for n in DEVICE))
    flat = flat.withColumnsRenamed({f"_{k}_{n}": f"{k}_{n}" for k, ns in (("geo", PLACE), ("device", DEVICE)) for n in ns})
    typed, bad = {}, []
    for names, read, absent in ((FLOATS, S.coerce_float, F.lit(0.0)), (("geo_lat", "geo_lon"), S.coerce_float, None), (("auth_success",), S.coerce_bool, F.lit(True))):
        for n in names:
            value = read(F.col(n))
            bad.append(F.when(F.col(n).isNotNull() & value.isNull(), F.lit(n)))
            typed[n] = value if absent is None else F.when(F.col(n).isNull(), absent).otherwise(value)
    texts = ("entity_id", "entity_type", "source_ip", "resource_accessed", "auth_method", "session_id", *(f"geo_{n}" for n in ("country", "city")), *(f"device_{n}" for n in DEVICE))
    typed |= {n: F.trim(n) for n in texts}
    typed["device_mac"] = F.lower(F.trim("device_mac"))
    typed["event_id"] = F.coalesce(F.trim("event_id"), S.stable_id("evt", F.col("raw")))
    typed["command_sequence"] = F.coalesce("command_sequence", F.array().cast("array<string>"))
    typed["timestamp"] = F.col("timestamp").try_cast("timestamp")
    out = flat.withColumn("_bad", F.filter(F.array(*bad), lambda m: m.isNotNull())).withColumns(typed).withColumn("ts_us", F.unix_micros("timestamp"))
    short = F.when(F.length("source_ip") < 3, F.array(F.lit("source_ip"))).otherwise(F.array().cast("array<string>"))
    reasons = F.when(F.col("_broken"), F.array(F.lit("unparseable"))).otherwise(F.array_sort(F.array_distinct(F.concat(rejections(), short, "_bad"))))
    return out.withColumn("reasons", reasons).select("raw", *keep, *EVENT.fieldNames(), "ts_us", "reasons")


def good_and_dead(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events, and dead letters; a bad message never stops the stream."""
    return (
        parsed.filter(F.size("reasons") == 0).drop("raw", "reasons"),
        parsed.filter(F.size("reasons") > 0).select("raw", "reasons"),
    )


def message_stream(spark: SparkSession, fmt: str, **options) -> DataFrame:
    """Any source with a ``value`` column: text files here, a broker on a cluster."""
    return spark.readStream.format(fmt).options(**options).load()


def detections_to_messages(detections: DataFrame) -> DataFrame:
    return detections.select(F.col("entity_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stored table as a stream, a few files per micro-batch; run with availableNow to stop at the end."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


# --- keyed feature state --------------------------------------------------------------------------- #

FEATURE_SCHEMA = (
    "entity_id string, event_id {id}, ts_us bigint, log_seconds_since_prev double, log_distance_from_prev_km double, "
    "device_changed_from_prev double, window_event_count double, window_auth_failures double, window_distinct_resources double, "
    "log_window_bytes_out double, window_distinct_sessions double, session_event_index double, session_distinct_resources double, "
    "session_auth_failures double, is_new_session double, bytes_out_zscore double, bytes_in_zscore double, "
    "session_duration_zscore double, interval_zscore double, sequence_length_zscore double, is_new_country double, "
    "is_new_device_mac double, cold_start double, profile_confidence double"
)
STREAM_FEATURES = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")][3:]


def _km(lat1, lon1, lat2, lon2) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def _z(x, n, s, q) -> float:
    if n < 2:
        return 0.0
    return (x - s / n) / max(math.sqrt(max(0.0, q / n - (s / n) ** 2)), 0.1)


class FeatureState(StatefulProcessor):
    """Per entity: a bounded trailing window, the previous event, running sums, and - each in its own
    keyed store, so only touched entries are read - the sessions and values seen."""

    def __init__(self, settings: Settings):
        self.s = settings

    def init(self, handle) -> None:
        self.core = handle.getValueState(
            "core", "n bigint, us bigint, lat double, lon double, mac string, sums array<double>, s_before bigint, s_blk bigint, s_in bigint"
        )
        self.recent = handle.getValueState(
            "recent", "us array<bigint>, ok array<boolean>, sid array<string>, sent array<double>, res array<string>"
        )
        self.sessions = handle.getMapState("sessions", "sid string", "us bigint")
        self.seen = handle.getMapState("seen", "v string", "before bigint, blk bigint, inside bigint")

    def _seen(self, dim: str, value: str, blk: int, add: bool) -> int:
        key = (dim + "\u0001" + str(value),)
        before, last, inside = self.seen.getValue(key) if self.seen.containsKey(key) else (0, blk, 0)
        if last != blk:
            before, last, inside = before + inside, blk, 0
        if add:
            self.seen.updateValue(key, (before, last, inside + 1))
        return before

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        if self.core.exists():
            n, us, lat, lon, mac, sums, s_before, s_blk, s_in = self.core.get()
            win = [list(x) for x in self.recent.get()]
            sums = list(sums)
        else:
            n, us, lat, lon, mac, sums, s_before, s_blk, s_in = 0, 0, 0.0, 0.0, "", [0.0] * 15, 0, -1, 0
            win = [[], [], [], [], []]
        out = []
        for r in batch.itertuples(index=False):
            row, (n, us, lat, lon, mac, sums, s_before, s_blk, s_in) = self._one(
                r, n, us, lat, lon, mac, sums, s_before, s_blk, s_in, win
            )
            out.append((key[0], *row))
        self.core.update((n, us, lat, lon, mac, sums, s_before, s_blk, s_in))
        self.recent.update(tuple(win))
        yield pd.DataFrame(out, columns=["entity_id", "event_id", "ts_us", *STREAM_FEATURES])

    def _one(self, r, n, us, lat, lon, mac, sums, s_before, s_blk, s_in, win):
        s, t = self.s, int(r.ts_us)
        span = s.window_minutes * 60_000_000
        first = n == 0
        blk = -1 if first else (n - 1) // s.refresh_every
        if s_blk != blk:
            s_before, s_blk, s_in = s_before + s_in, blk, 0
        known = bool(r.session_id) and self.sessions.containsKey((r.session_id,))
        # the stored window ends at the previous event's cut-off: that is the session's view
        same = [i for i in range(len(win[0])) if r.session_id and win[2][i] == r.session_id]
        live = [i for i in range(len(win[0])) if win[0][i] >= t - span]
        gap = math.log1p(max(0.0, (t - us) / 1e6)) if not first else None
        signals = [
            math.log1p(max(0.0, r.bytes_out)), math.log1p(max(0.0, r.bytes_in)), math.log1p(max(0.0, r.session_duration)),
            gap, float(len(r.command_sequence)),
        ]
        z = [0.0 if x is None else _z(x, *sums[3 * i : 3 * i + 3]) for i, x in enumerate(signals)]
        weight = 0.0 if first else 1.0 if s_before >= s.min_sessions else s_before / (s_before + s.prior_sessions)
        fresh = [float(self._seen(d, v, blk, True) == 0 and not first and weight > 0) for d, v in (("c", r.geo_country), ("m", r.device_mac))]
        bad = 0 if r.auth_success else 1
        sids = {win[2][i] for i in live if win[2][i]} | ({r.session_id} if r.session_id else set())
        row = (
            r.event_id, t, gap or 0.0, 0.0 if first else math.log1p(_km(lat, lon, r.geo_lat, r.geo_lon)),
            float(not first and mac != r.device_mac), len(live) + 1.0, float(sum(not win[1][i] for i in live) + bad),
            float(len({win[4][i] for i in live} | {r.resource_accessed})), math.log1p(max(0.0, sum(win[3][i] for i in live) + r.bytes_out)),
            float(len(sids)), float(len(same)), float(len({win[4][i] for i in same} | {r.resource_accessed})),
            float(sum(not win[1][i] for i in same) + bad), float(not known), *z, *fresh, float(s_before < s.min_sessions), weight,
        )
        for i, x in enumerate(signals):
            if x is not None:
                sums[3 * i] += 1.0
                sums[3 * i + 1] += x
                sums[3 * i + 2] += x * x
        if r.session_id and not known:
            self.sessions.updateValue((r.session_id,), (t,))
            s_in += 1
        for store, x in zip(win, (t, bool(r.auth_success), r.session_id, float(r.bytes_out), r.resource_accessed)):
            store.append(x)
        drop = max(sum(x < t - span for x in win[0]), len(win[0]) - s.window_cap)
        for store in win:
            del store[:drop]
        return row, (n + 1, t, float(r.geo_lat), float(r.geo_lon), r.device_mac, sums, s_before, s_blk, s_in)

    def close(self) -> None:
        pass


FEATURE_INPUT = (
    "entity_id", "event_id", "ts_us", "session_id", "geo_lat", "geo_lon", "geo_country", "device_mac", "auth_success",
    "resource_accessed", "bytes_out", "bytes_in", "session_duration", "command_sequence",
)


def feature_stream(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Stateful features of an event stream; equal to the batch features for events in order."""
    return events.select(*FEATURE_INPUT).groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=FeatureState(s), outputStructType=FEATURE_SCHEMA.replace("{id}", dict(events.dtypes)["event_id"]), outputMode="Append", timeMode="None"
    )


# --- keyed drift state ------------------------------------------------------------------------------ #


class DriftState(StatefulProcessor):
    def __init__(self, settings: Settings):
        self.s = settings

    def init(self, handle) -> None:
        self.state = handle.getValueState("m", "seen bigint, buffer array<double>, edges array<double>, base array<double>, streak bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = Monitor(self.s)
        if self.state.exists():
            seen, buffer, edges, base, streak = self.state.get()
            m.seen, m.buffer, m.streak = seen, list(buffer), streak
            m.edges, m.base = (list(edges), list(base)) if len(edges) else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_us", "event_id"]).itertuples(index=False):
            psi, status, n = m.push(r.value)
            if status != "bootstrap":
                out.append((key[0], r.event_id, int(r.ts_us), n, psi, status))
        floats = lambda xs: [float(x) for x in xs or []]
        self.state.update((m.seen, floats(m.buffer), floats(m.edges), floats(m.base), m.streak))
        yield pd.DataFrame(out, columns=["entity_id", "event_id", "ts_us", "samples", "psi", "status"])

    def close(self) -> None:
        pass


def drift_stream(signal: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return signal.groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=DriftState(s),
        outputStructType=f"entity_id string, event_id {dict(signal.dtypes)['event_id']}, ts_us bigint, samples bigint, psi double, status string",
        outputMode="Append", timeMode="None",
    )


# --- campaigns, summaries, late events ---------------------------------------------------------------- #


def campaign_stream(detections: DataFrame, s: Settings = DEFAULTS, lateness: str = "1 hour") -> DataFrame:
    """Campaigns as event-time sessions; one row when a campaign's 72 hours have passed."""
    hours = f"{int(s.campaign_gap_hours)} hours"
    return (
        detections.filter("is_anomaly").withWatermark("timestamp", lateness)
        .groupBy("entity_id", F.session_window("timestamp", hours).alias("w"))
        .agg(F.count(F.lit(1)).alias("stages"), F.max("risk").alias("max_risk"), F.min("ts_us").alias("started_us"), F.max("ts_us").alias("last_us"))
        .drop("w")
    )


def traffic_stream(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", length, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.when(F.col("auth_success"), 0.0).otherwise(1.0)).alias("failure_rate")
    ).select(F.unix_micros("w.start").alias("start_us"), "events", "failure_rate")


def summary_stream(detections: DataFrame) -> DataFrame:
    """Running totals by type for a live view (complete output mode)."""
    return detections.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("max_risk"))


def with_offsets(detections: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stream-static join: the offsets table is read anew for every micro-batch."""
    return detections.join(offsets.select("entity_id", "offset"), "entity_id", "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))


def split_late(batch: DataFrame, horizon_us: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) against the newest event time handled so far."""
    return batch.filter(F.col("ts_us") >= horizon_us), batch.filter(F.col("ts_us") < horizon_us)


# --- sinks --------------------------------------------------------------------------------------------- #


def upsert(path: str, key: str, *order: str):
    """foreachBatch sink keeping the latest row per key. Every batch writes a new version folder named
    by its id and a batch that is retried overwrites its own version, so the result is the same
    however often it runs. Read it back with :func:`read_upserted`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = read_upserted(spark, path, batch_id)
        rows = batch if earlier is None else earlier.unionByName(batch)
        latest_by(rows, key, *[F.col(o) for o in order]).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def read_upserted(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table (strictly before a batch id when given)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
        if name.startswith("v=") and done:
            versions.append(int(name[2:]))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(versions)}") if versions else None
