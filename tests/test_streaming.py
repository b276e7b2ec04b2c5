"""Streams against their batch counterparts."""

import json
from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS
from tidewatch.operators.campaigns import link, rollup
from tidewatch.operators.drift import adaptive_drift
from tidewatch.operators.features import featurise
from tidewatch.streaming import jobs as J

WIDE = replace(DEFAULTS, window_minutes=360)


def drain(spark, df, tmp, name, mode="append"):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def chunks(events, tmp, name, n=3):
    """The events as n files in time order, so each micro-batch continues where the last one ended."""
    rows = events.select("*", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy("ts_us", "event_id")).alias("part"))
    for i in range(1, n + 1):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp}/{name}")
    return f"{tmp}/{name}"


def test_feature_stream_equals_batch(spark, events, tmp_path):
    J.use_rocksdb(spark)
    path = chunks(events, tmp_path, "ev")
    got = drain(spark, J.feature_stream(J.replay(spark, path, events.schema, 1), WIDE), tmp_path, "feats").toPandas()
    want = featurise(events, WIDE, names=J.STREAM_FEATURES).select("event_id", *J.STREAM_FEATURES).toPandas()
    got, want = got.set_index("event_id").sort_index(), want.set_index("event_id").sort_index()
    assert len(got) == len(want) > 100
    for c in J.STREAM_FEATURES:
        assert (got[c] - want[c]).abs().max() < 1e-6, c
    assert want["is_new_country"].sum() > 0 and want["window_event_count"].max() > 1


def test_drift_stream_equals_batch(spark, events, tmp_path):
    J.use_rocksdb(spark)
    signal = events.selectExpr("entity_id", "ts_us", "event_id", "log1p(value) AS value")
    path = chunks(signal, tmp_path, "sig")
    got = drain(spark, J.drift_stream(J.replay(spark, path, signal.schema, 1)), tmp_path, "drift").toPandas()
    want = adaptive_drift(signal).toPandas()
    key = ["entity_id", "event_id"]
    m = got.merge(want, on=key, suffixes=("", "_w"))
    assert len(m) == len(want) == len(got) > 0
    assert (m["psi"] - m["psi_w"]).abs().max() < 1e-9 and (m["status"] == m["status_w"]).all()


def test_bad_messages_go_to_dead_letters(spark, tmp_path):
    ok = {"event_id": "1", "entity_id": "u", "entity_type": "user", "timestamp": "2026-03-02T09:30:00Z", "source_ip": "1.2.3.4",
          "geo_lat": 1.0, "geo_lon": 2.0, "resource_accessed": "/a", "auth_method": "mfa", "auth_success": True,
          "session_duration": 1.0, "bytes_out": 1.0, "bytes_in": 1.0}
    lines = [json.dumps(ok), "not json", json.dumps({**ok, "event_id": "2", "geo_lat": 99.0})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    good, dead = J.good_and_dead(J.parse_messages(J.message_stream(spark, "text", path=str(tmp_path / "in"))))
    assert [r.event_id for r in drain(spark, good, tmp_path, "good").collect()] == ["1"]
    assert sorted(tuple(r.reasons) for r in drain(spark, dead, tmp_path, "dead").collect()) == [("lat",), ("unparseable",)]


def test_campaign_stream_equals_batch_once_closed(spark, events, tmp_path):
    det = events.selectExpr("event_id", "entity_id", "timestamp", "ts_us", "value AS risk", "value > 100 AS is_anomaly", "'brute_force' AS anomaly_type")
    last = det.agg(F.max("ts_us")).first()[0]
    closing = spark.range(1).selectExpr("-1L AS event_id", "'zz' AS entity_id", f"timestamp_micros({last} + 864000000000) AS timestamp",
                                        f"{last} + 864000000000 AS ts_us", "1D AS risk", "true AS is_anomaly", "'brute_force' AS anomaly_type")
    path = str(tmp_path / "det")
    det.coalesce(1).write.parquet(path)
    closing.coalesce(1).write.mode("append").parquet(path)
    got = drain(spark, J.campaign_stream(J.replay(spark, path, det.schema, 1)), tmp_path, "camp").filter("entity_id <> 'zz'").toPandas()
    want = rollup(link(det.filter("is_anomaly").drop("timestamp"))).toPandas()
    key = ["entity_id", "started_us", "last_us", "stages"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values)) and len(got) > 1


def test_upsert_keeps_the_last_write_and_survives_a_retry(spark, tmp_path):
    write = J.upsert(str(tmp_path / "t"), "k", "at")
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "only")], "k string, at int, v string")
    b = spark.createDataFrame([("x", 2, "new")], "k string, at int, v string")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    rows = {r.k: r.v for r in J.read_upserted(spark, str(tmp_path / "t")).collect()}
    assert rows == {"x": "new", "y": "only"}


def test_summary_stream_counts_everything(spark, events, tmp_path):
    det = events.selectExpr("label AS anomaly_type", "value AS risk")
    path = chunks(events, tmp_path, "sum")
    live = J.summary_stream(J.replay(spark, path, events.schema, 1).selectExpr("label AS anomaly_type", "value AS risk"))
    got = drain(spark, live, tmp_path, "live", "complete")
    assert {(r.anomaly_type, r.n) for r in got.collect()} == {(r.anomaly_type, r["count"]) for r in det.groupBy("anomaly_type").count().collect()}
