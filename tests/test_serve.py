"""Messages to detections as a stream: equal to batch, each message once, late ones apart, state that shrinks."""

import json
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS
from tidewatch.operators.features import NUMERIC, featurise
from tidewatch.plans.fit import fit_all
from tidewatch.plans.score import score_table
from tidewatch.streaming import jobs as J
from tidewatch.streaming import serve as SV

#: Small limits, so that cuts, caps, snapshots and points all change within the small table.
TIGHT = replace(DEFAULTS, window_minutes=2000, window_cap=7, refresh_every=3, geo_points=10, min_sessions=3, prior_stat_floor=2, cohort_min_events=2, cohort_count=3,
                top_values={"country": 2, "ip_prefix": 3, "resource": 3, "device_mac": 2, "device_os": 2, "token": 4, "ngram": 4})


@pytest.fixture(scope="module")
def fitted(spark, events):
    state = fit_all(events.filter("split = 'train'"), events.filter("split = 'val'"), events.select("event_id", "label"), TIGHT, trees=3)
    return events.filter("split = 'test'"), state


def message(r):
    return json.dumps({
        "event_id": str(r.event_id), "entity_id": r.entity_id, "entity_type": r.entity_type, "timestamp": r.stamp, "source_ip": r.source_ip,
        "geo": {"country": r.geo_country, "city": r.geo_city, "lat": r.geo_lat, "lon": r.geo_lon},
        "device_fingerprint": {"os": r.device_os, "mac": r.device_mac, "protocol": r.device_protocol, "user_agent": r.device_user_agent},
        "resource_accessed": r.resource_accessed, "auth_method": r.auth_method, "auth_success": r.auth_success, "session_id": r.session_id,
        "session_duration": r.session_duration, "command_sequence": r.command_sequence, "bytes_out": r.bytes_out, "bytes_in": r.bytes_in})


def closing(us):
    """An event of another entity so far ahead that the watermark passes all others."""
    return json.dumps({"event_id": f"end{us}", "entity_id": "zz", "entity_type": "user", "timestamp": us, "source_ip": "1.2.3.4", "geo": {"country": "DE", "city": "x", "lat": 1.0, "lon": 1.0},
                       "device_fingerprint": {"os": "o", "mac": "m", "protocol": "p", "user_agent": "u"}, "resource_accessed": "/", "auth_method": "mfa"})


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))
    at = 1_700_000_000 + 60 * int(name[0])  # files are taken in the order of these times
    os.utime(folder / name, (at, at))


def run(spark, folder, state, out):
    raw = J.message_stream(spark, "text", path=str(folder), maxFilesPerTrigger=1)
    jobs = SV.serve(raw, state, f"{out}/to", f"{out}/check", TIGHT, lateness="2 days", availableNow=True)
    for q in jobs:
        q.awaitTermination()


def test_messages_become_the_detections_of_batch(spark, events, fitted, tmp_path):
    J.use_rocksdb(spark)
    test, state = fitted
    rows = test.withColumn("stamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).orderBy("ts_us").collect()
    rng = random.Random(1)
    day = 86_400_000_000
    order = sorted(rows, key=lambda r: r.ts_us + rng.random() * 1.5 * day)  # shuffled within the lateness
    tardy, order = order[10:14], order[:10] + order[14:]
    n = len(order) // 3
    folder, out = tmp_path / "in", tmp_path
    put(folder, "1.txt", [message(r) for r in order[:n]] + ["", "not json"])
    put(folder, "2.txt", [message(r) for r in order[n : 2 * n]])
    run(spark, folder, state, out)  # ends here, and is started again over more files
    put(folder, "3.txt", [message(r) for r in order[2 * n :]] + ['{"event_id": "bad", "entity_id": "u"}'])
    put(folder, "4.txt", [closing("2036-01-01T00:00:00Z")])
    run(spark, folder, state, out)
    put(folder, "5.txt", [closing("2036-02-01T00:00:00Z")] + [message(r) for r in tardy])
    put(folder, "6.txt", [closing("2037-03-01T00:00:00Z")])
    run(spark, folder, state, out)
    late_ids = [str(r.event_id) for r in tardy]
    assert sorted(r.event_id for r in SV.read_sink(spark, f"{out}/to", "late").collect()) == sorted(late_ids)
    assert SV.read_sink(spark, f"{out}/to", "dead").count() == 3
    got = SV.read_sink(spark, f"{out}/to", "detections").where("entity_id <> 'zz'").toPandas().set_index("event_id").sort_index()
    on_time = test.withColumn("event_id", F.col("event_id").cast("string")).where(~F.col("event_id").isin(late_ids))
    want = score_table(on_time, state, TIGHT, drift=False).toPandas().set_index("event_id").sort_index()
    assert len(want) > 100 and list(got.index) == list(want.index)
    for c in [c for c in NUMERIC if c != "cold_start"] + ["baseline", "sequence"]:
        assert (got[c] - want[c]).abs().max() < 1e-7, c
    a, b = np.stack(got["row_array"]), np.stack(want["row_array"])
    assert np.abs(a - b).max() < 1e-7
    # Logarithms of the two runtimes may differ in the last bit, and a tree's threshold may lie there.
    alike = (a == b).all(axis=1) | ((got["classifier"] - want["classifier"]).abs() < 1e-9)
    assert alike.mean() > 0.98
    for c in ("classifier", "risk", "uncertainty"):
        assert (got[c] - want[c])[alike].abs().max() < 1e-7, c
    for c in ("detection_id", "is_anomaly", "anomaly_type", "cold_start", "in_budget"):
        assert (got[c] == want[c])[alike].all(), c


def feed(spark, folder, rows, parts):
    for i in range(parts):
        rows.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, stream, tmp, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_every_stream_feature_equals_batch(spark, events, tmp_path):
    J.use_rocksdb(spark)
    top = [r[0] for r in events.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").limit(4).collect()]
    base = events.where(F.col("entity_id").isin(top)).drop("label", "value")
    last = base.agg(F.max("ts_us")).first()[0] + 10**13
    end = base.limit(1).withColumns({"entity_id": F.lit("zz"), "ts_us": F.lit(last), "timestamp": F.timestamp_micros(F.lit(last))})
    cut = base.selectExpr("percentile(ts_us, 0.5)").first()[0]
    rows = base.withColumn("part", F.when(F.col("ts_us") < cut, 0).otherwise(1)).unionByName(end.withColumn("part", F.lit(2)))
    stream = SV.history_stream(feed(spark, tmp_path / "h", rows, 3), TIGHT, "1 day", None)
    drained(spark, stream, tmp_path, "hist")
    schema = base.schema
    got = SV.stream_features(spark.table("hist").where("entity_id <> 'zz'"), schema, TIGHT).toPandas().set_index("event_id").sort_index()
    want = featurise(base, TIGHT).toPandas().set_index("event_id").sort_index()
    assert len(want) > 100 and list(got.index) == list(want.index)
    for c in NUMERIC:
        assert (got[c] - want[c]).abs().max() < 1e-7, c
    for c in [c for c in want.columns if c.startswith("c_")] + ["profile_source"]:
        assert (got[c] == want[c]).all(), c
    assert all(a.tolist() == b.tolist() for a, b in zip(got["tokens"], want["tokens"]))


def test_idle_entities_leave_the_state(spark, events, tmp_path):
    J.use_rocksdb(spark)
    base = events.drop("label", "value").where("ts_us is not null").orderBy("ts_us").limit(60)
    last = base.agg(F.max("ts_us")).first()[0]
    day = 86_400_000_000
    ends = [base.limit(1).withColumns({"entity_id": F.lit("zz"), "event_id": F.lit(-i), "ts_us": F.lit(last + d * day), "timestamp": F.timestamp_micros(F.lit(last + d * day)), "part": F.lit(i)})
            for i, d in ((1, 3), (2, 40), (3, 41))]
    rows = base.withColumn("part", F.lit(0))
    for e in ends:
        rows = rows.unionByName(e)
    q = drained(spark, SV.history_stream(feed(spark, tmp_path / "i", rows, 4), TIGHT, "1 day", 30.0), tmp_path, "idle")
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.table("idle").where("entity_id <> 'zz'").count() == 60
    assert max(totals) > 100 and totals[-1] < max(totals) / 4
