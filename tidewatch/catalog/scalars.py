"""Queries over sources, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import EVENTS, ORDERED, haversine, r4, with_
from tidewatch.functions import scalar as S
from tidewatch.functions.scalar import r4 as R
from tidewatch.operators.ordering import order_events, previous
from tidewatch.sources import tables as Tb
from tidewatch.sources.telemetry import access_events, load_raw

EV = with_(EVENTS)
PLAIN = (
    "event_id", "ts_us", "entity_id", "entity_type", "source_ip", "geo_country", "geo_city", "geo_lat", "geo_lon",
    "resource_accessed", "auth_method", "auth_success", "session_id", "session_duration", "device_os", "device_mac",
    "device_protocol", "device_user_agent", "split",
)
VOLUME = ("round(bytes_out, 4) AS bytes_out", "round(bytes_in, 4) AS bytes_in")
FLAT = ", ".join(PLAIN + VOLUME)


@query("scan_access_events", f"{EV} SELECT {FLAT}, array_to_string(cmds, ' ') AS commands FROM ev")
def scan_access_events(spark, sf):
    return access_events(spark, sf).selectExpr(*PLAIN, *VOLUME, "array_join(command_sequence, ' ') AS commands")


@query("nest_and_flatten_events", f"{EV} SELECT {FLAT} FROM ev")
def nest_and_flatten_events(spark, sf):
    return Tb.flatten(Tb.nest(access_events(spark, sf))).selectExpr(*PLAIN, *VOLUME)


@query(
    "truth_table",
    f"{EV} SELECT event_id, label, label <> 'normal' AS is_anomaly, campaign_id, coalesce(stage, -1) AS stage, split FROM ev",
)
def truth_table(spark, sf):
    return Tb.truth_of(access_events(spark, sf)).withColumn("stage", F.coalesce("stage", F.lit(-1).cast("bigint")))


@query("strip_truth", f"{EV} SELECT {FLAT} FROM ev")
def strip_truth(spark, sf):
    return Tb.strip_truth(access_events(spark, sf)).selectExpr(*PLAIN, *VOLUME)


@query(
    "train_split_in_order",
    with_(EVENTS, "t AS (SELECT * FROM ev WHERE split = 'train')")
    + " SELECT event_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS rn FROM t",
)
def train_split_in_order(spark, sf):
    return order_events(Tb.read_split(access_events(spark, sf), "train"), halo=1).rows().select("event_id", "entity_id", "rn")


@query(
    "lenient_coercion",
    """SELECT event_id, round(value * 1000, 2) AS as_number, round(value, 2) AS as_percent,
       CAST(trunc(round(value * 1000, 2)) AS BIGINT) AS as_int,
       CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' WHEN 'error' THEN 'true' WHEN 'purchase' THEN 'false' ELSE 'rejected' END AS as_flag,
       true AS garbage_rejected FROM events""",
)
def lenient_coercion(spark, sf):
    raw = load_raw(spark, sf)
    thousand = F.format_number(F.col("value") * 1000, 2)
    word = F.expr("CASE event_type WHEN 'click' THEN ' YES' WHEN 'view' THEN 'off' WHEN 'error' THEN '1' WHEN 'purchase' THEN '' ELSE 'maybe' END")
    return raw.select(
        "event_id",
        F.round(S.coerce_float(thousand), 2).alias("as_number"),
        F.round(S.coerce_float(F.concat(F.format_string("%.2f", "value"), F.lit("%"))), 2).alias("as_percent"),
        S.coerce_int(thousand).alias("as_int"),
        F.coalesce(S.coerce_bool(word).cast("string"), F.lit("rejected")).alias("as_flag"),
        S.coerce_float(F.concat(F.lit("x"), thousand)).isNull().alias("garbage_rejected"),
    )


# Defects planted arithmetically so that the rejects are the same on both sides.
@query(
    "quarantined_events",
    f"""{EV}, bad AS (SELECT event_id,
      concat_ws(',', CASE WHEN event_id % 50 = 0 THEN 'lat' END, CASE WHEN event_id % 60 = 0 THEN 'lon' END,
        CASE WHEN event_id % 70 = 0 THEN 'bytes_out' END, CASE WHEN event_id % 80 = 0 THEN 'entity_type' END,
        CASE WHEN event_id % 90 = 0 THEN 'auth_method' END, CASE WHEN event_id % 110 = 0 THEN 'resource_accessed' END) AS reasons FROM ev)
      SELECT * FROM bad WHERE reasons <> ''""",
)
def quarantined_events(spark, sf):
    df = access_events(spark, sf)
    m = lambda n: F.col("event_id") % n == 0
    broken = df.withColumns(
        {
            "geo_lat": F.when(m(50), 95.0).otherwise(F.col("geo_lat")),
            "geo_lon": F.when(m(60), -190.0).otherwise(F.col("geo_lon")),
            "bytes_out": F.when(m(70), -1.0).otherwise(F.col("bytes_out")),
            "entity_type": F.when(m(80), "robot").otherwise(F.col("entity_type")),
            "auth_method": F.when(~m(90), F.col("auth_method")),
            "resource_accessed": F.when(m(110), " ").otherwise(F.col("resource_accessed")),
        }
    )
    return Tb.validate(broken)[1].select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "latest_detection_per_key",
    "SELECT user_id, max(event_id) AS event_id, count(*) AS writes FROM events GROUP BY user_id",
)
def latest_detection_per_key(spark, sf):
    raw = load_raw(spark, sf).select("user_id", "event_id", "ts")
    last = Tb.latest_by(raw, "user_id", F.col("ts"), F.col("event_id"))
    writes = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("writes"))
    return last.join(writes, "user_id").select("user_id", "event_id", "writes")


@query(
    "dataset_metadata",
    f"""{EV} SELECT split, label, count(*) AS n, count(DISTINCT entity_id) AS entities,
        {r4('avg(CASE WHEN label <> $$normal$$ THEN 1 ELSE 0 END)')} AS anomaly_rate FROM ev GROUP BY ROLLUP (split, label)""".replace("$$", "'"),
)
def dataset_metadata(spark, sf):
    return access_events(spark, sf).rollup("split", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("entity_id").alias("entities"),
        R(F.avg(F.when(F.col("label") != "normal", 1).otherwise(0))).alias("anomaly_rate"),
    )


@query("split_assignment", f"{EV} SELECT split, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM ev GROUP BY split")
def split_assignment(spark, sf):
    return access_events(spark, sf).groupBy("split").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n")
    )


@query(
    "cyclic_time",
    f"""{EV} SELECT event_id, {r4('sin(2*pi()*(hour(timestamp)+minute(timestamp)/60.0)/24)')} AS hour_sin,
      {r4('cos(2*pi()*(hour(timestamp)+minute(timestamp)/60.0)/24)')} AS hour_cos,
      {r4('sin(2*pi()*(isodow(timestamp)-1)/7)')} AS dow_sin, {r4('cos(2*pi()*(isodow(timestamp)-1)/7)')} AS dow_cos,
      hour(timestamp) < 6 OR hour(timestamp) >= 22 AS off_hours FROM ev""",
)
def cyclic_time(spark, sf):
    hs, hc = S.cyclic(F.hour("timestamp") + F.minute("timestamp") / 60.0, 24.0)
    ds, dc = S.cyclic(F.weekday("timestamp"), 7.0)
    return access_events(spark, sf).select(
        "event_id", R(hs).alias("hour_sin"), R(hc).alias("hour_cos"), R(ds).alias("dow_sin"), R(dc).alias("dow_cos"),
        S.off_hours(F.col("timestamp")).alias("off_hours"),
    )


@query(
    "network_prefix",
    """WITH ips AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '10.' || (event_id % 7)
         ELSE concat_ws('.', 10, event_id % 7, event_id % 5, event_id % 250) END AS ip FROM events)
       SELECT event_id, CASE WHEN len(string_split(ip, '.')) < 3 THEN ip
         ELSE array_to_string(list_slice(string_split(ip, '.'), 1, 3), '.') END AS prefix FROM ips""",
)
def network_prefix(spark, sf):
    ip = F.expr("if(event_id % 9 = 0, concat('10.', event_id % 7), concat_ws('.', '10', event_id % 7, event_id % 5, event_id % 250))")
    return load_raw(spark, sf).select("event_id", S.ip_prefix(ip).alias("prefix"))


@query(
    "travel_between_events",
    f"""{with_(EVENTS, ORDERED)}, d AS (SELECT event_id, {haversine('p_lat','p_lon','geo_lat','geo_lon')} AS km,
        greatest(abs(ts_us - p_us) / 1e6, 60) / 3600 AS hours FROM o WHERE rn > 1)
      SELECT event_id, {r4('km')} AS km, {r4('hours')} AS hours, {r4('km / hours')} AS kmh,
        km >= 500 AND km / hours > 900 AS impossible FROM d""",
)
def travel_between_events(spark, sf):
    o = previous(order_events(access_events(spark, sf), halo=1), "ts_us", "geo_lat", "geo_lon")
    c = F.col
    args = (c("prev.geo_lat"), c("prev.geo_lon"), c("prev.ts_us"), c("geo_lat"), c("geo_lon"), c("ts_us"))
    fired, _ = S.impossible_travel(*args)
    return o.rows().filter("rn > 1").select(
        "event_id",
        R(S.haversine_km(args[0], args[1], args[3], args[4])).alias("km"),
        R(S.elapsed_hours(args[2], args[5])).alias("hours"),
        R(S.velocity_kmh(*args)).alias("kmh"),
        fired.alias("impossible"),
    )


@query(
    "impossible_travel_pairs",
    f"""{with_(EVENTS, ORDERED)}, d AS (SELECT entity_id, {haversine('p_lat','p_lon','geo_lat','geo_lon')} AS km,
        greatest(abs(ts_us - p_us) / 1e6, 60) / 3600 AS hours FROM o WHERE rn > 1)
      SELECT entity_id, count(*) AS n, {r4('max(km / hours)')} AS top_kmh FROM d WHERE km >= 500 AND km / hours > 900 GROUP BY entity_id""",
)
def impossible_travel_pairs(spark, sf):
    o = previous(order_events(access_events(spark, sf), halo=1), "ts_us", "geo_lat", "geo_lon")
    c = F.col
    fired, speed = S.impossible_travel(
        c("prev.geo_lat"), c("prev.geo_lon"), c("prev.ts_us"), c("geo_lat"), c("geo_lon"), c("ts_us")
    )
    hits = o.rows().select("entity_id", fired.alias("fired"), speed.alias("kmh")).filter("fired")
    return hits.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), R(F.max("kmh")).alias("top_kmh"))


@query(
    "safe_log",
    f"""SELECT event_id, {r4("ln(1 + greatest(0, coalesce(CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 10 END, 0)))")} AS x FROM events""",
)
def safe_log(spark, sf):
    v = F.when(F.col("event_id") % 11 != 0, F.col("value") - 10)
    return load_raw(spark, sf).select("event_id", R(S.safe_log1p(v)).alias("x"))


@query(
    "risk_bands",
    """SELECT CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS band,
       count(*) AS n FROM events GROUP BY 1""",
)
def risk_bands(spark, sf):
    return load_raw(spark, sf).groupBy(S.risk_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_TECH_SQL = ", ".join(f"('{a}', {b}, '{c}', '{d}', '{e}')" for a, b, c, d, e in S.TECHNIQUES)


@query(
    "technique_mapping",
    f"""{EV}, tech(label, pos, technique_id, technique, tactic) AS (VALUES {_TECH_SQL})
      SELECT event_id, ev.label, string_agg(technique_id || ' ' || tactic, '; ' ORDER BY pos) AS techniques
      FROM ev LEFT JOIN tech USING (label) GROUP BY event_id, ev.label""",
)
def technique_mapping(spark, sf):
    from tidewatch.operators.explain import techniques

    df = access_events(spark, sf).select("event_id", "label")
    return techniques(df, "label").select(
        "event_id", "label",
        F.expr("if(size(techniques) = 0, null, array_join(transform(techniques, t -> concat(t.technique_id, ' ', t.tactic)), '; '))").alias("techniques"),
    )


@query(
    "normalise_categories",
    """SELECT nullif(trim(CASE WHEN event_id % 13 = 0 THEN '  ' ELSE '  ' || event_type || ' ' END), '') AS category, count(*) AS n
       FROM events GROUP BY 1""",
)
def normalise_categories(spark, sf):
    raw = F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return load_raw(spark, sf).groupBy(S.normalise_category(raw).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "attack_probability_and_offset",
    f"""SELECT event_id, {r4('greatest(0, least(1, 1 - value / 100))')} AS p_attack,
        {r4('greatest(0, least(100, value + CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 9) * 10 - 40 END))')} AS effective FROM events""",
)
def attack_probability_and_offset(spark, sf):
    offset = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 9) * 10 - 40)
    return load_raw(spark, sf).select(
        "event_id",
        R(S.attack_probability(F.col("value") / 100)).alias("p_attack"),
        R(S.effective_risk(F.col("value"), offset)).alias("effective"),
    )


@query(
    "display_types",
    f"""{EV}, p AS (SELECT event_id, k, label, value > 60 AS is_anomaly, (k % 7) / 10.0 AS p_bf, (k % 5) / 10.0 AS p_it FROM ev)
      SELECT event_id, CASE WHEN NOT is_anomaly THEN 'normal' WHEN label <> 'normal' THEN label
        WHEN p_bf >= p_it THEN 'brute_force' ELSE 'impossible_travel' END AS shown FROM p""",
)
def display_types(spark, sf):
    raw_k = F.expr("cast(session_duration / 10 as int)")
    probs = F.create_map(
        F.lit("normal"), F.lit(0.9), F.lit("impossible_travel"), (raw_k % 5) / 10.0, F.lit("brute_force"), (raw_k % 7) / 10.0
    )
    shown = S.display_type(F.col("label"), probs, F.col("value") > 60)
    return access_events(spark, sf).select("event_id", shown.alias("shown"))


@query(
    "stable_ids",
    "SELECT event_id, 'det_' || substr(sha256(event_id || '|' || user_id), 1, 12) AS detection_id FROM events",
)
def stable_ids(spark, sf):
    return load_raw(spark, sf).select("event_id", S.stable_id("det", F.col("event_id"), F.col("user_id")).alias("detection_id"))


_KNOWN = "event_id % 5 <> 0"


@query(
    "ingested_messages",
    f"""{EV}, m AS (SELECT *, event_id % 17 = 3 AS broken, event_id % 13 = 2 AS far, event_id % 7 = 1 AS no_flag, event_id % 11 = 4 AS odd FROM ev)
      SELECT event_id AS message, coalesce(CASE WHEN NOT broken AND {_KNOWN} THEN CAST(event_id AS VARCHAR) END, 'made') AS event_id,
        coalesce(CASE WHEN NOT broken THEN entity_id END, '') AS entity_id, coalesce(CASE WHEN NOT broken THEN device_mac END, '') AS device_mac,
        CASE WHEN broken THEN true ELSE no_flag OR auth_success END AS auth_success,
        CASE WHEN broken THEN 0 WHEN odd THEN -1 ELSE floor(bytes_out) END AS bytes_out,
        CASE WHEN broken THEN 'unparseable' ELSE concat_ws(',', CASE WHEN odd THEN 'bytes_out' END, CASE WHEN far THEN 'lat' END) END AS reasons FROM m""",
)
def ingested_messages(spark, sf):
    """Events rendered as nested messages, with faults by event id, read back leniently."""
    from tidewatch.streaming.jobs import parse_messages

    n = Tb.nest(access_events(spark, sf)).withColumn("message", F.col("event_id"))
    text = F.format_number(F.floor("bytes_out").cast("double"), 0)
    n = n.withColumns({
        "event_id": F.when(F.expr(_KNOWN), F.col("event_id").cast("string")),
        "auth_success": F.when(F.col("message") % 7 != 1, F.when(F.col("auth_success"), "Yes").otherwise(" off ")),
        "bytes_out": F.when(F.col("message") % 11 == 4, F.lit("much")).otherwise(text),
        "geo": F.struct("geo.country", "geo.city", F.when(F.col("message") % 13 == 2, 999.0).otherwise(F.col("geo.lat")).alias("lat"), "geo.lon"),
        "device_fingerprint": F.struct("device_fingerprint.os", F.concat(F.lit(" "), F.upper("device_fingerprint.mac")).alias("mac"), "device_fingerprint.protocol"),
    })
    fields = ("event_id", "entity_id", "entity_type", "timestamp", "source_ip", "geo", "device_fingerprint", "resource_accessed", "auth_method", "auth_success", "session_id", "command_sequence", "bytes_out")
    value = F.to_json(F.struct(*fields))
    raw = n.select("message", F.when(F.col("message") % 17 == 3, F.substring(value, 1, 40)).otherwise(value).alias("value"))
    made = F.when(F.col("event_id").startswith("evt_"), "made").otherwise(F.col("event_id"))
    out = parse_messages(raw, keep=("message",)).select(
        "message", made.alias("event_id"), F.coalesce("entity_id", F.lit("")).alias("entity_id"), F.coalesce("device_mac", F.lit("")).alias("device_mac"),
        "auth_success", F.coalesce("bytes_out", F.lit(-1.0)).alias("bytes_out"), F.array_join("reasons", ",").alias("reasons"),
    )
    blank = F.col("reasons") == "unparseable"
    return out.withColumns({"entity_id": F.when(blank, "").otherwise(F.col("entity_id")), "auth_success": blank | F.col("auth_success"), "bytes_out": F.when(blank, 0.0).otherwise(F.col("bytes_out")), "device_mac": F.when(blank, "").otherwise(F.col("device_mac"))})
