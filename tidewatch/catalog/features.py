"""Queries over the per-event features, profiles, snapshots, corpus and encoders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import BEFORE, BLOCK, EVENTS, ORDERED, WEIGHT, by_value, haversine, r4, recent, with_
from tidewatch.config import DEFAULTS
from tidewatch.functions.scalar import r4 as R
from tidewatch.operators import corpus as C
from tidewatch.operators import ordering as O
from tidewatch.operators import profiles as P
from tidewatch.operators.features import NUMERIC, Knowledge, featurise
from tidewatch.sources.telemetry import access_events

WIDE = replace(DEFAULTS, window_minutes=360)  # six hours: the telemetry is sparse at sixty minutes


def _features(spark, sf, names, settings=WIDE, with_corpus=False, raw=()):
    df = access_events(spark, sf)
    know = Knowledge(corpus=C.fit_corpus(df.filter("split = 'train'"), settings)) if with_corpus else Knowledge()
    out = featurise(df, settings, know, names)
    return out.select("event_id", *[R(F.col(n).cast("double")).alias(n) for n in names], *raw)


#: (features, SQL) of every group in the benchmark's settings; together all features.
PARTS: list[tuple[tuple[str, ...], str]] = []


def feature_query(name, names, sql, **kw):
    if kw.get("settings", WIDE) is WIDE and not kw.get("raw"):
        PARTS.append((tuple(names), sql))
    query(name, sql)(lambda spark, sf: _features(spark, sf, names, **kw))


feature_query(
    "features_time",
    ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "log_seconds_since_prev", "is_first_event"),
    f"""{with_(EVENTS, ORDERED)} SELECT event_id,
      {r4('sin(2*pi()*(hour(timestamp)+minute(timestamp)/60.0)/24)')} AS hour_sin,
      {r4('cos(2*pi()*(hour(timestamp)+minute(timestamp)/60.0)/24)')} AS hour_cos,
      {r4('sin(2*pi()*(isodow(timestamp)-1)/7)')} AS dow_sin, {r4('cos(2*pi()*(isodow(timestamp)-1)/7)')} AS dow_cos,
      {r4('CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END')} AS is_weekend,
      {r4('CASE WHEN rn = 1 THEN 0 ELSE ln(1 + greatest(0, (ts_us - p_us) / 1e6)) END')} AS log_seconds_since_prev,
      {r4('CASE WHEN rn = 1 THEN 1 ELSE 0 END')} AS is_first_event FROM o""",
)

_KM = haversine("p_lat", "p_lon", "geo_lat", "geo_lon")
feature_query(
    "features_movement",
    ("log_geo_velocity_kmh", "log_distance_from_prev_km", "device_changed_from_prev"),
    f"""{with_(EVENTS, ORDERED)}, d AS (SELECT *, {_KM} AS km FROM o) SELECT event_id,
      {r4('CASE WHEN rn = 1 THEN 0 ELSE ln(1 + km / (greatest(abs(ts_us - p_us) / 1e6, 60) / 3600)) END')} AS log_geo_velocity_kmh,
      {r4('CASE WHEN rn = 1 THEN 0 ELSE ln(1 + km) END')} AS log_distance_from_prev_km,
      {r4('CASE WHEN p_mac <> device_mac THEN 1 ELSE 0 END')} AS device_changed_from_prev FROM d""",
)

_LAT, _LON = "radians(geo_lat)", "radians(geo_lon)"
feature_query(
    "features_home_distance",
    ("log_distance_from_home_km",),
    f"""{with_(EVENTS, ORDERED)},
      u AS (SELECT *, sum(CASE WHEN rn <= 250 THEN cos({_LAT})*cos({_LON}) ELSE 0 END) OVER {BLOCK} AS x,
        sum(CASE WHEN rn <= 250 THEN cos({_LAT})*sin({_LON}) ELSE 0 END) OVER {BLOCK} AS y,
        sum(CASE WHEN rn <= 250 THEN sin({_LAT}) ELSE 0 END) OVER {BLOCK} AS z,
        sum(CASE WHEN rn <= 250 THEN 1 ELSE 0 END) OVER {BLOCK} AS n FROM o),
      h AS (SELECT *, degrees(atan2(z/n, sqrt(pow(x/n,2)+pow(y/n,2)))) AS hlat, degrees(atan2(y/n, x/n)) AS hlon FROM u)
      SELECT event_id, {r4(f"coalesce(CASE WHEN n > 0 THEN ln(1 + {haversine('hlat','hlon','geo_lat','geo_lon')}) END, 0)")} AS log_distance_from_home_km FROM h""",
)

_PREFIX = "concat_ws('.', '10', ent % 200, k % 4)"
_SIMPLE = {"country": "geo_country", "ip_prefix": "prefix", "auth_method": "auth_method", "protocol": "device_protocol"}


def _lik(dim):
    return f"CASE WHEN snap_n > 0 THEN weight * seen_{dim} / snap_n ELSE 0 END"


def _new(dim):
    return f"CASE WHEN snap_n > 0 AND weight > 0 AND seen_{dim} = 0 THEN 1 ELSE 0 END"


_SEEN = {
    "hour": "hour(timestamp)", "dow": "isodow(timestamp)", "country": "geo_country", "ip_prefix": "prefix",
    "auth_method": "auth_method", "protocol": "device_protocol", "device_mac": "device_mac", "device_os": "device_os",
}
_SEEN_CTE = (
    f"px AS (SELECT *, {_PREFIX} AS prefix, hour(timestamp) AS hh, isodow(timestamp) AS dd FROM w), sn AS (SELECT *, "
    + ", ".join(
        f"count(*) OVER {by_value({'hour': 'hh', 'dow': 'dd'}.get(d, e))} AS seen_{d}" for d, e in _SEEN.items()
    )
    + " FROM px)"
)
feature_query(
    "features_profile",
    (
        "hour_likelihood", "dow_likelihood", "country_likelihood", "is_new_country", "ip_prefix_likelihood",
        "is_new_ip_prefix", "auth_method_likelihood", "is_new_auth_method", "is_new_device_mac", "is_new_device_os",
        "protocol_likelihood",
    ),
    f"""{with_(EVENTS, ORDERED, WEIGHT, _SEEN_CTE)} SELECT event_id,
      {r4('CASE WHEN snap_n = 0 THEN 1 ELSE 24 * weight * seen_hour / snap_n END')} AS hour_likelihood,
      {r4('CASE WHEN snap_n = 0 THEN 1 ELSE 7 * weight * seen_dow / snap_n END')} AS dow_likelihood,
      {r4(_lik('country'))} AS country_likelihood, {r4(_new('country'))} AS is_new_country,
      {r4(_lik('ip_prefix'))} AS ip_prefix_likelihood, {r4(_new('ip_prefix'))} AS is_new_ip_prefix,
      {r4(_lik('auth_method'))} AS auth_method_likelihood, {r4(_new('auth_method'))} AS is_new_auth_method,
      {r4(_new('device_mac'))} AS is_new_device_mac, {r4(_new('device_os'))} AS is_new_device_os,
      {r4(_lik('protocol'))} AS protocol_likelihood FROM sn""",
)

# Top-40 resource snapshots: every (block, value) of the entity, cumulative count, rank, cut.
_RES_GRID = """
vb AS (SELECT entity_id, resource_accessed AS v, blk, count(*) AS n FROM o GROUP BY ALL),
bb AS (SELECT DISTINCT entity_id, blk FROM o), vv AS (SELECT DISTINCT entity_id, v FROM vb),
grid AS (SELECT bb.entity_id, bb.blk, vv.v, coalesce(vb.n, 0) AS n FROM bb JOIN vv USING (entity_id)
         LEFT JOIN vb ON vb.entity_id = bb.entity_id AND vb.blk = bb.blk AND vb.v = vv.v),
cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY entity_id, v ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM grid),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id, blk ORDER BY seen DESC, v) AS rank FROM cum WHERE seen > 0),
top AS (SELECT entity_id, blk, v, seen, seen / CAST(sum(seen) OVER (PARTITION BY entity_id, blk) AS DOUBLE) AS share FROM rk WHERE rank <= 40)"""
feature_query(
    "features_resource_topk",
    ("resource_likelihood", "is_new_resource"),
    f"""{with_(EVENTS, ORDERED, WEIGHT, _RES_GRID)} SELECT event_id,
      {r4('coalesce(weight * share, 0)')} AS resource_likelihood,
      {r4('CASE WHEN snap_n > 0 AND weight > 0 AND share IS NULL THEN 1 ELSE 0 END')} AS is_new_resource
      FROM w LEFT JOIN top ON top.entity_id = w.entity_id AND top.blk = w.blk AND top.v = w.resource_accessed""",
)
feature_query(
    "features_foreign_resources",
    ("window_distinct_resources", "window_foreign_resource_ratio"),
    f"""{with_(EVENTS, ORDERED, WEIGHT, _RES_GRID, recent())},
      tl AS (SELECT entity_id, blk, list(v) AS known FROM top GROUP BY ALL),
      wr AS (SELECT r.event_id, w.weight, w.snap_n, coalesce(tl.known, []) AS known,
        list_distinct(list_append(list_transform(win, lambda x: x.res), r.resource_accessed)) AS res
        FROM r JOIN w ON w.event_id = r.event_id LEFT JOIN tl ON tl.entity_id = r.entity_id AND tl.blk = r.blk)
      SELECT event_id, {r4('len(res)')} AS window_distinct_resources,
        {r4('CASE WHEN snap_n > 0 AND weight > 0 THEN len(list_filter(res, lambda x: NOT list_contains(known, x))) / CAST(len(res) AS DOUBLE) ELSE 0 END')} AS window_foreign_resource_ratio FROM wr""",
)


def _window_sql(minutes):
    return f"""{with_(EVENTS, ORDERED, recent(minutes))},
      m AS (SELECT *, len(win) + 1 AS n, len(list_filter(win, lambda x: NOT x.ok)) + CASE WHEN auth_success THEN 0 ELSE 1 END AS fails,
        list_sum(list_append(list_transform(win, lambda x: x.b), bytes_out)) AS total,
        len(list_distinct(list_append(list_transform(win, lambda x: x.sid), session_id))) AS sids FROM r)
      SELECT event_id, {r4('fails')} AS window_auth_failures, {r4('fails / CAST(n AS DOUBLE)')} AS window_auth_failure_ratio,
        {r4('ln(1 + total)')} AS log_window_bytes_out, {r4('n')} AS window_event_count,
        {r4(f'n / CAST({minutes} AS DOUBLE)')} AS window_events_per_minute, {r4('sids')} AS window_distinct_sessions FROM m"""


_WINDOW = (
    "window_auth_failures", "window_auth_failure_ratio", "log_window_bytes_out", "window_event_count",
    "window_events_per_minute", "window_distinct_sessions",
)
feature_query("features_window_6h", _WINDOW, _window_sql(360))
feature_query("features_window_1h", _WINDOW, _window_sql(60), settings=DEFAULTS)
feature_query(
    "features_session_so_far",
    ("session_event_index", "session_distinct_resources", "session_auth_failures", "is_new_session"),
    f"""{with_(EVENTS, ORDERED, recent())}, m AS (SELECT *, row_number() OVER (PARTITION BY entity_id, session_id ORDER BY ts_us, event_id) AS sr FROM r)
      SELECT event_id, {r4('len(coalesce(same, []))')} AS session_event_index,
        {r4('len(list_distinct(list_append(list_transform(coalesce(same, []), lambda x: x.res), resource_accessed)))')} AS session_distinct_resources,
        {r4('len(list_filter(coalesce(same, []), lambda x: NOT x.ok)) + CASE WHEN auth_success THEN 0 ELSE 1 END')} AS session_auth_failures,
        {r4('CASE WHEN sr = 1 THEN 1 ELSE 0 END')} AS is_new_session FROM m""",
)


def _z(value, x):
    n, s, q = f"{x}_n", f"{x}_s", f"{x}_q"
    return (
        f"CASE WHEN coalesce({n}, 0) < 2 THEN 0 ELSE ({value} - {s} / {n}) / "
        f"greatest(sqrt(greatest(0, {q} / {n} - pow({s} / {n}, 2))), 0.1) END"
    )


_SIG = {
    "bo": "ln(1 + bytes_out)", "bi": "ln(1 + bytes_in)", "du": "ln(1 + session_duration)",
    "it": "CASE WHEN rn > 1 THEN ln(1 + greatest(0, (ts_us - p_us) / 1e6)) END", "sl": "CAST(len(cmds) AS DOUBLE)",
}
_SIG_CTE = (
    "sg AS (SELECT *, " + ", ".join(f"{e} AS {x}" for x, e in _SIG.items()) + " FROM o), st AS (SELECT *, "
    + ", ".join(f"count({x}) OVER {BEFORE} AS {x}_n, sum({x}) OVER {BEFORE} AS {x}_s, sum({x}*{x}) OVER {BEFORE} AS {x}_q" for x in _SIG)
    + " FROM sg)"
)
feature_query(
    "features_volume",
    (
        "log_bytes_out", "bytes_out_zscore", "log_bytes_in", "bytes_in_zscore", "log_session_duration",
        "session_duration_zscore", "interval_zscore", "sequence_length", "sequence_length_zscore",
    ),
    f"""{with_(EVENTS, ORDERED, _SIG_CTE)} SELECT event_id, {r4('bo')} AS log_bytes_out, {r4(_z('bo','bo'))} AS bytes_out_zscore,
      {r4('bi')} AS log_bytes_in, {r4(_z('bi','bi'))} AS bytes_in_zscore, {r4('du')} AS log_session_duration,
      {r4(_z('du','du'))} AS session_duration_zscore, {r4('CASE WHEN rn = 1 THEN 0 ELSE ' + _z('it','it') + ' END')} AS interval_zscore,
      {r4('sl')} AS sequence_length, {r4(_z('sl','sl'))} AS sequence_length_zscore FROM st""",
)
feature_query(
    "features_window_volume_ratio",
    ("window_bytes_out_ratio",),
    f"""{with_(EVENTS, ORDERED, _SIG_CTE, recent())}, t AS (SELECT r.event_id,
        list_sum(list_append(list_transform(r.win, lambda x: x.b), r.bytes_out)) AS total,
        CASE WHEN coalesce(bo_n, 0) > 0 THEN exp(bo_s / bo_n) - 1 ELSE 0 END AS typical FROM r JOIN st ON st.event_id = r.event_id)
      SELECT event_id, {r4('CASE WHEN typical > 1 THEN total / typical ELSE 0 END')} AS window_bytes_out_ratio FROM t""",
)

_BAGS = f"""
tk AS (SELECT event_id, entity_id, blk, unnest(cmds) AS v FROM o),
tks AS (SELECT *, count(*) OVER {by_value('v')} AS seen FROM tk),
gm AS (SELECT event_id, entity_id, blk, unnest(list_transform(range(1, len(cmds)), lambda i: cmds[i] || '>' || cmds[i + 1])) AS v FROM o),
gms AS (SELECT *, count(*) OVER {by_value('v')} AS seen FROM gm)"""
feature_query(
    "features_sequence_novelty",
    ("seq_token_novelty_entity", "seq_ngram_novelty_entity"),
    f"""{with_(EVENTS, ORDERED, WEIGHT, _BAGS)},
      t AS (SELECT event_id, avg(CASE WHEN seen = 0 THEN 1 ELSE 0 END) AS x FROM tks GROUP BY 1),
      g AS (SELECT event_id, avg(CASE WHEN seen = 0 THEN 1 ELSE 0 END) AS x FROM gms GROUP BY 1),
      any_g AS (SELECT *, coalesce(sum(greatest(len(cmds) - 1, 0)) OVER {BLOCK}, 0) AS grams FROM w)
      SELECT w.event_id, {r4('CASE WHEN snap_n > 0 AND weight > 0 THEN coalesce(t.x, 0) ELSE 0 END')} AS seq_token_novelty_entity,
        {r4('CASE WHEN grams > 0 AND weight > 0 THEN coalesce(g.x, 0) ELSE 0 END')} AS seq_ngram_novelty_entity
      FROM any_g w LEFT JOIN t ON t.event_id = w.event_id LEFT JOIN g ON g.event_id = w.event_id""",
)
feature_query(
    "features_corpus",
    ("resource_global_rarity", "resource_entity_share", "device_os_global_rarity", "seq_ngram_novelty_global", "seq_token_rarity_global"),
    f"""{with_(EVENTS, ORDERED, _BAGS)},
      learn AS (SELECT * FROM o WHERE split = 'train'),
      tot AS (SELECT CAST(greatest(count(*), 1) AS DOUBLE) AS n, CAST(greatest(count(DISTINCT entity_id), 1) AS DOUBLE) AS e FROM learn),
      res AS (SELECT resource_accessed, count(*) AS n, count(DISTINCT entity_id) AS e FROM learn GROUP BY 1),
      os AS (SELECT device_os, count(*) AS n FROM learn GROUP BY 1),
      tc AS (SELECT v, count(*) AS n FROM tk SEMI JOIN learn USING (event_id) GROUP BY 1), tt AS (SELECT CAST(greatest(sum(n), 1) AS DOUBLE) AS n FROM tc),
      tr AS (SELECT event_id, avg(-ln(greatest(CASE WHEN tc.n >= 3 THEN tc.n ELSE 1 END, 1) / (tt.n + 1))) AS x
             FROM tk LEFT JOIN tc USING (v), tt GROUP BY 1),
      gk AS (SELECT DISTINCT v, 1 AS old FROM gm SEMI JOIN learn USING (event_id)),
      gn AS (SELECT event_id, avg(CASE WHEN old IS NULL THEN 1 ELSE 0 END) AS x FROM gm LEFT JOIN gk USING (v) GROUP BY 1)
      SELECT o.event_id, {r4('-ln(greatest(coalesce(res.n, 0), 1) / tot.n)')} AS resource_global_rarity, {r4('coalesce(res.e, 0) / tot.e')} AS resource_entity_share,
        {r4('-ln(greatest(coalesce(os.n, 0), 1) / tot.n)')} AS device_os_global_rarity, {r4('coalesce(gn.x, 0)')} AS seq_ngram_novelty_global, {r4('coalesce(tr.x, 0)')} AS seq_token_rarity_global
      FROM o LEFT JOIN res USING (resource_accessed) LEFT JOIN os USING (device_os) LEFT JOIN tr ON tr.event_id = o.event_id LEFT JOIN gn ON gn.event_id = o.event_id, tot""",
    with_corpus=True,
)
feature_query(
    "features_profile_meta",
    ("log_entity_session_count", "log_entity_event_count", "cold_start", "profile_confidence", "auth_success"),
    f"""{with_(EVENTS, ORDERED, WEIGHT)} SELECT event_id, {r4('ln(1 + sessions)')} AS log_entity_session_count,
      {r4('ln(1 + snap_n)')} AS log_entity_event_count, {r4('CASE WHEN sessions < 15 THEN 1 ELSE 0 END')} AS cold_start,
      {r4('weight')} AS profile_confidence, {r4('CASE WHEN auth_success THEN 1 ELSE 0 END')} AS auth_success FROM w""",
)
feature_query(
    "features_failure_delta",
    ("auth_failure_rate_delta",),
    f"""{with_(EVENTS, ORDERED, WEIGHT, recent())}, f AS (SELECT event_id, coalesce(sum(CASE WHEN auth_success THEN 0 ELSE 1 END) OVER {BLOCK}, 0) AS bad FROM o)
      SELECT r.event_id, {r4('(len(list_filter(win, lambda x: NOT x.ok)) + CASE WHEN r.auth_success THEN 0 ELSE 1 END) / CAST(len(win) + 1 AS DOUBLE) - CASE WHEN w.snap_n > 0 THEN w.weight * f.bad / w.snap_n ELSE 0 END')} AS auth_failure_rate_delta
      FROM r JOIN w ON w.event_id = r.event_id JOIN f ON f.event_id = r.event_id""",
)
