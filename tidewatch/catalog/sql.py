"""Plain-SQL statement of the telemetry adapter and shared sub-queries, for the SQL twins."""

from __future__ import annotations

from tidewatch.sources.telemetry import COLD_FROM_US, PLACES, SESSION_SECONDS, WEEK_SECONDS


def _pick(values, index):
    return f"list_extract([{', '.join(values)}], CAST({index} AS BIGINT) + 1)"


def _text(values):
    return [f"'{v}'" for v in values]


EVENTS = f"""
raw AS (
  SELECT event_id, ts, epoch_us(ts) AS ts_us, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id // 10 AS ent
  FROM events),
bounds AS (
  SELECT min(ts_us) + ((max(ts_us) - min(ts_us)) * 60) // 100 AS train_end,
         min(ts_us) + ((max(ts_us) - min(ts_us)) * 80) // 100 AS val_end FROM raw),
base AS (
  SELECT *, CASE WHEN k >= 97 THEN (ent + 1 + event_id % 7) % 8 ELSE ent % 8 END AS place,
         concat_ws('_', ent, (ts_us // 1000000) // {SESSION_SECONDS}) AS session_id,
         CASE WHEN event_type = 'error' AND value > 60 THEN 'brute_force'
              WHEN value > 150 THEN 'low_and_slow_exfil'
              WHEN k >= 98 THEN 'impossible_travel' ELSE 'normal' END AS label,
         ent || CASE WHEN ent % 5 = 1 AND ts_us < {COLD_FROM_US} THEN '_old' ELSE '' END AS who
  FROM raw),
ev AS (
  SELECT event_id, ts AS timestamp, ts_us, 'ent_' || who AS entity_id, ent, k, value, event_type,
    {_pick(_text(("user", "service_account", "edge_device")), "ent % 3")} AS entity_type,
    concat_ws('.', '10', ent % 200, k % 4, event_id % 250) AS source_ip,
    {_pick(_text(p[3] for p in PLACES), "place")} AS geo_country,
    {_pick(_text(p[4] for p in PLACES), "place")} AS geo_city,
    {_pick([f"CAST({p[1]} AS DOUBLE)" for p in PLACES], "place")} AS geo_lat,
    {_pick([f"CAST({p[2]} AS DOUBLE)" for p in PLACES], "place")} AS geo_lon,
    '/' || event_type || '/' || (k % 10) AS resource_accessed,
    {_pick(_text(("password", "token", "certificate", "biometric", "mfa")), "k % 5")} AS auth_method,
    event_type <> 'error' AS auth_success, session_id,
    k * CAST(10 AS DOUBLE) AS session_duration,
    list(event_type) OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cmds,
    {_pick(_text(("linux", "windows", "macos")), "k % 3")} AS device_os,
    '02:00:' || (ent * 7 + k // 33) AS device_mac,
    {_pick(_text(("https", "ssh", "mqtt", "rdp")), "k % 4")} AS device_protocol,
    'agent/' || (k % 3) AS device_user_agent,
    value * 1000 AS bytes_out, value * 100 AS bytes_in, label,
    CASE WHEN label <> 'normal' THEN concat_ws('_', 'c', who, (ts_us // 1000000) // {WEEK_SECONDS}) END AS campaign_id,
    CASE WHEN label <> 'normal' THEN CAST(k % 4 AS BIGINT) END AS stage,
    CASE WHEN ts_us < train_end THEN 'train' WHEN ts_us < val_end THEN 'val' ELSE 'test' END AS split
  FROM base, bounds)"""

# Rows numbered per entity, snapshot block, snapshot size, and the previous row's fields.
ORDERED = """
o0 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS rn FROM ev),
o AS (
  SELECT *, CAST(floor((rn - 2) / 20.0) AS BIGINT) AS blk,
    CASE WHEN rn >= 2 THEN 1 + 20 * CAST(floor((rn - 2) / 20.0) AS BIGINT) ELSE 0 END AS snap_n,
    lag(ts_us) OVER w AS p_us, lag(geo_lat) OVER w AS p_lat, lag(geo_lon) OVER w AS p_lon,
    lag(device_mac) OVER w AS p_mac
  FROM o0 WINDOW w AS (PARTITION BY entity_id ORDER BY ts_us, event_id))"""


def recent(minutes: int = 360) -> str:
    """The trailing window and the session-so-far rows of every event, as lists."""
    span = minutes * 60_000_000
    return f"""
r0 AS (
  SELECT *, coalesce(list({{'us': ts_us, 'ok': auth_success, 'sid': session_id, 'b': bytes_out, 'res': resource_accessed}})
    OVER (PARTITION BY entity_id ORDER BY ts_us, event_id ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING), []) AS rec FROM o),
r AS (
  SELECT *, list_filter(rec, lambda x: x.us >= ts_us - {span}) AS win,
    list_filter(rec, lambda x: x.us >= p_us - {span} AND x.sid = session_id) AS same FROM r0)"""


BLOCK = "(PARTITION BY entity_id ORDER BY blk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BEFORE = "(PARTITION BY entity_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def by_value(col: str) -> str:
    return f"(PARTITION BY entity_id, {col} ORDER BY blk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


# Sessions and weight of own history as of the snapshot (no persisted profile, no priors).
WEIGHT = f"""
w0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity_id, session_id ORDER BY ts_us, event_id) = 1 THEN 1 ELSE 0 END AS first_in FROM o),
w1 AS (SELECT *, coalesce(sum(first_in) OVER {BLOCK}, 0) AS sessions FROM w0),
w AS (
  SELECT *, CASE WHEN snap_n = 0 THEN CAST(0 AS DOUBLE) WHEN sessions >= 15 THEN CAST(1 AS DOUBLE)
       ELSE sessions / (sessions + CAST(12 AS DOUBLE)) END AS weight FROM w1)"""


def haversine(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(12742.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def r4(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 4) + CAST(0 AS DOUBLE)"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
