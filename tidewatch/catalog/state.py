"""Queries over fitted state: corpus, vocabulary, encoders, profiles, snapshots, sessions, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.features import WIDE, _BAGS, _RES_GRID
from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import EVENTS, ORDERED, haversine, r4, recent, with_
from tidewatch.config import DEFAULTS
from tidewatch.functions import sequences as Q
from tidewatch.functions.scalar import r4 as R
from tidewatch.operators import corpus as C
from tidewatch.operators import ordering as O
from tidewatch.operators import profiles as P
from tidewatch.operators import sessions as SE
from tidewatch.sources.telemetry import access_events

EV = with_(EVENTS)


def rows():
    return F.count(F.lit(1)).alias("n")


@query(
    "corpus_frequencies",
    f"""{EV}, l AS (SELECT 'resource' AS dim, resource_accessed AS value, entity_id FROM ev UNION ALL SELECT 'device_os', device_os, entity_id FROM ev
        UNION ALL SELECT 'country', geo_country, entity_id FROM ev), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT entity_id) AS DOUBLE) AS e FROM ev),
        g AS (SELECT dim, value, count(*) AS n, count(DISTINCT entity_id) AS e FROM l GROUP BY 1, 2)
      SELECT dim, value, g.n, {r4('g.n / t.n')} AS share, {r4('g.e / t.e')} AS entity_share, {r4('-ln(greatest(g.n / t.n, 1 / t.n))')} AS surprisal FROM g, t""",
)
def corpus_frequencies(spark, sf):
    t = C.frequencies(access_events(spark, sf))
    return t.select("dim", "value", "n", *[R(F.col(c)).alias(c) for c in ("share", "entity_share", "surprisal")])


@query(
    "vocabulary",
    f"""{with_(EVENTS)}, t AS (SELECT unnest(cmds) AS token FROM ev), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3)
      SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id, n FROM c""",
)
def vocabulary(spark, sf):
    return C.vocabulary(C.fit_corpus(access_events(spark, sf)))


_GRAMS = "list_transform(range(1, len(cmds)), lambda i: cmds[i] || '>' || cmds[i + 1])"


@query(
    "ngram_counts",
    f"{EV}, g AS (SELECT unnest({_GRAMS}) AS gram FROM ev) SELECT gram, count(*) AS n FROM g GROUP BY 1",
)
def ngram_counts(spark, sf):
    g = access_events(spark, sf).select(F.explode(Q.ngrams(Q.clean(F.col("command_sequence")))).alias("gram"))
    return g.groupBy("gram").agg(rows())


_VOCAB = """tkn AS (SELECT unnest(cmds) AS token FROM ev WHERE split = 'train'),
vc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS id, count(*) AS n FROM tkn GROUP BY 1 HAVING count(*) >= 3)"""


@query(
    "encode_and_decode",
    f"""{with_(EVENTS, _VOCAB)}, e AS (SELECT event_id, u.pos AS pos, coalesce(vc.id, 1) AS id, coalesce(vc.token, '<unk>') AS tok
        FROM (SELECT event_id, unnest(cmds) AS token, generate_subscripts(cmds, 1) AS pos FROM ev) u LEFT JOIN vc USING (token)),
      g AS (SELECT event_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids, string_agg(CASE WHEN id > 2 THEN tok END, ' ' ORDER BY pos) AS decoded, count(*) AS n,
        avg(CASE WHEN id = 1 THEN 1 ELSE 0 END) AS unknown FROM e GROUP BY 1)
      SELECT event_id, repeat('0 ', CAST(19 - n AS BIGINT)) || '2 ' || ids AS ids, decoded, {r4('unknown')} AS unknown_ratio FROM g""",
)
def encode_and_decode(spark, sf):
    df = access_events(spark, sf)
    vocab = C.vocabulary(C.fit_corpus(df.filter("split = 'train'")))
    coded = C.encode_sequences(df.select("event_id", "command_sequence"), vocab)
    return C.decode(coded, vocab).select(
        "event_id", F.array_join("sequence_ids", " ").alias("ids"), F.array_join("decoded", " ").alias("decoded"),
        R(C.unknown_ratio(F.col("sequence_ids"))).alias("unknown_ratio"),
    )


@query(
    "token_and_ngram_rarity",
    f"""{with_(EVENTS, _VOCAB)}, tt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tkn),
      gt AS (SELECT unnest({_GRAMS}) AS gram FROM ev WHERE split = 'train'), gc AS (SELECT gram, count(*) AS n FROM gt GROUP BY 1), gg AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gt),
      a AS (SELECT event_id, avg(-ln(greatest(coalesce(vc.n, 0), 1) / (tt.n + 1))) AS tr FROM (SELECT event_id, unnest(cmds) AS token FROM ev) LEFT JOIN vc USING (token), tt GROUP BY 1),
      b AS (SELECT event_id, avg(-ln(greatest(coalesce(gc.n, 0), 1) / (gg.n + 1))) AS gr, avg(CASE WHEN gc.n IS NULL THEN 1 ELSE 0 END) AS nov
        FROM (SELECT event_id, unnest({_GRAMS}) AS gram FROM ev) LEFT JOIN gc USING (gram), gg GROUP BY 1)
      SELECT event_id, {r4('a.tr')} AS token_rarity, {r4('coalesce(b.gr, 0)')} AS ngram_rarity, {r4('coalesce(b.nov, 0)')} AS ngram_novelty FROM a LEFT JOIN b USING (event_id)""",
)
def token_and_ngram_rarity(spark, sf):
    df = access_events(spark, sf)
    out = C.sequence_rarity(df, C.fit_corpus(df.filter("split = 'train'")))
    return out.select("event_id", *[R(F.col(c)).alias(c) for c in ("token_rarity", "ngram_rarity", "ngram_novelty")])


@query(
    "category_codes",
    f"""{EV}, l AS (SELECT unnest([{{'f': 'entity_type', 'v': entity_type}}, {{'f': 'auth_method', 'v': auth_method}}, {{'f': 'geo_country', 'v': geo_country}},
        {{'f': 'device_protocol', 'v': device_protocol}}, {{'f': 'device_os', 'v': device_os}}, {{'f': 'resource_accessed', 'v': resource_accessed}}]) AS x FROM ev WHERE split = 'train'),
        c AS (SELECT x.f AS field, x.v AS value, count(*) AS n FROM l GROUP BY 1, 2)
      SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS code FROM c
      UNION ALL SELECT 'cohort', v, CAST(c AS BIGINT) FROM (VALUES ('0', 1), ('1', 2), ('2', 3), ('3', 4), ('4', 5), ('5', 6), ('unknown', 7)) t(v, c)""",
)
def category_codes(spark, sf):
    codes = C.category_codes(access_events(spark, sf).filter("split = 'train'"))
    return codes.select("field", "value", F.col("code").cast("bigint").alias("code"))


@query(
    "encoded_categories",
    f"""{EV}, c AS (SELECT resource_accessed, row_number() OVER (ORDER BY count(*) DESC, resource_accessed) AS code FROM ev WHERE split = 'train' GROUP BY 1),
        g AS (SELECT geo_country, row_number() OVER (ORDER BY count(*) DESC, geo_country) AS code FROM ev WHERE split = 'train' AND entity_id <> 'ent_7' GROUP BY 1)
      SELECT event_id, coalesce(c.code, 0) AS resource_code, coalesce(g2.code, 0) AS country_code, g2.code IS NULL AS country_novel
      FROM ev LEFT JOIN c USING (resource_accessed) LEFT JOIN (SELECT geo_country, row_number() OVER (ORDER BY count(*) DESC, geo_country) AS code FROM ev WHERE split = 'train' GROUP BY 1) g2 USING (geo_country)""",
)
def encoded_categories(spark, sf):
    df = access_events(spark, sf)
    codes = C.category_codes(df.filter("split = 'train'"))
    out = C.encode_categories(df, codes, ["resource_accessed", "geo_country"])
    return out.select(
        "event_id", F.col("resource_accessed_code").cast("bigint").alias("resource_code"),
        F.col("geo_country_code").cast("bigint").alias("country_code"), F.col("geo_country_novel").alias("country_novel"),
    )


_DIM_SQL = " UNION ALL ".join(
    f"SELECT entity_id, '{d}' AS dim, {e} AS value, {k} AS cap FROM ev"
    for d, e, k in (
        ("country", "geo_country", 20), ("ip_prefix", "concat_ws('.', '10', ent % 200, k % 4)", 40), ("resource", "resource_accessed", 40),
        ("auth_method", "auth_method", 9999), ("device_mac", "device_mac", 12), ("device_os", "device_os", 12), ("protocol", "device_protocol", 9999),
        ("hour", "CAST(hour(timestamp) AS VARCHAR)", 9999), ("dow", "CAST(isodow(timestamp) - 1 AS VARCHAR)", 9999),
        ("token", "unnest(cmds)", 80), ("ngram", f"unnest({_GRAMS})", 160),
    )
)


def _shares_sql(key):
    src = _DIM_SQL if key == "entity_id" else _DIM_SQL.replace("SELECT entity_id", f"SELECT {key}")
    return f"""{EV}, l AS ({src}), c AS (SELECT {key}, dim, value, cap, count(*) AS n FROM l GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY {key}, dim ORDER BY n DESC, value) AS rank FROM c)
      SELECT {key}, dim, value, n, {r4(f'n / CAST(sum(n) OVER (PARTITION BY {key}, dim) AS DOUBLE)')} AS share FROM r WHERE rank <= cap"""


@query("profile_distributions", _shares_sql("entity_id"))
def profile_distributions(spark, sf):
    counts = P.value_counts(access_events(spark, sf), ["entity_id"])
    return P.top_shares(counts, ["entity_id"]).select("entity_id", "dim", "value", "n", R(F.col("share")).alias("share"))


@query("type_prior_distributions", _shares_sql("entity_type"))
def type_prior_distributions(spark, sf):
    counts = P.value_counts(access_events(spark, sf), ["entity_type"])
    return P.top_shares(counts, ["entity_type"]).select("entity_type", "dim", "value", "n", R(F.col("share")).alias("share"))


_HOME = """hm AS (SELECT entity_id, degrees(atan2(avg(sin(radians(geo_lat))), sqrt(pow(avg(cos(radians(geo_lat))*cos(radians(geo_lon))),2)+pow(avg(cos(radians(geo_lat))*sin(radians(geo_lon))),2)))) AS hlat,
  degrees(atan2(avg(cos(radians(geo_lat))*sin(radians(geo_lon))), avg(cos(radians(geo_lat))*cos(radians(geo_lon))))) AS hlon FROM o WHERE rn <= 250 GROUP BY 1)"""

_PROFILE_SQL = f"""{with_(EVENTS, ORDERED, _HOME)},
  sp AS (SELECT entity_id, max({haversine('hlat', 'hlon', 'geo_lat', 'geo_lon')}) AS spread FROM o JOIN hm USING (entity_id) WHERE rn <= 250 GROUP BY 1)
  SELECT entity_id, count(*) AS event_count, count(DISTINCT session_id) AS session_count, min(ts_us) AS first_us, max(ts_us) AS last_us,
    {r4('avg(CASE WHEN auth_success THEN 0 ELSE 1 END)')} AS failure_rate, {r4('avg(ln(1 + bytes_out))')} AS bytes_out_mean,
    {r4('stddev_pop(ln(1 + bytes_out))')} AS bytes_out_std, {r4('avg(ln(1 + session_duration))')} AS duration_mean,
    {r4('avg(CASE WHEN rn > 1 THEN ln(1 + greatest(0, (ts_us - p_us) / 1e6)) END)')} AS interval_mean,
    {r4('avg(len(cmds))')} AS seq_len_mean, {r4('any_value(hlat)')} AS home_lat, {r4('any_value(hlon)')} AS home_lon, {r4('any_value(spread)')} AS spread_km
  FROM o JOIN hm USING (entity_id) JOIN sp USING (entity_id) GROUP BY 1"""


@query("entity_profiles", _PROFILE_SQL)
def entity_profiles(spark, sf):
    from tidewatch.operators.cohorts import stat_mean, stat_std

    p = P.entity_profiles(access_events(spark, sf))
    c = F.col
    return p.select(
        "entity_id", "event_count", "session_count", "first_us", "last_us", R(c("failure_rate")).alias("failure_rate"),
        R(stat_mean(c("bytes_out_n"), c("bytes_out_s"))).alias("bytes_out_mean"),
        R(stat_std(c("bytes_out_n"), c("bytes_out_s"), c("bytes_out_q"))).alias("bytes_out_std"),
        R(stat_mean(c("duration_n"), c("duration_s"))).alias("duration_mean"),
        R(stat_mean(c("interval_n"), c("interval_s"))).alias("interval_mean"),
        R(stat_mean(c("seq_len_n"), c("seq_len_s"))).alias("seq_len_mean"),
        R(c("home_lat")).alias("home_lat"), R(c("home_lon")).alias("home_lon"), R(c("spread_km")).alias("spread_km"),
    )


@query(
    "pooled_profiles",
    f"""{with_(EVENTS, ORDERED)}, g AS (SELECT entity_id, entity_type, session_id, auth_success, bytes_out FROM o)
      SELECT entity_id, entity_type, count(*) AS n, count(DISTINCT session_id) AS sessions, {r4('avg(ln(1 + bytes_out))')} AS bytes_out_mean,
        {r4('avg(CASE WHEN auth_success THEN 0 ELSE 1 END)')} AS failure_rate FROM g GROUP BY GROUPING SETS ((entity_id), (entity_type), ())""",
)
def pooled_profiles(spark, sf):
    return P.pooled(access_events(spark, sf)).select(
        "entity_id", "entity_type", "n", "sessions", R(F.col("bytes_out_mean")).alias("bytes_out_mean"), R(F.col("failure_rate")).alias("failure_rate")
    )


@query(
    "snapshot_topk_cuts",
    f"""{with_(EVENTS, ORDERED, _RES_GRID)}, d AS (SELECT entity_id, blk, count(*) AS nv FROM rk GROUP BY ALL),
      c AS (SELECT rk.entity_id, rk.blk, max(CASE WHEN rank = 40 THEN seen END) AS cut_n, max(CASE WHEN rank = 40 THEN v END) AS cut_value,
        sum(CASE WHEN rank <= 40 THEN seen ELSE 0 END) AS top_total FROM rk GROUP BY ALL)
      SELECT c.entity_id, c.blk, CAST(cut_n AS BIGINT) AS cut_n, cut_value, CAST(top_total AS BIGINT) AS top_total FROM c JOIN d ON c.entity_id = d.entity_id AND c.blk = d.blk WHERE nv > 40""",
)
def snapshot_topk_cuts(spark, sf):
    cuts = P.snapshot_cuts(O.order_events(access_events(spark, sf)))
    return cuts.filter("dim = 'resource'").select("entity_id", "blk", "cut_n", "cut_value", "top_total")


@query(
    "snapshot_counts_every_event",
    f"""{with_(EVENTS, ORDERED)} SELECT event_id, count(*) OVER (PARTITION BY entity_id, resource_accessed ORDER BY ts_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, rn - 1 AS history FROM o""",
)
def snapshot_counts_every_event(spark, sf):
    # A cadence of one event turns the snapshot into live statistics.
    from dataclasses import replace

    o = O.order_events(access_events(spark, sf), replace(DEFAULTS, refresh_every=1))
    o = P.snapshot_seen(P.value_columns(o))
    return o.rows().selectExpr("event_id", "seen_resource AS seen", "rn - 1 AS history")


@query(
    "token_snapshot_counts",
    f"{with_(EVENTS, ORDERED, _BAGS)} SELECT event_id, v AS token, max(seen) AS seen, count(*) AS n FROM tks GROUP BY ALL",
)
def token_snapshot_counts(spark, sf):
    long = P.snapshot_bags(O.order_events(access_events(spark, sf)))
    return long.filter("dim = 'token'").groupBy("event_id", F.col("value").alias("token")).agg(F.max("seen").alias("seen"), rows())


@query(
    "completed_sessions",
    f"""{EV}, x AS (SELECT *, lag(cmds[-1]) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS last_token FROM ev),
      y AS (SELECT *, len(list_filter(cmds, lambda c, i: i = 1 OR c <> cmds[i - 1])) - CASE WHEN cmds[1] = last_token THEN 1 ELSE 0 END AS fresh FROM x)
      SELECT session_id, count(*) AS event_count, count(DISTINCT resource_accessed) AS distinct_resources, count(DISTINCT geo_country) AS distinct_countries,
        count(DISTINCT device_mac) AS distinct_devices, count(*) FILTER (NOT auth_success) AS auth_failures,
        {r4('avg(CASE WHEN auth_success THEN 0 ELSE 1 END)')} AS auth_failure_ratio, max(ts_us) - min(ts_us) AS span_us,
        {r4('sum(bytes_out)')} AS total_bytes_out, {r4('sum(bytes_in)')} AS total_bytes_in, CAST(sum(fresh) AS BIGINT) AS command_count FROM y GROUP BY 1""",
)
def completed_sessions(spark, sf):
    s = SE.summaries(access_events(spark, sf))
    return s.select(
        "session_id", "event_count", "distinct_resources", "distinct_countries", "distinct_devices", "auth_failures",
        *[R(F.col(c)).alias(c) for c in ("auth_failure_ratio", "total_bytes_out", "total_bytes_in")],
        F.round(F.col("span_seconds") * 1e6).cast("bigint").alias("span_us"), "command_count",
    )


@query(
    "session_order",
    f"{EV} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS pos FROM ev",
)
def session_order(spark, sf):
    return SE.ordered(access_events(spark, sf)).select("session_id", "event_id", "pos")


@query(
    "session_commands",
    f"""{with_(EVENTS).replace('WITH ', 'WITH RECURSIVE ', 1)},
      s AS (SELECT session_id, event_id, list_filter(cmds, lambda t: t <> '') AS c, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS i FROM ev),
      f AS (
        SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS VARCHAR[]) AS tail, CAST([] AS VARCHAR[]) AS fresh FROM s
        UNION ALL
        SELECT session_id, i, event_id, list_slice(tail || fresh, greatest(1, len(tail) + len(fresh) - 63), len(tail) + len(fresh)), fresh FROM (
          SELECT s.session_id, s.i, s.event_id, tail,
            list_slice(c, 1 + list_max(list_filter(range(0, least(len(tail), len(c)) + 1), lambda k: list_slice(tail, len(tail) - k + 1, len(tail)) = list_slice(c, 1, k))), len(c)) AS fresh
          FROM f JOIN s ON s.session_id = f.session_id AND s.i = f.i + 1))
      SELECT session_id, event_id, coalesce(array_to_string(fresh, ' '), '') AS new_tokens FROM f WHERE i > 0""",
)
def session_commands(spark, sf):
    """Commands of each session rebuilt from overlapping windows: the new tokens of every event."""
    return SE.new_commands(access_events(spark, sf)).select(
        "session_id", "event_id", F.array_join("new_tokens", " ").alias("new_tokens")
    )


@query(
    "gap_sessions",
    f"""{with_(EVENTS, ORDERED)}, g AS (SELECT *, sum(CASE WHEN p_us IS NULL OR ts_us - p_us > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS group_no FROM o)
      SELECT entity_id, CAST(group_no AS BIGINT) AS group_no, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM g GROUP BY 1, 2""",
)
def gap_sessions(spark, sf):
    o = O.gap_groups(O.order_events(access_events(spark, sf), halo=1), 7_200_000_000)
    return o.rows().groupBy("entity_id", "group_no").agg(rows(), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(
    "trailing_window_rows",
    f"""{with_(EVENTS, ORDERED, recent(360))} SELECT event_id, len(win) AS rows_in_window, len(coalesce(same, [])) AS rows_in_session,
        coalesce(list_min(list_transform(win, lambda x: x.us)), 0) AS oldest_us FROM r""",
)
def trailing_window_rows(spark, sf):
    o = O.order_events(access_events(spark, sf), WIDE)
    o = O.trailing(O.previous(o, "ts_us"), {"us": "ts_us", "sid": "session_id"})
    span = 360 * 60_000_000
    return o.rows().selectExpr(
        "event_id",
        f"cast(size(filter(recent, x -> x.us >= ts_us - {span})) AS bigint) AS rows_in_window",
        f"cast(size(filter(recent, x -> x.us >= prev.ts_us - {span} and x.sid = session_id)) AS bigint) AS rows_in_session",
        f"coalesce(array_min(transform(filter(recent, x -> x.us >= ts_us - {span}), x -> x.us)), 0) AS oldest_us",
    )


@query(
    "traffic_summary",
    f"""{EV} SELECT count(*) AS events, count(DISTINCT entity_id) AS entities, count(DISTINCT session_id) AS sessions,
      {r4('avg(CASE WHEN auth_success THEN 0 ELSE 1 END)')} AS failure_rate, {r4('avg(CASE WHEN hour(timestamp) < 6 OR hour(timestamp) >= 22 THEN 1 ELSE 0 END)')} AS off_hours_rate,
      count(DISTINCT geo_country) AS countries, {r4('avg(session_duration)')} AS mean_duration FROM ev""",
)
def traffic_summary(spark, sf):
    s = SE.traffic(access_events(spark, sf))
    return s.select("events", "entities", "sessions", R(F.col("failure_rate")).alias("failure_rate"),
                    R(F.col("off_hours_rate")).alias("off_hours_rate"), "countries", R(F.col("mean_duration")).alias("mean_duration"))


@query(
    "traffic_by_sliding_hour",
    f"""{EV}, w AS (SELECT ev.*, (ts_us // 900000000 - o) * 900000000 AS start_us FROM ev, (SELECT unnest([0, 1, 2, 3]) AS o))
      SELECT start_us, count(*) AS events, {r4('avg(CASE WHEN auth_success THEN 0 ELSE 1 END)')} AS failure_rate FROM w GROUP BY 1""",
)
def traffic_by_sliding_hour(spark, sf):
    w = access_events(spark, sf).groupBy(F.window("timestamp", "1 hour", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), R(F.avg(F.when(F.col("auth_success"), 0.0).otherwise(1.0))).alias("failure_rate")
    )
    return w.select(F.unix_micros("w.start").alias("start_us"), "events", "failure_rate")


@query(
    "class_and_split_counts",
    f"""{EV}, c(label) AS (VALUES ('normal'), ('credential_misuse'), ('lateral_movement'), ('brute_force'), ('impossible_travel'), ('credential_stuffing'), ('device_spoofing'), ('low_and_slow_exfil'), ('insider_drift'))
      SELECT c.label, count(ev.event_id) AS n, count(ev.event_id) FILTER (split = 'train') AS train, count(ev.event_id) FILTER (split = 'val') AS val,
        count(ev.event_id) FILTER (split = 'test') AS test FROM c LEFT JOIN ev USING (label) GROUP BY 1""",
)
def class_and_split_counts(spark, sf):
    return SE.class_counts(access_events(spark, sf))


@query(
    "split_shares",
    f"{EV} SELECT split, count(*) AS n, {r4('count(*) / CAST((SELECT count(*) FROM ev) AS DOUBLE)')} AS share FROM ev GROUP BY 1",
)
def split_shares(spark, sf):
    per = access_events(spark, sf).groupBy("split").agg(rows())
    return per.selectExpr("split", "n", "round(n / sum(n) OVER (), 4) + 0D AS share")  # three rows


@query(
    "incident_summary",
    f"""{EV}, i AS (SELECT label, campaign_id, count(*) AS n, count(DISTINCT stage) AS stages FROM ev WHERE label <> 'normal' GROUP BY ALL)
      SELECT label, count(*) AS incidents, CAST(sum(n) AS BIGINT) AS events, {r4('avg(stages)')} AS mean_stages FROM i GROUP BY 1""",
)
def incident_summary(spark, sf):
    return SE.incidents(access_events(spark, sf)).withColumn("mean_stages", R(F.col("mean_stages")))


@query(
    "union_inside_timeline",
    f"""{EV}, u AS (SELECT event_id, ts_us, label FROM ev WHERE label = 'normal' UNION ALL SELECT event_id, ts_us + 43200000000, label FROM ev WHERE label <> 'normal')
      SELECT label, count(*) AS n, max(ts_us) AS last_us FROM u WHERE ts_us <= (SELECT max(ts_us) FROM ev) GROUP BY 1""",
)
def union_inside_timeline(spark, sf):
    df = access_events(spark, sf).select("event_id", "ts_us", "label")
    last = df.agg(F.max("ts_us")).first()[0]
    shifted = df.filter("label <> 'normal'").withColumn("ts_us", F.col("ts_us") + 43_200_000_000)
    u = df.filter("label = 'normal'").unionByName(shifted).filter(F.col("ts_us") <= last)
    return u.groupBy("label").agg(rows(), F.max("ts_us").alias("last_us"))


# --- joins ---------------------------------------------------------------------------------- #


@query(
    "events_with_labels",
    f"""{EV}, lb AS (SELECT event_id, label, campaign_id FROM ev WHERE label <> 'normal')
      SELECT ev.event_id, coalesce(lb.label, 'normal') AS label, lb.campaign_id FROM ev LEFT JOIN lb USING (event_id)""",
)
def events_with_labels(spark, sf):
    df = access_events(spark, sf)
    labels = df.filter("label <> 'normal'").select("event_id", "label", "campaign_id")
    return df.select("event_id").join(labels, "event_id", "left").select(
        "event_id", F.coalesce("label", F.lit("normal")).alias("label"), "campaign_id"
    )


@query(
    "stored_and_live_profiles",
    f"""{EV}, s AS (SELECT entity_id, count(*) AS n, avg(CASE WHEN auth_success THEN 0 ELSE 1 END) AS fr FROM ev WHERE split = 'train' GROUP BY 1),
        l AS (SELECT entity_id, count(*) AS n, avg(CASE WHEN auth_success THEN 0 ELSE 1 END) AS fr FROM ev WHERE split <> 'train' GROUP BY 1)
      SELECT entity_id, coalesce(s.n, 0) + coalesce(l.n, 0) AS n, {r4('(coalesce(s.n * s.fr, 0) + coalesce(l.n * l.fr, 0)) / (coalesce(s.n, 0) + coalesce(l.n, 0))')} AS failure_rate,
        CASE WHEN s.n IS NULL THEN 'live' WHEN l.n IS NULL THEN 'stored' ELSE 'both' END AS source FROM s FULL JOIN l USING (entity_id)""",
)
def stored_and_live_profiles(spark, sf):
    df = access_events(spark, sf)
    stored, live = (P.entity_profiles(df.filter(x)) for x in ("split = 'train'", "split <> 'train'"))
    m = P.merged(stored, live)
    return m.select("entity_id", F.col("event_count").alias("n"), R(F.col("failure_rate")).alias("failure_rate"), "source")


@query(
    "merged_distributions",
    f"""{EV}, s AS (SELECT entity_id, geo_country AS value, count(*) AS n FROM ev WHERE split = 'train' GROUP BY ALL),
        l AS (SELECT entity_id, geo_country AS value, count(*) AS n FROM ev WHERE split <> 'train' GROUP BY ALL),
        st AS (SELECT entity_id, CAST(sum(n) AS DOUBLE) AS n FROM s GROUP BY 1), lt AS (SELECT entity_id, CAST(sum(n) AS DOUBLE) AS n FROM l GROUP BY 1),
        k AS (SELECT entity_id, value FROM s UNION SELECT entity_id, value FROM l)
      SELECT k.entity_id, k.value, {r4('(coalesce(st.n, 0) * coalesce(s.n / st.n, 0) + coalesce(lt.n, 0) * coalesce(l.n / lt.n, 0)) / (coalesce(st.n, 0) + coalesce(lt.n, 0))')} AS share
      FROM k LEFT JOIN s ON s.entity_id = k.entity_id AND s.value = k.value LEFT JOIN l ON l.entity_id = k.entity_id AND l.value = k.value
        LEFT JOIN st ON st.entity_id = k.entity_id LEFT JOIN lt ON lt.entity_id = k.entity_id""",
)
def merged_distributions(spark, sf):
    df = access_events(spark, sf)
    stored, live = (P.entity_profiles(df.filter(x)) for x in ("split = 'train'", "split <> 'train'"))
    m = P.merged(stored, live)
    return m.select("entity_id", F.explode("d_country").alias("value", "share")).withColumn("share", R(F.col("share")))


@query(
    "shrunk_toward_prior",
    f"""{EV}, e AS (SELECT entity_id, any_value(entity_type) AS entity_type, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1),
        ec AS (SELECT entity_id, geo_country AS value, count(*) AS n FROM ev GROUP BY ALL),
        p AS (SELECT entity_type, geo_country AS value, count(*) AS n FROM ev GROUP BY ALL), pt AS (SELECT entity_type, CAST(sum(n) AS DOUBLE) AS n FROM p GROUP BY 1),
        w AS (SELECT *, CASE WHEN sessions >= 15 THEN 1.0 ELSE sessions / (sessions + 12.0) END AS weight FROM e),
        k AS (SELECT entity_id, value FROM ec UNION SELECT w.entity_id, p.value FROM w JOIN p USING (entity_type) WHERE weight < 1)
      SELECT k.entity_id, k.value, {r4('w.weight * coalesce(ec.n / w.n, 0) + (1 - w.weight) * coalesce(p.n / pt.n, 0)')} AS share
      FROM k JOIN w USING (entity_id) LEFT JOIN ec ON ec.entity_id = k.entity_id AND ec.value = k.value
        LEFT JOIN p ON p.entity_type = w.entity_type AND p.value = k.value JOIN pt ON pt.entity_type = w.entity_type""",
)
def shrunk_toward_prior(spark, sf):
    df = access_events(spark, sf)
    prior = P.profile_rows(P.numbered_events(df, DEFAULTS), ["entity_type"], geo_by_group=True, dims=("country",))
    out = P.shrunk(P.entity_profiles(df, dims=("country",)), prior)
    return out.select("entity_id", F.explode("d_country").alias("value", "share")).withColumn("share", R(F.col("share")))


@query(
    "cohort_members",
    f"{EV} SELECT entity_id, count(*) AS n FROM ev WHERE entity_id IN (SELECT entity_id FROM ev WHERE label = 'brute_force') GROUP BY 1",
)
def cohort_members(spark, sf):
    df = access_events(spark, sf)
    members = df.filter("label = 'brute_force'").select("entity_id").distinct()
    return df.join(members, "entity_id", "left_semi").groupBy("entity_id").agg(rows())
