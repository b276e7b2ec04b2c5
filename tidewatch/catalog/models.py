"""Queries over cohorts, serving-mode features, tiers, batch scoring and explanations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.catalog.features import PARTS, WIDE
from tidewatch.catalog.registry import query
from tidewatch.catalog.scoring import SC, scored
from tidewatch.catalog.sql import BLOCK, EVENTS, ORDERED, by_value, haversine, r4, with_
from tidewatch.config import ANOMALY_CLASSES, DEFAULTS
from tidewatch.functions import sequences as SQ
from tidewatch.functions.scalar import r4 as R
from tidewatch.operators import cohorts as CO
from tidewatch.operators import corpus as C
from tidewatch.operators import explain as X
from tidewatch.operators import profiles as P
from tidewatch.operators import tiers as T
from tidewatch.operators.features import NUMERIC, Knowledge, featurise
from tidewatch.plans import evaluate as EV
from tidewatch.plans import fit as FI
from tidewatch.plans import score as SCO
from tidewatch.session import settle
from tidewatch.sources.telemetry import access_events

# --- cohorts --------------------------------------------------------------------------------- #

_SUMMARY = f"""{with_(EVENTS, ORDERED)}, s AS (SELECT entity_id, any_value(entity_type) AS entity_type, count(*) AS n,
    avg(CASE WHEN hour(timestamp) = 9 THEN 1 ELSE 0 END) AS hour_09, avg(CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END) AS weekend_share,
    avg(CASE WHEN auth_method = 'mfa' THEN 1 ELSE 0 END) AS auth_mfa_share, avg(ln(1 + bytes_out)) AS log_bytes_out_mean,
    avg(CASE WHEN rn > 1 THEN ln(1 + greatest(0, (ts_us - p_us) / 1e6)) END) AS log_interval_mean,
    ln(1 + least(20, count(DISTINCT geo_country))) AS distinct_countries, ln(1 + least(40, count(DISTINCT resource_accessed))) AS distinct_resources FROM o GROUP BY 1)"""
_SUM_COLS = ("hour_09", "weekend_share", "auth_mfa_share", "log_bytes_out_mean", "log_interval_mean", "distinct_countries", "distinct_resources")


@query(
    "behaviour_summary",
    f"{_SUMMARY} SELECT entity_id, n, {r4('CASE WHEN entity_type = $$user$$ THEN 1 ELSE 0 END')} AS type_user, {', '.join(r4(c) + ' AS ' + c for c in _SUM_COLS)} FROM s".replace("$$", "'"),
)
def behaviour_summary(spark, sf):
    b = CO.behaviour_summary(P.entity_profiles(access_events(spark, sf), dims=CO.DIMS))
    return b.select("entity_id", F.col("event_count").alias("n"), *[R(F.col(c)).alias(c) for c in ("type_user", *_SUM_COLS)])


def _given_cohorts():
    """Three fixed centroids in the first 42 dimensions, so that assignment has an exact twin."""
    centre = {0: {"weekend_share": 0.2}, 1: {"type_user": 1.0, "log_bytes_out_mean": 9.0}, 2: {"log_interval_mean": 6.0}}
    rows = [[centre[i].get(n, 0.0) for n in CO.SUMMARY] for i in range(3)]
    weight = {"weekend_share": 1.0, "type_user": 1.0, "log_bytes_out_mean": 1.0, "log_interval_mean": 1.0}
    stds = [weight.get(n, 1e9) for n in CO.SUMMARY]  # a huge scale switches a dimension off
    return CO.CohortModel(rows, [0.0] * len(CO.SUMMARY), stds, {"user": 1}, {0: 1, 1: 2, 2: 1})


def _dist(w, u, b, i):
    return f"sqrt(pow(weekend_share - {w}, 2) + pow(type_user - {u}, 2) + pow(log_bytes_out_mean - {b}, 2) + pow(log_interval_mean - {i}, 2))"


@query(
    "nearest_cohort",
    f"""{_SUMMARY}, t AS (SELECT *, CASE WHEN entity_type = 'user' THEN 1 ELSE 0 END AS type_user FROM s),
      d AS (SELECT entity_id, {_dist(0.2, 0, 0, 0)} AS a, {_dist(0, 1, 9, 0)} AS b, {_dist(0, 0, 0, 6)} AS c FROM t)
      SELECT entity_id, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cohort FROM d""",
)
def nearest_cohort(spark, sf):
    m = _given_cohorts()
    m = replace(m, centroids=[[x / s if s > 1 else x for x, s in zip(c, m.stds)] for c in m.centroids])
    return CO.assign(CO.behaviour_summary(P.entity_profiles(access_events(spark, sf), dims=CO.DIMS)), m).select("entity_id", F.col("cohort").cast("int").alias("cohort"))


@query("fitted_cohorts")
def fitted_cohorts(spark, sf):
    return CO.fit_cohorts(settle(P.entity_profiles(access_events(spark, sf), dims=CO.DIMS))).table(spark).select("cohort", "size", "description")


@query("live_cohorts")
def live_cohorts(spark, sf):
    """Cohort of every event's live snapshot under cohorts fitted on the training split."""
    df = access_events(spark, sf)
    model = CO.fit_cohorts(settle(P.entity_profiles(df.filter("split = 'train'"), dims=CO.DIMS)))
    f = featurise(df, WIDE, Knowledge(cohorts=model), names=("cold_start",))
    return f.groupBy("entity_id", F.col("c_cohort").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


# --- features against persisted profiles and priors --------------------------------------------- #

_STORED = """
st AS (SELECT entity_id, count(*) AS st_n, count(DISTINCT session_id) AS st_s, sum(ln(1 + bytes_out)) AS st_sum, sum(pow(ln(1 + bytes_out), 2)) AS st_sq FROM ev0 WHERE split = 'train' GROUP BY 1),
sc AS (SELECT entity_id, geo_country, count(*) AS c FROM ev0 WHERE split = 'train' GROUP BY 1, 2),
pt AS (SELECT entity_type, CAST(count(*) AS DOUBLE) AS n FROM ev0 WHERE split = 'train' GROUP BY 1),
pc AS (SELECT entity_type, geo_country, count(*) AS c FROM ev0 WHERE split = 'train' GROUP BY 1, 2),
gt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ev0 WHERE split = 'train'),
gc AS (SELECT geo_country, count(*) AS c FROM ev0 WHERE split = 'train' GROUP BY 1)"""
_EV_REST = EVENTS.replace("\nev AS (", "\nev0 AS (") + ", ev AS (SELECT * FROM ev0 WHERE split <> 'train')"
_SERVE = f"""{with_(_EV_REST, ORDERED, _STORED)},
  f0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity_id, session_id ORDER BY ts_us, event_id) = 1 THEN 1 ELSE 0 END AS fi,
    count(*) OVER {by_value('geo_country')} AS seen FROM o),
  f1 AS (SELECT *, coalesce(sum(fi) OVER {BLOCK}, 0) AS live_s FROM f0),
  f2 AS (SELECT f1.*, coalesce(st_n, 0) AS st_n, coalesce(st_s, 0) + live_s AS own_s, coalesce(st_n, 0) + snap_n AS own_n, sc.c AS stored_c, CASE WHEN pt.n IS NULL THEN gc.c / gt.n ELSE pc.c / pt.n END AS prior_share,
    CASE WHEN pt.n IS NULL THEN 'global' ELSE 'cohort' END AS prior_kind
    FROM f1 LEFT JOIN st ON st.entity_id = f1.entity_id LEFT JOIN sc ON sc.entity_id = f1.entity_id AND sc.geo_country = f1.geo_country
    LEFT JOIN pt ON pt.entity_type = f1.entity_type LEFT JOIN pc ON pc.entity_type = f1.entity_type AND pc.geo_country = f1.geo_country
    LEFT JOIN gc ON gc.geo_country = f1.geo_country CROSS JOIN gt),
  f3 AS (SELECT *, CASE WHEN own_n = 0 THEN CAST(0 AS DOUBLE) WHEN own_s >= 15 THEN CAST(1 AS DOUBLE) ELSE own_s / (own_s + CAST(12 AS DOUBLE)) END AS w FROM f2)"""


def _serving(spark, sf, with_priors):
    df = access_events(spark, sf)
    train, rest = df.filter("split = 'train'"), df.filter("split <> 'train'")
    know = Knowledge(profiles=P.entity_profiles(train, dims=("country",)))  # the only distribution asked for below
    if with_priors:
        # Entity types stand in for cohorts: 0 user, 1 service account, 2 edge device.
        index = "CASE entity_type WHEN 'user' THEN 0 WHEN 'service_account' THEN 1 ELSE 2 END AS cohort"
        assigned = train.selectExpr("entity_id", index).distinct()
        model = CO.CohortModel([], [], [], {"user": 0, "service_account": 1, "edge_device": 2}, {0: 1, 1: 1, 2: 1})
        know = Knowledge(profiles=know.profiles, priors=P.priors(train, assigned, dims=("country",)), cohorts=model)
    return featurise(rest, DEFAULTS, know, ("country_likelihood", "is_new_country", "cold_start", "profile_confidence", "log_entity_event_count"))


_OWN = "CASE WHEN own_n > 0 THEN (coalesce(stored_c, 0) + seen) / CAST(own_n AS DOUBLE) ELSE 0 END"


@query(
    "features_stored_profile",
    f"""{_SERVE} SELECT event_id, {r4(f'w * {_OWN}')} AS country_likelihood,
      {r4('CASE WHEN own_n > 0 AND w > 0 AND coalesce(stored_c, 0) + seen = 0 THEN 1 ELSE 0 END')} AS is_new_country,
      {r4('CASE WHEN own_s < 15 THEN 1 ELSE 0 END')} AS cold_start, {r4('w')} AS profile_confidence FROM f3""",
)
def features_stored_profile(spark, sf):
    f = _serving(spark, sf, False)
    return f.select("event_id", *[R(F.col(n)).alias(n) for n in ("country_likelihood", "is_new_country", "cold_start", "profile_confidence")])


@query(
    "features_with_priors",
    f"""{_SERVE} SELECT event_id, {r4(f'w * {_OWN} + (1 - w) * coalesce(prior_share, 0)')} AS country_likelihood,
      {r4('CASE WHEN (w > 0 AND coalesce(stored_c, 0) + seen > 0) OR (w < 1 AND prior_share IS NOT NULL) THEN 0 ELSE 1 END')} AS is_new_country,
      CASE WHEN own_n = 0 THEN prior_kind WHEN w >= 1 THEN 'entity' ELSE 'entity+' || prior_kind END AS profile_source FROM f3""",
)
def features_with_priors(spark, sf):
    f = _serving(spark, sf, True)
    return f.select("event_id", R(F.col("country_likelihood")).alias("country_likelihood"), R(F.col("is_new_country")).alias("is_new_country"), "profile_source")


_ALL = [n for names, _ in PARTS for n in names]
_FULL = "SELECT * FROM " + " JOIN ".join(f"({sql})" + (" USING (event_id)" if k else "") for k, (_, sql) in enumerate(PARTS))
_CODED = ("entity_type", "auth_method", "geo_country", "device_protocol", "device_os", "resource_accessed", "cohort")
_FULL += f" JOIN ({with_(EVENTS)} SELECT event_id, {', '.join(f'{c} AS c_{c}' for c in _CODED[:-1])}, 'unknown' AS c_cohort FROM ev) USING (event_id)"


@query("full_feature_table", _FULL)
def full_feature_table(spark, sf):
    """All 59 features and 7 categories of every event, the corpus from the training split: the batch job of the benchmark."""
    df = access_events(spark, sf)
    f = featurise(df, WIDE, Knowledge(corpus=C.fit_corpus(df.filter("split = 'train'"))))
    return f.select("event_id", *[R(F.col(n).cast("double")).alias(n) for n in _ALL], *[f"c_{c}" for c in _CODED])


@query("entity_feature_statistics")
def entity_feature_statistics(spark, sf):
    """Mean and population deviation of all 59 features per entity."""
    return FI.feature_statistics(featurise(access_events(spark, sf), WIDE), ["entity_id"])


@query("pooled_feature_statistics")
def pooled_feature_statistics(spark, sf):
    """The same per entity type and over all events."""
    f = settle(featurise(access_events(spark, sf), WIDE))
    each = FI.feature_statistics(f, ["entity_type"])
    return each.unionByName(FI.feature_statistics(f.withColumn("entity_type", F.lit("all")), ["entity_type"]))


@query(
    "scaler_inverse",
    f"""{with_(EVENTS)}, v AS (SELECT event_id, ln(1 + bytes_out) AS x FROM ev), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM v)
      SELECT event_id, {r4('mx + sx * least(12, greatest(-12, (x - mx) / sx))')} AS log_bytes_out FROM v, m""",
)
def scaler_inverse(spark, sf):
    f = featurise(access_events(spark, sf), names=("log_bytes_out",))
    sc = T.fit_scaler(f, ("log_bytes_out",))["log_bytes_out"]
    z = f.selectExpr("event_id", f"{T.scale_sql('log_bytes_out', *sc)} AS z")
    return z.select("event_id", R(F.expr(T.unscale_sql("z", *sc))).alias("log_bytes_out"))


@query(
    "category_round_trip",
    f"{with_(EVENTS)} SELECT event_id, auth_method AS auth_method_value, device_os AS device_os_value, geo_country AS geo_country_value FROM ev",
)
def category_round_trip(spark, sf):
    """Codes of three fields, read back."""
    ev = access_events(spark, sf)
    fields = ["auth_method", "device_os", "geo_country"]
    codes = settle(C.category_codes(ev))
    back = C.decode_categories(C.encode_categories(ev, codes, fields), codes, fields)
    return back.select("event_id", *[f"{f}_value" for f in fields])


@query(
    "profile_ngram_novelty",
    f"""{with_(EVENTS)}, g AS (SELECT event_id, entity_id, split, list_transform(range(1, len(cmds)), lambda i: cmds[i] || '>' || cmds[i + 1]) AS grams FROM ev),
      known AS (SELECT entity_id, list_distinct(flatten(list(grams))) AS known FROM g WHERE split = 'train' GROUP BY 1)
      SELECT event_id, {r4("CASE WHEN len(grams) = 0 THEN 0 WHEN coalesce(len(known), 0) = 0 THEN 1 ELSE len(list_filter(grams, lambda x: NOT list_contains(known, x))) / CAST(len(grams) AS DOUBLE) END")} AS novelty
      FROM g LEFT JOIN known USING (entity_id)""",
)
def profile_ngram_novelty(spark, sf):
    """N-grams of each event against its entity's training profile."""
    g = access_events(spark, sf).select("event_id", "entity_id", "split", SQ.ngrams(SQ.clean(F.col("command_sequence"))).alias("grams"))
    seen = g.filter("split = 'train'").select("entity_id", F.explode("grams").alias("gram")).distinct()
    known = seen.groupBy("entity_id").agg(F.collect_set("gram").alias("known"))  # an entity's distinct n-grams
    return g.join(known, "entity_id", "left").select("event_id", R(SQ.profile_novelty(F.col("grams"), F.col("known"))).alias("novelty"))


@query(
    "scaled_features",
    f"""{with_(EVENTS, ORDERED)}, v AS (SELECT event_id, ln(1 + bytes_out) AS x, CASE WHEN rn = 1 THEN 0 ELSE ln(1 + greatest(0, (ts_us - p_us) / 1e6)) END AS g FROM o),
      m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(g) AS mg, stddev_pop(g) AS sg FROM v)
      SELECT event_id, {r4('least(12, greatest(-12, (x - mx) / sx))')} AS log_bytes_out, {r4('least(12, greatest(-12, (g - mg) / sg))')} AS log_seconds_since_prev FROM v, m""",
)
def scaled_features(spark, sf):
    names = ("log_bytes_out", "log_seconds_since_prev")
    f = featurise(access_events(spark, sf), names=names)
    sc = T.fit_scaler(f, names)
    return f.select("event_id", *[R(F.expr(T.scale_sql(n, *sc[n]))).alias(n) for n in names])


@query("what_if_features")
def what_if_features(spark, sf):
    """Every entity's last event again, an hour later and from another place, against its history."""
    df = access_events(spark, sf)
    last = df.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "entity_id"]), F.struct("ts_us", "event_id")).alias("e"))
    hyp = last.select("entity_id", "e.*").withColumns(
        {"event_id": -F.col("event_id") - 1, "ts_us": F.col("ts_us") + 3_600_000_000, "timestamp": F.expr("timestamp + INTERVAL 1 HOUR"),
         "geo_country": F.lit("Iceland"), "geo_lat": F.lit(64.1), "geo_lon": F.lit(-21.9)}
    )
    return SCO.what_if(df, hyp, WIDE).select("event_id", "is_new_country", "log_distance_from_prev_km", "window_event_count")


# --- tiers ------------------------------------------------------------------------------------- #

_STEPS = f"""{with_(EVENTS)}, vc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS id FROM (SELECT unnest(cmds) AS token FROM ev WHERE split = 'train') GROUP BY 1 HAVING count(*) >= 3),
  tk AS (SELECT event_id, split, unnest(cmds) AS token, generate_subscripts(cmds, 1) AS pos, len(cmds) AS n FROM ev),
  en AS (SELECT event_id, split, pos, n, coalesce(id, 1) AS id FROM tk LEFT JOIN vc USING (token)),
  st AS (SELECT event_id, split, 19 - n + pos AS pos, coalesce(lag(id) OVER (PARTITION BY event_id ORDER BY pos), 2) AS ctx, id AS nxt FROM en),
  tr AS (SELECT ctx, nxt, count(*) AS n FROM st WHERE split = 'train' GROUP BY 1, 2), cn AS (SELECT ctx, sum(n) AS n FROM tr GROUP BY 1),
  su AS (SELECT st.*, -ln((coalesce(tr.n, 0) + 0.1) / (coalesce(cn.n, 0) + 0.1 * ((SELECT count(*) FROM vc) + 3))) AS nll
    FROM st LEFT JOIN tr ON tr.ctx = st.ctx AND tr.nxt = st.nxt LEFT JOIN cn ON cn.ctx = st.ctx)"""


def _surprise(spark, sf):
    df = access_events(spark, sf)
    train = df.filter("split = 'train'")
    vocab = C.vocabulary(C.fit_corpus(train))
    transitions = T.fit_transitions(T.steps(train, vocab))
    return T.step_surprise(T.steps(df, vocab), transitions, vocab.count() + 3), vocab


@query(
    "next_action_transitions",
    f"{_STEPS} SELECT tr.ctx, tr.nxt, tr.n, CAST(cn.n AS BIGINT) AS ctx_n FROM tr JOIN cn USING (ctx)",
)
def next_action_transitions(spark, sf):
    train = access_events(spark, sf).filter("split = 'train'")
    t = T.fit_transitions(T.steps(train, C.vocabulary(C.fit_corpus(train))))
    return t.selectExpr("cast(ctx AS bigint) AS ctx", "cast(nxt AS bigint) AS nxt", "n", "ctx_n")


@query("sequence_surprise", f"{_STEPS} SELECT event_id, {r4('avg(nll)')} AS nll, count(*) AS steps FROM su GROUP BY 1")
def sequence_surprise(spark, sf):
    return T.sequence_scores(_surprise(spark, sf)[0]).select("event_id", R(F.col("nll")).alias("nll"), "steps")


@query(
    "surprising_steps",
    f"""{_STEPS}, wt AS (SELECT event_id, pos, nxt, nll / sum(nll) OVER (PARTITION BY event_id) AS weight FROM su),
      rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(weight, 9) DESC, pos) AS r FROM wt)
      SELECT event_id, pos, nxt AS token_id, {r4('weight')} AS weight FROM rk WHERE r <= 2""",
)
def surprising_steps(spark, sf):
    w = T.step_attribution(_surprise(spark, sf)[0])
    top = w.selectExpr("*", "row_number() OVER (PARTITION BY event_id ORDER BY round(weight, 9) DESC, pos) AS r").filter("r <= 2")
    return top.selectExpr("event_id", "cast(pos AS bigint) AS pos", "cast(nxt AS bigint) AS token_id", "round(weight, 4) + 0D AS weight")


@query(
    "class_weights",
    f"""{with_(EVENTS)}, c(label) AS (VALUES {', '.join(f"('{x}')" for x in ANOMALY_CLASSES)}), g AS (SELECT c.label, count(ev.event_id) AS n FROM c LEFT JOIN ev USING (label) GROUP BY 1)
      SELECT label, n, {r4('CASE WHEN n = 0 THEN 1 ELSE (SELECT count(*) FROM ev) / CAST(9 * n AS DOUBLE) END')} AS weight FROM g""",
)
def class_weights(spark, sf):
    w = T.class_weights(access_events(spark, sf).select("label"), "balanced")
    return w.select("label", "n", R(F.col("weight")).alias("weight"))


@query("bottleneck_residuals")
def bottleneck_residuals(spark, sf):
    """Reconstruction error of all features behind the linear bottleneck and the worst features of each event."""
    df = settle(access_events(spark, sf))
    f = settle(featurise(df, WIDE, Knowledge(corpus=_settled_corpus(df.filter("split = 'train'")))))
    scaler = T.fit_scaler(f)
    out = T.score_bottleneck(f, T.fit_bottleneck(f, scaler)).withColumn("worst", F.expr(T.worst_features(2)))
    return out.select("event_id", "error", "baseline", F.expr("array_join(transform(worst, x -> x.feature), ',') AS worst"))


def _settled_corpus(train):
    c = C.fit_corpus(train, WIDE)
    return replace(c, counts=settle(c.counts))


@query("isotonic_calibration")
def isotonic_calibration(spark, sf):
    s = scored(spark, sf)
    knots = T.fit_isotonic(s, "classifier", "y")
    from tidewatch.operators.risk import interpolate_sql

    return s.select("event_id", "classifier", F.expr(f"{interpolate_sql('classifier', knots)} AS calibrated"))


#: Knots of a calibration that has a jump, a level stretch and a steep one.
_KNOTS = ((0.05, 0.0), (0.2, 0.1), (0.2, 0.3), (0.55, 0.3), (0.6, 0.8), (0.95, 1.0))


@query(
    "calibrated_scores",
    f"""{SC} SELECT event_id, {r4("CASE " + f"WHEN classifier <= {_KNOTS[0][0]} THEN {_KNOTS[0][1]} " + " ".join(
        f"WHEN classifier <= {x1} THEN {y0} + (classifier - {x0}) * ({y1 - y0}) / ({x1 - x0})" for (x0, y0), (x1, y1) in zip(_KNOTS, _KNOTS[1:]) if x1 > x0) + f" ELSE {_KNOTS[-1][1]} END")} AS calibrated FROM sc""",
)
def calibrated_scores(spark, sf):
    """The calibration map of given knots."""
    from tidewatch.operators.risk import interpolate_sql

    return scored(spark, sf).select("event_id", R(F.expr(interpolate_sql("classifier", _KNOTS))).alias("calibrated"))


# --- explanations -------------------------------------------------------------------------------- #


@query(
    "alert_narratives",
    f"""{SC} SELECT event_id, entity_id || ': possible ' || replace(anomaly_type, '_', ' ') || ', risk ' || CAST(CAST(risk AS BIGINT) AS VARCHAR) || ' of 100 (' ||
      CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'moderate' ELSE 'low' END || ').' ||
      CASE WHEN event_id % 2 = 0 THEN ' Led by log_bytes_out.' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' Rules hit: brute_force.' ELSE '' END ||
      CASE anomaly_type WHEN 'brute_force' THEN ' Techniques: T1110 (Brute Force).' ELSE ' Techniques: T1048 (Exfiltration Over Alternative Protocol).' END ||
      CASE WHEN event_id % 5 = 0 THEN ' Little history so far; read the risk with care.' ELSE '' END AS narrative FROM sc WHERE is_anomaly""",
)
def alert_narratives(spark, sf):
    rows = X.techniques(scored(spark, sf).filter("is_anomaly"), "anomaly_type").selectExpr(
        "event_id", "entity_id", "anomaly_type", "risk", "if(event_id % 2 = 0, array('log_bytes_out'), cast(array() AS array<string>)) AS drivers",
        "if(event_id % 3 = 0, array('brute_force'), cast(array() AS array<string>)) AS hits", "event_id % 5 = 0 AS cold_start",
        "transform(techniques, t -> named_struct('technique_id', t.technique_id, 'technique', t.name)) AS techniques",
    )
    return rows.selectExpr("event_id", f"{X.narrative_sql()} AS narrative")


@query("alerts_to_explain", f"{SC} SELECT event_id, entity_id, anomaly_type FROM sc WHERE is_anomaly")
def alerts_to_explain(spark, sf):
    return scored(spark, sf).filter("is_anomaly").select("event_id", "entity_id", "anomaly_type")


#: What the forest sees: scaled features, category codes, the scores of the other two tiers.
INPUTS = [*NUMERIC, "entity_type", "auth_method", "geo_country", "device_protocol", "device_os", "resource_accessed", "cohort", "baseline", "sequence"]
_FITTED: dict = {}
#: What the queries below read of a detection; the forest's inputs are kept for alerts only.
_TOLD = (
    "detection_id", "event_id", "entity_id", "ts_us", "baseline", "sequence", "classifier", "risk", "uncertainty", "in_budget", "is_anomaly",
    "predicted", "anomaly_type", "hits", "cold_start", "drift_flag",
)


def _served(spark, sf):
    """(state, test events, their detections): fitted on the training split, tuned on validation; once a session and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _FITTED:
        df = settle(access_events(spark, sf))
        state = FI.fit_all(df.filter("split = 'train'"), df.filter("split = 'val'"), df.select("event_id", "label"), WIDE)
        test = df.filter("split = 'test'")
        told = SCO.score_table(test, state, WIDE).select(*_TOLD, F.expr("if(is_anomaly, row_array, null) AS row_array"))
        _FITTED[at] = state, test, settle(told)
    return _FITTED[at]


def _alerts(spark, sf):
    state, _, detections = _served(spark, sf)
    return state, detections.filter("is_anomaly")


@query("alert_attributions")
def alert_attributions(spark, sf):
    """The inputs that move each alert's class most, of all 68."""
    state, alerts = _alerts(spark, sf)
    top = X.top_attributions(X.attributed(alerts, state.classifier, INPUTS), INPUTS, {n: m for n, (m, _) in state.scaler.items()})
    return top.select("event_id", "rank", "feature", "contribution", "direction", "typical", "description")


@query("feature_importance")
def feature_importance(spark, sf):
    state, alerts = _alerts(spark, sf)
    return X.global_importance(X.attributions(alerts, state.classifier, INPUTS))


@query("alert_counterfactuals")
def alert_counterfactuals(spark, sf):
    """Few features put back to typical that end an alert, judged by the fused risk of all three tiers; every feature is tried."""
    state, alerts = _alerts(spark, sf)
    cf = X.counterfactual(X.attributed(alerts, state.classifier, INPUTS), None, state.classifier, state.risk, INPUTS, len(NUMERIC))
    return cf.select("event_id", "original_risk", "resulting_risk", "found", F.array_join("changes", ",").alias("changes"), "summary")


@query("alert_explanations")
def alert_explanations(spark, sf):
    """Everything told about an alert: leading inputs, counterfactual, least expected commands, techniques, narrative."""
    state, test, detections = _served(spark, sf)
    ids = detections.filter("is_anomaly").select("event_id")
    steps = T.step_attribution(T.step_surprise(T.steps(test.join(ids, "event_id", "left_semi"), state.vocab, WIDE), state.transitions, state.vocab_size))
    words = state.vocab.select(F.col("id").alias("nxt"), "token")
    named = steps.join(words, "nxt", "left").withColumn("token", F.coalesce("token", F.lit("an unknown command")))
    out = X.explain(detections, named, state, INPUTS, len(NUMERIC))
    return out.selectExpr(
        "event_id", "anomaly_type", "risk", "transform(top_features, x -> x.feature) AS leading", "counterfactual.summary AS counterfactual",
        f"{X.summarise_steps_sql('coalesce(sequence_steps, array())')} AS commands", "transform(techniques, x -> x.technique_id) AS techniques", "narrative")


@query("scored_detections")
def scored_detections(spark, sf):
    """Fit on the training split, tune on validation, score the test split into detections."""
    _, _, d = _served(spark, sf)
    return d.select("detection_id", "event_id", "entity_id", "risk", "uncertainty", "in_budget", "is_anomaly", "anomaly_type", "cold_start", "drift_flag")


# --- evaluation of the fitted whole ---------------------------------------------------------------- #


@query("evaluation_metrics")
def evaluation_metrics(spark, sf):
    """Recall at the budget, ranking quality, macro F1 and calibration error of the test split's detections."""
    state, test, detections = _served(spark, sf)
    judged = EV.evaluation_table(detections, test.select("event_id", "label", "campaign_id"), state.risk)
    return EV.metrics_row(settle(judged.select("event_id", "risk", "label", "predicted")), WIDE.alert_budget)


@query("campaign_experiment")
def campaign_experiment(spark, sf):
    """True campaigns against those linked from what was flagged."""
    state, test, detections = _served(spark, sf)
    judged = EV.evaluation_table(detections, test.select("event_id", "label", "campaign_id"), state.risk)
    judged = judged.select("event_id", "entity_id", "ts_us", "risk", "predicted", "hits", "campaign_id")
    return EV.campaign_experiment(settle(judged), state.risk.alert_threshold, WIDE)


@query("cold_start_ablation")
def cold_start_ablation(spark, sf):
    """Recall on events of little-known entities, with cohort priors and with the global prior alone."""
    state, test, detections = _served(spark, sf)
    return EV.cold_start_ablation(test, test.select("event_id", "label"), state, WIDE, detections)
