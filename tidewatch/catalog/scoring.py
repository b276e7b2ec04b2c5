"""Queries over rules, risk, evaluation, drift, campaigns, feedback and reads.

Where an operator needs model scores, the query derives them from the table by plain arithmetic
(the ``scored`` table below), so that its SQL twin can state the same input.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.catalog.features import _SEEN_CTE, WIDE
from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import BLOCK, EVENTS, ORDERED, WEIGHT, haversine, r4, recent, with_
from tidewatch.config import ANOMALY_CLASSES, DEFAULTS
from tidewatch.functions.scalar import r4 as R
from tidewatch.operators import campaigns as K
from tidewatch.operators import drift as D
from tidewatch.operators import feedback as B
from tidewatch.operators import metrics as M
from tidewatch.operators import reads as H
from tidewatch.operators import risk as RI
from tidewatch.operators import rules as RU
from tidewatch.operators.features import featurise
from tidewatch.operators.ranking import quantiles, ranked
from tidewatch.sources.telemetry import access_events

_K = "CAST(session_duration / 10 AS INT)"
_PRED = (
    "CASE WHEN value > 140 THEN 'low_and_slow_exfil' WHEN NOT auth_success AND value > 50 THEN 'brute_force' "
    f"WHEN {_K} >= 97 THEN 'impossible_travel' ELSE 'normal' END"
)
_TIERS = (
    f"{_K} % 20 / CAST(20 AS DOUBLE) AS baseline, event_id % 16 / CAST(16 AS DOUBLE) AS sequence, "
    "least(100, floor(value)) / CAST(100 AS DOUBLE) AS classifier"
)
SCORED = f"""sc AS (SELECT event_id, entity_id, entity_type, ts_us, session_id, split, label, value,
  least(CAST(100 AS DOUBLE), floor(value)) AS risk, {_PRED} AS predicted, {_TIERS},
  CASE WHEN label <> 'normal' THEN 1 ELSE 0 END AS y, value > 230 AS is_anomaly,
  CASE WHEN auth_success THEN 'low_and_slow_exfil' ELSE 'brute_force' END AS anomaly_type FROM ev)"""
SC = with_(EVENTS, SCORED)


def scored(spark, sf):
    return access_events(spark, sf).selectExpr(
        "event_id", "entity_id", "entity_type", "ts_us", "session_id", "split", "label", "value",
        "least(100D, cast(floor(value) AS double)) AS risk", f"{_PRED} AS predicted",
        f"{_K} % 20 / 20D AS baseline", "event_id % 16 / 16D AS sequence", "least(100, floor(value)) / 100D AS classifier",
        "if(label <> 'normal', 1, 0) AS y", "value > 230 AS is_anomaly",
        "if(auth_success, 'low_and_slow_exfil', 'brute_force') AS anomaly_type",
    )


def _rounded(df, *cols):
    return df.select(*[R(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- rules ----------------------------------------------------------------------------------- #

_RULES_SQL = f"""{with_(EVENTS, ORDERED, WEIGHT, _SEEN_CTE, recent(360))},
  f AS (SELECT r.event_id, r.entity_id, r.ts_us, r.label, r.rn, {haversine('r.p_lat', 'r.p_lon', 'r.geo_lat', 'r.geo_lon')} AS km,
      greatest(abs(r.ts_us - r.p_us) / 1e6, 60) / 3600 AS hours, sn.snap_n > 0 AND sn.weight > 0 AND sn.seen_country = 0 AS fresh,
      len(list_filter(win, lambda x: NOT x.ok)) + CASE WHEN r.auth_success THEN 0 ELSE 1 END AS fails FROM r JOIN sn ON sn.event_id = r.event_id),
  h AS (SELECT *, rn > 1 AND fresh AND km >= 2000 AND km / hours > 900 AS travel, fails >= 5 AS brute FROM f),
  c AS (SELECT *, CASE WHEN travel THEN least(1, greatest(0.5, 0.5 + 0.5 * (km / hours - 900) / 900)) END AS travel_conf,
      CASE WHEN brute THEN least(1, greatest(0.5, 0.5 + 0.5 * (fails - 5) / CAST(5 AS DOUBLE))) END AS brute_conf FROM h)"""


def _ruled(spark, sf):
    f = featurise(access_events(spark, sf), WIDE, names=RU.RULE_FEATURES)
    return RU.apply_rules(f, WIDE)


@query(
    "rules_fired",
    f"""{_RULES_SQL}, l AS (SELECT event_id, 'impossible_travel' AS rule, travel_conf AS confidence FROM c WHERE travel
        UNION ALL SELECT event_id, 'brute_force', brute_conf FROM c WHERE brute)
      SELECT event_id, rule, {r4('confidence')} AS confidence, row_number() OVER (PARTITION BY event_id ORDER BY round(confidence, 9) DESC, rule DESC) AS strength FROM l""",
)
def rules_fired(spark, sf):
    hits = _ruled(spark, sf).selectExpr("event_id", "posexplode(hits) AS (i, h)")
    return hits.select("event_id", F.col("h.name").alias("rule"), R(F.col("h.conf")).alias("confidence"),
                       (F.col("i") + 1).cast("bigint").alias("strength"))


@query(
    "brute_force_bursts",
    f"""{with_(EVENTS, ORDERED, recent(360))}, f AS (SELECT entity_id, event_id, len(list_filter(win, lambda x: NOT x.ok)) + CASE WHEN auth_success THEN 0 ELSE 1 END AS fails FROM r)
      SELECT entity_id, count(*) AS bursts, max(fails) AS worst, {r4('max(least(1, greatest(0.5, 0.5 + 0.5 * (fails - 5) / CAST(5 AS DOUBLE))))')} AS confidence
      FROM f WHERE fails >= 5 GROUP BY 1""",
)
def brute_force_bursts(spark, sf):
    f = featurise(access_events(spark, sf), WIDE, names=("window_auth_failures",)).filter("window_auth_failures >= 5")
    return f.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("bursts"), F.max("window_auth_failures").cast("bigint").alias("worst"),
        R(F.max(F.expr(RU.confidence_sql("window_auth_failures", 5.0)))).alias("confidence"),
    ).orderBy(F.desc("bursts"), "entity_id")


@query(
    "resolved_types",
    f"""{SC}, r AS (SELECT event_id, predicted, event_id % 4 = 0 AS brute, event_id % 6 = 0 AS travel, (event_id % 6) / 10.0 + 0.3 AS p_pred,
        least(1, 0.5 + (event_id % 10) / 10.0) AS bc, 0.8 AS tc FROM sc),
      o AS (SELECT *, CASE WHEN brute AND bc >= 0.75 AND (NOT travel OR bc >= tc) THEN 'brute_force' WHEN travel THEN 'impossible_travel'
          END AS forced, CASE WHEN brute AND bc >= 0.75 AND (NOT travel OR bc >= tc) THEN bc WHEN travel THEN tc END AS conf FROM r)
      SELECT event_id, CASE WHEN forced IS NULL OR (predicted <> 'normal' AND predicted <> forced AND p_pred >= 0.5) THEN predicted ELSE forced END AS predicted_type,
        {r4("CASE WHEN forced IS NULL OR (predicted <> 'normal' AND predicted <> forced AND p_pred >= 0.5) THEN p_pred WHEN predicted = forced THEN conf ELSE (1 - conf) * p_pred / (CASE WHEN 1 - 0 = 0 THEN 1 ELSE p_pred END) END")} AS p_base FROM o""",
)
def resolved_types(spark, sf):
    p = "(event_id % 6) / 10D + 0.3D"
    rows = scored(spark, sf).selectExpr("event_id", "predicted AS base_type", f"map(predicted, {p}, 'other', 0D) AS probs")
    rules = {
        "impossible_travel": {"fires": "event_id % 6 = 0", "confidence": "0.8D", "detail": "''"},
        "brute_force": {"fires": "event_id % 4 = 0", "confidence": "least(1D, 0.5D + (event_id % 10) / 10D)", "detail": "''"},
    }
    ruled = RU.resolve_type(RU.apply_rules(rows, rules=rules))
    return ruled.select("event_id", F.col("predicted").alias("predicted_type"),
                        R(F.expr("if(base_type = 'other', 0D, probs_adjusted[base_type])")).alias("p_base"))


# --- risk ------------------------------------------------------------------------------------ #

_KNOTS = ((0.0, 0.0), (0.2, 0.05), (0.5, 0.4), (0.8, 0.9))
_W = (0.35, 0.30, 0.35)
_CAL = "CASE WHEN fused <= 0 THEN 0 WHEN fused <= 0.2 THEN fused * 0.25 WHEN fused <= 0.5 THEN 0.05 + (fused - 0.2) * 0.35 / 0.3 WHEN fused <= 0.8 THEN 0.4 + (fused - 0.5) * 0.5 / 0.3 ELSE 0.9 END"


@query(
    "risk_assessment",
    f"""{SC}, f AS (SELECT *, least(1, greatest(0, 0.35 * baseline + 0.30 * sequence + 0.35 * classifier)) AS fused, event_id % 7 = 0 AS hit,
        event_id % 3 = 0 AS cold, (baseline + sequence + classifier) / 3 AS mean FROM sc),
      g AS (SELECT *, 100 * {_CAL} AS model_risk, least(50, 80 * sqrt((pow(baseline - mean, 2) + pow(sequence - mean, 2) + pow(classifier - mean, 2)) / 3) * CASE WHEN cold THEN 2 ELSE 1 END) AS band FROM f),
      h AS (SELECT *, CASE WHEN hit THEN greatest(model_risk, 72) ELSE model_risk END AS r FROM g)
      SELECT event_id, round(fused, 6) AS fused, round(r, 8) AS risk, round(band, 8) AS uncertainty, r >= 45.00001 OR hit AS in_budget, r >= 60.00001 OR hit AS is_anomaly FROM h""",
)
def risk_assessment(spark, sf):
    rows = scored(spark, sf).selectExpr(
        "event_id", "baseline", "sequence", "classifier", "if(event_id % 3 = 0, 1D, 0D) AS cold_start",
        "if(event_id % 7 = 0, named_struct('conf', 0.8D), null) AS override",
    )
    out = RI.assess(rows, RI.RiskModel(_W, _KNOTS, 45.00001, 60.00001))
    out = out.select("event_id", F.round("fused", 6).alias("fused"), F.round("risk", 8).alias("risk"), F.round("uncertainty", 8).alias("uncertainty"), "in_budget", "is_anomaly")
    return out


@query(
    "weight_grid_search",
    f"""{SC}, v AS (SELECT event_id, y, baseline AS b, sequence AS s, classifier AS c FROM sc WHERE split = 'val'),
      n AS (SELECT count(*) AS n, sum(y) AS pos FROM v), g AS (SELECT i, j FROM range(21) a(i), range(21) b(j) WHERE i + j <= 20),
      f AS (SELECT i, j, y, row_number() OVER (PARTITION BY i, j ORDER BY round(i * 0.05 * b + j * 0.05 * s + greatest(0, 1 - i * 0.05 - j * 0.05) * c, 9) DESC, event_id) AS r FROM v, g)
      SELECT i AS baseline_steps, j AS sequence_steps, CAST(sum(CASE WHEN r <= greatest(1, round_even(n.n * 0.05, 0)) THEN y ELSE 0 END) AS BIGINT) AS hits FROM f, n GROUP BY 1, 2""",
)
def weight_grid_search(spark, sf):
    t = RI.tune_weights(scored(spark, sf).filter("split = 'val'"), 0.05)
    return t.selectExpr(
        "cast(round(w_baseline * 20) AS bigint) AS baseline_steps", "cast(round(w_sequence * 20) AS bigint) AS sequence_steps", "cast(hits AS bigint) AS hits"
    )


@query(
    "budget_thresholds",
    f"{SC} SELECT {r4('quantile_cont(value, 0.99)')} AS p99, {r4('quantile_cont(value, 0.95)')} AS p95, {r4('quantile_cont(value, 0.5)')} AS median FROM sc",
)
def budget_thresholds(spark, sf):
    q = quantiles(scored(spark, sf), "value", [0.99, 0.95, 0.5])
    return spark.range(1).select(*[R(F.lit(v)).alias(n) for n, v in zip(("p99", "p95", "median"), q)])


@query(
    "score_normaliser",
    f"""{SC}, q AS (SELECT quantile_cont(value, 0.95) AS c, median(value) AS m FROM sc), d AS (SELECT median(abs(value - m)) AS mad FROM sc, q)
      SELECT event_id, {r4('1 / (1 + exp(-least(12, greatest(-12, (value - c) / (1.4826 * mad)))))')} AS score FROM sc, q, d""",
)
def score_normaliser(spark, sf):
    from tidewatch.operators.tiers import fit_normaliser

    s = scored(spark, sf)
    return s.select("event_id", R(F.expr(fit_normaliser(s, "value").sql("value"))).alias("score"))


@query(
    "calibrated_probabilities",
    f"""{SC}, p AS (SELECT event_id, 1 - classifier AS a, classifier * 0.7 AS b, classifier * 0.3 AS c FROM sc),
      q AS (SELECT event_id, {_CAL.replace('fused', 'a')} AS a, {_CAL.replace('fused', 'b')} AS b, least(1, greatest(0, c)) AS c FROM p),
      r AS (SELECT *, a + b + c AS t FROM q)
      SELECT event_id, {r4('CASE WHEN t > 0 THEN a / t ELSE 0 END')} AS p_normal, {r4('CASE WHEN t > 0 THEN b / t ELSE 0 END')} AS p_brute_force,
        CASE WHEN a >= b AND a >= c THEN 'normal' WHEN c >= b THEN 'lateral_movement' ELSE 'brute_force' END AS base_type FROM r""",
)
def calibrated_probabilities(spark, sf):
    from tidewatch.operators.tiers import calibrate

    raw = scored(spark, sf).selectExpr("event_id", "array(1 - classifier, 0D, classifier * 0.3D, classifier * 0.7D, 0D, 0D, 0D, 0D, 0D) AS p")
    zero = ((0.0, 0.0), (1.0, 0.0))
    knots = {c: zero for c in ANOMALY_CLASSES}
    knots.update({"normal": _KNOTS, "brute_force": _KNOTS, "lateral_movement": ((0.0, 0.0), (1.0, 1.0))})
    out = calibrate(raw, knots)
    return out.select("event_id", R(F.col("probs")["normal"]).alias("p_normal"), R(F.col("probs")["brute_force"]).alias("p_brute_force"), "base_type")


# --- evaluation ------------------------------------------------------------------------------ #

_RANK = "rk AS (SELECT *, row_number() OVER (ORDER BY risk DESC, event_id) AS rank FROM sc), tot AS (SELECT count(*) AS n, sum(y) AS pos FROM sc)"


@query(
    "recall_at_budget",
    f"""{with_(EVENTS, SCORED, _RANK)}, b(budget) AS (VALUES (0.01), (0.05), (0.25)), k AS (SELECT CAST(budget AS DOUBLE) AS budget, CAST(greatest(1, round_even(n * CAST(budget AS DOUBLE), 0)) AS BIGINT) AS k FROM b, tot)
      SELECT budget, k, CAST(sum(CASE WHEN rank <= k THEN y ELSE 0 END) AS BIGINT) AS hits, {r4('sum(CASE WHEN rank <= k THEN y ELSE 0 END) / CAST(any_value(pos) AS DOUBLE)')} AS recall FROM rk, k, tot GROUP BY 1, 2""",
)
def recall_at_budget(spark, sf):
    return _rounded(M.recall_at_budget(scored(spark, sf), [0.01, 0.05, 0.25]), "recall")


@query(
    "precision_curve",
    f"""{with_(EVENTS, SCORED, _RANK)}, h AS (SELECT rank, sum(y) OVER (ORDER BY rank) AS hits FROM rk),
      p AS (SELECT DISTINCT CAST(floor(i * (n - 1) / CAST(199 AS DOUBLE)) AS BIGINT) + 1 AS k FROM range(200) t(i), tot)
      SELECT k, CAST(hits AS BIGINT) AS hits, {r4('hits / CAST(k AS DOUBLE)')} AS precision FROM p JOIN h ON h.rank = p.k""",
)
def precision_curve(spark, sf):
    return _rounded(M.precision_curve(scored(spark, sf)), "precision")


@query(
    "global_ranks",
    f"{with_(EVENTS, SCORED, _RANK)} SELECT event_id, rank, CAST(sum(y) OVER (ORDER BY rank) AS BIGINT) AS hits FROM rk",
)
def global_ranks(spark, sf):
    r = ranked(scored(spark, sf).select("event_id", "risk", "y"), "risk", "event_id", {"hits": "y"}, bucket_rows=2000)
    return r.select("event_id", "rank", "hits")


_CLS = "cls(label) AS (VALUES " + ", ".join(f"('{c}')" for c in ANOMALY_CLASSES) + ")"
_PC = f"""{_CLS}, pc AS (SELECT cls.label, count(*) FILTER (sc.label = cls.label) AS support, count(*) FILTER (sc.predicted = cls.label) AS pn,
  count(*) FILTER (sc.label = cls.label AND sc.predicted = cls.label) AS hits FROM cls, sc GROUP BY 1),
pf AS (SELECT *, CASE WHEN pn > 0 THEN hits / CAST(pn AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN pn + support > 0 THEN 2 * hits / CAST(pn + support AS DOUBLE) ELSE 0 END AS f1 FROM pc)"""


@query(
    "per_class_metrics",
    f"{with_(EVENTS, SCORED, _PC)} SELECT label, support, {r4('precision')} AS precision, {r4('recall')} AS recall, {r4('f1')} AS f1 FROM pf",
)
def per_class_metrics(spark, sf):
    return _rounded(M.per_class(scored(spark, sf)), "precision", "recall", "f1")


@query(
    "confusion_matrix",
    f"""{with_(EVENTS, SCORED, _CLS)} SELECT a.label, b.label AS predicted, (SELECT count(*) FROM sc WHERE sc.label = a.label AND sc.predicted = b.label) AS n FROM cls a, cls b""",
)
def confusion_matrix(spark, sf):
    return M.confusion(scored(spark, sf))


@query(
    "macro_f1",
    f"""{with_(EVENTS, SCORED, _PC)} SELECT {r4('avg(f1)')} AS macro_f1, {r4('avg(f1) FILTER (support > 0)')} AS macro_f1_present, count(*) FILTER (support = 0) AS n_missing FROM pf""",
)
def macro_f1(spark, sf):
    return _rounded(M.macro_f1(scored(spark, sf)), "macro_f1", "macro_f1_present")


@query("missing_classes", f"{with_(EVENTS, SCORED, _CLS)} SELECT label FROM cls WHERE label NOT IN (SELECT label FROM sc)")
def missing_classes(spark, sf):
    return M.missing_classes(scored(spark, sf))


@query(
    "ranking_quality",
    f"""{SC}, g AS (SELECT risk, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1), t AS (SELECT sum(n) AS n, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n - pos) AS DOUBLE) AS q FROM g),
      c AS (SELECT *, sum(n) OVER (ORDER BY risk DESC) AS cn, sum(pos) OVER (ORDER BY risk DESC) AS cp FROM g),
      a AS (SELECT sum(pos / t.p * cp / CAST(cn AS DOUBLE)) AS ap, sum(pos * (t.q - (cn - cp) + 0.5 * (c.n - pos))) / (any_value(t.p) * any_value(t.q)) AS auc, any_value(t.p / t.n) AS prev FROM c, t)
      SELECT {r4('ap')} AS average_precision, {r4('ap / prev')} AS uplift, {r4('auc')} AS roc_auc FROM a""",
)
def ranking_quality(spark, sf):
    return _rounded(M.ranking_quality(scored(spark, sf)), "average_precision", "uplift", "roc_auc")


@query(
    "calibration_error",
    f"""{SC}, b AS (SELECT least(CAST(floor(risk / 100 * 10) AS INT), 9) AS bin, risk / 100 AS p, y FROM sc), g AS (SELECT bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM b GROUP BY 1)
      SELECT {r4('sum(n * abs(c - a)) / sum(n)')} AS ece FROM g""",
)
def calibration_error(spark, sf):
    return _rounded(M.calibration_error(scored(spark, sf)), "ece")


@query(
    "rule_precision",
    f"""{_RULES_SQL}, l AS (SELECT 'impossible_travel' AS rule, travel AS fired, label FROM c UNION ALL SELECT 'brute_force', brute, label FROM c)
      SELECT rule, count(*) FILTER (fired) AS n_fired, {r4("avg(CASE WHEN label <> 'normal' THEN 1 ELSE 0 END) FILTER (fired)")} AS anomaly_precision,
        {r4("avg(CASE WHEN label = rule THEN 1 ELSE 0 END) FILTER (fired)")} AS type_precision, {r4("count(*) FILTER (fired AND label = rule) / CAST(count(*) FILTER (label = rule) AS DOUBLE)")} AS recall FROM l GROUP BY 1""",
)
def rule_precision(spark, sf):
    df = access_events(spark, sf)
    ruled = RU.apply_rules(featurise(df, WIDE, names=RU.RULE_FEATURES), WIDE).join(df.select("event_id", "label"), "event_id")
    rules = {n: f"exists(hits, x -> x.name = '{n}')" for n in ("impossible_travel", "brute_force")}
    return _rounded(M.rule_precision(ruled, rules), "anomaly_precision", "type_precision", "recall")


@query(
    "recall_by_class",
    f"""{with_(EVENTS, SCORED, _RANK)} SELECT label, count(*) AS n, count(*) FILTER (rank <= greatest(1, round_even(tot.n * 0.01, 0))) AS hits,
      {r4('avg(CASE WHEN rank <= greatest(1, round_even(tot.n * 0.01, 0)) THEN 1 ELSE 0 END)')} AS recall FROM rk, tot WHERE label <> 'normal' GROUP BY 1""",
)
def recall_by_class(spark, sf):
    return _rounded(M.recall_by_class(scored(spark, sf), 0.01), "recall")


@query(
    "uncertainty_cold_and_warm",
    f"""{with_(EVENTS, SCORED, ORDERED, WEIGHT)}, u AS (SELECT sc.event_id, w.sessions < 15 AS cold, (baseline + sequence + classifier) / 3 AS m, * FROM sc JOIN w ON w.event_id = sc.event_id),
      v AS (SELECT cold, risk, least(50, 80 * sqrt((pow(baseline - m, 2) + pow(sequence - m, 2) + pow(classifier - m, 2)) / 3) * CASE WHEN cold THEN 2 ELSE 1 END) AS band FROM u)
      SELECT cold, count(*) AS n, {r4('avg(band)')} AS mean_uncertainty, {r4('avg(CASE WHEN risk >= 90 THEN 1 ELSE 0 END)')} AS budget_fraction FROM v GROUP BY 1""",
)
def uncertainty_cold_and_warm(spark, sf):
    cold = featurise(access_events(spark, sf), names=("cold_start",)).select("event_id", "cold_start")
    s = scored(spark, sf).join(cold, "event_id").selectExpr("*", f"{RI.uncertainty_sql(DEFAULTS, 'cold_start >= 0.5')} AS band")
    return s.groupBy((F.col("cold_start") >= 0.5).alias("cold")).agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("band")).alias("mean_uncertainty"), R(F.avg(F.expr("if(risk >= 90, 1D, 0D)"))).alias("budget_fraction")
    )


@query(
    "metric_verdicts",
    f"""{with_(EVENTS, SCORED, _PC)}, m AS (SELECT avg(f1) AS macro_f1, avg(f1) FILTER (support > 0) AS macro_f1_present FROM pf)
      SELECT 'macro_f1' AS metric, {r4('macro_f1')} AS value, CAST(0.85 AS DOUBLE) AS target, CASE WHEN macro_f1 >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m
      UNION ALL SELECT 'macro_f1_present', {r4('macro_f1_present')}, CAST(0.5 AS DOUBLE), CASE WHEN macro_f1_present >= 0.5 THEN 'PASS' ELSE 'FAIL' END FROM m""",
)
def metric_verdicts(spark, sf):
    m = M.macro_f1(scored(spark, sf))
    return _rounded(M.verdicts(m, {"macro_f1": (0.85, True), "macro_f1_present": (0.5, True)}), "value")


@query("scored_split_summary", f"""{SC} SELECT split, count(*) AS n, count(DISTINCT entity_id) AS entities, {r4('avg(y)')} AS prevalence, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (risk >= 100) AS in_budget FROM sc GROUP BY 1""")
def scored_split_summary(spark, sf):
    return scored(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"), R(F.avg("y")).alias("prevalence"),
        F.expr("count_if(is_anomaly) AS anomalies"), F.expr("count_if(risk >= 100) AS in_budget"),
    )


# --- drift ----------------------------------------------------------------------------------- #


def _signal(spark, sf):
    return access_events(spark, sf).selectExpr("entity_id", "ts_us", "event_id", "log1p(value) AS value")


_J = range(10)
_DRIFT = f"""{with_(EVENTS, ORDERED)}, v AS (SELECT entity_id, event_id, ts_us, rn, ln(1 + value) AS x FROM o),
  q AS (SELECT entity_id, list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e0 FROM v WHERE rn <= 50 GROUP BY 1),
  e AS (SELECT entity_id, list_sort(e0) AS e FROM q),
  b AS (SELECT v.*, e, CASE WHEN x >= e[1] AND x <= e[-1] THEN least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) - 1 END AS bin FROM v JOIN e USING (entity_id)),
  bs AS (SELECT entity_id, {', '.join(f'count(*) FILTER (bin = {j}) AS c{j}' for j in _J)}, CAST(count(bin) AS DOUBLE) AS c FROM b WHERE rn <= 50 GROUP BY 1),
  w AS (SELECT entity_id, event_id, rn, {', '.join(f'count(*) FILTER (bin = {j}) OVER s AS n{j}' for j in _J)}, CAST(count(bin) OVER s AS DOUBLE) AS n FROM b WHERE rn > 50
    WINDOW s AS (PARTITION BY entity_id ORDER BY ts_us, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
  p AS (SELECT w.entity_id, event_id, rn - 50 AS samples, {', '.join(f'greatest(c{j} / c, 1e-6) AS b{j}, greatest(CASE WHEN n = 0 THEN 0.1 ELSE n{j} / n END, 1e-6) AS r{j}' for j in _J)} FROM w JOIN bs USING (entity_id)),
  t AS (SELECT *, {' + '.join(f'b{j}' for j in _J)} AS bt, {' + '.join(f'r{j}' for j in _J)} AS rt FROM p),
  psi AS (SELECT entity_id, event_id, samples, CASE WHEN samples >= 50 THEN {' + '.join(f'(r{j} / rt - b{j} / bt) * ln((r{j} / rt) / (b{j} / bt))' for j in _J)} ELSE 0 END AS psi FROM t)"""


@query(
    "static_drift",
    f"{_DRIFT} SELECT entity_id, event_id, samples, {r4('psi')} AS psi, CASE WHEN psi >= 0.2 THEN 'drifting' ELSE 'stable' END AS status FROM psi",
)
def static_drift(spark, sf):
    d = D.static_drift(_signal(spark, sf))
    return _rounded(d.select("entity_id", "event_id", "samples", "psi", "status"), "psi")


@query(
    "static_drift_summary",
    f"""{_DRIFT} SELECT count(*) AS n, {r4('avg(CASE WHEN psi >= 0.2 THEN 1 ELSE 0 END)')} AS drift_fraction, {r4('avg(psi) FILTER (psi > 0)')} AS mean_psi, {r4('max(psi)')} AS max_psi FROM psi""",
)
def static_drift_summary(spark, sf):
    s = D.drift_summary(D.static_drift(_signal(spark, sf))).drop("adapted")
    return _rounded(s, "drift_fraction", "mean_psi", "max_psi")


# The monitor as a fold: one reading of every entity at a time, carrying base shares and streak.
_ROW = f"[{', '.join(f'CASE WHEN n = 0 THEN CAST(1 AS DOUBLE) / k ELSE n{j} / n END' for j in _J)}][:k]"
_BASE = f"[{', '.join(f'CASE WHEN c = 0 THEN CAST(1 AS DOUBLE) / k ELSE c{j} / c END' for j in _J)}][:k]"
_FLOOR = "list_transform({0}, lambda x: greatest(x, 1e-6))"
_MIX = "list_transform(list_zip(base, r), lambda z: 0.95 * z[1] + 0.05 * z[2])"
_FOLD = f"""{_DRIFT.replace('WITH ', 'WITH RECURSIVE ', 1)},
  rows AS (SELECT w.entity_id, event_id, rn - 50 AS m, {_ROW} AS r, {_BASE} AS own FROM (SELECT w.*, len(e) - 1 AS k FROM w JOIN e USING (entity_id)) w JOIN bs USING (entity_id)),
  f AS (
    SELECT entity_id, CAST(0 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS event_id, own AS base, 0 AS streak, CAST(0 AS DOUBLE) AS psi, '' AS status FROM rows WHERE m = 1
    UNION ALL
    SELECT entity_id, m, event_id, CASE WHEN m >= 50 AND (s2 = 0 OR s2 = 3) THEN list_transform({_MIX}, lambda x: x / list_sum({_MIX})) ELSE base END,
      CASE WHEN s2 = 3 THEN 0 ELSE s2 END, psi, CASE WHEN s2 = 3 THEN 'adapted' WHEN s2 > 0 THEN 'drifting' ELSE 'stable' END
    FROM (SELECT *, CASE WHEN psi >= 0.2 THEN streak + 1 ELSE 0 END AS s2 FROM (
      SELECT *, CASE WHEN m < 50 THEN 0 ELSE list_sum(list_transform(list_zip(list_transform(fr, lambda x: x / list_sum(fr)), list_transform(fb, lambda x: x / list_sum(fb))), lambda z: (z[1] - z[2]) * ln(z[1] / z[2]))) END AS psi
      FROM (SELECT rows.entity_id, rows.m, rows.event_id, r, base, streak, {_FLOOR.format('r')} AS fr, {_FLOOR.format('base')} AS fb FROM f JOIN rows ON rows.entity_id = f.entity_id AND rows.m = f.m + 1))))"""


@query("adaptive_drift", f"{_FOLD} SELECT entity_id, event_id, m AS samples, {r4('psi')} AS psi, status FROM f WHERE m > 0")
def adaptive_drift(spark, sf):
    return _rounded(D.adaptive_drift(_signal(spark, sf)).select("entity_id", "event_id", "samples", "psi", "status"), "psi")


@query(
    "adaptive_drift_states",
    f"""{_FOLD} SELECT status, count(*) AS entities, string_agg(entity_id, ',' ORDER BY entity_id) AS members
      FROM (SELECT entity_id, arg_max(status, m) AS status FROM f WHERE m > 0 GROUP BY 1) GROUP BY 1""",
)
def adaptive_drift_states(spark, sf):
    return D.latest_states(D.adaptive_drift(_signal(spark, sf))).groupBy("status").agg(
        F.count(F.lit(1)).alias("entities"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("members")
    )


@query(
    "adaptive_drift_summary",
    f"""{_FOLD} SELECT count(*) AS n, {r4("avg(CASE WHEN status = 'drifting' THEN 1 ELSE 0 END)")} AS drift_fraction, count(*) FILTER (status = 'adapted') AS adapted,
      {r4('coalesce(avg(psi) FILTER (psi > 0), 0)')} AS mean_psi, {r4('max(psi)')} AS max_psi FROM f WHERE m > 0""",
)
def adaptive_drift_summary(spark, sf):
    return _rounded(D.drift_summary(D.adaptive_drift(_signal(spark, sf))), "drift_fraction", "mean_psi", "max_psi")


# --- campaigns ------------------------------------------------------------------------------- #

_GAP = 72 * 3_600_000_000
_CAMP = f"""{SC}, an AS (SELECT *, lag(ts_us) OVER w AS p FROM sc WHERE is_anomaly WINDOW w AS (PARTITION BY entity_id ORDER BY ts_us, event_id)),
  cp AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR ts_us - p > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS BIGINT) AS campaign_no FROM an)"""


def _anomalies(spark, sf):
    return scored(spark, sf).filter("is_anomaly").select("event_id", "entity_id", "ts_us", "anomaly_type", "value").withColumnRenamed("value", "risk")


@query("campaign_links", f"{_CAMP} SELECT event_id, entity_id, campaign_no FROM cp")
def campaign_links(spark, sf):
    return K.link(_anomalies(spark, sf)).select("event_id", "entity_id", "campaign_no")


@query(
    "campaign_rollup",
    f"{_CAMP} SELECT entity_id, campaign_no, min(ts_us) AS started_us, max(ts_us) AS last_us, count(*) AS stages, {r4('max(value)')} AS max_risk, count(DISTINCT anomaly_type) AS types FROM cp GROUP BY 1, 2",
)
def campaign_rollup(spark, sf):
    return _rounded(K.rollup(K.link(_anomalies(spark, sf))).drop("campaign_id"), "max_risk")


@query(
    "campaign_kill_chains",
    f"""{_CAMP}, s AS (SELECT *, lag(anomaly_type) OVER (PARTITION BY entity_id, campaign_no ORDER BY ts_us, event_id) AS pt FROM cp)
      SELECT entity_id, campaign_no, row_number() OVER (PARTITION BY entity_id, campaign_no ORDER BY ts_us, event_id) AS step, event_id, anomaly_type FROM s WHERE pt IS NULL OR pt <> anomaly_type""",
)
def campaign_kill_chains(spark, sf):
    return K.kill_chain(K.link(_anomalies(spark, sf))).select("entity_id", "campaign_no", "step", "event_id", "anomaly_type")


@query(
    "campaign_reconstruction",
    f"""{_CAMP}, t AS (SELECT ev.event_id, ev.campaign_id AS truth_id, cp.entity_id || '#' || cp.campaign_no AS recon_id FROM ev LEFT JOIN cp ON cp.event_id = ev.event_id),
      m AS (SELECT truth_id, recon_id, count(*) AS n FROM t WHERE truth_id IS NOT NULL AND recon_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT truth_id, max(n) AS maj, sum(n) AS n FROM m GROUP BY 1)
      SELECT CAST(sum(maj) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS linked, (SELECT count(DISTINCT truth_id) FROM t) AS expected, (SELECT count(DISTINCT recon_id) FROM t) AS reconstructed,
        {r4('sum(maj) / CAST(sum(n) AS DOUBLE)')} AS stages_linked FROM x""",
)
def campaign_reconstruction(spark, sf):
    links = K.link(_anomalies(spark, sf)).select("event_id", F.col("campaign_id").alias("recon_id"))
    truth = access_events(spark, sf).select("event_id", F.col("campaign_id").alias("truth_id"))
    return _rounded(K.reconstruction(truth.join(links, "event_id", "left")), "stages_linked")


# --- feedback -------------------------------------------------------------------------------- #

_FB = f"""{SC}, fb AS (SELECT event_id, entity_id, ts_us, CASE WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'false_positive' END AS verdict,
    row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS seq FROM sc WHERE value > 100),
  fl AS (SELECT event_id, entity_id, ts_us, seq, CASE WHEN verdict = 'confirmed' THEN CAST(10 AS DOUBLE) ELSE CAST(-10 AS DOUBLE) END AS step,
    list(CASE WHEN verdict = 'confirmed' THEN CAST(10 AS DOUBLE) ELSE CAST(-10 AS DOUBLE) END) OVER (PARTITION BY entity_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS steps FROM fb),
  au AS (SELECT event_id, entity_id, ts_us, seq, step, list_reduce(list_prepend(CAST(0 AS DOUBLE), steps), lambda a, x: greatest(CAST(-40 AS DOUBLE), least(CAST(40 AS DOUBLE), a + x))) AS new_value FROM fl)"""


def _feedback(spark, sf):
    return scored(spark, sf).filter("value > 100").selectExpr(
        "event_id AS feedback_id", "event_id AS detection_id", "ts_us", "if(event_id % 3 = 0, 'confirmed', 'false_positive') AS verdict"
    )


def _audit(spark, sf):
    known, _ = B.accepted(_feedback(spark, sf), scored(spark, sf).withColumnRenamed("event_id", "detection_id"))
    return B.fold(known)


@query(
    "feedback_audit",
    f"{_FB} SELECT event_id AS feedback_id, entity_id, seq, step AS adjustment, coalesce(lag(new_value) OVER (PARTITION BY entity_id ORDER BY seq), 0) AS previous_value, new_value FROM au",
)
def feedback_audit(spark, sf):
    return _audit(spark, sf).select("feedback_id", "entity_id", F.col("seq").cast("bigint").alias("seq"), "adjustment", "previous_value", "new_value")


@query(
    "feedback_offsets",
    f"{_FB} SELECT entity_id, arg_max(new_value, seq) AS \"offset\", count(*) AS verdicts FROM au GROUP BY 1",
)
def feedback_offsets(spark, sf):
    return B.offsets(_audit(spark, sf))


@query(
    "feedback_rejected",
    f"{SC} SELECT event_id + 1 AS detection_id FROM sc WHERE value > 200 AND event_id + 1 NOT IN (SELECT event_id FROM sc)",
)
def feedback_rejected(spark, sf):
    s = scored(spark, sf)
    fb = s.filter("value > 200").selectExpr("event_id + 1 AS detection_id", "'confirmed' AS verdict")
    return B.accepted(fb, s.withColumnRenamed("event_id", "detection_id"))[1].select("detection_id")


@query(
    "decisions_after_feedback",
    f"""{_FB}, off AS (SELECT entity_id, arg_max(new_value, seq) AS o FROM au GROUP BY 1)
      SELECT event_id, greatest(0, least(100, risk + coalesce(o, 0))) AS effective_risk, greatest(0, least(100, risk + coalesce(o, 0))) >= 60 AS decided_anomaly FROM sc LEFT JOIN off USING (entity_id)""",
)
def decisions_after_feedback(spark, sf):
    off = B.offsets(_audit(spark, sf)).select("entity_id", "offset")
    rows = scored(spark, sf).join(off, "entity_id", "left").withColumn("hits", F.array().cast("array<string>"))
    return RI.decide(rows, RI.RiskModel()).select("event_id", "effective_risk", "decided_anomaly")


@query(
    "offset_at_decision_time",
    f"""{_FB}, b AS (SELECT entity_id, ts_us, 1 AS kind, seq, NULL AS det, new_value FROM au UNION ALL SELECT entity_id, ts_us, 0, 0, event_id, NULL FROM sc),
      c AS (SELECT det, kind, last_value(new_value IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts_us, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM b)
      SELECT det AS event_id, coalesce(o, 0) AS \"offset\" FROM c WHERE kind = 0""",
)
def offset_at_decision_time(spark, sf):
    s = scored(spark, sf)
    audit = _audit(spark, sf).join(_feedback(spark, sf).select("feedback_id", "ts_us"), "feedback_id")
    out = B.offset_as_of(s.selectExpr("event_id AS detection_id", "entity_id", "ts_us"), audit)
    return out.select(F.col("detection_id").cast("bigint").alias("event_id"), "offset")


# --- reads ----------------------------------------------------------------------------------- #

_DET = "event_id, entity_id, round(value, 4) AS risk, ts_us"


def _detections(spark, sf):
    return scored(spark, sf).drop("risk").withColumnRenamed("value", "risk").withColumn("detection_id", F.concat(F.lit("det_"), F.col("event_id")))


def _shown(df, *more):
    return df.select("event_id", "entity_id", F.round("risk", 4).alias("risk"), "ts_us", *more)


@query("ranked_detections", f"{SC} SELECT {_DET} FROM sc WHERE entity_type = 'user' AND value >= 60 AND anomaly_type = 'brute_force' ORDER BY value DESC, event_id LIMIT 50 OFFSET 10")
def ranked_detections(spark, sf):
    return _shown(H.list_detections(_detections(spark, sf), 10, 50, "brute_force", "user", None, 60.0))


@query("latest_detections", f"{SC} SELECT {_DET} FROM sc ORDER BY ts_us DESC, event_id LIMIT 50")
def latest_detections(spark, sf):
    return _shown(H.list_detections(_detections(spark, sf), sort="time"))


@query("detection_by_id", f"{SC} SELECT {_DET} FROM sc WHERE event_id = 20")
def detection_by_id(spark, sf):
    return _shown(H.detection_by_id(_detections(spark, sf), "det_20"))


@query("entity_history", f"{SC} SELECT {_DET}, (SELECT count(*) FROM sc WHERE entity_id = 'ent_0') AS total FROM sc WHERE entity_id = 'ent_0' ORDER BY value DESC, ts_us DESC, event_id LIMIT 100")
def entity_history(spark, sf):
    return _shown(H.entity_history(_detections(spark, sf), "ent_0"), "total")


@query("top_detection_per_entity", f"{SC}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY value DESC, event_id) AS r FROM sc) SELECT {_DET} FROM r WHERE r = 1 ORDER BY value DESC, event_id LIMIT 10")
def top_detection_per_entity(spark, sf):
    return _shown(H.top_per_entity(_detections(spark, sf)))


@query("storyline", f"{SC} SELECT event_id, ts_us, round(value, 4) AS risk FROM sc WHERE entity_id = 'ent_2' ORDER BY ts_us, event_id")
def storyline(spark, sf):
    return H.storyline(_detections(spark, sf), "ent_2").withColumn("risk", F.round("risk", 4))


@query(
    "dashboard",
    f"""{_CAMP} SELECT 'n_detections' AS metric, count(*) AS n FROM sc UNION ALL SELECT 'n_anomalies', count(*) FROM sc WHERE is_anomaly
      UNION ALL SELECT 'n_campaigns', count(*) FROM (SELECT DISTINCT entity_id, campaign_no FROM cp) UNION ALL SELECT 'n_feedback', count(*) FROM sc WHERE value > 100
      UNION ALL SELECT 'type:' || anomaly_type, count(*) FROM sc WHERE is_anomaly GROUP BY anomaly_type""",
)
def dashboard(spark, sf):
    return H.dashboard(_detections(spark, sf), K.rollup(K.link(_anomalies(spark, sf))), _feedback(spark, sf))


@query("latest_campaigns", f"{_CAMP} SELECT entity_id, campaign_no, max(ts_us) AS last_us FROM cp GROUP BY 1, 2 ORDER BY last_us DESC, entity_id LIMIT 20")
def latest_campaigns(spark, sf):
    return H.latest(K.rollup(K.link(_anomalies(spark, sf))), "last_us", "entity_id", limit=20).select("entity_id", "campaign_no", "last_us")


@query("latest_feedback", f"{SC} SELECT event_id AS feedback_id, ts_us FROM sc WHERE value > 100 ORDER BY ts_us DESC, event_id LIMIT 100")
def latest_feedback(spark, sf):
    return H.latest(_feedback(spark, sf), "ts_us", "feedback_id", limit=100).select("feedback_id", "ts_us")


@query("latest_drift_states", f"{_DRIFT} SELECT entity_id, arg_max(samples, samples) AS samples, {r4('arg_max(psi, samples)')} AS psi FROM psi GROUP BY 1")
def latest_drift_states(spark, sf):
    return _rounded(D.latest_states(D.static_drift(_signal(spark, sf))).select("entity_id", "samples", "psi"), "psi")


@query("latest_metrics_run", f"{SC} SELECT split, count(*) AS n, {r4('avg(y)')} AS prevalence FROM sc WHERE split = (SELECT split FROM sc ORDER BY ts_us DESC LIMIT 1) GROUP BY 1")
def latest_metrics_run(spark, sf):
    runs = scored(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("prevalence"), F.max("ts_us").alias("created_us"))
    last = runs.agg(F.max_by(F.struct("split", "n", "prevalence"), "created_us").alias("r")).select("r.*")
    return _rounded(last, "prevalence")
