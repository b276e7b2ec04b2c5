"""Evaluation of a scored table: budgeted recall, curves, per-class metrics, calibration.

A scored table has ``event_id``, ``risk`` (0-100), ``label``, ``predicted``; an anomaly is any
label but 'normal'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ANOMALY_CLASSES
from tidewatch.operators.ranking import ranked
from tidewatch.sources.tables import class_table

POSITIVE = "if(label <> 'normal', 1, 0)"


def budget_size(n: int, budget: float) -> int:
    return max(1, round(n * budget))  # half to even


def _totals(scored: DataFrame) -> tuple[int, int]:
    row = scored.agg(F.count(F.lit(1)), F.expr(f"coalesce(sum({POSITIVE}), 0)")).first()
    return row[0], row[1]


def recall_at_budget(scored: DataFrame, budgets: list[float]) -> DataFrame:
    """One row per budget: its size, hits and recall (null without positives). Ties go by event id."""
    n, positives = _totals(scored)
    sizes = [(float(b), budget_size(n, b)) for b in budgets]
    top = ranked(scored.select("event_id", "risk", F.expr(POSITIVE).alias("_pos")), "risk", "event_id").filter(F.col("rank") <= max(k for _, k in sizes))
    picks = [F.expr(f"coalesce(sum(if(rank <= {k}, _pos, 0)), 0)").alias(f"h{i}") for i, (_, k) in enumerate(sizes)]
    rows = ", ".join(f"{b}D, cast({k} as bigint), h{i}" for i, (b, k) in enumerate(sizes))
    out = top.agg(*picks).selectExpr(f"stack({len(sizes)}, {rows}) AS (budget, k, hits)")
    return out.withColumn("recall", F.expr(f"if({positives} > 0, hits / {max(1, positives)}, null)"))


def precision_curve(scored: DataFrame, points: int = 200) -> DataFrame:
    """Precision of the top k at ``points`` evenly spaced k."""
    n, _ = _totals(scored)
    if n <= points:
        ks = list(range(1, n + 1))
    else:
        ks = sorted({int(i * (n - 1) / (points - 1)) + 1 for i in range(points)})
    r = ranked(scored.select("event_id", "risk", F.expr(POSITIVE).alias("_pos")), "risk", "event_id", {"hits": "_pos"})
    return r.filter(F.col("rank").isin(ks)).selectExpr("rank AS k", "hits", "hits / rank AS precision")


def class_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion(scored: DataFrame) -> DataFrame:
    """All class pairs (zero-filled), 81 rows; built from at most 81 counts."""
    names = F.array(*[F.lit(c) for c in ANOMALY_CLASSES])
    grid = class_table(scored.sparkSession).select("label", F.explode(names).alias("predicted"))
    return grid.join(class_counts(scored), ["label", "predicted"], "left").select(
        "label", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def per_class(scored: DataFrame) -> DataFrame:
    c = class_counts(scored).selectExpr(
        "explode(array(named_struct('c', label, 's', n, 'p', 0L, 't', if(label = predicted, n, 0L)), "
        "named_struct('c', predicted, 's', 0L, 'p', n, 't', 0L))) AS x"
    ).groupBy(F.col("x.c").alias("label")).agg(
        F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted_n"), F.sum("x.t").alias("hits")
    )
    full = class_table(scored.sparkSession).select("label").join(c, "label", "left").na.fill(0)
    return full.selectExpr(
        "label", "support",
        "if(predicted_n > 0, hits / predicted_n, 0D) AS precision",
        "if(support > 0, hits / support, 0D) AS recall",
        "if(predicted_n + support > 0, 2 * hits / (predicted_n + support), 0D) AS f1",
    )


def macro_f1(scored: DataFrame) -> DataFrame:
    return per_class(scored).agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"),
        F.count(F.when(F.col("support") == 0, 1)).alias("n_missing"),
    )


def missing_classes(scored: DataFrame) -> DataFrame:
    return class_table(scored.sparkSession).select("label").join(scored.select("label").distinct(), "label", "left_anti")


def ranking_quality(scored: DataFrame) -> DataFrame:
    """Average precision, its uplift over prevalence, and ROC-AUC; equal scores count as one group."""
    groups = scored.groupBy("risk").agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum({POSITIVE})").alias("pos"))
    n, positives = _totals(scored)
    groups = groups.withColumn("one", F.lit(0))
    g = ranked(groups, "risk", "one", {"upto_n": "n", "upto_pos": "pos"})
    negatives = n - positives
    ok = 0 < positives < n
    p, q = max(1, positives), max(1, negatives)
    out = g.agg(
        F.expr(f"sum(pos / {p}D * upto_pos / upto_n)").alias("average_precision"),
        F.expr(f"sum(pos * ({negatives} - (upto_n - upto_pos) + 0.5D * (n - pos))) / ({p}D * {q}D)").alias("roc_auc"),
    )
    if not ok:
        out = out.selectExpr("cast(null AS double) AS average_precision", "cast(null AS double) AS roc_auc")
    return out.selectExpr("average_precision", f"average_precision / {positives / n if n else 0.0}D AS uplift", "roc_auc")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    b = scored.selectExpr(f"least(cast(floor(risk / 100 * {bins}) AS int), {bins - 1}) AS bin", "risk / 100 AS p", f"{POSITIVE} AS y")
    per = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))
    return per.agg(F.expr("sum(n * abs(confidence - accuracy)) / sum(n)").alias("ece"))


def rule_precision(scored: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rules``: rule name (equal to its class) -> boolean SQL over the scored table."""
    pairs = ", ".join(f"named_struct('rule', '{r}', 'fired', {x})" for r, x in rules.items())
    long = scored.selectExpr("label", f"explode(array({pairs})) AS r").selectExpr("label", "r.rule AS rule", "r.fired AS fired")
    return long.groupBy("rule").agg(
        F.expr("count_if(fired)").alias("n_fired"),
        F.expr("avg(if(fired, if(label <> 'normal', 1D, 0D), null))").alias("anomaly_precision"),
        F.expr("avg(if(fired, if(label = rule, 1D, 0D), null))").alias("type_precision"),
        F.expr("count_if(fired and label = rule) / count_if(label = rule)").alias("recall"),
    )


def recall_by_class(scored: DataFrame, budget: float) -> DataFrame:
    n, _ = _totals(scored)
    k = budget_size(n, budget)
    r = ranked(scored.select("event_id", "risk", "label"), "risk", "event_id")
    return r.filter("label <> 'normal'").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count_if(rank <= {k})").alias("hits"),
        F.expr(f"avg(if(rank <= {k}, 1D, 0D))").alias("recall"),
    )


def verdicts(metrics: DataFrame, targets: dict[str, tuple[float, bool]]) -> DataFrame:
    """metric name -> (target, higher is better); one row per metric."""
    rows = ", ".join(
        f"'{m}', cast({m} AS double), {t}D, if({m} {'>=' if up else '<='} {t}, 'PASS', 'FAIL')" for m, (t, up) in targets.items()
    )
    return metrics.selectExpr(f"stack({len(targets)}, {rows}) AS (metric, value, target, verdict)").withColumn(
        "verdict", F.coalesce("verdict", F.lit("n/a"))
    )
