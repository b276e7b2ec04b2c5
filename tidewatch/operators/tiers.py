"""Scoring tiers: linear bottleneck residual, next-action model, calibrated classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ANOMALY_CLASSES, DEFAULTS, Settings
from tidewatch.operators import corpus as C
from tidewatch.operators.features import NUMERIC
from tidewatch.operators.ranking import quantiles
from tidewatch.session import settle

SMOOTHING = 0.1


# --- scaling ------------------------------------------------------------------------------- #


def _moments(batches):
    """n, mean and sum of squares about it of every column of a task, NaN and nulls left out."""
    import pyarrow as pa

    n = mean = m2 = names = None
    for batch in batches:
        names = batch.schema.names
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        seen = ~np.isnan(x)
        k = seen.sum(axis=1)
        some = np.maximum(k, 1)
        with np.errstate(invalid="ignore"):
            m = np.where(seen, x, 0.0).sum(axis=1) / some
            q = np.where(seen, (x - m[:, None]) ** 2, 0.0).sum(axis=1)
            if n is None:
                n, mean, m2 = k, m, q
            else:
                total = np.maximum(n + k, 1)
                m2 = m2 + q + np.where((n > 0) & (k > 0), (m - mean) ** 2 * n * k / total, 0.0)
                mean = np.where(k == 0, mean, np.where(n == 0, m, mean + (m - mean) * k / total))
                n = n + k
    if n is not None:
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)], names=["name", "n", "mean", "m2"])


def fit_scaler(features: DataFrame, names=NUMERIC) -> dict[str, tuple[float, float]]:
    """name -> (mean, population std), NaN ignored, flat columns get 1. A task sends one row a column."""
    parts = features.selectExpr(*[f"cast({n} AS double) AS {n}" for n in names]).mapInArrow(_moments, "name string, n long, mean double, m2 double").filter("n > 0")
    merged = parts.selectExpr("*", "sum(n * mean) OVER (PARTITION BY name) / sum(n) OVER (PARTITION BY name) AS m")
    rows = merged.groupBy("name").agg(F.first("m").alias("m"), F.expr("sqrt(sum(m2 + if(mean = m, 0D, n * pow(mean - m, 2))) / sum(n))").alias("s"))
    found = {r["name"]: (r["m"], r["s"]) for r in rows.collect()}
    out = {}
    for n in names:
        m, s = found.get(n, (None, None))
        out[n] = (m or 0.0, s if s is not None and s >= 1e-6 else 1.0)
    return out


def scale_sql(name: str, mean: float, std: float) -> str:
    finite = f"if({name} is null or isnan({name}) or abs({name}) = double('Infinity'), 0D, {name})"
    return f"least(12D, greatest(-12D, ({finite} - {mean!r}D) / {std!r}D))"


def unscale_sql(name: str, mean: float, std: float) -> str:
    """The value that scale_sql() scaled; what lay beyond the clip comes back at it."""
    return f"({name} * {std!r}D + {mean!r}D)"


def scaled_array(scaler: dict) -> str:
    return "array(" + ", ".join(scale_sql(n, m, s) for n, (m, s) in scaler.items()) + ")"


# --- score normalisation ------------------------------------------------------------------- #


@dataclass(frozen=True)
class Normaliser:
    center: float
    scale: float

    def sql(self, x: str) -> str:
        z = f"least(12D, greatest(-12D, ({x} - {self.center!r}D) / {self.scale!r}D))"
        return f"1D / (1D + exp(-({z})))"


def holdout(id: str = "event_id", percent: int = 15) -> str:
    """Deterministic split by the id's hash, the same on every run and executor."""
    return f"pmod(xxhash64({id}), 100) < {percent}"


def fit_normaliser(scores: DataFrame, column: str, quantile: float = 0.95) -> Normaliser:
    scores = settle(scores.select(column))  # read by several passes below
    center, median = quantiles(scores, column, [quantile, 0.5])
    if center is None:
        return Normaliser(0.0, 1.0)
    dev = scores.selectExpr(f"abs({column} - {median!r}D) AS d")
    scale = 1.4826 * quantiles(dev, "d", [0.5])[0]
    if scale < 1e-9:
        scale = scores.agg(F.stddev_pop(column)).first()[0] or 0.0
    return Normaliser(center, scale if scale >= 1e-9 else 1.0)


# --- tier 1: what a 16-dimensional linear bottleneck cannot reproduce ------------------------ #


@dataclass(frozen=True)
class Bottleneck:
    scaler: dict
    components: list  # features x k
    normaliser: Normaliser


def feature_errors(rows: DataFrame, scaler: dict, components) -> DataFrame:
    """Adds ``z`` (scaled row), ``errors`` (squared residual per feature) and ``error`` (their mean)."""
    from pyspark.sql.functions import pandas_udf

    keep = np.eye(len(scaler)) - np.asarray(components) @ np.asarray(components).T

    @pandas_udf("array<double>")
    def residual(z: pd.Series) -> pd.Series:
        x = np.vstack(z.to_numpy()) if len(z) else np.zeros((0, len(keep)))
        return pd.Series(list((x @ keep) ** 2))

    out = rows.withColumn("z", F.expr(scaled_array(scaler))).withColumn("errors", residual("z"))
    return out.withColumn("error", F.expr(f"aggregate(errors, 0D, (a, x) -> a + x) / {float(len(scaler))}D"))


def fit_bottleneck(features: DataFrame, scaler: dict, k: int = 16) -> Bottleneck:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    fit = features.filter(f"not ({holdout()})").select(array_to_vector(F.expr(scaled_array(scaler))).alias("v"))  # scaled by each pass: as a table it is larger than the features
    held = features.filter(holdout())
    model = PCA(k=min(k, len(scaler)), inputCol="v", outputCol="p").fit(fit)
    components = model.pc.toArray().tolist()
    return Bottleneck(scaler, components, fit_normaliser(feature_errors(held, scaler, components), "error"))


def score_bottleneck(rows: DataFrame, m: Bottleneck) -> DataFrame:
    return feature_errors(rows, m.scaler, m.components).withColumn("baseline", F.expr(m.normaliser.sql("error")))


def worst_features(k: int = 5, names=NUMERIC) -> str:
    """SQL: the k features that reproduce worst, as (name, error) structs."""
    listed = ", ".join(f"'{n}'" for n in names)
    items = f"transform(zip_with(array({listed}), errors, (n, e) -> named_struct('e', e, 'n', n)), x -> x)"
    return f"transform(slice(reverse(array_sort({items})), 1, {k}), x -> named_struct('feature', x.n, 'error', x.e))"


# --- tier 2: smoothed first-order next-action model ------------------------------------------ #


def steps(events: DataFrame, vocab: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(event_id, pos, ctx, nxt): the transitions of each encoded sequence, padding left out."""
    ids = C.encode_sequences(events.select("event_id", "command_sequence"), vocab, s)
    pairs = (
        "transform(filter(sequence(0, size(sequence_ids) - 2), i -> sequence_ids[i] <> 0), "
        "i -> named_struct('pos', i + 1, 'ctx', sequence_ids[i], 'nxt', sequence_ids[i + 1]))"
    )
    return ids.selectExpr("event_id", f"explode({pairs}) AS p").select("event_id", "p.*")


def fit_transitions(step_rows: DataFrame) -> DataFrame:
    """(ctx, nxt, n, ctx_n): counts only, so it merges and combines map-side."""
    pairs = step_rows.groupBy("ctx", "nxt").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("ctx_n", F.expr("sum(n) OVER (PARTITION BY ctx)"))


def step_surprise(step_rows: DataFrame, transitions: DataFrame, vocab_size: int) -> DataFrame:
    """Adds ``nll`` per step: -ln((n + a) / (ctx_n + a V))."""
    pair = step_rows.join(transitions.select("ctx", "nxt", "n"), ["ctx", "nxt"], "left")
    ctx = transitions.select("ctx", "ctx_n").distinct()
    full = pair.join(ctx, "ctx", "left")
    a = SMOOTHING
    return full.withColumn("nll", F.expr(f"-ln((coalesce(n, 0) + {a}D) / (coalesce(ctx_n, 0) + {a * vocab_size!r}D))"))


def sequence_scores(surprise: DataFrame) -> DataFrame:
    return surprise.groupBy("event_id").agg(F.avg("nll").alias("nll"), F.count(F.lit(1)).alias("steps"))


def step_attribution(surprise: DataFrame) -> DataFrame:
    """Each step's share of its sequence's surprise."""
    return surprise.withColumn("weight", F.expr("if(sum(nll) OVER (PARTITION BY event_id) > 0, nll / sum(nll) OVER (PARTITION BY event_id), 0D)"))


# --- tier 3: classifier ----------------------------------------------------------------------- #


def class_weights(labels: DataFrame, mode: str = "none") -> DataFrame:
    """(label, n, weight) for every class."""
    from tidewatch.sources.tables import class_table

    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = labels.count()
    balanced = f"if(coalesce(n, 0) = 0, 1D, {float(total)}D / ({len(ANOMALY_CLASSES)} * n))"
    weight = {"none": "1D", "balanced": balanced, "sqrt": f"sqrt({balanced})"}[mode]
    full = class_table(labels.sparkSession).join(counts, "label", "left")
    return full.selectExpr("label", "coalesce(n, 0L) AS n", f"{weight} AS weight")


def fit_isotonic(rows: DataFrame, score: str, target: str) -> tuple:
    """Monotone calibration knots; the identity when the target never varies."""
    from pyspark.ml.regression import IsotonicRegression

    merged = rows.groupBy(F.col(score).alias("s")).agg(F.avg(target).alias("t"), F.count(F.lit(1)).cast("double").alias("w"))
    lo, hi = merged.agg(F.min("t"), F.max("t")).first()
    if lo is None or (lo == hi and lo in (0.0, 1.0)):
        return ((0.0, 0.0), (1.0, 1.0))
    m = IsotonicRegression(featuresCol="s", labelCol="t", weightCol="w", predictionCol="p").fit(merged)
    knots = tuple((float(x), float(min(1.0, max(0.0, y)))) for x, y in zip(m.boundaries, m.predictions))
    return knots if len(knots) >= 2 else ((0.0, knots[0][1]), (1.0, knots[0][1]))


@dataclass(frozen=True)
class Classifier:
    model: object
    classes: list
    knots: dict
    inputs: list


def assemble(rows: DataFrame, scaler: dict, codes: DataFrame) -> DataFrame:
    """Adds ``row``: 59 scaled features, 7 category codes and the two tier scores (68 values)."""
    from pyspark.ml.functions import array_to_vector

    cats = [c for c in rows.columns if c.startswith("c_")]
    plain = rows.withColumnsRenamed({c: c[2:] for c in cats if c != "c_entity_type"}).withColumn("cohort", F.col("cohort"))
    fields = ["entity_type", "auth_method", "geo_country", "device_protocol", "device_os", "resource_accessed", "cohort"]
    coded = C.encode_categories(plain, codes, fields)
    extra = ", ".join([f"cast({f}_code AS double)" for f in fields] + ["baseline", "sequence"])
    out = coded.withColumn("row_array", F.expr(f"concat({scaled_array(scaler)}, array({extra}))"))
    return out.withColumn("row", array_to_vector("row_array"))


def fit_classifier(rows: DataFrame, s: Settings = DEFAULTS, trees: int = 30, weighting: str = "none") -> Classifier:
    """Multiclass forest on 85 % of the rows, per-class calibration on the rest. ``rows``: row, label.
    ``weighting`` is a mode of class_weights(); the weights go to the forest's training rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    idx = F.expr("CASE label " + " ".join(f"WHEN '{c}' THEN {i}D" for i, c in enumerate(ANOMALY_CLASSES)) + " END")
    data = rows.withColumn("y", idx)
    forest = RandomForestClassifier(featuresCol="row", labelCol="y", numTrees=trees, maxDepth=8, seed=s.seed)
    if weighting != "none":
        data = data.join(F.broadcast(class_weights(rows, weighting).select("label", "weight")), "label")  # one row per class
        forest = forest.setWeightCol("weight")
    model = forest.fit(data.filter(f"not ({holdout()})"))
    held = model.transform(data.filter(holdout())).withColumn("p", vector_to_array("probability")).select("p", "y")
    held = settle(held)
    knots = {}
    for i, c in enumerate(ANOMALY_CLASSES[: model.numClasses]):
        one = held.select(F.expr(f"p[{i}]").alias("s"), F.expr(f"if(y = {i}, 1D, 0D)").alias("t"))
        knots[c] = fit_isotonic(one, "s", "t")
    return Classifier(model, list(ANOMALY_CLASSES), knots, [])


def calibrate(rows: DataFrame, knots: dict, raw: str = "p") -> DataFrame:
    """Adds ``probs`` (calibrated, renormalised map) and ``base_type`` from raw per-class scores."""
    from tidewatch.operators.risk import interpolate_sql

    vals = [interpolate_sql(f"{raw}[{i}]", knots[c]) if c in knots else "0D" for i, c in enumerate(ANOMALY_CLASSES)]
    out = rows.withColumn("_cal", F.expr(f"array({', '.join(vals)})"))
    out = out.withColumn("_sum", F.expr("aggregate(_cal, 0D, (a, x) -> a + x)"))
    names = ", ".join(f"'{c}'" for c in ANOMALY_CLASSES)
    out = out.withColumn("_cal", F.expr("transform(_cal, x -> x / if(_sum <= 0, 1D, _sum))"))
    return out.selectExpr(
        "*", f"map_from_arrays(array({names}), _cal) AS probs",
        f"element_at(array({names}), cast(array_position(_cal, array_max(_cal)) AS int)) AS base_type",
    ).drop("_cal", "_sum")


def classify(rows: DataFrame, c: Classifier) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = c.model.transform(rows).withColumn("p", vector_to_array("probability"))
    return calibrate(out.drop("rawPrediction", "probability", "prediction"), c.knots).withColumn(
        "classifier", F.expr("greatest(0D, least(1D, 1D - probs['normal']))")
    )
