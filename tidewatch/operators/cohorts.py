"""Peer groups: behaviour summaries, k-means cohorts, assignment of new entities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, ENTITY_TYPES, Settings
from tidewatch.functions import scalar as S
from tidewatch.operators import profiles as P
from tidewatch.operators.ordering import Ordered, running

#: Entities of a task that fits cohorts.
FIT_ROWS = 50_000
#: The distributions a summary looks at.
DIMS = ("hour", "dow", "country", "resource", "auth_method")
AUTH_ORDER = ("password", "token", "certificate", "mfa", "biometric")
SUMMARY = (
    [f"hour_{h:02d}" for h in range(24)]
    + ["weekend_share"]
    + [f"type_{t}" for t in ENTITY_TYPES]
    + [
        "log_bytes_out_mean", "log_bytes_out_std", "log_duration_mean", "log_interval_mean", "sequence_len_mean",
        "auth_failure_rate", "distinct_countries", "distinct_resources", "geo_spread_scaled",
    ]
    + [f"auth_{a}_share" for a in AUTH_ORDER]
)


def stat_mean(n: Column, s: Column) -> Column:
    return F.when(n > 0, s / n).otherwise(F.lit(0.0))


def stat_std(n: Column, s: Column, q: Column) -> Column:
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), q / n - F.pow(s / n, 2)))).otherwise(F.lit(0.0))


def summary_columns(profile=F.col) -> dict[str, Column]:
    """The 42 summary dimensions over a profile row."""
    zero = F.lit(0.0)

    def share(dim, value):
        return F.coalesce(profile(f"d_{dim}")[value], zero)

    def distinct(dim):
        return F.log1p(F.coalesce(F.size(profile(f"d_{dim}")), F.lit(0)).cast("double"))

    out = {f"hour_{h:02d}": share("hour", str(h)) for h in range(24)}
    out["weekend_share"] = share("dow", "5") + share("dow", "6")
    for t in ENTITY_TYPES:
        out[f"type_{t}"] = S.flag(profile("entity_type") == t)
    g = profile
    out["log_bytes_out_mean"] = stat_mean(g("bytes_out_n"), g("bytes_out_s"))
    out["log_bytes_out_std"] = stat_std(g("bytes_out_n"), g("bytes_out_s"), g("bytes_out_q"))
    out["log_duration_mean"] = stat_mean(g("duration_n"), g("duration_s"))
    out["log_interval_mean"] = stat_mean(g("interval_n"), g("interval_s"))
    out["sequence_len_mean"] = stat_mean(g("seq_len_n"), g("seq_len_s"))
    out["auth_failure_rate"] = F.coalesce(g("failure_rate"), zero)
    out["distinct_countries"] = distinct("country")
    out["distinct_resources"] = distinct("resource")
    out["geo_spread_scaled"] = F.log1p(F.greatest(F.coalesce(g("spread_km"), zero), zero)) / 10.0
    for a in AUTH_ORDER:
        out[f"auth_{a}_share"] = share("auth_method", a)
    return {n: F.nanvl(c.cast("double"), zero) for n, c in out.items()}


def behaviour_summary(profiles: DataFrame) -> DataFrame:
    keep = ["entity_id", "entity_type", "event_count"]
    return profiles.select(*keep, *[c.alias(n) for n, c in summary_columns().items()])


@dataclass(frozen=True)
class CohortModel:
    """k x 42 numbers, so it lives on the driver and travels as literals."""

    centroids: list
    means: list
    stds: list
    type_default: dict
    sizes: dict

    @property
    def largest(self):
        return max(self.sizes, key=lambda c: (self.sizes[c], -c)) if self.sizes else None

    def nearest(self, columns: list[Column]) -> Column:
        """Index of the nearest centroid, ties to the lower index."""
        return self.nearest_scaled(self.scaled(columns))

    def scaled(self, columns: list[Column]) -> list[Column]:
        return [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, self.means, self.stds)]

    def nearest_scaled(self, z: list[Column]) -> Column:
        scored = []
        for i, centre in enumerate(self.centroids):
            d = sum((((zi - F.lit(float(x))) * (zi - F.lit(float(x)))) for zi, x in zip(z, centre)), F.lit(0.0))
            scored.append(F.struct(F.sqrt(d).alias("d"), F.lit(i).alias("i")))
        return F.array_min(F.array(*scored))["i"]

    def default_sql(self, entity_type: str) -> str:
        arms = " ".join(f"WHEN '{t}' THEN {c}" for t, c in sorted(self.type_default.items()))
        rest = "null" if self.largest is None else str(self.largest)
        return f"CASE {entity_type} {arms} ELSE {rest} END" if arms else rest

    def describe(self, cohort: int) -> str:
        raw = dict(zip(SUMMARY, [c * s + m for c, s, m in zip(self.centroids[cohort], self.stds, self.means)]))
        hours = [raw[f"hour_{h:02d}"] for h in range(24)]
        peak = hours.index(max(hours))
        night = sum(hours[:6]) + hours[22] + hours[23]
        kind = max(ENTITY_TYPES, key=lambda t: raw[f"type_{t}"])
        when = "around the clock" if night > 0.28 else f"peaking at {peak:02d}:00"
        days = "including weekends" if raw["weekend_share"] > 0.22 else "on weekdays"
        return f"{kind}s active {when}, {days}"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(x) for x in c], int(self.sizes.get(i, 0)), self.describe(i)) for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "cohort int, centroid array<double>, size bigint, description string")


def fit_cohorts(profiles: DataFrame, settings: Settings = DEFAULTS) -> CohortModel:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    summary = behaviour_summary(profiles)
    usable = summary.filter(F.col("event_count") >= settings.cohort_min_events)
    n = usable.count()
    if n < 2:
        usable, n = summary, summary.count()
    if n == 0:
        return CohortModel([], [], [], {}, {})
    moments = usable.agg(
        *[F.avg(c).alias(f"m_{c}") for c in SUMMARY], *[F.stddev_pop(c).alias(f"s_{c}") for c in SUMMARY]
    ).first()
    means = [moments[f"m_{c}"] for c in SUMMARY]
    stds = [moments[f"s_{c}"] if moments[f"s_{c}"] and moments[f"s_{c}"] >= 1e-6 else 1.0 for c in SUMMARY]
    if n < 2:  # one entity is its own cohort, at the scaled origin
        return with_sizes(CohortModel([[0.0] * len(SUMMARY)], means, stds, {}, {}), usable)
    scaled = usable.select(
        "entity_id", "entity_type", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(SUMMARY, means, stds)]
    )
    # The first centres are drawn by place in the table, so rows get places that only their ids decide.
    scaled = scaled.repartition(-(-n // FIT_ROWS), "entity_id").sortWithinPartitions("entity_id")
    vectors = VectorAssembler(inputCols=list(SUMMARY), outputCol="features").transform(scaled)
    model = KMeans(k=int(min(settings.cohort_count, n)), seed=settings.seed, initSteps=3).fit(vectors)
    centroids = [[float(x) for x in c] for c in model.clusterCenters()]
    half = CohortModel(centroids, means, stds, {}, {})
    return with_sizes(half, usable)


def assign(summary: DataFrame, model: CohortModel) -> DataFrame:
    return summary.withColumn("cohort", model.nearest([F.col(c) for c in SUMMARY]))


def with_sizes(model: CohortModel, usable: DataFrame) -> CohortModel:
    """Cohort sizes and, per entity type, its most populous cohort (ties to the lower id)."""
    per = assign(usable, model).groupBy("entity_type", "cohort").count().collect()  # <= types x cohorts rows
    sizes, default = {}, {}
    for t, c, k in sorted(per, key=lambda r: (str(r[0]), -r[2], r[1])):
        sizes[c] = sizes.get(c, 0) + k
        default.setdefault(t, c)
    return CohortModel(model.centroids, model.means, model.stds, default, sizes)


def snapshot_spread(o: Ordered) -> DataFrame:
    """(entity, hb, spread): spread of the first min(250, seen) points as of each early block.

    An entity contributes at most 250 points, so its point list is bounded; after block ``last``
    the value no longer changes.
    """
    s = o.settings
    last = math.ceil((s.geo_points - 1) / s.refresh_every)
    pts = (
        o.rows().filter(F.col("rn") <= s.geo_points)
        .groupBy(o.key)
        .agg(F.array_sort(F.collect_list(F.struct("rn", F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon")))).alias("pts"))
    )
    hb = F.explode(F.sequence(F.lit(0), F.least(F.lit(last), F.ceil((F.size("pts") - 1) / s.refresh_every).cast("int"))))
    per = pts.select(o.key, "pts", hb.alias("hb"))
    per = per.withColumn("pts", F.slice("pts", 1, F.least(F.lit(s.geo_points), 1 + s.refresh_every * F.col("hb"))))

    def total(f):
        return F.aggregate("pts", F.lit(0.0), lambda a, p: a + f(F.radians(p["lat"]), F.radians(p["lon"])))

    n = F.size("pts")
    lat, lon = P.centroid(
        total(lambda a, b: F.cos(a) * F.cos(b)), total(lambda a, b: F.cos(a) * F.sin(b)), total(lambda a, b: F.sin(a)),
        n, F.col("pts")[0]["lat"], F.col("pts")[0]["lon"],
    )
    per = per.withColumn("_lat", lat).withColumn("_lon", lon)
    far = F.array_max(F.transform("pts", lambda p: S.haversine_km(F.col("_lat"), F.col("_lon"), p["lat"], p["lon"])))
    return per.select(o.key, F.col("hb").cast("bigint").alias("hb"), far.alias("spread_km"))


def live_cohorts(o: Ordered, model: CohortModel, told: Ordered | None = None) -> Ordered:
    """Adds ``live_cohort``: the cohort of the entity's live snapshot, or its type's default while
    the snapshot has fewer than three events. Expects ``first_rn_country`` / ``first_rn_resource``
    and ``snap_n``. All rows of a block share a snapshot, so it is summed and judged once a block,
    over the same rows in ``told`` where that carries less than ``o``."""
    s = o.settings
    last = math.ceil((s.geo_points - 1) / s.refresh_every)
    sums = {**snapshot_sums(), "snap_fail": "if(auth_success, 0D, 1D)"}
    told = told or o
    blocks = told.rows().groupBy(*o.part, "blk", "entity_type").agg(
        F.max("snap_n").alias("snap_n"), *[F.expr(f"sum({x}) AS _in{n}") for n, x in sums.items()]
    ).withColumn("halo", F.lit(False))
    f = running(told.with_frame(blocks), {n: f"_in{n}" for n in sums}, "block").frame
    f = f.withColumn("hb", F.least(F.lit(last).cast("bigint"), F.col("blk")))
    spread = snapshot_spread(told)
    if o.sliced:
        spread = told.rows().select(o.key, "slice").distinct().join(spread, o.key)
    f = f.join(spread, [*o.part, "hb"], "left")
    judged = with_live_cohort(f, model, s).selectExpr(*[f"{c} AS _of_{c}" for c in (*o.part, "blk", "entity_type")], "live_cohort")
    same = [F.col(c) == F.col(f"_of_{c}") for c in (*o.part, "blk")] + [F.col("entity_type").eqNullSafe(F.col("_of_entity_type"))]
    out = o.frame.join(judged, same, "left")
    return o.with_frame(out.drop(*[c for c in out.columns if c.startswith("_of_")]))


def snapshot_sums() -> dict[str, str]:
    """The sums over a snapshot's rows that its cohort is found by."""
    sums = {f"_h{h}": f"if(hour(timestamp) = {h}, 1D, 0D)" for h in range(24)}
    sums["_we"] = "if(weekday(timestamp) >= 5, 1D, 0D)"
    sums["_dc"] = "if(first_rn_country = rn, 1D, 0D)"
    sums["_dr"] = "if(first_rn_resource = rn, 1D, 0D)"
    for a in AUTH_ORDER:
        sums[f"_a_{a}"] = f"if(auth_method = '{a}', 1D, 0D)"
    for n, x in P.stat_sums().items():
        sums[f"_{n}"] = x
    return sums


def with_live_cohort(f: DataFrame, model: CohortModel, s: Settings) -> DataFrame:
    """Adds ``live_cohort`` to rows with the snapshot's sums, ``snap_n``, ``snap_fail`` and ``spread_km``."""
    n, zero = F.when(F.col("snap_n") >= 3, F.col("snap_n")), F.lit(0.0)
    c = F.col
    parts = {f"hour_{h:02d}": c(f"_h{h}") / n for h in range(24)}
    parts["weekend_share"] = c("_we") / n
    for t in ENTITY_TYPES:
        parts[f"type_{t}"] = S.flag(c("entity_type") == t)
    parts["log_bytes_out_mean"] = stat_mean(c("_bytes_out_n"), c("_bytes_out_s"))
    parts["log_bytes_out_std"] = stat_std(c("_bytes_out_n"), c("_bytes_out_s"), c("_bytes_out_q"))
    parts["log_duration_mean"] = stat_mean(c("_duration_n"), c("_duration_s"))
    parts["log_interval_mean"] = stat_mean(c("_interval_n"), c("_interval_s"))
    parts["sequence_len_mean"] = stat_mean(c("_seq_len_n"), c("_seq_len_s"))
    parts["auth_failure_rate"] = c("snap_fail") / n
    parts["distinct_countries"] = F.log1p(F.least(c("_dc"), F.lit(float(s.top_values["country"]))))
    parts["distinct_resources"] = F.log1p(F.least(c("_dr"), F.lit(float(s.top_values["resource"]))))
    parts["geo_spread_scaled"] = F.log1p(F.coalesce(c("spread_km"), zero)) / 10.0
    for a in AUTH_ORDER:
        parts[f"auth_{a}_share"] = c(f"_a_{a}") / n
    scaled = {f"_z{i}": z for i, z in enumerate(model.scaled([parts[name] for name in SUMMARY]))}
    cohort = F.when(n >= 3, model.nearest_scaled([c(i) for i in scaled])).otherwise(F.expr(model.default_sql("entity_type")))
    return f.withColumns(scaled).withColumn("live_cohort", cohort).drop(*scaled)
