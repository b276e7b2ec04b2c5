"""Behaviour profiles: value counts, top-K distributions, live snapshots, persisted profiles, priors.

Counts live in long tables ``(entity, dim, value, n)`` because those merge exactly and combine
map-side. A finished profile is one row per entity with maps bounded by the top-K limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions import scalar as S
from tidewatch.operators.ordering import Ordered, order_events, over, previous

SINGLE_DIMS = (
    "hour", "dow", "country", "ip_prefix", "resource", "auth_method", "device_mac", "device_os", "protocol",
)
BAG_DIMS = ("token", "ngram")
DIMS = SINGLE_DIMS + BAG_DIMS
STATS = ("bytes_out", "bytes_in", "duration", "interval", "seq_len")


# What each single-valued dimension of an event is, in SQL.
SINGLE_SQL = {
    "hour": "cast(hour(timestamp) AS string)",
    "dow": "cast(weekday(timestamp) AS string)",
    "country": "geo_country",
    "ip_prefix": "if(size(split(source_ip, '[.]')) < 3, source_ip, substring_index(source_ip, '.', 3))",
    "resource": "resource_accessed",
    "auth_method": "auth_method",
    "device_mac": "device_mac",
    "device_os": "device_os",
    "protocol": "device_protocol",
}


def _bag_sql(dim: str, ngram_n: int) -> str:
    clean = "filter(coalesce(command_sequence, array()), t -> t is not null and t <> '')"
    if dim == "token":
        return clean
    if ngram_n <= 1:
        return clean
    grams = f"transform(sequence(1, size(c) - {ngram_n - 1}), i -> array_join(slice(c, i, {ngram_n}), '>'))"
    body = f"if(size(c) >= {ngram_n}, {grams}, cast(array() AS array<string>))"
    return f"transform(array({clean}), c -> {body})[0]"


def dim_values(ngram_n: int = 2, dims=DIMS) -> str:
    """SQL for the array of (dim, pos, value) of one event: single values, tokens and n-grams."""
    singles = ", ".join(
        f"named_struct('dim', '{d}', 'pos', 0, 'value', {SINGLE_SQL[d]})" for d in dims if d in SINGLE_SQL
    )
    parts = [f"array({singles})"] if singles else []
    for d in dims:
        if d in BAG_DIMS:
            parts.append(
                f"transform({_bag_sql(d, ngram_n)}, (v, i) -> named_struct('dim', '{d}', 'pos', cast(i AS int), 'value', v))"
            )
    return f"concat({', '.join(parts)})"


def exploded(df: DataFrame, keep: list[str], ngram_n: int = 2, dims=DIMS) -> DataFrame:
    long = df.selectExpr(*keep, f"explode({dim_values(ngram_n, dims)}) AS d")
    return long.selectExpr(*keep, "d.dim AS dim", "d.pos AS pos", "d.value AS value")


# The five numeric signals with running statistics; ``interval`` needs the ``prev`` column.
STAT_SQL = {
    "bytes_out": "log1p(greatest(0D, coalesce(bytes_out, 0D)))",
    "bytes_in": "log1p(greatest(0D, coalesce(bytes_in, 0D)))",
    "duration": "log1p(greatest(0D, coalesce(session_duration, 0D)))",
    "interval": "if(prev is null, null, log1p(greatest(0D, (ts_us - prev.ts_us) / 1e6D)))",
    "seq_len": "cast(size(coalesce(command_sequence, array())) AS double)",
}


def stat_sums() -> dict[str, str]:
    out = {}
    for name, v in STAT_SQL.items():
        out[f"{name}_n"] = f"if({v} is null, null, 1D)"
        out[f"{name}_s"] = v
        out[f"{name}_q"] = f"({v}) * ({v})"
    return out


UNIT_SQL = {
    "ux": "cos(radians(geo_lat)) * cos(radians(geo_lon))",
    "uy": "cos(radians(geo_lat)) * sin(radians(geo_lon))",
    "uz": "sin(radians(geo_lat))",
}


def centroid(x, y, z, n, first_lat, first_lon) -> tuple[Column, Column]:
    """Spherical centroid from summed unit vectors; the first point where they cancel out."""
    mx, my, mz = x / n, y / n, z / n
    hyp = F.sqrt(mx * mx + my * my)
    flat = (hyp < 1e-12) & (F.abs(mz) < 1e-12)
    lat = F.when(flat, first_lat).otherwise(F.degrees(F.atan2(mz, hyp)))
    lon = F.when(flat, first_lon).otherwise(F.degrees(F.atan2(my, mx)))
    return F.when(n > 0, lat), F.when(n > 0, lon)


# --------------------------------------------------------------------------- #
# Counts, top-K, distributions
# --------------------------------------------------------------------------- #


def value_counts(events: DataFrame, keys: list[str], settings: Settings = DEFAULTS, dims=DIMS) -> DataFrame:
    """(keys, dim, value, n). Partial sums happen before the shuffle, so a hot key costs one row per task."""
    long = exploded(events, keys, settings.ngram_n, dims)
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "dim", "value").agg(F.count(F.lit(1)).alias("n"))


def top_shares(counts: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Keep the top K by (-n, value) of each distribution that has a K, all values of the others, then normalise.

    Row numbers under a constant limit are cut inside each task before the shuffle, so a limited
    distribution with very many values does not gather in one place. The limit is looked up by finished
    counts: told by the dimension alone, each half would count the whole input for itself.
    """
    limit = F.lit(None).cast("int")
    for dim, k in settings.top_values.items():
        limit = F.when(F.col("dim") == dim, F.lit(k)).otherwise(limit)
    limit = F.when(F.col("n") >= 0, limit)
    kept = counts.filter(limit.isNull())
    if settings.top_values:
        w = Window.partitionBy(*keys, "dim").orderBy(F.desc("n"), "value")
        widest = max(settings.top_values.values())
        ranked = counts.filter(limit.isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= widest)
        kept = kept.unionByName(ranked.filter(F.col("rank") <= limit).drop("rank"))
    total = F.sum("n").over(Window.partitionBy(*keys, "dim"))
    return kept.withColumn("share", F.col("n") / total)


def share_maps(shares: DataFrame, keys: list[str], dims=DIMS) -> DataFrame:
    """One row per key with a bounded map per dimension (``d_country``, ``d_token``, ...)."""
    pairs = {d: F.collect_list(F.when(F.col("dim") == d, F.struct("value", "share"))).alias(f"d_{d}") for d in dims}
    lists = shares.groupBy(*keys).agg(*pairs.values())
    return lists.select(*keys, *[F.expr(f"if(size(d_{d}) > 0, map_from_entries(d_{d}), null) AS d_{d}") for d in dims])


# --------------------------------------------------------------------------- #
# Finished profiles and priors
# --------------------------------------------------------------------------- #


def numbered_events(events: DataFrame, settings: Settings) -> DataFrame:
    o = order_events(events, settings, halo=1)
    return previous(o, "ts_us").rows()


def _home(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    agg = points.groupBy(*keys).agg(
        *[F.expr(f"sum({x}) AS {n}") for n, x in UNIT_SQL.items()],
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(F.struct("geo_lat", "geo_lon"), order).alias("p0"),
        F.collect_set(F.struct("geo_lat", "geo_lon")).alias("points"),
    )
    lat, lon = centroid(F.col("ux"), F.col("uy"), F.col("uz"), F.col("n_points"), F.col("p0.geo_lat"), F.col("p0.geo_lon"))
    located = agg.withColumn("home_lat", lat).withColumn("home_lon", lon)
    far = F.array_max(
        F.transform(
            "points", lambda p: S.haversine_km(F.col("home_lat"), F.col("home_lon"), p["geo_lat"], p["geo_lon"])
        )
    )
    return located.select(*keys, "home_lat", "home_lon", F.coalesce(far, F.lit(0.0)).alias("spread_km"))


def profile_rows(
    numbered: DataFrame, keys: list[str], settings: Settings = DEFAULTS, geo_by_group: bool = False, dims=DIMS
) -> DataFrame:
    """Profiles for any grouping of events: per entity, per cohort, or overall; distributions of ``dims`` only."""
    base = numbered.groupBy(*keys).agg(
        *([] if "entity_type" in keys else [F.min("entity_type").alias("entity_type")]),
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.avg(F.when(F.col("auth_success"), 0.0).otherwise(1.0)).alias("failure_rate"),
        *[F.expr(f"coalesce(sum({x}), 0D) AS {n}") for n, x in stat_sums().items()],
    )
    if geo_by_group:
        # Groups take their members' first points, members in order of first appearance.
        first = numbered.filter(F.col("rn") <= settings.geo_points)
        seen = F.first(F.struct("ts_us", "event_id")).over(Window.partitionBy(*keys, "entity_id").orderBy("rn"))
        w = Window.partitionBy(*keys).orderBy("_seen", "rn")
        points = first.withColumn("_seen", seen).withColumn("_p", F.row_number().over(w))
        home = _home(points.filter(F.col("_p") <= settings.geo_points), keys, "_p")
    else:
        home = _home(numbered.filter(F.col("rn") <= settings.geo_points), keys, "rn")
    counts = value_counts(numbered, keys, settings, dims)
    maps = share_maps(top_shares(counts, keys, settings), keys, dims)
    return base.join(home, keys, "left").join(maps, keys, "left")


def entity_profiles(events: DataFrame, settings: Settings = DEFAULTS, dims=DIMS) -> DataFrame:
    return profile_rows(numbered_events(events, settings), ["entity_id"], settings, dims=dims)


def priors(events: DataFrame, assignments: DataFrame, settings: Settings = DEFAULTS, dims=DIMS) -> DataFrame:
    """One profile per cohort and a global one (cohort -1), from pooled counts, never averages."""
    numbered = numbered_events(events, settings)
    members = numbered.join(assignments.select("entity_id", "cohort"), "entity_id", "left")
    by_cohort = members.withColumn(
        "cohort", F.explode(F.array_distinct(F.array(F.coalesce("cohort", F.lit(-1)), F.lit(-1))))
    )
    return profile_rows(by_cohort, ["cohort"], settings, geo_by_group=True, dims=dims)


# --------------------------------------------------------------------------- #
# Live snapshots
# --------------------------------------------------------------------------- #


def value_columns(o: Ordered) -> Ordered:
    """Adds ``v_<dim>`` for the single-valued dimensions."""
    return o.with_frame(o.frame.selectExpr("*", *[f"{x} AS v_{d}" for d, x in SINGLE_SQL.items()]))


def snapshot_seen(o: Ordered, first_of: tuple[str, ...] = ("resource",)) -> Ordered:
    """Adds ``seen_<dim>``: how often the live snapshot has seen this event's value, and
    ``first_rn_<dim>``: the row number of the value's first occurrence for the entity.

    The frames add the value to the partition columns; rows are already clustered by entity (and
    slice), so each costs a sort inside the task and no exchange.
    """
    one = "if(halo, null, 1)" if o.sliced else "1"
    cols = [f"count({one}) {over(o, 'block', 'v_' + d)} AS seen_{d}" for d in SINGLE_DIMS]
    cols += [f"min(rn) OVER (PARTITION BY {', '.join([*o.part, 'v_' + d])}) AS first_rn_{d}" for d in first_of]
    frame = o.frame.selectExpr("*", *cols)
    if not o.sliced:
        return o.with_frame(frame)
    long = exploded(o.frame, [o.key, "slice", o.id], o.settings.ngram_n, SINGLE_DIMS)
    long = long.join(_earlier(o, SINGLE_DIMS), [o.key, "slice", "dim", "value"], "left")
    picks = [F.expr(f"max(if(dim = '{d}', earlier, null)) AS e_{d}") for d in SINGLE_DIMS]
    picks += [F.expr(f"max(if(dim = '{d}', earlier_rn, null)) AS r_{d}") for d in first_of]
    carry = long.groupBy(o.key, "slice", o.id).agg(*picks)
    frame = frame.join(carry, [o.key, "slice", o.id], "left")
    changed = {f"seen_{d}" for d in SINGLE_DIMS} | {f"first_rn_{d}" for d in first_of}
    plain = [c for c in frame.columns if c not in changed and c[:2] not in ("e_", "r_")]
    return o.with_frame(
        frame.selectExpr(
            *plain,
            *[f"seen_{d} + coalesce(e_{d}, 0) AS seen_{d}" for d in SINGLE_DIMS],
            *[f"least(first_rn_{d}, r_{d}) AS first_rn_{d}" for d in first_of],
        )
    )


def _earlier(o: Ordered, dims) -> DataFrame:
    """Per (entity, slice, dim, value) present in a slice: occurrences in the slices before it."""
    long = exploded(o.frame, [o.key, "slice", "halo", "rn"], o.settings.ngram_n, dims)
    per = long.groupBy(o.key, "slice", "dim", "value").agg(
        F.expr("count(if(halo, null, 1)) AS n"), F.min("rn").alias("rn0")
    )
    w = f"OVER (PARTITION BY {o.key}, dim, value ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return per.selectExpr(
        o.key, "slice", "dim", "value", f"coalesce(sum(n) {w}, 0) AS earlier", f"min(rn0) {w} AS earlier_rn"
    )


def bags(o: Ordered) -> DataFrame:
    """Long table of every event's tokens and n-grams."""
    return exploded(o.rows(), [*o.part, o.id, "blk"], o.settings.ngram_n, BAG_DIMS)


def snapshot_bags(o: Ordered) -> DataFrame:
    """The same with ``seen`` as of the event's snapshot."""
    long = bags(o).selectExpr("*", f"count(1) {over(o, 'block', 'dim', 'value')} AS seen")
    if not o.sliced:
        return long
    long = long.join(_earlier(o, BAG_DIMS), [o.key, "slice", "dim", "value"], "left")
    return long.withColumn("seen", F.expr("seen + coalesce(earlier, 0)")).drop("earlier", "earlier_rn")


_CUT_SCHEMA = (
    "{key} {key_type}, slice bigint, dim string, blk bigint, cut_n bigint, cut_value string, "
    "top_total bigint, top_values array<string>"
)


#: Columns that cut_maps() adds.
CUT_TYPES = {
    **{f"cut_{d}": "struct<cut_n:bigint,cut_value:string,top_total:bigint>" for d in ("country", "ip_prefix", "resource", "device_mac", "device_os", "token", "ngram")},
    "top_resources": "array<string>",
}


def crowded(events: DataFrame, dims, s: Settings = DEFAULTS) -> tuple[str, ...]:
    """Those of ``dims`` that hold more than K values in the whole table: in the others no snapshot has a cut."""
    limits = {d: k for d, k in s.top_values.items() if d in dims}
    values = exploded(events, [], s.ngram_n, tuple(d for d in DIMS if d in limits)).filter("value is not null").distinct()
    found = values.groupBy("dim").agg(F.count(F.lit(1)).alias("nv")).collect()  # a row a dimension
    held = {r["dim"]: r["nv"] for r in found}
    return tuple(d for d in dims if held.get(d, 0) > limits[d])


def snapshot_cuts(o: Ordered, dims=DIMS) -> DataFrame:
    """Where a snapshot's top-K cut falls, for distributions that have more than K values.

    A value is inside the snapshot of block ``blk`` when (-count, value) <= (-cut_n, cut_value).
    Only (entity, dim) pairs that ever exceed K values are looked at. Counts only grow, so a new
    top-K can contain only the old top-K and values that occurred since: each slice starts from
    the top-K at its beginning and needs nothing else of the past.
    """
    s, key = o.settings, o.key
    limits = {d: k for d, k in s.top_values.items() if d in dims}
    long = exploded(o.rows(), [key, "slice", "blk"], s.ngram_n, tuple(d for d in DIMS if d in limits))
    cells = long.filter("value is not null").groupBy(key, "slice", "dim", "blk", "value").agg(F.count(F.lit(1)).alias("n"))
    limit_sql = "CASE dim " + " ".join(f"WHEN '{d}' THEN {k}" for d, k in limits.items()) + " END"
    limit = F.expr(limit_sql)
    if o.sliced:
        wide = (
            cells.select(key, "dim", "value").distinct().groupBy(key, "dim").agg(F.count(F.lit(1)).alias("nv"))
            .filter(F.col("nv") > limit).select(key, "dim")
        )
        cells = cells.join(wide, [key, "dim"], "left_semi")
    else:
        new = f"if(row_number() OVER (PARTITION BY {key}, dim, value ORDER BY blk) = 1, 1, 0) AS new"
        cells = cells.selectExpr("*", new).selectExpr("*", f"sum(new) OVER (PARTITION BY {key}, dim) AS nv")
        cells = cells.filter(F.col("nv") > limit)
    before = F.lit(-2).cast("bigint")  # marks counts carried into a slice
    cells = cells.select(key, "slice", "dim", "blk", "value", "n")
    if o.sliced:
        per = cells.groupBy(key, "slice", "dim", "value").agg(F.sum("n").alias("n"))
        through = Window.partitionBy(key, "dim", "value").orderBy("slice")
        upto = per.withColumn("total", F.sum("n").over(through))
        own = upto.filter(F.col("total") > F.col("n")).select(
            key, "slice", "dim", before.alias("blk"), "value", (F.col("total") - F.col("n")).alias("n")
        )
        # Top-K (and the next one) of the values occurring in a slice, by their counts at its end.
        rank = Window.partitionBy(key, "dim", "slice").orderBy(F.desc("total"), "value")
        best = upto.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= limit + 1)
        best = best.select(key, "dim", "slice", "value", F.col("total").alias("n"))

        def carry(pdf):
            return _carry_tops(pdf, key, limits)

        kt = dict(cells.dtypes)[key]
        tops = best.groupBy(key, "dim").applyInPandas(
            carry, f"{key} {kt}, slice bigint, dim string, blk bigint, value string, n bigint"
        )
        cells = cells.unionByName(own).unionByName(tops)

    def cut(pdf):
        return _cut_blocks(pdf, key, limits)

    kt = dict(cells.dtypes)[key]
    return cells.groupBy(key, "slice", "dim").applyInPandas(cut, _CUT_SCHEMA.format(key=key, key_type=kt))


def _top(counts: dict, names, k: int) -> list:
    return sorted(names, key=lambda v: (-counts[v], v))[:k]


def _carry_tops(pdf, key, limits):
    """Top-K at the start of each slice, from the (K per slice) candidates of the slices before."""
    import pandas as pd

    k = limits[pdf["dim"].iloc[0]]
    counts, top, out = {}, [], []
    for sl, rows in pdf.sort_values("slice").groupby("slice"):
        out += [(pdf[key].iloc[0], sl, pdf["dim"].iloc[0], -2, v, counts[v]) for v in top]
        counts = {v: counts[v] for v in top}
        counts.update(zip(rows["value"], rows["n"]))
        top = _top(counts, list(counts), k + 1)
    return pd.DataFrame(out, columns=[key, "slice", "dim", "blk", "value", "n"])


def _cut_blocks(pdf, key, limits):
    """Walk the blocks of one slice, keeping the top-K; emit the cut each block is judged against."""
    import pandas as pd

    dim, k = pdf["dim"].iloc[0], limits[pdf["dim"].iloc[0]]
    start = pdf[pdf["blk"] == -2].drop_duplicates("value")
    counts = dict(zip(start["value"], start["n"]))
    top = _top(counts, counts, k + 1)
    out = []
    body = pdf[pdf["blk"] != -2].sort_values("blk")
    blks, values, ns = body["blk"].tolist(), body["value"].tolist(), body["n"].tolist()
    entity, at, i = pdf[key].iloc[0], pdf["slice"].iloc[0], 0
    while i < len(blks):
        if len(top) > k:
            inside = top[:k]
            total = int(sum(counts[v] for v in inside))
            names = sorted(inside) if dim == "resource" else None
            out.append((entity, at, dim, blks[i], counts[inside[-1]], inside[-1], total, names))
        start_of = i
        while i < len(blks) and blks[i] == blks[start_of]:
            counts[values[i]] = counts.get(values[i], 0) + ns[i]
            i += 1
        top = _top(counts, set(top) | set(values[start_of:i]), k + 1)
    cols = [key, "slice", "dim", "blk", "cut_n", "cut_value", "top_total", "top_values"]
    return pd.DataFrame(out, columns=cols)


def cut_maps(cuts: DataFrame, key: str) -> DataFrame:
    """One row per (entity, slice, blk): cut per dimension, as small struct columns."""
    picks = [
        F.first(F.when(F.col("dim") == d, F.struct("cut_n", "cut_value", "top_total")), ignorenulls=True).alias(f"cut_{d}")
        for d in ("country", "ip_prefix", "resource", "device_mac", "device_os", "token", "ngram")
    ]
    tops = F.first(F.when(F.col("dim") == "resource", F.col("top_values")), ignorenulls=True).alias("top_resources")
    return cuts.groupBy(key, "slice", "blk").agg(*picks, tops)


# --------------------------------------------------------------------------- #
# Blending finished profiles
# --------------------------------------------------------------------------- #


def pooled(events: DataFrame) -> DataFrame:
    """Counts and means per entity, per type and overall from one pass of grouping sets."""
    e = events.selectExpr("entity_id", "entity_type", "session_id", "if(auth_success, 0D, 1D) AS fail", f"{STAT_SQL['bytes_out']} AS bo")
    return e.groupingSets([["entity_id"], ["entity_type"], []], "entity_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"),
        F.avg("bo").alias("bytes_out_mean"), F.avg("fail").alias("failure_rate"),
    )


def blend_map_sql(a: str, b: str, w: str) -> str:
    """Convex blend of two share maps over the union of their keys."""
    none = "cast(map() AS map<string,double>)"
    return (
        f"CASE WHEN {w} >= 1 THEN coalesce({a}, {none}) WHEN {w} <= 0 THEN coalesce({b}, {none}) ELSE "
        f"map_zip_with(coalesce({a}, {none}), coalesce({b}, {none}), (k, x, y) -> {w} * coalesce(x, 0D) + (1 - {w}) * coalesce(y, 0D)) END"
    )


def _stat_columns() -> list[str]:
    return [f"{n}_{x}" for n in STATS for x in "nsq"]


def merged(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Persisted profile extended by the evidence since: counts and sums add, shares blend by events."""
    j = stored.alias("s").join(live.alias("l"), "entity_id", "full").withColumn(
        "w", F.expr("coalesce(s.event_count, 0) / (coalesce(s.event_count, 0) + coalesce(l.event_count, 0))")
    )
    return j.selectExpr(
        "entity_id", "coalesce(s.entity_type, l.entity_type) AS entity_type",
        "coalesce(s.event_count, 0) + coalesce(l.event_count, 0) AS event_count",
        "coalesce(s.session_count, 0) + coalesce(l.session_count, 0) AS session_count",
        "least(s.first_us, l.first_us) AS first_us", "greatest(s.last_us, l.last_us) AS last_us",
        "w * coalesce(s.failure_rate, 0D) + (1 - w) * coalesce(l.failure_rate, 0D) AS failure_rate",
        *[f"coalesce(s.{c}, 0D) + coalesce(l.{c}, 0D) AS {c}" for c in _stat_columns()],
        "coalesce(s.home_lat, l.home_lat) AS home_lat", "coalesce(s.home_lon, l.home_lon) AS home_lon",
        "greatest(s.spread_km, l.spread_km) AS spread_km",
        *[f"{blend_map_sql(f's.d_{d}', f'l.d_{d}', 'w')} AS d_{d}" for d in DIMS],
        "CASE WHEN s.event_count is null THEN 'live' WHEN l.event_count is null THEN 'stored' ELSE 'both' END AS source",
    )


def shrunk(profiles: DataFrame, prior: DataFrame, on: str = "entity_type", s: Settings = DEFAULTS) -> DataFrame:
    """Profiles with little history pulled toward the prior of their group (``prior`` has one row
    per group, so it is small by construction), in the distributions that both have."""
    dims = [d for d in DIMS if f"d_{d}" in profiles.columns and f"d_{d}" in prior.columns]
    p = prior.selectExpr(f"{on} AS _g", *[f"{c} AS pr_{c}" for c in prior.columns if c != on])
    j = profiles.join(F.broadcast(p), profiles[on] == p["_g"], "left").withColumn(
        "w", F.expr(f"if(session_count >= {s.min_sessions}, 1D, session_count / (session_count + {float(s.prior_sessions)}D))")
    )
    thin = [f"{c} + if(w < 1 and {c[:-1]}n < {s.prior_stat_floor}, coalesce(pr_{c}, 0D), 0D) AS {c}" for c in _stat_columns()]
    return j.selectExpr(
        "entity_id", "entity_type", "event_count", "session_count", "w AS confidence", "w < 1 AS cold_start",
        "w * failure_rate + (1 - w) * coalesce(pr_failure_rate, 0D) AS failure_rate", *thin,
        "coalesce(home_lat, pr_home_lat) AS home_lat", "coalesce(home_lon, pr_home_lon) AS home_lon",
        "w * spread_km + (1 - w) * coalesce(pr_spread_km, 0D) AS spread_km",
        *[f"{blend_map_sql(f'd_{d}', f'pr_d_{d}', 'w')} AS d_{d}" for d in dims],
    )
