"""The 59 numeric and 7 categorical features of an access event.

One table of SQL expressions serves training, evaluation and batch scoring; the streaming job keeps
the same quantities as keyed state. A row only ever sees strictly earlier rows of its entity in
(time, id) order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.scalar import EARTH_KM
from tidewatch.operators import ordering as O
from tidewatch.operators import profiles as P
from tidewatch.operators.cohorts import CohortModel, live_cohorts
from tidewatch.operators.corpus import Corpus

NUMERIC = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "hour_likelihood", "dow_likelihood",
    "log_seconds_since_prev", "is_first_event",
    "log_geo_velocity_kmh", "log_distance_from_prev_km", "log_distance_from_home_km",
    "country_likelihood", "is_new_country", "ip_prefix_likelihood", "is_new_ip_prefix",
    "resource_likelihood", "is_new_resource", "resource_global_rarity", "resource_entity_share",
    "window_distinct_resources", "window_foreign_resource_ratio",
    "auth_method_likelihood", "is_new_auth_method", "auth_success",
    "window_auth_failures", "window_auth_failure_ratio", "auth_failure_rate_delta",
    "sequence_length", "sequence_length_zscore", "seq_token_novelty_entity", "seq_ngram_novelty_entity",
    "seq_ngram_novelty_global", "seq_token_rarity_global",
    "is_new_device_mac", "is_new_device_os", "protocol_likelihood", "device_changed_from_prev",
    "device_os_global_rarity",
    "log_bytes_out", "bytes_out_zscore", "log_bytes_in", "bytes_in_zscore",
    "log_session_duration", "session_duration_zscore", "log_window_bytes_out", "window_bytes_out_ratio",
    "window_event_count", "window_events_per_minute", "window_distinct_sessions", "interval_zscore",
    "session_event_index", "session_distinct_resources", "session_auth_failures", "is_new_session",
    "log_entity_session_count", "log_entity_event_count", "cold_start", "profile_confidence",
)
CATEGORICAL = (
    "entity_type", "auth_method", "geo_country", "device_protocol", "device_os", "resource_accessed", "cohort",
)
ID_COLUMNS = ("event_id", "entity_id", "entity_type", "timestamp", "ts_us", "session_id", "split")
BAG_TYPE = "array<struct<pos:int,value:string,seen:bigint,corpus_n:bigint>>"


@dataclass(frozen=True)
class Knowledge:
    """Everything fitted that features may look at. Empty knowledge is training mode."""

    corpus: Corpus | None = None
    profiles: DataFrame | None = None  # persisted entity profiles, optionally with ``cohort``
    priors: DataFrame | None = None  # cohort profiles, cohort -1 is the global one
    cohorts: CohortModel | None = None


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"if({lat1} is null, null, {2 * EARTH_KM}D * asin(least(1D, sqrt({a}))))"


def centroid_sql(lat: bool, x="home_ux", y="home_uy", z="home_uz", n="home_n", first="home_lat0") -> str:
    hyp = f"sqrt(pow({x} / {n}, 2) + pow({y} / {n}, 2))"
    flat = f"{hyp} < 1e-12 and abs({z} / {n}) < 1e-12"
    angle = f"atan2({z} / {n}, {hyp})" if lat else f"atan2({y} / {n}, {x} / {n})"
    return f"CASE WHEN {n} > 0 THEN if({flat}, {first}, degrees({angle})) END"


def zscore_sql(value: str, n: str, s: str, q: str) -> str:
    std = f"sqrt(greatest(0D, {q} / {n} - pow({s} / {n}, 2)))"
    return f"if({n} < 2, 0D, ({value} - {s} / {n}) / greatest({std}, 0.1D))"


def _corpus_joins(o: O.Ordered, k: Knowledge) -> O.Ordered:
    """Corpus counts of the event's resource and operating system; plain equi-joins whose strategy
    Catalyst picks by size."""
    frame = o.frame
    for dim in ("resource", "device_os"):
        side = k.corpus.counts.filter(F.col("dim") == dim).selectExpr(
            f"value AS v_{dim}", f"n AS corpus_n_{dim}", f"n_entities AS corpus_entities_{dim}"
        )
        frame = frame.join(side, f"v_{dim}", "left")
    return o.with_frame(frame)


def _bags(o: O.Ordered, k: Knowledge, long: DataFrame | None = None, seen: bool = True) -> O.Ordered:
    """Tokens and n-grams as arrays of (pos, value, seen in the snapshot, seen in the corpus)."""
    if long is None:
        long = P.snapshot_bags(o) if seen else P.bags(o).withColumn("seen", F.lit(0).cast("bigint"))
    if k.corpus is not None:
        side = k.corpus.counts.filter(F.col("dim").isin(*P.BAG_DIMS)).selectExpr("dim", "value", "n AS corpus_n")
        long = long.join(side, ["dim", "value"], "left")
    else:
        long = long.withColumn("corpus_n", F.lit(None).cast("bigint"))
    item = "named_struct('pos', pos, 'value', value, 'seen', seen, 'corpus_n', corpus_n)"
    wide = long.groupBy(*o.part, o.id).agg(
        *[F.expr(f"array_sort(collect_list(if(dim = '{d}', {item}, null))) AS {d}s") for d in P.BAG_DIMS]
    )
    frame = o.frame.join(wide, [*o.part, o.id], "left")
    plain = [c for c in frame.columns if c not in ("tokens", "ngrams")]
    empty = f"cast(array() AS {BAG_TYPE})"
    return o.with_frame(
        frame.selectExpr(*plain, f"coalesce(tokens, {empty}) AS tokens", f"coalesce(ngrams, {empty}) AS ngrams")
    )


def _judged_dims(names) -> tuple[str, ...]:
    """The distributions that features of these names hold a row's values against."""
    named = {"token": "seq_token_novelty_entity", "ngram": "seq_ngram_novelty_entity"}
    dims = [d for d in P.DIMS if {f"{d}_likelihood", f"is_new_{d}", named.get(d)} & set(names)]
    return tuple(dims + ["resource"] * ("window_foreign_resource_ratio" in names and "resource" not in dims))


#: What a trailing row tells, and the features that ask for it; all need its time and session.
_TRAILING = {
    "ok": ("auth_success", ("window_auth_failures", "window_auth_failure_ratio", "auth_failure_rate_delta", "session_auth_failures")),
    "out": ("bytes_out", ("log_window_bytes_out", "window_bytes_out_ratio")),
    "res": ("resource_accessed", ("window_distinct_resources", "window_foreign_resource_ratio", "session_distinct_resources")),
    "first": ("first_rn_resource", ("window_distinct_resources", "window_foreign_resource_ratio")),
}


def _trailing_fields(names) -> dict[str, str]:
    asked = {n: x for n, (x, by) in _TRAILING.items() if set(by) & set(names)}
    return {"us": "ts_us", "sid": "session_id", **asked}


def _cuts(o: O.Ordered, dims) -> O.Ordered:
    if not dims:
        return o.with_frame(o.frame.selectExpr("*", *[f"cast(null AS {t}) AS {c}" for c, t in P.CUT_TYPES.items()]))
    cuts = P.cut_maps(P.snapshot_cuts(o, dims), o.key)
    on = [o.key, "slice", "blk"] if o.sliced else [o.key, "blk"]
    return o.with_frame(o.frame.join(cuts if o.sliced else cuts.drop("slice"), on, "left"))


def _attach(o: O.Ordered, table: DataFrame, prefix: str) -> O.Ordered:
    """Left-join a per-entity table; an oversized entity's row is repeated per slice, which spreads it."""
    renamed = table.selectExpr(
        f"entity_id AS {o.key}", *[f"{c} AS {prefix}{c}" for c in table.columns if c != "entity_id"]
    )
    if o.sliced:
        renamed = o.frame.select(o.key, "slice").distinct().join(renamed, o.key)
    return o.with_frame(o.frame.join(renamed, o.part, "left"))


def _resolve(frame: DataFrame, k: Knowledge, s: Settings) -> DataFrame:
    """Own history = persisted + live; the weight on it; the cohort."""
    has_st = k.profiles is not None
    frame = frame.selectExpr(
        "*",
        ("coalesce(st_event_count, 0)" if has_st else "0") + " AS st_n",
        ("coalesce(st_session_count, 0)" if has_st else "0") + " + snap_sessions AS own_sessions",
    ).selectExpr("*", "cast(st_n + snap_n AS double) AS own_n")
    cohort = "cast(null AS int)"
    if k.cohorts is not None and k.cohorts.centroids:
        default = k.cohorts.default_sql("entity_type")
        cohort = f"if(rn >= 2, live_cohort, {default})"
        if has_st and "st_cohort" in frame.columns:
            cohort = f"coalesce(st_cohort, {cohort})"
    return frame.selectExpr(
        "*",
        f"CASE WHEN own_n = 0 THEN 0D WHEN own_sessions >= {s.min_sessions} THEN 1D "
        f"ELSE own_sessions / (own_sessions + {float(s.prior_sessions)}D) END AS w",
        "if(own_n > 0, st_n / own_n, 0D) AS ws",
        f"cast({cohort} AS int) AS cohort",
    )


def _with_prior(frame: DataFrame, k: Knowledge) -> DataFrame:
    """Cohort prior, else the type's default cohort, else the global one. The prior table has one row
    per cohort plus one, so broadcasting it is bounded by the cohort count."""
    known = [r["cohort"] for r in k.priors.select("cohort").collect()]
    default = "null"
    if k.cohorts is not None:
        arms = [f"WHEN '{t}' THEN {c}" for t, c in sorted(k.cohorts.type_default.items()) if c in known]
        default = f"CASE entity_type {' '.join(arms)} END" if arms else "null"
    listed = ", ".join(str(c) for c in known) or "-1"
    table = k.priors.selectExpr("cohort AS prior_cohort", *[f"{c} AS pr_{c}" for c in k.priors.columns if c != "cohort"])
    choice = f"coalesce(if(cohort in ({listed}), cohort, null), {default}, -1) AS prior_cohort"
    return frame.selectExpr("*", choice).join(F.broadcast(table), "prior_cohort", "left")


def _known(s: Settings, has_st: bool, has_pr: bool, dim: str, value: str, seen: str) -> str:
    """Is the value part of the resolved profile? A snapshot keeps (-count, value) <= its cut."""
    live = f"{seen} > 0"
    if dim in s.top_values:
        cut = f"cut_{dim}"
        live = (
            f"({seen} > 0 and ({cut} is null or {seen} > {cut}.cut_n "
            f"or ({seen} = {cut}.cut_n and {value} <= {cut}.cut_value)))"
        )
    own = f"({live} or coalesce(map_contains_key(st_d_{dim}, {value}), false))" if has_st else live
    hit = f"(w > 0 and {own})"
    if has_pr:
        hit = f"({hit} or (w < 1 and coalesce(map_contains_key(pr_d_{dim}, {value}), false)))"
    return f"coalesce({hit}, false)"


def _share(s: Settings, has_st: bool, has_pr: bool, dim: str) -> str:
    """Probability of the event's value under the resolved profile."""
    seen, value, total = f"seen_{dim}", f"v_{dim}", "snap_n"
    if dim in s.top_values:
        total = f"coalesce(cast(cut_{dim}.top_total AS double), snap_n)"
    own = f"if({_known(s, False, False, dim, value, seen).replace('w > 0 and ', '')}, {seen} / {total}, 0D)"
    if has_st:
        own = f"(ws * coalesce(st_d_{dim}[{value}], 0D) + (1 - ws) * {own})"
    out = f"w * {own}"
    if has_pr:
        out = f"({out} + (1 - w) * coalesce(pr_d_{dim}[{value}], 0D))"
    return f"if({value} is null, 0D, {out})"


def _has_any(has_st: bool, has_pr: bool, dim: str, live: str) -> str:
    own = f"({live} or coalesce(size(st_d_{dim}), 0) > 0)" if has_st else live
    out = f"(w > 0 and {own})"
    return f"({out} or (w < 1 and coalesce(size(pr_d_{dim}), 0) > 0))" if has_pr else out


def _stats(s: Settings, has_st: bool, has_pr: bool) -> list[str]:
    cols = []
    for name in P.STATS:
        n = f"live_{name}_n" + (f" + coalesce(st_{name}_n, 0D)" if has_st else "")
        thin = f"w < 1 and {n} < {s.prior_stat_floor}"
        for x in "nsq":
            v = f"live_{name}_{x}" + (f" + coalesce(st_{name}_{x}, 0D)" if has_st else "")
            if has_pr:
                v += f" + if({thin}, coalesce(pr_{name}_{x}, 0D), 0D)"
            cols.append(f"{v} AS {name}_{x}")
    return cols


def featurise(
    events: DataFrame, settings: Settings = DEFAULTS, know: Knowledge = Knowledge(), names=NUMERIC
) -> DataFrame:
    """Numeric features, categorical values and bookkeeping columns, one row per event.

    Asking for fewer ``names`` leaves out the stages only the others need.
    """
    return finish(history(events, settings, know, names), settings, know, names)


def history(events: DataFrame, settings: Settings = DEFAULTS, know: Knowledge = Knowledge(), names=NUMERIC) -> O.Ordered:
    """What a row knows of its entity's earlier rows: counts, sums, cuts, trailing rows, previous row, cohort.

    The streaming job keeps the same columns as keyed state (``streaming/serve.py``)."""
    s, k = settings, know
    judged = _judged_dims(names)
    text = any(n.startswith("seq") for n in names)
    against_profile = bool(judged)
    windowed = any("window" in n or n.startswith("session_") or n == "auth_failure_rate_delta" for n in names)
    with_cohorts = k.cohorts is not None and bool(k.cohorts.centroids)
    o = P.value_columns(O.order_events(events, s))
    o = O.first_of(o, "session_id", "_first_in_session")
    if against_profile or windowed or with_cohorts:
        o = P.snapshot_seen(o, ("resource", "country") if with_cohorts else ("resource",))
    snap_n = f"cast(if(blk >= 0, blk * {s.refresh_every} + 1, 0) AS double) AS snap_n"
    bare = o  # what cohorts look at, without the joins below
    if k.corpus is not None:
        o = _corpus_joins(o, k)
    if text:
        o = _bags(o, k, seen=bool(set(judged) & set(P.BAG_DIMS)))
    else:
        tokens = f"transform(filter(command_sequence, t -> t <> ''), t -> cast(named_struct('pos', 0, 'value', t, 'seen', 0, 'corpus_n', null) AS {BAG_TYPE[6:-1]}))"
        o = o.with_frame(o.frame.selectExpr("*", f"{tokens} AS tokens", f"cast(array() AS {BAG_TYPE}) AS ngrams"))
    limited = [d for d in judged if d in s.top_values]
    if limited:
        o = _cuts(o, P.crowded(events, limited, s) if len(limited) > 1 else limited)
    o = O.previous(o, "ts_us", "geo_lat", "geo_lon", "device_mac")
    early = f"rn <= {s.geo_points}"
    o = O.running(
        o,
        {
            "snap_sessions": "_first_in_session",
            "snap_fail": "if(auth_success, 0D, 1D)",
            "snap_tokens": "size(tokens)",
            "snap_ngrams": "size(ngrams)",
            "home_n": f"if({early}, 1D, 0D)",
            **{f"home_{n}": f"if({early}, {x}, 0D)" for n, x in P.UNIT_SQL.items()},
            "home_lat0": "if(rn = 1, geo_lat, 0D)",
            "home_lon0": "if(rn = 1, geo_lon, 0D)",
        },
        "block",
    )
    o = O.running(o, {f"live_{n}": x for n, x in P.stat_sums().items()}, "before")
    if windowed:
        o = O.trailing(o, _trailing_fields(names))
    o = o.with_frame(o.frame.selectExpr("*", snap_n))
    if not with_cohorts:
        return o
    told = O.previous(bare, "ts_us")
    return live_cohorts(o, k.cohorts, told.with_frame(told.frame.selectExpr("*", snap_n)))


def finish(o: O.Ordered, settings: Settings = DEFAULTS, know: Knowledge = Knowledge(), names=NUMERIC) -> DataFrame:
    """The features of rows that carry what history() gives."""
    s, k = settings, know
    windowed = any("window" in n or n.startswith("session_") or n == "auth_failure_rate_delta" for n in names)
    has_st, has_pr = k.profiles is not None, k.priors is not None
    if has_st:
        o = _attach(o, k.profiles, "st_")
    f = _resolve(o.rows(), k, s)
    if has_pr:
        f = _with_prior(f, k)

    span = s.window_minutes * 60_000_000
    home = {x: centroid_sql(x == "lat", first=f"home_{x}0") for x in ("lat", "lon")}
    for x in home:
        parts = [f"st_home_{x}"] * has_st + [home[x]] + [f"pr_home_{x}"] * has_pr
        home[x] = f"coalesce({', '.join(parts)})"
    fail = "if(snap_n > 0, snap_fail / snap_n, 0D)"
    if has_st:
        fail = f"(ws * coalesce(st_failure_rate, 0D) + (1 - ws) * {fail})"
    fail = f"w * {fail}" + (" + (1 - w) * coalesce(pr_failure_rate, 0D)" if has_pr else "")
    sid = "coalesce(session_id, '')"
    arrays = [
        f"filter(recent, x -> x.us >= ts_us - {span}) AS win",
        f"if({sid} = '', array(), filter(recent, x -> x.us >= prev.ts_us - {span} and x.sid = session_id)) AS same",
    ]
    told = _trailing_fields(names)
    over_window = {
        "first": "array_distinct(concat(transform(win, x -> named_struct('res', x.res, 'first', x.first)), "
        "array(named_struct('res', resource_accessed, 'first', first_rn_resource)))) AS win_res",
        "ok": "cast(size(filter(win, x -> not x.ok)) + if(auth_success, 0, 1) AS double) AS win_fail",
        "us": "cast(size(win) + 1 AS double) AS win_n",
        "out": "aggregate(win, 0D, (a, x) -> a + x.out) + bytes_out AS win_out",
    }
    f = f.selectExpr(
        "*",
        *(arrays if windowed else []),
        f"{home['lat']} AS my_lat",
        f"{home['lon']} AS my_lon",
        f"{fail} AS my_fail",
        *[x.replace(" AS ", " AS t_") for x in _stats(s, has_st, has_pr)],
        haversine_sql("prev.geo_lat", "prev.geo_lon", "geo_lat", "geo_lon") + " AS dist",
        "if(rn = 1, 0D, log1p(greatest(0D, (ts_us - prev.ts_us) / 1e6D))) AS log_gap",
        "(own_n = 0" + (" and coalesce(pr_event_count, 0) = 0" if has_pr else "") + ") AS no_history",
    ).selectExpr(
        "*",
        *([x for n, x in over_window.items() if n in told] if windowed else []),
        "if(t_bytes_out_n > 0, expm1(t_bytes_out_s / t_bytes_out_n), 0D) AS typical",
    )

    known_res = "(w > 0 and coalesce(if(top_resources is null, null, array_contains(top_resources, p.res)), p.first <= snap_n))"
    if has_st:
        known_res = f"({known_res} or (w > 0 and coalesce(map_contains_key(st_d_resource, p.res), false)))"
    if has_pr:
        known_res = f"({known_res} or (w < 1 and coalesce(map_contains_key(pr_d_resource, p.res), false)))"

    def share(dim):
        return _share(s, has_st, has_pr, dim)

    def is_new(dim):
        fresh = f"(v_{dim} is null or not {_known(s, has_st, has_pr, dim, 'v_' + dim, 'seen_' + dim)})"
        return f"if({_has_any(has_st, has_pr, dim, 'snap_n > 0')} and {fresh}, 1D, 0D)"

    def novelty(dim):
        arr = f"{dim}s"
        unknown = f"size(filter({arr}, x -> not {_known(s, has_st, has_pr, dim, 'x.value', 'x.seen')}))"
        some = _has_any(has_st, has_pr, dim, f"snap_{arr} > 0")
        return f"if({some} and size({arr}) > 0, {unknown} / size({arr}), 0D)"

    def z(value, name):
        return zscore_sql(value, f"t_{name}_n", f"t_{name}_s", f"t_{name}_q")

    c = k.corpus
    if c is not None:
        n_events, n_entities = float(max(1, c.n_events)), float(max(1, c.n_entities))
        rarity = {
            d: f"-ln(greatest(coalesce(corpus_n_{d}, 0) / {n_events}D, 1D / {n_events}D))" for d in ("resource", "device_os")
        }
        entity_share = f"coalesce(corpus_entities_resource, 0) / {n_entities}D"
        denom = float(max(1, c.token_total) + 1)
        floor = f"greatest(if(x.corpus_n >= {c.min_token_count}, x.corpus_n, 1), 1)"
        token_rarity = (
            f"if(size(tokens) > 0, aggregate(tokens, 0D, (a, x) -> a - ln({floor} / {denom}D)) / size(tokens), 0D)"
        )
        gram_global = "if(size(ngrams) > 0, size(filter(ngrams, x -> x.corpus_n is null)) / size(ngrams), 0D)"
    else:
        rarity, entity_share, token_rarity, gram_global = {"resource": "0D", "device_os": "0D"}, "0D", "0D", "0D"
    log = P.STAT_SQL
    meta = {x: f"if(own_n > 0, {own}, {f'coalesce(pr_{x}_count, 0)' if has_pr else '0'})"
            for x, own in (("session", "own_sessions"), ("event", "own_n"))}
    hour = "2 * pi() * (hour(timestamp) + minute(timestamp) / 60D) / 24D"
    dow = "2 * pi() * weekday(timestamp) / 7D"
    out = {
        "hour_sin": f"sin({hour})", "hour_cos": f"cos({hour})", "dow_sin": f"sin({dow})", "dow_cos": f"cos({dow})",
        "is_weekend": "if(weekday(timestamp) >= 5, 1D, 0D)",
        "hour_likelihood": f"if(no_history, 1D, 24D * {share('hour')})",
        "dow_likelihood": f"if(no_history, 1D, 7D * {share('dow')})",
        "log_seconds_since_prev": "log_gap",
        "is_first_event": "if(rn = 1, 1D, 0D)",
        "log_geo_velocity_kmh": "if(rn = 1, 0D, log1p(dist / (greatest(abs(ts_us - prev.ts_us) / 1e6D, 60D) / 3600D)))",
        "log_distance_from_prev_km": "if(rn = 1, 0D, log1p(dist))",
        "log_distance_from_home_km": f"coalesce(log1p({haversine_sql('my_lat', 'my_lon', 'geo_lat', 'geo_lon')}), 0D)",
        "country_likelihood": share("country"), "is_new_country": is_new("country"),
        "ip_prefix_likelihood": share("ip_prefix"), "is_new_ip_prefix": is_new("ip_prefix"),
        "resource_likelihood": share("resource"), "is_new_resource": is_new("resource"),
        "resource_global_rarity": rarity["resource"], "resource_entity_share": entity_share,
        "window_distinct_resources": "size(win_res)",
        "window_foreign_resource_ratio":
            f"if({_has_any(has_st, has_pr, 'resource', 'snap_n > 0')}, "
            f"size(filter(win_res, p -> not coalesce({known_res}, false))) / size(win_res), 0D)",
        "auth_method_likelihood": share("auth_method"), "is_new_auth_method": is_new("auth_method"),
        "auth_success": "if(auth_success, 1D, 0D)",
        "window_auth_failures": "win_fail",
        "window_auth_failure_ratio": "win_fail / win_n",
        "auth_failure_rate_delta": "win_fail / win_n - my_fail",
        "sequence_length": "size(tokens)",
        "sequence_length_zscore": z("size(tokens)", "seq_len"),
        "seq_token_novelty_entity": novelty("token"), "seq_ngram_novelty_entity": novelty("ngram"),
        "seq_ngram_novelty_global": gram_global, "seq_token_rarity_global": token_rarity,
        "is_new_device_mac": is_new("device_mac"), "is_new_device_os": is_new("device_os"),
        "protocol_likelihood": share("protocol"),
        "device_changed_from_prev": "if(prev.device_mac <> device_mac, 1D, 0D)",
        "device_os_global_rarity": rarity["device_os"],
        "log_bytes_out": log["bytes_out"], "bytes_out_zscore": z(log["bytes_out"], "bytes_out"),
        "log_bytes_in": log["bytes_in"], "bytes_in_zscore": z(log["bytes_in"], "bytes_in"),
        "log_session_duration": log["duration"], "session_duration_zscore": z(log["duration"], "duration"),
        "log_window_bytes_out": "log1p(greatest(0D, win_out))",
        "window_bytes_out_ratio": "if(typical > 1D, win_out / typical, 0D)",
        "window_event_count": "win_n",
        "window_events_per_minute": f"win_n / {max(1.0, float(s.window_minutes))}D",
        "window_distinct_sessions":
            "size(array_distinct(concat(transform(filter(win, x -> coalesce(x.sid, '') <> ''), x -> x.sid), "
            f"if({sid} = '', array(), array(session_id)))))",
        "interval_zscore": f"if(rn = 1, 0D, {z('log_gap', 'interval')})",
        "session_event_index": "size(same)",
        "session_distinct_resources": "size(array_distinct(concat(transform(same, x -> x.res), array(resource_accessed))))",
        "session_auth_failures": "size(filter(same, x -> not x.ok)) + if(auth_success, 0, 1)",
        "is_new_session": f"if({sid} = '', 1D, _first_in_session)",
        "log_entity_session_count": f"log1p({meta['session']})",
        "log_entity_event_count": f"log1p({meta['event']})",
        "cold_start": f"if(own_n = 0 or own_sessions < {s.min_sessions}, 1D, 0D)",
        "profile_confidence": "w",
    }
    group = "if(prior_cohort >= 0, 'cohort', 'global')" if has_pr else "'global'"
    return f.selectExpr(
        *[x for x in ID_COLUMNS if x in f.columns],
        "rn",
        *[f"cast({out[n]} AS double) AS {n}" for n in NUMERIC if n in names],
        *[f"{x} AS c_{x}" for x in CATEGORICAL if x != "cohort"],
        "coalesce(cast(cohort AS string), 'unknown') AS c_cohort",
        "transform(tokens, x -> x.value) AS tokens",
        f"CASE WHEN own_n = 0 THEN {group} WHEN w >= 1 THEN 'entity' ELSE concat('entity+', {group}) END AS profile_source",
    )
