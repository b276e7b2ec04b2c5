"""Messages to detections as one streaming job.

parse -> keyed history -> (in foreachBatch) the features' own SQL -> tiers, classes, rules, risk -> two idempotent sinks.

The keyed state gives each event the columns that ``features.history`` computes from a whole table, so that everything behind
it is the same code as in batch, for all features. Events wait in state until the watermark has passed them and are then
taken in order of time and id; what arrives behind the watermark goes to a sink of its own and never enters a history.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.scalar import EARTH_KM
from tidewatch.operators import cohorts as CO
from tidewatch.operators import ordering as O
from tidewatch.operators import profiles as P
from tidewatch.operators.features import Knowledge, _bags, _corpus_joins, finish
from tidewatch.plans.fit import State
from tidewatch.plans.score import score_features
from tidewatch.streaming.jobs import good_and_dead, parse_messages

#: Sums over a snapshot's rows, in the order the state keeps them; the first ones are what features look at.
SNAP = ("snap_sessions", "snap_fail", "snap_tokens", "snap_ngrams", "home_n", "home_ux", "home_uy", "home_uz", "home_lat0", "home_lon0")
COHORT = tuple(CO.snapshot_sums())
_FRESH = ("_dc", "_dr")  # known only from state: first rows of a country or resource
LIVE = tuple(f"live_{n}" for n in P.stat_sums())
RECENT = "array<struct<us:bigint,ok:boolean,sid:string,out:double,res:string,first:bigint>>"
CUT = "struct<cut_n:bigint,cut_value:string,top_total:bigint>"
CUT_DIMS = ("country", "ip_prefix", "resource", "device_mac", "device_os", "token", "ngram")
STATE = (
    "rn bigint, blk bigint, first_in_session double, seen array<bigint>, first_resource bigint, first_country bigint, "
    f"prev struct<ts_us:bigint,geo_lat:double,geo_lon:double,device_mac:string>, snap array<double>, cohort array<double>, live array<double>, "
    f"recent {RECENT}, cuts array<{CUT}>, top_resources array<string>, tokens array<bigint>, ngrams array<bigint>, spread_km double"
)
OUT = "entity_id string, event_id {id}, ts_us bigint, late boolean, row string, state string"


def _inputs(s: Settings) -> dict[str, str]:
    """What the state takes from an event, computed in the JVM by the expressions that batch uses."""
    bags = {d: P._bag_sql(d, s.ngram_n) for d in P.BAG_DIMS}
    own_stats = {n: x for n, x in P.STAT_SQL.items() if n != "interval"}
    cohort = {n: x for n, x in CO.snapshot_sums().items() if n not in _FRESH and n[1:] not in P.stat_sums()}
    return {
        "v": f"array({', '.join(P.SINGLE_SQL[d] for d in P.SINGLE_DIMS)})",
        "tokens": bags["token"], "ngrams": bags["ngram"],
        "stats": f"array({', '.join(own_stats.values())})",
        "unit": f"array({', '.join(P.UNIT_SQL.values())})",
        "cohort": f"array({', '.join(cohort.values())})",
        "lat": "geo_lat", "lon": "geo_lon", "mac": "device_mac", "ok": "auth_success", "sid": "session_id", "out": "bytes_out", "res": "resource_accessed",
    }


def _km(lat1, lon1, lat2, lon2) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(a)))


def _spread(points: list) -> float:
    """Farthest of the points from their centroid, as batch snapshots have it."""
    u = [[f(math.radians(a), math.radians(b)) for a, b in points] for f in (
        lambda a, b: math.cos(a) * math.cos(b), lambda a, b: math.cos(a) * math.sin(b), lambda a, b: math.sin(a))]
    x, y, z = (sum(c) / len(points) for c in u)
    hyp = math.hypot(x, y)
    lat, lon = points[0] if hyp < 1e-12 and abs(z) < 1e-12 else (math.degrees(math.atan2(z, hyp)), math.degrees(math.atan2(y, x)))
    return max(_km(lat, lon, a, b) for a, b in points)


class History(StatefulProcessor):
    """An entity's history: counts of values, sessions seen, sums, the top values, and the rows of the trailing window.

    Counts and sessions stand in keyed stores of their own, so that only entries an event names are read. Waiting events are
    a list of at most the entity's events within the allowed lateness. An entity that is idle for ``idle_us`` of event time
    is forgotten; a session is, once it is idle that long.
    """

    def __init__(self, s: Settings, idle_us: int | None):
        self.s, self.idle = s, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", "v string")
        self.waiting = handle.getListState("waiting", "us bigint, row string")
        self.counts = handle.getMapState("counts", "dim string, v string", "before bigint, blk bigint, inside bigint, first bigint")
        self.tops = handle.getMapState("tops", "dim string", "v string")
        self.sessions = handle.getMapState("sessions", "sid string", "us bigint")

    # --- arrival, order, forgetting ---

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        late, soonest = [], None
        for chunk in rows:
            fresh = []
            for us, row in zip(chunk["ts_us"].tolist(), chunk["row"].tolist()):
                if us < horizon:
                    late.append((key[0], json.loads(row)["event_id"], us, True, row, None))
                else:
                    fresh.append((us, row))
                    soonest = us if soonest is None else min(soonest, us)
            if fresh:
                self.waiting.appendList(fresh)
        if soonest is not None:
            self._wake(soonest)
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for us, row in self.waiting.get():
            if us < horizon:
                event = json.loads(row)
                due.append((us, event["event_id"], event, row))
            else:
                later.append((us, row))
        if due:
            due.sort(key=lambda x: x[:2])
            self._load()
            out = [(key[0], i, us, False, row, json.dumps(self._take(us, e["_in"]))) for us, i, e, row in due]
            self._set_idle_timer(horizon)
            self._store()
            self.waiting.put(later) if later else self.waiting.clear()
            yield self._frame(out)
        elif not later and self.idle is not None and self.core.exists():
            if json.loads(self.core.get()[0])["prev"][0] + self.idle < horizon:
                for store in (self.core, self.waiting, self.counts, self.tops, self.sessions):
                    store.clear()
        if later:
            self._wake(min(us for us, _ in later))

    def _set_idle_timer(self, horizon: int) -> None:
        """One timer for the day the entity will have been idle too long; now and then sessions that are go already."""
        c = self.c
        if self.idle is None:
            return
        if c["timer"] > horizon // 1000:
            self.handle.deleteTimer(c["timer"])
        c["timer"] = (c["prev"][0] + self.idle) // 1000 + 1
        self.handle.registerTimer(c["timer"])
        if c["swept"] + self.idle // 4 < horizon:
            c["swept"] = horizon
            for sid in [k[0] for k, v in self.sessions.iterator() if v[0] + self.idle < horizon]:
                self.sessions.removeKey((sid,))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["entity_id", "event_id", "ts_us", "late", "row", "state"])

    # --- one event ---

    def _load(self) -> None:
        self.c = json.loads(self.core.get()[0]) if self.core.exists() else {
            "rn": 0, "blk": -1, "prev": None, "snap": [0.0] * (len(SNAP) + len(COHORT)), "sums": [0.0] * (len(SNAP) + len(COHORT)),
            "live": [0.0] * len(LIVE), "recent": [], "cuts": [None] * len(CUT_DIMS), "tops": None, "touched": {}, "points": [], "spread": None, "timer": 0, "swept": 0}
        self.cached: dict[tuple, list] = {}

    def _store(self) -> None:
        self.core.update((json.dumps(self.c),))
        for k, (cell, changed) in self.cached.items():
            if changed:
                self.counts.updateValue(k, tuple(cell))

    def _cell(self, dim: str, value: str) -> list:
        k = (dim, value)
        if k not in self.cached:
            self.cached[k] = [list(self.counts.getValue(k)) if self.counts.containsKey(k) else [0, self.c["blk"], 0, 0], False]
        return self.cached[k][0]

    def _seen(self, dim: str, value: str | None) -> int:
        """How often the snapshot has the value."""
        if value is None:
            return 0
        before, blk, inside, _ = self._cell(dim, value)
        return before + (inside if blk != self.c["blk"] else 0)

    def _add(self, dim: str, value: str | None) -> None:
        if value is None:
            return
        cell = self._cell(dim, value)
        if cell[1] != self.c["blk"]:
            cell[0], cell[1], cell[2] = cell[0] + cell[2], self.c["blk"], 0
        cell[2] += 1
        cell[3] = cell[3] or self.c["rn"]
        self.cached[dim, value][1] = True
        if dim in self.s.top_values:
            self.c["touched"].setdefault(dim, {})[value] = None

    def _close_block(self) -> None:
        """A snapshot takes in the rows since the last one: sums, the top values of each limited dimension, the spread."""
        c = self.c
        c["snap"] = list(c["sums"])
        for dim, names in c["touched"].items():
            k = self.s.top_values[dim]
            top = dict(json.loads(self.tops.getValue((dim,))[0])) if self.tops.containsKey((dim,)) else {}
            for v in names:
                cell = self._cell(dim, v)
                top[v] = cell[0] + cell[2]
            kept = sorted(top.items(), key=lambda x: (-x[1], x[0]))[: k + 1]
            self.tops.updateValue((dim,), (json.dumps(kept),))
            if len(kept) > k and dim in CUT_DIMS:
                inside = kept[:k]
                c["cuts"][CUT_DIMS.index(dim)] = {"cut_n": inside[-1][1], "cut_value": inside[-1][0], "top_total": sum(n for _, n in inside)}
                if dim == "resource":
                    c["tops"] = sorted(v for v, _ in inside)
        c["touched"] = {}
        if c["points"] is not None:
            c["spread"] = _spread(c["points"])
            if len(c["points"]) >= self.s.geo_points:
                c["points"] = None  # it changes no more

    def _take(self, us: int, e: dict) -> dict:
        """The event's row of history; then the event becomes part of it."""
        s, c = self.s, self.c
        c["rn"] += 1
        rn = c["rn"]
        blk = (rn - 2) // s.refresh_every if rn > 1 else -1
        if blk != c["blk"]:
            self._close_block()
            c["blk"] = blk
        values = dict(zip(P.SINGLE_DIMS, e["v"]))
        sid = e["sid"]
        new_session = sid is not None and not self.sessions.containsKey((sid,))
        firsts = {d: (self._cell(d, values[d])[3] or rn) if values[d] is not None else None for d in ("resource", "country")}
        span = s.window_minutes * 60_000_000
        prev = c["prev"]
        gap = math.log1p(max(0.0, (us - prev[0]) / 1e6)) if prev else None
        row = {
            "rn": rn, "blk": blk, "first_in_session": float(new_session), "seen": [self._seen(d, v) for d, v in values.items()],
            "first_resource": firsts["resource"], "first_country": firsts["country"],
            "prev": None if prev is None else {"ts_us": prev[0], "geo_lat": prev[1], "geo_lon": prev[2], "device_mac": prev[3]},
            "snap": c["snap"][: len(SNAP)], "cohort": c["snap"][len(SNAP) :], "live": list(c["live"]), "recent": list(c["recent"]),
            "cuts": list(c["cuts"]), "top_resources": c["tops"], "spread_km": c["spread"] if blk >= 0 else None,
            "tokens": [self._seen("token", t) for t in e["tokens"]], "ngrams": [self._seen("ngram", g) for g in e["ngrams"]],
        }
        stats = iter(e["stats"])
        signal = {n: gap if n == "interval" else next(stats) for n in P.STATS}
        sums = []
        for x in signal.values():
            sums += [0.0, 0.0, 0.0] if x is None else [1.0, x, x * x]
        c["live"] = [a + b for a, b in zip(c["live"], sums)]
        for d, v in values.items():
            self._add(d, v)
        for d, bag in (("token", e["tokens"]), ("ngram", e["ngrams"])):
            for v in bag:
                self._add(d, v)
        early = 1.0 if rn <= s.geo_points else 0.0
        lat, lon = e["lat"], e["lon"]
        unit = [x * early if x is not None else 0.0 for x in e["unit"]]
        mine = [float(new_session), 0.0 if e["ok"] else 1.0, float(len(e["tokens"])), float(len(e["ngrams"])), early, *unit,
                lat if rn == 1 else 0.0, lon if rn == 1 else 0.0]
        given = iter(e["cohort"])
        own = dict(zip(P.stat_sums(), sums))
        for name in COHORT:
            if name in _FRESH:
                mine.append(float(firsts["country" if name == "_dc" else "resource"] == rn))
            else:
                mine.append(own[name[1:]] if name[1:] in own else next(given))
        c["sums"] = [a + b for a, b in zip(c["sums"], mine)]
        if c["points"] is not None and early:
            c["points"].append([lat, lon])
        if sid is not None:
            self.sessions.updateValue((sid,), (us,))
        c["recent"].append({"us": us, "ok": e["ok"], "sid": sid, "out": e["out"], "res": e["res"], "first": firsts["resource"]})
        c["recent"] = [x for x in c["recent"][-s.window_cap :] if x["us"] >= us - span]
        c["prev"] = [us, lat, lon, e["mac"]]
        return row

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, s: Settings = DEFAULTS, lateness: str = "10 minutes", idle_days: float | None = 90.0) -> DataFrame:
    """Columns of OUT: each on-time event once the watermark has passed it, with its row of history; late ones as they come.

    events: the columns of EVENT, ``timestamp`` and ``ts_us``. The watermark is that of the whole stream. Its time column ends
    before the stateful operator, because Spark would drop late rows there without a trace.
    """
    named = ", ".join(f"'{n}', {x}" for n, x in _inputs(s).items())
    keep = F.to_json(F.struct(*events.columns, F.expr(f"named_struct({named})").alias("_in")), {"ignoreNullFields": "false"})
    rows = events.withWatermark("timestamp", lateness).select("entity_id", "ts_us", keep.alias("row"))
    idle = None if idle_days is None else int(idle_days * 86_400_000_000)
    return rows.groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=History(s, idle), outputStructType=OUT.replace("{id}", dict(events.dtypes)["event_id"]), outputMode="Append", timeMode="EventTime")


def events_of(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The events that rows of history_stream() carry."""
    plain = T.StructType([f for f in schema.fields if f.name not in ("timestamp",)])
    return rows.withColumn("_e", F.from_json("row", plain)).select(
        *[F.col(f"_e.{f.name}") if f.name != "timestamp" else F.timestamp_micros("ts_us").alias("timestamp") for f in schema.fields])


def stream_features(rows: DataFrame, schema: T.StructType, s: Settings = DEFAULTS, know: Knowledge = Knowledge()) -> DataFrame:
    """All features of on-time rows of history_stream(): the batch expressions over the state's columns."""
    plain = T.StructType([f for f in schema.fields if f.name != "timestamp"])
    f = rows.select(F.timestamp_micros("ts_us").alias("timestamp"), F.from_json("row", plain).alias("_e"), F.from_json("state", STATE).alias("_s"))
    f = f.select("timestamp", *[F.col(f"_e.{n}") for n in plain.fieldNames()], "_s")
    dims = {d: f"_s.seen[{i}] AS seen_{d}" for i, d in enumerate(P.SINGLE_DIMS)}
    f = f.selectExpr(
        *schema.fieldNames(), "_s.rn AS rn", "_s.blk AS blk", "0L AS slice", "false AS halo", *[f"{x} AS v_{d}" for d, x in P.SINGLE_SQL.items()],
        "_s.first_in_session AS _first_in_session", *dims.values(), "_s.first_resource AS first_rn_resource", "_s.first_country AS first_rn_country",
        "_s.prev AS prev", *[f"_s.snap[{i}] AS {n}" for i, n in enumerate(SNAP)], *[f"_s.live[{i}] AS {n}" for i, n in enumerate(LIVE)],
        *[f"_s.cohort[{i}] AS {n}" for i, n in enumerate(COHORT)], "_s.spread_km AS spread_km", "_s.recent AS recent",
        *[f"_s.cuts[{i}] AS cut_{d}" for i, d in enumerate(CUT_DIMS)], "_s.top_resources AS top_resources",
        "_s.tokens AS _tokens", "_s.ngrams AS _ngrams", f"cast(if(_s.blk >= 0, _s.blk * {s.refresh_every} + 1, 0) AS double) AS snap_n")
    bags = ", ".join(
        f"transform({P._bag_sql(d, s.ngram_n)}, (v, i) -> named_struct('dim', '{d}', 'pos', cast(i AS int), 'value', v, 'seen', _{d}s[i]))" for d in P.BAG_DIMS)
    o = O.Ordered(f.drop("_tokens", "_ngrams"), "entity_id", "ts_us", "event_id", False, s, s.window_cap)
    if know.corpus is not None:
        o = _corpus_joins(o, know)
    o = _bags(o, know, f.selectExpr("entity_id", "event_id", f"explode(concat({bags})) AS d").select("entity_id", "event_id", "d.*"))
    if know.cohorts is not None and know.cohorts.centroids:
        o = o.with_frame(CO.with_live_cohort(o.frame, know.cohorts, s))
    return finish(o.with_frame(o.frame.drop(*COHORT, "spread_km")), s, know)


def detect(rows: DataFrame, schema: T.StructType, state: State, s: Settings = DEFAULTS, offsets: DataFrame | None = None) -> DataFrame:
    """Detections of on-time rows of history_stream(); the same as score_table() gives for the whole table."""
    return score_features(stream_features(rows, schema, s, state.knowledge), events_of(rows, schema), state, s, offsets, drift=False)


def serve(
    raw: DataFrame, state: State, to: str, checkpoint: str, s: Settings = DEFAULTS, lateness: str = "10 minutes", idle_days: float | None = 90.0,
    offsets: DataFrame | None = None, column: str = "value", **trigger,
) -> list[StreamingQuery]:
    """Two queries over messages: detections and late events under ``to``/detections and /late, dead letters under /dead.

    ``trigger`` goes to DataStreamWriter.trigger; bound a batch by the source's options (maxFilesPerTrigger,
    maxOffsetsPerTrigger). Each batch overwrites the folder of its own number, so a batch that is repeated after a failure
    leaves each message once; read the folders with read_sink(). Null or empty messages are dead letters. Each batch's history
    rows stand under /history until they are removed.
    """
    parsed = parse_messages(raw, column)
    good, dead = good_and_dead(parsed)
    history = history_stream(good, s, lateness, idle_days)
    schema = good.schema

    def write(batch: DataFrame, number: int) -> None:
        place = f"{to}/history/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        held = batch.sparkSession.read.schema(batch.schema).parquet(place)
        on_time, late = held.where("NOT late"), held.where("late")
        if not on_time.isEmpty():  # a batch with nothing to score costs no plan
            detect(on_time, schema, state, s, offsets).drop("row").write.mode("overwrite").parquet(f"{to}/detections/batch={number}")
        if not late.isEmpty():
            late.select("entity_id", "event_id", "ts_us", "row").write.mode("overwrite").parquet(f"{to}/late/batch={number}")

    def bury(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/dead/batch={number}")

    jobs = []
    for name, rows, sink in (("detections", history, write), ("dead", dead, bury)):
        jobs.append(rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"processingTime": "30 seconds"})).start())
    return jobs


def read_sink(spark: SparkSession, to: str, name: str) -> DataFrame:
    """What serve() has written so far; ``name`` is detections, late or dead."""
    return spark.read.option("basePath", f"{to}/{name}").parquet(f"{to}/{name}").drop("batch")
