"""Hand values, brute force, leakage, skew splitting and round trips."""

import math
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS
from tidewatch.functions import scalar as S
from tidewatch.functions import sequences as Q
from tidewatch.operators import drift as D
from tidewatch.operators import feedback as B
from tidewatch.operators import ordering as O
from tidewatch.operators import profiles as P
from tidewatch.operators.campaigns import link
from tidewatch.operators.corpus import fit_corpus
from tidewatch.operators.features import NUMERIC, Knowledge, featurise
from tidewatch.operators.metrics import budget_size, recall_at_budget
from tidewatch.operators.ranking import quantiles, ranked
from tidewatch.operators.sessions import merge_overlap
from tidewatch.sources import tables as Tb

WIDE = replace(DEFAULTS, window_minutes=360)
HOUR = 3_600_000_000


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalar_hand_values(spark):
    r = one(
        spark,
        S.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)).alias("paris"),
        S.elapsed_hours(F.lit(0), F.lit(1)).alias("floor"),
        S.coerce_float(F.lit("42%")).alias("pct"), S.coerce_int(F.lit("1,234")).alias("i"), S.coerce_bool(F.lit(" YES ")).alias("b"),
        S.coerce_float(F.lit("abc")).alias("bad"), S.ip_prefix(F.lit("10.24.8.15")).alias("ip"), S.ip_prefix(F.lit("fe80")).alias("short"),
        S.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("nul"),
    )
    assert abs(r.paris - 343.6) < 1 and abs(r.floor - 1 / 60) < 1e-12
    assert (r.pct, r.i, r.b, r.bad, r.ip, r.short, r.nul) == (42.0, 1234, True, None, "10.24.8", "fe80", None)


def test_sequences_hand_values(spark):
    a = F.array(*[F.lit(x) for x in "abc"])
    r = one(spark, Q.ngrams(a).alias("g"), Q.ngrams(F.array(F.lit("a"))).alias("e"), Q.pad_left(F.array(F.lit(2), F.lit(5)), 4).alias("p"),
            Q.adjacent_distinct(F.array(*[F.lit(x) for x in "aabba"])).alias("d"))
    assert r.g == ["a>b", "b>c"] and r.e == [] and r.p == [0, 0, 2, 5] and r.d == ["a", "b", "a"]
    seq, tail = [], []
    for w in (["login", "view"], ["login", "view"], ["view", "logout"]):
        new, tail = merge_overlap(tail, w, 64)
        seq += new
    assert seq == ["login", "view", "logout"]


def simulate(rows, every=20, window=360 * 60_000_000, cap=400, top=40):
    """Event-by-event replay of one entity in plain Python; rows are in order."""
    counts, snap, total_at, history, sessions, snap_sessions, out = Counter(), None, 0, [], set(), 0, []
    for n, r in enumerate(rows, 1):
        if n >= 2 and (snap is None or n - 1 - total_at >= every):
            kept = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
            total = sum(v for _, v in kept)
            snap, total_at, snap_sessions = {k: v / total for k, v in kept}, n - 1, len(sessions)
        w = 0.0 if snap is None else 1.0 if snap_sessions >= 15 else snap_sessions / (snap_sessions + 12)
        recent = history[-cap:]
        win = [h for h in recent if h.ts_us >= r.ts_us - window]
        prev = history[-1].ts_us if history else 0
        same = [h for h in recent if h.ts_us >= prev - window and h.session_id == r.session_id]
        names = {h.resource_accessed for h in win} | {r.resource_accessed}
        out.append(
            (r.event_id, w * (snap or {}).get(r.resource_accessed, 0.0), float(bool(snap) and w > 0 and r.resource_accessed not in snap),
             float(len(win) + 1), float(len(same)), sum(x not in snap for x in names) / len(names) if snap and w > 0 else 0.0)
        )
        counts[r.resource_accessed] += 1
        sessions.add(r.session_id)
        history.append(r)
    return out


NAMES = ("resource_likelihood", "is_new_resource", "window_event_count", "session_event_index", "window_foreign_resource_ratio")


@pytest.mark.parametrize("limit", [None, 60])
def test_features_equal_event_by_event_replay(spark, events, limit):
    s = replace(WIDE, max_group_rows=limit)
    got = {r.event_id: tuple(r)[1:] for r in featurise(events, s, names=NAMES).select("event_id", *NAMES).collect()}
    rows = events.select("entity_id", "event_id", "ts_us", "session_id", "resource_accessed").orderBy("ts_us", "event_id").collect()
    want = []
    for e in {r.entity_id for r in rows}:
        want += simulate([r for r in rows if r.entity_id == e])
    assert len(want) == len(got) and any(w[2] for w in want) and any(w[4] for w in want)
    for eid, *vals in want:
        assert got[eid] == pytest.approx(vals, abs=1e-9), eid


def test_splitting_an_oversized_entity_changes_nothing(spark, events):
    know = Knowledge(corpus=fit_corpus(events))

    def run(s):
        cols = [F.round(n, 7).alias(n) for n in NUMERIC]
        return featurise(events, s, know).select("event_id", *cols).toPandas().set_index("event_id").sort_index()

    whole, split = run(WIDE), run(replace(WIDE, max_group_rows=70))
    assert O.order_events(events, replace(WIDE, max_group_rows=70)).sliced
    assert (whole - split).abs().max().max() < 1e-6


def test_later_events_never_change_earlier_rows(spark, events):
    cut = events.agg(F.expr("percentile_approx(ts_us, 0.7)")).first()[0]
    names = ("country_likelihood", "bytes_out_zscore", "window_event_count", "session_event_index", "cold_start")
    full = featurise(events, WIDE, names=names).filter(F.col("ts_us") <= cut).select("event_id", *names)
    early = featurise(events.filter(F.col("ts_us") <= cut).repartition(7), WIDE, names=names).select("event_id", *names)
    assert full.count() == early.count() and full.exceptAll(early).count() == 0


def toy(spark, times, entity="e"):
    return spark.createDataFrame([(entity, i, int(t)) for i, t in enumerate(times)], "entity_id string, event_id bigint, ts_us bigint")


def test_window_bounds_and_ties(spark):
    df = toy(spark, [0, 60 * 60_000_000, 60 * 60_000_000, 120 * 60_000_000 + 1])
    o = O.trailing(O.order_events(df), {"us": "ts_us"})
    n = [r.n for r in o.rows().selectExpr("event_id", "size(filter(recent, x -> x.us >= ts_us - 3600000000)) AS n").orderBy("event_id").collect()]
    assert n == [0, 1, 2, 0]


def test_window_cap(spark):
    s = replace(DEFAULTS, window_cap=10)
    o = O.trailing(O.order_events(toy(spark, range(40)), s), {"us": "ts_us"})
    assert o.rows().selectExpr("max(size(recent))").first()[0] == 10


def test_snapshot_cadence(spark):
    o = O.order_events(toy(spark, range(45)))
    o = O.running(o, {"seen": "1"}, "block")
    seen = [int(r.seen) for r in o.rows().orderBy("rn").collect()]
    assert seen[0] == 0 and seen[1] == 1 and seen[20] == 1 and seen[21] == 21 and seen[41] == 41


def test_campaign_gap_is_inclusive(spark):
    g = 72 * HOUR
    df = toy(spark, [0, g, 2 * g + 1]).withColumns({"risk": F.lit(1.0), "anomaly_type": F.lit("x")})
    assert [r.campaign_no for r in link(df).orderBy("event_id").collect()] == [1, 1, 2]


def test_feedback_clamps_at_every_step(spark):
    v = ["false_positive"] * 5 + ["confirmed"] + ["confirmed"] * 300
    df = spark.createDataFrame([("e", i, i, x) for i, x in enumerate(v)], "entity_id string, feedback_id bigint, ts_us bigint, verdict string")
    for s in (DEFAULTS, replace(DEFAULTS, max_group_rows=50)):
        new = [r.new_value for r in B.fold(df, s).orderBy("feedback_id").collect()]
        assert new[:6] == [-10, -20, -30, -40, -40, -30] and new[-1] == 40 and len(new) == 306


def test_feedback_through_levels_of_chunks(spark, monkeypatch):
    import random

    monkeypatch.setattr(B, "CHUNK", 4)
    rnd = random.Random(3)
    rows = [(e, 1000 * k + i, i // 3, rnd.choice(["false_positive", "confirmed"])) for k, (e, n) in enumerate({"busy": 300, "some": 17, "one": 1}.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, feedback_id bigint, ts_us bigint, verdict string")
    want, cur = {}, {}
    for e, i, _, v in rows:
        before = cur.get(e, 0.0)
        cur[e] = max(-40.0, min(40.0, before + (-10.0 if v == "false_positive" else 10.0)))
        want[i] = (before, cur[e])
    for s in (DEFAULTS, replace(DEFAULTS, max_group_rows=50)):
        assert {r.feedback_id: (r.previous_value, r.new_value) for r in B.fold(df, s).collect()} == want
    assert B.fold(df.limit(0)).count() == 0


def test_weight_grid_with_shared_scores(spark):
    import random

    from tidewatch.operators import risk as RI

    rnd = random.Random(5)

    def plain(rows, k):
        out = {}
        for g, (a, b, c) in enumerate(RI.weight_grid(0.25)):
            best = sorted(rows, key=lambda r: (-round(a * r[2] + b * r[3] + c * r[4], 9), r[0]))
            out[g] = sum(r[1] for r in best[:k])
        return out

    few = [(i, int(rnd.random() < 0.3), *(rnd.choice([0.0, 0.25, 0.5]) for _ in range(3))) for i in range(1500)]
    same = [(i, i % 7 % 2, 0.5, 0.5, 0.5) for i in range(1500)]
    free = [(i, int(rnd.random() < 0.1), rnd.random(), rnd.random(), rnd.random()) for i in range(300)]
    for rows in (few, same, free):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "event_id bigint, y int, baseline double, sequence double, classifier double")
        got = {r.g: r.hits for r in RI.tune_weights(df, 0.1, 0.25).collect()}
        assert got == plain(rows, len(rows) // 10)
    assert RI.tune_weights(df.limit(0), 0.1, 0.25).count() == 0
    gaps = spark.createDataFrame([(1, 1, None, 0.9, 0.9), (2, None, 0.1, 0.1, 0.1)], df.schema)
    assert {r.hits for r in RI.tune_weights(gaps, 0.5, 0.25).collect()} == {0}


def test_offset_as_of_with_split_history(spark):
    marks = spark.createDataFrame([("e", 10 * i + 5, i, float(i)) for i in range(200)], "entity_id string, ts_us bigint, seq bigint, new_value double")
    probes = spark.createDataFrame([("e", 10 * i, i) for i in range(200)], "entity_id string, ts_us bigint, detection_id bigint")
    for s in (DEFAULTS, replace(DEFAULTS, max_group_rows=60)):
        got = {int(r.detection_id): r.offset for r in B.offset_as_of(probes, marks, s).collect()}
        assert got == {i: float(max(0, i - 1)) for i in range(200)}


def test_psi_and_monitor(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    d = spark.range(1).select(arr(0.8, 0.1, 0.1).alias("a"), arr(0.1, 0.1, 0.8).alias("b"))
    same, far = d.selectExpr(D.psi_sql("a", "a"), D.psi_sql("a", "b")).first()
    assert same == 0 and far > 0.5
    m = D.Monitor(DEFAULTS)
    out = [m.push(math.sin(i)) for i in range(99)]
    assert all(p == 0 for p, _, _ in out) and m.push(0.3)[0] > 0
    shifted = [m.push(50.0)[1] for _ in range(400)]
    assert "drifting" in shifted and "adapted" in shifted and shifted[-1] == "stable"


def test_budget_is_half_even_and_recall(spark):
    assert (budget_size(250, 0.01), budget_size(350, 0.01), budget_size(3, 0.01)) == (2, 4, 1)
    rows = [(i, float(r), "brute_force" if i < 2 else "normal") for i, r in enumerate([95, 90, 85, 10, 5, 1])]
    df = spark.createDataFrame(rows, "event_id bigint, risk double, label string")
    assert recall_at_budget(df, [0.34]).first().recall == 1.0


def test_ranks_and_quantiles_across_buckets(spark):
    df = spark.range(5000).selectExpr("id", "cast(if(id % 3 = 0, 7, id % 100) AS double) AS v")
    r = ranked(df, "v", "id", {"s": "1"}, bucket_rows=300).toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert list(r["rank"]) == list(range(1, 5001)) and list(r["s"]) == list(r["rank"])
    vals = sorted(x.v for x in df.collect())
    import numpy as np

    assert quantiles(df, "v", [0.1, 0.5, 0.99], bucket_rows=40) == pytest.approx(list(np.quantile(vals, [0.1, 0.5, 0.99])))


def test_topk_cut_under_splitting(spark, events):
    def cuts(s):
        rows = P.snapshot_cuts(O.order_events(events, s)).drop("slice", "top_values").collect()
        return sorted(tuple(r) for r in rows)

    small = replace(DEFAULTS, top_values={**DEFAULTS.top_values, "resource": 12, "token": 3, "ngram": 9})
    assert cuts(small) == cuts(replace(small, max_group_rows=60)) and len(cuts(small)) > 50


def test_state_round_trip_and_version_check(spark, events, tmp_path):
    p = P.entity_profiles(events)
    Tb.save_state(spark, {"profiles": p}, str(tmp_path / "s"))
    back = Tb.load_state(spark, str(tmp_path / "s"))["profiles"]
    assert back.select("entity_id", "event_count").exceptAll(p.select("entity_id", "event_count")).count() == 0
    spark.createDataFrame([(99, ["profiles"])], "schema_version int, tables array<string>").write.mode("overwrite").parquet(str(tmp_path / "s/manifest"))
    with pytest.raises(ValueError):
        Tb.load_state(spark, str(tmp_path / "s"))


def test_dataset_write_keeps_truth_apart(spark, events, tmp_path):
    Tb.write_dataset(events, Tb.truth_of(events), str(tmp_path / "d"))
    e = spark.read.parquet(str(tmp_path / "d/events"))
    assert not set(Tb.TRUTH) & set(e.columns) and e.count() == events.count()
    with pytest.raises(ValueError):
        Tb.read_split(events, "nowhere")
