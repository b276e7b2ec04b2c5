"""Fitted state saved by one job scores the same in another; cuts and switches do not change results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS
from tidewatch.operators import corpus as C
from tidewatch.operators import profiles as P
from tidewatch.operators import ranking as R
from tidewatch.operators import reads as H
from tidewatch.operators import sessions as SE
from tidewatch.plans.fit import fit_all
from tidewatch.plans.persist import load_fitted, save_fitted
from tidewatch.plans.score import score_table


def test_saved_state_scores_alike(spark, events, tmp_path):
    labels = events.select("event_id", "label")
    state = fit_all(events.filter("split = 'train'"), events.filter("split = 'val'"), labels, trees=3)
    save_fitted(spark, state, str(tmp_path / "state"))
    again = load_fitted(spark, str(tmp_path / "state"))
    assert again.scaler == state.scaler and again.risk == state.risk and again.bottleneck.normaliser == state.bottleneck.normaliser
    cols = ("event_id", "baseline", "sequence", "classifier", "risk", "is_anomaly", "anomaly_type")
    test = events.filter("split = 'test'")
    rows = [sorted(map(tuple, score_table(test, st, drift=False).select(*cols).collect())) for st in (state, again)]
    assert rows[0] == rows[1] and rows[0]


def test_unlimited_distributions_keep_every_value(spark):
    counts = spark.range(200).selectExpr("'e' AS entity_id", "'auth_method' AS dim", "cast(id AS string) AS value", "1L AS n")
    more = counts.withColumn("dim", F.lit("country"))
    out = P.top_shares(counts.union(more), ["entity_id"], replace(DEFAULTS, top_values={"country": 2})).groupBy("dim").count()
    assert {r["dim"]: r["count"] for r in out.collect()} == {"auth_method": 200, "country": 2}


def test_split_session_counts_commands_alike(spark):
    rows = [(k, "e", "s", k * 1_000_000, ["ls"] if k in (0, 79) else [], True) for k in range(80)]
    ev = spark.createDataFrame(rows, "event_id long, entity_id string, session_id string, ts_us long, command_sequence array<string>, auth_success boolean")
    for c in ("resource_accessed", "geo_country", "device_mac"):
        ev = ev.withColumn(c, F.lit("x"))
    ev = ev.withColumns({"bytes_out": F.lit(1.0), "bytes_in": F.lit(1.0)})
    counts = [SE.summaries(ev, replace(DEFAULTS, max_group_rows=n)).first()["command_count"] for n in (None, 20)]
    assert counts == [1, 1]


def test_pages_are_refused_not_cut(spark):
    d = spark.range(3).selectExpr("cast(id AS string) AS event_id", "1D AS risk", "id AS ts_us", "'a' AS entity_id")
    with pytest.raises(ValueError):
        H.list_detections(d, limit=1000)
    assert H.top_per_entity(d).first()["event_id"] == "0"


def test_fields_without_cap_keep_all_values(spark):
    cols = list(C.CATEGORIES.values())
    ev = spark.range(30).select(*[F.concat(F.lit("v"), F.col("id")).alias(c) for c in dict.fromkeys(cols)])
    n = {r["field"]: r["count"] for r in C.category_codes(ev, caps={"resource_accessed": 4}).groupBy("field").count().collect()}
    assert n["resource_accessed"] == 4 and n["auth_method"] == 30


def test_null_scores_rank_last_whatever_the_buckets(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, cast(id AS double)) AS s")
    for ascending in (True, False):
        ranks = [{r["id"]: r["rank"] for r in R.ranked(df, "s", "id", ascending=ascending, bucket_rows=b).collect()} for b in (10_000, 50)]
        assert ranks[0] == ranks[1] and sorted(ranks[0].values()) == list(range(1, 1001))
        assert min(v for k, v in ranks[0].items() if k % 10 == 0) == 901


def test_group_limit_is_bounded():
    with pytest.raises(ValueError):
        replace(DEFAULTS, max_group_rows=1).group_limit(10**9)
