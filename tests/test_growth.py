"""Work of the profile and cohort steps a row, without the rest of what could be asked."""

from dataclasses import replace

import pyspark.sql.functions as F

from tidewatch.catalog import models, state
from tidewatch.catalog.features import WIDE
from tidewatch.operators import cohorts as CO
from tidewatch.operators import corpus as C
from tidewatch.operators import profiles as P
from tidewatch.operators import rules as RU
from tidewatch.operators.features import Knowledge, featurise
from tidewatch.session import settle


def test_cohorts_do_not_hang_on_the_layout(spark, events):
    rows = settle(P.entity_profiles(events.withColumn("entity_id", F.col("session_id")), dims=CO.DIMS))
    laid = [rows.coalesce(1).sort("entity_id"), rows.repartition(7, "event_count"), rows.coalesce(1).sort(F.desc("entity_id"))]
    fits = [[[round(x, 6) for x in c] for c in CO.fit_cohorts(r, replace(WIDE, cohort_min_events=3)).centroids] for r in laid]
    assert fits[0] == fits[1] == fits[2] and len(fits[0]) == 6


def test_cohorts_are_judged_once_a_block(events):
    model = CO.fit_cohorts(P.entity_profiles(events, dims=CO.DIMS), replace(WIDE, cohort_min_events=1))
    plans = []
    for s in (WIDE, replace(WIDE, max_group_rows=60)):
        f = featurise(events, s, Knowledge(cohorts=model), ("cold_start",)).select("event_id", "c_cohort")
        plans.append(f._jdf.queryExecution().optimizedPlan().toString())
        rows = sorted(tuple(r) for r in f.collect())
        assert len(rows) == 1000 and (s is WIDE or rows == first)
        first = rows
    assert all("sum(" in p and "_in_h9" in p for p in plans)


def test_asked_distributions_only(events):
    all_dims, some = P.entity_profiles(events), P.entity_profiles(events, dims=("country", "hour"))
    assert [c for c in some.columns if c.startswith("d_")] == ["d_country", "d_hour"]
    asked = ["entity_id", "event_count", "spread_km"]
    maps = [f"array_sort(map_entries(d_{d})) AS {d}" for d in ("country", "hour")]
    assert sorted(map(str, some.selectExpr(*asked, *maps).collect())) == sorted(map(str, all_dims.selectExpr(*asked, *maps).collect()))


def test_limited_and_other_distributions_share_one_count(events):
    counts = P.value_counts(events, ["entity_id"])
    shares = P.top_shares(counts, ["entity_id"])
    shares.collect()
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_features_are_held_against_the_corpus_only(events):
    corpus = C.fit_corpus(events)
    assert "Aggregate" not in _plan(corpus.counts)  # counted once, not by each join
    f = featurise(events, WIDE, Knowledge(corpus=corpus), ("seq_ngram_novelty_global", "resource_global_rarity"))
    assert "FlatMapGroupsInPandas" not in _plan(f) and "cut_n" not in _plan(f)


def test_rule_features_look_at_their_own_columns(events):
    f = featurise(events, WIDE, names=RU.RULE_FEATURES)
    assert "ngram" not in _plan(f.drop("tokens")) and "first_rn_resource" not in _plan(f)


def test_fewer_names_give_the_same_values(events):
    know = Knowledge(corpus=C.fit_corpus(events))
    groups = (RU.RULE_FEATURES, ("seq_ngram_novelty_global", "seq_token_rarity_global", "sequence_length"), ("window_bytes_out_ratio",))
    names = [n for g in groups for n in g]
    whole = {r["event_id"]: r for r in featurise(events, WIDE, know).select("event_id", *names).collect()}
    for g in groups:
        rows = featurise(events, WIDE, know, g).select("event_id", *g).collect()
        assert len(rows) == len(whole) and all(r[n] == whole[r["event_id"]][n] for r in rows for n in g)


def test_shrunk_keeps_the_distributions_asked_for(spark, tiny):
    f = state.shrunk_toward_prior(spark, tiny)
    assert "substring_index" not in _plan(f) and "command_sequence" not in _plan(f) and f.count() > 10


def test_stored_profiles_hold_what_features_ask_for(spark, tiny):
    for f in (models.features_stored_profile(spark, tiny), models.features_with_priors(spark, tiny)):
        assert "substring_index" not in _plan(f) and f.count() > 300
