"""Every registered query runs on the tiny scale where cheap, and twins agree with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "scan_access_events", "quarantined_events", "travel_between_events", "features_profile", "features_foreign_resources",
    "snapshot_topk_cuts", "completed_sessions", "rules_fired", "static_drift", "campaign_kill_chains", "feedback_audit",
    "recall_at_budget", "ranking_quality", "weight_grid_search", "features_with_priors", "sequence_surprise",
)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def canon(rows):
    def cell(v):
        if v is None or v != v:
            return ""
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(str(cell(v)) for v in r) for r in rows))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, tiny, duck, name):
    df = entry.queries()[name](spark, tiny)
    cols = sorted(df.columns)
    got = canon(df.select(*cols).toPandas().astype(object).values.tolist())
    frame = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(frame.columns) == cols
    assert got == canon(frame[cols].astype(object).values.tolist()) and got


def test_registry_shape():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100 and len(o) > 90


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_explanations_add_up_and_never_raise_risk(spark, tiny):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F
    from tidewatch.catalog import models as M
    from tidewatch.config import ANOMALY_CLASSES
    from tidewatch.operators import explain as X

    state, alerts = M._alerts(spark, tiny)
    assert alerts.count() > 5 and len(M.INPUTS) == 68 and all(len(r.row_array) == 68 for r in alerts.select("row_array").collect())
    attr = X.attributions(alerts, state.classifier, M.INPUTS)
    total = {r.event_id: r.s for r in attr.groupBy("event_id").agg(F.sum("contribution").alias("s")).collect()}
    zero = alerts.withColumn("row_array", F.expr("transform(row_array, x -> 0D)"))

    def p(df):
        """The forest's probability of each alert's class, before calibration."""
        out = state.classifier.model.transform(df.select("event_id", "anomaly_type", array_to_vector("row_array").alias("row")))
        names = {c: i for i, c in enumerate(ANOMALY_CLASSES)}
        return {r.event_id: (r.v + [0.0] * 9)[names[r.anomaly_type]] for r in out.select("event_id", "anomaly_type", vector_to_array("probability").alias("v")).collect()}

    full, none = p(alerts), p(zero)
    assert set(total) == set(full) and all(abs(total[e] - (full[e] - none[e])) < 1e-9 for e in total)
    cf = X.counterfactual(alerts, attr, state.classifier, state.risk, M.INPUTS, 59).collect()
    assert all(r.resulting_risk <= r.original_risk and len(r.changes) <= 4 for r in cf)
    told = entry.queries()["alert_explanations"](spark, tiny).collect()
    assert len(told) == len(total) and all(len(r.leading) == 6 and r.narrative and r.counterfactual and r.commands for r in told)
