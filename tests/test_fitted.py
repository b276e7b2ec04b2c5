"""Fitting and scoring take no more than they need: exchanges, cuts, tuning."""

import re

from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.catalog.features import WIDE
from tidewatch.operators import cohorts as CO
from tidewatch.operators import corpus as C
from tidewatch.operators import profiles as P
from tidewatch.operators import risk as RI
from tidewatch.operators.features import Knowledge, featurise
from tidewatch.session import settle


def test_wide_rows_are_dealt_once(spark, events, monkeypatch):
    """Joins by entity and event, block or type keep the parts of the entity, and cohorts are summed without cuts."""
    monkeypatch.setattr(session, "PART_ROWS", 50)
    know = Knowledge(corpus=C.fit_corpus(events), cohorts=CO.fit_cohorts(settle(P.entity_profiles(events, dims=CO.DIMS))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        plan = featurise(events, WIDE, know)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert keys and {k.rsplit(", ", 1)[0] for k in keys} <= {"entity_id", "_of_entity_id", "entity_id, slice, blk"}
    assert sum("REPARTITION_BY_NUM" in line for line in plan.splitlines()) < 6 and plan.count("FlatMapGroupsInPandas") == 1


def test_cuts_are_sought_where_a_dimension_is_crowded(spark, events):
    held = {r.dim: r.n for r in P.value_counts(events, ["split"]).groupBy("dim").agg(F.countDistinct("value").alias("n")).collect()}
    want = tuple(d for d in P.DIMS if held.get(d, 0) > WIDE.top_values.get(d, 1 << 40))
    got = P.crowded(events, tuple(WIDE.top_values), WIDE)
    assert sorted(got) == sorted(want) and "resource" in got and "country" not in got
    few = events.filter("resource_accessed LIKE '%/1'")  # nothing is crowded: columns of cuts stay, empty
    names = ("resource_likelihood", "country_likelihood", "window_foreign_resource_ratio")
    assert P.crowded(few, ("resource", "country"), WIDE) == ()
    alone = {r.event_id: r.resource_likelihood for r in featurise(few, WIDE, names=names[:1]).collect()}
    both = featurise(few, WIDE, names=names).collect()
    assert len(both) == len(alone) > 20 and all(alone[r.event_id] == r.resource_likelihood for r in both)


def test_keys_of_batches_are_those_of_sql(spark):
    rows = spark.range(4000).selectExpr("rand(1) AS baseline", "round(rand(2), 9) AS sequence", "if(id % 9 = 0, null, if(id % 11 = 0, double('NaN'), rand(3))) AS classifier", "1 AS n", "id % 2 AS y").localCheckpoint()
    w, shift = (0.35, 0.05, 0.6000000000000001), 20
    key = RI._fused_key("baseline", "sequence", "classifier", *[f"{x!r}D" for x in w])
    want = rows.selectExpr(f"shiftright({key}, {shift}) AS head", f"shiftright({key}, {shift - 10}) & 1023 AS digit", "n", "y").filter("head = 700").groupBy("digit").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    got = RI._digits(rows, "n", "y", {5: (w, 700)}, shift).groupBy("digit").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
