from tidewatch.operators import risk as RI
from tidewatch.operators.ranking import ranked


def test_the_plan_of_ranks_does_not_grow_with_their_buckets(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 700 AS double) AS s")
    few, many = (ranked(df, "s", "id", {"n": "1"}, bucket_rows=b) for b in (2000, 20))
    size = [len(x._jdf.queryExecution().analyzed().toString()) for x in (few, many)]
    assert size[1] < 1.1 * size[0]
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_weight_tuning_looks_at_tied_rows_for_their_weights_only(spark, monkeypatch):
    """Missing scores included; hits as a plain ranking of all rows by fused score and id gives them."""
    import math

    rows = [(i, i * 7 % 20 / 20, None if i % 50 == 49 else i * 11 % 16 / 16, i * 13 % 101 / 100, int(i % 9 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, baseline double, sequence double, classifier double, y int")
    seen, inner = [], RI._budget_hits
    monkeypatch.setattr(RI, "_budget_hits", lambda rows, *a: seen.append(rows.count()) or inner(rows, *a))
    got = {r.g: r.hits for r in RI.tune_weights(df, 0.05).collect()}
    assert len(seen) == 2 and seen[1] < len(rows) * len(RI.weight_grid()) / 20

    for g, (wb, wq, wc) in enumerate(RI.weight_grid()):
        fused = lambda r: -math.inf if r[2] is None else round(wb * r[1] + wq * r[2] + wc * r[3], 9)
        top = sorted(rows, key=lambda r: (-max(0.0, fused(r)), r[0]))[:150]
        assert got[g] == sum(r[4] for r in top), g
