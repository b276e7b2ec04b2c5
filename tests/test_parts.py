"""Ordered tables are dealt into parts by their rows."""

import pyspark.sql.functions as F

from tidewatch.operators import ordering as O


def test_parts_grow_with_rows(spark, monkeypatch):
    from tidewatch import session

    monkeypatch.setattr(session, "PART_ROWS", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(2000).selectExpr("id AS event_id", "id AS ts_us", "concat('e', id % 400) AS entity_id")
    try:
        frame = O.order_events(rows).frame
        sizes = [r["n"] for r in frame.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert frame.rdd.getNumPartitions() == 40 and sum(sizes) == 2000 and max(sizes) < 300
        assert frame.filter("rn > 5").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
