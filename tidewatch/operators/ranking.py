"""Exact global ranks, prefix sums and quantiles without ever sorting a table in one task.

Rows are dealt into order-preserving buckets by a range partitioning, written once with the number of
their bucket (Spark's sample steers only the sizes of the buckets; every result is exact). Bucket
totals, of which there are at most a few thousand, give each bucket's offset; inside a bucket a
plain window does the rest. Ties on the score are separated by the id, so one popular score
cannot make a bucket large. Null and NaN scores rank last, in either direction. Buckets hold about
BUCKET_ROWS rows until there are MAX_BUCKETS of them; beyond that they grow with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

BUCKET_ROWS = 500_000
MAX_BUCKETS = 4096


def ranked(
    df: DataFrame, score: str, id: str, sums: dict[str, str] | None = None, ascending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds ``rank`` (1 = first) by (score, id ascending) and, per SQL expression in ``sums``, its
    running total up to and including the row."""
    sums = sums or {}
    value = F.col(score).cast("double")
    last = value.isNull() | F.isnan(value)
    keyed = df.withColumn("_s", F.when(last, float("inf")).otherwise(value * (1 if ascending else -1))).withColumn("_i", F.col(id))
    buckets = min(MAX_BUCKETS, math.ceil(df.count() / bucket_rows))
    if buckets > 1:
        keyed = settle(keyed.repartitionByRange(buckets, "_s", "_i").withColumn("_b", F.spark_partition_id()))
    else:
        keyed = keyed.withColumn("_b", F.lit(0))
    within = Window.partitionBy("_b").orderBy("_s", "_i")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("rank", F.row_number().over(within).cast("bigint"))
    out = out.withColumns({n: F.sum(F.expr(x)).over(upto) for n, x in sums.items()})
    if buckets > 1:
        per = keyed.groupBy("_b").agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(F.expr(x)).alias(f"_t_{n}") for n, x in sums.items()]
        )
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= MAX_BUCKETS rows
        offs = per.select(
            "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        )
        out = out.join(F.broadcast(offs), "_b").withColumn("rank", F.col("rank") + F.col("_o"))
        out = out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
        out = out.drop("_o", *[f"_o_{n}" for n in sums])
    return out.drop("_s", "_i", "_b")


def quantiles(df: DataFrame, value: str, probs: list[float], bucket_rows: int = BUCKET_ROWS) -> list[float | None]:
    """Exact linear-interpolated quantiles of a whole column; equal values are merged first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(probs)
    pos = ranked(counts.withColumn("one", F.lit(0)), "v", "one", {"upto": "n"}, ascending=True, bucket_rows=bucket_rows)
    wanted = sorted({f(p * (total - 1)) for p in probs for f in (math.floor, math.ceil)})
    hit = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")))
    rows = pos.select("v", F.explode(hit).alias("w")).collect()  # at most two rows per quantile
    at = {r["w"]: r["v"] for r in rows}
    out = []
    for p in probs:
        x = p * (total - 1)
        lo, hi = math.floor(x), math.ceil(x)
        out.append(at[lo] + (at[hi] - at[lo]) * (x - lo))
    return out
