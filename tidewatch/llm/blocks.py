"""Bounded blocks of an index side and a query side that share a key, handed to a numpy function.

A key may hold any share of the rows: members and visitors of a key beyond the limit are dealt into parts, and every part
of one meets every part of the other in a block of its own. No block is larger than two limits (in expectation).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W

MEMBER, VISITOR = 0, 1


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by keys; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in cols)
        change[0] = last is not None and head != last
        at = np.flatnonzero(change).tolist()
        begin = 0
        for cut in at:
            if cut > begin:
                held.append(b.slice(begin, cut - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(b.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, keys: list[str], limit: int, work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """rows: keys, side (MEMBER or VISITOR), id long and more columns. work gets one block, members first."""
    counts = rows.groupBy(*keys).agg(
        F.ceil(F.sum(F.when(F.col("side") == MEMBER, 1).otherwise(0)) / limit).cast("int").alias("_m"),
        F.ceil(F.sum(F.when(F.col("side") == VISITOR, 1).otherwise(0)) / limit).cast("int").alias("_v"),
    )
    crowded = counts.where("_m > 1 OR _v > 1")
    held = rows.join(crowded, keys, "left").withColumns({"_m": F.greatest(F.col("_m"), F.lit(1)), "_v": F.greatest(F.col("_v"), F.lit(1))})
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == MEMBER, F.col("_m")).otherwise(F.col("_v"))).cast("int")
    other = F.when(F.col("side") == MEMBER, F.col("_v")).otherwise(F.col("_m"))
    dealt = held.withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), other - 1))}).withColumns({
        "_pm": F.when(F.col("side") == MEMBER, F.col("_own")).otherwise(F.col("_other")),
        "_pv": F.when(F.col("side") == MEMBER, F.col("_other")).otherwise(F.col("_own")),
    })
    by = [*keys, "_pm", "_pv"]
    dealt = dealt.drop("_m", "_v", "_own", "_other").repartition(*by).sortWithinPartitions(*by, "side")

    @W.trimmed

    def run(batches):
        for t in groups(batches, by):
            out = work(t)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.mapInArrow(run, schema)
