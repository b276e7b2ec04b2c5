"""Connected components: union-find inside a batch, alternating large and small stars across the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import drop, save


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]. label[x] is the smallest member of x's set, before and after."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        label = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as few edges: each id with the smallest id of its set."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merge(np.arange(len(ids)), inv[: len(a)], inv[len(a) :])
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = stars(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, component (smallest id reachable) for every id that an edge names with another id.

    Edges with a null end or two equal ends link nothing; repeated edges are one. Each round halves the depth of every
    tree, so rounds grow with the logarithm of the longest path. Hubs meet in partial sums and in joins that Spark can split.
    """
    known = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = save(known.mapInArrow(_contract, "u long, v long").distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        out = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = save(out.distinct())
        drop(now)
        now, was, mark = new, mark, _mark(new)
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
