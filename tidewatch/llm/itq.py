"""Near pairs of vectors: iterative quantisation to binary codes, multi-index Hamming tables, exact cosine at the end.

A rotation of the principal axes is learned so that signs of the rotated coordinates lose least: balanced bits whose Hamming
distance follows the angle. Codes are cut into blocks; two codes at most 2 * blocks - 1 bits apart differ by at most one bit
in some block, so a table per block, probed at the block and at each one-bit change of it, retrieves them all. Only those
pairs are compared with the original vectors, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import in_blocks
from tidewatch.llm.graph import components
from tidewatch.llm.store import save

#: Vectors that the rotation is fitted on at most; rounds of fitting; members of a table's bucket that meet in one task.
FIT_ROWS, ROUNDS, BUCKET = 20_000, 40, 2048
_BITS = 64


@dataclass
class Quantiser:
    """Codes of unit vectors: signs of (x - mean) @ axes."""

    mean: np.ndarray
    axes: np.ndarray

    @property
    def blocks(self) -> int:
        return max(1, round(self.axes.shape[1] * 6 / _BITS))

    @property
    def radius(self) -> int:
        return 2 * self.blocks - 1

    @property
    def cuts(self) -> list[int]:
        return [round(self.axes.shape[1] * k / self.blocks) for k in range(self.blocks + 1)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.axes > 0
        bits = np.zeros((len(x), _BITS), dtype=bool)
        bits[:, : on.shape[1]] = on
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()

    @staticmethod
    def fit(x: np.ndarray, dim: int) -> Quantiser:
        rng = np.random.default_rng(17)
        bits = min(dim, _BITS)
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        if len(x) < 2 * bits:
            return Quantiser(np.zeros(dim), np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :bits])
        mean = x.mean(axis=0)
        _, vectors = np.linalg.eigh(np.cov((x - mean).T).reshape(dim, dim))
        axes = vectors[:, ::-1][:, :bits]
        v = (x - mean) @ axes
        for _ in range(ROUNDS):
            b = np.where(v @ turn > 0, 1.0, -1.0)
            s, _, t = np.linalg.svd(b.T @ v)
            turn = (s @ t).T
        return Quantiser(mean, axes @ turn)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column that all have dim elements, at unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dims(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def candidates(classes: DataFrame) -> DataFrame:
    """classes: id long, label, v array<double>. Pairs a < b of one label and dimension with codes within the radius."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.select("v").sample(min(1.0, 1.2 * FIT_ROWS / max(n, 1)), seed=17).limit(FIT_ROWS).toArrow().combine_chunks()
    column = sample.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = _dims(column)
    fitted = spark.sparkContext.broadcast({int(d): Quantiser.fit(matrix(column.filter(pa.array(sizes == d)), int(d)), int(d)) for d in np.unique(sizes)})

    def probe(batches):
        for b in batches:
            dims = _dims(b.column("v"))
            for d in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == d))
                ids, space, v = (b.column(k).take(own) for k in ("id", "space", "v"))
                q = fitted.value.get(d) or Quantiser.fit(np.zeros((0, d)), d)
                code = q.codes(matrix(v, d))
                ids, space = ids.to_numpy(), space.to_numpy()
                for k, (lo, hi) in enumerate(zip(q.cuts, q.cuts[1:])):
                    part = (code >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                    flips = np.array([0, *(1 << j for j in range(hi - lo))], dtype=np.uint64)
                    keys = np.concatenate([part, (part[None, :] ^ flips[:, None]).ravel()])
                    again = len(flips) + 1
                    cols = [np.tile(space, again), np.full(len(keys), k, np.int32), keys.view(np.int64), np.repeat([0, 1], [len(ids), len(ids) * len(flips)]).astype(np.int8), np.tile(ids, again), np.tile(code.view(np.int64), again)]
                    yield pa.record_batch([pa.array(c) for c in cols] + [pa.array(np.full(len(keys), d, np.int32))], names=["space", "block", "bits", "side", "id", "code", "dim"])

    def meet(t: pa.Table) -> pa.Table | None:
        side, ids, code = t.column("side").to_numpy(), t.column("id").to_numpy(), t.column("code").to_numpy().view(np.uint64)
        k, d = t.column("block")[0].as_py(), t.column("dim")[0].as_py()
        m, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(m) or not len(p):
            return None
        q = fitted.value.get(d) or Quantiser.fit(np.zeros((0, d)), d)
        cuts, radius = q.cuts, q.radius
        found = []
        step = max(1, (1 << 20) // len(m))
        for lo in range(0, len(p), step):
            part = p[lo : lo + step]
            x = code[part][:, None] ^ code[m][None, :]
            i, j = np.nonzero((ids[part][:, None] < ids[m][None, :]) & (np.bitwise_count(x) <= radius))
            apart = x[i, j]
            first = np.ones(len(i), dtype=bool)  # a pair counts in the first block that brings it together
            for b in range(k):
                first &= np.bitwise_count((apart >> np.uint64(cuts[b])) & np.uint64((1 << (cuts[b + 1] - cuts[b])) - 1)) > 1
            found.append((ids[part[i[first]]], ids[m[j[first]]]))
        a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
        return pa.table({"a": a, "b": b}) if len(a) else None

    probes = classes.select("id", F.xxhash64("label", F.size("v")).alias("space"), "v").mapInArrow(probe, "space long, block int, bits long, side byte, id long, code long, dim int")
    return in_blocks(save(probes), ["space", "block", "bits"], BUCKET, meet, "a long, b long")


def cosine_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of classes of one label whose cosine is at least threshold."""
    left = classes.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"))
    right = classes.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    pairs = candidates(classes).join(left, "a").join(right, "b").where("la = lb").select("a", "b", "va", "vb")

    def rerank(batches):
        for b in batches:
            dims = _dims(b.column("va"))
            for d in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                near = (matrix(part.column("va"), d) * matrix(part.column("vb"), d)).sum(axis=1) >= threshold
                yield pa.record_batch([part.column(k).filter(pa.array(near)) for k in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(rerank, "a long, b long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Columns id, n_links, component, kept for every row: links join vectors of one label with cosine >= threshold.

    Vectors link only if their labels are equal and not null and their dimensions agree. Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing. Equal vectors of a label are compared as one and count as
    links of each other. A row with a null id links with nothing and has no component; its kept is null. An empty table
    gives none. Pairs travel only if their codes are near, so what is moved follows the number of links.
    """
    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND x > double('-inf') AND x < double('inf')) AND exists(v, x -> x <> 0)"
    good = flat.where(fine)
    classes = save(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "label", "v", "n"))
    links = save(cosine_links(classes, threshold))
    both = links.union(links.select("b", "a")).toDF("id", "other")
    sizes = classes.select(F.col("id").alias("other"), "n")
    linked = both.join(sizes, "other").groupBy("id").agg(F.sum("n").alias("far"))
    found = components(links, "a", "b").withColumnRenamed("node", "id")
    told = classes.join(linked, "id", "left").join(found, "id", "left").select(
        "label", "v", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    sure = good.join(told, ["label", "v"]).select("id", "n_links", "component")
    alone = flat.where(f"NOT coalesce({fine}, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return sure.unionByName(alone).withColumn("kept", F.col("id") == F.col("component"))
