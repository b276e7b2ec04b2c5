"""SimHash fingerprints and their near pairs, found with vantage-point trees over masked Hamming distance.

Fingerprints at most `radius` bits apart differ by at most radius // trees bits in one of `trees` disjoint bit ranges. The
distance inside a range is a metric, so each range gets a vantage-point tree: a node keeps a vantage fingerprint and the
median distance to it, and the triangle bound decides which side a fingerprint's ball can reach. The top of each tree is
grown from a bounded sample on the driver; its leaves are the shards. A fingerprint is a member of one shard of each tree
and a visitor of every later shard its ball overlaps, so each near pair meets in a shard and is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.blocks import in_blocks
from tidewatch.llm.graph import components, merge
from tidewatch.llm.store import save

#: Rows of a shard that one task compares at a time; fingerprints in the driver's sample at most; depth of a tree at most.
SHARD, SAMPLE, DEPTH = 2048, 1 << 17, 14
_SEED = 42
_ROWS = 1 << 16


def fingerprints(column: pa.Array, size: int) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, every repeat counted; no words give zero."""
    w = W.split(column, lower=True)
    n = w.count()
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(w):
        return out
    lengths = w.ends - w.starts
    solid = np.zeros(len(w.data) + 1, dtype=np.int8)
    np.add.at(solid, w.starts, 1)
    np.add.at(solid, w.ends, -1)
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    # the words joined by one space each: the byte after a word is its separator
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(begin[-1]), 32, dtype=np.uint8)
    keep = np.ones(int(begin[-1]), dtype=bool)
    keep[begin[1:] - 1] = False
    joined[keep] = w.data[inside]
    text = joined.tobytes()
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), per)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    start = w.first[:-1][doc] + (np.arange(len(doc)) - first[doc])
    last = np.minimum(start + size, w.first[1:][doc]) - 1
    s, e = begin[start], begin[last] + lengths[last]
    digest = xxhash.xxh64_intdigest
    for lo, hi in _slices(per):
        at = slice(first[lo], first[hi - 1] + per[hi - 1])
        h = np.array([digest(text[a:b], _SEED) for a, b in zip(s[at].tolist(), e[at].tolist())], dtype=np.uint64)
        some = np.flatnonzero(per[lo:hi]) + lo
        if not len(some):
            continue
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.add.reduceat(bits, first[some] - first[lo], axis=0, dtype=np.int32)
        on = total * 2 > per[some][:, None]
        out[some] = np.packbits(on, axis=1, bitorder="little").copy().view("<u8").ravel()
    return out


def _slices(per: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about _ROWS shingles each; a longer text stands alone."""
    ends = np.cumsum(per)
    lo = 0
    while lo < len(per):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _ROWS, side="right")))
        yield lo, hi
        lo = hi


def prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Columns id, fp (the fingerprint's bits as a signed long)."""

    @W.trimmed

    def run(batches):
        for b in batches:
            for lo, hi in _slices(np.full(b.num_rows, _ROWS // 64)):
                part = b.slice(lo, hi - lo)
                fp = fingerprints(part.column(1), size)
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


@dataclass
class Tree:
    """A complete binary tree in heap order; fingerprints within mu of the vantage point go left."""

    mask: int
    radius: int
    depth: int
    vantage: np.ndarray
    mu: np.ndarray

    @staticmethod
    def grow(mask: int, radius: int, depth: int, sample: np.ndarray, rng: np.random.Generator) -> Tree:
        m = np.uint64(mask)
        size = (1 << depth) - 1
        tree = Tree(mask, radius, depth, np.zeros(size, np.uint64), np.full(size, mask.bit_count() // 2, np.int16))
        parts = [sample]
        for node in range(size):
            own = parts[node]
            if len(own):
                best = None
                for v in rng.choice(own, min(4, len(own)), replace=False):
                    d = np.bitwise_count((own ^ v) & m)
                    mu = int(np.median(d))
                    cut = np.abs(np.mean(d <= mu) - 0.5) + np.mean((d > mu - radius) & (d <= mu + radius))
                    if best is None or cut < best[0]:
                        best = (cut, v, mu, d)
                _, tree.vantage[node], tree.mu[node], d = best
                parts += [own[d <= best[2]], own[d > best[2]]]
            else:
                parts += [own, own]
        return tree

    def leaf(self, fp: np.ndarray) -> np.ndarray:
        node = np.zeros(len(fp), dtype=np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((fp ^ self.vantage[node]) & np.uint64(self.mask))
            node = 2 * node + 1 + (d > self.mu[node])
        return node

    def reach(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that hold anything within the radius of them, by the triangle bound."""
        row, node = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((fp[row] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int16)
            left, right = d - self.radius <= self.mu[node], d + self.radius > self.mu[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node


def forest(classes: DataFrame, radius: int, trees: int) -> list[Tree]:
    """The tops of the trees, from a sample of at most SAMPLE fingerprints and an eighth of all."""
    n = classes.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD)))))
    sample = np.zeros(0, np.uint64)
    if depth:
        some = classes.select("fp").sample(min(0.125, 0.9 * SAMPLE / n), seed=_SEED).limit(SAMPLE).toArrow()
        sample = np.sort(some.column(0).to_numpy()).view(np.uint64)
    rng = np.random.default_rng(_SEED)
    cuts = [round(64 * k / trees) for k in range(trees + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [Tree.grow(m, radius // trees, depth, sample, rng) for m in masks]


def links(classes: DataFrame, radius: int = 4, trees: int = 3) -> DataFrame:
    """classes: id long, fp long, one row per fingerprint. Edges (a, b) that connect just what pairs within radius connect.

    A shard gives a spanning forest of its near pairs, not the pairs, so a crowd of near copies gives one edge each.
    """
    grown = classes.sparkSession.sparkContext.broadcast(forest(classes, radius, trees))

    @W.trimmed

    def route(batches):
        for b in batches:
            ids, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            bits = fp.view(np.uint64)
            for k, tree in enumerate(grown.value):
                home = tree.leaf(bits)
                row, leaf = tree.reach(bits)
                later = leaf >= home[row]
                row, leaf = row[later], leaf[later]
                at, key, side = np.concatenate([np.arange(len(ids)), row]), np.concatenate([home, leaf]), np.repeat([0, 1], [len(ids), len(row)])
                yield pa.record_batch(
                    [pa.array(key + (k << 32), pa.int64()), pa.array(side, pa.int8()), pa.array(ids[at], pa.int64()), pa.array(fp[at], pa.int64())],
                    names=["shard", "side", "id", "fp"],
                )

    def compare(t: pa.Table) -> pa.Table | None:
        ids, fp = t.column("id").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        side = t.column("side").to_numpy()
        names, inv = np.unique(ids, return_inverse=True)
        label = np.arange(len(names))
        m, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, (1 << 19) // max(1, len(m)))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            near = np.bitwise_count(fp[part][:, None] ^ fp[m][None, :]) <= radius
            i, j = np.nonzero(near & (inv[part][:, None] != inv[m][None, :]))
            label = merge(label, inv[part[i]], inv[m[j]])
        far = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[far], "b": names[label[far]]}) if len(far) else None

    routed = classes.select("id", "fp").mapInArrow(route, "shard long, side byte, id long, fp long")
    return in_blocks(save(routed), ["shard"], SHARD * 2, compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """Columns id, fp, component for every row of docs; component is the smallest id reachable by links.

    Null and wordless texts have fingerprint zero and link like any other. Rows that repeat an id count once each. A row
    with a null id keeps its fingerprint and gets the component of that fingerprint; it lends no id to it. An empty table
    gives an empty result. Other columns of docs are not touched.
    """
    every = save(prints(docs, id_col, text_col, size))
    classes = save(every.groupBy("fp").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("id", "fp"))
    found = components(links(classes, radius), "a", "b")
    of = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))
    return every.join(of, "fp", "left").select("id", "fp", "component")
