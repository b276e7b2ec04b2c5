"""Hard negatives of anchors: candidate lists shared by a cluster of anchors, in the order of an angular upper bound.

Anchors come in blocks of bounded size. A block's anchors are clustered by angle; every task sorts its candidates once for
each cluster by |x| * cos(max(0, angle(x, centre) - the cluster's widest angle)), which no member of the cluster can exceed
(after scaling by its own length). Each member walks that list and stops where the bound of all that follows is certainly
below what it has. Tasks return their first few; the first few of all tasks are the first few of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import save

#: Bytes of anchor vectors sent at a time; candidates compared at once; rows of vectors a task sorts at a time.
BLOCK_BYTES, STEP, HELD = 16 << 20, 512, 65_536
_LONG = 1 << 63


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: in doubles where they hold all sums, else in longs; ValueError beyond."""
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    top = int(np.abs(a).max()) * int(np.abs(x).max()) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top >= _LONG:
        raise ValueError("inner products do not fit into a long")
    return a @ x.T


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(_lengths(x), 1e-300)[:, None]


class Anchors:
    """A block of anchors of one dimension, with clusters of them by angle."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scores: list | None = None):
        self.ids, self.labels, self.x, self.scores = ids, labels, x, scores
        unit = _unit(x)
        k = max(1, int(np.sqrt(len(x))))
        centres = unit[np.random.default_rng(5).permutation(len(x))[:k]]
        for _ in range(6):
            of = (unit @ centres.T).argmax(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, of, unit)
            centres = np.where(_lengths(total)[:, None] > 0, _unit(total), centres)
        of = (unit @ centres.T).argmax(axis=1)
        self.clusters = []
        for c in range(k):
            own = np.flatnonzero(of == c)
            if len(own):
                wide = np.arccos(np.clip(unit[own] @ centres[c], -1, 1)).max() if _lengths(x[own]).min() > 0 else np.pi
                self.clusters.append((centres[c], wide, own))
        self.length = _lengths(x)

    def lists(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each cluster: its members, all candidates by falling bound, and the bounds for a member of length one."""
        unit, length = _unit(x), _lengths(x)
        for centre, wide, own in self.clusters:
            angle = np.arccos(np.clip(unit @ centre, -1, 1))
            bound = length * np.cos(np.maximum(0, angle - wide)) + (length * 1e-9 + 1e-9)  # room for rounding
            order = np.argsort(-bound, kind="stable")
            yield own, order, bound[order]


def _first(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row that come first by score (falling), then id."""
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    lead = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(lead, np.diff(np.append(lead, len(rows))))
    few = rank < k
    return rows[few], cols[few], score[few]


def _walk(a: Anchors, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, want: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None, k: int):
    """(place in want or anchor, candidate, score) of the first k for each walker.

    want None: walkers are the anchors, looking for candidates of their label. Else want holds arrays (anchor, low, high): each
    walker looks for candidates of other labels with low <= 100 * score <= high.
    """
    out = []
    for own, order, bound in a.lists(x):
        if want is None:
            who, at = own, own
        else:
            who = np.flatnonzero(np.isin(want[0], own))
            at = want[0][who]
        have = (np.zeros(0, np.int64),) * 3
        least = np.full(len(who), -np.inf)  # the k-th score so far
        live = np.arange(len(who))
        for lo in range(0, len(order), STEP):
            reach = bound[lo] * a.length[at[live]]
            stay = reach >= least[live]
            if want is not None:
                stay &= 100 * reach >= want[1][who[live]]
            live = live[stay]
            if not len(live):
                break
            part = order[lo : lo + STEP]
            one, inverse = np.unique(at[live], return_inverse=True)
            score = _products(a.x[one], x[part])[inverse]
            same = a.labels[at[live]][:, None] == labels[part][None, :]
            fits = (same if want is None else ~same & (100 * score >= want[1][who[live]][:, None]) & (100 * score <= want[2][who[live]][:, None])) & (a.ids[at[live]][:, None] != ids[part][None, :])
            fits &= score >= least[live][:, None]
            r, c = np.nonzero(fits)
            have = _first(np.concatenate([have[0], live[r]]), np.concatenate([have[1], part[c]]), np.concatenate([have[2], score[r, c]]), ids, k)
            full = np.bincount(have[0], minlength=len(who)) >= k
            last = np.full(len(who), np.inf)
            np.minimum.at(last, have[0], have[2].astype(np.float64))
            least = np.where(full, last, -np.inf)
        out.append((who[have[0]], have[1], have[2]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HELD:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _of_dim(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    t = t.filter(pa.array(t.column("dim").to_numpy() == dim)).combine_chunks()
    if not t.num_rows:
        return None
    column = t.column("v").chunk(0)
    return t.column("id").to_numpy(), t.column("label").to_numpy(), _vectors(column, dim)


def _searched(rows: DataFrame, anchors: list[Anchors], k: int, bands: bool) -> DataFrame:
    """First k of each task's candidates for every walker: columns anchor, positive (null without bands), positive_score, id, score."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        for t in _blocks(batches):
            for a in sent.value:
                some = _of_dim(t, a.x.shape[1])
                if some is None:
                    continue
                ids, labels, x = some
                want = (a.scores[0], 50 * a.scores[2], 95 * a.scores[2]) if bands else None
                who, cand, score = _walk(a, ids, labels, x, want, k)
                anchor = a.ids[a.scores[0][who]] if bands else a.ids[who]
                positive = pa.array(a.scores[1][who]) if bands else pa.nulls(len(who), pa.int64())
                ps = pa.array(a.scores[2][who]) if bands else pa.nulls(len(who), pa.int64())
                yield pa.record_batch([pa.array(anchor), positive, ps, pa.array(ids[cand]), pa.array(score)], names=["anchor", "positive", "positive_score", "id", "score"])

    return rows.mapInArrow(run, "anchor long, positive long, positive_score long, id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 3, id_col: str = "id", label_col: str = "label", vector_col: str = "v") -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label and array<long> vectors; is_anchor: condition on them. Scores are integer inner products, higher first,
    ties by smaller id. An anchor's positives are its first n_positives rows of the same label; for each, the negatives are
    the first n_negatives rows of other labels with 50 * positive_score <= 100 * negative_score <= 95 * positive_score.

    Rows with a null id, label, vector or component take no part; of rows with one id the first by label, then vector,
    stands. A row is never its own positive. Vectors meet only those of their dimension; empty ones meet none. Anchors
    without positives, and positives without negatives in the band, give no rows; an empty table gives none. Scores must
    fit into a long (ValueError otherwise). Other columns are not read.
    """
    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    good = flat.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL)")
    one = good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("anchor").alias("anchor"))
    table = save(one.select("id", "r.label", "r.v", F.size("r.v").alias("dim"), "anchor"))
    anchors, candidates = table.where("anchor"), table.select("id", "label", "v", "dim")
    out = None
    for block in _anchor_blocks(anchors):
        groups = _grouped(block)
        top = _ranked(_searched(candidates, groups, n_positives, False), ["anchor"], n_positives)
        positives = top.select("anchor", "id", "score").toArrow()  # n_positives for each anchor of a block
        groups = _with_scores(groups, positives)
        found = _ranked(_searched(candidates, groups, n_negatives, True), ["anchor", "positive"], n_negatives)
        part = save(found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _anchor_blocks(anchors: DataFrame) -> Iterator[pa.Table]:
    """The anchors, some at a time: parts by a hash of the id, so many that a part holds about BLOCK_BYTES of vectors."""
    size = anchors.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    for k in range(parts):
        own = anchors if parts == 1 else anchors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        yield own.select("id", "label", "v", "dim").toArrow()


def _grouped(block: pa.Table) -> list[Anchors]:
    dims = np.unique(block.column("dim").to_numpy()).tolist()
    return [Anchors(*_of_dim(block, d)) for d in dims]


def _with_scores(groups: list[Anchors], positives: pa.Table) -> list[Anchors]:
    """Each anchor's place, positive and score, for the second walk; anchors without positives walk no more."""
    who, ids, score = (positives.column(c).to_numpy() for c in ("anchor", "id", "score"))
    for a in groups:
        order = np.argsort(a.ids)
        at = np.minimum(np.searchsorted(a.ids[order], who), len(order) - 1)
        own = a.ids[order[at]] == who
        keep = own & (np.abs(score) < _LONG // 128)
        if (own & ~keep).any():
            raise ValueError("scores are too large to be compared as whole percentages")
        a.scores = (order[at[keep]], ids[keep], score[keep])
    return groups
