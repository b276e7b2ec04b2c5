"""Quality grades by ordinal regression: one set of weights over hashed text features, ordered thresholds between grades.

P(grade <= k) = sigmoid(threshold_k - w . x). A text's features are its words, their last three bytes, and the bands its
overall figures fall into (length of words, repeats, symbols, capitals, line lengths), hashed into 2 ** BITS places, damped
by the logarithm and scaled to unit length, each kind on its own.

The fit sees at most FIT_ROWS labelled ids (in order of a hash of the id), each with its smallest text: the documented bound of
what reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W

FIT_ROWS, BITS, ROUNDS, RIDGE = 12_000, 16, 150, 3e-4
_BANDS = 12


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all rows' features, in order of row."""
    n = w.count()
    rows = np.arange(len(n))
    h = w.hashes()
    data = w.data.astype(np.uint64) + np.uint64(1)
    tail = W.mix(W.span_hash(data, np.maximum(w.ends - 3, w.starts), w.ends) + np.uint64(3))
    kinds = [_counted(w.doc, h), _counted(w.doc, tail)]
    length = w.ends - w.starts
    many = np.maximum(n, 1)
    size = np.bincount(w.doc, weights=length, minlength=len(n))
    symbol = _per_row(w, ((w.data > 32) & (w.data < 48)) | ((w.data > 57) & (w.data < 65)) | ((w.data > 90) & (w.data < 97)) | ((w.data > 122) & (w.data < 127)))
    upper = _per_row(w, (w.data > 64) & (w.data < 91))
    digit = _per_row(w, (w.data > 47) & (w.data < 58))
    key = W.mix(h + W.mix(w.doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(w.doc[first], minlength=len(n))
    pair = W.mix(key[1:] * np.uint64(W.BASES[1]) + key[:-1])[w.doc[1:] == w.doc[:-1]] if len(key) > 1 else key[:0]
    held = w.doc[1:][w.doc[1:] == w.doc[:-1]] if len(key) > 1 else w.doc[:0]
    _, first = np.unique(pair, return_index=True)
    pairs = np.bincount(held[first], minlength=len(n)) / np.maximum(n - 1, 1)
    figures = [size / many / 16, distinct / many, pairs, symbol / np.maximum(size, 1), upper / np.maximum(size, 1) * 2, digit / np.maximum(size, 1) * 2, np.log1p(n) / 12]
    bands = [np.minimum((f * _BANDS).astype(np.int64), _BANDS) + 100 * k for k, f in enumerate(figures, 1)]
    kinds += [(rows, W.mix(b.astype(np.uint64) + np.uint64(1 << 40)), np.ones(len(n))) for b in bands]
    row, place, value = (np.concatenate([k[i] for k in kinds]) for i in range(3))
    order = np.argsort(row, kind="stable")
    return row[order], (place[order] >> np.uint64(64 - BITS)).astype(np.int64), value[order]


def _per_row(w: W.Words, on: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(on)])
    return np.bincount(w.doc, weights=total[w.ends] - total[w.starts], minlength=len(w.first) - 1)


def _counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes with log(1 + count), scaled to unit length."""
    if not len(h):
        return doc, h, np.zeros(0)
    _, first, count = np.unique(W.mix(h + W.mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    row, value = doc[first], np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value * value))
    return row, h[first], value / norm[row]


@dataclass
class Model:
    weight: np.ndarray
    threshold: np.ndarray

    def tails(self, w: W.Words) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one row per text."""
        row, place, value = features(w)
        x = np.bincount(row, weights=self.weight[place] * value, minlength=len(w.first) - 1)
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - x[:, None], -500, 500)))


def train(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Penalised maximum likelihood by full-gradient Adam steps; thresholds stay ordered as a start and positive gaps."""
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(1 << BITS), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    w_at, t_at = slice(0, 1 << BITS), 1 << BITS
    for step in range(1, ROUNDS + 1):
        t = p[t_at] + np.concatenate([[0.0], np.cumsum(np.exp(p[t_at + 1 :]))])
        x = np.bincount(row, weights=p[place] * value, minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = (1 / (1 + np.exp(np.clip(x - edge[grade + k], -500, 500))) for k in (1, 0))
        prob = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g = np.zeros_like(p)
        g[w_at] = np.bincount(place, weights=(slope_hi - slope_lo)[row] * value, minlength=1 << BITS) / n + RIDGE * p[w_at]
        of_t = np.array([slope_lo[grade == k + 1].sum() - slope_hi[grade == k].sum() for k in range(grades - 1)]) / n
        g[t_at] = of_t.sum()
        g[t_at + 1 :] = np.exp(p[t_at + 1 :]) * np.cumsum(of_t[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(p[w_at], p[t_at] + np.concatenate([[0.0], np.cumsum(np.exp(p[t_at + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str, text_col: str, grade_col: str) -> Model | None:
    """None where fewer than two grades occur among the rated rows."""
    sc = docs.sparkSession.sparkContext
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, grades - 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(grade_col).cast("int").alias("g"))
    drawn = rated.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    ids, g = drawn.column("id").to_numpy(), drawn.column("g").to_numpy()
    order = np.argsort(ids)
    known = sc.broadcast((ids[order], g[order]))

    def run(batches):
        ids, g = known.value
        for b in batches:
            own = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            fine = (ids[at] == own) & ~np.asarray(b.column(0).is_null()) if len(ids) else np.zeros(len(own), bool)
            rows, grade = b.filter(pa.array(fine)), g[at[fine]] if len(ids) else own[:0]
            lo = 0
            for piece in W.pieces(rows, 1):
                row, place, value = features(W.split(piece.column(1)))
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(grade[lo : lo + piece.num_rows], pa.int32()), pa.ListArray.from_arrays(pa.array(cut), pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32)))],
                    names=["g", "place", "value"],
                )
                lo += piece.num_rows

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids.tolist()], "id long")  # FIT_ROWS ids at most
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("t").alias("t"))  # one row an id, however often it stands
    got = texts.mapInArrow(run, "g int, place array<int>, value array<float>").toArrow().combine_chunks()
    grade = got.column("g").to_numpy()
    if len(np.unique(grade)) < 2:
        return None
    place, value = (got.column(c).combine_chunks() for c in ("place", "value"))
    place = place.chunk(0) if isinstance(place, pa.ChunkedArray) else place
    value = value.chunk(0) if isinstance(value, pa.ChunkedArray) else value
    row = np.repeat(np.arange(len(grade)), place.value_lengths().to_numpy())
    return train(row, place.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64), grade, grades)


def grade(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> DataFrame:
    """docs with expected_grade (0 to grades - 1) and tail_probability (of the highest grade); such columns are replaced.

    Null, empty and wordless texts are graded by their figures alone. Of several ratings of an id the lowest holds; null
    ids and grades teach nothing. If fewer than two grades are rated, both columns are null. Every other column stays. Texts
    are read whole. An empty table gives none.
    """
    new = ("expected_grade", "tail_probability")
    rest = [c for c in docs.columns if c not in new]
    model = fit(docs, ratings, grades, id_col, text_col, grade_col)
    if model is None:
        return docs.select(*rest, *(F.lit(None).cast("double").alias(c) for c in new))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = rest.index(text_col)

    def run(batches):
        for b in batches:
            for piece in W.pieces(b, at):
                tails = shared.value.tails(W.split(piece.column(at)))
                yield pa.record_batch([*piece.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*rest, *new])

    return docs.select(*rest).mapInArrow(run, docs.select(*rest, *(F.lit(0.0).alias(c) for c in new)).schema)


def graded(labels: DataFrame, quality: Column, toxic: Column) -> DataFrame:
    """A grade of 0 to 2 from two marks: 2 for good and harmless, one less for each fault; null marks give none."""
    return labels.withColumn("grade", (quality + (1 - toxic)).cast("int"))
