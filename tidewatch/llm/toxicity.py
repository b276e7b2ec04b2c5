"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Toxic and ordinary texts each have a bigram model over one vocabulary: words, and for rarer words the bytes they begin with,
so that forms of one stem count together. A class's bigrams back off to the number of different
words that a word follows in that class, and those to the number in both, so what only copies of one text repeat weighs
little, and an expression too rare to tell the classes apart is about as likely
under either. A text is judged by differences of log-likelihood per word: of the whole text and of its worst short windows,
put together by a logistic fit on labelled rows that the counts leave out (one in FOLDS).

Counts cover all labelled rows that are not left out. Words, stems and bigrams enter the model if they stand in at least
MIN_TEXTS of these texts, whatever their number. The model is two tables, one row for each unit and for each bigram; up to
BROADCAST rows together are sent to every worker, more stay tables and each piece of text joins the rows it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.lookup import asked, meet, numbered
from tidewatch.llm.store import drop, save

#: Labels and rows of the model that are broadcast at most; least number of labelled texts; rows that the logistic fit sees at
#: most; window lengths in words; words gathered before a task sends counts.
LABELS, BROADCAST, MIN_TEXTS, FIT_ROWS, WINDOWS, FLUSH = 1_000_000, 4_000_000, 3, 50_000, (1, 4, 16, 64), 1 << 20
FOLDS = 5
#: Bytes from a word's beginning that stand for it if it is rare, longest first.
STEMS = (7, 6, 5, 4)
#: A ratio learnt from n texts or contexts weighs n / (n + TRUST) against no evidence, or against the backoff for a bigram.
TRUST = 10.0
#: Ratio from which a word is strong evidence; features of a text.
STRONG = 1.5
FEATURES = 3 + len(WINDOWS)


@dataclass
class Model:
    """Log-likelihood ratios of words (index 0: all rare words), of contexts, and of the bigrams kept."""

    vocabulary: np.ndarray
    word: np.ndarray
    context: np.ndarray
    keys: np.ndarray
    bigram: np.ndarray

    @staticmethod
    def of(unit: pa.Table, pair: pa.Table) -> Model:
        """unit: h (0 for all rare words), word, context. pair: left, right, ratio. Rows that repeat a key are equal."""
        h, first = np.unique(unit.column("h").to_numpy().view(np.uint64), return_index=True)
        word, context = (unit.column(c).to_numpy()[first] for c in ("word", "context"))
        left, right = (np.searchsorted(h, pair.column(c).to_numpy().view(np.uint64)).astype(np.int64) for c in ("left", "right"))
        keys, at = np.unique(left << 32 | right, return_index=True)
        return Model(h[1:], word, context, keys, pair.column("ratio").to_numpy()[at])

    def features(self, column: pa.Array) -> np.ndarray:
        """Per row: mean ratio of the whole text, logarithms of its strong evidence in all and per hundred words, and the
        largest mean over windows of each length."""
        w = W.split(column, lower=True, marks=True)
        n = w.count()
        out = np.zeros((len(n), FEATURES))
        if not len(w):
            return out
        at = places(units(w), self.vocabulary)
        before = shifted(at, w)
        ratio = self.word[at] + self.context[before]
        if len(self.keys):
            key = before << 32 | at
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ratio = np.where(self.keys[place] == key, self.bigram[place], ratio)
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        some = np.flatnonzero(n)
        begin, end = w.first[:-1][some], w.first[1:][some]
        out[some, 0] = (total[end] - total[begin]) / n[some]
        strong = np.add.reduceat(np.maximum(ratio - STRONG, 0), begin)
        out[some, 1], out[some, 2] = np.log1p(strong), np.log1p(100 * strong / n[some])
        for k, size in enumerate(WINDOWS, 3):
            stop = np.minimum(np.arange(len(at)) + size, w.first[1:][w.doc])
            start = np.maximum(stop - size, w.first[:-1][w.doc])
            out[some, k] = np.maximum.reduceat((total[stop] - total[start]) / size, begin)
        return out


@dataclass
class Tables:
    """The same model as tables of what Model.of takes.

    A unit also says by which bits (the six lowest of a unit's hash) its kept bigrams end (follows) and begin (precedes), so that
    a piece asks only for bigrams that both of their units may know.
    """

    unit: DataFrame
    pair: DataFrame

    def signed(self) -> Tables:
        def bits(own: str, other: str, name: str) -> DataFrame:
            return self.pair.groupBy(F.col(own).alias("h")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({other} & 63 AS int))")).alias(name))

        unit = self.unit.join(bits("left", "right", "follows"), "h", "left").join(bits("right", "left", "precedes"), "h", "left")
        return Tables(save(unit.fillna(0, ["follows", "precedes"])), self.pair)

    @staticmethod
    def of(found: pa.Table) -> Model:
        kind = found.column("kind").to_numpy()
        part = [found.filter(pa.array(kind == k)) for k in (0, 1)]
        return Model.of(part[0].rename_columns(["_piece", "kind", "h", "_", "word", "context"]), part[1].rename_columns(["_piece", "kind", "left", "right", "ratio", "_"]))


#: Contexts that rare words stand for when different contexts are counted: no word's count of different rare contexts goes beyond it.
STRANGE = 1 << 16


def units(w: W.Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings, finest first."""
    data = w.data.astype(np.uint64) + np.uint64(1)
    return [w.hashes(), *(W.mix(W.span_hash(data, w.starts, np.minimum(w.starts + k, w.ends)) + np.uint64(k)) for k in STEMS)]


def places(hashes: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word's finest known unit in the sorted vocabulary plus one; zero for rare words."""
    out = np.zeros(len(hashes[0]), np.int64)
    if len(vocabulary):
        for h in hashes[::-1]:
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            out = np.where(vocabulary[at] == h, at + 1, out)
    return out


def shifted(at: np.ndarray, w: W.Words) -> np.ndarray:
    """The value of the word before each word of its row; zero before the first."""
    before = np.zeros(len(at), dtype=np.int64)
    before[1:] = at[:-1]
    before[w.first[:-1][w.count() > 0]] = 0
    return before


def _asks(column: pa.Array) -> list[np.ndarray]:
    """Distinct units of a piece, and 0."""
    return [np.unique(np.concatenate([np.zeros(1, np.uint64), *units(W.split(column, lower=True, marks=True))])).view(np.int64)]


def _words(w: W.Words) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.concatenate(units(w)).view(np.int64)], np.tile(w.doc, 1 + len(STEMS))


def _pairs(w: W.Words, vocabulary: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Units of the word before (0 before the first; rare words have 1 to STRANGE) and of each word (0 for rare words)."""
    found = units(w)
    at = places(found, vocabulary)
    unit = np.concatenate([np.zeros(1, np.uint64), vocabulary])[at].view(np.int64)
    before = np.where(at > 0, unit, (found[0] % np.uint64(STRANGE)).astype(np.int64) + 1)
    return [shifted(before, w), unit], w.doc


_COUNTS = ("n0", "n1", "in0", "in1")


def _sums(key: list[np.ndarray], text: np.ndarray, y: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row for each key: n0, n1 (toxic, ordinary occurrences), in0, in1 (texts that hold it)."""
    order = np.lexsort(key)  # texts come in order
    key, text, y = [k[order] for k in key], text[order], y[order]
    new = np.ones(len(y), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    fresh = new.copy()
    fresh[1:] |= text[1:] != text[:-1]
    begin = np.flatnonzero(new)
    cols = [np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64) for x in (y, 1 - y, y & fresh, (1 - y) & fresh)]
    return pa.record_batch([pa.array(x) for x in (*(k[begin] for k in key), *cols)], names=[*names, *_COUNTS])


def _tally(texts: DataFrame, keys, names: list[str]) -> DataFrame:
    """names and _COUNTS over texts (t, y). keys(words) gives keys and rows."""

    @W.trimmed

    def run(batches):
        held: list[tuple] = []

        def flush():
            return _sums([np.concatenate([h[0][k] for h in held]) for k in range(len(names))], *(np.concatenate([h[k] for h in held]) for k in (1, 2)), names)

        serial = 0
        for b in batches:
            for piece in W.pieces(b, 0):
                key, row = keys(W.split(piece.column(0), lower=True, marks=True))
                held.append((key, row + serial, piece.column(1).to_numpy().astype(np.int64)[row]))
                serial += piece.num_rows
                if sum(len(h[1]) for h in held) >= FLUSH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return _summed(texts.mapInArrow(run, _schema(names)), names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in (*names, *_COUNTS))


def _summed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy(*names).agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _tally_pairs(texts: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """left, right and _COUNTS of all bigrams of units in vocabulary (key), which has n rows."""
    names = ["left", "right"]
    if n <= BROADCAST:
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(vocabulary.toArrow().column("key").to_numpy().view(np.uint64)))
        return _tally(texts, lambda w: _pairs(w, shared.value), names)

    def take(found: pa.Table) -> np.ndarray:
        return np.unique(found.column("key").to_numpy().view(np.uint64))

    def use(known: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        key, row = _pairs(W.split(b.column(0), lower=True, marks=True), known)
        return _sums(key, row, b.column(1).to_numpy().astype(np.int64)[row], names)

    pieces = numbered(texts, 0)
    found = asked(pieces, lambda b: _asks(b.column(0)), ["key"], 0).join(vocabulary, "key")
    return _summed(meet(pieces, found, take, use, _schema(names), 0), names)


def _discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


def _model(told: DataFrame, vocabulary: DataFrame) -> Tables:
    """Kneser-Ney estimates of both classes, from counts of bigrams (left, right, _COUNTS) over vocabulary (key)."""
    c2 = (0, 1)
    ones = told.agg(*(F.count_if(F.col(f"n{c}") == k) for c in c2 for k in (1, 2))).first()
    d = [_discount(*ones[2 * c : 2 * c + 2]) for c in c2]
    context = F.when(F.col("left").between(0, STRANGE), 0).otherwise(F.col("left"))
    kept = (context != 0) & (F.col("in0") + F.col("in1") >= MIN_TEXTS)
    held = [F.greatest(F.col(f"n{c}") - F.lit(d[c]), F.lit(0.0)) for c in c2]
    ends = told.groupBy(F.col("right").alias("h")).agg(F.count("*").alias("either"), *(F.count_if(F.col(f"n{c}") > 0).alias(f"after{c}") for c in c2))
    begins = told.groupBy(context.alias("h")).agg(*(F.sum(f"n{c}").alias(f"seen{c}") for c in c2), *(F.sum(F.when(kept, held[c]).otherwise(0.0)).alias(f"held{c}") for c in c2))
    every = vocabulary.select(F.col("key").alias("h")).union(told.sparkSession.range(1).select(F.lit(0).cast("long").alias("h")))
    unit = save(every.join(ends, "h", "left").join(begins, "h", "left").fillna(0))
    cut = [F.greatest(F.col(f"after{c}") - F.lit(d[c]), F.lit(0.0)) for c in c2]
    all_ = unit.agg(F.sum(F.col("either") + 1e-3), *(F.sum(f"after{c}") for c in c2), *(F.sum(cut[c]) for c in c2)).first()
    base = (F.col("either") + 1e-3) / F.lit(all_[0])
    word = [(cut[c] + F.lit(all_[1 + c] - all_[3 + c]) * base) / F.lit(float(all_[1 + c])) if all_[1 + c] else base for c in c2]
    seen = [F.greatest(F.col(f"seen{c}"), F.lit(1)) for c in c2]
    trust = {k: n / (n + F.lit(TRUST)) for k, n in (("word", F.col("either")), ("context", F.col("seen0") + F.col("seen1")), ("pair", F.col("in0") + F.col("in1")))}
    unit = unit.select("h", trust["word"].alias("trust_word"), trust["context"].alias("trust_context"), *(word[c].alias(f"word{c}") for c in c2), *(seen[c].alias(f"seen{c}") for c in c2), *(F.greatest(1 - F.col(f"held{c}") / seen[c], F.lit(1e-6)).alias(f"free{c}") for c in c2))
    unit = save(unit.withColumns({"word": F.col("trust_word") * (F.log("word0") - F.log("word1")), "context": F.col("trust_context") * (F.log("free0") - F.log("free1"))}))
    left = unit.select(F.col("h").alias("left"), "seen0", "seen1", "free0", "free1", "context")
    right = unit.select(F.col("h").alias("right"), "word0", "word1", "word")
    log = [F.log(held[c] / F.col(f"seen{c}") + F.col(f"free{c}") * F.col(f"word{c}")) for c in c2]
    ratio = trust["pair"] * (log[0] - log[1]) + (1 - trust["pair"]) * (F.col("context") + F.col("word"))
    pair = told.where(kept).join(left, "left").join(right, "right").select("left", "right", ratio.alias("ratio"))
    return Tables(unit.select("h", "word", "context"), save(pair))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Model | Tables, np.ndarray] | float:
    """The model and the weights of its features, or the share of toxic rows where the labels have one class or none (0 if there are none)."""
    marks = save(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
                 .withColumn("apart", F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0))
    n = {(r.apart, r.y): r["count"] for r in marks.groupBy("apart", "y").count().collect()}
    total, toxic = sum(n.values()), sum(k for (_, y), k in n.items() if y)
    if toxic in (0, total):
        return toxic / total if total else 0.0
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(marks) if total <= LABELS else marks, "id")
    if len(n) == 4:
        texts, rest, some = known.where("NOT apart"), known.where("apart"), n[True, 0] + n[True, 1]
    else:
        texts, rest, some = known, known, total  # too few rows to leave some out
    texts = texts.select("t", "y")
    vocabulary = save(_tally(texts, _words, ["key"]).where(f"in0 + in1 >= {MIN_TEXTS}").select("key"))
    size = vocabulary.count()
    told = save(_tally_pairs(texts, vocabulary, size))
    model = _model(told, vocabulary)
    drop(told)
    if model.unit.count() + model.pair.count() <= BROADCAST:
        model = Model.of(model.unit.toArrow(), model.pair.toArrow())
    else:
        model = model.signed()
    return model, _calibrate(rest, model, some)


def _over(rows: DataFrame, at: int, model: Model | Tables, work, schema) -> DataFrame:
    """work(model, batch) for all rows; column at holds the text."""
    if isinstance(model, Model):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        @W.trimmed

        def run(batches):
            for b in batches:
                for piece in W.pieces(b, at):
                    yield work(shared.value, piece)

        return rows.mapInArrow(run, schema)

    def take(found: pa.Table) -> tuple:
        h, first = np.unique(found.column("h").to_numpy().view(np.uint64), return_index=True)
        return found.column("_piece").to_numpy()[:1], h, *(found.column(c).to_numpy()[first].view(np.uint64) for c in ("follows", "precedes"))

    def bigrams(told: tuple, b: pa.RecordBatch) -> pa.RecordBatch:
        number, h, follows, precedes = told
        w = W.split(b.column(at), lower=True, marks=True)
        here = places(units(w), h[1:])
        key = np.unique(shifted(here, w) << 32 | here)
        left, right = key >> 32, key & 0xFFFFFFFF
        known = (follows[left] >> (h[right] & np.uint64(63))) & (precedes[right] >> (h[left] & np.uint64(63))) & np.uint64(1)
        some = (known > 0) & (left > 0)
        return pa.record_batch([pa.array(np.repeat(number, some.sum())), *(pa.array(h[k[some]].view(np.int64)) for k in (left, right))], names=["_piece", "left", "right"])

    pieces = numbered(rows, at)
    unit = save(asked(pieces, lambda b: _asks(b.column(at)), ["h"], at).join(model.unit, "h"))
    pair = meet(pieces, unit.select("_piece", "h", "follows", "precedes"), take, bigrams, "_piece long, left long, right long", at, distinct=True).join(model.pair, ["left", "right"])
    found = unit.select("_piece", F.lit(0).alias("kind"), F.col("h").alias("a"), F.lit(0).cast("long").alias("b"), F.col("word").alias("x"), F.col("context").alias("z"))
    found = found.union(pair.select("_piece", F.lit(1).alias("kind"), "left", "right", "ratio", F.lit(0.0)))
    return meet(pieces, found, Tables.of, work, schema, at)


def _calibrate(texts: DataFrame, model: Model | Tables, n: int) -> np.ndarray:
    """Logistic weights of the features, by Newton steps with a small ridge, on about FIT_ROWS labelled ids at most.

    An id that stands in several rows is seen with its smallest text, so the driver gets one row for each id.
    """
    names = [*(f"x{k}" for k in range(FEATURES)), "y"]

    def work(model: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(x) for x in model.features(b.column(0)).T), pa.array(b.column(1).to_numpy().astype(float))], names=names)

    share = min(1.0, FIT_ROWS / n)
    chosen = texts.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < round(share * 1_000_000)).groupBy("id", "y").agg(F.min("t").alias("t")).select("t", "y")
    rows = _over(chosen, 0, model, work, ", ".join(f"{c} double" for c in names)).toArrow()
    data = np.stack([rows.column(c).to_numpy() for c in names], axis=1) if rows.num_rows else np.zeros((0, len(names)))
    x, y = np.c_[np.ones(len(data)), data[:, :-1]], data[:, -1]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs with one more column, toxicity (0 to 1), from a model fitted to the rows of docs that labels marks 0 or 1.

    Null, empty and wordless texts get the score of a text without evidence. Of several labels of an id the largest holds;
    null ids and labels teach nothing. With labels of one class, or none, every score is that class's share (0 for none).
    Every column of docs stays; a column named toxicity is replaced. An empty table gives none.
    """
    fitted = fit(docs, labels, id_col, text_col, label_col)
    if isinstance(fitted, float):
        return docs.withColumn("toxicity", F.lit(fitted))
    model, weights = fitted
    rest = [c for c in docs.columns if c != "toxicity"]
    at = rest.index(text_col)

    def work(model: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        z = model.features(b.column(at)) @ weights[1:] + weights[0]
        return pa.record_batch([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*rest, "toxicity"])

    return _over(docs.select(*rest), at, model, work, docs.select(*rest).withColumn("toxicity", F.lit(0.0)).schema)
