"""Removal of word runs that already stand in a document with a smaller id: seed and extend.

Seeds are winnowed word 5-grams: every window of `run` consecutive words is anchored at its smallest seed, so equal windows
have equal anchors at equal places. Documents meet on anchors. A match is extended both ways in two steps: first as far as
the anchor's windows reach, by a hash of that whole stretch, which settles true copies; then, for anchors that different
documents share in different surroundings, window by window. Overlapping matches make up the maximal repeats, of which every
word is covered.

Texts go through the shuffle twice, compressed; in between travel packed arrays of hashes, one row per task and bucket. A
task first settles what it can see itself, so a passage that very many documents share is sent once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.blocks import groups
from tidewatch.llm.store import partitions, save

SEED_WORDS = 5
#: Entries that a map task gathers before it sends them; characters of text per bucket.
FLUSH, BUCKET_CHARS = 1 << 20, 12_000_000


def winnow(h: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window of run words, the start of its anchor, and the anchor's hash (leftmost smallest seed)."""
    k = min(SEED_WORDS, run)
    g, at = W.grams(h, doc, k)
    of = np.zeros(len(h), dtype=np.uint64)
    of[at] = g
    if len(h) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), of[:0]
    start = np.flatnonzero(doc[: len(h) - run + 1] == doc[run - 1 :])
    best, where = of[start], start.copy()
    for j in range(1, run - k + 1):
        other = of[start + j]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, start + j, where)
    return start, where, best


def _bins(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), [c[part] for c in columns]


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of (integer, arrays...) as one batch; arrays become binary."""
    keys = pa.array([r[0] for r in rows], pa.int64())
    rest = [pa.array([np.ascontiguousarray(r[i]).tobytes() for r in rows], pa.binary()) for i in range(1, len(names))]
    return pa.record_batch([keys, *rest], names=names)


def _whole(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind)


def _by_doc(kind: int, doc: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(k, v[0]) for k, v in _bins(doc, value)]
    if rows:
        out = _packed(rows, ["doc", "found"])
        yield out.append_column("kind", pa.array(np.full(len(rows), kind, np.int32)))


@dataclass
class Anchors:
    """Each anchor's seed and a hash of the stretch of words that its windows cover; its windows are start[first:last]."""

    start: np.ndarray
    first: np.ndarray
    last: np.ndarray
    seed: np.ndarray
    stretch: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(w: W.Words, word: np.ndarray, run: int) -> Anchors:
        start, where, best = winnow(word, w.doc, run)
        at, first = np.unique(where, return_index=True)
        last = np.append(first[1:], len(where)) if len(first) else first
        begin, end = start[first], start[last - 1] + run
        shape = ((at - begin) << 32 | (end - begin)).astype(np.uint64)
        stretch = W.mix(W.span_hash(word, begin, end, W.BASES[1]) ^ W.mix(shape)) >> np.uint64(32)
        return Anchors(start, first, last, best[first], stretch, w.doc[begin] if len(begin) else begin)

    def key(self) -> np.ndarray:
        """One value for seed and stretch."""
        return _key(self.seed, self.stretch)

    def among(self, lists: list[list[bytes] | None]) -> np.ndarray:
        """Which anchors' keys are in the list of their row."""
        have = [np.frombuffer(b"".join(x or []), dtype=np.uint64) for x in lists]
        row = np.repeat(np.arange(len(have)), [len(x) for x in have]).astype(np.uint64)
        known = W.mix(np.concatenate(have) + W.mix(row)) if len(row) else np.zeros(0, np.uint64)
        return np.isin(W.mix(self.key() + W.mix(self.row.astype(np.uint64))), known)


def _key(seed: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    return W.mix(seed ^ W.mix(stretch))


def _tags(w: W.Words) -> np.ndarray:
    """16 bits of each row's words, which tell rows with one id but other texts apart."""
    return W.span_hash(w.hashes(W.BASES[1]), w.first[:-1], w.first[1:]) >> np.uint64(48)


def _least(doc: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings entries together that agree in all of same, and each one's smallest document in that order."""
    order = np.lexsort((doc, *same[::-1]))
    new = _new(*(x[order] for x in same))
    begin = np.flatnonzero(new)
    return order, np.repeat(doc[order][begin], np.diff(np.append(begin, len(order))))


def _new(*same: np.ndarray) -> np.ndarray:
    new = np.ones(len(same[0]), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0)
    return new


def _placed(extra: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (extra & np.uint32(0xFFFF)).astype(np.uint64) << np.uint64(32) | pos


SETTLED, OPEN = 0, 1


def shared_anchors(docs: DataFrame, run: int, buckets: int) -> DataFrame:
    """doc, found (anchor keys), kind: SETTLED if the whole stretch stands in a smaller document, so that all its windows do;
    OPEN if the seed stands in another document too and the windows must be compared."""

    @W.trimmed

    def send(batches):
        kept: list[tuple] = []

        def flush():
            seed, stretch, doc = (np.concatenate([k[i] for k in kept]) for i in range(3))
            order, least = _least(doc, seed, stretch)
            seed, stretch, doc = seed[order], stretch[order], doc[order]
            fresh = _new(seed, stretch, doc)
            first, late = fresh & (doc == least), fresh & (doc != least)
            rows = [(b, True, *v) for b, v in _bins((seed[first] % np.uint64(buckets)).astype(np.int64), seed[first], stretch[first].astype(np.uint32), doc[first])]
            none = np.zeros(0, np.uint32)
            rows += [(b, False, v[0], none, v[1]) for b, v in _bins(doc[late] % buckets, _key(seed[late], stretch[late]), doc[late])]
            return pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(2, 5))],
                names=["key", "open", "seed", "stretch", "doc"],
            )

        for b in batches:
            for part in W.pieces(b, 1):
                w = W.split(part.column(1))
                a = Anchors.of(w, w.hashes(), run)
                kept.append((a.seed, a.stretch, part.column(0).to_numpy()[a.row]))
                if sum(len(k[0]) for k in kept) >= FLUSH:
                    yield flush()
                    kept.clear()
        if kept and sum(len(k[0]) for k in kept):
            yield flush()

    @W.trimmed

    def meet(batches):
        for t in groups(batches, ["key"]):
            is_open = t.column("open").to_numpy(zero_copy_only=False)
            closed, t = t.filter(pa.array(~is_open)), t.filter(pa.array(is_open))
            yield from _by_doc(SETTLED, _whole(closed, "doc", np.int64), _whole(closed, "seed", np.uint64))
            if not t.num_rows:
                continue
            seed, stretch, doc = _whole(t, "seed", np.uint64), _whole(t, "stretch", np.uint32).astype(np.uint64), _whole(t, "doc", np.int64)
            order, least = _least(doc, seed, stretch)
            seed, stretch, doc = seed[order], stretch[order], doc[order]
            key = _key(seed, stretch)
            late = doc > least
            yield from _by_doc(SETTLED, doc[late], key[late])
            begin = np.flatnonzero(_new(seed))
            size = np.diff(np.append(begin, len(seed)))
            varied = np.add.reduceat(_new(seed, stretch).astype(np.int64), begin) > 1
            shared = np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)
            at = ~late & np.repeat(varied & shared, size)
            yield from _by_doc(OPEN, doc[at], key[at])

    sent = docs.mapInArrow(send, "key long, open boolean, seed binary, stretch binary, doc binary")
    return sent.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(meet, "doc long, found binary, kind int")


def repeated_windows(docs: DataFrame, run: int, buckets: int) -> DataFrame:
    """docs: id, packed text, and the list of its open anchors. doc, found: starts of the windows that a smaller id has too."""

    @W.trimmed

    def send(batches):
        kept: list[tuple] = []

        def flush():
            h, extra, doc, pos = (np.concatenate([k[i] for k in kept]) for i in range(4))
            order, least = _least(doc, h, extra >> np.uint32(16))
            h, extra, doc, pos = h[order], extra[order], doc[order], pos[order]
            first = doc == least
            rows = [(b, *v) for b, v in _bins((h[first] % np.uint64(buckets)).astype(np.int64), h[first], extra[first], doc[first], pos[first])]
            late = ~first
            rows += [(b, b"", b"", *v) for b, v in _bins(doc[late] % buckets, doc[late], _placed(extra[late], pos[late]))]
            return pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) > 0 for r in rows]), *(pa.array([bytes(np.ascontiguousarray(r[i]).data) if len(r[i]) else b"" for r in rows], pa.binary()) for i in range(1, 5))],
                names=["key", "open", "h", "extra", "doc", "pos"],
            )

        for b in W.unpacked(batches):
            for part in W.pieces(b, 1):
                w = W.split(part.column(1))
                word = w.hashes()
                a = Anchors.of(w, word, run)
                pick = np.repeat(a.among(part.column(2).to_pylist()), a.last - a.first)
                start = a.start[pick]
                if not len(start):
                    continue
                h, extra = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
                for k in range(run):
                    h = h * np.uint64(W.BASES[0]) + word[start + k]
                    extra = extra * np.uint64(W.BASES[1]) + word[start + k]
                ids = part.column(0).to_numpy()
                check = (W.mix(extra) >> np.uint64(48) << np.uint64(16) | _tags(w)[w.doc[start]]).astype(np.uint32)
                kept.append((W.mix(h), check, ids[w.doc[start]], (start - w.first[w.doc[start]]).astype(np.uint32)))
                if sum(len(k[0]) for k in kept) >= FLUSH:
                    yield flush()
                    kept.clear()
        if kept:
            yield flush()

    @W.trimmed

    def meet(batches):
        for t in groups(batches, ["key"]):
            is_open = t.column("open").to_numpy(zero_copy_only=False)
            closed, t = t.filter(pa.array(~is_open)), t.filter(pa.array(is_open))
            doc, pos = _whole(closed, "doc", np.int64), _whole(closed, "pos", np.uint64)
            if t.num_rows:
                h, extra, d, p = _whole(t, "h", np.uint64), _whole(t, "extra", np.uint32), _whole(t, "doc", np.int64), _whole(t, "pos", np.uint32)
                order, least = _least(d, h, extra >> np.uint32(16))
                late = order[d[order] > least]
                doc, pos = np.concatenate([doc, d[late]]), np.concatenate([pos, _placed(extra[late], p[late])])
            yield from _by_doc(OPEN, doc, pos)

    sent = docs.mapInArrow(send, "key long, open boolean, h binary, extra binary, doc binary, pos binary")
    return sent.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(meet, "doc long, found binary, kind int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns id, n_words, n_removed, kept (the words left, joined by one space) for every row of docs, and those named in
    carry as they are.

    A word goes if a window of run words that covers it also starts in a document with a smaller id. Null and empty texts
    have no words and an empty kept. Rows with equal ids do not remove each other's words, be their texts equal or not; a row
    with a null id loses nothing and removes nothing. Texts of any length are read whole. An empty table gives none.
    """
    spark = docs.sparkSession
    rest = [f"_{k}" for k in range(len(carry))]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(r) for c, r in zip(carry, rest)))
    known = texts.select("id", "t").where("id IS NOT NULL")
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(partitions(spark), -(-chars // BUCKET_CHARS))
    anchors = save(shared_anchors(known, run, buckets))
    zipped = texts.mapInArrow(W.packed, texts.withColumn("t", F.col("t").cast("binary")).withColumnRenamed("t", "z").schema)
    of = anchors.where(F.col("kind") == OPEN).groupBy("doc").agg(F.collect_list("found").alias("found"))
    windows = save(repeated_windows(zipped.join(of, zipped["id"] == of["doc"]).select("id", "z", "found"), run, buckets))
    told = anchors.where(F.col("kind") == SETTLED).select("doc", F.col("found").alias("anchor"), F.lit(None).cast("binary").alias("window"))
    told = told.union(windows.select("doc", F.lit(None).cast("binary"), "found"))
    gone = told.groupBy("doc").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("window").alias("windows"))

    @W.trimmed

    def cover(batches):
        for b in W.unpacked(batches):
            for part in W.pieces(b, 1):
                w = W.split(part.column(1))
                edge = np.zeros(len(w) + run + 1, dtype=np.int32)
                lists = part.column(2).to_pylist()
                if any(lists):
                    a = Anchors.of(w, w.hashes(), run)
                    at = a.among(lists)
                    np.add.at(edge, a.start[a.first[at]], 1)
                    np.add.at(edge, a.start[a.last[at] - 1] + run, -1)
                tags = _tags(w)
                for d, found in enumerate(part.column(3).to_pylist()):
                    if found:
                        at = np.frombuffer(b"".join(found), dtype=np.uint64)
                        at = (at[at >> np.uint64(32) == tags[d]] & np.uint64(0xFFFFFFFF)).astype(np.int64) + w.first[d]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + run, -1)
                keep = np.cumsum(edge)[: len(w)] == 0
                left = np.concatenate([[0], np.cumsum(keep)])[w.first]
                n = w.count()
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), W.joined(w, keep).cast(pa.string()), *part.columns[4:]],
                    names=["id", "n_words", "n_removed", "kept", *rest],
                )

    every = zipped.join(gone, zipped["id"] == gone["doc"], "left").select("id", "z", "anchors", "windows", *rest)
    as_is = every.select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), *rest)
    return every.mapInArrow(cover, as_is.schema).withColumnsRenamed(dict(zip(rest, carry)))
