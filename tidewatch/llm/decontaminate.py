"""Benchmark decontamination: windows of an item's size, SimHash, multi-index Hamming tables, exact weighted similarity.

Texts are compared as lower-cased words without ASCII punctuation, in shingles of five words (fewer words: one shingle),
every repeat counted; an item of fewer words matches where just these words follow each other. A window is as long as the item it may match. The similarity of two bags of shingles is the sum of
smaller counts over the sum of larger ones; two bags of sizes a and b that reach t share at least t / (1 + t) * (a + b)
shingles, so only windows that hold so many shingles of items of their size are fingerprinted; none that could match is lost.

A table for each of BLOCKS blocks holds the items' block values and all within NEAR bits of them; fingerprints that differ in
at most RADIUS = BLOCKS * (NEAR + 1) - 1 bits agree with one of these. That radius lies over four deviations beyond what a
similarity of 0.8 leads to. Pairs found are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W

SHINGLE, BLOCKS, NEAR = 5, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Characters of items that are broadcast at a time; more items mean more passes over the documents.
ITEM_CHARS = 16_000_000
_WIDTH = 64 // BLOCKS
_FLIPS = np.array([sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(range(_WIDTH), k)], dtype=np.uint64)


def shingles(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each row where its shingles begin and how many it has."""
    word = w.hashes()
    n = w.count()
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    row = np.repeat(np.arange(len(n)), per)
    start = w.first[:-1][row] + np.arange(len(row)) - first[row]
    end = np.minimum(start + SHINGLE, w.first[1:][row])
    out = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        there = start + k < end
        out[there] = out[there] * np.uint64(W.BASES[0]) + word[start[there] + k]
    return W.mix(out), first, per


def simhash(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the ranges of a row of shingle hashes, by sums of bits up to each place."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    lo, hi = int(begin.min()), int(end.max())
    bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    on = 2 * (total[end - lo] - total[begin - lo]) > (end - begin)[:, None]
    return np.packbits(on, axis=1, bitorder="little").copy().view("<u8").ravel()


@dataclass
class Items:
    """Items by number: ids, words, shingles each; known shingles by (item, shingle) and by size; and the block tables."""

    ids: list
    words: np.ndarray
    size: np.ndarray
    fp: np.ndarray
    shingle: np.ndarray
    sizes_of: list[np.ndarray]
    of: np.ndarray
    count: np.ndarray
    table: np.ndarray
    entry: np.ndarray
    #: The first shingle of each item.
    only: np.ndarray

    @staticmethod
    def build(ids: list, texts: pa.Array) -> Items:
        w = W.split(texts, lower=True, marks=True)
        h, first, per = shingles(w)
        n = w.count()
        fp = np.array([simhash(h, np.array([a]), np.array([a + k]))[0] if k else 0 for a, k in zip(first, per)], dtype=np.uint64)
        item = np.repeat(np.arange(len(n)), per)
        of, count = np.unique(_own(item, h), return_counts=True)
        shingle, inv = np.unique(h, return_inverse=True)
        by = np.argsort(inv, kind="stable")
        cuts = np.searchsorted(inv[by], np.arange(1, len(shingle)))
        sizes_of = [np.unique(n[item[x]]) for x in np.split(by, cuts)] if len(shingle) else []
        full = np.flatnonzero(per)
        keys = [_block(n[full], k, (fp[full] >> np.uint64(_WIDTH * k) & np.uint64((1 << _WIDTH) - 1)) ^ f) for k in range(BLOCKS) for f in _FLIPS]
        table, entry = np.concatenate(keys), np.tile(full, BLOCKS * len(_FLIPS))
        order = np.argsort(table, kind="stable")
        only = np.zeros(len(n), np.uint64)
        only[full] = h[first[full]]
        return Items(ids, n, per, fp, shingle, sizes_of, of, count, table[order], entry[order], only)

    def matches(self, w: W.Words, least: float) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word of the window) of the best window of each row and item."""
        yield from self._short(w)
        h, first, per = shingles(w)
        if not len(h) or not len(self.shingle):
            return
        at = np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)
        hit = np.flatnonzero(self.shingle[at] == h)
        if not len(hit):
            return
        row_of = np.repeat(np.arange(len(per)), per)
        by_size: dict[int, list[np.ndarray]] = {}
        for s in np.unique(at[hit]):
            where = hit[at[hit] == s]
            for size in self.sizes_of[s].tolist():
                if size >= SHINGLE:
                    by_size.setdefault(size, []).append(where)
        if not by_size:
            return
        share = least / (1 + least)
        begins, ends, sizes = [], [], []
        for size, found in by_size.items():
            p = np.sort(np.concatenate(found))
            m = size - SHINGLE + 1
            # whole windows: enough hits within m places of one row
            c = max(1, int(np.ceil(share * 2 * m - 1e-9)))
            if len(p) >= c:
                last = p[c - 1 :]
                lead = p[: len(p) - c + 1]
                row = row_of[lead]
                lo = np.maximum(last - m + 1, first[row])
                hi = np.minimum(lead, first[row] + per[row] - m)
                good = (row == row_of[last]) & (hi >= lo)
                lo, hi = lo[good], hi[good]
                n = hi - lo + 1
                begin = np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                begins.append(begin)
                ends.append(begin + m)
                sizes.append(np.full(len(begin), size))
            # rows shorter than the item: the whole row
            rows, hits = np.unique(row_of[p], return_counts=True)
            short = (per[rows] < m) & (hits >= share * (per[rows] + m) - 1e-9)
            begins.append(first[rows[short]])
            ends.append(first[rows[short]] + per[rows[short]])
            sizes.append(np.full(int(short.sum()), size))
        begin, end, size = (np.concatenate(x) for x in (begins, ends, sizes))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for r in np.unique(row_of[begin]).tolist():
            own = np.flatnonzero(row_of[begin] == r)
            for lo in range(0, len(own), 4096):
                pick = own[lo : lo + 4096]
                b, e = begin[pick], end[pick]
                window, item = self.lookup(simhash(h, b, e), size[pick])
                sim = self.similarity(h, b[window], e[window], item)
                for k in np.flatnonzero(sim >= least).tolist():
                    key, value = (r, int(item[k])), (float(sim[k]), -int(b[window[k]] - first[r]))
                    if value > best.get(key, (-1.0, 0)):
                        best[key] = value
        for (r, i), (sim, start) in best.items():
            yield r, i, sim, -start

    def _short(self, w: W.Words) -> Iterator[tuple[int, int, float, int]]:
        """Items of fewer words than a shingle: one shingle, so a window is equal or shares nothing."""
        for size in range(1, SHINGLE):
            items = np.flatnonzero(self.words == size)
            if len(items):
                g, at = W.grams(w.hashes(), w.doc, size)
                for i in items.tolist():
                    place = at[g == self.only[i]]
                    row, first = np.unique(w.doc[place], return_index=True)
                    for r, p in zip(row.tolist(), place[first].tolist()):
                        yield r, i, 1.0, int(p - w.first[r])

    def lookup(self, fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of its size) within RADIUS, by the block tables."""
        window, item = [], []
        for k in range(BLOCKS):
            key = _block(size, k, fp >> np.uint64(_WIDTH * k) & np.uint64((1 << _WIDTH) - 1))
            lo, hi = np.searchsorted(self.table, key), np.searchsorted(self.table, key, side="right")
            n = hi - lo
            window.append(np.repeat(np.arange(len(fp)), n))
            item.append(self.entry[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        pair = np.unique(np.concatenate(window) * len(self.size) + np.concatenate(item))
        window, item = pair // len(self.size), pair % len(self.size)
        near = np.bitwise_count(fp[window] ^ self.fp[item]) <= RADIUS
        return window[near], item[near]

    def similarity(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        out = np.zeros(len(item))
        step = max(1, (1 << 21) // int(max(1, (end - begin).max(initial=1))))
        for lo in range(0, len(item), step):
            b, n, i = begin[lo : lo + step], (end - begin)[lo : lo + step], item[lo : lo + step]
            pair = np.repeat(np.arange(len(b)), n)
            at = np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = _own(i[pair], h[at])
            place = np.minimum(np.searchsorted(self.of, key), len(self.of) - 1)
            there = self.of[place] == key
            both, have = np.unique(pair[there] * len(self.of) + place[there], return_counts=True)
            shared = np.bincount(both // len(self.of), weights=np.minimum(have, self.count[both % len(self.of)]), minlength=len(b))
            out[lo : lo + step] = shared / (n + self.size[i] - shared)
        return out


def _own(item: np.ndarray, h: np.ndarray) -> np.ndarray:
    return W.mix(h ^ W.mix(item.astype(np.uint64) + np.uint64(1)))


def _block(size: np.ndarray, k: int, value: np.ndarray) -> np.ndarray:
    return (size.astype(np.uint64) * np.uint64(BLOCKS) + np.uint64(k)) << np.uint64(_WIDTH) | value


def _slices(items: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcasts of all items, about ITEM_CHARS characters at a time."""
    bench = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    chars = bench.agg(F.sum(F.length("t") + 100)).first()[0] or 0
    passes = max(1, -(-chars // ITEM_CHARS))
    for k in range(passes):
        some = bench.where(F.pmod(F.xxhash64("id", "t"), F.lit(passes)) == k).orderBy("id", "t").toArrow().combine_chunks()
        yield items.sparkSession.sparkContext.broadcast(Items.build(some.column("id").to_pylist(), some.column("t")))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() has no row for; rows without an id are judged as well."""
    at = docs.columns.index(text_col)
    for shared in _slices(items, item_id, item_text):

        @W.trimmed

        def run(batches, shared=shared):
            for b in batches:
                for piece in W.pieces(b, at):
                    keep = np.ones(piece.num_rows, dtype=bool)
                    keep[[m[0] for m in shared.value.matches(W.split(piece.column(at), lower=True, marks=True), least)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8,
) -> DataFrame:
    """Columns id, item, similarity, start: the best window (first word) of each document and item that reach least.

    Null, empty and wordless texts match nothing, on either side. Rows that repeat an id count once each; null ids are kept
    as null. Texts are read whole. Without documents, items or matches the result is empty. Clean documents have no row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = None
    for shared in _slices(items, item_id, item_text):

        @W.trimmed

        def run(batches, shared=shared):
            known = shared.value
            for b in batches:
                for piece in W.pieces(b, 1):
                    got = list(known.matches(W.split(piece.column(1), lower=True, marks=True), least))
                    if got:
                        row, item, sim, start = zip(*got)
                        yield pa.record_batch(
                            [piece.column(0).take(pa.array(row)), pa.array([known.ids[i] for i in item], pa.int64()), pa.array(sim), pa.array(start, pa.int64())],
                            names=["id", "item", "similarity", "start"],
                        )

        part = texts.mapInArrow(run, "id long, item long, similarity double, start long")
        found = part if found is None else found.union(part)
    return found
