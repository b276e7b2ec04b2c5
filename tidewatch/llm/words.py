"""Words of Arrow text batches as numpy arrays: byte ranges, owners and hashes, without a Python object per word.

A word is a maximal run of bytes other than the six ASCII spaces (0x20, 0x09-0x0D). UTF-8 never uses these bytes inside a
longer character, so byte ranges and character ranges agree. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARKS = _SPACE.copy()
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd 64-bit bases of the two polynomial hashes (fixed values), so that each has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept per worker, as long as the longest batch seen."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << (int(n) + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of values[s:e] for every range at once, by prefix sums; equal ranges hash alike wherever they stand."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """All words of a batch, in order. first[d]:first[d+1] are the words of row d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """64-bit hash of each word's bytes; the plus one keeps zero bytes and lengths apart."""
        return span_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, base)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, keep: np.ndarray, d: int) -> bytes:
        """The kept words of row d, joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        raw = self.data
        idx = np.flatnonzero(keep[a:b]) + a
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.starts[idx].tolist(), self.ends[idx].tolist())])


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's byte offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array | pa.ChunkedArray, lower: bool = False, marks: bool = False) -> Words:
    """Words of every row of a string column; lower folds A-Z only, marks takes ASCII punctuation for space as well."""
    data, offsets = raw_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~(_MARKS if marks else _SPACE)[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1 : n + 1])) + 1
    first = np.searchsorted(starts, offsets).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, first, doc)


def grams(h: np.ndarray, doc: np.ndarray, n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one row, and the index of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    b = np.uint64(base)
    for k in range(n):
        out = out * b + h[at + k]
    return mix(out), at


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with memory that is free given back to the system before and after it.

    Spark keeps Python workers for later tasks, more of them than run at once, and allocators keep what a large batch took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, text: int, size: int = 1 << 18):
    """Slices of a batch with about size bytes of text each; a longer text stands alone, whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def joined(w: Words, keep: np.ndarray | None = None) -> pa.Array:
    """Each row's kept words, unchanged, joined by one space."""
    keep = np.ones(len(w), dtype=bool) if keep is None else keep
    lengths = np.where(keep, w.ends - w.starts + 1, 0)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    at = begin[w.first]
    out = np.full(int(begin[-1]), 32, dtype=np.uint8)
    solid = np.ones(int(begin[-1]), dtype=bool)
    solid[begin[1:][keep] - 1] = False
    mark = np.zeros(len(w.data) + 1, dtype=np.int8)
    mark[w.starts[keep]] += 1
    mark[w.ends[keep]] -= 1
    out[solid] = w.data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    full = np.diff(at) > 0
    last = np.ones(len(out), dtype=bool)
    last[at[1:][full] - 1] = False
    out = out[last]
    offsets = np.concatenate([[0], np.cumsum(np.diff(at) - full)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their second column, the text, compressed row by row for the shuffle; null stays null."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        for part in pieces(b, 1):
            yield pa.record_batch([part.column(0), pa.array([None if t is None else squeeze(t.encode()) for t in part.column(1).to_pylist()], pa.binary()), *part.columns[2:]], names=["id", "z", *b.schema.names[2:]])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts again, some hundred rows at a time; other columns stay."""
    open_ = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = pa.array([None if z is None else open_(z) for z in part.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.record_batch([part.column(0), texts, *part.columns[2:]], names=["id", "t", *b.schema.names[2:]])
