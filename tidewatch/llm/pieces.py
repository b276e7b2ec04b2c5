"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

A text, with one space before it, is cut into chunks: spaces and what follows them up to the next space. No piece of the
models read here crosses such a border (checked on loading), so the piece lattice of a text is that of its chunks in a row.
The lattice of each distinct chunk is filtered forwards once: the log-sum of all segmentations of its beginnings. Then
every occurrence is sampled backwards on its own, with random numbers that are a hash of seed, row key, chunk number and
step. A segmentation comes up in proportion to the product of its pieces' weights, in any partitioning and on any retry.

Byte-pair models store merge ranks, not probabilities; a piece's weight is (rank + 2.7) ** -alpha, Zipf's law by rank. A
character without a piece of its own is spelled in byte pieces, and so is the space mark's own character in a text; control
and unknown pieces are never produced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.store import tokenizer_file

_MARK = "▁"
_LOADED: dict[tuple[str, float], "Vocabulary"] = {}
_LIMIT = 1 << 18


#: Edges that a worker remembers at most, with the chunks they belong to; later chunks are filtered again where they occur.
_REMEMBERED = 1_500_000
#: Bytes of chunks that are filtered at once; each takes some hundreds of bytes of memory meanwhile.
_AT_ONCE = 1 << 15


@dataclass
class Filtered:
    """Lattices of distinct chunks, end to end: chunk k lies between the nodes bound[k] and bound[k + 1]. Edges are sorted by
    the node they end in; share is that node plus the part of its mass up to and with the edge."""

    bound: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    share: np.ndarray
    edges: int
    chunks: int
    slot: dict[bytes, int]

    @staticmethod
    def room(edges: int) -> Filtered:
        return Filtered(np.zeros(edges // 4 + 1, np.int64), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges), 0, 0, {})

    def add(self, other: Filtered, names: list[bytes]) -> None:
        """Remember other's chunks while there is room."""
        if not names or self.edges + other.edges > len(self.start) or self.chunks + len(names) >= len(self.bound):
            return
        at, node = slice(self.edges, self.edges + other.edges), int(self.bound[self.chunks])
        self.start[at], self.piece[at], self.share[at] = other.start + node, other.piece, other.share + node
        self.slot.update(zip(names, range(self.chunks, self.chunks + len(names))))
        self.bound[self.chunks + 1 : self.chunks + len(names) + 1] = other.bound[1:] + node
        self.edges, self.chunks = self.edges + other.edges, self.chunks + len(names)

    def walk(self, live: np.ndarray, chunk: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Sample occurrences backwards, all at once: (step, occurrences, pieces). n counts each one's pieces."""
        out = []
        share = self.share[: self.edges]
        node, first, step = self.bound[chunk + 1], self.bound[chunk], 0
        while len(live):
            salt = np.full(1, step, np.uint64) * np.uint64(W.BASES[1])
            u = (W.mix(own[live] + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = np.searchsorted(share, node + np.minimum(u, 1 - 1e-9), side="right")
            out.append((step, live, self.piece[e]))
            n[live] += 1
            node = self.start[e].astype(np.int64)
            more = node > first
            live, node, first, step = live[more], node[more], first[more], step + 1
        return out


@dataclass
class Vocabulary:
    """A trie over piece bytes as sorted (node, byte) keys; weights; and each piece's bytes for decoding."""

    edge: np.ndarray
    child: np.ndarray
    piece_at: np.ndarray
    weight: np.ndarray
    byte_piece: np.ndarray
    raw: np.ndarray
    begin: np.ndarray
    known: Filtered

    @staticmethod
    def load(path: str, alpha: float) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text: list[bytes] = []
        plain, byte_piece = [], np.full(256, -1, np.int32)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_piece[int(piece[1:-1], 16)] = i
                text.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text.append(b"")
            else:
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError(f"piece {i} crosses a space")
                text.append(piece.replace(_MARK, " ").encode())
                plain.append(i)
        if (byte_piece < 0).any():
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for i in plain:
            at = 0
            for b in text[i]:
                at = nodes.setdefault((at, b), len(nodes) + 1)
                if at == len(piece_at):
                    piece_at.append(-1)
            piece_at[at] = i
        keys = np.array([n << 8 | b for n, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        ranks = np.argsort(np.argsort([-model.get_score(i) for i in range(size)], kind="stable"))
        weight = -alpha * np.log(ranks + 2.7)
        weight[byte_piece] = -alpha * np.log(size + 2.7)
        return Vocabulary(
            keys[order], np.array(list(nodes.values()), dtype=np.int64)[order], np.array(piece_at, dtype=np.int32), weight, byte_piece,
            np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])]), Filtered.room(_REMEMBERED),
        )

    def lattice(self, raw: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (from, to, piece) over byte positions; end_of is where each position's chunk ends."""
        at, node, here = np.arange(len(raw)), np.zeros(len(raw), np.int64), np.arange(len(raw))
        starts, ends, found = [], [], []
        single = np.zeros(len(raw), dtype=bool)
        width = 1 + (raw >= 0xC0).astype(np.int64) + (raw >= 0xE0) + (raw >= 0xF0)
        lead = (raw & 0xC0) != 0x80
        at, node, here = at[lead], node[lead], here[lead]
        while len(at):
            key = node << 8 | raw[here]
            i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[i] == key
            at, node, here = at[on], self.child[i[on]], here[on] + 1
            piece = self.piece_at[node]
            whole = np.flatnonzero(piece >= 0)
            starts.append(at[whole])
            ends.append(here[whole])
            found.append(piece[whole])
            single[at[whole][here[whole] - at[whole] == width[at[whole]]]] = True
            more = here < end_of[at]
            at, node, here = at[more], node[more], here[more]
        first = np.maximum.accumulate(np.where(lead, np.arange(len(raw)), 0))  # of each byte's character
        spelled = np.flatnonzero(~single[first])
        starts.append(spelled)
        ends.append(spelled + 1)
        found.append(self.byte_piece[raw[spelled]])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(found)

    def sample(self, column: pa.Array, key: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all rows in order and the number of each row. Rows are empty or begin with a space."""
        data, offsets = W.raw_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        cut = np.append(np.flatnonzero(opens), len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slot = np.array([self.known.slot.get(x, -1) for x in distinct], dtype=np.int64)
        new = np.flatnonzero(slot < 0)
        fresh = Filtered.room(0)
        if len(new):
            fresh = self._filtered([distinct[i] for i in new])
            slot[new] = -1 - np.arange(len(new))
        which = slot[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(cut[:-1], offsets)))
        number = np.arange(len(which)) - np.searchsorted(cut[:-1], offsets)[:-1][row]
        own = W.mix(key[row] + W.mix(number.astype(np.uint64) + W.mix(np.full(1, seed, np.uint64))))
        n = np.zeros(len(which), np.int64)
        old = np.flatnonzero(which >= 0)
        young = np.flatnonzero(which < 0)
        taken = self.known.walk(old, which[old], own, n) + fresh.walk(young, -1 - which[young], own, n)
        self.known.add(fresh, [distinct[i] for i in new])
        end = np.cumsum(n)
        out = np.empty(int(end[-1]), np.int32)
        for k, live, p in taken:
            out[end[live] - 1 - k] = p
        return out, np.diff(np.concatenate([[0], end])[np.searchsorted(cut[:-1], offsets)])

    def _filtered(self, chunks: list[bytes]) -> Filtered:
        """Lattices of the chunks, made _AT_ONCE bytes at a time (a longer chunk alone)."""
        part = np.cumsum([len(c) for c in chunks]) // _AT_ONCE
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(chunks)]]).tolist()
        made = [self._lattices(chunks[a:b]) for a, b in zip(cuts, cuts[1:])]
        node = np.concatenate([[0], np.cumsum([m.bound[-1] for m in made])])
        bound = np.concatenate([[0], *[m.bound[1:] + k for m, k in zip(made, node)]])
        start, share = (np.concatenate([getattr(m, x) + k.astype(getattr(m, x).dtype) for m, k in zip(made, node)]) for x in ("start", "share"))
        return Filtered(bound, start, np.concatenate([m.piece for m in made]), share, sum(m.edges for m in made), len(chunks), {})

    def _lattices(self, chunks: list[bytes]) -> Filtered:
        bound = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        start, stop, piece = self.lattice(raw, np.repeat(bound[1:], np.diff(bound)))
        order = np.argsort(stop * 4096 + (stop - start))  # a piece is far shorter than that
        s, z, p = start[order], stop[order], piece[order]
        w = self.weight[p]
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[bound[:-1]] = True
        depth = z - np.repeat(bound[:-1], np.diff(bound))[s]
        order = np.argsort(depth << 32 | np.arange(len(z)))
        mass = np.full(len(raw) + 1, -np.inf)  # a chunk's end is the next one's beginning: it holds the end's mass
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if a < b:
                at = order[a:b]
                v, to = np.where(begins[s[at]], 0.0, mass[s[at]]) + w[at], z[at]
                new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                mass[to[new]] = np.logaddexp.reduceat(v, new)
        part = np.exp(np.where(begins[s], 0.0, mass[s]) + w - mass[z])
        at = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
        total = np.cumsum(part)
        before = np.repeat(np.concatenate([[0.0], total[at[1:] - 1]]), np.diff(np.append(at, len(z))))
        share = np.minimum(total - before, 1.0)
        share[np.append(at[1:], len(z)) - 1] = 1.0
        return Filtered(bound, s.astype(np.int32), p.astype(np.int32), z + share, len(z), len(chunks), {})

    def spell(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The texts of rows of pieces, without the space put before them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.begin) - 1):
            raise ValueError("unknown piece id")
        length = self.begin[ids + 1] - self.begin[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        out = self.raw[np.repeat(self.begin[ids] - (end - length), length) + np.arange(total)]
        row = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])]
        full = np.diff(row) > 0
        keep = np.ones(len(out), dtype=bool)
        keep[row[:-1][full]] = False
        offsets = np.concatenate([[0], np.cumsum(np.diff(row) - full)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out[keep].tobytes())]).cast(pa.binary())


def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Vocabulary.load(path, alpha)
    return _LOADED[path, alpha]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", seed: int = 42, alpha: float = 1.0, spelled: str | None = None) -> DataFrame:
    """docs with one more column, pieces array<int>: one sampled segmentation of each text, reproducible by its row key.

    The row key is the id (null: zero), so rows with equal ids and texts get equal pieces. Null and empty texts have no
    pieces. Texts of any length are read whole; a chunk's lattice takes memory in proportion to its length. All columns of
    docs stay; one named pieces is replaced. An empty table gives none. ``spelled`` names a further column for what decode()
    would give of the pieces, in the same worker: two in a row hold model and batches twice at once.
    """
    path = tokenizer_file(model)
    rest = [c for c in docs.columns if c not in ("pieces", spelled)]
    names = [*rest, "pieces", *([spelled] if spelled else [])]
    ready = docs.select(*rest, F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col))).otherwise("").alias("_t"), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("_key"))
    at = len(rest)

    @W.trimmed

    def run(batches):
        known = vocabulary(path, alpha)
        for b in batches:
            for piece in W.pieces(b, at, _LIMIT):
                ids, n = known.sample(piece.column(at), piece.column(at + 1).to_numpy().view(np.uint64), seed)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                texts = [known.spell(ids, n).cast(pa.string())] if spelled else []
                yield pa.record_batch([*piece.columns[:at], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), *texts], names=names)

    schema = docs.select(*rest).withColumns({c: F.lit(None).cast("array<int>" if c == "pieces" else "string") for c in names[at:]}).schema
    return ready.mapInArrow(run, schema)


def decode(rows: DataFrame, pieces_col: str = "pieces", model: str = "piece_bpe_32k.model", to: str = "decoded") -> DataFrame:
    """rows with one more column: the text that the pieces spell, exactly the one encoded. Null pieces give null, none an empty text."""
    path = tokenizer_file(model)
    rest = [c for c in rows.columns if c != to]
    at = rest.index(pieces_col)

    @W.trimmed

    def run(batches):
        known = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column(at)
                texts = known.spell(lists.flatten().to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)).cast(pa.string())
                yield pa.record_batch([*part.columns, pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)], names=[*rest, to])

    return rows.select(*rest).mapInArrow(run, rows.select(*rest).withColumn(to, F.lit(None).cast("string")).schema)
