"""Token ids of whole texts in compact files: frequency-ranked ids, one to four bytes each, lengths in control bytes.

A written folder holds two tables. `ranks` maps a rank to its id, most frequent first. `blocks` holds the documents in
ascending id order: a row has the number of its part, its place in it, how many ids stand before it in the part, its
documents (`docs`, `counts`, 64-bit), the control bytes and the data bytes. A control byte holds the byte lengths of four
ranks, two bits each, lowest first; `data` holds the ranks themselves, little-endian.

Tokenizing works on words: none of the tokenizers read here joins characters across ASCII white space, so a text's ids are
those of its words in turn, and each distinct word is encoded once per worker.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.store import drop, partitions, save, tokenizer_file

#: Words that a worker remembers at most; ids of a block, beyond which a new one begins; bytes of text looked at together.
REMEMBERED, BLOCK_IDS, PIECE = 1_000_000, 1 << 20, 1 << 21
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int8) + 1
#: Byte-level stand-ins: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_STAND_IN = {b: chr(256 + k) for k, b in enumerate(_OTHERS)}
_LETTER, _PUNCTUATION = np.zeros((2, 256), dtype=bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_WORKER: dict[str, Encoder] = {}


class Encoder:
    """Ids of many words at once; the first REMEMBERED distinct words are looked up, others encoded again where they occur."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: Whether a run of lower-case letters reaches the model as it is, each byte by its stand-in.
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and "[\\p{L}]+" in told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.model = self.tokenizer.model
        self.tails: dict[str, list[int]] = {}
        self.slot: dict[str, int] = {}
        self.begin = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def letters(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_STAND_IN))]

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words and where each word's begin. Letters with stops after them go to the model directly; the whole
        tokenizer, which takes several times as long, sees the rest."""
        found: list[list[int] | None] = [None] * len(words)
        rest = []
        for k, word in enumerate(words):
            stem = word.rstrip(".,;:!?") if self.plain else ""
            low = stem.lower()
            if low.isalpha() and (stem.isascii() or ("Σ" not in stem and unicodedata.is_normalized("NFC", stem))):
                found[k] = self.letters(low)
                if len(stem) < len(word):
                    tail = word[len(stem) :]
                    if tail not in self.tails and len(self.tails) < 4096:
                        self.tails[tail] = self.letters(tail)
                    found[k] = found[k] + (self.tails.get(tail) or self.letters(tail))
            else:
                rest.append(k)
        for lo in range(0, len(rest), 4096):  # an encoding is large until only its ids are kept
            some = rest[lo : lo + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([words[k] for k in some], add_special_tokens=False)):
                found[k] = e.ids
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order, and the number of each row."""
        w = W.split(column)
        if not len(w):
            return np.zeros(0, np.int32), np.zeros(len(w.first) - 1, np.int64)
        data, starts, ends, first = self.units(w)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        solid = data[_inside(len(data), starts, ends)]
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        slot = np.fromiter(map(self.slot.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        at = np.flatnonzero(slot < 0)
        flat, begin = self.flat, self.begin
        if len(at):
            new = [distinct[i] for i in at.tolist()]
            more, where = self.fresh(new)
            slot[at] = np.arange(len(new)) + len(self.begin) - 1
            flat, begin = np.concatenate([flat, more]), np.concatenate([begin, begin[-1] + where[1:]])
            if len(self.slot) + len(new) <= REMEMBERED:
                self.slot.update(zip(new, slot[at].tolist()))
                self.flat, self.begin = flat, begin
        slots = slot[coded.indices.to_numpy()]
        n = begin[slots + 1] - begin[slots]
        ends = np.cumsum(n)
        take = np.repeat((begin[slots] - (ends - n)).astype(np.int32), n)
        take += np.arange(len(take), dtype=np.int32)
        return flat[take], np.diff(np.concatenate([[0], ends])[first])

    def units(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is looked up: words, but letters and the punctuation after them apart where the tokenizer keeps them apart
        anyway, and such letters in lower case. So one entry serves a word in all its surroundings. Also the first unit of each row."""
        if not self.plain:
            return w.data, w.starts, w.ends, w.first
        letter, high = _LETTER[w.data], w.data >= 128
        at = np.arange(len(w.data))
        stem = np.maximum(np.maximum.accumulate(np.where(_PUNCTUATION[w.data], -1, at))[w.ends - 1] + 1, w.starts)
        other = np.concatenate([[0], np.cumsum(~(letter | high))])
        clean = (stem > w.starts) & (other[stem] == other[w.starts]) & letter[stem - 1]
        data = np.where(_inside(len(w.data), w.starts[clean], stem[clean]), W._LOWER[w.data], w.data)
        cut = clean & (stem < w.ends)
        place = np.arange(len(w)) + np.cumsum(cut) - cut
        starts, ends = np.empty((2, len(w) + int(cut.sum())), dtype=np.int64)
        starts[place], ends[place] = w.starts, np.where(cut, stem, w.ends)
        starts[place[cut] + 1], ends[place[cut] + 1] = stem[cut], w.ends[cut]
        return data, starts, ends, np.append(place, len(starts))[w.first]


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in one of the ranges, none of which overlap."""
    mark = np.zeros(n + 1, dtype=np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    return np.cumsum(mark[:-1], dtype=np.int8).astype(bool)


def encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids with the end id after them."""
    at = np.cumsum(n)
    return np.insert(ids, at, end), n + 1


def pack(rank: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    rank = np.ascontiguousarray(rank, dtype="<u4")
    extra = (rank > 0xFF).astype(np.uint8) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    code = np.zeros(-(-len(rank) // 4) * 4, dtype=np.uint8)
    code[: len(rank)] = extra
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = rank.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() packed; lengths come from a table by control byte."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    end = np.cumsum(length, dtype=np.int64)
    begin = end - length
    out = raw[begin].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranks(seen: DataFrame, size: int) -> np.ndarray:
    """Ids by falling count, then by id. seen: ids and their counts of one task a row, as arrays; rows are added up where they
    are read. The vocabulary's size bounds what reaches the driver."""

    def add(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    found = seen.mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, dtype=np.int64)
    total[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return np.lexsort((np.arange(size), -total)).astype(np.int32)


def dealt(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each row's part: parts follow each other in the order of (id, hash). An id that several bounds name, because very many
    rows share it, is cut among their parts by its hashes."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = ((hashes >> 32) + (1 << 31)) / float(1 << 32)  # 0 to 1, rising with the hash
    return (low + np.floor(share * (high - low + 1))).astype(np.int32)


def _bounds(ids: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the table into parts of about equal size."""
    if parts == 1:
        return np.zeros(0, np.int64)
    found = ids.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (10 * parts))
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in found], dtype=np.int64)


def _opened(ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(ids), dtype="<u4")


def write(docs: DataFrame, to: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row, each document's end id included, in ascending id order (null ids first).

    Texts are tokenized where they are read; ids, not texts, are then put in order, by bounds from the id column alone, made
    into blocks and counted in one pass, and the blocks written again with ranks. Null and empty texts have the end id alone.
    Rows that share an id, or have none, stand in the order of a hash of their text; equal rows in any order. An empty table
    writes no block. A lost task is run again and Spark commits the files of one attempt only.
    """
    spark = docs.sparkSession
    path = tokenizer_file(tokenizer)
    size = encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
    small = np.dtype("<u2") if max(size, end + 1) <= 1 << 16 else np.dtype("<u4")
    names = ["part", "seq", "base", "n_ids", "docs", "counts"]
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NULL))).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))
    parts = partitions(spark)
    bounds = _bounds(texts, parts)

    def tokenized(batches):
        for b in batches:
            for piece in W.pieces(b, 2, PIECE):
                ids, n = with_end(*encoder(path).ids(piece.column(2)), end)
                offsets = (np.concatenate([[0], np.cumsum(n)]) * small.itemsize).astype(np.int64)
                coded = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(small))])
                part = dealt(piece.column(0).to_numpy(), piece.column(1).to_numpy(), bounds)
                yield pa.record_batch([pa.array(part), piece.column(0), piece.column(1), coded.cast(pa.binary())], names=["part", "id", "h", "ids"])

    def blocks(batches):
        seq, base, total = 0, 0, np.zeros(max(size, end + 1), dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part = TaskContext.get().partitionId()

        def row(**has):
            has = {"part": part, "seq": seq, "base": base} | has
            return pa.record_batch([pa.array([has.get(c)], k) for c, k in kinds.items()], names=list(kinds))

        def block():
            ids, docs_, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            total[:] += np.bincount(ids, minlength=len(total))
            return row(n_ids=len(ids), docs=docs_.tobytes(), counts=n.tobytes(), ids=zstandard.compress(ids.astype("<u4").tobytes(), 1))

        for b in batches:
            data = b.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] // small.itemsize
            flat = np.frombuffer(data.buffers()[2], small)
            docs_, lo = b.column("id").to_numpy(), 0
            while lo < len(docs_):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_IDS, "right")) - 1)
                held.append((flat[offsets[lo] : offsets[hi]], docs_[lo:hi], np.diff(offsets[lo : hi + 1])))
                lo = hi
                if sum(len(h[0]) for h in held) >= BLOCK_IDS:
                    out = block()
                    yield out
                    seq, base, held = seq + 1, base + out.column("n_ids")[0].as_py(), []
        if held:
            yield block()
        if total.any():
            at = np.flatnonzero(total)
            yield row(seq=-1, seen=at.astype(np.int32), n_seen=total[at])

    kinds = {"part": pa.int64(), "seq": pa.int64(), "base": pa.int64(), "n_ids": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "ids": pa.binary(), "seen": pa.list_(pa.int32()), "n_seen": pa.list_(pa.int64())}
    moved = texts.mapInArrow(tokenized, "part int, id long, h long, ids binary").repartitionById(parts, F.col("part")).sortWithinPartitions("id", "h")
    plain = save(moved.drop("part", "h").mapInArrow(blocks, "part long, seq long, base long, n_ids long, docs binary, counts binary, ids binary, seen array<int>, n_seen array<long>"))
    order = ranks(plain.where("seq < 0").select("seen", "n_seen"), max(size, end + 1))
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order))
    of = spark.sparkContext.broadcast(rank)
    spark.createDataFrame(pa.table({"rank": np.arange(len(order), dtype=np.int32), "id": order})).coalesce(1).write.parquet(f"{to}/ranks")

    def ranked(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                control, data = pack(of.value[_opened(row.column(6)[0].as_py())])
                yield pa.record_batch([*row.columns[:6], pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=[*names, "control", "data"])

    plain.where("seq >= 0").drop("seen", "n_seen").mapInArrow(ranked, "part long, seq long, base long, n_ids long, docs binary, counts binary, control binary, data binary").write.parquet(f"{to}/blocks")
    drop(plain)


#: Stands for a null id in the blocks.
_NULL = np.iinfo(np.int64).min


def read(spark: SparkSession, at: str, digest: bool = False) -> DataFrame:
    """One row per document of a written folder: id, start (ids before it), n_ids, and its ids, or their CRC-32 if digest."""
    blocks = spark.read.parquet(f"{at}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toArrow()
    part, n = parts.column("part").to_numpy(), parts.column("n").to_numpy()
    order = np.argsort(part)
    before = dict(zip(part[order].tolist(), (np.cumsum(n[order]) - n[order]).tolist()))
    id_of = spark.read.parquet(f"{at}/ranks").orderBy("rank").toArrow().column("id").to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast((before, id_of))

    def decode(batches):
        before, id_of = shared.value
        for b in batches:
            for r in b.to_pylist():
                docs, counts = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.int64)
                ids = id_of[unpack(r["control"], r["data"], r["n_ids"])]
                end = np.cumsum(counts)
                start = end - counts
                if digest:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(start.tolist(), end.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([start, end[-1:]]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(
                    [pa.array(docs, mask=docs == _NULL), pa.array(start + r["base"] + before[r["part"]]), pa.array(counts), last],
                    names=["id", "start", "n_ids", "found"],
                )

    out = blocks.mapInArrow(decode, f"id long, start long, n_ids long, found {'long' if digest else 'array<int>'}")
    return out.withColumnRenamed("found", "crc32" if digest else "ids")
