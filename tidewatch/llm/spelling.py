"""Spelling variants: words of a corpus one edit apart, found by composing finite-state machines.

The vocabulary is cut by initial state, so that no acceptor holds more than a block of words. A pair one edit apart that
shares its first KEY code points lies in one partition of the words as written. Any other pair has its edit among these
code points, so (words have at least 2 * KEY) it shares its last KEY and lies in one partition of the reversed words. In each
partition the words' remainders become a minimised acceptor; acceptor, one-edit transducer and acceptor are composed and the
accepted pairs enumerated. An arc carries how many words precede it, so a path's sum is the index of its word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.blocks import in_blocks
from tidewatch.llm.store import drop, save

#: Code points that name an initial state; words of one acceptor; distinct words a task counts before it hands them on.
KEY, BLOCK, HELD = 3, 16_384, 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LABELS = 1 << 21  # more than the number of code points


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words, built in one pass over them."""

    def __init__(self, words: list[str]):
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        size: list[int] = []
        path: list[tuple[int, list, bool]] = [(0, [], False)]  # label into the state, its finished arcs, accepts

        def close(depth: int) -> None:
            while len(path) > depth:
                label, arcs, accepts = path.pop()
                key = (accepts, tuple(arcs))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(states)
                    states.append(key)
                    size.append(accepts + sum(size[t] for _, t in arcs))
                if path:
                    path[-1][1].append((label, state))
                else:
                    self.start = state

        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            close(shared + 1)
            path += [(ord(c), [], False) for c in word[shared:]]
            label, arcs, _ = path[-1]
            path[-1] = (label, arcs, True)
            before = word
        close(0)
        degree = np.array([len(arcs) for _, arcs in states])
        self.accepts = np.array([a for a, _ in states], dtype=bool)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        flat = [arc for _, arcs in states for arc in arcs]
        self.label = np.array([x for x, _ in flat], dtype=np.int64)
        self.target = np.array([t for _, t in flat], dtype=np.int64)
        weight = np.array(size, dtype=np.int64)[self.target] if flat else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(weight)])
        owner = np.repeat(np.arange(len(states)), degree)
        self.skip = total[:-1] - total[self.first[owner]] + self.accepts[owner]
        self.arc = owner * _LABELS + self.label

    def arcs(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each arc that leaves one of the states: which of them, and the arc."""
        n = self.first[state + 1] - self.first[state]
        whose = np.repeat(np.arange(len(state)), n)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + self.first[state][whose]

    def step(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arc that each state has for the label, or -1."""
        if not len(self.arc):
            return np.full(len(state), -1)
        key = state * _LABELS + label
        at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
        return np.where(self.arc[at] == key, at, -1)


def one_edit_pairs(a: Acceptor, b: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in a, in b) of all pairs that acceptor a, exactly one edit and acceptor b accept together; each pair once.

    A state of the composition is a state of each acceptor and whether the edit has been made; with it go the indices so far.
    """

    def both(front, only_equal: bool):
        """Arcs of both sides taken at once: with equal labels, or (the replacing edit) with different ones."""
        p, q, i, j = front
        whose, x = a.arcs(p)
        if only_equal:
            y = b.step(q[whose], a.label[x])
            fits = y >= 0
        else:
            again, y = b.arcs(q[whose])
            whose, x = whose[again], x[again]
            fits = a.label[x] != b.label[y]
        whose, x, y = whose[fits], x[fits], y[fits]
        return a.target[x], b.target[y], i[whose] + a.skip[x], j[whose] + b.skip[y]

    def left(front):
        p, q, i, j = front
        whose, x = a.arcs(p)
        return a.target[x], q[whose], i[whose] + a.skip[x], j[whose]

    def right(front):
        p, q, i, j = front
        whose, y = b.arcs(q)
        return p[whose], b.target[y], i[whose], j[whose] + b.skip[y]

    zero = np.zeros(1, np.int64)
    same = (np.array([a.start]), np.array([b.start]), zero, zero)
    edited = tuple(np.zeros(0, np.int64) for _ in range(4))
    found = []
    while len(same[0]) or len(edited[0]):
        made = [both(edited, True), both(same, False), left(same), right(same)]
        edited = tuple(np.concatenate(c) for c in zip(*made))
        same = both(same, True)
        p, q, i, j = edited
        end = a.accepts[p] & b.accepts[q]
        found.append(np.stack([i[end], j[end]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def count_words(docs: DataFrame, min_length: int, min_count: int, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, str], str] | None = None) -> DataFrame:
    """Columns word, n: how often each run of letters (A-Z lower-cased) occurs, over all documents and whole texts.

    change(id, run) may replace a run first; it sees each distinct run of a document once. Tasks count before the shuffle.
    """

    def run(batches):
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")
        held: Counter[str] = Counter()
        for b in batches:
            for who, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer()
                if raw is None:
                    continue
                here = Counter(runs.findall(raw.to_pybytes().translate(_LOWER).decode()))
                if change:
                    for word, n in here.items():
                        new = change(who, word)
                        if len(new) >= min_length:
                            held[new] += n
                else:
                    held.update(here)
                if len(held) > HELD:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _near(t: pa.Table, ratio: int) -> pa.Table | None:
    """Of one block: for each member its number of near visitors and the best of those that may be its form."""
    side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
    words = np.array(t.column("word").to_pylist(), dtype=object)
    forward = t.column("part")[0].as_py() == 0
    rest = np.array([w[KEY:] if forward else w[-KEY - 1 :: -1] for w in words], dtype=object)
    member, visitor = (np.flatnonzero(side == s) for s in (0, 1))
    if not len(member) or not len(visitor):
        return None
    member, visitor = member[np.argsort(rest[member])], visitor[np.argsort(rest[visitor])]
    a = Acceptor(rest[member].tolist())
    b = a if np.array_equal(words[member], words[visitor]) else Acceptor(rest[visitor].tolist())
    u, v = one_edit_pairs(a, b)
    u, v = member[u], visitor[v]
    if not forward:  # pairs that share their first code points are found in the other partition
        head = np.array([w[:KEY] for w in words], dtype=object)
        apart = head[u] != head[v]
        u, v = u[apart], v[apart]
    if not len(u):
        return None
    able = n[v] >= ratio * n[u]
    order = np.lexsort((np.argsort(np.argsort(words))[v], -n[v], ~able, u))
    u, v, able = u[order], v[order], able[order]
    lead = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    best = v[lead]
    none = ~able[lead]
    return pa.table({
        "word": pa.array(words[u[lead]], pa.string()), "n_near": np.diff(np.append(lead, len(u))),
        "form": pa.array(words[best], pa.string(), mask=none), "form_n": pa.array(n[best], pa.int64(), mask=none)})


def variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """vocabulary: distinct word string (at least 2 * KEY code points), n long. Columns word, n, n_near, form, form_n, root.

    Two words are near if exactly one inserted, deleted or replaced code point turns one into the other. A word's form is its
    near word with the largest n (ties: first by code points), if that is at least ratio (over 1) times its own n; following
    forms ends at its root. Words without near words keep n_near 0, a null form and themselves as root. Repeated words are
    added up, null words and null counts left out; an empty vocabulary gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could follow each other in a circle")
    words = save(vocabulary.groupBy("word").agg(F.sum("n").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"))
    halves = F.explode(F.array(*(
        F.struct(F.lit(part).cast("int").alias("part"), key.alias("key"), F.lit(side).cast("byte").alias("side"))
        for part, key in ((0, F.substring("word", 1, KEY)), (1, F.expr(f"right(word, {KEY})"))) for side in (0, 1))))
    rows = words.select("word", "n", F.xxhash64("word").alias("id"), halves.alias("h")).select("word", "n", "id", "h.*")
    near = in_blocks(rows, ["part", "key"], BLOCK, lambda t: _near(t, ratio), "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w"))))
    told = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    out = save(words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.w").alias("form"), (-F.col("b.n")).alias("form_n")))
    return out.join(_roots(out, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(out: DataFrame, ratio: int) -> DataFrame:
    """Where following forms ends, for words that have one. A chain has at most log(max n) / log(ratio) links; each round doubles the reach."""
    up = save(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio)))):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = save(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(up)
        up = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
        up._saved_at = new._saved_at
    return up


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """Words of the texts (runs of letters A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) with their spelling variants: columns of variants().

    Words have at least min_length code points (2 * KEY or more) and min_count occurrences. Null and empty texts have no
    words, repeated rows count again, a null id is passed to change as None, other columns are not read. Texts and runs may
    be of any length. An empty table gives no rows.
    """
    if min_length < 2 * KEY:
        raise ValueError(f"words need at least {2 * KEY} code points")
    return variants(count_words(docs, min_length, min_count, id_col, text_col, change), ratio)
