"""URL filter: listed rules first, else the ratio of two character models of variable order.

URLs that a rule allows and URLs that a rule blocks each train a Markov model over bytes. A context of up to ORDER bytes is
part of a model if it stands often enough; a longer context backs off to a shorter one by Witten-Bell smoothing, down to the
uniform distribution. The difference of log-likelihoods per byte is cut at the value that best balances both kinds of
error on the rule-judged URLs that the counts leave out.

A context stays if it stands LEAST times in a class, whatever the number of URLs, and all its continuations stay with it. Up to
BROADCAST contexts and continuations are sent to every worker; more stay a table, and each piece of URLs joins what it asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.lookup import asked, meet, numbered
from tidewatch.llm.store import drop, save

#: Longest context in bytes; least count of a context; one in FOLDS rule-judged URLs sets the cut; bins of that choice.
ORDER, LEAST, FOLDS, BINS, SPAN = 5, 2, 5, 4000, 8.0
#: Contexts and continuations that are broadcast at most.
BROADCAST = 2_000_000
_FLUSH = 1 << 21
_B = np.uint64(W.BASES[0])


@dataclass(frozen=True)
class Rule:
    """Fits hosts equal to or below host whose URL's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def contexts(raw: np.ndarray, offsets: np.ndarray):
    """For each order: positions with so long a context in their row, and the context's hash. Byte 0 of a row is its mark."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    depth = np.arange(len(raw)) - offsets[:-1][row]
    value = raw.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(raw), np.uint64)
    at = np.flatnonzero(depth > 0)
    for k in range(ORDER + 1):
        if k:
            at = at[depth[at] >= k]
            h[at] = h[at] * _B + value[at - k]
        yield at, W.mix(h[at] + W.mix(np.full(1, k, np.uint64)))


def _pair(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return W.mix(context ^ (byte.astype(np.uint64) + np.uint64(1)) * _B)


@dataclass
class Model:
    """Per class: counts n and numbers of followers t of contexts, counts of continuations; keys sorted."""

    context: np.ndarray
    n: np.ndarray
    t: np.ndarray
    pair: np.ndarray
    m: np.ndarray
    cut: float = 0.0

    @staticmethod
    def of(rows: pa.Table) -> Model:
        """rows: kind (0 context, 1 continuation), key, n0, n1 (counts), t0, t1 (followers). Rows that repeat a key are equal."""
        kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy().view(np.uint64)
        n, t = (np.stack([rows.column(f"{c}{k}").to_numpy() for k in (0, 1)]).astype(np.float64) for c in "nt")
        at = [np.flatnonzero(kind == k) for k in (0, 1)]
        at = [a[np.unique(key[a], return_index=True)[1]] for a in at]
        return Model(key[at[0]], n[:, at[0]], t[:, at[0]], key[at[1]], n[:, at[1]])

    def ratio(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood per byte under the allowed model less that under the blocked one; zero for no bytes."""
        raw, offsets = W.raw_bytes(column)
        p = np.full((2, len(raw)), 1 / 256)
        if len(self.context):
            for at, h in contexts(raw, offsets):
                i = np.minimum(np.searchsorted(self.context, h), len(self.context) - 1)
                known = self.context[i] == h
                at, h, i = at[known], h[known], i[known]
                key = _pair(h, raw[at])
                j = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                m = np.where(self.pair[j] == key, self.m[:, j], 0)
                n, t = self.n[:, i], self.t[:, i]
                p[:, at] = np.where(n > 0, (m + t * p[:, at]) / np.maximum(n + t, 1), p[:, at])
        log = np.log(p[0]) - np.log(p[1])
        log[offsets[:-1]] = 0
        total = np.concatenate([[0.0], np.cumsum(log)])
        n = np.diff(offsets) - 1
        return np.where(n > 0, (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1), 0.0)


@dataclass
class Tables:
    """The same model as a table of what Model.of takes."""

    rows: DataFrame
    cut: float = 0.0


def _asks(b: pa.RecordBatch, at: int) -> list[np.ndarray]:
    """kind, key of what a piece needs."""
    raw, offsets = W.raw_bytes(b.column(at))
    found = [(h, _pair(h, raw[i])) for i, h in contexts(raw, offsets)]
    key = [np.unique(np.concatenate([f[k] for f in found])).view(np.int64) for k in (0, 1)]
    return [np.repeat([0, 1], [len(key[0]), len(key[1])]), np.concatenate(key)]


def _over(rows: DataFrame, at: int, model: Model | Tables, work, schema) -> DataFrame:
    """work(model, batch) for all rows; column at holds the URL after its mark."""
    if isinstance(model, Model):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                for piece in W.pieces(b, at):
                    yield work(shared.value, piece)

        return rows.mapInArrow(run, schema)
    pieces = numbered(rows, at)
    found = asked(pieces, lambda b: _asks(b, at), ["kind", "key"], at).join(model.rows, ["kind", "key"])
    return meet(pieces, found, Model.of, work, schema, at)


def fit(urls: DataFrame) -> Model | Tables | None:
    """urls: u (the URL after a mark byte), y (0 allowed, 1 blocked). None where either kind is missing."""
    fold = F.pmod(F.xxhash64("u"), F.lit(FOLDS)) == 0

    def count(batches):
        held: list[tuple] = []

        def flush():
            context, byte, order, y = (np.concatenate([h[k] for h in held]) for k in range(4))
            _, first, inv = np.unique(_pair(context, byte), return_index=True, return_inverse=True)
            n = [np.bincount(inv, weights=y == c, minlength=len(first)).astype(np.int64) for c in (0, 1)]
            return pa.record_batch([pa.array(context[first].view(np.int64)), pa.array(byte[first].astype(np.int32)), *map(pa.array, n)], names=["h", "byte", "n0", "n1"])

        for b in batches:
            for piece in W.pieces(b, 0):
                raw, offsets = W.raw_bytes(piece.column(0))
                y = np.repeat(piece.column(1).to_numpy(), np.diff(offsets))
                for k, (at, h) in enumerate(contexts(raw, offsets)):
                    held.append((h, raw[at], np.full(len(at), k, np.int8), y[at]))
                if sum(len(h[0]) for h in held) >= _FLUSH:
                    yield flush()
                    held = []
        if held and sum(len(h[0]) for h in held):
            yield flush()

    pairs = save(urls.where(~fold).mapInArrow(count, "h long, byte int, n0 long, n1 long").groupBy("h", "byte").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = pairs.agg(F.sum("n0"), F.sum("n1")).first()
    if not total[0] or not total[1]:
        drop(pairs)
        return None
    context = pairs.groupBy("h").agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}") for c in (0, 1))).where(f"s0 >= {LEAST} OR s1 >= {LEAST}")
    told = save(context)

    def keyed(batches):
        for b in batches:
            key = _pair(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
            yield pa.record_batch([pa.array(np.ones(len(key), np.int64)), pa.array(key.view(np.int64)), b.column(2), b.column(3)], names=["kind", "key", "n0", "n1"])

    kept = pairs.join(told.select("h"), "h").select("h", "byte", "n0", "n1").mapInArrow(keyed, "kind long, key long, n0 long, n1 long")
    none = F.lit(0).cast("long")
    rows = save(told.select(none.alias("kind"), F.col("h").alias("key"), F.col("s0").alias("n0"), F.col("s1").alias("n1"), "t0", "t1").union(kept.select("*", none, none)))
    drop(pairs)
    drop(told)
    model = Model.of(rows.toArrow()) if rows.count() <= BROADCAST else Tables(rows)
    model.cut = _cut(urls.where(fold), model)
    return model


def _cut(urls: DataFrame, model: Model | Tables) -> float:
    """The ratio below which URLs are blocked, with the least mean of both error rates on urls; zero where a kind is missing."""

    def work(model: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.clip((model.ratio(b.column(0)) + SPAN) * BINS / (2 * SPAN), 0, BINS - 1).astype(np.int64)
        y = b.column(1).to_numpy()
        n = np.stack([np.bincount(at[y == c], minlength=BINS) for c in (0, 1)])
        some = np.flatnonzero(n.sum(axis=0))
        return pa.record_batch([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], names=["bin", "n0", "n1"])

    got = _over(urls.select("u", "y"), 0, model, work, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, BINS))
    for c in (0, 1):
        n[c][got.column("bin").to_numpy()] = got.column(f"n{c}").to_numpy()
    if not n[0].sum() or not n[1].sum():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1) / n.sum(axis=1, keepdims=True)
    error = below[0] + 1 - below[1]
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] * 2 * SPAN / BINS - SPAN)


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and ratio; existing columns of these names are replaced, all others stay.

    The longest fitting rule (host and path together) decides; URLs that none fits get the models' verdict: block where the
    ratio is below the cut. Null URLs and URLs without :// have an empty host and path; a null or empty URL has ratio zero.
    Repeated rows stay and get equal verdicts; each of them counts in the models. Very long URLs are read whole.
    Where the rules leave one kind of URL without example, there is nothing to compare and such URLs are allowed.
    """
    new = ("host", "path", "rule", "verdict", "ratio")
    host, path = parts(F.col(url_col))
    found = pages.select(*(c for c in pages.columns if c not in new or c == url_col), host.alias("host"), path.alias("path"), F.concat(F.lit("\x02"), F.coalesce(url_col, F.lit(""))).alias("_u"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, said = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(said)
    ruled = found.withColumns({"rule": rule, "verdict": said})
    model = fit(ruled.where("verdict IS NOT NULL").select(F.col("_u").alias("u"), (F.col("verdict") == "block").cast("int").alias("y")))
    if model is None:
        return ruled.drop("_u").withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "ratio": F.lit(0.0)})
    at = ruled.columns.index("_u")

    def work(model: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*b.columns, pa.array(model.ratio(b.column(at)))], names=[*b.schema.names, "ratio"])

    scored = _over(ruled, at, model, work, ruled.withColumn("ratio", F.lit(0.0)).schema)
    return scored.drop("_u").withColumn("verdict", F.coalesce("verdict", F.when(F.col("ratio") < model.cut, "block").otherwise("allow")))
