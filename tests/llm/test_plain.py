"""The queries of op4 and op8 against plain recomputation with dictionaries, and the fit of op9 against its plain likelihood."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.llm import quality, toxicity, urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def hashed(spark, values, kind):
    """Spark's xxhash64 of each distinct value, which deals rows into folds."""
    df = spark.createDataFrame([(v,) for v in set(values)], f"v {kind}")
    return {r.v: r.h for r in df.select("v", F.xxhash64("v").alias("h")).collect()}


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_query_equals_plain_witten_bell(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url").collect()
    said = {}
    for r in rows:
        host, path = plain_parts(r.url)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        said[r.page_id] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    text = {r.page_id: "\x02" + (r.url or "") for r in rows}
    fold = hashed(spark, text.values(), "string")
    count = (defaultdict(Counter), defaultdict(Counter))
    for i, (_, _, _, v) in said.items():
        if v and fold[text[i]] % 5:
            raw, c = text[i].encode(), int(v == "block")
            for at in range(1, len(raw)):
                for k in range(min(at, urls.ORDER) + 1):
                    count[c][raw[at - k : at]][raw[at]] += 1
    kept = {x for c in count for x, n in c.items() if n.total() >= urls.LEAST}

    def ratio(t):
        raw, total = t.encode(), 0.0
        for at in range(1, len(raw)):
            p = [1 / 256, 1 / 256]
            for k in range(min(at, urls.ORDER) + 1):
                x = raw[at - k : at]
                for c in (0, 1):
                    if x in kept and x in count[c]:
                        n, t_ = count[c][x].total(), len(count[c][x])
                        p[c] = (count[c][x][raw[at]] + t_ * p[c]) / (n + t_)
            total += math.log(p[0] / p[1])
        return total / (len(raw) - 1) if len(raw) > 1 else 0.0

    score = {i: ratio(t) for i, t in text.items()}
    held = [(min(max(int((score[i] + urls.SPAN) * urls.BINS / (2 * urls.SPAN)), 0), urls.BINS - 1), v == "block") for i, (_, _, _, v) in said.items() if v and not fold[text[i]] % 5]
    kinds = [[b for b, y in held if y == c] for c in (False, True)]
    cut = 0.0
    if all(kinds):
        wrong = [sum(b < e for b in kinds[0]) / len(kinds[0]) + sum(b >= e for b in kinds[1]) / len(kinds[1]) for e in range(urls.BINS + 1)]
        best = [e for e, w in enumerate(wrong) if w <= min(wrong) + 1e-12]
        cut = best[len(best) // 2] * 2 * urls.SPAN / urls.BINS - urls.SPAN
    got = {r.page_id: r for r in entry.queries()["op4_url_filter"](spark, tiny).collect()}
    assert set(got) == set(said) and sum(v is None for *_, v in said.values()) > 10
    for i, (host, path, rule, v) in said.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and abs(got[i].ratio - score[i]) < 1e-9
        assert got[i].verdict == (v or ("block" if score[i] < cut else "allow")) or abs(score[i] - cut) < 1e-9


def test_toxicity_query_equals_plain_kneser_ney(spark, tiny):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect() if r.toxic is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    fold = hashed(spark, labels, "long")
    apart = {i for i in labels if fold[i] % toxicity.FOLDS == 0}
    marks = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum())
    split = lambda t: [x.encode() for x in re.findall(rf"[^\x20\x09-\x0d{marks}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    words = {i: split(t) for i, t in docs.items()}
    forms = lambda x: [("word", x), *((k, x[:k]) for k in toxicity.STEMS)]
    texts = defaultdict(set)
    for i in labels.keys() - apart:
        for x in words[i]:
            for u in forms(x):
                texts[u].add(i)
    known = {u for u, held in texts.items() if len(held) >= toxicity.MIN_TEXTS}
    unit = lambda x: next((u for u in forms(x) if u in known), None)
    column = sorted({x for i in labels for x in words[i]})
    bucket = dict(zip(column, (toxicity.units(toxicity.W.split(pa.array([x.decode() for x in column])))[0] % np.uint64(toxicity.STRANGE)).tolist()))
    n, inside = (Counter(), Counter()), defaultdict(set)
    for i in labels.keys() - apart:
        c = 0 if labels[i] else 1
        before = None
        for x in words[i]:
            n[c][before, unit(x)] += 1
            inside[before, unit(x)].add(i)
            before = unit(x) or ("rare", bucket[x])
    pairs = set(n[0]) | set(n[1])
    d = []
    for c in (0, 1):
        a, b = (sum(v == k for v in n[c].values()) for k in (1, 2))
        d.append(a / (a + 2 * b) if a and b else 0.75)
    context = lambda left: left if left in known else None
    kept = {p for p in pairs if context(p[0]) and len(inside[p]) >= toxicity.MIN_TEXTS}
    either, after = Counter(p[1] for p in pairs), [Counter(p[1] for p in n[c]) for c in (0, 1)]
    seen, held = [Counter(), Counter()], [Counter(), Counter()]
    for p in pairs:
        for c in (0, 1):
            seen[c][context(p[0])] += n[c][p]
            held[c][context(p[0])] += max(n[c][p] - d[c], 0) if p in kept else 0
    every = [*known, None]
    mass = sum(either[u] + 1e-3 for u in every)
    many = [sum(after[c][u] for u in every) for c in (0, 1)]
    cut = [sum(max(after[c][u] - d[c], 0) for u in every) for c in (0, 1)]
    P = [{u: (max(after[c][u] - d[c], 0) + (many[c] - cut[c]) * (either[u] + 1e-3) / mass) / many[c] for u in every} for c in (0, 1)]
    free = [{u: max(1 - held[c][u] / max(seen[c][u], 1), 1e-6) for u in every} for c in (0, 1)]
    trust = lambda k: k / (k + toxicity.TRUST)
    word = {u: trust(either[u]) * math.log(P[0][u] / P[1][u]) for u in every}
    ctx = {u: trust(seen[0][u] + seen[1][u]) * math.log(free[0][u] / free[1][u]) for u in every}
    bigram = {}
    for left, right in kept:
        p = [max(n[c][left, right] - d[c], 0) / max(seen[c][left], 1) + free[c][left] * P[c][right] for c in (0, 1)]
        t = trust(len(inside[left, right]))
        bigram[left, right] = t * math.log(p[0] / p[1]) + (1 - t) * (ctx[left] + word[right])

    def features(i):
        found = [unit(x) for x in words[i]]
        r = [bigram.get((b, a), word[a] + ctx[b]) for b, a in zip([None, *found], found)]
        if not r:
            return [0.0] * toxicity.FEATURES
        total, strong = np.concatenate([[0.0], np.cumsum(r)]), sum(max(x - toxicity.STRONG, 0) for x in r)
        ends = np.arange(len(r))
        worst = []
        for size in toxicity.WINDOWS:
            stop = np.minimum(ends + size, len(r))
            worst.append(((total[stop] - total[np.maximum(stop - size, 0)]) / size).max())
        return [total[-1] / len(r), math.log1p(strong), math.log1p(100 * strong / len(r)), *worst]

    x = np.array([[1.0, *features(i)] for i in sorted(apart)])
    y = np.array([labels[i] for i in sorted(apart)], float)
    ridge = np.array([1e-6, *[1e-2] * toxicity.FEATURES])
    w = np.zeros(len(ridge))
    for _ in range(200):  # damped Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 2 / np.abs(step).max())
    got = {r.doc_id: r for r in entry.queries()["op8_toxicity"](spark, tiny).collect()}
    assert set(got) == set(docs) and len({labels[i] for i in apart}) == 2
    for i in docs:
        want = 1 / (1 + math.exp(-float(np.clip(w[0] + np.dot(w[1:], features(i)), -500, 500))))
        assert abs(got[i].score - want) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2), i


def test_grade_weights_maximise_the_plain_likelihood(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 4000)
    monkeypatch.setattr(quality, "BITS", 4)
    rng = np.random.default_rng(2)
    rows = [[(int(k), float(v)) for k, v in zip(rng.choice(12, 3, replace=False), rng.random(3))] for _ in range(120)]
    grade = np.array([min(3, max(0, int(sum(v * (k - 5) for k, v in r) / 3 + 1.5 + rng.normal()))) for r in rows])
    row, place, value = (np.array(c) for c in zip(*[(i, k, v) for i, r in enumerate(rows) for k, v in r]))
    model = quality.train(row, place, value, grade, 4)

    def loss(weight, threshold):
        total = 0.0
        for r, g in zip(rows, grade):
            x = sum(weight[k] * v for k, v in r)
            below = [0.0, *(1 / (1 + math.exp(x - t)) for t in threshold), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows) + quality.RIDGE / 2 * sum(w * w for w in weight)

    best = loss(model.weight, model.threshold)
    for k in range(12):
        for step in (-0.3, 0.3):  # steps of constant length end near the optimum, not on it
            moved = model.weight.copy()
            moved[k] += step
            assert loss(moved, model.threshold) > best
    for k in range(3):
        for step in (-0.1, 0.1):
            moved = model.threshold.copy()
            moved[k] += step
            assert loss(model.weight, moved) > best


def test_fits_see_one_row_of_a_repeated_id(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 30, 12)) + (" awful" if k % 2 else " nice"), k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    often = df.union(df.where("doc_id = 7").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("x"))
    ratings = df.select("doc_id", F.col("toxic").alias("grade"))
    once = quality.fit(df, ratings, 2, "doc_id", "text", "grade")
    many = quality.fit(often, ratings, 2, "doc_id", "text", "grade")
    assert np.abs(once.weight - many.weight).max() < 1e-6 and quality.grade(often, ratings, 2).count() == 700
    assert quality.grade(df.limit(0), ratings, 2).count() == 0
    odd = spark.createDataFrame([(900, ""), (901, None), (902, "word " * 40_000)], "doc_id long, text string")
    out = {r.doc_id: r.expected_grade for r in quality.grade(df.select("doc_id", "text").union(odd), ratings, 2).where("doc_id >= 900").collect()}
    assert len(out) == 3 and out[900] == out[901] and all(0 <= g <= 1 for g in out.values())
    assert toxicity.score(often.drop("toxic"), df.select("doc_id", "toxic")).count() == 700
