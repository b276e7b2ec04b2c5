import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import WORDS
from tidewatch.llm import graph, itq, simhash, substring, words


def lowest(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_print(text, size):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(text)
    parts = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups_equal_brute_force(docs, made):
    rows = [(i, t) for i, t in made if i not in (405,)]
    prints = {i: plain_print(t, 4) for i, t in rows}
    ids = sorted(prints)
    expected = lowest(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.near_duplicates(docs.where("doc_id <> 405")).collect()
    assert {r.id: (r.fp % 2**64, r.component) for r in got} == {i: (prints[i], expected[i]) for i in ids}
    assert expected[401] == expected[402] == 400 and expected[404] == 403 and expected[205] == 5


def test_trees_prune_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "SHARD", 64)
    classes = spark.createDataFrame(pa.table({"id": np.arange(len(fp)), "fp": fp.view(np.int64)}))
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    pairs = [(a, b) for a, b in zip(*np.nonzero(d <= 4)) if a < b]
    expected = lowest(range(len(fp)), pairs)
    got = {r.node: r.component for r in graph.components(simhash.links(classes), "a", "b").collect()}
    assert pairs and {i: got.get(i, i) for i in range(len(fp))} == expected


def test_simhash_null_ids_repeats_and_no_rows(spark, no_docs):
    rows = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q")], "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(100, 400)]
    hub = [(5000, 6000 + k) for k in range(500)]
    edges = spark.createDataFrame(path + hub + [(9, 9), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert got == {k: 100 for k in range(101, 401)} | {6000 + k: 5000 for k in range(500)}


def plain_repeats(rows, run):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - run + 1):
            if first.setdefault(tuple(w[k : k + run]), i) < i:
                gone[k : k + run] = [True] * run
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings_equal_brute_force(docs, made):
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()}
    assert got == plain_repeats(made, 13)
    assert got[205][2] == "" and got[105][1] >= 30


def test_substrings_flushing_often_and_carrying(docs, made, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 50)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs.select("doc_id", "text"), carry=("doc_id", "text")).collect()}
    assert got == {i: v[:2] for i, v in plain_repeats(made, 13).items()}


def test_substrings_null_and_shared_ids(spark, no_docs):
    text = " ".join(f"w{k}" for k in range(20))
    other = "head " + text
    rows = spark.createDataFrame([(1, text), (1, other), (None, text), (2, "x " + text), (2, other)], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(rows).collect())
    assert got == [(0, 20, 0), (1, 20, 0), (1, 21, 0), (2, 21, 20), (2, 21, 21)]
    assert substring.remove_repeats(no_docs).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x[100:200] = x[:100] + 0.08 * rng.standard_normal((100, 32))
    x[200:220] = x[3]
    rows = [(k, x[k].tolist(), int(k % 3 == 0)) for k in range(300)]
    bad = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0, None], 1), (904, x[3].tolist(), None), (None, x[3].tolist(), 1), (905, [], 0), (906, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & np.array([[a[2] == b[2] for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    expected = lowest(range(300), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    got = {r.id: (r.n_links, r.component, r.kept) for r in itq.near_vectors(df).collect()}
    found = sum(got[k][0] for k in range(300))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert sum(got[k][1] == expected[k] for k in range(300)) >= 0.9 * 300
    assert all(got[k][2] == (got[k][1] == k) for k in range(300))
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 905, 906)) and got[None] == (0, None, None)
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_words_and_joins():
    col = pa.array(["a  b\tc", None, "", " é\u00a0x \n"])
    w = words.split(col)
    assert w.count().tolist() == [3, 0, 0, 1]
    assert words.joined(w).to_pylist() == ["a b c", "", "", "é\u00a0x"]
    assert words.joined(w, np.array([True, False, True, False])).to_pylist() == ["a c", "", "", ""]
    h = words.split(pa.array(["x y", "y x"])).hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
