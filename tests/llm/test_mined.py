"""Spelling variants, hard negatives and main text against plain versions."""

import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import extract, negatives, spelling
from tidewatch.llm.queries import spoil

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(u, v):
    if u == v:
        return False
    i = 0
    while i < min(len(u), len(v)) and u[i] == v[i]:
        i += 1
    return u[i + 1 :] == v[i + 1 :] or u[i:] == v[i + 1 :] or u[i + 1 :] == v[i:]


def plain_variants(counts, ratio=5):
    form = {}
    near = {u: [v for v in counts if one_edit(u, v)] for u in counts}
    for u, found in near.items():
        if found:
            best = min(found, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[u]:
                form[u] = best
    out = set()
    for u, n in counts.items():
        root = u
        while root in form:
            root = form[root]
        out.add((u, n, len(near[u]), form.get(u), counts.get(form.get(u)), root))
    return out


def test_composition_finds_all_pairs_one_edit_apart():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(250)})
    a = spelling.Acceptor(words)
    assert len(a.accepts) < sum(map(len, words))
    found = list(zip(*(x.tolist() for x in spelling.one_edit_pairs(a, a))))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if one_edit(u, v)}


def test_spelling_variants_equal_plain_counts(spark, made, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)  # crowded partitions are dealt
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(11)
    bases = ["colour", "colours", "kalomi", "Öresund", "kalom", "latuka" * 4, "ababab", "abababab"]
    noisy = []
    for k in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(bases[:3] + bases)
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "é" + w[i + 1 :], w.upper()])
            words.append(w)
        noisy.append((1000 + k, " ".join(words)))
    rows = made + noisy + [noisy[0], (None, noisy[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n int, word string")
    counts = Counter()
    for i, t in rows:
        for run in RUNS.findall((t or "").translate(LOWER)):
            counts[spoil(i, run)] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = spelling.spelling_variants(docs, change=spoil)
    got = [tuple(r) for r in out.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(counts)
    assert sum(r[3] is not None for r in got) > 20


def test_forms_are_followed_to_the_end_and_odd_tables_pass(spark, no_docs):
    chain = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "x" * 3000: 5, "x" * 2999 + "y": 25}
    rows = [(w, n) for w, n in chain.items()] + [(None, 7), ("nothing", None)]
    out = spelling.variants(spark.createDataFrame(rows, "word string, n long"))
    assert {tuple(r) for r in out.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(chain)
    assert spelling.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, "word string, n long"), 1)


def plain_negatives(rows):
    """rows: id, label, vector; None anywhere takes no part; the first row of an id stands."""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and None not in v:
            good[i] = min(good.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, v) in good.items():
        if a % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            band = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out |= {(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(band)}
    return out


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 7)
    monkeypatch.setattr(negatives, "HELD", 64)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1500)  # several blocks of anchors
    rng = np.random.default_rng(2)
    base = rng.integers(-40, 40, (12, 6))
    rows = [(int(i), int(rng.integers(0, 4)), (base[rng.integers(0, 12)] + rng.integers(-9, 9, 6)).tolist()) for i in range(300)]
    same = rows[10][2]
    rows += [(1000 + k, k % 3, same) for k in range(60)]  # a crowd of equal vectors
    rows += [(2000 + k, 1, [0] * 6) for k in range(5)] + [(3000 + k, k % 2, [5, 5 - k]) for k in range(8)]
    rows += [(None, 1, same), (4000, None, same), (4005, 1, None), (4010, 1, [1, None, 2, 3, 4, 5]), (4015, 2, []), (10, 3, same), rows[20], (4020, 9, same)]
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, label int, v array<long>, score double")
    out = negatives.hard_negatives(table, F.col("id") % 5 == 0)
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = plain_negatives(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert negatives.hard_negatives(table.where("false"), F.col("id") % 5 == 0).count() == 0


def test_walks_stop_before_the_end_of_their_lists(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16)) * 300
    x = np.floor(centres[rng.integers(0, 8, 4000)] + rng.standard_normal((4000, 16)) * 8).astype(np.int64)
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    seen = []
    real = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    a = negatives.Anchors(ids[:64], labels[:64], x[:64])
    who, cand, score = negatives._walk(a, ids, labels, x, None, 5)
    assert sum(seen) < 64 * 4000 / 2
    for k in range(64):
        all_scores = x @ x[k]
        order = sorted((-all_scores[j], j) for j in range(4000) if labels[j] == labels[k] and j != k)[:5]
        assert [(-int(s), int(c)) for s, c in zip(score[who == k], cand[who == k])] == [(int(s), int(j)) for s, j in order]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>if (a < b) "</p>";</script><style>p{}</style></head><body class="nav sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-banner">We use cookies</div><!-- <p>no</p> -->
%s<aside>Side</aside><form><input>Search</form><div id="adTop">Buy</div><section class="post comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""


def test_blocks_leave_out_what_markup_names():
    found, inside = extract.blocks(PAGE % "<article class='no-comments'><header><h1>A &amp; B&nbsp;&#x43;</h1></header><p>One <b>bo</b>ld\n line<p>two<br>three <a href='>'>l<i>in</i>k</a><div class=share>Share</div><table><tr><td>c<td>d</table><p>a < b &lt; &unknown; &amp</article>")
    assert inside and [t for _, t in found] == ["A & B C", "One bold line", "two", "three link", "c", "d", "a < b < &unknown; &"]
    found, inside = extract.blocks(PAGE % "<div><p>Open text<div hidden><p>no</div><span aria-hidden='true'>no</span> goes on</div>")
    assert not inside and [t for _, t in found] == ["Open text", "goes on"]
    assert [t for _, t in extract.blocks("<form><div><main>in</main>out</div></form>")[0]] == ["in"]
    assert [t for _, t in extract.blocks("<main><p>m<article><p>a</article></main>")[0]] == ["a"]
    for odd, want in (("", []), ("plain", ["plain"]), ("<p>cut <b", ["cut"]), ("<!-- open", []), ("<p x=\"a>b", ["b"]), ("</p></div>x", ["x"]), ("<script>never closed", []), ("1 < 2 > 0", ["1 < 2 > 0"])):
        assert [t for _, t in extract.blocks(odd)[0]] == want, odd
    assert len(extract.blocks("<a" * 200_000)[0]) <= 1 and len(extract.blocks('<a "' * 50_000 + ">x")[0]) == 1


def plain_runs(pages, run=extract.RUN):
    """Which blocks a host repeats, by comparing all runs of all pages."""
    streams = [[(w, k) for k, (b, t) in enumerate(p) for w in (f"<{b}>", *t.split())] for p, _ in pages]
    inside = [i for _, i in pages]
    first = {}
    for k, (p, _) in enumerate(pages):
        first.setdefault(tuple(t for _, t in p), k)
    on = Counter()
    for flag in (False, True):
        for k in first.values():
            if inside[k] == flag:
                on.update({(flag, tuple(w for w, _ in streams[k][i : i + run])) for i in range(len(streams[k]) - run + 1)})
    out = []
    for k, (p, i) in enumerate(pages):
        share, least = extract.MAIN if i else extract.OPEN
        need = max(least, int(np.ceil(share * sum(inside[j] == i for j in first.values()))))
        covered = [False] * len(streams[k])
        for at in range(len(streams[k]) - run + 1):
            if on[i, tuple(w for w, _ in streams[k][at : at + run])] >= need:
                covered[at : at + run] = [True] * run
        if covered and sum(not c for c in covered) < extract.FRESH * len(covered):
            covered = [False] * len(covered)
        kept = [t for n, (_, t) in enumerate(p) if sum(c for c, (_, b) in zip(covered, streams[k]) if b == n) < extract.COVERED * (1 + len(t.split()))]
        out.append(" ".join(kept))
    return out


def test_main_text_equals_plain_comparison_of_runs(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sa"]) + rng.choice(["na", "ri", "so", ""]) for _ in range(n))
    menu = "<div class=x1><p>Start<p>News of the day<p>Contact us by mail or telephone<p>All rights belong to the owner of this site</div>"
    offer = "<p>Write your address here and get our letter on every single day"
    rows = []
    for host, n in (("a.org", 30), ("b.org", 3), ("c.org", 1)):
        for k in range(n):
            body = f"<p>{prose(40)}<p>{prose(25)}"
            wrap = f"<article>{body}{offer}</article>" if k % 2 else body
            rows.append((len(rows), f"http://{host}/{k}", f"<body>{menu}{wrap}<p>Published with care by the people of this place</body>"))
    rows += [(500, "http://a.org/copy", rows[0][2]), (500, "http://a.org/copy", rows[0][2]), (None, None, None), (501, "no host", "<p>alone"), (502, "http://b.org/e", "")]
    rows.append((503, "http://a.org/long", "<article>" + "".join(f"<p>{prose(60)}" for _ in range(800)) + "</article>"))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    hosts = {}
    for i, url, page in rows:
        hosts.setdefault(re.sub(r"^.*?://|/.*", "", url or "") if "://" in (url or "") else "", []).append((i, extract.blocks(page or "")))
    want = Counter()
    for found in hosts.values():
        want.update(zip((i for i, _ in found), plain_runs([b for _, b in found])))
    out = extract.main_text(table).collect()
    assert Counter((r.id, r.text) for r in out) == want
    texts = [r.text for r in out if r.url and r.url.startswith("http://a.org/") and r.id < 500]
    assert all("Contact" not in t and "Published" not in t and "Write your" not in t for t in texts) and all(len(t.split()) >= 60 for t in texts)
    assert extract.main_text(table.where("false")).count() == 0


def test_groups_of_a_large_host_report_to_each_other(spark, monkeypatch):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice = "<p>this line stands on each of the pages of the host and says nothing new"
    rows = [(k, f"http://big.org/{k}", f"<p>{prose(60)}{notice}") for k in range(80)]
    monkeypatch.setattr(extract, "GROUP", 4000)
    out = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.id: r.text for r in out} == {i: extract.blocks(h)[0][0][1] for i, _, h in rows}


def test_the_size_of_a_hosts_groups_changes_no_text(spark, monkeypatch):
    """Lines on a few pages, on a share of some groups only, near the least shares, in large pages and in copies."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line = [f"<p>{prose(14)}" for _ in range(60)]
    rows = []
    for k in range(150):
        main = k % 3 == 0
        shared = [line[k // 2 % 30]] + [line[30 + j] for j in range(30) if (k * 7919 + j * 104729) % 97 < 97 * (0.15 + j / 300 if not main else 0.7 + j / 150)]
        body = f"<p>{prose(60)}" + "".join(shared) + f"<p>{prose(30)}"
        rows.append((k, f"http://big.org/{k}", f"<article>{body}</article>" if main else body))
    rows += [(900 + k, "http://big.org/copy", rows[3][2]) for k in range(20)]
    rows += [(950 + k, f"http://wide.org/{k}", f"<p>{prose(700)}<p>{prose(700)}{line[k // 2]}" + (line[40] if k < 5 else "")) for k in range(12)]
    want = {}
    for host in ("big.org", "wide.org"):
        found = [(i, extract.blocks(h)) for i, url, h in rows if host in url]
        want |= dict(zip((i for i, _ in found), plain_runs([b for _, b in found])))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (3_000, 20_000, 6_000_000):
        monkeypatch.setattr(extract, "GROUP", size)
        assert {r.id: r.text for r in extract.main_text(table).collect()} == want, size


def test_token_files_order_odd_rows(spark, no_docs):
    """Null ids first, rows of one id together, an id that a third of the rows share in several parts, an empty table."""
    from tokenizers import Tokenizer

    from tidewatch.llm import tokens
    from tidewatch.llm.store import folder, tokenizer_file

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(8)
    rows = [(k if k % 3 else 30, f"word{rng.randrange(900)} text {k}") for k in range(300)] + [(None, "one"), (None, None), (None, "one"), (-(1 << 63) + 5, "low"), ((1 << 63) - 1, "high"), (30, "")]
    to = f"{folder(spark)}/tokens-test-{uuid.uuid4().hex}"
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), to, "word_bpe_49k.json", 2)
    got = sorted((r.start, r.n_ids, r.id, tuple(r.ids)) for r in tokens.read(spark, to).collect())
    ids = [r[2] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    assert [r[0] for r in got] == [sum(r[1] for r in got[:k]) for k in range(len(got))]
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in rows)
    assert Counter((r[2], r[3]) for r in got) == want
    tokens.write(no_docs, f"{to}-none", "word_bpe_49k.json", 2)
    assert tokens.read(spark, f"{to}-none").count() == 0
    bounds = np.array([5, 30, 30, 30, 40])
    h = np.array([-(1 << 63), -1, 0, (1 << 63) - 1])
    assert tokens.dealt(np.full(4, 30), h, bounds).tolist() == [1, 2, 3, 4] and tokens.dealt(np.array([4, 6, 41, 35]), h, bounds).tolist() == [0, 1, 5, 4]
