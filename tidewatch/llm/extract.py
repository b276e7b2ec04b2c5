"""Main text of web pages: what markup names as menus and the like goes, then what a suffix array of the host shows to be repeated.

A page is parsed into blocks of text. Blocks that stand in menus, footers, adverts, forms, comments and so on are left out by
their markup. The rest of a host's pages is concatenated into one stream of tokens (a mark of the block's element, then its
words) and sorted by suffix. Suffixes that agree in RUN tokens are neighbours; where such neighbours stand on enough pages
that differ, their tokens are covered. A block whose tokens are mostly covered is boilerplate; the others keep their text.

A large host is dealt, by content, into groups of about GROUP characters, each with its own suffix array. A run on a given
share of the host's pages is on that share of the pages of at least one group. What the groups report is therefore only asked
after: each group counts its pages with these runs, and the sums decide as one suffix array of the whole host would. Every
group then covers its pages by the host's list, so the size of a group changes no result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.blocks import groups
from tidewatch.llm.store import save
from tidewatch.llm.urls import parts

#: Tokens of a run; characters of html in a group.
RUN, GROUP = 8, 6_000_000
#: Share of a host's differing pages, and least number of them, that makes a run boilerplate: where no element holds the
#: main text, and inside one that does.
OPEN, MAIN = (0.2, 2), (0.8, 10)
#: A block goes if this share of its tokens is covered; a page with less than FRESH of its tokens uncovered is a copy and stays.
COVERED, FRESH = 0.8, 0.1

# Elements of HTML by their role.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "nobr", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "object", "svg", "canvas", "audio", "video", "map", "datalist"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "comment", "comments", "disqus", "replies", "respond", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "pagination", "pager", "toolbar",
}
#: An open element of the first kind ends where one of the second kind starts, unless one of the third stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?].*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(tag: str, attributes: str) -> bool:
    """Whether the attributes name something else than main text."""
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, text = name.lower(), value[0] or value[1] or value[2]
        if name in ("class", "id") and any(p.lower() in _MARKS for p in _PART.findall(text)):
            return True
        if name == "role" and text.strip().lower() in _ROLES or name == "hidden" or name == "aria-hidden" and text.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", text, re.I):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(element, text) of the page's blocks that markup leaves in, in page order, and whether they stand in an article or main.

    Blocks of articles stand alone if there are any, else those of main elements, else all.
    """
    stack: list[tuple[str, bool, int]] = []  # element, left out, 2 in an article, 1 in a main element
    found: list[tuple[str, int, str]] = []
    held: list[str] = []
    out, main = False, 0
    block = "body"
    last = page.rfind(">") + 1

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                found.append((block, main, text))
            held.clear()

    def state() -> None:
        nonlocal out, main
        out, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at, last)
        text = page[at : m.start()] if m else _UNFINISHED.sub("", page[at:])
        if text and not out:
            held.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        inline = tag in _INLINE
        if not inline and not out:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if inline and stack[k][1]:
                        flush()
                    del stack[k:]
                    state()
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if tag in _VOID:
            continue
        if not inline:
            ends, fence = _ENDS.get(tag, ({"p"}, ()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in fence or tag not in _ENDS and stack[k][0] != "p":
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    state()
                    break
            block = tag
        if tag in ("article", "main") and out and next(s[0] for s in stack if s[1]) == "form":
            out = False  # some pages are one form as a whole
        left_out = out or (tag in _OUT and not (tag == "header" and main)) or _marked(tag, m[3])
        if inline and not left_out:
            continue
        if left_out and not out and inline:
            flush()
        if not m[3].endswith("/") or tag not in ("svg", "canvas"):
            stack.append((tag, left_out, max(main, {"main": 1, "article": 2}.get(tag, 0))))
            state()
    if not out:
        flush()
    inside = max((m for _, m, _ in found), default=0)
    return [(b, t) for b, m, t in found if m == inside], inside > 0


def _tokens(pages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, page and block (numbered over all pages) of every token."""
    texts = [f"<{b}> {t}" for page in pages for b, t in page]
    w = W.split(pa.array(texts, pa.large_string()))
    of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    return w.hashes(), of[w.doc], w.doc


def suffix_ranks(token: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by doubling, up to run tokens: positions whose run stays on its page and stands elsewhere too, and their ranks.

    Equal ranks are suffixes that agree in run tokens. Order beyond these changes no result, so doubling stops there. A suffix
    that is alone with its rank is settled and takes no further part.
    """
    size = len(token)
    _, rank, n = np.unique(token, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[rank] > 1)
    have = 1
    while have < run:
        step = min(have, run - have)
        at = at[at + step + have <= size]
        _, new, n = np.unique(rank[at] * (2 * size + 1) + rank[at + step], return_inverse=True, return_counts=True)
        rank = len(n) + np.arange(size)
        rank[at] = new
        at = at[n[new] > 1]
        have += step
    at = at[page[at] == page[at + run - 1]]
    return at, rank[at]


def repeats(token: np.ndarray, page: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of runs that enough of the pages share (no two of them alike): those of open pages and those of pages with a main element."""
    at, rank = suffix_ranks(token, page, RUN)
    out = []
    for flag, (share, least) in ((False, OPEN), (True, MAIN)):
        own = np.flatnonzero(inside[page[at]] == flag)
        pairs = np.unique(rank[own] * len(inside) + page[at[own]])
        values, n = np.unique(pairs // len(inside), return_counts=True)
        frequent = values[n >= max(least, int(np.ceil(share * (inside == flag).sum())))]
        out.append(_named(token, at[own[np.isin(rank[own], frequent)]], flag))
    return np.unique(np.concatenate(out))


def page_counts(token: np.ndarray, page: np.ndarray, inside: np.ndarray, asked: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of runs and how many of the pages (no two of them alike) hold each, for open pages and those with a main element.

    Without ``asked``: the runs on the group's own share of its pages; where one page is that share, all runs.
    """
    name, at = W.grams(token, page, RUN)
    if asked is not None:
        hit = np.isin(name, asked) | np.isin(name ^ np.uint64(1), asked)
        name, at = name[hit], at[hit]
    again = np.zeros(len(token), dtype=bool)
    if asked is None:
        again[suffix_ranks(token, page, RUN)[0]] = True
    out = []
    for flag, (share, _) in ((False, OPEN), (True, MAIN)):
        least = 1 if asked is not None else max(1, int(np.ceil(share * (inside == flag).sum())))
        own = (inside[page[at]] == flag) & (again[at] | (least == 1))
        run, where = name[own] ^ np.uint64(flag), page[at[own]]
        order = np.lexsort((where, run))
        run, where = run[order], where[order]
        first = np.ones(len(run), dtype=bool)
        first[1:] = (run[1:] != run[:-1]) | (where[1:] != where[:-1])
        values, n = np.unique(run[first], return_counts=True)
        keep = n >= least
        if asked is not None:
            keep &= np.isin(values, asked)
        out.append((values[keep], n[keep]))
    return out


def _named(token: np.ndarray, at: np.ndarray, flag: bool | np.ndarray) -> np.ndarray:
    """A hash of the runs at these places; runs of open pages and of others are told apart."""
    if not len(at):
        return np.zeros(0, np.uint64)
    h, _ = W.grams(token[at[:, None] + np.arange(RUN)].ravel(), np.repeat(np.arange(len(at)), RUN), RUN)
    return h ^ np.asarray(flag, dtype=np.uint64)


def unique_text(pages: list[list[tuple[str, str]]], inside: np.ndarray, known: np.ndarray) -> list[tuple[str, int]]:
    """Each page's text without the blocks that known runs cover, and how many blocks went."""
    token, page, block = _tokens(pages)
    at = np.arange(max(0, len(token) - RUN + 1))
    at = at[page[at] == page[at + RUN - 1]]
    hit = at[np.isin(_named(token, at, inside[page[at]]), known)]
    mark = np.zeros(len(token) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + RUN, -1)
    covered = np.cumsum(mark[:-1]) > 0
    n_blocks = sum(len(p) for p in pages)
    size = np.bincount(block, minlength=n_blocks)
    dead = np.bincount(block, weights=covered, minlength=n_blocks) >= COVERED * size
    total = np.bincount(page, minlength=len(pages))
    fresh = np.bincount(page, weights=~covered, minlength=len(pages)) >= FRESH * total
    out, k = [], 0
    for p, page_blocks in enumerate(pages):
        gone = dead[k : k + len(page_blocks)] & fresh[p]
        k += len(page_blocks)
        out.append((" ".join(t for (_, t), g in zip(page_blocks, gone) if not g), int(gone.sum())))
    return out


def _squeezed(rows: list) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))


def _opened(blob: bytes) -> list:
    return json.loads(zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass"))


def _content(page: list[tuple[str, str]]) -> int:
    return xxhash.xxh64_intdigest("\n".join(t for _, t in page).encode("utf-8", "surrogatepass"), 13) >> 1


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one host and group in a batch, parsed, as one compressed row."""
    for b in batches:
        for piece in W.pieces(b, b.schema.get_field_index("html"), 1 << 22):
            held: dict[tuple[str, int], list] = {}
            dealt: dict[str, int] = {}
            for who, url, host, n_groups, raw in zip(*(piece.column(c).to_pylist() for c in ("id", "url", "host", "groups", "html"))):
                found, inside = blocks(raw or "")
                content = _content(found)
                dealt[host] = n_groups
                held.setdefault((host, content % n_groups), []).append((who, url, inside, content, found))
            yield pa.record_batch(
                [pa.array([h for h, _ in held], pa.string()), pa.array([g for _, g in held], pa.int64()), pa.array([dealt[h] for h, _ in held], pa.int64()), pa.array([_squeezed(rows) for rows in held.values()], pa.binary())],
                names=["host", "part", "groups", "z"])


def _distinct(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a group's pages, their pages, and which of these have a main element; pages with the same blocks count as one."""
    one = list({r[3]: r for r in rows}.values())
    token, page, _ = _tokens([r[4] for r in one])
    return token, page, np.array([r[2] for r in one], dtype=bool)


def _spare(pages: int, share: float) -> int:
    """On how many of a group's pages a run may be that the group does not report."""
    return max(0, int(np.ceil(share * pages)) - 1)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of a host: its pages, compressed again, and the runs its suffix array shows to be repeated.

    The group of an undivided host names its runs. One of many groups gives its numbers of open pages and of others, and the
    runs on its share of them with the number of pages beyond what an unreported run could be on.
    """
    for t in groups(batches, ["host", "part"]):
        rows = [r for z in t.column("z").to_pylist() for r in _opened(z)]
        token, page, inside = _distinct(rows)
        known, found = np.zeros(0, np.uint64), []
        if t.column("groups")[0].as_py() == 1:
            known = repeats(token, page, inside)
        else:
            found = page_counts(token, page, inside)
        pages = [int((~inside).sum()), int(inside.sum())]
        over = [n - _spare(pages[k], share) for k, ((_, n), (share, _)) in enumerate(zip(found, (OPEN, MAIN)))]
        lists = [pa.array([np.concatenate(x or [np.zeros(0, np.int64)])], pa.list_(pa.int64())) for x in ([v.view(np.int64) for v, _ in found], over, [np.full(len(v), k) for k, (v, _) in enumerate(found)])]
        yield pa.record_batch(
            [t.column("host").chunk(0)[:1], t.column("groups").chunk(0)[:1], pa.array([pages], pa.list_(pa.int64())), pa.array([known.view(np.int64)], pa.list_(pa.int64())), *lists, pa.array([_squeezed(rows)], pa.binary())],
            names=["host", "groups", "pages", "runs", "maybe", "over", "flag", "z"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of each group's pages hold the runs its host asks after."""
    for b in batches:
        for host, asked, z in zip(b.column("host"), b.column("asked"), b.column("z")):
            token, page, inside = _distinct(_opened(z.as_py()))
            for flag, (run, n) in enumerate(page_counts(token, page, inside, asked.values.to_numpy(zero_copy_only=False).view(np.uint64))):
                yield pa.record_batch([pa.repeat(host, len(run)), pa.array(np.full(len(run), flag), pa.int64()), pa.array(run.view(np.int64)), pa.array(n, pa.int64())], names=["host", "flag", "run", "n"])


def _divided(held: DataFrame) -> DataFrame:
    """host, run: what is repeated on hosts of several groups.

    A run that a group does not report is on fewer of its pages than its share. So a run's reported numbers and the most that
    the other groups may add bound its pages from above; only runs whose bound reaches the host's least number are counted in
    all groups. Where groups hold few pages nearly all their runs are reported, and the bound leaves out what few pages have.
    """
    groups = held.where("groups > 1")
    wanted = lambda pages, share, least: F.greatest(F.lit(least), F.ceil(F.lit(share) * pages)).cast("long")
    spare = lambda pages, share: F.greatest(F.lit(0), F.ceil(F.lit(share) * pages) - 1).cast("long")
    pages = [F.col("pages")[k] for k in (0, 1)]
    per = groups.groupBy("host").agg(*[F.sum(pages[k]).alias(f"p{k}") for k in (0, 1)], *[F.sum(spare(pages[k], share)).alias(f"s{k}") for k, (share, _) in enumerate((OPEN, MAIN))])
    need = save(per.select("host", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("flag"), wanted(F.col(f"p{k}"), *rule).alias("least"), F.col(f"s{k}").alias("spare")) for k, rule in enumerate((OPEN, MAIN))])).alias("n")).select("host", "n.*"))
    said = groups.select("host", F.explode(F.arrays_zip("flag", "maybe", "over")).alias("r")).select("host", F.col("r.flag").alias("flag"), F.col("r.maybe").alias("run"), F.col("r.over").alias("over"))
    bound = said.groupBy("host", "flag", "run").agg(F.sum("over").alias("over")).join(need, ["host", "flag"]).where("over + spare >= least")
    asked = save(bound.groupBy("host").agg(F.collect_set("run").alias("asked")))
    counts = groups.select("host", "z").join(asked, "host").select("host", "asked", "z").mapInArrow(_counted, "host string, flag long, run long, n long")
    return counts.groupBy("host", "flag", "run").agg(F.sum("n").alias("n")).join(need, ["host", "flag"]).where("n >= least").select("host", "run")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for known, z in zip(b.column("known"), b.column("z")):
            rows = _opened(z.as_py())
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                if known.is_valid:
                    texts = unique_text([r[4] for r in part], np.array([r[2] for r in part], dtype=bool), known.values.to_numpy(zero_copy_only=False).view(np.uint64))
                else:
                    texts = [(" ".join(t for _, t in r[4]), 0) for r in part]
                yield pa.record_batch(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array([t for t, _ in texts], pa.string()),
                     pa.array([len(r[4]) for r in part], pa.int64()), pa.array([g for _, g in texts], pa.int64())],
                    names=["id", "url", "text", "n_blocks", "n_repeated"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id, url, text, n_blocks, n_repeated: each row's main text, the blocks that markup left in, and how many the host repeats.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. If a page
    has an article or main element, blocks outside of it go. A run of RUN tokens is boilerplate on OPEN's share of a host's
    pages (MAIN's inside an article or main element); pages with the same blocks count as one. Pages that are covered almost
    whole are copies and lose nothing.

    Null html and pages without text give an empty text; null URLs and those without :// form one host. Repeated rows and
    rows with null or equal ids are rows of their own. Html may be malformed, truncated or very long (a page is never split).
    An empty table gives no rows; other columns are not read.
    """
    host, _ = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    # Both small sides are written first: their size is known, so that Spark sends them to the pages while they are small.
    large = save(rows.groupBy("host").agg(F.sum(F.length("html").cast("long")).alias("n")).where(F.col("n") > GROUP).select("host", F.ceil(F.col("n") / GROUP).cast("long").alias("groups")))
    dealt = rows.join(large, "host", "left").select("id", "url", "host", F.coalesce("groups", F.lit(1)).alias("groups"), "html")
    packed = dealt.mapInArrow(_parsed, "host string, part long, groups long, z binary")
    held = save(packed.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(
        _sorted_groups, "host string, groups long, pages array<long>, runs array<long>, maybe array<long>, over array<long>, flag array<long>, z binary"))
    runs = held.where("groups = 1").select("host", F.explode("runs").alias("run")).unionByName(_divided(held))
    known = save(runs.groupBy("host").agg(F.collect_set("run").alias("known")))
    return held.select("host", "z").join(known, "host", "left").select("known", "z").mapInArrow(_extracted, "id long, url string, text string, n_blocks long, n_repeated long")
