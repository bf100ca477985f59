"""Main text of web pages: a suffix array over the pages of a host, and the structure of each page.

Different texts of a host are taken in groups of about ``GROUP``. In a group the token streams of all texts are put one after another; suffixes are
sorted by prefix doubling up to ``RUN`` tokens, and equal neighbours give the runs of the group with the number of their texts. A run of a large enough part of
the host's texts is one of that part of some group's; those that are get counted in all groups of the host, so how a host is dealt out decides nothing. Tokens
covered by a run that many pages with different texts share are boilerplate; unique runs stay. On a host that has a page with text but without any mark, texts that
have half of their runs of ``SHINGLE`` words in common, also by way of others, are copies of one: what they share is no boilerplate for that. So is a page
that is mostly boilerplate without any mark, whose runs then stay. Such texts are found by their rarest shingles and compared whole.

Repetition alone is no proof: whole articles are copied, and passages repeat across articles, while a menu may stand on
one page only. So structure comes in: what the page itself marks as its article is kept, also if other
pages repeat it (more than half of it is in shared runs), but for whole blocks of shared runs in an article that is otherwise its own; what it marks as menu, header, footer, sidebar, notice, advert, form or reader comments goes even if none does. Runs
decide on what is marked as neither.

A form or a part of a class name (``page-comments``) may stand around the whole page: an article in it is kept if the page marks no other
and it is longer than the unmarked text. ``post-header`` and the like in an article are kept as its header.

Null pages are empty and give an empty text. A null or unreadable address is a host of its own kind, "". Repeated rows are
pages each, and do not count as different texts. Unclosed tags end with what they stand in, unclosed comments with the page. Empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpath.llm.components import components
from cellpath.llm.staged import keep, stage
from cellpath.llm.words import grams, mix
from cellpath.session import bucketed_table

RUN = 8
GROUP = 128
#: Copies of a page that a group of texts may hold; others go to groups of copies.
COPIES = 64
#: Words of a shingle, and the similarity of their sets from which texts are near copies.
SHINGLE = 5
ALIKE = 0.5
#: Pages with different texts that must share a run, at least and as a part of the host's.
LEAST_PAGES = 3
SHARE = 0.3
#: Large hosts up to this number are broadcast (names and counts, some 10 MB); more are joined by shuffling.
MOST_BROADCAST = 100_000

# Names of HTML.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_DROPPED = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "template", "noscript", "svg", "math", "canvas", "object", "audio", "video",
    "button", "select", "datalist", "fieldset", "applet", "map", "picture", *_RAW,
}
_MAIN = {"article", "main"}
_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"ul", "ol", "dl", "table"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "note"}
# Words in class and id names.
_BOILERPLATE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "header", "masthead", "topbar", "footer", "cookie", "cookies",
    "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "share", "sharing", "social", "subscribe", "newsletter",
    "signup", "login", "search", "related", "recommended", "widget", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply",
    "toolbar", "pagination", "pager", "skip", "hidden", "disclaimer", "copyright", "toc",
}
_FINAL = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "related", "recommended", "ad", "ads", "advert", "sidebar"}
_CONTENT = {"article", "content", "post", "entry", "story", "main", "maincontent", "articlebody", "postcontent", "entrycontent"}
_NOT_OWN = {"has", "no", "with", "without", "is"}

_TAG = re.compile(
    r"""<!--(?P<note>.*?)(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?P<rest>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S,
)
_LOOSE = re.compile(r"</?[a-zA-Z][^<>]*+(?:>|(?=<)|\Z)")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)

# Whole names that make an element a layout of the page: its sidebar-* says what it has, not what it is.
_LAYOUT = {"layout", "page", "site", "wrapper"}

#: In CUT, dropped for a form or a part of a class name, an article is only a MAYBE.
OPEN, MAIN, GONE, FOR_GOOD, CUT, MAYBE = range(6)
_SILENT = (FOR_GOOD, CUT)


def _words_of(value: str) -> set[str]:
    out = set()
    for name in value.lower().split():
        parts = re.split(r"[-_:]+", name)
        if not _NOT_OWN & set(parts[:-1]):
            out.update(parts)
            out.add("".join(parts))
    return out


def _zone(name: str, rest: str, zone: int) -> int:
    """Zone of an element's content, given the zone it stands in."""
    if zone == FOR_GOOD or name in _DROPPED and name != "form":
        return FOR_GOOD
    if name == "form":
        return CUT
    gone = CUT if zone in (CUT, MAYBE) else GONE
    if name == "header" and zone not in (MAIN, MAYBE):
        return gone
    own = zone
    if rest and not rest.isspace():
        found = {k.lower(): v.strip("\"'") for k, v in _NAME.findall(rest)}
        names = f"{found.get('class', '')} {found.get('id', '')}" if name not in ("html", "body") else ""
        words, whole = _words_of(names), set(names.lower().split())
        if whole & _LAYOUT and "sidebar" not in whole:
            words.discard("sidebar")
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return FOR_GOOD
        role = found.get("role", "").lower()
        if role in _ROLES:
            return FOR_GOOD
        if words & _FINAL and not (name in _MAIN and zone == OPEN and not words & {"comment", "comments", "reply", "related"}):
            return FOR_GOOD if whole & _FINAL or name in _MAIN else CUT
        if zone in (MAIN, MAYBE) and "header" not in whole:
            words.discard("header")
        if words & _BOILERPLATE and name not in _MAIN:
            return gone
        if zone == OPEN and (role in _MAIN or words & _CONTENT or found.get("itemprop", "").lower() == "articlebody"):
            own = MAIN
    if name in _MAIN:
        return MAYBE if zone in (CUT, MAYBE) else MAIN
    return own


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space as one space, each with its zone; empty ones and those gone for good left out."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, size = OPEN, 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, zone))
            parts.clear()

    while at < size:
        low = page.find("<", at)
        if low < 0:
            low = size
        if low > at and zone not in _SILENT:
            parts.append(page[at:low])
        if low == size:
            break
        tag = _TAG.match(page, low)
        if not tag:
            loose = _LOOSE.match(page, low)
            if loose:
                at = loose.end()
            else:  # a plain "<"
                if zone not in _SILENT:
                    parts.append("<")
                at = low + 1
            continue
        at = tag.end()
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if name not in _INLINE:
            if name == "br" or name in _VOID:
                if zone not in _SILENT and name in ("br", "hr", "img"):
                    parts.append(" ")
                continue
            close()
        if tag["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in _INLINE and stack[depth][1] != zone:
                        close()
                    zone = stack[depth][1]
                    del stack[depth:]
                    break
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = found.end() if found else size
            continue
        if name not in _INLINE:
            zone = _end_implied(name, stack, zone)
        inner = _zone(name, tag["rest"], zone)
        if inner != zone and name in _INLINE:
            close()
        if not tag["rest"].endswith("/") or name not in ("svg", "math"):
            stack.append((name, zone))
            zone = inner
    close()
    return _settled(out)


def _settled(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Articles in cut zones are the page's if it marks no other and their text is longer than what is open; else they go."""
    length = {z: sum(len(text) for text, zone in found if zone == z) for z in (OPEN, MAIN, MAYBE)}
    if length[MAYBE] and not length[MAIN] and length[MAYBE] > length[OPEN]:
        return [(text, MAIN if zone == MAYBE else zone) for text, zone in found]
    return [(text, zone) for text, zone in found if zone != MAYBE]


def _end_implied(name: str, stack: list[tuple[str, int]], zone: int) -> int:
    """A block ends an open paragraph, an item the item before it."""
    for depth in range(len(stack) - 1, -1, -1):
        opened = stack[depth][0]
        if opened == "p" or opened in _OWN_KIND.get(name, ()):
            zone = stack[depth][1]
            del stack[depth:]
            return zone
        if opened not in _INLINE:
            return zone
    return zone


def _run_order(tokens: np.ndarray, pages: np.ndarray, texts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole runs in order of their tokens, then texts; where another run and where another run or text begins.

    ``tokens`` are the pages' streams one after another, ``pages`` says whose each is, ``texts`` which text each page has. The
    suffix array is sorted by prefix doubling until its order holds for ``run`` tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * np.int64(n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    whole = np.zeros(n, np.bool_)
    if n >= run:
        whole[: n - run + 1] = pages[: n - run + 1] == pages[run - 1 :]
    start = np.flatnonzero(whole)
    order = start[np.lexsort((texts[pages[start]], rank[start]))]  # the suffix array of whole runs
    r, t = rank[order], texts[pages[order]]
    new_run = np.concatenate([[True], r[1:] != r[:-1]]) if len(order) else np.zeros(0, np.bool_)
    new_text = new_run | np.concatenate([[True], t[1:] != t[:-1]]) if len(order) else new_run
    return order, new_run, new_text


def _spread(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run that begins at one of ``starts``."""
    hits = np.zeros(n + 1, np.int64)
    np.add.at(hits, starts, 1)
    np.add.at(hits, starts + run, -1)
    return np.cumsum(hits[:-1]) > 0


def repeated(tokens: np.ndarray, pages: np.ndarray, texts: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that pages with at least ``least`` different texts share; arguments as above."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.bool_)
    order, new_run, new_text = _run_order(tokens, pages, texts, run)
    which = np.cumsum(new_run) - 1
    count = np.bincount(which, new_text) if len(order) else np.zeros(0)
    return _spread(order[count[which] >= least] if len(order) else order, n, run)


def near_copies(tokens: np.ndarray, pages: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The text of each page, one number for texts that are near copies of each other, directly or by way of others."""
    n = int(texts.max(initial=-1)) + 1
    first = np.full(n, -1, np.int64)
    first[texts[::-1]] = np.arange(len(texts))[::-1]
    of_text = np.full(len(texts), -1, np.int64)
    of_text[first] = np.arange(n)  # a page for each text
    shingles = grams(mix(tokens.astype(np.uint64) + np.uint64(1)), SHINGLE)
    owner = of_text[pages[: len(shingles)]]
    whole = (owner >= 0) & (pages[: len(shingles)] == pages[SHINGLE - 1 :][: len(shingles)])
    names = np.unique(shingles[whole], return_inverse=True)[1]
    pairs = np.unique(names * n + owner[whole])
    names, owner = pairs // max(n, 1), pairs % max(n, 1)
    common = np.zeros((n, n), np.float32)
    for start in range(0, int(names.max(initial=-1)) + 1, 4096):
        low, high = np.searchsorted(names, [start, start + 4096])
        held = np.zeros((4096, n), np.float32)
        held[names[low:high] - start, owner[low:high]] = 1
        common += held.T @ held
    size = np.diag(common)
    alike = common >= ALIKE * (size[:, None] + size[None, :] - common)
    alike &= common > 0
    label = np.arange(n)
    while True:
        least = np.where(alike, label[None, :], n).min(axis=1, initial=n)
        lower = np.minimum(label, least)
        if np.array_equal(lower, label):
            return np.unique(label, return_inverse=True)[1][texts]
        label = lower


def _marked(page: list[tuple[str, int]], stream: list[tuple[str, int]], covered: np.ndarray) -> str:
    """The marked article without blocks that consist of shared runs, unless more than half of it is shared: then it is a copy."""
    size, shared = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
    of = np.array([k for _, k in stream], np.int64)
    np.add.at(size, of, 1)
    np.add.at(shared, of, covered)
    main = np.array([zone == MAIN for _, zone in page])
    if 2 * shared[main].sum() <= size[main].sum():
        main &= shared < size
    return " ".join(text for (text, _), kept in zip(page, main) if kept)


def _stream(page: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Words of a page with the numbers of their blocks."""
    return [(w, k) for k, (text, _) in enumerate(page) for w in text.split(" ")]


def _kept(page: list[tuple[str, int]], stream: list[tuple[str, int]], covered: np.ndarray) -> str:
    """Main text of a page whose words in shared runs are known."""
    if any(zone == MAIN for _, zone in page):
        return _marked(page, stream, covered)
    return " ".join(w for i, (w, k) in enumerate(stream) if page[k][1] == OPEN and not covered[i])


def _unmarked(page: list[tuple[str, int]]) -> bool:
    """Whether runs decide on the whole page."""
    return bool(page) and all(zone != MAIN for _, zone in page)


def _extract(table: pa.Table) -> pa.Table:
    """Main texts of all pages of one host at once: what :func:`main_texts` gives for hosts of any size."""
    found = [blocks(x or "") for x in table["html"].to_pylist()]
    words = [_stream(page) for page in found]
    ids: dict[str, int] = {}
    tokens = np.array([ids.setdefault(w, len(ids)) for page in words for w, _ in page], np.int64)
    pages = np.repeat(np.arange(len(words)), [len(p) for p in words])
    bodies: dict[tuple[str, ...], int] = {}
    texts = np.array([bodies.setdefault(tuple(t for t, _ in page), len(bodies)) for page in found], np.int64)
    if any(map(_unmarked, found)):
        texts = near_copies(tokens, pages, texts)
    least = max(LEAST_PAGES, int(np.ceil(SHARE * (texts.max(initial=-1) + 1))))
    covered = repeated(tokens, pages, texts, RUN, least)
    out, at = [], 0
    for page, stream in zip(found, words):
        out.append(_kept(page, stream, covered[at : at + len(stream)]))
        at += len(stream)
    return pa.table({
        "page_id": table["page_id"],
        "url": table["url"],
        "text": pa.array(out, pa.string()),
    })


def _pack(body: str) -> bytes:
    """A body as it moves and is stored; equal ones give equal bytes."""
    return zlib.compress(body.encode(), 1) if body else b""


def _bodies(table: pa.Table | pa.RecordBatch) -> list[str]:
    return [zlib.decompress(x).decode() if x else "" for x in table["body"].to_pylist()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their blocks, a line each, packed, and zones, a digit each."""
    for batch in batches:
        found = [blocks(x or "") for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"], batch["url"], batch["host"],
                pa.array([_pack("\n".join(text for text, _ in page)) for page in found], pa.binary()),
                pa.array(["".join(str(zone) for _, zone in page) for page in found], pa.string()),
                pa.array([_unmarked(page) for page in found], pa.bool_()),
            ],
            names=["page_id", "url", "host", "body", "zones", "unmarked"],
        )


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hash of each word; ``known`` keeps those met before."""
    for w in set(words).difference(known):
        known[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
    return np.array([known[w] for w in words], np.uint64)


def _words(body: str) -> list[str]:
    return body.replace("\n", " ").split(" ") if body else []


def _group_runs(bodies: list[str], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of a group of bodies, in order, with their texts; where another run and where another run or text begins."""
    words = [_words(body) for body in bodies]
    pages = np.repeat(np.arange(len(words)), [len(p) for p in words])
    hashes = _hashes([w for page in words for w in page], {})
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_), np.zeros(0, np.bool_)
    order, new_run, new_text = _run_order(hashes, pages, texts, RUN)
    return grams(hashes, RUN)[order].view(np.int64), texts[pages[order]], new_run, new_text


def _own_texts(table: pa.Table) -> list[str]:
    """The different texts that a group has as its own."""
    own = table.filter(table["own"])
    return list(dict(zip(own["key"].to_pylist(), _bodies(own))).values())


def _counted(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of a group's own texts, its runs and in how many of the texts each is."""
    bodies = _own_texts(table)
    runs, _, new_run, new_text = _group_runs(bodies, np.arange(len(bodies)))
    n = np.bincount(np.cumsum(new_run) - 1, new_text).astype(np.int64) if len(runs) else np.zeros(0, np.int64)
    return len(bodies), runs[new_run], n


def _runs_table(table: pa.Table, **columns: np.ndarray) -> pa.Table:
    size = len(columns["run"])
    host = pa.array(table["host"].slice(0, 1).to_pylist() * size, pa.string())
    return pa.table({"host": host, **{name: pa.array(column, pa.int64()) for name, column in columns.items()}})


def _candidates(table: pa.Table) -> pa.Table:
    """Runs in so large a part of a group's own texts as is asked of the host's."""
    texts, runs, n = _counted(table)
    alone = texts == table["n"][0].as_py()
    likely = n >= max(LEAST_PAGES if alone else 1, SHARE * texts - 1e-6)
    return _runs_table(table, run=runs[likely & (not table["labelled"][0].as_py())])


def _count_candidates(table: pa.Table, candidates: pa.Table) -> pa.Table:
    """In how many of a group's own texts the candidates of its host are."""
    if not table.num_rows or not candidates.num_rows:
        return _runs_table(table, run=np.zeros(0, np.int64), n=np.zeros(0, np.int64))
    _, runs, n = _counted(table)
    found = np.isin(runs, candidates["run"].to_numpy())
    return _runs_table(table, run=runs[found], n=n[found])


def _labelled_runs(table: pa.Table) -> pa.Table:
    """Runs of a group of different texts, with each label that has them."""
    runs, labels, _, new_text = _group_runs(_bodies(table), table["label"].to_numpy())
    return _runs_table(table, run=runs[new_text], label=labels[new_text])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different shingles of each text."""
    for batch in batches:
        known: dict[str, int] = {}
        found = [np.unique(grams(_hashes(_words(body), known), SHINGLE)).view(np.int64) for body in _bodies(batch)]
        yield pa.RecordBatch.from_arrays([batch["host"], batch["key"], pa.array(found, pa.list_(pa.int64()))], names=["host", "key", "shingles"])


def _copy_labels(texts: DataFrame) -> DataFrame:
    """``key, label`` of the texts (``host, key, body``) that have near copies on their host, as :func:`near_copies` groups them.

    Sets alike by ``ALIKE`` share one of their rarest shingles, which a prefix of their rarest ones holds; whole sets are compared then.
    """
    sets = stage(texts.select("host", "key", "body").mapInArrow(_shingles, "host string, key long, shingles array<long>"), "page-shingles")
    each = sets.select("host", "key", F.explode("shingles").alias("shingle"))
    often = each.groupBy("host", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    # A shingle of one text comes first in its order and links nothing.
    size = F.size("shingles")
    shared = each.join(often, ["host", "shingle"]).groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    first = sets.select("host", "key", size.alias("size")).join(shared, ["host", "key"])
    first = first.withColumn("take", F.expr(f"size - cast(ceil({ALIKE} * size) as int) + 1 - (size - size(shared))")).where("take > 0")
    first = keep(first.select("host", "key", "size", F.explode(F.expr("slice(shared, 1, take).shingle")).alias("shingle")))
    other = first.select("host", "shingle", F.col("key").alias("b"), F.col("size").alias("size_b"))
    fits = F.expr(f"a < b AND least(size, size_b) >= {ALIKE} * greatest(size, size_b)")
    pairs = first.withColumnRenamed("key", "a").join(other, ["host", "shingle"]).where(fits).select("a", "b").distinct()
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    links = pairs.join(left, "a").join(right, "b").where(common >= ALIKE * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")
    return components(links).select(F.col("node").alias("key"), F.col("component").alias("label"))


def _settle(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """Main texts of pages of one host, whose shared runs are given."""
    shared, known, out = runs["run"].to_numpy().view(np.uint64), {}, []
    for body, zones in zip(_bodies(pages), pages["zones"].to_pylist()):
        page = list(zip(body.split("\n"), map(int, zones))) if zones else []
        stream = _stream(page)
        covered = np.zeros(len(stream), np.bool_)
        if len(shared) and stream:
            covered = _spread(np.flatnonzero(np.isin(grams(_hashes([w for w, _ in stream], known), RUN), shared)), len(stream), RUN)
        out.append(_kept(page, stream, covered))
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(out, pa.string())})


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """Per page row: page_id, url, text. ``group`` says how much a task takes at a time, nothing else."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = rows.withColumn("host", host).mapInArrow(_parse, "page_id long, url string, host string, body binary, zones string, unmarked boolean")
    parsed = parsed.withColumn("key", F.xxhash64(F.lit(7), "host", "body")).withColumn("pick", F.xxhash64("page_id", "url"))
    keys = parsed.groupBy("host", "key").agg(F.count("*").alias("rows"), F.min("pick").alias("first"), F.max("unmarked").alias("unmarked"))
    keys = keep(keys)
    copies = F.sum(F.when(F.col("rows") > COPIES, F.col("rows")).otherwise(0))
    hosts = keep(keys.groupBy("host").agg(F.count("*").alias("n"), copies.alias("copies"), F.max("unmarked").alias("labelled")))
    often = keep(keys.where(F.col("rows") > COPIES).select(F.col("key").alias("again"), "first"))
    parts = F.ceil(F.col("n") / group)
    more = F.ceil(F.col("copies") / group)
    hosts = hosts.select("host", "n", "labelled", parts.alias("parts"), more.alias("more"))
    many = hosts.count() > MOST_BROADCAST

    def of_host(table: DataFrame, sizes: DataFrame) -> DataFrame:
        return table.join(sizes.hint("merge") if many else F.broadcast(sizes), "host")

    def to_groups(runs: DataFrame) -> DataFrame:
        """Every group of a host's pages gets the runs."""
        groups = F.explode(F.expr("sequence(0L, parts + more - 1)"))
        return of_host(runs.select("host", "run"), hosts).select("host", "run", groups.alias("part")).groupBy("host", "part")

    all_often = often.hint("merge") if often.count() > MOST_BROADCAST else F.broadcast(often)
    marked = of_host(parsed.join(all_often, F.col("key") == F.col("again"), "left"), hosts).withColumn("own", F.expr("again IS NULL OR pick = first"))
    part = F.expr("if(own, pmod(xxhash64(key, 1), parts), parts + pmod(pick, greatest(more, 1L)))")
    # Read three times: for candidates, for their numbers and for the texts. So it moves once, and lies in files by group.
    dealt = marked.select("page_id", "url", "host", "body", "zones", "key", "own", "n", "labelled", part.alias("part"))
    dealt = bucketed_table(dealt, ["host", "part"], "pages", "zstd")
    groups = dealt.groupBy("host", "part")
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.lit(SHARE) * F.col("n")))
    candidates = groups.applyInArrow(_candidates, "host string, run long").distinct()
    counted = groups.cogroup(to_groups(candidates)).applyInArrow(_count_candidates, "host string, run long, n long")
    counted = counted.groupBy("host", "run").agg(F.sum("n").alias("texts"))
    shared = of_host(counted, hosts).where(F.col("texts") >= least).select("host", "run")
    if not hosts.where("labelled").isEmpty():
        texts = of_host(parsed, hosts.where("labelled")).groupBy("host", "key").agg(F.first("body").alias("body"), F.first("parts").alias("parts"))
        texts = stage(texts, "page-texts")
        labels = keep(_copy_labels(texts))
        label = F.coalesce("label", "key")
        different = keys.join(labels, "key", "left").groupBy("host").agg(F.count_distinct(label).alias("n"))
        texts = texts.join(labels, "key", "left").select("host", "body", label.alias("label"), F.expr("pmod(xxhash64(key, 1), parts)").alias("part"))
        runs = texts.groupBy("host", "part").applyInArrow(_labelled_runs, "host string, run long, label long")
        runs = runs.groupBy("host", "run").agg(F.count_distinct("label").alias("texts"))
        shared = shared.union(of_host(runs, different).where(F.col("texts") >= least).select("host", "run"))
    return groups.cogroup(to_groups(shared)).applyInArrow(_settle, "page_id long, url string, text string")
