"""Main text of web pages: page structure and nearest-URL page differencing.

A page becomes text lines, one per block element. Lines of menus, headers, footers, sidebars, forms, scripts and styles
are no text, nor are reader comments, adverts and notices; elements are known by their tag and role, by
whole class tokens or ids (``SKIP_NAMES``) or by whole words in them (``NOISE``). The text is that of the page's article
(``article``, else ``main``, else all that is left). No article or main goes by its own name, nor does
what holds one; an article named as a comment or teaser counts only where there is nothing else. Headings in
the article's own header are text.

Within each host the pages are ordered by URL path and paired with the neighbour that shares the longer path start;
the text lines of the pair are aligned by longest common subsequence. Where a page has no article, shared lines are
deleted (all stay if every line was shared: a copy). In articles a shared line is deleted only if it is boilerplate of
the host: shared on at least ``MANY_PAGES`` of its pages and on ``HOST_SHARE`` of them. Then it goes from every page of the
host, unless a page has nothing else.

Only line hashes travel between pages, found by rank (equi-joins on rank +- 1), so a host with a third of
all pages is spread like any other. Parsing takes time in proportion to the page; the alignment of n and m
different lines n * m / 64 steps in bounded memory.

Defined results: null and empty html give an empty text; null urls form one host with the empty path;
repeated rows get equal texts and count as one page; of neighbours that share equally much of the path the one before is
taken; very long pages are parsed and aligned whole; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otgraph.llm.common import text_key, written

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element and attribute names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "optgroup", "datalist",
              "template", "svg", "canvas", "object", "audio", "video", "map", "dialog", "menu", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
              "menubar", "toolbar", "tablist"}
SKIP_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsored", "promos", "sidebar", "side-bar",
              "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "site-header", "page-header", "site-footer",
              "page-footer", "footer", "masthead", "cookies", "cookie-notice", "cookie-banner", "cookie-bar", "cookie-consent", "gdpr",
              "newsletter", "share-buttons", "social-links", "related", "related-posts", "related-articles", "comments", "comment-list",
              "commentlist", "disqus", "disqus_thread", "pagination", "pager", "skip-link"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TITLED = {"section", *HEADINGS}                             # their ids are made from headings
#: Words of a class token or id that name a comment, advert or notice, and those that only tell a state of it.
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "comment", "comments",
         "notice", "notices", "cookie", "cookies"}
STATES = {"has", "no", "with", "without", "is", "open", "closed", "on", "off", "free", "enabled", "disabled", "allowed"}
#: Names of articles that stand beside the page's own.
BESIDE = NOISE | {"reply", "replies", "teaser", "teasers", "related", "promo"}
MANY_PAGES, HOST_SHARE = 8, 0.5         # pages of a host that make a line of articles its boilerplate
TRACE_BITS = 1 << 27                    # of an alignment that is traced in one go


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _words(a: dict[str, str], tag: str) -> tuple[set[str], set[str]]:
    """Class tokens and id of an element, and the words of those that tell no state."""
    names = set(a.get("class", "").lower().split())
    if tag not in TITLED and "section" not in names:
        names.add(a.get("id", "").strip().lower())
    parts = [set(re.split("[-_]+", n)) for n in names]
    return names, set().union(*[p for p in parts if not p & STATES])


VISIBLE, HIDDEN, HEADINGS_ONLY = 0, 1, 2


def _kind(tag: str, raw: str, in_article: bool) -> tuple[int, bool, bool]:
    """(level, named, beside): what is visible of an element; whether it is none by its name unless it holds an article or main;
    whether it is an article beside the page's own."""
    if tag == "header" and in_article:
        return HEADINGS_ONLY, False, False
    if tag in SKIP:
        return HIDDEN, False, False
    if not raw.strip() or tag in ("html", "body"):
        return VISIBLE, False, False
    a = _attributes(raw)
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or role in SKIP_ROLES:
        return HIDDEN, False, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return HIDDEN, False, False
    names, words = _words(a, tag)
    if tag in ("article", "main") or role in ("main", "article"):
        return VISIBLE, False, tag == "article" and bool(words & BESIDE)
    return VISIBLE, not SKIP_NAMES.isdisjoint(names) or bool(words & NOISE), False


def _tokens(source: str):
    """(text before, name or None, whether it closes, attributes, place after) of each tag, comment and so on, and the rest.
    A ``<`` that begins none is text. Where a scan of quoted attributes failed it is not tried again."""
    at = look = 0
    n, last = len(source), source.rfind(">")
    failed: set[int] = set()

    def tag_end(i: int) -> int:
        seen = []
        while True:
            i = _UNQUOTED.match(source, i).end()
            if i >= n or i in failed:
                break
            if source[i] == ">":
                return i
            seen.append(i)
            i = source.find(source[i], i + 1) + 1
            if not i:
                break
        failed.update(seen)
        return -1

    while True:
        lt = source.find("<", look)
        if lt < 0:
            break
        if source.startswith("<!--", lt) or source.startswith("<![CDATA[", lt):
            stop, skip = ("-->", 4) if source[lt + 2] == "-" else ("]]>", 9)
            e = source.find(stop, lt + skip)
            inner = source[lt + skip:e if e >= 0 else n] if skip == 9 else ""
            look = e + 3 if e >= 0 else n
            yield source[at:lt] + html.escape(inner), None, False, "", look
        elif lt > last:
            break
        elif source[lt + 1] in "!?":
            look = source.find(">", lt) + 1
            yield source[at:lt], None, False, "", look
        else:
            m = _NAME.match(source, lt)
            e = tag_end(m.end()) if m else -1
            if e < 0:
                look = lt + 1
                continue
            name, closes = m[2].lower(), bool(m[1])
            look = e + 1
            if name in RAW and not closes:
                stop = _RAW_END[name].search(source, look)
                look = stop.end() if stop else n
            yield source[at:lt], name, closes, source[m.end():e], look
        at = look
    yield source[at:], None, False, "", n


_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def page_lines(source: str | None) -> list[tuple[int, str]]:
    """(zone, line) of the visible blocks, in page order. Zone 2: inside an article, 1: inside main, 0: elsewhere, -1: in an
    article beside the page's own."""
    out: list[tuple[int, str]] = []
    stack: list[list] = []                            # open elements: name, level, zone, first line if named or -1
    opened: Counter = Counter()
    buf: list[str] = []
    level, zone, free = VISIBLE, 0, 0                 # free: stack[:free] hold an article or main

    def flush():
        if buf:
            line = " ".join(html.unescape("".join(buf)).split())
            buf.clear()
            if line:
                out.append((zone, line))

    def close():
        nonlocal level, zone, free
        name, _, _, first = stack.pop()
        opened[name] -= 1
        if first >= 0:
            flush()
            del out[first:]
        free = min(free, len(stack))
        now = stack[-1][1:3] if stack else (VISIBLE, 0)
        if now[0] != level or now[1] != zone:
            flush()
        level, zone = now

    for text, tag, closes, raw, _ in _tokens(source or ""):
        if text and level == VISIBLE:
            buf.append(text)
        if tag is None:
            continue
        if tag not in INLINE:
            flush()
        if closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in RAW or tag in VOID or raw.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            close()                                   # an unclosed element ends where the next begins
        inner, held, named = zone, level, False
        if level != HIDDEN:
            kind, named, beside = _kind(tag, raw, zone == 2)
            main = tag == "main" or tag != "article" and "main" in _attributes(raw).get("role", "").lower().split() if raw or tag == "main" else False
            if level == HEADINGS_ONLY:
                held = VISIBLE if tag in HEADINGS and kind == VISIBLE and not named else HIDDEN if kind == HIDDEN or named else HEADINGS_ONLY
                named = False
            elif zone == 2 and (named or beside):
                held, named = HIDDEN, False
            else:
                held = kind
            if held == VISIBLE and zone < 2 and (tag == "article" or main):
                inner = zone if zone == -1 else -1 if beside else 2 if tag == "article" else 1
                if inner > 0:
                    for e in stack[free:]:
                        e[3] = -1                     # what holds an article or main is not skipped by its name
                    free = len(stack)
        if held != level or inner != zone or named:
            flush()
        stack.append([tag, held, inner, len(out) if named else -1])
        opened[tag] += 1
        level, zone = held, inner
    flush()
    while stack:
        close()
    return out


def text_lines(source: str | None) -> tuple[bool, list[str], list[str]]:
    """(whether the page has an article or main, the lines of it or else of the page, all lines)."""
    lines = page_lines(source)
    zone = max((z for z, _ in lines), default=0)
    return zone != 0, [x for z, x in lines if z == zone], [x for _, x in lines]


def line_hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _rows_of(a: list[int], b: list[int]) -> list[int]:
    """After each of ``b`` the set of places of ``a`` as bits: 0 where the longest common subsequence of what is so far
    of b with a[:place + 1] is longer than with a[:place]."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, []
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` with every start of ``a``."""
    v = _rows_of(a, b)[-1] if b else (1 << len(a)) - 1
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(a)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` on a longest common subsequence with ``b``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    in_a, in_b = set(a[lo:ea]), set(b[lo:eb])
    mid = [i for i in range(lo, ea) if a[i] in in_b]               # lines that both have
    return [*range(lo), *[mid[i] for i in _aligned([a[i] for i in mid], [x for x in b[lo:eb] if x in in_a])], *range(ea, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) > TRACE_BITS:                 # halve b; the best cut of a needs the last rows only
        h = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:h]) + _lengths(a[::-1], b[h:][::-1])[::-1]))
        return _aligned(a[:cut], b[:h]) + [cut + i for i in _aligned(a[cut:], b[h:])]
    rows, out = _rows_of(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _place(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").lower(), u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return "", url or ""


def outlines(pages: DataFrame) -> DataFrame:
    """(page_id, _hk, host, path, own, h, around): of every page whether it has an article or main, the hashes of its text
    lines, and those of all its lines if there are more."""
    def run(batches):
        for batch in batches:
            rows = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                own, lines, every = text_lines(source)
                rows.append((*_place(url), own, [line_hash(x) for x in lines], [line_hash(x) for x in every] if len(every) > len(lines) else None))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("_hk"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.bool_()), *[pa.array(c, pa.list_(pa.int64())) for c in cols[3:]]],
                names=["page_id", "_hk", "host", "path", "own", "h", "around"])

    return _rows(pages).mapInArrow(run, "page_id long, _hk long, host string, path string, own boolean, h array<long>, around array<long>")


def _rows(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("_hk", F.xxhash64("url", text_key(F.col("html"))))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, _hk, drop): lines that go, of pages that lose any."""
    order = ["host", "path", "page_id", "_hk"]
    placed = outlines(pages).dropDuplicates(["page_id", "_hk"]).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(placed.withColumn("_n", F.monotonically_increasing_id()), "html-lines")
    part = F.shiftright("_n", 33)
    # rows before each partition: one row per partition
    size = ranked.groupBy(part.alias("_p")).count()
    size = size.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = ranked.withColumn("_p", part).join(size, "_p").withColumn("rank", F.col("_b") + F.col("_n").bitwiseAND((1 << 33) - 1))
    rank = written(rank.select("rank", "page_id", "_hk", "host", "path", "own", "h", "around"), "html-rank")
    near = lambda step, name: rank.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", F.coalesce("around", "h").alias("h")).alias(name))
    pairs = rank.where(F.size("h") > 0).join(near(1, "before"), "rank", "left").join(near(-1, "after"), "rank", "left")

    def run(batches):
        for batch in batches:
            drops = []
            for r in batch.to_pylist():
                best, most = None, -1
                for n in (r["before"], r["after"]):
                    if n is not None and n["host"] == r["host"]:
                        same = next((i for i, (x, y) in enumerate(zip(n["path"], r["path"])) if x != y), min(len(n["path"]), len(r["path"])))
                        if same > most:
                            best, most = n, same
                drops.append(common_lines(r["h"], best["h"]) if best else [])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "_hk", "host", "own", "h")] + [pa.array(drops, pa.list_(pa.int32()))],
                                             names=["page_id", "_hk", "host", "own", "h", "shared"])

    out = pairs.select("page_id", "_hk", "host", "path", "own", "h", "before", "after").mapInArrow(
        run, "page_id long, _hk long, host string, own boolean, h array<long>, shared array<int>")
    out = written(out, "html-shared")
    free = out.where("not own and size(shared) > 0 and size(shared) < size(h)").select("page_id", "_hk", F.col("shared").alias("drop"))
    pages_of = rank.groupBy("host").agg(F.count("*").alias("pages"))
    votes = (out.where("own").select("host", F.explode(F.array_distinct(F.transform("shared", lambda i: F.col("h")[i]))).alias("line"))
             .groupBy("host", "line").agg(F.count("*").alias("votes")).where(F.col("votes") >= MANY_PAGES))
    common = written(votes.join(pages_of, "host").where(F.col("votes") >= HOST_SHARE * F.col("pages")).select("host", "line"), "html-common")
    if not common.isEmpty():
        hosts = out.where("own").join(common.select("host").distinct(), "host", "left_semi")
        gone = (hosts.select("page_id", "_hk", "host", F.size("h").alias("n"), F.posexplode("h").alias("i", "line")).join(common, ["host", "line"])
                .groupBy("page_id", "_hk").agg(F.first("n").alias("n"), F.collect_list("i").alias("drop")))
        free = free.unionByName(gone.where("size(drop) < n").select("page_id", "_hk", "drop"))
    return written(free, "html-drop")


def main_text(source: str | None, drop=()) -> str:
    gone = set(drop or ())
    return " ".join(x for i, x in enumerate(text_lines(source)[1]) if i not in gone)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page row."""
    drop = shared_lines(pages).select(F.col("page_id").alias("_id"), F.col("_hk").alias("_k"), "drop")
    rows = _rows(pages)
    rows = rows.join(drop, rows["page_id"].eqNullSafe(drop["_id"]) & (rows["_hk"] == drop["_k"]), "left").select("page_id", "url", "html", "drop")

    def run(batches):
        for batch in batches:
            text = [main_text(s, d) for s, d in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
