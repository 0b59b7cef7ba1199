"""Main text of web pages by equivalence-class template deduction.

A token is an element's path, told apart by its class and id words (digits count as one). Tokens with
equal occurrence vectors over the pages of a host form an equivalence class; a vector is held as a
count and an exclusive-or of page hashes, so vectors of any number of pages aggregate in one pass and
no host meets in one task. Classes of tokens that stand exactly once on each of their pages, and are
on half of the host's pages or more, make the template's skeleton; each nests in slots of the others.
Pages without elements are in no vector. The main slot is the article or main element,
or else the least skeleton element that holds all of the varying text; from it each page gives its blocks, without the parts that the template or
their own markup tell to be something else.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img",
}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: Elements that never hold article text.
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "audio", "video", "input", "option", "datalist"} | RAW
#: Words of class, id and role that name something other than the article.
OTHER = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "trending", "comment", "comments", "disqus",
    "reply", "replies", "respond", "widget", "pagination", "pager", "search", "toolbar", "hidden", "complementary", "contentinfo", "alert", "disclaimer", "copyright",
}
#: Words that stand beside one of those in the name of such a part.
PART = {
    "box", "bar", "block", "section", "container", "wrapper", "wrap", "list", "links", "buttons", "button", "area", "panel", "inner", "form", "icons", "top", "bottom",
    "left", "right", "primary", "secondary", "site", "page", "header", "slot", "unit", "item", "items", "posts", "text", "message", "main", "global", "row",
}
MAIN = {"article", "main"}
#: Elements whose end tag may be left out: what they stand in, and which of those open before end with them.
ALIKE = {
    "li": (("ul", "ol", "menu"), ("li",)), "dt": (("dl",), ("dt", "dd")), "dd": (("dl",), ("dt", "dd")), "option": (("select", "datalist"), ("option",)),
    "tr": (("table",), ("tr", "td", "th")), "td": (("table",), ("td", "th")), "th": (("table",), ("td", "th")),
}

#: A tag; its parts never give characters back, so one try is linear in what it reads.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
#: Tags whose quotes do not close, before a page's quotes are taken for plain characters.
TRIES = 40
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TELLING = re.compile("class|id|role|hidden|style", re.I).search
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


@dataclass
class Element:
    """``first`` and ``last`` bound its blocks; ``other``: its own markup says it is not the article;
    ``soft``: only a class or id word, or that it is a form, says so."""

    path: str
    tag: str
    other: bool
    first: int
    last: int = -1
    soft: bool = False
    above: int = -1


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _is_other(name: str) -> bool:
    """Whether a class or id word is a marker as a whole: ``share-box``, but not ``has-sidebar``."""
    for words in ({x for x in _SPLIT.split(name) if x}, set(_SPLIT.split(name.lower())) - {""}):
        words = {w.lower() for w in words if not w.isdigit()}
        if not OTHER.isdisjoint(words) and words <= OTHER | PART:
            return True
    return False


def _marks(attrs: str) -> tuple[str, bool, bool]:
    """(class and id words for the path, whether they name something else, whether it is hidden)."""
    if not _TELLING(attrs):
        return "", False, False
    words, other, hidden = [], False, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            own = value.split()
            words += own
            other |= any(_is_other(w) for w in own)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return _DIGITS.sub("0", ".".join(sorted(set(words)))), other, hidden


def _lift(page: Page) -> None:
    """Show what only a word or a form hides, where it holds the article.

    A form with a heading of the page or an article is the whole page's form. If words or forms hide
    every article and main element of a page, or all of its text, those do not count. Elements stand
    in page order, so one way down and one way up tell of all that is above or below.
    """
    every = page.elements

    def holding(own: list[bool]) -> list[bool]:
        """Which elements have one of ``own`` below them."""
        out = [False] * len(every)
        for k in range(len(every) - 1, -1, -1):
            if (up := every[k].above) >= 0 and (own[k] or out[k]):
                out[up] = True
        return out

    def under(told: list[bool]) -> list[bool]:
        """Which elements are one of ``told`` or below one."""
        for k, e in enumerate(every):
            told[k] = told[k] or e.above >= 0 and told[e.above]
        return told

    for e, holds in zip(every, holding([e.tag == "h1" or e.tag in MAIN for e in every]), strict=True):
        if holds and e.tag == "form" and e.soft:
            e.other = e.soft = False
    mains = [e.tag in MAIN and e.last > e.first for e in every]
    if any(mains):
        dark = under([e.other for e in every])
        if all(d for d, m in zip(dark, mains, strict=True) if m):
            hard = under([e.other and not e.soft for e in every])
            lit = [m and not h for m, h in zip(mains, hard, strict=True)]
            for e, own, holds in zip(every, lit, holding(lit), strict=True):
                if own or holds:
                    e.other = e.soft = False
    for hard in (False, True):
        depth = np.zeros(len(page.blocks) + 1, np.int64)
        for e in every:
            if e.other and not (hard and e.soft):
                depth[e.first] += 1
                depth[e.last] -= 1
        page.hidden = (np.cumsum(depth)[:-1] > 0).tolist()
        if not all(page.hidden):
            break
    if hard and not all(page.hidden):
        for e in every:
            if e.soft:
                e.other = e.soft = False


def parse(source: str | None) -> Page:
    """Blocks and elements of a page, mended the way browsers mend: text is decoded, white space in
    a block is one space, and whatever the end of the page leaves open is closed there. Time is
    linear in the page, whatever is broken in it: open tags are found by name, not by search, and
    after ``TRIES`` tags with open quotes a page's quotes count as plain characters."""
    page = Page()
    stack: list[tuple[str, Element | None]] = []
    at_of: dict[str, list[int]] = {}  # places in the stack by tag
    blocks_at: list[int] = []  # places of block elements
    path: list[str] = []
    text: list[str] = []
    open_: list[int] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(html_lib.unescape("".join(text)).split())
            if words:
                page.blocks.append(words)
                page.linked.append(min(links, len(words)))
            text.clear()
        links = 0

    def push(tag: str, element: Element | None) -> None:
        at_of.setdefault(tag, []).append(len(stack))
        if element is not None:
            blocks_at.append(len(stack))
        stack.append((tag, element))

    def place(*tags: str) -> int:
        return max((at_of[t][-1] for t in tags if at_of.get(t)), default=-1)

    def close(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            tag, element = stack.pop()
            if tag:
                at_of[tag].pop()
            in_link -= tag == "a"
            if element is not None:
                flush()
                blocks_at.pop()
                element.last = len(page.blocks)
                path.pop()
                open_.pop()

    def say(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            links += len(piece) * (in_link > 0)

    at, source = 0, source or ""
    upto, tag_at, left, cdata = source.rfind(">"), _TAG.match, TRIES, True
    start = source.find("<")
    while 0 <= start <= upto:
        mark = source[start + 1 : start + 2]
        if mark in ("!", "?"):
            stop = -1
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                stop = len(source) if stop < 0 else stop + 3
            elif cdata and source.startswith("<![CDATA[", start):
                stop = source.find("]]>", start + 9) + 3
                cdata = stop > 2
            if stop > 2:
                say(source[at:start])
                if source.startswith("<![", start):
                    text.append(html_lib.escape(source[start + 9 : stop - 3], quote=False))
            else:
                say(source[at:start])
                stop = source.find(">", start) + 1
            at = stop
            start = source.find("<", at)
            continue
        m = tag_at(source, start)
        if m is None and (mark == "/" or mark.isalpha()) and mark.isascii() and tag_at is not _PLAIN_TAG.match:
            left -= 1
            m = _PLAIN_TAG.match(source, start)
            if not left:
                tag_at = _PLAIN_TAG.match
        if m is None:
            start = source.find("<", start + 1)
            continue
        say(source[at:start])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            k = place(tag)
            if k < 0:
                if tag not in INLINE:
                    flush()
            elif tag in INLINE and blocks_at and blocks_at[-1] > k:
                stack[k] = ("", None)  # a formatting end across blocks closes itself alone
                at_of[tag].pop()
                in_link -= tag == "a"
            else:
                close(k)
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, at)
            if tag not in INLINE:
                flush()
            stop = end.start() if end else len(source)
            at = source.find(">", stop) + 1 if end else stop
            at = at or len(source)
        elif tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                flush()
        elif tag in INLINE:
            in_link += tag == "a"
            push(tag, None)
        else:
            if tag in CLOSES_P:
                if blocks_at and stack[blocks_at[-1]][0] == "p":
                    close(blocks_at[-1])
            elif tag in ALIKE:
                within, alike = ALIKE[tag]
                if (k := place(*alike)) > place(*within):
                    close(min(at_of[t][-1] for t in alike if at_of.get(t) and at_of[t][-1] > place(*within)))
            flush()
            words, other, hidden = _marks(m[3])
            outer = tag == "header" and place(*MAIN) < 0
            path.append(f"{tag}.{words}" if words else tag)
            hard = hidden or tag in NEVER and tag != "form" or outer
            element = Element("/".join(path) if len(path) <= 40 else f"#{len(path)}/" + "/".join(path[-8:]), tag, tag not in ("html", "body") and (hard or other or tag == "form"), len(page.blocks))
            element.soft, element.above = element.other and not hard, open_[-1] if open_ else -1
            open_.append(len(page.elements))
            page.elements.append(element)
            push(tag, element)
        start = source.find("<", at)
    say(source[at:])
    close(0)
    flush()
    _lift(page)
    return page


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) >> 1


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


_STATS = "host string, token string, pages long, times long, vector long, chars long, low long, high long"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each token in one task's pages, and what its elements hold."""
    total: dict[tuple[str, str], list[int]] = {}

    def close() -> pa.RecordBatch:
        keys = list(total)
        columns = list(zip(*total.values(), strict=True))
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *(pa.array(c, pa.int64()) for c in columns)], names=["host", "token", "pages", "times", "vector", "chars", "low", "high"])
        total.clear()
        return out

    for whole in batches:
        for b in slices(whole, 2):
            for host, page_id, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page = parse(source)
                sizes = np.concatenate([[0], np.cumsum([0 if h else len(t) - n for t, n, h in zip(page.blocks, page.linked, page.hidden, strict=True)])]).astype(int)
                found: dict[str, list[Element]] = {"": []} if page.elements else {}
                for e in page.elements:
                    found.setdefault(e.path, []).append(e)
                for token, own in found.items():
                    chars = int(sum(sizes[e.last] - sizes[e.first] for e in own))
                    said = _hash("\n".join("\n".join(page.blocks[e.first : e.last]) for e in own))
                    times = len(own) if token else 1
                    row = [1, times, _hash(f"{page_id}:{times}"), chars, said, said]
                    old = total.get((host, token))
                    if old is None:
                        total[host, token] = row
                    else:
                        old[0] += 1
                        old[1] += times
                        old[2] ^= row[2]
                        old[3] += chars
                        old[4], old[5] = min(old[4], said), max(old[5], said)
            if len(total) > 300_000:
                yield close()
    if total:
        yield close()


def classes(group: pd.DataFrame) -> pd.DataFrame:
    """``group`` with ``cls``, the equivalence class of each token, and ``valid``.

    A class is the tokens of one occurrence vector (its pages, its occurrences and the exclusive-or of
    both by page). It is valid if its tokens stand exactly once on each of their pages, so that they
    have one order there. It nests in a slot of the class round it; a token in a place that repeats,
    or that is not of a valid class, has another role there and leaves its class.
    """
    out = group.assign(cls=group.groupby(["vector", "pages", "times"], sort=False).ngroup())
    once = dict(zip(out.token, out.times == out.pages, strict=True))
    valid: dict[str, bool] = {}
    for t in sorted(once, key=len):  # what stands round a token has a shorter path
        ups = [] if t[:1] == "#" else [t[:k] for k, c in enumerate(t) if c == "/"][-1:]
        valid[t] = once[t] and all(valid.get(up, False) for up in ups)
    return out.assign(valid=out.token.map(valid).astype(bool))


def deduce(group: pd.DataFrame, pages: int, support: float = 0.5) -> tuple[str, list[str]]:
    """(path of the main slot, paths of constant parts) from the tokens of one host.

    The template is the valid classes on ``support`` of the host's pages or more, so odd pages without
    the article take nothing from it. No slot with text: pages are told by their own markup.
    """
    group = group[(group.token != "") & (group.pages >= support * pages)]
    told = classes(group)
    constant = [] if pages < 3 else group[(group.low == group.high) & (group.pages >= 3) & (group.chars > 0)].token.tolist()
    slots = told[told.valid & (told.chars > 0) & ~told.token.isin(constant)]
    if not len(slots):
        return "", constant
    named = slots[[t.rsplit("/", 1)[-1].split(".")[0] in MAIN for t in slots.token]]
    if len(named):
        best = named.sort_values(["chars", "token"], ascending=[False, True]).iloc[0].token
    else:  # from the outermost slot down, as long as one slot within has all of its varying text
        by_token = slots.set_index("token")
        varying = group[(group.chars > 0) & ~group.token.isin(constant)].token.tolist()
        fixed = {t: c for t, c in zip(group.token, group.chars, strict=True) if t in set(constant)}
        fixed = {t: c for t, c in fixed.items() if not any(t[:k] in fixed for k, x in enumerate(t) if x == "/")}
        best = by_token.sort_values(["chars"], ascending=False, kind="stable").index[0]
        best = min((t for t in by_token.index if by_token.chars[t] == by_token.chars[best]), key=lambda t: (t.count("/"), t))
        while True:
            own = by_token.loc[best]
            inside = sorted((t for t in by_token.index if t.startswith(f"{best}/")), key=lambda t: (t.count("/"), -by_token.chars[t], t))
            for t in inside:
                chrome = sum(c for f, c in fixed.items() if f.startswith(f"{best}/") and not f.startswith(f"{t}/"))
                left = own.chars - chrome - by_token.chars[t]
                beside = any(v.startswith(f"{best}/") and v != t and not v.startswith(f"{t}/") and not t.startswith(f"{v}/") for v in varying)
                if not beside and left <= (1 - by_token.pages[t] / own.pages) * own.chars:
                    best = t
                    break
            else:
                break
    return best, [c for c in constant if c.startswith(f"{best}/")]


def templates(spark: SparkSession, pages: DataFrame, *, support: float = 0.5) -> DataFrame:
    """(host, main, constant) of every host with 3 pages or more, and of all hosts together as ``*``.

    Tokens on fewer than ``support`` of a host's pages are in no class that could be its skeleton; so
    what one host sends to one task is bounded by the size of its pages, not by their number.
    """
    seen = pages.select(host_of().alias("host"), "page_id", "html").mapInArrow(_observe, _STATS)
    sums = [F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")]
    by_host = written(spark, seen.groupBy("host", "token").agg(*sums), "page-tokens")
    tokens = by_host.unionByName(by_host.groupBy("token").agg(*sums).withColumn("host", F.lit("*")))
    sizes = tokens.where("token = ''").select("host", F.col("pages").alias("n")).where("n >= 3 or host = '*'")
    kept = tokens.join(sizes, "host").where(F.col("pages") >= support * F.col("n"))

    def of_host(group: pd.DataFrame) -> pd.DataFrame:
        main, constant = deduce(group, int(group["n"].iloc[0]), support)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "main": [main], "constant": [constant]})

    return written(spark, kept.groupBy("host").applyInPandas(of_host, "host string, main string, constant array<string>"), "templates")


def main_text(page: Page, main: str, constant: list[str]) -> str:
    """The blocks of the main slot in page order, joined by an empty line.

    A page without the slot gives its ``article`` or ``main`` elements, or else its body.
    """
    shown, fixed = ~np.array(page.hidden, bool), np.zeros(len(page.blocks), bool)
    told = set(constant)
    for e in page.elements:
        if told and e.path in told:
            fixed[e.first : e.last] = True

    def within(slots: list[Element]) -> np.ndarray:
        out = np.zeros(len(page.blocks), bool)
        for e in slots:
            out[e.first : e.last] = True
        return out & shown

    keep = within([e for e in page.elements if main and e.path == main and not e.other])
    if not keep.any():
        keep = within([e for e in page.elements if e.tag in MAIN and not e.other])
    if not keep.any():
        keep = shown
    if (keep & ~fixed).any():  # a page that is nothing but the template's own words keeps them
        keep = keep & ~fixed
    return "\n\n".join(page.blocks[i] for i in np.flatnonzero(keep))


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null and empty html give an empty text.

    Pages of hosts with fewer than 3 pages, or without a usable template, are told by the template of
    all hosts, then by their own markup. Repeated rows stay; an empty table gives an empty table.
    """
    found = templates(spark, pages)
    n = found.count()
    few = (lambda df: F.broadcast(df)) if n <= 20_000 else (lambda df: df)
    every = found.where("host = '*'").select("main", "constant").first()
    fallback = (every.main, list(every.constant)) if every else ("", [])
    told = pages.select("page_id", "url", "html", host_of().alias("host")).join(few(found.where("host <> '*'")), "host", "left").select("page_id", "url", "html", "main", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                texts = []
                for source, main, constant in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    texts.append(main_text(parse(source), main, constant or []) if main else main_text(parse(source), *fallback))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return told.mapInArrow(run, "page_id long, url string, text string, n_chars long")
