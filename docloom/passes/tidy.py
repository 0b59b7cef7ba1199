"""Cleanup of converted books: broken words, repeated marks, headings, blank lines and long lines.

Each pass takes a document's lines and gives a ``Rewrite``, so passes compose and bookmarks can follow.
Fenced code is left alone throughout.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection

from . import lines as L
from .lines import Rewrite

#: Control characters, replacement characters and noncharacters.
UNREADABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffc\ufffd\ufdd0-\ufdef" + "".join(chr(p << 16 | 0xFFFE) + chr(p << 16 | 0xFFFF) for p in range(17)) + "]")
HYPHENS = "-\u00ad\u2010"
# Words that a title does not end with.
DANGLING = {"and", "or", "the", "of", "a", "an", "as", "to", "for", "which", "where", "through", "but", "not", "yet"}


def close_gap(line: str) -> str:
    """Single spaces, but two before a page number at the end."""
    t = re.sub(" +", " ", line)
    m = re.search(r"\s(\d{1,4})\s*$", t)
    head = L.trim(t[: m.start()]) if m else ""
    return f"{head}  {m[1]}" if head else t


def readable(text: list[str]) -> Rewrite:
    """Characters that conversion could not read go, and the gaps that they leave close."""
    free = L.free(text)
    return L.each(text, lambda i, x: close_gap(UNREADABLE.sub("", x)) if free[i] and UNREADABLE.search(x) else x)


_cap = re.compile("([\"“‘'«(\\[]*)([^\\W\\d_])[\"”’'»)\\]]*").fullmatch


def cap_pieces(line: str) -> str | None:
    """Quotes and letter of a line that is an initial."""
    m = _cap(L.trim(line))
    return m[1] + m[2] if m else None


def drop_caps(text: list[str]) -> Rewrite:
    """A lone letter, quotes before it kept, joined with the next line if that begins in lower case."""
    free, out, i = L.free(text), [], 0
    while i < len(text):
        cap = _cap(L.trim(text[i])) if free[i] else None
        after = L.trim(text[i + 1]) if cap and i + 1 < len(text) and free[i + 1] else ""
        if after[:1].islower():
            out.append(([i], cap[1] + cap[2] + after))
            i += 2
        else:
            out.append(([i], text[i]))
            i += 1
    return L.settled(len(text), out)


def broken(line: str, after: str) -> bool:
    """Whether a line ends in a hyphen that the next line's first letter continues."""
    t, nxt = line.rstrip(), L.trim(after)
    if not nxt[:1].isalpha() or t[-1:] not in HYPHENS or not t[-2:-1].isalpha() or L.heading(line):
        return False
    return bool(t)


def hyphens(text: list[str]) -> Rewrite:
    """Words broken at line ends put together, as long as the joined line is broken too."""
    free, out = L.free(text), []
    for i, line in enumerate(text):
        if out and free[i] and free[i - 1] and broken(out[-1][1], line):
            out[-1] = (out[-1][0], out[-1][1].rstrip()[:-1] + L.trim(line))
        else:
            out.append(([i], line))
    return L.settled(len(text), out)


_word = re.compile(r"([^\W\d_]+)")


def rejoined(line: str, known: Collection[str], most: int = 14) -> str:
    """Two pieces of a known word put together, unless both are words themselves; known words have ``most``
    letters."""
    parts = _word.split(line)  # words at odd places
    words, past = parts[1::2], -1
    near = [k for k, (a, gap, b) in enumerate(zip(words, parts[2::2], words[1:], strict=False)) if gap == " " and len(a) + len(b) <= most]
    for k in near:
        first, second = words[k], words[k + 1]
        whole = (first + second).lower()
        if k > past and whole in known and second[0].islower() and len(first) <= 8 and len(second) <= 6 and not (first.lower() in known and second.lower() in known):
            parts[2 * k + 1 : 2 * k + 4] = [whole[:1].upper() + whole[1:] if first[0].isupper() else whole, "", ""]
            past = k + 1
    return "".join(parts) if past >= 0 else line


def split_words(text: list[str], known: Collection[str]) -> Rewrite:
    free, most = L.free(text), min(14, max(map(len, known), default=0))
    return L.each(text, lambda i, x: rejoined(x, known, most) if free[i] and not L.trim(x).startswith("<!--") else x)


def whole_words(text: list[str], known: Collection[str]) -> Rewrite:
    """Unreadable characters, drop caps, line-end hyphens and split words, in turn."""
    out = readable(text)
    for step in (drop_caps, hyphens, lambda x: split_words(x, known)):
        out = out.then(step(out.lines))
    return out


def suspect(line: str, known: Collection[str]) -> bool:
    """Whether a line may hold a split word: two short pieces of which the second is no word, or two of
    two letters of which the first is none."""
    if not L.trim(line) or L.trim(line).startswith(("#", *L.NOT_PROSE, ">")):
        return False
    for m in re.finditer(r"(?<![^\W\d_])([^\W\d_]{2,4}) (?=([^\W\d_]{2,4})(?![^\W\d_]))", line):
        a, b = m[1].lower(), m[2].lower()
        if m[2][0].islower() and (b not in known or (a not in known and len(a) == len(b) == 2)):
            return True
    return False


def bare(s: str) -> str:
    """Letters and digits alone."""
    return "".join(c for c in s.lower() if c.isalnum())


def accepted(original: str, proposed: str) -> str:
    """A proposed line, if it has the same letters and digits; comments and headings stay as they are."""
    new = proposed.strip("\n\r")
    return original if "<!--" in original or L.heading(original) or not new or bare(original) != bare(new) else new


def repeated_marks(text: list[str]) -> Rewrite:
    """Page marks met before go, and so does the first line of a page that repeats an earlier heading."""
    free, pages, titles, fresh = L.free(text), set(), set(), False

    def keep(i: int, line: str) -> str | None:
        nonlocal fresh
        if not free[i]:
            fresh &= not L.is_fence(line)
            return line
        if (n := L.page_mark(line)) is not None:
            if n in pages:
                return None
            pages.add(n)
            fresh = True
            return line
        t = L.trim(line)
        if not t:
            return line
        at_top, fresh = fresh, False
        title = L.heading(t)
        name = title or t
        if at_top and not t.startswith(("![", "|", ">")) and not L.contents_line(t) and len(name) <= 80 and len(L.folded(name)) >= 2 and L.folded(name) in titles:
            return None
        if title:
            key = L.folded(title)
            titles.update(k for k in (key, L.core(key)) if k and (k == key or k[0].isalpha()))
        return line

    return L.each(text, keep)


def without_footers(line: str, addresses: Collection[str]) -> str:
    """Addresses that stick to a letter peeled off, until none does."""
    found = True
    while found:
        found = False
        for a in addresses:
            at = line.lower().find(a)
            if at > 0 and line[at - 1].isalpha():
                line, found = line[:at] + line[at + len(a) :], True
                break
    return line


def banner(line: str) -> bool:
    """The remark that the outline was taken from the file."""
    return L.trim(line).startswith(">") and "bookmarks taken from the PDF" in line


def without_chrome(text: list[str], *, least: int = 10, strip: bool = True) -> Rewrite:
    """Lines that repeat ``least`` times go, but for the first that is a heading; footers that stick to
    words go; so do banners with the blank line after them, and page marks without a body."""
    free = L.free(text)
    keys = [L.chrome_key(x) if f and strip else None for x, f in zip(text, free, strict=True)]
    often = {k for k, n in Counter(k for k in keys if k).items() if n >= least}
    sites = sorted(k for k in often if L.footer_address(k))
    headed, banners = set(), [f and banner(x) for x, f in zip(text, free, strict=True)]

    def keep(i: int, line: str) -> str | None:
        if not free[i]:
            return line
        if banners[i] or (i and banners[i - 1] and not L.trim(line)):
            return None
        if keys[i] in often:
            first = L.heading(line) is not None and keys[i] not in headed
            headed.add(keys[i]) if first else None
            return line if first else None
        return without_footers(line, sites)

    kept = L.each(text, keep)
    free, empty = L.free(kept.lines), set()
    run: list[int] = []  # a page mark and the blank lines after it
    for i, line in enumerate([*kept.lines, "<!-- page 1 -->"]):
        end = i == len(kept.lines)
        mark = end or (free[i] and L.page_mark(line) is not None)
        if run and not mark and not L.trim(line):
            run.append(i)
            continue
        if run and (mark or L.is_fence(line)):
            empty.update(run)
        run = [i] if mark and not end else []
    return kept.then(L.each(kept.lines, lambda i, x: None if i in empty else x))


def echo(line: str, title: str) -> bool:
    """Whether a line says no more than the heading above it."""
    t = L.trim(line)
    return bool(t and title) and not t.startswith(L.NOT_PROSE) and not L.contents_line(t) and L.folded(t) in (L.folded(title), L.core(L.folded(title)))


def wrapped_title(line: str, title: str) -> bool:
    """Whether a line is the first part of a compound title that goes on in the heading after it."""
    t, bare = L.trim(line), lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w).lower()
    if not t or L.heading(t) or t.startswith(L.NOT_PROSE) or L.ends_sentence(t) or not t[0].isupper():
        return False
    a, b = t.split(), title.split()
    compound = re.search(r"[—–]|\b(?:and|or)\b", t.lower()) is not None
    return compound and 3 <= len(a) <= 18 and 1 <= len(b) <= 6 and bare(a[0]) != bare(b[0])


def _goes_on(text: list[str], at: int) -> bool:
    """Whether a body of four words or more, with a capital, comes next."""
    i = L.next_said(text, at)
    t = L.trim(text[i]) if i is not None else ""
    return bool(t) and not L.is_fence(t) and not L.heading(t) and not t.startswith(L.NOT_PROSE) and t[0].isalpha() and t[0].isupper() and len(t.split()) >= 4


def heading_layout(text: list[str]) -> Rewrite:
    """Lines that only repeat the heading above go; a title that was wrapped becomes one heading."""
    free, out, title = L.free(text), [], ""
    for i, line in enumerate(text):
        own = L.heading(line) if free[i] else None
        if free[i] and not own and echo(line, title):
            continue
        at = next((k for k in range(len(out) - 1, -1, -1) if L.trim(out[k][1])), None) if own else None
        if own and at is not None and wrapped_title(out[at][1], own) and _goes_on(text, i):
            title = f"{L.trim(out[at][1])} {own}"
            out[at] = (out[at][0], "#" * min(6, max(2, L.marks(line))) + " " + title)
            continue
        title = own or title
        out.append(([i], line))
    return L.settled(len(text), out)


def blank_runs(text: list[str]) -> Rewrite:
    """One blank line between paragraphs, none within a sentence or at the ends."""
    free, out, i = L.free(text), [], 0
    while i < len(text):
        if not free[i] or L.trim(text[i]):
            out.append(([i], text[i]))
            i += 1
            continue
        j = i
        while j < len(text) and not L.trim(text[j]):
            j += 1
        run, prev, nxt = list(range(i, j)), L.trim(out[-1][1]) if out else "", L.trim(text[j]) if j < len(text) else ""
        if prev and nxt and not continues(prev, nxt):
            out.append((run, ""))
        elif out:
            out[-1] = (out[-1][0] + run, out[-1][1])
        i = j
    return L.settled(len(text), out)


def continues(prev: str, nxt: str) -> bool:
    """Whether a sentence goes on over the blank lines between two lines."""
    marks = ("#", *L.NOT_PROSE, ">")
    return not (prev.startswith(marks) or nxt.startswith(marks) or "---" in (prev, nxt)) and nxt[:1].isalpha() and not L.ends_sentence(prev)


def prose(line: str) -> bool:
    t = L.trim(line)
    return bool(t) and not t.startswith(("#", *L.NOT_PROSE, "```", "~~~")) and not L.contents_line(t)


def usual_length(text: list[str]) -> int:
    """The upper median of prose lines of 20 to 110 characters, 68 where there are none."""
    sizes = sorted(n for x, f in zip(text, L.free(text), strict=True) if f and prose(x) and 20 <= (n := len(L.trim(x))) <= 110)
    return sizes[len(sizes) // 2] if sizes else 68


_stop = re.compile(r"(?<=[^\W\d_]{3})([.!?,;:]) ")


def cut(line: str, usual: int, limit: int) -> int | None:
    """Where to break a long line: after the sentence, else the comma, else the word nearest the usual length."""
    least, last = max(16, usual // 2), len(line) - 12
    nearest = lambda spots: min(spots, key=lambda at: (abs(at - usual), at))
    stops = [m for m in _stop.finditer(line, least - 1, max(0, min(last, limit + 8))) if m.start() < last]
    for found in ([m.end() for m in stops if m[1] in ".!?"], [m.end() for m in stops if m[1] in ",;:"]):
        if found:
            return nearest(found)
    last = min(limit, last)
    if last < least:
        return None
    below, above = line.rfind(" ", least - 1, min(usual, last)), line.find(" ", max(usual, least - 1), last)
    found = [at + 1 for at in (below, above) if at >= 0]
    return nearest(found) if found else None


def long_lines(text: list[str]) -> Rewrite:
    """Prose much longer than the usual line broken near that length."""
    usual = usual_length(text)
    limit = max(usual + 28, int(usual * 1.45 + 0.5))
    free, out = L.free(text), []
    for i, line in enumerate(text):
        rest = L.trim(line)
        if not (free[i] and prose(rest) and len(rest) > limit):
            out.append(([i], line))
            continue
        parts, done = [], 0
        # a break is looked for in what decides it, so that a very long line is gone through once
        while len(rest) - done > limit and (at := cut(rest[done : done + limit + 32], usual, limit)) is not None:
            a, past = L.trim(rest[done : done + at]), done + at
            while past < len(rest) and not L.trim(rest[past]):
                past += 1
            if len(a) < 12 or len(rest) - past < 12:
                break
            parts.append(a)
            done = past
        parts += [rest[done:]] if rest[done:] else []
        indent = re.match("[ \t]*", line)[0]
        out += [([i] if k == 0 else [], (indent if k == 0 else "") + p) for k, p in enumerate(parts)]
    return L.settled(len(text), out)


def subheadings(text: list[str]) -> Rewrite:
    """Titles in the body become headings, one level below the heading before them, to the third; each
    looks at those already promoted."""
    new, free = list(text), L.free(text)
    for i, line in enumerate(text):
        if free[i]:
            a, b = L.last_said(new, i), L.next_said(new, i)
            before = L.trim(new[a]) if a is not None else ""
            if L.subheading(line, before, L.trim(new[b]) if b is not None else ""):
                new[i] = "#" * (min(3, L.level(before) + 1) if L.level(before) else 2) + " " + L.trim(line)
    return Rewrite(new, list(range(len(text))))


def hidden_numbers(text: list[str]) -> Rewrite:
    """Page headings as page marks; lines with a page number alone go."""
    free = L.free(text)
    return L.each(text, lambda i, x: x if not free[i] else L.page_heading(x) or (None if L.lone_number(x) else x))


def joined_headings(text: list[str]) -> Rewrite:
    """A heading that ends in a word such as ``of`` takes the short line after it."""
    out, i = [], 0
    while i < len(text):
        title = L.heading(text[i])
        said = L.words(title) if title else []
        j = L.next_said(text, i) if said and said[-1] in DANGLING else None
        if j is not None and L.short_title(text[j]):
            out.append(([i, j], "#" * L.marks(text[i]) + f" {title} {L.heading(text[j]) or L.trim(text[j])}"))
            i = j + 1
        else:
            out.append(([i], text[i]))
            i += 1
    return L.settled(len(text), out)


def chapter_ornaments(text: list[str]) -> Rewrite:
    """A Roman numeral under a heading goes, with the title lines below it if they spell that heading."""
    gone: set[int] = set()
    for i, line in enumerate(text):
        above = L.last_said(text, i) if i not in gone and L.roman(line) else None
        title = L.heading(text[above]) if above is not None else None
        if not title:
            continue
        gone.add(i)
        need, taken, j = Counter(L.words(title)), [], i
        while need and (j := L.next_said(text, j)) is not None and L.short_title(text[j]):
            part = Counter(L.words(L.heading(text[j]) or text[j]))
            if not part or part - need:
                break
            need -= part
            taken.append(j)
        if not need:
            gone.update(taken)
    return L.settled(len(text), [([i], x) for i, x in enumerate(text) if i not in gone], gone)


def sentence_title(title: str) -> bool:
    """Whether a title reads like a sentence."""
    n = len(L.words(title))
    return re.search(r"[.?!]\s+\S", title) is not None or n >= 14 or (n >= 10 and any(c in title for c in ',"“')) or (n >= 8 and L.words(title)[-1] in DANGLING)


def demoted(text: list[str]) -> Rewrite:
    """Headings that are citations, or the start of a sentence that goes on, become text."""

    def change(i: int, line: str) -> str:
        title = L.heading(line)
        if not title or L.citation(title):
            return title or line
        j = L.next_said(text, i) if sentence_title(title) else None
        nxt = L.trim(text[j]) if j is not None else "#"
        if L.heading(nxt) or nxt.startswith(("#", "<!--", "•", "![")) and j is None or nxt.startswith(("<!--", "•", "![")):
            return line
        return title if len(L.words(nxt)) >= 4 or len(L.words(title)) >= 12 else line

    return L.each(text, change)


def tidy_headings(text: list[str]) -> Rewrite:
    """Split headings joined, chapter ornaments gone, sentences demoted; bookmarks follow all three."""
    out = joined_headings(text)
    for step in (chapter_ornaments, demoted):
        out = out.then(step(out.lines))
    return out


def _letters(s: str) -> str:
    return "".join(c for c in s.upper() if c.isalnum())


_spaced = re.compile(r"([ \t]*(?:#{1,6} +)?)(.*)", re.S).fullmatch


def tracked(body: str) -> bool:
    """Five letters or more set apart by blanks, and nothing longer than a letter with its stop."""
    parts = body.split(" ")
    parts = [p for p in parts if p]
    return len(parts) >= 5 and all(len(p) <= 1 or (p[0].isalnum() and not any(map(str.isalnum, p[1:]))) for p in parts) and sum(p[0].isalpha() for p in parts) >= 5


def closed_letters(text: list[str], source: str) -> Rewrite:
    """Letter-spaced titles as the source text of the file writes them; of several places that with the
    same capitals, then the shortest."""
    places = [i for i, c in enumerate(source) if c.isalnum()]
    key = "".join(source[i].upper()[:1] for i in places)
    free = L.free(text)

    def best(body: str) -> str | None:
        want, own = _letters(body), [c for c in body if c.isalnum()]
        found, at = [], key.find(want) if len(want) >= 5 and len(key) >= 8 else -1
        while at >= 0:
            lo, hi = places[at], places[at + len(want) - 1] + 1
            while lo and not source[lo - 1].isspace() and not source[lo - 1].isalnum():
                lo -= 1
            while hi < len(source) and not source[hi].isspace() and not source[hi].isalnum():
                hi += 1
            said = " ".join(source[lo:hi].split())
            alike = sum(a.isupper() == b.isupper() for a, b in zip(own, (c for c in said if c.isalnum()), strict=False))
            found.append((-alike, hi - lo, len(found), said))
            at = key.find(want, at + len(want))
        return min(found)[3] if found else None

    def change(i: int, line: str) -> str:
        m = _spaced(line)
        if not free[i] or m[2].startswith((*L.NOT_PROSE, ">")) or not tracked(m[2]):
            return line
        said = best(m[2])
        return m[1] + said if said and not tracked(said) else line

    return L.each(text, change)


# What a manual's page frame begins with, and the marks that glue it to the text.
FRAME = ("page:", "date:", "747-400", "fcom ii ")
GLUE = ["Page:", "Date:", "Iss. / Revision no.:", "Iss./Revision no.:", "747-400 FCOM II", "FCOM II"]
_numbered = re.compile(r"(\d+(?:\.\d+)+)(?:\s+|(?=[^\W\d_]|\())(.+)", re.S).fullmatch


def heading_part(after: str) -> str | None:
    """The title at the start of what follows a section number: all of it up to 90 characters, else its
    first words, to the first in lower case."""
    body = re.match(r"(?:\([^)]*\)\s*)?", after).end()
    if not after[body : body + 1].isalpha():
        return None
    if len(after) <= 90:
        return after
    end = 0
    for n, m in enumerate(re.finditer(r"\S+", after)):
        if (n and m[0][0].islower()) or len(m[0]) > 40 or m.end() > 90 or n == 8:
            break
        end = m.end()
    title = L.trim(after[:end])
    return title if len(title) >= 3 else None


def numbered_heading(line: str) -> tuple[str, str] | None:
    """(heading, rest) of a line such as ``8.1 Controls and Indicators``."""
    m = _numbered(L.trim(line))
    dots = m[1].count(".") if m else 0
    title = heading_part(L.trim(m[2])) if 1 <= dots <= 6 else None
    if not title or title.lower().startswith(("page", "date", "iss")):
        return None
    return "#" * min(6, max(2, dots + 1)) + f" {m[1]} {title}", L.trim(L.trim(m[2])[len(title) :])


def numbered_callout(line: str) -> str | None:
    t = L.trim(line)
    m = re.fullmatch(r"\d{1,2}\s(.*)", t, re.S)
    rest = L.trim(m[1]) if m else ""
    return f"**{t}**" if 6 <= len(rest) <= 80 and rest[0].isalpha() and rest[0].isupper() and "." not in rest else None


def frame_line(line: str, keys: Collection[str] = ()) -> bool:
    """A line of the page frame: one of ``keys``, or one that a manual's frame begins with."""
    t = line.strip()
    if not t or numbered_heading(t) or numbered_callout(t):
        return False
    low = t.replace("  ", " ").lower()
    return low in keys or low.startswith(FRAME) or low == "fcom ii" or "revision no" in low or (low.startswith("iss") and "revision" in low)


def unglued(line: str, keys: Collection[str] = ()) -> list[str]:
    """The parts of a long line that the page frame's marks glue together."""
    if len(line) < 90:
        return [line]
    parts = re.split("|".join(map(re.escape, GLUE)) + "|\n", line, flags=re.I)
    return [t for p in parts if (t := L.trim(p)) and not frame_line(t, keys)] or [line]


def mashed(text: list[str]) -> bool:
    body = [x for x in text if not x.startswith("|")]
    size = sum(map(len, body))
    return bool(body) and ((len(body) <= 2 and size > 280) or size // len(body) > 160)


def rebuilt(page: str, plain: str, keys: Collection[str] = (), *, strip: bool = True) -> str:
    """A page's text from its Markdown, or from the file's ``plain`` text where the Markdown is mashed:
    frame lines go, section numbers become headings, numbered callouts bold."""
    kit = [t for x in re.split("\r\n|\r|\n", plain) if (t := L.trim(x)) and not (strip and frame_line(t, keys))]
    own = [t for x in page.strip().split("\n") if (t := L.trim(x)) and not t.startswith(("![", "<!--"))]
    if mashed(own) and kit:
        source = kit
    elif strip or mashed(own):
        source = [y for x in own for y in unglued(x, keys if strip else ())]
    else:
        source = own
    out, after_heading = [], False
    for line in map(str.strip, source):
        if not line or (strip and frame_line(line, keys)):
            continue
        if hit := numbered_heading(line):
            out += [""] * bool(out) + [hit[0]] + [hit[1]] * bool(hit[1])
            after_heading = not hit[1]
            continue
        out += [""] * after_heading + [numbered_callout(line) or line]
        after_heading = False
    return "\n".join(out)


def frame_keys(pages: list[str], most: int = 800) -> set[str]:
    """Lines of 4 to 60 characters on a third of the pages, three at least, section titles apart."""
    n = min(len(pages), most)
    counts: Counter[str] = Counter()
    for page in pages[:n]:
        said = {t.strip().replace("  ", " ").lower() for x in re.split("\r\n|\r|\n", page) if (t := L.trim(x)) and not numbered_heading(t) and not numbered_callout(t)}
        counts.update(k for k in said if 4 <= len(k) <= 60)
    return {k for k, c in counts.items() if c >= max(3, -(-n * 34 // 100))}


def pages_of(text: str) -> list[str]:
    """Pages between form feeds, empty ones too; else between page marks, those with text."""
    if "\f" in text:
        return text.split("\f")
    pages: list[list[str]] = [[]]
    for line in text.split("\n"):
        t = L.trim(line)
        if t.startswith("<!-- page ") and t.endswith("-->"):
            pages.append([])
        else:
            pages[-1].append(line)
    return [p for x in pages if (p := "\n".join(x).strip())]


def tidied(text: str, plain: list[str], *, strip: bool = True, most: int = 800) -> str:
    """A book rebuilt page by page with a mark before each page that has text; the book as it was where
    nothing, or too little, is left."""
    keys = frame_keys(plain) if strip else set()
    pages = pages_of(text)
    if len(pages) < 2 <= len(plain):
        pages = [""] * len(plain)
    made = []
    for i in range(min(max(len(pages), len(plain)), most)):
        body = rebuilt(pages[i] if i < len(pages) else "", plain[i] if i < len(plain) else "", keys, strip=strip).strip()
        made += [f"<!-- page {i + 1} -->", "", body, ""] if body else []
    new = "\n".join(made) or text
    a, b = len(text.strip()), len(new.strip())
    return text if b < 40 or (a > 200 and b < a // 5) else new


def reopened(text: str, passes) -> str:  # noqa: ANN001
    """A text after all passes in turn; as it was where they leave less than half of over 200 characters."""
    own = text.split("\n")
    for step in passes:
        own = step(own).lines
    new = "\n".join(own)
    return text if len(text) > 200 and len(new) * 2 < len(text) else new
