"""Outlines and texts: page marks, headings put where the outline says, bookmarks found again."""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import asdict, dataclass, replace

from . import lines as L


@dataclass(frozen=True)
class Mark:
    """An outline entry; ``page`` and ``line`` count from 0."""

    title: str
    level: int = 1
    page: int | None = None
    line: int | None = None


def written(marks: list[Mark]) -> str | None:
    """The outline beside a text, as JSON; none for an empty outline."""
    return json.dumps([{k: v for k, v in asdict(m).items() if v is not None} for m in marks], ensure_ascii=False) if marks else None


def read(data: str | None) -> list[Mark]:
    """An outline from its JSON; empty where it cannot be read."""
    try:
        return [Mark(str(x["title"]), int(x.get("level", 1)), x.get("page"), x.get("line")) for x in json.loads(data or "")]
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


def page_breaks(text: str) -> str:
    """Form feeds as page marks; a blank page in front has no number."""
    if "\f" not in text:
        return text
    parts = [p.strip() for p in text.split("\f")]
    first = 0 if parts[0] else 1
    chunks = []
    for i, part in enumerate(parts):
        chunks += [f"<!-- page {i - first + 1} -->"] * (i >= first) + [part] * bool(part)
    return "\n\n".join(chunks)


def heading_page(line: str) -> int | None:
    """N of a heading ``Page N``."""
    title = L.heading(line)
    digits = title[5:].strip() if title and title.lower().startswith("page ") else ""
    return int(digits) if digits.isdecimal() and int(digits) > 0 else None


def page_starts(text: list[str]) -> dict[int, int]:
    """First line of each page, from 0: that of its ``Page N`` heading, else that of its mark."""
    out: dict[int, int] = {}
    for read_page in (heading_page, L.page_mark):
        for i, line in enumerate(text):
            if (n := read_page(line)) is not None and n - 1 not in out:
                out[n - 1] = i
    return out


def outline_core(title: str) -> str:
    """A folded title without its number, unless less than three characters are left."""
    f = L.folded(title)
    return c if len(c := L.core(f)) >= 3 else f


def line_matches(line: str, needle: str) -> bool:
    """Whether a line says a folded title: the same, with more after it that is no letter, long enough a
    part of it, or a short line that holds it."""
    a = L.folded(line)
    if len(a) < 3 or L.contents_line(line):
        return False
    if a.startswith(needle):
        return not a[len(needle) : len(needle) + 1].isalpha()
    if needle.startswith(a) and len(a) >= 16 and not a.startswith("page "):
        return True
    return L.heading(line) is None and len(a) <= 120 and needle in a and len(needle) >= 8


def title_line(title: str, text: list[str], start: int = 0, end: int | None = None) -> int | None:
    needle = L.folded(title)
    return next((i for i in range(max(0, start), min(len(text), len(text) if end is None else end)) if line_matches(text[i], needle)), None) if len(needle) >= 3 else None


def heading_line(title: str, text: list[str], start: int = 0, skip: set[int] = frozenset()) -> int | None:
    want = L.folded(title)
    return next((i for i in range(max(0, start), len(text)) if i not in skip and (h := L.heading(text[i])) is not None and L.folded(h) == want), None)


def heading_and_title_lines(titles: list[str], text: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Each title with its ``heading_line`` and its ``title_line``. Lines are folded once for all titles; a title is
    looked for in all of them at once, and only lines that hold it, or begin it, are looked at."""
    heads: dict[str, int] = {}
    plain: dict[str, int] = {}
    starts, where, headed, said, size = [], [], [], [], 0
    for i, line in enumerate(text):
        h, a = L.heading(line), L.folded(line)
        if h is not None:
            heads.setdefault(L.folded(h), i)
        if len(a) >= 3 and not L.contents_line(line):
            starts.append(size)
            where.append(i)
            headed.append(h is not None)
            said.append(a)
            size += len(a) + 1
            if len(a) >= 16 and not a.startswith("page "):
                plain.setdefault(a, i)
    begun: dict[str, list[tuple[str, int]]] = {}
    for a, i in plain.items():
        begun.setdefault(a[:16], []).append((a, i))
    whole = "\n" + "\n".join(said)

    def holding(needle: str) -> int | None:
        asked, at = (needle if len(needle) >= 8 else "\n" + needle), 0
        while (at := whole.find(asked, at)) >= 0:
            k = bisect_right(starts, at - (len(asked) == len(needle))) - 1
            a = said[k]
            if not a[len(needle) : len(needle) + 1].isalpha() if a.startswith(needle) else not headed[k] and len(a) <= 120:
                return where[k]
            at = starts[k] + len(a) + 1  # the line end after it
        return None

    def line(title: str) -> int | None:
        needle = L.folded(title)
        if len(needle) < 3:
            return None
        found = [i for a, i in begun.get(needle[:16], ()) if needle.startswith(a)]
        return min((i for i in (holding(needle), *found) if i is not None), default=None)

    known: dict[str, int | None] = {}
    return [(t, heads.get(L.folded(t)), known[t] if t in known else known.setdefault(t, line(t))) for t in titles]


def _spread(text: list[str], at: int, end: int, needle: str) -> bool:
    """Whether two or three lines from ``at`` are the title together."""
    said = ""
    for n, line in enumerate(text[at : min(end, at + 3)]):
        t = L.trim(line)
        if not t or t.startswith(L.NOT_PROSE) or L.is_fence(t) or L.contents_line(line) or len(t) > 80:
            return False
        said = f"{said} {L.folded(L.heading(line) or t)}".strip()
        if n and said == needle:
            return True
        if n and len(said) > len(needle):
            return False
    return False


def anchor(title: str, text: list[str], start: int, end: int) -> int | None:
    """The line where a title stands as a heading, or begins over two or three lines."""
    needle = outline_core(title)
    if len(needle) < 3:
        return None
    for i in range(max(0, start), min(end, len(text))):
        t = L.trim(text[i])
        if not t or t.startswith("<!--") or L.is_fence(t) or L.contents_line(text[i]):
            continue
        h = L.heading(text[i])
        if (h is not None and (outline_core(h) == needle or L.folded(h) == L.folded(title))) or _spread(text, i, min(end, len(text)), needle):
            return i
    return None


def stitched(marks: list[Mark], text: list[str]) -> tuple[list[str], list[Mark]]:
    """The text with the outline's entries as headings, and the outline with their lines.

    An entry goes where its title stands between its page and the next later one of the outline. Where
    it does not, it goes to a line of its page that matches, else below the page's first line; one that
    shares its page with the entry before is then left out.
    """
    new, starts, cursor = list(text), page_starts(text), 0
    inserts: dict[int, list[int]] = {}
    level = lambda m: min(6, max(1, m.level))
    head: dict[int, int] = {}  # entries that are headings already
    for k, m in enumerate(marks):
        title = m.title.strip()
        if not title:
            continue
        page = starts.get(m.page) if m.page is not None else None
        later = (starts[x.page] for x in marks[k + 1 :] if x.page in starts and x.page is not None and (m.page is None or x.page > m.page))
        hit = anchor(title, new, cursor if page is None else page, next(later, len(new)))
        if hit is not None and L.heading(new[hit]):
            new[hit] = "#" * level(m) + " " + title
            head[k], cursor = hit, hit + 1
            continue
        if hit is None:
            if k and m.page is not None and m.page == marks[k - 1].page:
                continue
            if page is not None:
                nxt = min((i for p, i in starts.items() if p > m.page), default=len(new), key=lambda i: i)
                nxt = starts[min((p for p in starts if p > m.page), default=m.page)] if any(p > m.page for p in starts) else len(new)
                hit = title_line(title, new, page, nxt)
                hit = min(page + 1, len(new)) if hit is None else hit
            else:
                hit = title_line(title, new, cursor)
                hit = min(cursor, len(new)) if hit is None else hit
        inserts.setdefault(hit, []).append(k)
        cursor = min(len(new), hit + 1)
    out: list[str] = []
    at_old: dict[int, int] = {}
    at_new: dict[int, int] = {}
    for i in range(len(new) + 1):
        for k in inserts.get(i, []):
            out += ["", "#" * level(marks[k]) + " " + marks[k].title.strip(), ""]
            at_new[k] = len(out) - 2
        if i < len(new) and (L.heading(new[i]) or "").lower() != "outline":
            at_old[i] = len(out)
            out.append(new[i])
    return out, [replace(m, line=at_new.get(k, at_old.get(head[k]) if k in head else m.line)) for k, m in enumerate(marks)]


def with_page_marks(text: str, pages: list[str]) -> str:
    """Page marks put before the first distinctive line of each page of the file, else in proportion;
    a text that has two already stays."""
    text = page_breaks(text)
    new = text.split("\n")
    if len({L.page_mark(x) for x in new} - {None}) >= 2 or sum(heading_page(x) is not None for x in new) >= 2:
        return text
    cursor, at = 0, []
    for k, page in enumerate(pages):
        sample = distinctive(page)
        needle = L.folded(sample) if sample and len(sample) >= 16 else None
        hit = next((i for i in range(cursor, len(new)) if not L.contents_line(new[i]) and (needle in (a := L.folded(new[i])) or (len(a) >= 16 and a in needle))), None) if needle else None
        if hit is None:
            hit = min(len(new), cursor + max(1, len(new) - cursor) // max(1, len(pages) - k))
        at.append(hit)
        cursor = min(len(new), hit + 1)
    for k in range(len(at) - 1, -1, -1):
        i = at[k]
        if "<!-- page" not in "".join(new[i : i + 1]) and f"<!-- page {k + 1}" not in "".join(new[max(0, i - 1) : i]):
            new.insert(i, f"<!-- page {k + 1} -->")
    return "\n".join(new)


def distinctive(page: str | None) -> str | None:
    """The first line of a page of 28 characters or more, else of 20, up to 160, that is no contents line."""
    said = [t for x in (page or "").split("\n") if 20 <= len(t := L.trim(x)) <= 160 and any(map(str.isalpha, t)) and not L.contents_line(x)]
    return next((t for t in said if len(t) >= 28), said[0] if said else None)


def claimed(marks: list[Mark], text: list[str], marker: str = "") -> tuple[list[str], list[Mark]]:
    """An outline on a translated text: entries take the headings that say their titles, the others the
    headings left, in order, which get the entry's title and level; then the marks of their pages."""
    new, taken = list(text), set()
    heads = [i for i, x in enumerate(new) if (h := _title(x, marker)) and not L.page_like(h) and h.lower() != "outline"]
    where: list[int | None] = []
    for m in marks:
        i = next((i for i in heads if i not in taken and L.folded(_title(new[i], marker)) == L.folded(m.title)), None) if m.title else None
        where.append(i)
        taken.add(i)
    left = [i for i in heads if i not in taken]
    for k, m in enumerate(marks):
        if where[k] is None and left:
            i = where[k] = left.pop(0)
            new[i] = (marker if marker and L.trim(new[i]).startswith(marker) else "") + "#" * min(6, max(1, m.level)) + " " + m.title
    starts = {(L.page_mark(x) or 0) - 1: i for i, x in reversed(list(enumerate(new))) if L.page_mark(x)}
    where = [starts.get(m.page) if w is None and m.page is not None else w for m, w in zip(marks, where, strict=True)]
    return new, [replace(m, line=w) for m, w in zip(marks, where, strict=True)]


def _title(line: str, marker: str = "") -> str | None:
    t = L.trim(line)
    return L.heading(t.removeprefix(marker) if marker else t)


def found(m: Mark, text: list[str]) -> int | None:
    """The line of a bookmark: the one it has, its heading, a line that says its title, its page."""
    if m.line is not None and 0 <= m.line < len(text):
        return m.line
    start = next((i for i, x in enumerate(text) if "<!-- page 1 -->" in x), 0)
    title = m.title.strip()
    for look in (heading_line, title_line):
        if title and (i := look(title, text, start)) is not None:
            return i
    return {L.page_mark(x) - 1: i for i, x in reversed(list(enumerate(text))) if L.page_mark(x)}.get(m.page)


def moved_headings(text: list[str], rounds: int = 8) -> L.Rewrite:
    """A heading that stands right under another, whose own title comes more than four lines later after the
    upper one's, moves there; several times."""
    out = L.Rewrite(list(text), list(range(len(text))))
    for _ in range(rounds):
        job = _stolen(out.lines)
        if job is None:
            break
        a, b = job
        kept = []
        for i, line in enumerate(out.lines):
            if i == b and L.heading(line):
                kept.append(([a, b], out.lines[a]))
            elif i == b:
                kept += [([a], out.lines[a]), ([b], line)]
            elif i != a:
                kept.append(([i], line))
        out = out.then(L.settled(len(out.lines), kept))
    return out


def _stolen(text: list[str]) -> tuple[int, int] | None:
    heads = [i for i, x in enumerate(text) if L.heading(x)]
    for i in heads:
        j = L.next_said(text, i)
        if j is None or not L.heading(text[j]) or L.marks(text[j]) > L.marks(text[i]):
            continue
        upper = anchor(L.heading(text[i]), text, j + 1, len(text))
        to = anchor(L.heading(text[j]), text, upper, len(text)) if upper is not None else None
        if to is not None and to > j + 4:
            return j, to
    return None


def font_headings(spans: list[tuple[int, str, float]], pages: int = 120, most: int = 80) -> list[Mark]:
    """The largest text of each page as its heading, where it stands out of the page's median size.

    ``spans`` are (page, text, size) in reading order; pages with fewer than eight spans give none.
    """
    out, seen = [], set()
    for page in sorted({p for p, _, _ in spans if p < pages}):
        own = [(t, z) for p, t, z in spans if p == page]
        if len(own) < 8:
            continue
        median = sorted(z for _, z in own)[len(own) // 2]
        big = [(z, " ".join(t.split())) for t, z in own if z >= max(median + 1.5, median * 1.28)]
        title = next((t for z, t in sorted(((z, t) for z, t in big if 4 <= len(t) <= 90), key=lambda x: -x[0])), None)
        if title and L.folded(title) not in seen and len(out) < most:
            seen.add(L.folded(title))
            out.append(Mark(title, 2, page))
    return out


def interpolated(line: int, own: tuple[int, int], other: tuple[int, int]) -> int:
    """The line of another section that a line of one stands for, by its share of the way."""
    size = max(1, own[1] - own[0])
    share = min(1.0, max(0.0, (line - own[0]) / size))
    return other[0] + int(share * (other[1] - other[0]))


def part_of(marks: list[Mark], start: int) -> list[Mark]:
    """An entry and the deeper ones right after it."""
    end = next((k for k in range(start + 1, len(marks)) if marks[k].level <= marks[start].level), len(marks))
    return marks[start:end]


def inferred(text: list[str], proposed: list[tuple[str, str]], *, least: int = 12) -> list[str]:
    """Headings put before the first line that holds the words proposed for them, word for word, in order."""
    new, cursor = list(text), 0
    for title, needle in proposed:
        at = next((i for i in range(cursor, len(new)) if needle in new[i]), None) if len(needle) >= least else None
        if at is not None and title.strip():
            new[at:at] = ["", f"## {title.strip()}", ""]
            cursor = at + 4
    return new


def walked(entries: list[dict], level: int = 1) -> list[Mark]:
    """A tree of outline entries (title, page, children) in reading order, with levels."""
    out = []
    for e in entries:
        title = " ".join(str(e.get("title", "")).split())
        out += [Mark(title, level, e.get("page"))] if title else []
        out += walked(e.get("children", []), level + 1)
    return out


def relocated(marks: list[Mark], text: list[str]) -> list[Mark]:
    """An outline on an edited text: entries by their titles, the others on the headings that no entry has
    taken, in order; without an outline, the text's own headings."""
    heads = [(i, L.marks(x), h) for i, x in enumerate(text) if (h := L.heading(x)) and not L.page_like(h) and h != "Outline"][:180]
    if not marks:
        return [Mark(h, min(3, n), line=i) for i, n, h in heads]
    where = [next((i for i, _, h in heads if h.lower() == m.title.lower()), None) for m in marks]
    left = [i for i, _, _ in heads if i not in where]
    return [replace(m, line=w if w is not None else left.pop(0) if left else None) for m, w in zip(marks, where, strict=True)]


def sections(text: list[str]) -> list[tuple[int, int, int, str]]:
    """(first, past, level, title) of each heading's part, to the next heading of any level."""
    heads = [(i, L.marks(x), h) for i, x in enumerate(text) if (h := L.heading(x)) and not L.page_like(h)]
    ends = [i for i, _, _ in heads[1:]] + [len(text)] * bool(heads)
    return [(i, e, n, h) for (i, n, h), e in zip(heads, ends, strict=True)]


def counterpart(own: list[tuple[int, int, int, str]], at: int, other: list[tuple[int, int, int, str]]) -> int | None:
    """The section of another outline that one stands for: the same place among those of its level, else the
    same place of all."""
    same = [k for k, s in enumerate(other) if s[2] == own[at][2]]
    nth = sum(s[2] == own[at][2] for s in own[:at])
    return same[nth] if nth < len(same) else at if at < len(other) else None


def followed(text: list[str], other: list[str], line: int) -> int:
    """The line of a translation that a line stands for: within its section's counterpart by share, else by
    its page, else by its share of the whole."""
    own, theirs = sections(text), sections(other)
    at = next((k for k in range(len(own) - 1, -1, -1) if own[k][0] <= line), None)
    to = counterpart(own, at, theirs) if at is not None else None
    if to is not None:
        return min(theirs[to][1] - 1, interpolated(line, own[at][:2], theirs[to][:2]))
    page = next((n for i in range(line, -1, -1) if (n := L.page_mark(text[i])) is not None), None) if text else None
    hit = next((i for i, x in enumerate(other) if page is not None and L.page_mark(x) == page), None)
    return hit if hit is not None else interpolated(line, (0, len(text)), (0, len(other)))


def next_page_line(marks: list[Mark], at: int, starts: dict[int, int], past: int) -> int:
    """Where the next entry of a later page begins, else the end."""
    page = marks[at].page
    return next((starts[m.page] for m in marks[at + 1 :] if m.page in starts and (page is None or m.page > page)), past)
