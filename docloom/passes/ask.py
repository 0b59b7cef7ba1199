"""Questions to a text: what to look for, excerpts, requests and replies; clips of it; how a reader shows it."""

from __future__ import annotations

import json
import re
import unicodedata

from . import grids
from . import lines as L
from .markup import without_comments
from .translation import MARKER

# Words of a question that say nothing.
STOP = {"the", "and", "for", "that", "this", "with", "from", "what", "when", "where", "which", "about", "does", "into", "have", "been"}


def bare(s: str) -> str:
    """Without regard to case and accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c))


def needles(answer: str, question: str) -> list[str]:
    """What an answer quotes, four characters or more, then the four longest words of the question."""
    quoted = [q.strip() for a, b in ('""', "“”", "«»") for q in re.findall(f"{a}([^{b}]*){b}", answer)]
    said = [w for w in re.split(r"[\W_]+", question.lower()) if len(w) > 3 and w not in STOP]
    return [q for q in quoted if len(q) >= 4] + sorted(said, key=len, reverse=True)[:4]


def bound(wanted: list[str], text: list[str], chapter: tuple[int, int], most: int = 120) -> list[int]:
    """Lines of the chapter that hold something wanted; of the whole text where the chapter has none."""
    keys = [bare(w) for w in wanted]
    hits = [i for i, x in enumerate(text) if any(k in bare(x) for k in keys)]
    return ([i for i in hits if chapter[0] <= i <= chapter[1]] or hits)[:most]


def excerpt(text: list[str], term: str, cap: int) -> str:
    """Two lines before the first that holds a term to seven after it; the beginning where none does."""
    hit = next((i for i, x in enumerate(text) if bare(term) in bare(x)), None)
    return "\n".join(text if hit is None else text[max(0, hit - 2) : hit + 8])[:cap]


def passage(text: list[str], line: int, ahead: int = 6, longest: int = 500) -> str:
    """Up to six lines from a hit, to the next heading or until over 500 characters; comments are passed over."""
    out: list[str] = []
    for i in range(line, min(len(text), line + ahead)):
        t = L.trim(text[i])
        if (t.startswith("#") and i > line) or len("\n".join(out)) > longest:
            break
        out += [text[i]] if t and not t.startswith("<!--") else []
    return "\n".join(out)


def plan(text: list[str], hits: list[int], budget: int = 12_000) -> str:
    """Passages of the hits, one after another, to the first that goes over the budget."""
    out, used = [], 0
    for i in dict.fromkeys(hits):
        p = passage(text, i)
        if p and used + len(p) > budget:
            break
        out += [p] if p else []
        used += len(p)
    return "\n\n".join(out)


def tagged(texts: list[tuple[str, str]], budget: int = 12_000, each: int = 2_400, least: int = 400) -> list[tuple[str, str]]:
    """(title, excerpt) of cards in their order, while the budget has at least 400 characters left."""
    out = []
    for title, said in texts:
        if budget < least:
            break
        cut = said[: min(each, budget)]
        out.append((title, cut))
        budget -= len(cut)
    return out


def budgeted(keys: list[str], budget: int = 2800) -> list[list[str]]:
    """Requests whose texts, eight characters more for each, come to the budget at most; a longer text goes alone."""
    out: list[list[str]] = []
    size = 0
    for k in keys:
        if not out or size + len(k) + 8 > budget:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(k) + 8
    return out


def mended(blob: str) -> str:
    """An object that was cut off, closed after its last string."""
    if blob and not blob.endswith("}"):
        cut = blob.rfind('"')
        blob = (blob[: cut + 1] if cut >= 0 else blob) + "}"
    return blob


def json_reply(raw: str):  # noqa: ANN201
    """The list or object in a reply with other words round it; None where it cannot be read."""
    t = re.sub(r"^```[^\n]*\n(.*?)(?:```[^`]*)?$", r"\1", raw.strip(), flags=re.S)
    for a, b in ("[]", "{}") if "{" not in t or 0 <= t.find("[") < t.find("{") else ("{}", "[]"):
        start, end = t.find(a), t.rfind(b)
        for blob in ([t[start : end + 1]] if 0 <= start < end else []) + ([mended(t[start:])] if start >= 0 and a == "{" else []):
            try:
                return json.loads(blob)
            except ValueError:
                continue
    return None


def string_list(raw: str) -> list[str] | None:
    """The strings of a reply's list; an object gives its ``line``."""
    found = json_reply(raw)
    if not isinstance(found, list):
        return None
    out = [x if isinstance(x, str) else x.get("line") if isinstance(x, dict) else None for x in found]
    return out if all(isinstance(x, str) for x in out) else None


def page_sentences(text: str) -> list[str]:
    """Sentences as the web page cuts them: after a stop and white space, and at line ends."""
    return re.split(r"(?<=[.?!])\s+|\n+", text)


def bold_runs(line: str, most: int = 24) -> tuple[str, list[tuple[int, int]]]:
    """A line without its pairs of stars, and (place, length) of what stood between them."""
    parts = line.split("**", 2 * most)
    if len(parts) % 2 == 0:  # the last mark has no partner
        parts[-2:] = ["**".join(parts[-2:])]
    out, bold = "", []
    for k, p in enumerate(parts):
        bold += [(len(out), len(p))] if k % 2 and p else []
        out += p
    return out, bold


def whole_bold(line: str) -> str | None:
    t = L.trim(line)
    return t[2:-2] if len(t) > 4 and t.startswith("**") and t.endswith("**") and "**" not in t[2:-2] else None


def page_token(line: str) -> str | None:
    """What a page mark names."""
    t = L.trim(line)
    return L.trim(t[10:-3]) or None if t.startswith("<!-- page ") and t.endswith("-->") else None


def reader_break(line: str) -> bool:
    """A line that stands alone in the reader: a translation, picture, page, heading or bold line."""
    t = L.trim(line)
    picture = re.match(r"!\[.*?\]\((?!\s*[\"']?data:)[^)]*\)", t, re.S) is not None
    return line.startswith(MARKER) or picture or page_token(t) is not None or L.level(t) > 0 or whole_bold(t) is not None


def runs(text: list[str], most: int = 80) -> list[tuple[str, int, int]]:
    """(kind, first, past) as a reader draws them: tables, lines alone, and flowing lines up to 80 together."""
    ends, out, i = dict(grids.tables(text)), [], 0
    flow: list[int] = []

    def flush() -> None:
        if flow:
            out.append(("flow", flow[0], flow[-1] + 1))
            flow.clear()

    while i < len(text):
        if i in ends:
            flush()
            out.append(("table", i, ends[i]))
            i = ends[i]
            continue
        if reader_break(text[i]):
            flush()
            out.append(("alone", i, i + 1))
        elif not L.trim(text[i]).startswith("<!--"):
            flow.append(i)
            if len(flow) >= most:
                flush()
        i += 1
    flush()
    return out


def plain_text(text: list[str], title: str = "") -> tuple[str, list[tuple[int, int]]]:
    """The text as a reader selects it, and (line, offset) of where each line begins: pages by name, table
    cells a line each, headings and bold without marks; comments, pictures and the book's own title go."""
    ends, out, where, size, i = dict(grids.tables(text)), [], [], 0, 0

    def emit(line: int, piece: str) -> None:
        nonlocal size
        where.append((line, size))
        out.append(piece)
        size += len(piece)

    while i < len(text):
        line = text[i]
        own = line.removeprefix(MARKER)
        t = L.trim(own)
        if i in ends:
            rows = grids.grid(text, i, ends[i])
            for k, row in enumerate(rows):
                emit(i if k == 0 else min(i + 1 + k, ends[i] - 1), "".join(f"{c}\n" for c in row))
            i = ends[i]
            continue
        if (page := page_token(line)) is not None:
            emit(i, f"Page {page}\n")
        elif t.startswith("![") and "](" in t:
            where.append((i, size))
        elif own != line or not t.startswith("<!--"):
            head = L.trim(t[L.level(t) :]) if L.level(t) else ""
            if head and own == line and L.level(t) == 1 and title and head.lower() == title.lower():
                where.append((i, size))
            else:
                emit(i, (head or whole_bold(own) or bold_runs(own)[0]) + "\n")
        i += 1
    return "".join(out), where


def paged_markdown(title: str, pages: list[str]) -> str:
    """A file's pages under headings, with its title in front: a page's heading is its first line of 4 to 79
    characters, else its number."""
    out = ["---", f"title: {title}", "---", ""]
    for n, page in enumerate(pages, 1):
        said = next((t for x in page.split("\n") if 4 <= len(t := L.trim(x)) < 80), f"Page {n}")
        out += [f"## {said}", ""] + ([page, ""] if page else [])
    return "\n".join(out)


def clip(raw: str, chapter: str = "", source: str = "", page: str = "") -> str:
    """A piece of text with the chapter above it and where it comes from below."""
    t = "\n".join(L.trim(x) for x in raw.replace("\r\n", "\n").replace("\xa0", " ").split("\n"))
    t = re.sub("\n{3,}", "\n\n", t).strip()
    cite = " · ".join(x for x in (source, f"Page {page}" if page else "") if x)
    return "\n".join(([f"### {chapter}", ""] if chapter else []) + [t] + (["", f"*{cite}*"] if cite else []))


def with_question(snippet: str, question: str) -> str:
    """A clip with the question below its chapter, or in front."""
    q = question.strip()
    if not q:
        return snippet
    head, gap, body = snippet.partition("\n\n")
    return f"{head}{gap}**Q:** {q}\n\n{body}" if gap else f"**Q:** {q}\n\n{snippet}"


def cited(note: str, titles: tuple[str, ...] = ()) -> list[str]:
    """Titles that a note's clips cite: lines between stars with a page, or with one of ``titles``."""
    out, have = [], {t.lower() for t in titles}
    for line in note.split("\n"):
        t = L.trim(line)
        if len(t) > 2 and t.startswith("*") and t.endswith("*"):
            parts = re.split(" · Page ", t[1:-1], maxsplit=1, flags=re.I)
            name = L.trim(parts[0])
            out += [name] if name and (len(parts) > 1 or name.lower() in have) else []
    return out


def note_body(text: str, marker: str = "") -> str:
    """A note without the mark and the title that it begins with."""
    t = text.strip()
    t = t.removeprefix(marker).strip() if marker else t
    return t.partition("\n")[2].strip() if t.startswith("# ") else t


def session_title(path: str) -> str:
    """``2024-01-02_10_30_00`` as ``2024-01-02 10.30.00``; other names with blanks for underscores."""
    stem = re.sub(r"\.[^./]*$", "", path.rpartition("/")[2])
    stem = stem[:-7] if stem.lower().endswith("_forage") else stem
    parts = [p for p in stem.split("_") if p]
    return f"{parts[0]} {'.'.join(parts[1:4])}" if len(parts) >= 4 else stem.replace("_", " ")


def clip_path(path: str) -> bool:
    return path.lower().endswith("_forage.md")


def visible(text: str) -> str:
    return without_comments(text)


def page_near(text: list[str], offset: int) -> str | None:
    """The page that an offset of the text stands on."""
    upto, page = 0, None
    for line in text:
        if upto > offset:
            break
        page = page_token(line) or page
        upto += len(line) + 1
    return page


def selection(text: list[str], start: int, end: int) -> str:
    """What is selected of the reader's text, tables that it touches as tables of the cells chosen."""
    shown, where = plain_text(text)
    ends, out, at, end = dict(grids.tables(text)), [], start, min(end, len(shown))
    line_at = lambda o: max((i for i, p in where if p <= o), default=0)
    while at < end:
        line = line_at(at)
        table = next(((a, b) for a, b in ends.items() if a <= line < b), None)
        if table is None:
            stop = min((p for i, p in where if p > at), default=len(shown))
            out.append(shown[at : min(stop, end)].rstrip("\n"))
            at = stop
            continue
        rows = grids.grid(text, *table)
        first = min(p for i, p in where if table[0] <= i < table[1])
        places = []
        for r, row in enumerate(rows):
            for c, cell in enumerate(row):
                places.append((r, c, first, first + len(cell)))
                first += len(cell) + 1
        picked = {(r, c) for r, c, a, b in places if a < end and b > start}
        out += grids.selected(text, *table, picked) or [rows[r][c] for r, c in sorted(picked)]
        at = max(first, at + 1)
    return "\n".join(out)


def note(title: str, clips: list[str], marker: str = "") -> str:
    """A note file of clips: its mark, its title, and the clips between rules."""
    return "\n".join(([marker, ""] if marker else []) + [f"# {title}", "", "\n\n---\n\n".join(clips), ""])


def working(base: str, live: str) -> str:
    """A note's text with what is still being gathered below a rule."""
    return "\n\n---\n\n".join(x for x in (base.strip(), live.strip()) if x)


def daily_note(have: str, source: str, text: str) -> str:
    """The day's note with a piece added under its source."""
    return f"{have.rstrip()}\n\n## {source}\n\n{text.strip()}\n".lstrip()


def chapter_text(text: str, n: int, most: int = 12_000) -> str:
    """The n-th part of a text between headings, the whole where there are fewer than three; 12,000 characters at most."""
    parts = re.split(r"(?m)^(?=#{1,6}\s)", text)
    return (parts[min(n, len(parts) - 1)] if len(parts) >= 3 else text)[:most]
