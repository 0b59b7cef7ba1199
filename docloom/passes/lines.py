"""What a line of Markdown is, and where its lines go when a text is rewritten."""

from __future__ import annotations

import re
from dataclasses import dataclass

BLANKS = "\t \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_heading = re.compile(r"#{1,6}(?!#)[# ]*(.*)", re.S).fullmatch
_number = re.compile(r"\d+(?:\.\d+)*\s+").match
_page = re.compile(r"<!-- page (.*)-->", re.S).fullmatch
_roman = re.compile(r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})").fullmatch
_cite = r"(?:[1-3]\s+)?[A-Za-z][A-Za-z'’]*(?:\s+[A-Za-z][A-Za-z'’]*){0,3}\s+\d{1,3}\s*:\s*\d{1,3}(?:\s*[–—-]\s*\d{1,3})?"
_citations = re.compile(rf"{_cite}(?:\s*;\s*{_cite})*").fullmatch
_trailing = re.compile(r"\s{2,}\d{1,4}\s*$").search
_pagelike = re.compile(r"(?:page|página|pagina|seite|pág\.?|стр\.?|страница)\s*\d+|第\s*\d+\s*页|\d+\s*(?:ページ|페이지)", re.I).fullmatch
# Fixed value: the mark of a translated line below its original.
MARKER = "<!--ym-tr-->"
#: Marks that a line of text does not begin with.
NOT_PROSE = ("<!--", "![", "|")


def trim(s: str) -> str:
    return s.strip(BLANKS)


def is_fence(line: str) -> bool:
    return ("```" in line or "~~~" in line) and trim(line).startswith(("```", "~~~"))


def free(lines: list[str]) -> list[bool]:
    """Which lines stand outside fences and are no fence marks."""
    out, inside = [], False
    for line in lines:
        mark = is_fence(line)
        out.append(not inside and not mark)
        inside ^= mark
    return out


def heading(line: str) -> str | None:
    """Title of a line of one to six marks, a translated one too."""
    t = trim(line)
    if t[:1] not in ("#", "<"):
        return None
    m = _heading(trim(t.removeprefix(MARKER)))
    return trim(m[1]) or None if m else None


def marks(line: str) -> int:
    t = trim(line)
    return len(t) - len(t.lstrip("#"))


def level(line: str) -> int:
    """Level of a heading with a blank after its marks, 0 for other lines."""
    n = marks(line)
    return n if 1 <= n <= 6 and trim(line)[n : n + 1] == " " else 0


def folded(title: str) -> str:
    t = trim(trim(title).replace("\xa0", " ").lstrip("#"))
    if t.startswith("[]"):
        t = trim(t[2:])
    if not t.isascii():
        t = t.replace("–", "-").replace("—", "-").replace("−", "-")
    said = " ".join(t.split())
    if said != t:  # white space that is trimmed neither before nor after stays, as one blank
        said = " " * t[:1].isspace() + said + " " * (t[-1:].isspace() and said != "")
    return said.lower()


def core(title: str) -> str:
    """A folded title without the number that it begins with."""
    m = _number(title)
    return title[m.end() :] if m else title


def words(title: str) -> list[str]:
    return re.findall(r"(?:[^\W_]|')+", core(folded(title)).replace("’", "'"))


def page_mark(line: str) -> int | None:
    m = _page(trim(line)) if "<!-- page" in line else None
    n = trim(m[1]) if m else ""
    return int(n) if n.isdecimal() and int(n) > 0 else None


def contents_line(line: str) -> bool:
    return "..." in line or (line.rstrip()[-1:].isdecimal() and heading(line) is None and _trailing(trim(line)) is not None)


def roman(line: str) -> bool:
    t = trim(line).removesuffix(".")
    return 1 <= len(t) <= 7 and _roman(t) is not None


def page_like(title: str) -> bool:
    return _pagelike(title.strip()) is not None


def lone_number(line: str) -> bool:
    t = trim(line)
    return 1 <= len(t) <= 4 and t.isnumeric()


def page_heading(line: str) -> str | None:
    """The page mark that a heading such as ``## Page 7`` stands for."""
    title = heading(line)
    digits = "".join(c for c in title if c.isdecimal()) if title else ""
    if digits and 1 <= int(digits) <= 9999 and (page_like(title) or title.isnumeric()):
        return f"<!-- page {int(digits)} -->"
    return None


def ends_sentence(line: str) -> bool:
    return trim(line).rstrip("\"”’')]}»").endswith((".", "!", "?", "…"))


def citation(line: str) -> bool:
    """Only citations of a chapter and verse."""
    t = trim(line)
    t = (heading(t) or t).strip("()[]“”\"'.")
    return 3 <= len(t) <= 80 and _citations(t) is not None


def short_title(line: str) -> bool:
    """A heading, or a line that could be one: up to 60 characters and ten words, no sentence, no list."""
    t = trim(line)
    if heading(t):
        return True
    if not t or roman(t) or t.startswith((*NOT_PROSE, "•", "- ", "* ")) or len(t) > 60 or t.endswith((".", "!", "?")):
        return False
    return 1 <= len(words(t)) <= 10


def subheading(line: str, before: str, after: str) -> bool:
    """A title that stands in the body between a finished paragraph and the next."""
    t = trim(line)
    if not t or level(t) or citation(t) or contents_line(t) or t.startswith((*NOT_PROSE, ">", "- ", "* ", "•")):
        return False
    if not (t[0].isalpha() and t[0].isupper()) or ends_sentence(t) or t.endswith((",", ";", ":")):
        return False
    told = not before or ends_sentence(before) or level(before) > 0 or before.startswith("<!--")
    return told and 2 <= len(t.split()) <= 14 and 8 <= len(t) <= 80 and after[:1].isalpha() and after[:1].isupper()


def footer_address(text: str) -> bool:
    """A web address and nothing else."""
    t = trim(text)
    body = re.sub(r"^www\.", "", re.sub("^https?://", "", t.lower()))
    return 8 <= len(t) <= 80 and "." in body and body[0] != "." != body[-1] and re.fullmatch("[a-z0-9.-]+", body) is not None


def chrome_key(line: str) -> str | None:
    """What a running header or footer is told by when it repeats."""
    t = trim(line)
    title = heading(t) or t
    if not t or t.startswith(("![", "|")) or page_mark(t) is not None or contents_line(t) or len(title) > 80:
        return None
    said = [w for w in title.split() if any(map(str.isalpha, w))]
    key = folded(title)
    return key if footer_address(title) or (2 <= len(said) <= 14 and len(key) >= 2) else None


def next_said(lines: list[str], after: int) -> int | None:
    return next((i for i in range(after + 1, len(lines)) if trim(lines[i])), None)


def last_said(lines: list[str], before: int) -> int | None:
    return next((i for i in range(before - 1, -1, -1) if trim(lines[i])), None)


@dataclass
class Rewrite:
    """Lines of a rewritten text, and for each old line the new one that it is now part of."""

    lines: list[str]
    where: list[int]

    def then(self, other: Rewrite) -> Rewrite:
        """This rewrite and, of its lines, another."""
        last = max(0, len(other.where) - 1)
        return Rewrite(other.lines, [other.where[min(i, last)] if other.where else 0 for i in self.where])


def settled(old: int, kept: list[tuple[list[int], str]], back: set[int] | None = None) -> Rewrite:
    """A rewrite of ``old`` lines from its new lines, each with the old lines that land on it.

    A line that lands nowhere goes forward to the next that does, at the end to the last line; one of
    ``back`` goes to the line before it.
    """
    where: list[int | None] = [None] * old
    for at, (olds, _) in enumerate(kept):
        for i in olds:
            where[i] = at
    if back:
        held = 0
        for i in range(old):
            if where[i] is None and i in back:
                where[i] = held
            held = where[i] if where[i] is not None else held
    ahead = max(0, len(kept) - 1)
    for i in range(old - 1, -1, -1):
        ahead = where[i] = ahead if where[i] is None else where[i]
    return Rewrite([t for _, t in kept], where)


def each(lines: list[str], change) -> Rewrite:  # noqa: ANN001
    """A rewrite line by line: ``change(i, line)`` gives the new line, or None to leave it out."""
    kept = [([i], new) for i, line in enumerate(lines) if (new := change(i, line)) is not None]
    return settled(len(lines), kept)
