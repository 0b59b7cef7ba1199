"""Pictures of a text: held in it, beside it, and small ones that repeat."""

from __future__ import annotations

import base64
import binascii
import re

from . import lines as L

_DATA = re.compile(r"!\[[^\]]*\]\(data:image/([A-Za-z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)\)")


def materialized(text: str, *, already: int = 0, most: int = 400, folder: str = "figures") -> tuple[str, list[tuple[str, bytes]]]:
    """The text with pictures that it holds linked as files, and the files; broken ones go."""
    files: list[tuple[str, bytes]] = []

    def link(m: re.Match) -> str:
        if len(files) >= most:
            return m[0]
        try:
            data = base64.b64decode(re.sub(r"\s", "", m[2]))
        except binascii.Error:
            data = b""
        if len(data) <= 32:
            return ""
        n = already + len(files) + 1
        kind = next((k for k in ("png", "webp") if k in m[1].lower()), "jpg")
        files.append((f"{folder}/figure-{n:03d}.{kind}", data))
        return f"![Figure {n}]({files[-1][0]})"

    return _DATA.sub(link, text), files


def alike(a: tuple[int, int], b: tuple[int, int], slack: float = 0.15) -> bool:
    """Whether two sizes differ by no more than a share of the larger, on both sides."""
    return all(abs(x - y) <= slack * max(x, y, 1) for x, y in zip(a, b, strict=True))


def ornaments(sizes: list[tuple[str, int, int]], *, least: int = 10, small: int = 150_000) -> set[str]:
    """Names of small pictures of which ten or more share a size."""
    left = [(n, (w, h)) for n, w, h in sizes if 0 < w * h < small]
    out: set[str] = set()
    for name, size in left:
        own = [n for n, s in left if n not in out and alike(size, s)] if name not in out else []
        out.update(own if len(own) >= least else [])
    return out


def linked_name(line: str) -> str | None:
    """File name of the picture that a line begins with."""
    m = re.match(r"!\[.*?\]\(([^)]*)\)", L.trim(line), re.S)
    path = m[1].partition(" ")[0].strip("\"' ") if m else ""
    return path.rstrip("/").rpartition("/")[2] or None


def without_ornaments(text: list[str], sizes: list[tuple[str, int, int]]) -> L.Rewrite:
    gone = ornaments(sizes)
    return L.each(text, lambda i, x: None if linked_name(x) in gone else x)


def figure_number(name: str) -> int | None:
    m = re.fullmatch(r"figure-(\d+)\.\w+", name)
    return int(m[1]) if m else None


def spliced(text: list[str], figures: list[tuple[int, str]], *, title: str = "Figures") -> list[str]:
    """Links to (page, file) put after the first line of the page's body that is no heading; those of pages
    that are not there come at the end."""
    by_page: dict[int, list[str]] = {}
    for page, name in figures:
        by_page.setdefault(page, []).append(name)
    out: list[str] = []
    page, due = None, False
    link = lambda f: ["", f"![{f.rpartition('/')[2].rpartition('.')[0]}]({f})"]
    for line in text:
        n = L.page_mark(line)
        if n is not None and due:
            out += [x for f in by_page.pop(page, []) for x in link(f)]
        page, due = (n, n in by_page) if n is not None else (page, due)
        out.append(line)
        if due and n is None and L.trim(line) and not L.heading(line):
            out += [x for f in by_page.pop(page, []) for x in link(f)] + [""]
            due = False
    out += [x for f in by_page.pop(page, []) for x in link(f)] if due else []
    left = [f for names in by_page.values() for f in names]
    return out + (["", f"## {title}"] + [x for f in left for x in link(f)] if left else [])
