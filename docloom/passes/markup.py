"""Markdown as XHTML, and a book as an EPUB package of stored files."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from ..sources.office import stored_zip
from . import grids
from . import lines as L


def escape(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = s.replace(a, b)
    return s


def without_comments(s: str) -> str:
    """Comments out; one that is not closed goes to the end."""
    return re.sub(r"<!--.*?(?:-->|\Z)", "", s, flags=re.S)


def destination(raw: str) -> str:
    """A link's target without angle brackets and title."""
    s = re.sub(r"^<([^>]*)>.*", r"\1", raw.strip(L.BLANKS), flags=re.S)
    return re.split(" [\"']", s, maxsplit=1)[0].strip(L.BLANKS)


_INLINE = re.compile(
    r"`(?P<code>[^`]*)`|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)]*)\)|\[(?P<text>[^\]]*)\]\((?P<dest>[^)]*)\)"
    r"|(?<![^\W_])(?:\*\*(?P<s1>(?:(?!\*\*).)*)\*\*|__(?P<s2>(?:(?!__).)*)__|(?P<mark>[*_])(?P<em>(?:(?!(?P=mark)).)*)(?P=mark)(?!(?P=mark)))",
    re.S,
)


def inline(raw: str, picture: Callable[[str], str | None] = lambda path: None) -> str:
    """Code, pictures, links, strong and emphasised words of a line; ``picture`` gives the place of a file."""
    if not any(c in raw for c in "`[*_") and "<!--" not in raw:
        return escape(raw)
    source, out, at = without_comments(raw), [], 0
    for m in _INLINE.finditer(source):
        out.append(escape(source[at : m.start()]))
        at = m.end()
        if m["code"] is not None:
            out.append(f"<code>{escape(m['code'])}</code>")
        elif m["src"] is not None:
            path = destination(m["src"])
            web = path.startswith(("http://", "https://"))
            place = path if web else None if path.startswith("data:") else picture(path)
            out.append(f'<img src="{escape(place if web else "../" + place)}" alt="{escape(m["alt"])}"/>' if place else "")
        elif m["dest"] is not None:
            path = destination(m["dest"])
            label = escape(m["text"])
            out.append(f'<a href="{escape(path)}">{label}</a>' if path.startswith(("http://", "https://", "mailto:")) else label)
        elif m["em"] is not None:
            out.append(f"<em>{inline(m['em'], picture)}</em>")
        else:
            out.append(f"<strong>{inline(m['s1'] if m['s1'] is not None else m['s2'], picture)}</strong>")
    return "".join(out) + escape(source[at:])


def image_link(line: str) -> str | None:
    """alt|path of the picture that a line begins with; none for pictures that are held in the text."""
    m = re.match(r"!\[(.*?)\]\(([^)]*)\)", L.trim(line), re.S)
    path = m[2].partition(" ")[0].strip("\"' ") if m else ""
    return f"{m[1]}|{path}" if m and not path.startswith("data:") else None


def safe_path(path: str) -> str | None:
    """A relative path that stays below its folder; None for any other."""
    plain = unquote(path)
    return plain if path and not path.startswith(("/", "data:")) and ".." not in plain else None


def contents_entry(line: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"(.*?)\.{2,}\s*(\d{1,4})\s*", L.trim(line), re.S) if ".." in line else None
    title = L.trim(m[1]) if m else ""
    return (title, int(m[2])) if len(title) > 1 else None


def list_item(line: str) -> tuple[int, bool, str] | None:
    c = line.lstrip("\t ")[:1]
    m = re.fullmatch(r"( *)(?:([-*+])|\d{1,7}\.) (.*)", line.replace("\t", "    "), re.S) if c.isdecimal() or c in ("-", "*", "+") else None
    return (len(m[1]), m[2] is None, m[3]) if m else None


def rule(line: str) -> bool:
    t = L.trim(line)
    if t[:1] not in ("-", "*", "_"):
        return False
    t = t.replace(" ", "")
    return len(t) >= 3 and set(t) in ({"-"}, {"*"}, {"_"})


def outside(text: list[str]) -> list[bool]:
    """Lines outside fences, where a fence ends with the mark that it began with."""
    out, fence = [], ""
    for line in text:
        mark = L.trim(line)[:1] if L.is_fence(line) else ""
        out.append(not fence and not mark)
        fence = "" if mark and mark == fence else fence or mark
    return out


@dataclass
class Heading:
    line: int
    level: int
    title: str
    anchor: str


def front_matter(text: list[str], most: int = 40) -> int:
    """Lines of the block that the text begins with, 0 without one."""
    if not text or L.trim(text[0]) != "---":
        return 0
    return next((i + 1 for i in range(1, min(len(text), most + 1)) if L.trim(text[i]) == "---"), 0)


def slug(title: str, used: set[str]) -> str:
    """A name for a title, with -2, -3 and so on until it is not in ``used``, where it is put."""
    s = re.sub(r"[\W_]+", "-", title.lower()).strip("-")
    s = f"h-{s or 'section'}" if not s or s.startswith("xml") or s[0].isnumeric() else s
    name, n = s, 2
    while name in used:
        name, n = f"{s}-{n}", n + 1
    used.add(name)
    return name


def headings(text: list[str]) -> list[Heading]:
    used: set[str] = set()
    skip, free = front_matter(text), outside(text)
    found = [(i, L.level(x), L.trim(L.trim(x)[L.level(x) :])) for i, x in enumerate(text) if i >= skip and free[i] and L.level(x)]
    return [Heading(i, n, t, slug(t, used)) for i, n, t in found if t]


def _list(items: list[tuple[int, bool, str]]) -> str:
    """Nested lists of (indent, ordered, html) items."""
    out, open_ = "", []
    end = lambda ordered: "</li></ol>\n" if ordered else "</li></ul>\n"
    for indent, ordered, body in items:
        while open_ and (indent < open_[-1][0] or (indent == open_[-1][0] and ordered != open_[-1][1])):
            out += end(open_.pop()[1])
        if not open_ or indent > open_[-1][0]:
            open_.append((indent, ordered))
            out += "<ol>\n" if ordered else "<ul>\n"
        else:
            out += "</li>\n"
        out += f"<li>{body}"
    return out + "".join(end(o) for _, o in reversed(open_))


def xhtml(text: list[str], *, known: list[Heading] | None = None, free: list[bool] | None = None, pages: dict[int, str] | None = None, here: str = "", picture=lambda path: None, first: int = 0, last: int | None = None) -> str:  # noqa: ANN001
    """The body of the lines from ``first`` to ``last``: paragraphs, headings, lists, tables, code, rules,
    places of pages, and contents lines linked to their pages."""
    last = len(text) if last is None else last
    heads, free = {h.line: h for h in (headings(text) if known is None else known)}, outside(text) if free is None else free
    out: list[str] = []
    para: list[str] = []
    items: list[tuple[int, bool, str]] = []

    def close() -> None:
        body = inline(" ".join(para).strip(), picture) if para else ""
        out.append(f"<p>{body}</p>\n" if body else "")
        out.append(_list(items) if items else "")
        para.clear()
        items.clear()

    i = first
    while i < last:
        line, t = text[i], L.trim(text[i])
        i += 1
        if not free[i - 1]:
            close()
            end = next((k for k in range(i, last) if free[k]), last)
            code = [x for k, x in enumerate(text[i:end], i) if not (k == end - 1 and L.is_fence(x))]
            out.append(f"<pre><code>{escape(chr(10).join(code))}</code></pre>\n")
            i = end
        elif not t:
            close()
        elif t.startswith("<!--") and t.endswith("-->"):
            n = L.page_mark(t)
            out.append(f'<a id="page-{n}"></a>\n' if n else "")
        elif entry := contents_entry(t):
            close()
            label, target = f"{escape(entry[0])} · {entry[1]}", (pages or {}).get(entry[1])
            link = f"#page-{entry[1]}" if target == here else f"{target}#page-{entry[1]}"
            out.append(f'<p class="tocline"><a href="{escape(link)}">{label}</a></p>\n' if target else f'<p class="tocline">{label}</p>\n')
        elif i - 1 in heads:
            close()
            h = heads[i - 1]
            out.append(f'<h{h.level} id="{h.anchor}">{escape(h.title)}</h{h.level}>\n')
        elif rule(t):
            close()
            out.append("<hr/>\n")
        elif i < last and "|" in line and grids.separator(text[i]):
            close()
            end = next((k for k in range(i + 1, last) if "|" not in text[k]), last)
            head, *body = grids.compact([grids.cells(line), *map(grids.cells, text[i + 1 : end])])
            row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{inline(c, picture)}</{tag}>" for c in r) + "</tr>"
            out.append(f"<table>\n<thead>{row(head, 'th')}</thead>\n<tbody>\n" + "".join(row(r, "td") + "\n" for r in body) + "</tbody></table>\n")
            i = end
        elif item := list_item(line):
            if para:
                close()
            items.append((item[0], item[1], inline(item[2], picture)))
        else:
            if items:
                close()
            para.append(t)
    close()
    return "".join(out)


@dataclass
class Chapter:
    title: str
    file: str
    first: int
    last: int
    anchor: str | None = None


def chapters(text: list[str], heads: list[Heading], book: str) -> list[Chapter]:
    """Cut at the highest level of heading there is; what stands before, if it says anything, is the front matter."""
    top = min((h.level for h in heads), default=0)
    cuts = [h for h in heads if h.level == top]
    skip = front_matter(text)
    said = lambda a, b: any((t := L.trim(x)) and not (t.startswith("<!--") and t.endswith("-->")) for x in text[a:b])
    out = [("Front matter", skip, cuts[0].line, None)] if cuts and said(skip, cuts[0].line) else []
    ends = [h.line for h in cuts[1:]] + [len(text)] * bool(cuts)
    out += [(h.title, h.line, e, h.anchor) for h, e in zip(cuts, ends, strict=True)] or ([] if out else [(book, skip, len(text), None)])
    return [Chapter(t, f"text/ch{n:03d}.xhtml", a, b, anchor) for n, (t, a, b, anchor) in enumerate(out, 1)]


def navigation(heads: list[Heading], parts: list[Chapter]) -> str:
    """Nested lists of the headings with links to their chapters' files; front matter comes first."""
    lines = [h.line for h in heads]
    file_of = {h.line: c.file for c in parts for h in heads[bisect_left(lines, c.first) : bisect_left(lines, c.last)]}
    out, open_ = "<ol>", []
    if parts and parts[0].anchor is None and not any(parts[0].first <= h.line < parts[0].last for h in heads):
        out += f'<li><a href="{escape(parts[0].file)}">{escape(parts[0].title)}</a></li>'
    for h in heads:
        if h.line not in file_of:
            continue
        while open_ and open_[-1] >= h.level:
            open_.pop()
            out += "</li></ol>" if open_ else "</li>"
        out += ("<ol>" if open_ else "") + f'<li><a href="{escape(file_of[h.line])}#{h.anchor}">{escape(h.title)}</a>'
        open_.append(h.level)
    return out + "".join("</li></ol>" if k else "</li>" for k in range(len(open_) - 1, -1, -1)) + "</ol>"


def page_files(text: list[str], parts: list[Chapter]) -> dict[int, str]:
    """The chapter file that each printed page begins in; the first mark of a page holds."""
    out: dict[int, str] = {}
    for c in parts:
        for line in text[c.first : c.last]:
            if (n := L.page_mark(line)) is not None:
                out.setdefault(n, c.file.rpartition("/")[2])
    return out


def _document(title: str, body: str, style: str = "../style.css") -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="en" lang="en">\n<head>\n<title>{escape(title)}</title>\n<link rel="stylesheet" type="text/css" href="{style}"/>\n</head>\n<body>\n{body}</body>\n</html>\n'


def epub(text: list[str], title: str, uid: str, *, lang: str = "en", pictures: dict[str, bytes] | None = None) -> bytes:
    """A book as an EPUB file. ``pictures`` are its files by relative path; paths that leave the folder, and
    pictures that are not there, are left out."""
    heads, have = headings(text), pictures or {}
    parts = chapters(text, heads, title)
    where, names, stored = page_files(text, parts), {}, []

    def picture(path: str) -> str | None:
        plain = safe_path(path)
        if plain is None or plain not in have:
            return None
        if plain not in names:
            base, _, kind = plain.rpartition("/")[2].rpartition(".")
            base = base if base.isascii() and base.isprintable() and base and " " not in base else f"figure-{len(names) + 1:03d}"
            kind = kind.lower() if kind.isascii() and kind.isalnum() else "bin"
            taken, n, name = {x.lower() for x in names.values()}, 2, f"images/{base}.{kind}"
            while name.lower() in taken:
                name, n = f"images/{base}-{n}.{kind}", n + 1
            names[plain] = name
            stored.append((f"OEBPS/{name}", have[plain]))
        return names[plain]

    free, lines = outside(text), [h.line for h in heads]  # a chapter looks at its own lines alone
    own = lambda c: heads[bisect_left(lines, c.first) : bisect_left(lines, c.last)]
    files = [(f"OEBPS/{c.file}", _document(c.title, xhtml(text, known=own(c), free=free, pages=where, here=c.file.rpartition("/")[2], picture=picture, first=c.first, last=c.last)).encode()) for c in parts]
    items = "\n".join(f'<item id="c{n}" href="{c.file}" media-type="application/xhtml+xml"/>' for n, c in enumerate(parts, 1))
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
    items += "".join(f'\n<item id="img-{n}" href="{x}" media-type="{kinds.get(x.rpartition(".")[2], "application/octet-stream")}"/>' for n, x in enumerate(names.values(), 1))
    spine = "".join(f'<itemref idref="c{n}"/>' for n in range(1, len(parts) + 1))
    package = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n'
        f'<dc:identifier id="uid">{escape(uid)}</dc:identifier>\n<dc:title>{escape(title)}</dc:title>\n<dc:language>{escape(lang)}</dc:language>\n</metadata>\n<manifest>\n'
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n<item id="css" href="style.css" media-type="text/css"/>\n{items}\n</manifest>\n<spine>\n{spine}\n</spine>\n</package>\n'
    )
    container = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n<rootfiles>\n<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>\n</rootfiles>\n</container>\n'
    nav = _document(title, f'<nav epub:type="toc" id="toc">\n<h1>{escape(title)}</h1>\n{navigation(heads, parts)}\n</nav>\n', "style.css")
    head = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container.encode()), ("OEBPS/content.opf", package.encode()), ("OEBPS/nav.xhtml", nav.encode()), ("OEBPS/style.css", b"body { font-family: serif; }\n")]
    return stored_zip(head + files + stored)
