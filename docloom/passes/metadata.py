"""Records of books: front matter, copyright pages, file names, XMP packets and catalog answers."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field, fields

from . import lines as L
from .markup import front_matter


@dataclass
class Record:
    title: str = ""
    authors: list[str] = field(default_factory=list)
    publisher: str = ""
    date: str = ""
    rights: str = ""
    summary: str = ""
    subjects: list[str] = field(default_factory=list)
    lang: str = ""
    isbn: str = ""
    source_name: str = ""
    created: str = ""
    pdf_creator: str = ""
    pdf_producer: str = ""

    def fill(self, other: Record) -> Record:
        """Fields that are empty here from another record."""
        for f in fields(self):
            if not getattr(self, f.name):
                setattr(self, f.name, getattr(other, f.name))
        return self


def valid_isbn(raw: str) -> str | None:
    """Digits of a right ISBN of ten or thirteen places."""
    t = re.sub("[^0-9X]", "", raw.upper())
    if re.fullmatch("[0-9]{13}", t) and sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(t)) % 10 == 0:
        return t
    if re.fullmatch("[0-9]{9}[0-9X]", t) and sum((10 if c == "X" else int(c)) * (10 - k) for k, c in enumerate(t)) % 11 == 0:
        return t
    return None


def clean(raw: str | None) -> str:
    return " ".join((raw or "").split())


def names(raw: str | None) -> list[str]:
    return [n for x in (raw or "").split(";") if (n := clean(x))]


def keywords(raw: str | None) -> list[str]:
    return [n for x in re.split("[,;]", raw or "") if (n := clean(x))]


def unquoted(raw: str) -> str:
    t = L.trim(raw)
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1].replace('\\"', '"').replace("\\'", "'").replace("\\\\", "\\")
    return t


# Keys of front matter and the fields that they fill.
KEYS = {
    "title": "title", "author": "authors", "authors": "authors", "publisher": "publisher", "date": "date", "rights": "rights", "description": "summary", "subject": "subjects",
    "subjects": "subjects", "lang": "lang", "language": "lang", "source": "source_name", "created": "created", "pdf-creator": "pdf_creator", "pdf-producer": "pdf_producer", "isbn": "isbn",
}


def parsed(block: list[str]) -> Record:
    """A record from lines of front matter: scalars, lists of items, and an identifier's text. The first
    value of a field holds; keys that are not known are passed over."""
    record, key = Record(), ""
    for line in block:
        t = L.trim(line)
        indented = line[:1] in " \t" or t.startswith("- ")
        m = re.fullmatch(r"([A-Za-z][\w-]*):\s*(.*)", t)
        if not indented and m:
            key = m[1].lower()
            _put(record, key, m[2])
        elif t.startswith("- ") and key == "identifier":
            _put(record, "isbn", t.partition("text:")[2])
        elif t.startswith("- "):
            _put(record, key, t[2:], listed=True)
        elif m and key == "identifier" and m[1] == "text":
            _put(record, "isbn", m[2])
    record.isbn = valid_isbn(record.isbn) or ""
    return record


def _put(record: Record, key: str, raw: str, listed: bool = False) -> None:
    name, value = KEYS.get(key), clean(unquoted(raw))
    if not name or not value:
        return
    now = getattr(record, name)
    if isinstance(now, list):
        if listed or not now:
            now += [value] if listed else (names(value) if name == "authors" else keywords(value))
    elif not now:
        setattr(record, name, value)


def peeled(text: str) -> tuple[str, str, Record | None]:
    """(front matter with a blank line below it, body, record) of a text."""
    own = text.split("\n")
    n = front_matter(own)
    if not n:
        return "", text, None
    m = n + (n < len(own) and not L.trim(own[n]))
    return "\n".join(own[:m]) + "\n", "\n".join(own[m:]), parsed(own[1 : n - 1])


def plain(line: str) -> str:
    """A line without heading marks and the stars round all of it."""
    t = L.trim(line)
    if L.level(t):
        t = L.trim(t[L.level(t) :])
    return L.trim(t[2:-2]) if len(t) > 4 and t.startswith("**") and t.endswith("**") else t


def opening(text: str) -> list[str]:
    """Lines that are not blank of the first two marked pages, 160 at most; the first 80 where none is marked."""
    kept, pages = [], 0
    for line in text.split("\n"):
        t = L.trim(line)
        if t.startswith("<!-- page ") and t.endswith("-->"):
            pages += 1
        elif t:
            kept.append(line)
        if pages > 2 or len(kept) >= (160 if pages else 80):
            break
    return kept


def title_sample(text: str) -> str:
    """What a title is read from: the opening, or the first 4,000 characters where it is short; 6,000 at most."""
    said = "\n".join(opening(text))
    return (said if len(said) >= 400 else max(said, text[:4000], key=len))[:6000]


def copyright_line(text: str) -> tuple[str, str, str] | None:
    """(rights, year, author) of a copyright line."""
    m = re.fullmatch(r"(?i)copyright\b(?:\s*(?:©|\(c\)))?\s*[, ]*\s*(\d{4})?(?:\s+by\s+(.+))?", text)
    if not m:
        return None
    author = (m[2] or "").strip(" .")
    author = author if len(author) >= 2 else ""
    return "Copyright" + (f" © {m[1]}" if m[1] else "") + (f" by {author}" if author else ""), m[1] or "", author


def published_by(text: str) -> str | None:
    m = re.fullmatch(r"(?i)published by\s+(.{2,80})", text)
    name = m[1].strip(" .") if m else ""
    return name if len(name) >= 2 else None


def _same(a: str, b: str) -> bool:
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c))
    return bare(a) == bare(b)


def from_copyright(text: str) -> Record:
    """A record from the short lines of a book's copyright page. A book that its author published has the
    house of the next line, if that looks like one."""
    record, said = Record(), [plain(x) for x in opening(text)]
    for t, after in zip(said, [*said[1:], ""], strict=True):
        if not t or len(t) > 140 or len(t.split()) > 18:
            continue
        if hit := copyright_line(t):
            record.fill(Record(rights=hit[0], date=hit[1], authors=[hit[2]] if hit[2] else []))
        if name := published_by(t):
            house = 2 <= len(after) <= 80 and 1 <= len(after.split()) <= 6 and ". " not in after and not after.lower().startswith(("copyright", "isbn", "published"))
            record.fill(Record(publisher=after if record.authors and _same(name, record.authors[0]) and house else name))
        if m := re.fullmatch(r"(?i)isbn(?:-1[03])?\s*[:#]?\s*([0-9x][0-9x \-]{8,22})", t):
            record.fill(Record(isbn=valid_isbn(m[1]) or ""))
    return record


def title_of_file(name: str) -> str:
    """A title from a file name: years and versions among its last three words go."""
    tokens = [t for t in re.split(r"[_\-\s]+", name.rpartition("/")[2].rpartition(".")[0] or name.rpartition("/")[2]) if t]
    said = " ".join(t for k, t in enumerate(tokens) if k < len(tokens) - 3 or not re.fullmatch(r"(?:19|20)\d\d|[vV]\d+", t))
    return said if len(said) >= 2 else "Untitled"


# Titles that say nothing.
BANNED = {"unknown", "untitled", "n/a", "none", "title", "not found"}


def accepted_title(raw: str, opening: str) -> str | None:
    """A proposed title, if half of its longer words stand in the opening; without such words, all of it."""
    t = re.split("[\n\r]", raw.strip())[0].strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1].strip()
    t = re.sub("(?i)^title:", "", t).strip().strip("#*` ")
    said = t.split()
    if not 2 <= len(t) <= 140 or t.strip(". ").lower() in BANNED or not 1 <= len(said) <= 16 or (t.endswith(".") and len(said) > 6):
        return None
    long = [w for x in said if len(w := re.sub(r"^[^\w]+|[^\w]+$", "", x)) >= 4]
    low = opening.lower()
    hits = sum(w.lower() in low for w in long)
    return t if (hits * 2 >= len(long) if long else t.lower() in low) else None


def with_title(title: str, block: str) -> str:
    """Front matter with this title, in place of the one it has or as its first field."""
    own, t = block.split("\n"), title.strip()
    if not t:
        return block
    line = 'title: "' + re.sub("\r\n|[\r\n]", " ", t).replace("\\", "\\\\").replace('"', '\\"') + '"'
    at = next((i for i, x in enumerate(own) if L.trim(x).lower().startswith("title:")), None)
    return "\n".join(own[:1] + [line] + own[1:] if at is None else own[:at] + [line] + own[at + 1 :])


def with_author(name: str, block: str) -> str:
    """Front matter with an author below the title, if it has none."""
    own, n = block.split("\n"), name.strip()
    if not n or any(L.trim(x).lower().startswith("author:") for x in own):
        return block
    at = next((i for i, x in enumerate(own) if L.trim(x).lower().startswith("title:")), 0) + 1
    return "\n".join(own[:at] + ["author:", '  - "' + n.replace("\\", "\\\\").replace('"', '\\"') + '"'] + own[at:])


def xmp_packet(data: bytes) -> str | None:
    """The XMP packet of a file's bytes, if there is one."""
    start = data.find(b"<x:xmpmeta")
    end = data.find(b"</x:xmpmeta>", start) if start >= 0 else -1
    return data[start : end + 12].decode("utf-8", "replace") if end >= 0 else None


def from_xmp(packet: str) -> Record:
    """A record from the Dublin Core and PDF elements of an XMP packet, lists item by item."""

    def values(tag: str) -> list[str]:
        m = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", packet, re.S)
        items = re.findall(r"<rdf:li\b[^>]*>(.*?)</rdf:li>", m[1], re.S) if m else []
        return [v for x in (items or ([m[1]] if m else [])) if (v := clean(html.unescape(re.sub("<[^>]+>", "", x))))]

    one = lambda tag: next(iter(values(tag)), "")
    return Record(
        one("dc:title"), values("dc:creator"), one("dc:publisher"), one("dc:date"), one("dc:rights"), one("dc:description"), values("dc:subject"), one("dc:language"),
        valid_isbn(one("prism:isbn") or one("dc:identifier")) or "", created=one("xmp:CreateDate")[:10], pdf_creator=one("xmp:CreatorTool"), pdf_producer=one("pdf:Producer"),
    )


def pdf_info(data: bytes) -> Record:
    """A record from the information dictionary of a PDF file, where its strings are plain."""
    found = {k.decode(): re.sub(rb"\\([()\\])", rb"\1", v).decode("latin-1") for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate)\s*\(((?:\\.|[^()\\])*)\)", data)}
    day = re.match(r"D:(\d{4})(\d\d)(\d\d)", found.get("CreationDate", ""))
    return Record(
        clean(found.get("Title")), names(found.get("Author")), summary=clean(found.get("Subject")), subjects=keywords(found.get("Keywords")), pdf_creator=clean(found.get("Creator")),
        pdf_producer=clean(found.get("Producer")), created="-".join(day.groups()) if day else "",
    )


def normal_title(title: str) -> str:
    return " ".join(re.sub(r"[^\w\s]|_", "", title.lower()).split())


def from_catalog(answer: dict, year: str = "first_publish_year") -> Record:
    """A record from a catalog's answer: the first publisher, twelve subjects at most."""
    one = lambda k: clean(str(next(iter(v), "") if isinstance(v := answer.get(k, ""), list) else v or ""))
    many = lambda k: [clean(str(x)) for x in answer.get(k) or [] if clean(str(x))]
    return Record(one("title"), many("author_name"), one("publisher"), one(year)[:4], lang=one("language"), subjects=many("subject")[:12], isbn=next((n for x in many("isbn") if (n := valid_isbn(x))), ""))


def looked_up(title: str, answers: list[dict]) -> Record | None:
    """The one answer whose normalised title is that asked for; none where there are more, or none."""
    hits = [a for a in answers if normal_title(str(a.get("title", ""))) == normal_title(title)]
    return from_catalog(hits[0]) if len(hits) == 1 else None


def resolved_title(reply: str, opening: str, name: str) -> str:
    """An accepted title, else one from the file name."""
    return accepted_title(reply, opening) or title_of_file(name)
