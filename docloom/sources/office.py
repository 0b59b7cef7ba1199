"""Office files, pictures and archives as bytes: members of a zip file, and their text."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What follows a member's closing tags in the text that it gives.
_BREAKS = re.compile("</(?:w:p|a:p|si)>")
_slide = re.compile(r"ppt/slides/slide([1-9][0-9]*)\.xml", re.A).fullmatch
PICTURES = {"jpg", "jpeg", "png", "gif", "tif", "tiff", "webp"}
TEXTS = {"md", "markdown", "txt", "json", "xml", "rtf"}


def xml_text(xml: str) -> str:
    """Text of a document part: paragraph and shared string ends are line ends, tags go."""
    t = re.sub("<[^>]+>", "", _BREAKS.sub("\n", xml))
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    return re.sub(r"[ \t]+\n", "\n", t).strip()


def _read(z: zipfile.ZipFile, name: str) -> str | None:
    try:
        return z.read(name).decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile, EOFError, zlib.error, ValueError):
        return None


def member(data: bytes, name: str) -> str | None:
    """A member of a zip file as text; None where there is no such member or no zip file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return _read(z, name)
    except (zipfile.BadZipFile, EOFError, zlib.error, ValueError):
        return None


def document_text(data: bytes) -> str | None:
    xml = member(data, "word/document.xml")
    return None if xml is None else xml_text(xml)


def shared_strings(data: bytes) -> str | None:
    """The shared strings of a workbook, a line each; its numbers and its grid are not in them."""
    xml = member(data, "xl/sharedStrings.xml")
    return None if xml is None else xml_text(xml)


def slides(data: bytes) -> str | None:
    """All slides that are there, in order of their numbers, each under its heading; without the first slide none."""
    parts: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in sorted({int(m[1]) for x in z.namelist() if (m := _slide(x))}):
                xml = _read(z, f"ppt/slides/slide{n}.xml")
                if not xml and n == 1:
                    return None
                if n > 1 and not parts:
                    return None
                if xml:
                    parts += [f"## Slide {n}", "", xml_text(xml), ""]
    except (zipfile.BadZipFile, EOFError, zlib.error, ValueError):
        return None
    return "\n".join(parts) if parts else None


def picture_text(name: str, words: str) -> str:
    """A picture's name as heading, and the words that were read in it."""
    return "\n".join([f"# {name}", "", words or "*No words found in this picture.*", ""])


def converted(name: str, data: bytes, words: str = "") -> str | None:
    """Markdown of a file by its kind; None for kinds that are not read here or cannot be opened."""
    stem, _, kind = name.rpartition("/")[2].rpartition(".")
    kind = kind.lower()
    if kind in TEXTS:
        return data.decode("utf-8", "replace")
    if kind in PICTURES:
        return picture_text(stem, words)
    read = {"docx": document_text, "pptx": slides, "xlsx": shared_strings, "xls": shared_strings}.get(kind)
    return read(data) if read else None


def fingerprint(data: bytes) -> int:
    """A picture's fingerprint: its length, its first 48 and, over 80, its last 16 bytes, folded by 31 in 64 bits."""
    h = len(data) * 16_777_619  # fixed value
    for b in data[:48] + (data[-16:] if len(data) > 80 else b""):
        h = (h * 31 + b) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def stored_zip(files: list[tuple[str, bytes]]) -> bytes:
    """A zip file of stored members in their order, with the same bytes at each run."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) by their kinds; a file that cannot be read has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a file at a time, as one may be large
                path, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                text = converted(path, data) if path is not None and data is not None else None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


#: How many sample files a task holds at once.
FILES = 16


def sample(kind: str):  # noqa: ANN201
    """A function on Columns that makes an Office file of a text, for queries without files of their own."""

    def made(text: str) -> bytes:
        esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        paras = text.split("\n")
        if kind == "docx":
            return stored_zip([("word/document.xml", ("<w:document><w:body>" + "".join(f"<w:p><w:r><w:t>{esc(p)}</w:t></w:r></w:p>" for p in paras) + "</w:body></w:document>").encode())])
        if kind == "xlsx":
            return stored_zip([("xl/sharedStrings.xml", ("<sst>" + "".join(f"<si><t>{esc(p)}</t></si>" for p in paras) + "</sst>").encode())])
        return stored_zip([(f"ppt/slides/slide{n}.xml", f"<p:sld><a:p><a:t>{esc(p)}</a:t></a:p></p:sld>".encode()) for n, p in enumerate(paras, 1)])

    def files(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            for k in range(0, len(a), FILES):
                yield pa.array([None if x is None else made(x) for x in a.slice(k, FILES).to_pylist()], pa.binary())

    from pyspark.sql import functions as F

    return F.arrow_udf(files, "binary")
