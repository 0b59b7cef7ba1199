"""Queries of what the passes are made of, and of sources and sinks around them.

As in ``queries_passes``, most have no SQL; ``tests/test_passes.py`` holds them against cases.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passes import ask, figures, grids, markup, metadata, stitch, tidy, translation
from .passes import lines as L
from .passes.spark import rows_of
from .plans import search
from .queries_passes import KNOWN, _book, _docs, _front, _listed, _marks, _outline
from .queries_shelf import asked_sql, parsed
from .sources import office

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _of(name: str, rows: Callable[[str], list[tuple]], schema: str, source=_book) -> None:  # noqa: ANN001
    QUERIES[name] = lambda s, d: rows_of(source(s, d), rows, schema, "text")


def _one(name: str, value: Callable[[str], object], kind: str = "string", source=_book) -> None:  # noqa: ANN001
    _of(name, lambda t: [(value(t),)], f"value {kind}", source)


_cut = lambda t: t.split("\n")
_json = lambda x: json.dumps(x, ensure_ascii=False)

# The search language: tokens and trees of the cases of its grammar.
_tokens = ["a b", "a OR b c", "a b NOT c", "( a OR b ) NOT c", "a and b", "a AND", "a )", "", "( a OR b", "low-speed", "- ( a )", "NOT"]
_trees = ["(and a b)", "(or a (and b c))", "(and a b (not c))", "(and (or a b) (not c))", "(and a and b)", "a", "a)", '""', "(or a b)", "low-speed", "(and - a)", "NOT"]


def _tree(n: search.Node | None) -> str:
    return "" if n is None else n.text if n.kind == "term" else f"({n.kind} {' '.join(map(_tree, n.parts))})"


QUERIES["g01_tokens"] = parsed("tokens", "string", lambda q: " ".join(v if k == "term" else k for k, v in search._tokens(q)))
ORACLE_SQL["g01_tokens"] = asked_sql(_tokens, "tokens")
QUERIES["g02_trees"] = parsed("tree", "string", lambda q: _tree(search.parse(q)))
ORACLE_SQL["g02_trees"] = asked_sql(_trees, "tree")

# Sources.
_one("a17_first_engine", lambda t: next((x for x in (office.document_text(t.encode()), office.member(t.encode(), "a"), t[:50]) if x), None), source=_docs)
_of("a20_outline_walk", lambda t: _listed(stitch.walked([{"title": m.title, "page": m.page, "children": [{"title": m.title + " a"}, {"title": " "}]} for m in _marks(t)])), _outline)
_one("a32_catalog_lookup", lambda t: _json(vars(r)) if (r := metadata.looked_up(t[:20], [{"title": t[:20].upper() + "!", "author_name": ["A"], "publisher": ["P", "Q"], "subject": list("abcdefghijklmnop"), "first_publish_year": 2001}, {"title": "Other"}])) else None, source=_docs)
_one("a34_pdf_info", lambda t: _json(vars(metadata.pdf_info(b"%PDF /Title (" + re.sub(r"[()\\]", "", t[:30]).encode("latin-1", "replace") + b") /Author (A; B) /CreationDate (D:20240131)"))), source=_docs)
_one("b11_clip_notes", lambda t: ask.note("Notes", [ask.clip(p, "C", "Book", "3") for p in t.split("\n")[:3]]), source=_docs)
_one("e12_woven_tables", lambda t: "\n".join(grids.woven(_cut(t), [(x[:20], [[["a", "b"], ["c", "d"]]]) for x in _cut(t)[:3]])), source=_docs)

# Outlines.
_of("s25_heading_and_title_lines", lambda t: stitch.heading_and_title_lines([m.title for m in _marks(t)], _cut(t)), "title string, heading int, line int")
_of("s60_counterparts", lambda t: [(s[3], other[c][3] if (c := stitch.counterpart(own, k, other)) is not None else None) for own in [stitch.sections(_cut(t))] for other in [stitch.sections(_cut(t)[9:])] for k, s in enumerate(own)], "title string, other string")

# Cleanup.
_one("s01_page_loop", lambda t: tidy.tidied(t, tidy.pages_of(t), most=3))
_of("s02_cleaned_lines", lambda t: [(i, x.strip()) for i, x in enumerate(re.split("\r\n|\r|\n", t)) if x.strip() and not tidy.frame_line(x)], "line_no int, text string")
_of("s06_remembered_titles", lambda t: [(i, L.folded(h), L.core(L.folded(h))) for i, x in enumerate(_cut(t)) if (h := L.heading(x))], "line_no int, folded string, core string")
_of("s12_stolen_headings", lambda t: [j for j in [stitch._stolen(_cut(t + "\n## One\n# Two\n\n## One\nb\nc\nd\ne\nf\n# Two\ng"))] if j], "source int, target int")
_of("s22_margin_keys", lambda t: [(i, re.sub("[0-9]+", "#", " ".join(x.lower().split())), L.lone_number(x)) for i, x in enumerate(_cut(t)[:2] + _cut(t)[-2:])], "place int, key string, number boolean")
_one("s48_numbers_removed", lambda t: tidy.reopened(t, (tidy.hidden_numbers,)))

# Records.
_of("s27_block_spans", lambda t: [(markup.front_matter(_cut(t)), t.count("\n"))], "past int, newlines int", _front)
_one("s30_assigned_keys", lambda t: _json(vars(metadata.parsed(_cut(t)[1:8]))), source=_front)
_one("s32_plain_lines", lambda t: "\n".join(map(metadata.plain, _cut(t))))
_one("s33_catalog_records", lambda t: _json(vars(metadata.from_catalog({"title": t[:20], "subject": t.split()[:20], "publisher": [], "isbn": ["x", "978-0-306-40615-7"]}))), source=_docs)
_one("s57_resolved_titles", lambda t: metadata.resolved_title(t[:25], t, "My_Book_2019.pdf"), source=_docs)

# Packages.
_one("s36_picture_names", lambda t: _json(sorted(x for x in zipfile.ZipFile(io.BytesIO(markup.epub(_cut(t), "B", "urn:x", pictures={"figures/figure-001.png": b"x" * 40}))).namelist() if "images" in x)))
_of("s37_chapter_files", lambda t: [(c.file, c.title, c.first, c.last) for own in [_cut(t)] for c in markup.chapters(own, markup.headings(own), "Book")], "file string, title string, first int, past int")
_one("s40_page_headings", lambda t: ask.paged_markdown("Book", t.split("\n\n")).count("## "), "int")

# Translation and answers.
_of("s38_heading_blocks", lambda t: [(b.prefix, b.body) for b in translation.blocks(t) if b.prefix], "prefix string, body string")
_one("s39_translated", lambda t: "\n".join(translation.rendered(translation.blocks(t), [y for x in translation.batches([b.body for b in translation.blocks(t) if b.text]) for y in x])))
_one("s42_mended_replies", lambda t: ask.mended('{"a": ' + json.dumps(t[:20])), source=_docs)
_one("s43_working_notes", lambda t: ask.working(t[:40], t[40:80]), source=_docs)
_of("s44_page_tokens", lambda t: [(i, p) for i, x in enumerate(_cut(t)) if (p := ask.page_token(x))], "line_no int, page string")
_of("s52_scrubbed_summaries", lambda t: [(re.sub("/Users/[^/]+", "/Users/<user>", f"/Users/{t[:5].strip()}/x: {t[:20]}"),)], "summary string", _docs)
_one("s65_chapter_texts", lambda t: ask.chapter_text(t, 2))
_of("o03_pages_near", lambda t: [(k, ask.page_near(_cut(t), k)) for k in range(0, len(t), 400)], "at int, page string")
_one("o04_selections", lambda t: ask.selection(_cut(t), 5, min(len(t), 300)))
_one("o01_cited_clips", lambda t: ask.clip(t, L.heading(_cut(t)[0]) or "", "Book", ask.page_near(_cut(t), len(t) // 2) or ""))
_one("d37_edited_map", lambda t: _json(tidy.tidy_headings(_cut(t)).where[:50]))
