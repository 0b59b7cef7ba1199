"""Queries of the passes that look at a document's lines one after another.

SQL has no form for most of them: ``tests/test_passes.py`` holds them against cases and plain versions.
They run over whole texts of all documents, in one scan without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passes import ask, figures, grids, markup, metadata, stitch, tidy, translation
from .passes import lines as L
from .passes.spark import mapped, rewritten, rows_of
from .sources import office
from .sources import relations as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A book in Markdown from each document: every line in one of 40 forms, all of the text in it.
BOOK = """array_join(transform(split(text, '\n'), (x, i) -> case (doc_id * 7 + i) % 40
 when 0 then concat('# ', i + 1, ' ', left(x, 40), '\n', x) when 1 then concat('<!-- page ', i % 6 + 1, ' -->\nReader Notes ', doc_id % 5, '\n\n', x) when 2 then concat('IV\n', x)
 when 3 then concat(x, ' king-\ndom of ', x) when 4 then concat('T\nhe ', x) when 5 then concat('| a |  | b |\n| --- | --- | --- |\n| ', i, ' |  | x |\n| y |  | z |\n\n', x)
 when 6 then concat('## Page ', i % 9 + 1, '\n', x) when 7 then concat(i % 100, '\n', x) when 8 then concat('```\n', x, '\n# no heading\n```') when 9 then concat(x, '\n\n\n\nand so on')
 when 10 then concat('8.', i, ' Controls and Indicators\n', x) when 11 then concat('1 Engine Fire Switches\n', x) when 12 then concat('## Y O U R G I F T\n', x) when 13 then concat('![Figure 1](figures/figure-001.png)\n', x)
 when 14 then concat('## Corrupted and\n\nWhy It Is\n', x) when 15 then concat(left(x, 60), '\ufffd   ', x) when 16 then concat('- ', x, '\n- [site](https://example.org/a) and *em* **strong** `code`') when 17 then concat('Chapter One ........ ', i, '\n', x)
 when 18 then concat('www.example.org\n', x) when 19 then concat('<!-- page ', i % 6 + 1, ' -->\n\n', x) when 20 then concat('### John 3:16\n', x) when 21 then concat('Shifting from One to Two\n\nAnd ', x)
 when 22 then concat('Wh en it came, ', x) when 24 then concat('* * *\n> 12 bookmarks taken from the PDF\n\n', x)
 when 25 then concat('name kind place\n\n| name | kind |\n| --- | --- |\n| one a | two b |\n| three c | four d |\n| five e | six f |\n| seven g | eight h |\n\nname kind one two a b three four c d five six e f seven g eight h\n', x) when 23 then concat('Why Life Is Not Working—and Why\n## Another Way\n\nAnother four words say it. ', x) else x end), '\n')"""


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _book(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("text is not null").select("doc_id", F.expr(BOOK).alias("text"))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = query


#: Words that a split word may be: the most frequent of the corpus's, and these.
KNOWN = frozenset("when many in to it came the and of a an is was that he she they we you not for with on at by from as".split())

# Cleanup.
for _name, _passes in {
    "d01_readable_text": (tidy.readable,), "d03_drop_cap_text": (tidy.drop_caps,), "d04_whole_words": (lambda x: tidy.whole_words(x, KNOWN),),
    "d07_without_chrome": (tidy.without_chrome,), "d20_heading_layout": (tidy.heading_layout,),
    "d23_long_lines": (tidy.long_lines,), "d26_tidy_headings": (tidy.tidy_headings,),
    "d28_chapter_ornaments": (tidy.chapter_ornaments,), "d29_demoted_headings": (tidy.demoted,), "d30_moved_headings": (stitch.moved_headings,), "d33_hidden_numbers": (tidy.hidden_numbers,),
    "e01_compacted_tables": (grids.compacted,), "e05_lifted_prose": (lambda x: L.Rewrite(grids.lifted(x), list(range(len(x)))),),
}.items():
    _add(_name, lambda s, d, passes=_passes: rewritten(_book(s, d), *passes))
REOPEN = (tidy.repeated_marks, tidy.without_chrome, lambda x: tidy.whole_words(x, KNOWN), tidy.heading_layout, tidy.tidy_headings, stitch.moved_headings, tidy.hidden_numbers, tidy.blank_runs, grids.compacted, tidy.subheadings, tidy.long_lines)
_add("d38_reopened", lambda s, d: rows_of(_book(s, d), lambda t: [(tidy.reopened(t, REOPEN),)], "text string", "text"))
_add("d36_reopened_map", lambda s, d: mapped(_book(s, d), *REOPEN))
_add("d15_rebuilt_pages", lambda s, d: rows_of(_book(s, d), lambda t: [(i, tidy.rebuilt(p, p.replace(". ", ".\n"))) for i, p in enumerate(tidy.pages_of(t))], "page int, text string", "text"))
_add("d19_tidied", lambda s, d: rows_of(_book(s, d), lambda t: [(tidy.tidied(t, tidy.pages_of(t)),)], "text string", "text"))
_add("c10_split_pages", lambda s, d: rows_of(_book(s, d).withColumn("text", F.expr("if(doc_id % 3 = 0, replace(text, '\n\n', '\f'), text)")), lambda t: list(enumerate(tidy.pages_of(t))), "page int, text string", "text"))
_add("d14_unglued_lines", lambda s, d: rows_of(_docs(s, d), lambda t: [(i, p) for i, x in enumerate(t.split("\n")) for p in tidy.unglued(f"Page: {i} Date: today {x}")], "line_no int, part string", "text"))


def _each_line(of: Callable[[str, int, list[str]], object], kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A rule on the lines of the books, where it gives a value that says something."""

    def rows(t: str) -> list[tuple]:
        own = t.split("\n")
        return [(i, v) for i, x in enumerate(own) if (v := of(x, i, own)) not in (None, False, "", 0)]

    return lambda s, d: rows_of(_book(s, d), rows, f"line_no int, value {kind}", "text")


_above = lambda i, own: L.trim(own[k]) if (k := L.last_said(own, i)) is not None else ""
_below = lambda i, own: L.trim(own[k]) if (k := L.next_said(own, i)) is not None else ""
for _name, (_of, _kind) in {
    "d09_without_footers": (lambda x, i, own: tidy.without_footers(x + "www.example.org", ["www.example.org"]), "string"), "d12_frame_lines": (lambda x, i, own: tidy.frame_line(x, {"reader notes 1"}), "boolean"),
    "d16_split_numbered_headings": (lambda x, i, own: "|".join(tidy.numbered_heading(x) or ()), "string"), "d22_continued_sentences": (lambda x, i, own: tidy.continues(L.trim(x), _below(i, own)), "boolean"),
   
    "d41b_accepted_lines": (lambda x, i, own: tidy.accepted(x, re.sub(r"\b(\w{2}) (\w{2})\b", r"\1\2", x)), "string"),
    "c08_image_links": (lambda x, i, own: markup.image_link(x), "string"), "c24_bold_runs": (lambda x, i, own: json.dumps(ask.bold_runs(x)) if "**" in x else None, "string"),
    "s05_drop_caps": (lambda x, i, own: tidy.cap_pieces(x), "string"),
    "s08_heading_echoes": (lambda x, i, own: tidy.echo(x, L.heading(_above(i, own)) or ""), "boolean"), "s08b_wrapped_titles": (lambda x, i, own: tidy.wrapped_title(x, L.heading(_below(i, own)) or ""), "boolean"),
    "s09_mark_counts": (lambda x, i, own: L.marks(x) * 10 + min(6, max(2, L.marks(x))), "int"), "s10_neighbour_lines": (lambda x, i, own: f"{_above(i, own)}|{_below(i, own)}", "string"),
    "s14_prose_lines": (lambda x, i, own: tidy.prose(x), "boolean"), "s14b_cuts": (lambda x, i, own: tidy.cut(x, 68, 98) if len(x) > 98 else None, "int"),
    "s16b_broken_words": (lambda x, i, own: i + 1 < len(own) and tidy.broken(x, own[i + 1]), "boolean"), "s17_page_headings": (lambda x, i, own: L.page_heading(x), "string"),
    "s18_cut_ends": (lambda x, i, own: grids.goes_on(x) * 2 + grids.ended(x), "int"), "s20_separators": (lambda x, i, own: grids.separator(x) if "|" in x else None, "boolean"),
    "s35_destinations": (lambda x, i, own: markup.safe_path(markup.destination(m[1])) if (m := re.search(r"\]\(([^)]*)\)", x)) else None, "string"),
    "s41_figure_numbers": (lambda x, i, own: figures.figure_number(figures.linked_name(x) or ""), "int"), "m20_inline": (lambda x, i, own: markup.inline(x, lambda p: f"images/{p}"), "string"),
    "g16_reader_breaks": (lambda x, i, own: ask.reader_break(x), "boolean"),
}.items():
    _add(_name, _each_line(_of, _kind))

# Tables.
_add("e03_tables", lambda s, d: rows_of(_book(s, d), lambda t: grids.tables(t.split("\n")), "first int, past int", "text"))
_add("e04_compact_tables", lambda s, d: rows_of(_book(s, d), lambda t: [(a, "\n".join(grids.written(grids.grid(own, a, b)))) for own in [t.split("\n")] for a, b in grids.tables(own)], "first int, text string", "text"))
_add("e06_table_echoes", lambda s, d: rows_of(_book(s, d), lambda t: [(i,) for own in [t.split("\n")] for i in sorted(grids.echoes(own, [(a, grids.grid(own, a, b)) for a, b in grids.tables(own)]))], "line_no int", "text"))
_add("e07_interleaved", lambda s, d: rows_of(_docs(s, d), lambda t: [(grids.interleaves(w, [w[::2], w[1::2]]), grids.interleaves(w, [w[1::2], w[::2]]))  for w in [t.split()]], "woven boolean, turned boolean", "text"))
_add("e09_table_html", lambda s, d: rows_of(_book(s, d), lambda t: [(a, grids.as_html(own, a, b)) for own in [t.split("\n")] for a, b in grids.tables(own)], "first int, html string", "text"))
_add("e10_selected_cells", lambda s, d: rows_of(_book(s, d), lambda t: [(a, "\n".join(grids.selected(own, a, b, {(0, 0), (1, 1)}))) for own in [t.split("\n")] for a, b in grids.tables(own)], "first int, text string", "text"))
_add("e11_extracted_grids", lambda s, d: rows_of(_docs(s, d), lambda t: [("\n".join(grids.extracted([x.split(" ")[:4] for x in t.split("\n")])),)], "text string", "text"))
_add("s19_plain_runs", lambda s, d: rows_of(_book(s, d), lambda t: [(r.start, r.stop) for r in grids.plain_runs(t.split("\n"))], "first int, past int", "text"))


# Outlines.
def _marks(t: str) -> list[stitch.Mark]:
    """An outline of the text's own headings, and some that it does not have."""
    heads = [h for x in t.split("\n") if (h := L.heading(x)) and not L.page_like(h)]
    return [stitch.Mark(h, 1 + k % 3, k % 5) for k, h in enumerate(heads)] + [stitch.Mark("Not there", 2, 1)]


_outline = "ord int, title string, level int, page int, line int"
_listed = lambda marks: [(k, m.title, m.level, m.page, m.line) for k, m in enumerate(marks)]
_add("f07_bookmark_lines", lambda s, d: rows_of(_book(s, d), lambda t: [(m.title, stitch.found(m, t.split("\n"))) for m in _marks(t)], "title string, line int", "text"))
_add("f20_navigation", lambda s, d: rows_of(_book(s, d), lambda t: [(markup.navigation(h, markup.chapters(own, h, "Book")),) for own in [t.split("\n")] for h in [markup.headings(own)]], "html string", "text"))
_add("f22_export_headings", lambda s, d: rows_of(_book(s, d), lambda t: [(h.line, h.level, h.title, h.anchor) for h in markup.headings(t.split("\n"))], "line_no int, level int, title string, anchor string", "text"))
_add("f24_page_files", lambda s, d: rows_of(_book(s, d), lambda t: sorted(markup.page_files(own, markup.chapters(own, markup.headings(own), "Book")).items()) if (own := t.split("\n")) else [], "page int, file string", "text"))
_add("f25_outline_part", lambda s, d: rows_of(_book(s, d), lambda t: _listed(stitch.part_of(_marks(t), 1)), _outline, "text"))
_add("f27_inferred_chapters", lambda s, d: rows_of(_docs(s, d), lambda t: [("\n".join(stitch.inferred(t.split("\n"), [(f"Chapter {k}", x[5:40]) for k, x in enumerate(t.split("\n"))])),)], "text string", "text"))
_add("f28_spliced_figures", lambda s, d: rows_of(_book(s, d), lambda t: [("\n".join(figures.spliced(t.split("\n"), [(1, "figures/a.png"), (3, "figures/b.png"), (99, "figures/c.png")])),)], "text string", "text"))
_add("c11_page_breaks", lambda s, d: rows_of(_docs(s, d), lambda t: [(stitch.page_breaks(t.replace(". ", ".\f")),)], "text string", "text"))
_add("a21_font_headings", lambda s, d: rows_of(_docs(s, d), lambda t: [(m.title, m.page) for m in stitch.font_headings([(i // 12, x[:80], 10.0 + 8 * (i % 12 == 3)) for i, x in enumerate(re.split(r"(?<=[.,]) ", t))])], "title string, page int", "text"))
_add("a30_outline_files", lambda s, d: rows_of(_book(s, d), lambda t: _listed(stitch.read(stitch.written(_marks(t)) if len(t) % 7 else "{broken")), _outline, "text"))
_add("b04_outline_json", lambda s, d: rows_of(_book(s, d), lambda t: [(stitch.written(_marks(t)[:-1]),)], "outline string", "text"))

# Translation.
_add("c16_blocks", lambda s, d: rows_of(_book(s, d), lambda t: [(k, b.text, b.prefix, b.body) for k, b in enumerate(translation.blocks(t))], "ord int, translated boolean, prefix string, body string", "text"))
_add("n01_below", lambda s, d: rows_of(_book(s, d), lambda t: [("\n".join(translation.rendered(b, [x.body.upper() for x in b if x.text])),) for b in [translation.blocks(t)]], "text string", "text"))
_add("n01b_replaced", lambda s, d: rows_of(_book(s, d), lambda t: [("\n".join(translation.rendered(b, [x.body.upper() for x in b if x.text], below=False)),) for b in [translation.blocks(t)]], "text string", "text"))
_add("n05_protected_links", lambda s, d: rows_of(_book(s, d), lambda t: [(p, len(links), translation.restored(p, links) == t) for p, links in [translation.protected(t)]], "text string, links int, same boolean", "text"))

# Records.
_FRONT = "concat('---\ntitle: \"', lang, ' book\"\nauthor:\n  - A. Name\n  - B. Name\nlanguage: ', lang, '\nidentifier:\n  - scheme: ISBN-13\n    text: \"978-0-306-40615-7\"\n---\n\nCopyright © 2001 by A. Name\nPublished by A. Name\nHouse Press\nISBN 978-0-306-40615-7\n', text)"
_front = lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.expr(_FRONT).alias("text"))
_fields = "title string, authors string, publisher string, date string, rights string, lang string, isbn string"
_record = lambda r: [(r.title, "; ".join(r.authors), r.publisher, r.date, r.rights, r.lang, r.isbn)]
_add("c19_front_matter", lambda s, d: rows_of(_front(s, d), lambda t: _record(metadata.peeled(t)[2]), _fields, "text"))
_add("c18_peeled_bodies", lambda s, d: rows_of(_front(s, d), lambda t: [metadata.peeled(t)[:2]], "front string, body string", "text"))
_add("m12_copyright_records", lambda s, d: rows_of(_front(s, d), lambda t: _record(metadata.from_copyright(metadata.peeled(t)[1])), _fields, "text"))
_add("m13_gathered_records", lambda s, d: rows_of(_front(s, d), lambda t: _record(metadata.Record(title="Given").fill(metadata.peeled(t)[2]).fill(metadata.from_copyright(metadata.peeled(t)[1]))), _fields, "text"))
_add("m09_file_titles", lambda s, d: rows_of(_docs(s, d).withColumn("name", F.expr("concat('/lib/', replace(left(text, 20), '\n', ' '), '_', source, '-v', doc_id % 9, '_20', 10 + doc_id % 20, '.pdf')")), lambda n: [(metadata.title_of_file(n),)], "title string", "name"))
_add("m10_accepted_titles", lambda s, d: rows_of(_docs(s, d), lambda t: [(metadata.accepted_title(t[: len(t) % 60], t), metadata.accepted_title("Title: 'Wholly Other Things'", t))], "title string, other string", "text"))
_add("s28_added_titles", lambda s, d: rows_of(_front(s, d), lambda t: [(metadata.with_author("C. Name", metadata.with_title('New "one"', metadata.peeled(t)[0])),)], "front string", "text"))
_add("s29_title_samples", lambda s, d: rows_of(_front(s, d), lambda t: [(metadata.title_sample(t),)], "sample string", "text"))
_add("a33_xmp", lambda s, d: rows_of(_docs(s, d), lambda t: _record(metadata.from_xmp(metadata.xmp_packet(b"%PDF-1.7\x00" + f"<x:xmpmeta><dc:title><rdf:Alt><rdf:li>{markup.escape(t[:30])}</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>A</rdf:li><rdf:li>B</rdf:li></rdf:Seq></dc:creator></x:xmpmeta>".encode()))), _fields, "text"))

# Files.
_add("a09_word_files", lambda s, d: office.texts(_docs(s, d).where("text is not null").select(F.expr("concat('/in/', doc_id, '.docx')").alias("path"), office.sample("docx")(F.col("text")).alias("content"))))
_add("a10_workbooks", lambda s, d: office.texts(_docs(s, d).where("text is not null").select(F.expr("concat('/in/', doc_id, '.xlsx')").alias("path"), office.sample("xlsx")(F.col("text")).alias("content"))))
_add("a11_slides", lambda s, d: office.texts(_docs(s, d).where("text is not null").select(F.expr("concat('/in/', doc_id, '.pptx')").alias("path"), office.sample("pptx")(F.col("text")).alias("content"))))
_add("a27_pictures", lambda s, d: rows_of(_docs(s, d), lambda t: [(office.picture_text("scan", t if len(t) % 2 else ""),)], "text string", "text"))
_add("a29_fingerprints", lambda s, d: rows_of(_docs(s, d), lambda t: [(office.fingerprint(t.encode()),)], "fingerprint long", "text"))
_add("a18_page_texts", lambda s, d: rows_of(_docs(s, d), lambda t: [(ask.paged_markdown("Book", re.split(r"\n{2,}", t)),)], "text string", "text"))
_add("b07_materialized", lambda s, d: rows_of(_docs(s, d), lambda t: [(figures.materialized(f"{t}\n![a](data:image/png;base64,{'QUJD' * 20})\n![b](data:image/gif;base64,QUJD)")[0],)], "text string", "text"))
_add("b08_epub", lambda s, d: rows_of(_book(s, d), lambda t: [(len(e), office.member(e, "OEBPS/nav.xhtml")) for e in [markup.epub(t.split("\n"), "Book", "urn:x", pictures={"figures/figure-001.png": b"x" * 40})]], "bytes int, nav string", "text"))
_add("b09_stored_zip", lambda s, d: rows_of(_docs(s, d), lambda t: [(len(z), office.member(z, "b.txt")) for z in [office.stored_zip([("a.txt", b"a"), ("b.txt", t.encode())])]], "bytes int, text string", "text"))
_add("m21_xhtml", lambda s, d: rows_of(_book(s, d), lambda t: [(markup.xhtml(t.split("\n")),)], "html string", "text"))

# Answers.
_asked = "What about the ention and thing, thing?"
_add("h07_needles", lambda s, d: rows_of(_docs(s, d), lambda t: [(json.dumps(ask.needles(f'It says "{t[10:30]}" here.', _asked), ensure_ascii=False),)], "needles string", "text"))
_add("h08_bound_lines", lambda s, d: rows_of(_docs(s, d), lambda t: [(i,) for i in ask.bound(ask.needles(f'"{t[10:30]}"', _asked), t.split("\n"), (0, 3))], "line_no int", "text"))
_add("h06_tagged_excerpts", lambda s, d: rows_of(_docs(s, d), lambda t: [(ask.excerpt(t.split("\n"), "tion", 2400),)], "excerpt string", "text"))
_add("c29_json_replies", lambda s, d: rows_of(_docs(s, d), lambda t: [(json.dumps(ask.json_reply(f"Sure! ```json\n[{json.dumps(t[:30])}, 2]\n``` bye")), json.dumps(ask.json_reply(f'{{"a": {json.dumps(t[:9])}')))], "whole string, mended string", "text"))
_add("c14_page_sentences", lambda s, d: rows_of(_docs(s, d), lambda t: list(enumerate(ask.page_sentences(t))), "pos int, sentence string", "text"))
_add("c17_reader_runs", lambda s, d: rows_of(_book(s, d), lambda t: ask.runs(t.split("\n")), "kind string, first int, past int", "text"))
_add("c23_reader_text", lambda s, d: rows_of(_book(s, d), lambda t: [ask.plain_text(t.split("\n"))[:1]], "text string", "text"))
_add("o02_clip_question", lambda s, d: rows_of(_docs(s, d), lambda t: [(ask.with_question(f"### A\n\n{t}", _asked),)], "clip string", "text"))
_add("o05_cited_titles", lambda s, d: rows_of(_docs(s, d), lambda t: [(x,) for x in ask.cited(f"{t}\n*{t[:9].strip()} · Page 3*\n*Other*")], "title string", "text"))
_add("o07_note_bodies", lambda s, d: rows_of(_docs(s, d), lambda t: [(ask.note_body(f"# Notes\n\n<!-- session -->\n\n{t}"),)], "text string", "text"))
_add("m23_session_titles", lambda s, d: rows_of(_docs(s, d).withColumn("name", F.expr("concat('2024-01-', lpad(doc_id % 28 + 1, 2, '0'), '_10-30_forage')")), lambda n: [(ask.session_title(n),)], "title string", "name"))
_add("m24_clip_paths", lambda s, d: rows_of(_docs(s, d).withColumn("path", F.expr("concat('/in/', source, if(doc_id % 2 = 0, '_FORAGE.md', '.md'))")), lambda p: [(ask.clip_path(p),)], "clip boolean", "path"))
