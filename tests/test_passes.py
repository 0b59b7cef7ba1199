"""The passes over lines: golden cases, plain versions, and every registered query over the smallest tables."""

import base64
import io
import itertools
import random
import zipfile
import zlib

import pytest

from docloom import queries_passes, queries_support
from docloom.passes import ask, figures, grids, markup, metadata, stitch, tidy, translation
from docloom.passes import lines as L
from docloom.sources import office

from .test_queries import SF

KNOWN = {"when", "in", "to", "many", "he", "came"}


QUERIES = queries_passes.QUERIES | {k: v for k, v in queries_support.QUERIES.items() if k not in queries_support.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) >= 2


@pytest.mark.parametrize(("step", "before", "after", "where"), [
    (tidy.readable, ["a�  b 7", "```", "x�"], ["a b  7", "```", "x�"], [0, 1, 2]),
    (tidy.drop_caps, ["T", "he final", "“A", "ll roads", "B", "Next"], ["The final", "“All roads", "B", "Next"], None),
    (tidy.hyphens, ["king-", "dom of x-", "y", "# a-", "b", "well-", "9"], ["kingdom of xy", "# a-", "b", "well-", "9"], None),
    (lambda x: tidy.split_words(x, KNOWN), ["Wh en he came in to Ma ny", "<!-- Wh en -->"], ["When he came in to Many", "<!-- Wh en -->"], None),
    (tidy.repeated_marks, ["<!-- page 1 -->", "# 1.3 Intro", "x", "<!-- page 1 -->", "<!-- page 2 -->", "", "Intro", "Intro"], ["<!-- page 1 -->", "# 1.3 Intro", "x", "<!-- page 2 -->", "", "Intro"], [0, 1, 2, 3, 3, 4, 5, 5]),
    (tidy.without_chrome, ["Reader Notes", "x"] * 10 + ["glued wordwww.x-site.org"] + ["www.x-site.org"] * 10, ["x"] * 10 + ["glued word"], None),
    (tidy.without_chrome, ["> 3 bookmarks taken from the PDF", "", "<!-- page 1 -->", "", "<!-- page 2 -->", "x"], ["<!-- page 2 -->", "x"], [0, 0, 0, 0, 0, 1]),
    (tidy.without_chrome, ["# Reader Notes", "Reader Notes"] * 5, ["# Reader Notes"], [0] * 10),
    (tidy.heading_layout, ["# 1 Intro", "", "Intro", "Body here."], ["# 1 Intro", "", "Body here."], [0, 1, 2, 2]),
    (tidy.heading_layout, ["Why Life Is Not Working—and Why Religion", "## Cannot Fix It", "Now four words follow"], ["## Why Life Is Not Working—and Why Religion Cannot Fix It", "Now four words follow"], None),
    (tidy.blank_runs, ["", "to", "", "", "accept", "End.", "", "New", ""], ["to", "accept", "End.", "", "New"], None),
    (tidy.hidden_numbers, ["## Page 7", "12", "x", "# 9"], ["<!-- page 7 -->", "x", "<!-- page 9 -->"], [0, 1, 1, 2]),
    (tidy.joined_headings, ["# The Failure of", "", "## Living Well", "x"], ["# The Failure of Living Well", "x"], [0, 0, 0, 1]),
    (tidy.chapter_ornaments, ["# The Failure of Living", "", "IV", "The Failure of", "Living", "Body"], ["# The Failure of Living", "", "Body"], [0, 1, 1, 1, 1, 2]),
    (tidy.demoted, ["# John 3:16–18", "# One. Two goes on", "and here four more words", "# Fine"], ["John 3:16–18", "One. Two goes on", "and here four more words", "# Fine"], None),
    (tidy.subheadings, ["# Top", "Shifting from One to Two", "", "Next para", "lower"], ["# Top", "## Shifting from One to Two", "", "Next para", "lower"], None),
    (lambda x: tidy.closed_letters(x, "He said your gift, YOUR GIFT"), ["# Y O U R G I F T", "Y O U"], ["# YOUR GIFT", "Y O U"], None),
    (stitch.moved_headings, ["## One", "# Two", "", "## One", "b", "c", "d", "e", "f", "# Two", "g"], ["## One", "", "## One", "b", "c", "d", "e", "f", "# Two", "g"], [0, 8, 1, 2, 3, 4, 5, 6, 7, 8, 9]),
])
def test_pass(step, before, after, where):
    got = step(list(before))
    assert after is None or got.lines == after
    assert where is None or got.where == where
    assert len(got.where) == len(before) and all(0 <= w < max(1, len(got.lines)) for w in got.where)


def test_long_lines_keep_all_words():
    text = ["short line of usual length, about sixty characters it has here"] * 5 + ["One sentence ends here, and then it goes on for long. " * 6]
    got = tidy.long_lines(text)
    assert " ".join(got.lines).split() == " ".join(text).split() and max(map(len, got.lines)) < 130 and got.lines[5].endswith(".")


def test_lines():
    assert L.heading("###x") == "x" and L.heading("####### x") is None and L.heading("<!--ym-tr--># x") == "x"
    assert L.page_mark("<!-- page  12 -->") == 12 and L.page_mark("<!-- page 0 -->") is None
    assert L.citation("(John 3:16–18; 1 Peter 2:3)") and not L.citation("John said 3")
    assert L.ends_sentence("he said.”)") and not L.ends_sentence("he said,") and L.roman("XIV.") and not L.roman("IIX")
    assert L.words("1.2 Don’t stop—now") == ["don't", "stop", "now"] and L.footer_address("https://www.a-b.org") and not L.footer_address("a b.org")
    assert tidy.numbered_heading("8.1 Controls and Indicators") == ("## 8.1 Controls and Indicators", "") and tidy.numbered_heading("8.1 page 3") is None
    assert tidy.numbered_heading("1.2.3 " + "Alpha Beta " * 10 + "gamma")[0] == "### 1.2.3 Alpha Beta Alpha Beta Alpha Beta Alpha Beta"
    assert tidy.frame_line("Page: 3") and not tidy.frame_line("8.1 Controls and Indicators") and tidy.frame_line("Reader  Notes", {"reader notes"})
    assert tidy.accepted("Ma ny", "Many") == "Many" and tidy.accepted("# Ma ny", "Many") == "# Ma ny" and tidy.accepted("Ma ny", "Money") == "Ma ny"


def test_rebuilt_books():
    pages = [f"Reader Notes\n8.{i} Controls and Indicators\nBody text {i} of the page that says something\n{i}." for i in range(1, 7)]
    text = "\f".join(pages)
    assert tidy.pages_of(text) == pages and tidy.frame_keys(pages) == {"reader notes"}
    new = tidy.tidied(text, pages)
    assert "Reader Notes" not in new and new.count("<!-- page") == 6 and "## 8.3 Controls and Indicators\n\nBody text 3" in new
    assert tidy.tidied("x", []) == "x"


def test_tables():
    rows = ["| a |  | b |", "| --- | --- | --- |", "| 1 |  | x |", "|  |  | y |"]
    assert grids.tables([*rows, "", "z"]) == [(0, 4)]
    assert grids.compacted(rows).lines == ["| a | b |", "| --- | --- |", "| 1 | x |", "|  | y |"]
    assert grids.compact([["", "h"], ["g", ""], ["", "v"]]) == [["h"], ["g"], ["v"]]
    assert grids.lifted(["it goes", *rows, "on here.", "", "New"]) == ["it goes", "on here.", *rows, "", "New"]
    assert grids.extracted([["a|b", None], ["", ""], ["c", "d\n e"]]) == ["| a\\|b |  |", "| --- | --- |", "| c | d e |"]
    assert grids.as_html(rows, 0, 4).count("<td>") == 6
    assert grids.woven(["snip", "z"], [("snip", [[["a", "b"], ["c", "d"]]])])[1] == "<!-- page 1 -->"


def test_interleaving_against_all_weaves():
    rng = random.Random(5)
    for _ in range(300):
        left, right = [rng.choice("ab") for _ in range(6)], [rng.choice("ab") for _ in range(6)]
        words = [rng.choice("ab") for _ in range(12)]
        plain = any([words[i] for i in at] == left and [words[i] for i in range(12) if i not in at] == right for at in itertools.combinations(range(12), 6))
        assert grids.interleaves(words, [left, right]) == plain


def test_outlines():
    text = ["<!-- page 1 -->", "Contents", "Chapter Two ..... 2", "<!-- page 2 -->", "# Chapter Two", "x", "<!-- page 3 -->", "What Keeps It", "in Business", "y"]
    marks = [stitch.Mark("Chapter Two", 2, 1), stitch.Mark("5 What Keeps It in Business", 1, 2), stitch.Mark("Lost", 3, 2)]
    new, found = stitch.stitched(marks, text)
    assert [new[m.line] if m.line is not None else None for m in found] == ["## Chapter Two", "# 5 What Keeps It in Business", None]
    assert stitch.read(stitch.written(found)) == found and stitch.read("no") == [] and stitch.written([]) is None
    assert stitch.page_breaks("\fone\f\ftwo") == "<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\n<!-- page 3 -->\n\ntwo"
    lines, told = stitch.claimed([stitch.Mark("Eins"), stitch.Mark("Zwei", 2)], ["# Eins", "# Deux"])
    assert lines == ["# Eins", "## Zwei"] and [m.line for m in told] == [0, 1]
    assert stitch.found(stitch.Mark("Chapter Two"), text) == 4 and stitch.found(stitch.Mark("zz", page=2), text) == 6
    assert stitch.interpolated(5, (0, 10), (100, 200)) == 150 and [m.title for m in stitch.part_of([stitch.Mark("a"), stitch.Mark("b", 2), stitch.Mark("c")], 0)] == ["a", "b"]


def test_translation():
    text = "# A\n\npara one\ntwo\n| t |\n\n![x](figures/a.png)\n---"
    parts = translation.blocks(text)
    assert [b.body for b in parts if b.text] == ["A", "para one\ntwo"]
    assert translation.rendered(parts, ["B", "p"], below=False) == ["# B", "", "p", "| t |", "", "![x](figures/a.png)", "---"]
    assert translation.rendered(parts, ["B", "p\nq"])[:8] == ["# A", "", L.MARKER + "# B", "", "para one\ntwo", "", L.MARKER + "p", L.MARKER + "q"]
    assert [len(b) for b in translation.batches(["x" * 2000] * 3 + ["y" * 9000, "z"])] == [2, 1, 1, 1]
    hidden, links = translation.protected("a [b](c) ![d](e)")
    assert hidden == "a [[0]] [[1]]" and translation.restored(hidden, links) == "a [b](c) ![d](e)" and translation.restored("[[ 7 ]]", links) == "[[ 7 ]]"


def test_records():
    block, body, record = metadata.peeled('---\ntitle: "A \\"b\\""\nauthor:\n  - X\n  - Y\nidentifier:\n  - scheme: ISBN-13\n    text: "978-0-306-40615-7"\n---\n\nBody')
    assert (record.title, record.authors, record.isbn, body) == ('A "b"', ["X", "Y"], "9780306406157", "Body") and block.endswith("\n\n")
    r = metadata.from_copyright("Copyright © 2001 by A. Name\nPublished by A. Name\nHouse Press\nISBN 978-0-306-40615-7")
    assert (r.authors, r.publisher, r.date, r.isbn) == (["A. Name"], "House Press", "2001", "9780306406157")
    assert metadata.title_of_file("/x/My_Great-book_v2_2019.pdf") == "My Great book" and metadata.title_of_file("2019.pdf") == "Untitled"
    assert metadata.accepted_title('"Flying Carpets"', "a carpet that was flying, Carpets") == "Flying Carpets" and metadata.accepted_title("Untitled", "x") is None
    assert metadata.with_title("N", "---\nlang: en\n---") == '---\ntitle: "N"\nlang: en\n---'
    assert metadata.from_xmp("<dc:title><rdf:li>T &amp; U</rdf:li></dc:title>").title == "T & U" and metadata.xmp_packet(b"none") is None


def test_markup():
    assert markup.inline("a **b *c* b** `d<` [e](https://f) ![g](h.png) 2*3*4 _i_", lambda p: f"images/{p}") == 'a <strong>b <em>c</em> b</strong> <code>d&lt;</code> <a href="https://f">e</a> <img src="../images/h.png" alt="g"/> 2*3*4 <em>i</em>'
    html = markup.xhtml(["# T", "one", "two", "", "- a", "  - b", "- c", "1. d", "***", "```", "x<", "```", "Chapter 1: Title .... 13", "| h |", "| - |", "| v |"], pages={13: "ch001.xhtml"}, here="ch002.xhtml")
    assert '<h1 id="t">T</h1>\n<p>one two</p>' in html and "<ul>\n<li>a<ul>\n<li>b</li></ul>\n</li>\n<li>c</li></ul>" in html and "<hr/>" in html and "<pre><code>x&lt;</code></pre>" in html
    assert 'href="ch001.xhtml#page-13"' in html and "<th>h</th>" in html
    used = set()
    assert [markup.slug(t, used) for t in ("A b", "A-b", "2 x", "?", "XML")] == ["a-b", "a-b-2", "h-2-x", "h-section", "h-xml"]
    assert markup.safe_path("a/../b") is None and markup.safe_path("%2e%2e/b") is None and markup.safe_path("a%20b.png") == "a b.png"
    book = markup.epub(["front", "# One", "![x](p.png)", "## Sub", "# Two"], "Book", "urn:x", pictures={"p.png": b"\x89PNG" + b"x" * 40})
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None and "OEBPS/images/p.png" in z.namelist()
        nav = z.read("OEBPS/nav.xhtml").decode()
    assert nav.index("Front matter") < nav.index("One") < nav.index("Sub") < nav.index("Two")


def test_files():
    docx = office.stored_zip([("word/document.xml", b"<w:p><w:t>a &amp; b</w:t></w:p><w:p>c</w:p>")])
    assert office.converted("x.DOCX", docx) == "a & b\nc" and office.converted("x.docx", b"no") is None and office.converted("x.exe", docx) is None
    assert office.slides(office.stored_zip([("ppt/slides/slide2.xml", b"<a:p>b</a:p>")])) is None
    assert office.converted("p.png", b"", "words") == "# p\n\nwords\n" and office.converted("p.txt", "é".encode()) == "é"
    with zipfile.ZipFile(io.BytesIO(docx)) as z:
        assert z.getinfo("word/document.xml").CRC == zlib.crc32(b"<w:p><w:t>a &amp; b</w:t></w:p><w:p>c</w:p>")
    text, files = figures.materialized(f"![a](data:image/png;base64,{base64.b64encode(b'x' * 40).decode()}) ![b](data:image/gif;base64,QUJD)")
    assert text == "![Figure 1](figures/figure-001.png) " and files == [("figures/figure-001.png", b"x" * 40)]
    sizes = [(f"s{i}.png", 40 + i % 4, 30) for i in range(12)] + [("big.png", 900, 900), ("odd.png", 10, 300)]
    assert figures.ornaments(sizes) == {f"s{i}.png" for i in range(12)}
    assert figures.spliced(["<!-- page 1 -->", "# H", "body", "more"], [(1, "figures/a.png"), (9, "figures/z.png")]) == ["<!-- page 1 -->", "# H", "body", "", "![a](figures/a.png)", "", "more", "", "## Figures", "", "![z](figures/z.png)"]


def test_asking():
    assert ask.needles('He says "flaps up" and “go”', "What lifts flaps most quickly") == ["flaps up", "quickly", "lifts", "flaps", "most"]
    assert ask.bound(["Flaps"], ["x", "fläps", "flaps"], (2, 2)) == [2] and ask.bound(["Flaps"], ["x", "fläps", "flaps"], (0, 0)) == [1, 2]
    assert ask.plan(["a" * 9000, "b" * 4000], [0, 1]) == "a" * 9000 and len(ask.tagged([("t", "x" * 3000)] * 9)) == 5
    assert ask.json_reply('ok ```json\n{"a": 1}\n```') == {"a": 1} and ask.json_reply('{"a": "x"') == {"a": "x"} and ask.string_list('x ["a", {"line": "b"}]') == ["a", "b"]
    assert ask.bold_runs("a **b** c **d") == ("a b c **d", [(2, 1)]) and ask.runs(["a", "# b", "c", "| x |", "| - |"]) == [("flow", 0, 1), ("alone", 1, 2), ("flow", 2, 3), ("table", 3, 5)]
    assert ask.plain_text(["# Book", "<!-- page 3 -->", "**x**", "| a | b |", "| - | - |", "| c | d |", "y **z**"], "book") == ("Page 3\nx\na\nb\nc\nd\ny z\n", [(0, 0), (1, 0), (2, 7), (3, 9), (5, 13), (6, 17)])
    assert ask.clip("  a\r\n\n\n\nb ", "C", "S", "4") == "### C\n\na\n\nb\n\n*S · Page 4*" and ask.with_question("### C\n\na", "q") == "### C\n\n**Q:** q\n\na"
    assert ask.cited("*S · Page 4*\n*T*\n*U*", ("t",)) == ["S", "T"] and ask.note_body("# N\n\nx") == "x" and ask.session_title("/a/2024-01-02_10_30_00_FORAGE.md") == "2024-01-02 10.30.00"


def test_support():
    assert [(m.title, m.level) for m in stitch.walked([{"title": "a", "children": [{"title": "b "}]}, {"title": " "}])] == [("a", 1), ("b", 2)]
    assert [m.line for m in stitch.relocated([stitch.Mark("two"), stitch.Mark("x")], ["# One", "", "# Two"])] == [2, 0] and stitch.relocated([], ["# One"])[0].line == 0
    assert stitch.followed(["# a", "1", "2", "# b", "3"], ["# A", "1", "2", "3", "4", "# B", "5"], 4) == 6 and stitch.followed(["# a", "1"], ["# A", "x", "y", "z"], 1) == 2
    r = metadata.pdf_info(b"/Title (A \\(b\\)) /Author (X; Y) /CreationDate (D:20240131)")
    assert (r.title, r.authors, r.created) == ("A (b)", ["X", "Y"], "2024-01-31")
    assert metadata.looked_up("The Book", [{"title": "the book!"}, {"title": "x"}]).title == "the book!" and metadata.looked_up("b", [{"title": "b"}, {"title": "B"}]) is None
    text = ["<!-- page 4 -->", "one", "| a | b |", "| - | - |", "| c | d |", "end"]
    assert ask.page_near(text, 30) == "4" and ask.plain_text(text)[0] == "Page 4\none\na\nb\nc\nd\nend\n"
    assert ask.selection(text, 7, 10) == "one" and ask.selection(text, 7, 16).split("\n") == ["one", "| a | b |", "| --- | --- |", "| c |  |"]
    assert ask.chapter_text("# a\nx\n# b\ny\n# c\nz", 1) == "# a\nx\n" and ask.working("a", " ") == "a" and ask.note("N", ["a", "b"]).startswith("# N\n\na\n\n---\n\nb")


def test_titles_are_looked_for_in_lines_folded_once(monkeypatch):
    text = ["# Of the Engine", "the engine fire switches", "12 engine fire switches here", "page 3 and so on, a long line", "# Engine Fire Switches", "engine fire switchesx", "x" * 121 + " of wings and tails", "see of wings and tails", "Of wings ... 5", "of  the engine, more", "the wing", ""]
    titles = ["Of the engine", "Engine  fire switches", "Page 3 and so on, a long line of it", "The engine fire switches, and the rest", "of wings and tails", "the", "th", "", "not there", "of the engine"]
    assert stitch.heading_and_title_lines(titles, text) == [(t, stitch.heading_line(t, text), stitch.title_line(t, text)) for t in titles]
    assert stitch.heading_and_title_lines(["Any"], []) == [("Any", None, None)]
    folded, done = L.folded, []
    monkeypatch.setattr(L, "folded", lambda t: done.append(t) or folded(t))
    stitch.heading_and_title_lines([f"Title {k}" for k in range(200)], [f"a line {k} of text" for k in range(300)])
    assert len(done) <= 300 + 2 * 200  # not one for each pair


def test_chapters_of_a_package_look_at_their_own_lines(monkeypatch):
    text = [x for k in range(40) for x in (f"# Part {k}", "- a ![p](figures/a.png)", "| x | y |", "| --- | --- |", "| ![p](figures/b.png) | * |", "> ..9", "* * *", "`c` & _d_", "")]
    outside, done = markup.outside, []
    monkeypatch.setattr(markup, "outside", lambda t: done.append(len(t)) or outside(t))
    book = zipfile.ZipFile(io.BytesIO(markup.epub(text, "B", "urn:x", pictures={"figures/a.png": b"a", "figures/b.png": b"b"})))
    assert [x for x in book.namelist() if "images" in x] == ["OEBPS/images/a.png", "OEBPS/images/b.png"]
    assert book.read("OEBPS/text/ch040.xhtml").decode().count("<img") == 2
    assert len(done) <= 3  # not one for each chapter


def test_pieces_too_long_for_a_known_word_are_not_looked_up():
    class Known(frozenset):
        asked = 0

        def __contains__(self, x):
            Known.asked += 1
            return super().__contains__(x)

    text = ["Wh en seventy sixths came, ma ny in to the ho use"]
    assert tidy.split_words(text, Known({"when", "many", "into"})).lines == ["When seventy sixths came, many into the ho use"]
    assert Known.asked <= 6
    line = "one two three, four five six. seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    assert [tidy.cut(line, u, m) for u, m in ((20, 40), (30, 60), (68, 98), (200, 300))] == [30, 30, 65, None]
