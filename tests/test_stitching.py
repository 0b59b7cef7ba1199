"""Outlines put into texts, against a plain cursor over each document."""

import random

from docloom import queries_joins
from docloom.operators import outline, stitching
from docloom.passes import lines as L
from docloom.passes import stitch
from docloom.sources import relations as R


def starts_of(text):
    out = {}
    for i, line in enumerate(text):
        if (n := L.page_mark(line)) is not None:
            out.setdefault(n - 1, i)
    for i, line in enumerate(text):
        if (n := stitch.heading_page(line)) is not None:
            out[n - 1] = i
    return out


def plain(marks, text):
    """(ord, place, whether a heading is there) of each entry, one after another."""
    starts, cursor, out = starts_of(text), 0, []
    for k, (title, page) in enumerate(marks):
        if not title.strip():
            continue
        lo = starts.get(page) if page is not None else None
        until = next((starts[p] for _, p in marks[k + 1 :] if p in starts and p is not None and (page is None or p > page)), len(text))
        hit = stitch.anchor(title, text, cursor if lo is None else lo, until)
        head = hit is not None and L.heading(text[hit]) is not None
        if hit is None:
            if k and page is not None and page == marks[k - 1][1]:
                continue
            if lo is not None:
                hi = min((p for p in starts if p > page), default=None)
                hit = stitch.title_line(title, text, lo, len(text) if hi is None else starts[hi])
                hit = min(lo + 1, len(text)) if hit is None else hit
            else:
                hit = stitch.title_line(title, text, cursor)
                hit = min(cursor, len(text)) if hit is None else hit
        out.append((k, hit, head))
        cursor = hit + 1 if head else min(len(text), hit + 1)
    return out


def rewritten(marks, levels, text, places):
    """The text with the entries, and the lines that they have in it."""
    heads = {at: k for k, at, head in places if head}
    new, where = [], {}
    for i in range(len(text) + 1):
        for k, at, head in places:
            if at == i and not head:
                new += ["", "#" * levels[k] + " " + marks[k][0].strip(), ""]
                where[k] = len(new) - 2
        if i == len(text):
            break
        for k, at, head in places:
            if at == i and head:
                where[k] = len(new)
        if i in heads:
            new.append("#" * levels[heads[i]] + " " + marks[heads[i]][0].strip())
        elif (L.heading(text[i]) or "").lower() != "outline":
            new.append(text[i])
    return "\n".join(new), where


TITLES = ["Opening Remarks", "5 What Keeps the Devil in Business", "The Long Way Home Again", "Going Up", "1.2 Going Up", "A", "Why Life Is Hard and Why Another Way", "Nowhere at all", " ", "Outline"]


def a_book(rng):
    text = []
    for _ in range(rng.randrange(1, 40)):
        text += rng.choice([
            ["## Opening Remarks"], ["What Keeps the Devil", "in Business"], ["# What Keeps the", "Devil", "## in Business"], ["The Long Way Home Again, it said, was long."], ["they took the long way home again"], ["Going Up 12"], ["Going Up .... 3"],
            ["### 7 Going Up"], ["## Page 2"], [f"<!-- page {rng.randrange(1, 5)} -->"], ["plain words here"], [""], ["Why Life Is Hard", "and Why", "Another Way"], ["Why Life Is Hard", "", "and Why Another Way"], ["# Outline"], ["```"], ["x" * 90], ["The Long Way Home"], ["## Page 4", "Opening Remarks of all"],
        ])
    return text


def test_places_are_those_of_the_cursor(spark):
    rng = random.Random(6)
    books = [a_book(rng) for _ in range(120)]
    outlines = [[(rng.choice(TITLES), rng.choice([None, 0, 1, 1, 2, 3, 6])) for _ in range(rng.randrange(1, 9))] for _ in books]
    docs = spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(books)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, k, t, 1 + k % 3, p) for i, o in enumerate(outlines) for k, (t, p) in enumerate(o)], "doc_id long, ord int, title string, level int, page int")
    lines = R.lines(docs)
    places = stitching.placed(marks, lines).cache()
    got = sorted((r.doc_id, r.ord, r.at, r["head"]) for r in places.collect())
    want = {i: plain(o, b) for i, (o, b) in enumerate(zip(outlines, books, strict=True))}
    assert got == sorted((i, *p) for i, found in want.items() for p in found)
    assert sum(r[3] for r in got) > 20 and sum(not r[3] for r in got) > 50
    texts = {r.doc_id: r.text for r in stitching.stitched(docs, places).collect()}
    where = {(r.doc_id, r.ord): r.line for r in stitching.located(places, lines).collect()}
    for i, (o, b) in enumerate(zip(outlines, books, strict=True)):
        text, at = rewritten(o, {k: 1 + k % 3 for k in range(len(o))}, b, want[i])
        assert texts[i] == text
        assert {k: v for (d, k), v in where.items() if d == i} == at


def test_no_entries_and_no_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, ord int, title string, level int, page int")
    assert stitching.placed(marks, R.lines(docs)).count() == 0
    assert {r.doc_id: r.text for r in stitching.stitched(docs, stitching.placed(marks, R.lines(docs))).collect()} == {1: "a\nb", 2: None}


def test_page_marks(spark):
    rng = random.Random(21)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    books, files = [], []
    for k in range(150):
        pages = [[rng.choice([said(1), said(4), said(6), said(30), "", "12", said(5) + " ..... 7"]) for _ in range(rng.randrange(0, 5))] for _ in range(rng.randrange(0, 7))]
        lines = [rng.choice([x, x, x + ", and on", "so " + x, x[: rng.randrange(12, 30)], "# " + x, said(3), x + "   12"]) for page in pages for x in page]
        lines += rng.choice([[], ["<!-- page 1 -->"], ["## Page 3", "more"], ["<!-- page 1 -->", "x", "<!-- page 2 -->"], ["## Page 1", "## Page 2"]])
        if k % 5 == 0:
            rng.shuffle(lines)
        books.append(lines or [""])
        files.append(["\n".join(p) for p in pages])
    docs = spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(books)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, k, t) for i, f in enumerate(files) for k, t in enumerate(f)], "doc_id long, page int, text string")
    got: dict[int, list[tuple]] = {}
    for r in stitching.page_marks(pages, R.lines(docs)).where("put").collect():
        got.setdefault(r.doc_id, []).append((r.at, r.page))
    put = 0
    for i, (book, file) in enumerate(zip(books, files, strict=True)):
        new = list(book)
        for at, page in sorted(got.get(i, []), reverse=True):
            new.insert(at, f"<!-- page {page + 1} -->")
        assert "\n".join(new) == stitch.with_page_marks("\n".join(book), file), (book, file)
        put += len(got.get(i, []))
    assert put > 150


def test_anchors_by_the_lines_that_may_matter_alone(spark):
    """Long lines may be left out, also where they stand between two pieces; f02 makes its lines once."""
    rng = random.Random(31)
    long = "one two " * 12
    books = ["\n".join(rng.choice(["One", "two", "# One two", "## 2 Two one", "", "One two ..... 4", "  two  ", "![one](a.png)", "```", "---", long, long + "# x", " " * 90 + "one" + " " * 9]) for _ in range(60)) for _ in range(30)]
    lines = R.lines(spark.createDataFrame(list(enumerate(books)), "doc_id long, text string")).cache()
    titles = spark.createDataFrame([(i, k, t) for i in range(30) for k, t in enumerate(["One two", "two one", "one two two", "Two", "2 two one", "One"])], "doc_id long, ord int, title string")
    want = sorted(map(tuple, stitching.anchors(titles, lines).collect()))
    few = lines.where(stitching.candidates())
    assert sorted(map(tuple, stitching.anchors(titles, few).collect())) == want and len({x.span for x in stitching.anchors(titles, lines).collect()}) == 3
    assert few.count() < lines.count() and sorted(map(tuple, outline.headings(few).collect())) == sorted(map(tuple, outline.headings(lines).collect()))
    made = queries_joins.QUERIES["f02_title_anchors"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in made._jdf.queryExecution().executedPlan().toString()
