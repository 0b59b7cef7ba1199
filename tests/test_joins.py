"""Budgets, claims and the lexicon against plain versions."""

import random
import re
from collections import Counter

import pytest

from docloom import queries_joins
from docloom.operators import budgets, claims, lexicon, ornaments, outline, scan, tracking
from docloom.passes import ask, figures, tidy, translation
from docloom.passes import lines as L
from docloom.sources import relations as R


@pytest.mark.parametrize("chunk,span", [(1, 64), (7, 1000), (4096, 1 << 20)])
def test_requests_are_those_of_the_fold(spark, chunk, span):
    rng = random.Random(chunk)
    docs = [[rng.choice([0, 1, 5, 40, 300, 2792, 2793, 4499, 4500, 9000]) if rng.random() < 0.3 else rng.randrange(200) for _ in range(n)] for n in (0, 1, 2, 33, 70, 500)]
    items = spark.createDataFrame([(i, k, n) for i, sizes in enumerate(docs) for k, n in enumerate(sizes)], "doc_id long, pos int, size int")

    def of(**how):
        got: dict[int, dict[int, list[int]]] = {}
        for r in budgets.batched(items, chunk=chunk, span=span, **how).orderBy("doc_id", "pos").collect():
            got.setdefault(r.doc_id, {}).setdefault(r.batch, []).append(r["size"])
        return [list(got.get(i, {}).values()) for i in range(len(docs))]

    assert of(budget=2800, extra=8) == [[list(map(len, b)) for b in ask.budgeted(["x" * n for n in sizes])] for sizes in docs]
    assert of(budget=4499, most=32) == [[list(map(len, b)) for b in translation.batches(["x" * n for n in sizes])] for sizes in docs]


def plain_claims(marks, text):
    """Entries by title, each taking the first heading that no other has; then what is left, in order; then pages."""
    heads = [(i, h) for i, x in enumerate(text) if (h := L.heading(x))]
    taken, where = set(), []
    for title, _ in marks:
        i = next((i for i, h in heads if title and i not in taken and L.folded(h) == L.folded(title)), None)
        where.append((i, "title") if i is not None else (None, None))
        taken.add(i)
    left = [i for i, h in heads if i not in taken and not L.page_like(h) and h.lower() != "outline"]
    where = [w if w[0] is not None else (left.pop(0), "order") if left else w for w in where]
    starts = {}
    for i, x in enumerate(text):
        if L.page_mark(x):
            starts.setdefault(L.page_mark(x) - 1, i)
    return [(starts[p], "page") if w[0] is None and p in starts else w for w, (_, p) in zip(where, marks, strict=True)]


def plain_relocated(marks, text):
    heads = [(i, h) for i, x in enumerate(text) if (h := L.heading(x))]
    where = [next((i for i, h in heads if h.lower() == t.lower()), None) for t, _ in marks]
    left = [i for i, h in heads if not L.page_like(h) and h != "Outline" and i not in where][:180]
    return [w if w is not None else left.pop(0) if left else None for w in where]


def test_claims(spark):
    rng = random.Random(3)
    titles = ["One", "ONE", "Two – b", "two - B", "", "Outline", "Page 3", "Lost", "3 Three"]
    books, outlines = [], []
    for _ in range(200):
        books.append([rng.choice(["# One", "## One", "### Two – b", "# Outline", "## Page 3", "<!-- page 1 -->", "<!-- page 2 -->", "text", "", "<!--ym-tr--># One", "# Other", "# More"]) for _ in range(rng.randrange(1, 15))])
        outlines.append([(rng.choice(titles), rng.choice([None, 0, 1, 5])) for _ in range(rng.randrange(0, 9))])
    lines = R.lines(spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(books)], "doc_id long, text string"))
    marks = spark.createDataFrame([(i, k, t, p) for i, o in enumerate(outlines) for k, (t, p) in enumerate(o)], "doc_id long, ord int, title string, page int")
    got = {(r.doc_id, r.ord): (r.line, r.how) for r in claims.claimed(marks, lines).collect()}
    assert got == {(i, k): w for i, (o, b) in enumerate(zip(outlines, books, strict=True)) for k, w in enumerate(plain_claims(o, b))}
    assert Counter(h for _, h in got.values()).keys() == {"title", "order", "page", None}
    got = {(r.doc_id, r.ord): r.line for r in claims.relocated(marks, lines).collect()}
    assert got == {(i, k): w for i, (o, b) in enumerate(zip(outlines, books, strict=True)) for k, w in enumerate(plain_relocated(o, b))}


def test_split_words(spark):
    rng = random.Random(5)
    pool = ["when", "every", "window", "open", "Über", "in", "to", "into", "it", "came", "many", "table"]

    def word():
        w = rng.choice(pool)
        k = rng.randrange(1, len(w)) if len(w) > 2 and rng.random() < 0.3 else 0
        return (w[:k] + " " + w[k:]) if k else rng.choice([w, w.capitalize(), w + ","])

    texts = ["\n".join(rng.choice(["", "# ", "> ", "<!-- ", "| "]) + rng.choice([" ", " ", "  "]).join(word() for _ in range(rng.randrange(12))) for _ in range(8)) + rng.choice(["", "\n```\nwh en in to\n```"]) for _ in range(60)]
    lines = R.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = lexicon.lexicon(lines, least=25)
    counted = Counter(w.lower() for t in texts for w in re.findall(r"[^\W\d_]+", t))
    known = {w for w, n in counted.items() if n >= 25}
    assert {r.word: r.times for r in words.collect()} == {w: counted[w] for w in known}
    got: dict[int, list[str]] = {}
    for r in scan.applied(lines, lexicon.rejoined(lines, words)).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    changed = 0
    for i, text in enumerate(texts):
        want = tidy.split_words(text.split("\n"), known).lines
        assert got[i] == want
        assert [tidy.bare(x) for x in want] == [tidy.bare(x) for x in text.split("\n")]
        changed += want != text.split("\n")
    assert changed > 20
    odd = {(r.doc_id, r.line_no) for r in lexicon.suspects(lines, words).collect()}
    assert odd == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if tidy.suspect(x, known)}
    near = {(r.doc_id, r.line_no): (r.before, r.after) for r in lexicon.with_neighbours(lexicon.suspects(lines, words), lines).collect()}
    for (i, k), (before, after) in near.items():
        own = texts[i].split("\n")
        assert before == (" ".join(own[k - 1].split()[-6:]) if k else "") and after == (" ".join(own[k + 1].split()[:6]) if k + 1 < len(own) else "")


def test_letter_spaced_titles(spark):
    rng = random.Random(8)
    words = ["your", "gift", "Your", "GIFT", "of", "the", "12", "day", "“Day”", "it’s", "é"]
    sources, books = [], []
    for _ in range(150):
        said = [rng.choice(words) for _ in range(rng.randrange(2, 40))]
        sources.append("".join(w + rng.choice([" ", "\n", ", ", "  ", "-", ""]) for w in said))
        titles = []
        for _ in range(3):
            k = rng.randrange(len(said))
            letters = "".join(c for w in said[k : k + rng.randrange(1, 5)] for c in w if c.isalnum())
            titles.append(rng.choice(["## ", "", "  ", "> ", "#"]) + " ".join(rng.choice([letters, letters.upper(), "NOT THERE"])))
        books.append("\n".join([*titles, "plain", "```", "Y O U R G I F T", "```"]))
    lines = R.lines(spark.createDataFrame(list(enumerate(books)), "doc_id long, text string"))
    edits = tracking.closed_letters(lines, spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string"))
    got = {(r.doc_id, r.line_no): r.text for r in edits.collect()}
    want = {}
    for i, (book, source) in enumerate(zip(books, sources, strict=True)):
        own = book.split("\n")
        want |= {(i, k): new for k, (old, new) in enumerate(zip(own, tidy.closed_letters(own, source).lines, strict=True)) if new != old}
    assert got == want and len(got) > 60


def test_ornaments(spark):
    rng = random.Random(12)
    books, pictures = [], []
    for _ in range(80):
        n = rng.randrange(1, 60)
        sizes = [(f"p{k:03d}.png", rng.choice([20, 22, 25, 28, 40, 400]) + rng.randrange(3), rng.choice([20, 23, 26, 500])) for k in range(n)]
        pictures.append(sizes)
        books.append([rng.choice([f"![a](figures/p{rng.randrange(n):03d}.png)", "text", "", f'  ![x](p{rng.randrange(n):03d}.png "t") tail', "see ![x](p001.png)"]) for _ in range(30)])
    frame = spark.createDataFrame([(i, *p) for i, own in enumerate(pictures) for p in own], "doc_id long, name string, w int, h int")
    got = {(r.doc_id, r.name) for r in ornaments.ornaments(frame).collect()}
    assert got == {(i, name) for i, own in enumerate(pictures) for name in figures.ornaments(own)} and len(got) > 300
    lines = R.lines(spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(books)], "doc_id long, text string"))
    edits = ornaments.without_ornaments(lines, frame).cache()
    where: dict[int, list[int]] = {}
    for r in scan.line_map(lines, edits).orderBy("doc_id", "old_line").collect():
        where.setdefault(r.doc_id, []).append(r.new_line)
    gone = {(r.doc_id, r.line_no) for r in edits.collect()}
    for i, (book, own) in enumerate(zip(books, pictures, strict=True)):
        want = figures.without_ornaments(book, own)
        assert [x for k, x in enumerate(book) if (i, k) not in gone] == want.lines and where[i] == want.where


def test_outline_after_ornaments(spark):
    """Headings at the lines that a map of all lines gives them, by the lines that go alone."""
    rng = random.Random(13)
    books = [["---", "x", "---"] * (i % 2) + [rng.choice(["# A title", "text", "", "![a](p1.png)", "## Other", "![b](q.png)", "see ![x](p1.png)", "- a ---"]) for _ in range(rng.randrange(60))] for i in range(40)]
    lines = R.lines(spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(books)], "doc_id long, text string")).cache()
    frame = spark.createDataFrame([(i, f"p{k}.png", 30, 20) for i in range(0, 40, 3) for k in range(12)], "doc_id long, name string, w int, h int")
    edits = ornaments.without_ornaments(lines, frame)
    places = {(r.doc_id, r.old_line): r.new_line for r in scan.line_map(lines, edits).collect()}
    want = sorted((r.doc_id, r.ord, r.title, places[r.doc_id, r.line_no]) for r in outline.headings(lines).collect())
    assert sorted(map(tuple, ornaments.outline_after(lines, frame).collect())) == want and any(k != places[i, k] for i, k in places)


def test_outline_after_ornaments_makes_lines_once(spark):
    docs = spark.createDataFrame([(1, "# a\n![x](p1.png)\n# b")], "doc_id long, text string")
    frame = spark.createDataFrame([(1, f"p{k}.png", 30, 20) for k in range(12)], "doc_id long, name string, w int, h int")
    made = queries_joins.QUERIES["s58_outline_after_ornaments"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ornaments.outline_after(R.lines(docs), frame).collect())) == [(1, 1, "a", 0), (1, 2, "b", 1)]
