"""Lines followed in the paired text, against the rule for one line at a time."""

import random

import pytest

from docloom.operators import tracking
from docloom.operators import following
from docloom.passes import lines as L
from docloom.sources import relations as R


def heads_of(text):
    return [(i, min(3, L.marks(x)), h) for i, x in enumerate(text) if (h := L.heading(x)) and not L.page_like(h) and h != "Outline"][:180]


def plain(text, other, line):
    own, theirs = heads_of(text), heads_of(other)
    titles = {}
    for i, x in enumerate(other):
        if L.heading(x):
            titles.setdefault(L.heading(x).lower(), i)

    def counterpart(i):
        same = [h for h in theirs if h[1] == own[i][1]]
        nth = sum(h[1] == own[i][1] for h in own[:i])
        return same[nth] if nth < len(same) else theirs[i] if i < len(theirs) else None

    page = next((n for i in range(line, -1, -1) if (n := L.page_mark(text[i])) is not None), None)
    at = max((k for k, h in enumerate(own) if h[0] <= line), default=None)
    to = None
    if at is not None:
        to = titles.get(own[at][2].lower())
        for k in (next(k for k, h in enumerate(own) if h[2].lower() == own[at][2].lower()), at):
            if to is None and counterpart(k) is not None:
                to = titles[counterpart(k)[2].lower()]
    if to is None and page is not None:
        to = next((i for i, x in enumerate(other) if L.page_mark(x) == page), None)
    if to is None:
        return None

    def bounds(heads, i, n):
        k = max((k for k, h in enumerate(heads) if h[0] <= i), default=None)
        return None if k is None else (heads[k][0], max(heads[k][0] + 1, heads[k + 1][0] if k + 1 < len(heads) else n))

    def paged(rows, until):
        start = next((i for i, x in enumerate(rows) if L.page_mark(x) == page), None)
        if page is None or start is None or start >= until:
            return None
        return start, max(start + 1, next((i for i in range(start + 1, min(until, len(rows))) if L.page_mark(rows[i]) is not None), until))

    a = bounds(own, line, len(text)) or (0, len(text))
    b = bounds(theirs, to, len(other)) or (to, max(len(other), to + 1))
    if (c := paged(text, a[1])) and (d := paged(other, b[1])):
        a, b = c, d
    share = min(1.0, max(0.0, (line - a[0]) / max(1, a[1] - a[0])))
    return b[0] + int(max(0, b[1] - b[0]) * share)


@pytest.mark.parametrize("chunk", [1, 512])
def test_lines_are_followed(spark, chunk):
    rng = random.Random(chunk)
    pool = ["# One", "## Two", "### Three", "# one", "## Other", "## Page 3", "# Outline", "<!-- page 1 -->", "<!-- page 2 -->", "<!-- page 3 -->", "a", "b", "c", "", "d"]
    make = lambda: [rng.choice(pool + ["x"] * 10) for _ in range(rng.randrange(1, 40))]
    texts, others = [make() for _ in range(120)], [make() for _ in range(120)]
    frame = lambda rows: R.lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(rows)], "doc_id long, text string"))
    got = {(r.doc_id, r.line_no): r.other for r in following.followed(frame(texts), frame(others), chunk=chunk).collect()}
    want = {(i, k): plain(t, o, k) for i, (t, o) in enumerate(zip(texts, others, strict=True)) for k in range(len(t))}
    assert got == want
    assert sum(v is not None for v in got.values()) > 1000


def test_a_source_is_gone_through_once_for_a_title(spark):
    rows = [(1, "## Y O U R G I F T\nx"), (2, "S o m e t\n"), (3, "## A b c d e f\n"), (4, "# Y O U R G I F T")]
    sources = [(1, "a your gift, then (Your Gift). x"), (2, "Somet"), (3, "abcdef 12345678"), (4, None)]
    lines = spark.createDataFrame([(k, i, x) for k, t in rows for i, x in enumerate(t.split("\n"))], "doc_id long, line_no int, text string")
    out = tracking.closed_letters(lines, spark.createDataFrame(sources, "doc_id long, text string"))
    assert sorted((r.doc_id, r.line_no, r.text) for r in out.collect()) == [(1, 0, "## (Your Gift)."), (3, 0, "## abcdef")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(source") == 1
