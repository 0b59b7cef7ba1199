"""Scans in two levels against the plain passes, for chunks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import scan
from docloom.passes import lines as L
from docloom.passes import tidy
from docloom.sources import relations as R

PIECES = [
    "```", "~~~ x", "", "", "   ", "<!-- page 1 -->", "<!-- page 2 -->", "<!-- page 1 -->", "# Of the", "## Of the", "### A title and", "Short One", "Short One of Two", "IV", "plain words go on", "Plain words end here.", "king-", "dom and king-", "dom of it",
    "a-", "# head-", "Running Head", "## Running Head", "## 5 Running Head", "| a | b |", "![x](y)", "> quoted", "- item", "John 3:16", "A Title of Words", "Another Title Here", "It goes on, and", "and ends.", "“Quoted end.”", "---", "Contents .... 3", "# Ends with the", "of",
    "####### x", "#NoBlank", "#", "Überschrift Zwei Worte", "x" * 70, "A very long title of many words that goes on and on for more than eighty characters in all",
]


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.choice([1, 2, 5, 30, 90]))) for _ in range(150)] + ["", "one", "\n\n"]
    lines = R.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).cache()
    return texts, lines


def held(books, edits, plain, chunk):
    texts, lines = books
    edits = edits(lines, chunk=chunk).cache()
    got: dict[int, list[str]] = {}
    for r in scan.applied(lines, edits).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    where: dict[int, list[int]] = {}
    for r in scan.line_map(lines, edits, chunk=chunk).orderBy("doc_id", "old_line").collect():
        where.setdefault(r.doc_id, []).append(r.new_line)
    changed = 0
    for i, text in enumerate(texts):
        want = plain(text.split("\n"))
        assert got.get(i, []) == want.lines, text
        assert where[i] == want.where, text
        changed += want.lines != text.split("\n")
    assert changed > 10


@pytest.mark.parametrize("chunk", [1, 3, 512])
@pytest.mark.parametrize("name", ["hyphens", "repeated_marks", "blank_runs", "joined_headings", "subheadings"])
def test_edits_are_those_of_the_pass(books, name, chunk):
    held(books, getattr(scan, name), getattr(tidy, name), chunk)


@pytest.mark.parametrize("chunk", [1, 4, 512])
def test_free_lines(books, chunk):
    texts, lines = books
    got = {(r.doc_id, r.line_no): r.free for r in scan.free(lines, chunk=chunk).collect()}
    assert got == {(i, k): f for i, text in enumerate(texts) for k, f in enumerate(L.free(text.split("\n")))}


@pytest.mark.parametrize("chunk", [1, 5, 100])
def test_any_automaton(spark, chunk):
    """Random tables of five states, one long document and a short one."""
    rng = random.Random(chunk)
    tables = [[rng.randrange(5) for _ in range(5)] for _ in range(9)]
    rows = [(d, i, rng.randrange(9)) for d, n in ((1, 700), (2, 3), (3, 0)) for i in range(n)]
    packed = F.array(*(scan.table(t).cast("bigint") for t in tables))
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, kind int").withColumn("step", F.get(packed, F.col("kind")))
    want, state = {}, {}
    for d, i, k in rows:
        want[d, i] = state.get(d, 2)
        state[d] = tables[k][want[d, i]]
    assert {(r.doc_id, r.line_no): r.state for r in scan.states(lines, "step", 5, first=2, chunk=chunk).collect()} == want
