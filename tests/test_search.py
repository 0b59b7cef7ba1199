"""The search language: parsing, highlights, and matching within a paragraph or a sentence."""

import pytest
from pyspark.sql import functions as F

from docloom.operators.retrieval import boolean_plan, hit_lines
from docloom.plans import search
from docloom.plans.search import Node, highlights, matching, matching_by_word, parse

t = lambda x: Node("term", x)
a = lambda *p: Node("and", parts=p)
o = lambda *p: Node("or", parts=p)
n = lambda p: Node("not", parts=(p,))


@pytest.mark.parametrize(
    ("query", "node"),
    [
        ("a b", a(t("a"), t("b"))), ("a OR b c", o(t("a"), a(t("b"), t("c")))), ('"a b" -c', a(t("a b"), n(t("c")))), ("(a OR b) NOT c", a(o(t("a"), t("b")), n(t("c")))),
        ("a and b", a(t("a"), t("and"), t("b"))), ("a AND", t("a")), ("a)", t("a)")), ('""', t('""')), ("(a OR b", o(t("a"), t("b"))), ('"a b', t("a b")),
        ("low-speed", t("low-speed")), ("-(a)", a(t("-"), t("a"))), ("AND a", t("AND a")), ("NOT", t("NOT")), ("()", t("()")), ("", None), ("  ", None),
    ],
)
def test_parse(query, node):
    assert parse(query) == node


def test_highlights():
    assert highlights(parse("a (b OR -c) NOT d")) == ["a", "b"]


def test_matching(spark):
    rows = [(1, "Flaps increase lift at low speed when landing."), (2, "Flaps. Ice on landing."), (3, "flaps\n\nlanding"), (4, "# Flaps\nlanding"), (5, "FLÀPS for the\nlanding"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(matching(docs, "flaps AND landing NOT ice")) == [1, 5]
    assert ids(matching(docs, "flaps")) == [1, 2, 3, 4, 5]
    assert ids(matching(docs, "")) == [1, 2, 3, 4, 5, 6]
    assert ids(matching_by_word(docs, "flaps AND landing NOT ice")) == [1]


def test_hit_lines_of_accented_texts_need_no_collation_and_no_exchange(spark, monkeypatch):
    """The collation is far slower than a look at folded letters; it is for letters that do not fold."""
    said = ["Le Clôwn Était là, 12 Straße.", "nichts hier ß", "", "the  of", "un idîot. THÈ OF it. oui", "", "clown Ⅷ", "", "İDIOT clown", "# clown", "x"]
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda rows, q="(the of OR clown) NOT idiot": sorted((r.doc_id, r.line_no) for r in hit_lines(rows, q).collect())
    assert found(docs("\n".join(said), None, "none here", "")) == [(0, 0), (0, 3), (0, 4), (0, 6)]
    assert found(docs("\r\n".join(said)), "strasse") == found(docs("\n".join(said)), "straße") == [(0, 0)]
    assert found(docs("# a\n\nnone\nat all\n\nno"), "NOT clown") == [(0, 2), (0, 3), (0, 5)]
    assert found(docs("# a\n\nnone\nat all\n\nno"), "none NOT clown") == [(0, 2)]
    plan = boolean_plan(docs("\n".join(said)), "(the of OR clown) NOT idiot")
    assert [(r.hits, r.excerpt) for r in plan.collect()] == [(4, "\n\n".join("\n".join(x for x in said[a:b] if x) for a, b in ((0, 6), (3, 9), (4, 9), (6, 9))))]
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "_collated", lambda c, term: F.raise_error(F.lit("collated")).cast("boolean"))
    assert found(docs("\n".join(said[:6]))) == [(0, 0), (0, 3), (0, 4)]
