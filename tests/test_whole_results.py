"""Queries against their SQL over tables of odd and long texts."""

import time

import duckdb
import pytest

from docloom import queries_passes
from docloom.operators import retrieval, stitching
from docloom.sources import office, relations

from .test_queries import ORACLE_SQL, QUERIES, plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def agree(spark, tmp_path):
    """Holds a query over documents of given texts against its SQL, and gives its rows."""

    def held(name, texts, table="documents"):
        path = f"{tmp_path}/{table}.parquet"
        if table == "documents":
            rows = [(i, t, ["en", "de"][i % 2], "src1", len(t or "")) for i, t in texts.items()]
            spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.mode("overwrite").parquet(path)
        else:
            spark.createDataFrame([(i, "https://a.example/x", t) for i, t in texts.items()], "page_id long, url string, html string").coalesce(1).write.mode("overwrite").parquet(path)
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        cursor = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        return [dict(zip(columns, r, strict=True)) for r in got]

    return held


def test_lines_that_differ_late_are_texts_of_their_own(agree):
    """Two lines of one length that differ beyond what a title can say: i09 counted them as one text."""
    long = "some title that goes on; " + "word " * 60
    texts = {0: "\n".join([f"Some title {k}" for k in range(3)]), 63 * 55: "\n".join(["some title that goes on"] * 70)}
    texts |= {9 + 64 * k: long + tail for k, tail in enumerate(["a b", "b a", "b a", "c c"])}
    texts[1 + 64 * 9] = "\n".join(["some title that goes on"] * 140)
    rows = agree("i09_fuzzy_join", texts)
    assert any(r["texts"] >= 3 and r["lines"] > r["texts"] for r in rows)


def test_chapters_of_many_headings(agree):
    """f21 cut at the first 180 headings of a document; its SQL has all, and a later one may be shallower."""
    texts = {0: "\n".join(f"line {k} of it" for k in range(64 * 40)), 1: "# late", 2: None, 3: ""}
    deep = ["## a"] + ["plain"] * 63
    texts[9 + 64] = "\n".join((deep * 30)[:1900] + ["# " + "x" * 40] * 64)
    rows = agree("f21_chapters", texts)
    assert max(r["first"] for r in rows if r["doc_id"] == 0) > 2000


def test_ranges_of_many_headings(agree):
    """f10 had the ranges of the first 180 headings of a page alone, the last of them up to the end."""
    rows = agree("f10_chapter_ranges", {1: "".join(f"<h{1 + k % 3}>Title {k}</h{1 + k % 3}><p>said {k}</p>" for k in range(400)), 2: "<h1>One</h1><p>x</p>"}, "pages")
    assert [r["title"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["ord"]))] == [f"Title {k}" for k in range(400)] + ["One"]


def test_all_slides_are_read():
    """a11 read eighty slides at most; a text gives one a line."""
    made = office.stored_zip([(f"ppt/slides/slide{n}.xml", f"<a:p>said {n}</a:p>".encode()) for n in (1, 2, 100, 9, 81, 1200)] + [("ppt/slides/slide03.xml", b"<a:p>no</a:p>"), ("ppt/slides/slide4.xml", b"")])
    assert office.slides(made) == "".join(f"## Slide {n}\n\nsaid {n}\n" + "\n" * (n != 1200) for n in (1, 2, 9, 81, 100, 1200))[:-1] + "\n"
    assert office.slides(b"no zip file") is None and office.slides(office.stored_zip([])) is None
    assert office.slides(office.stored_zip([("ppt/slides/slide1.xml", b""), ("ppt/slides/slide2.xml", b"<a:p>b</a:p>")])) is None


def test_slides_hold_whole_texts(spark, tmp_path):
    rows = [(0, "\n".join(f"line {k} & more" for k in range(300)), "en", "src1", 0), (1, "one", "en", "src1", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.text for r in queries_passes.QUERIES["a11_slides"](spark, str(tmp_path)).collect()}
    assert [x for x in got["/in/0.pptx"].split("\n") if x and not x.startswith("## ")] == [f"line {k} & more" for k in range(300)]
    assert got["/in/0.pptx"].count("## Slide ") == 300 and got["/in/1.pptx"] == "## Slide 1\n\none\n"


def test_hit_lines_of_odd_paragraphs(agree):
    """Paragraphs of accents, other letters, no term in a line of its own, and more than 120 hits."""
    texts = {0: "the\nart of it\n\nof the\r\nand\r# the of\nof\nthe idiot. The of it! x", 1: "ÇLOWN of\nthé ôf", 2: None, 3: "", 4: "\n".join(["the of"] * 130), 5: "clown\nidiot", 6: "ВЕРА the\nof", 7: "t\nhe of\nclo\nwn", 8: "  <!-- the of -->\n \nCLOWN"}
    rows = agree("g05_hit_lines", texts)
    assert sum(r["doc_id"] == 4 for r in rows) == 120 and {r["line_no"] for r in rows if r["doc_id"] == 1} == {0, 1}


def test_hit_lines_of_a_long_text(spark):
    """Lines of a text were split again for each line looked at: 2,000 took 12 s, 4,000 over 40."""
    docs = spark.createDataFrame([(0, "\n\n".join(["é the of it", "plain line"] * 1000))], "doc_id long, text string")
    began = time.monotonic()
    assert retrieval.hit_lines(docs, "(the of OR clown) NOT idiot", 5000).count() == 1000
    assert time.monotonic() - began < 20


def test_page_marks_of_long_lines(spark):
    """A line's characters were gone through from its beginning for each of its grams: one of 120,000 took 36 s."""
    text = "\n".join(["word and more of it " * 6000, "a needle that stands in one line alone", "x" * 16])
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    pages = spark.createDataFrame([(0, 0, "needle that stands in one line"), (0, 1, "x" * 24)], "doc_id long, page int, text string")
    began = time.monotonic()
    assert sorted((r.page, r.at) for r in stitching.page_marks(pages, relations.lines(docs)).collect()) == [(0, 1), (1, 2)]
    assert time.monotonic() - began < 20
