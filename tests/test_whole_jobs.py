"""Queries take whole texts and all rows."""

import pytest

from docloom import queries_records

from .test_queries import QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    long = "\n".join(["x" * 300] * 40) + "\n" + "y" * 2500 + "\n![](data:image/png;base64,AA)"
    rows = [(i, f"Title {i % 7} of a card", ["en", "de"][i % 2], "src1", 0) for i in range(60)] + [(60, long, "en", "src1", 0), (61, "w " * 900 + "end", "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_texts_are_whole(spark, sf):
    chunks = QUERIES["c21_chunks"](spark, sf).where("doc_id = 60").collect()
    assert sum(r.n for r in chunks) >= 40 * 300 + 2500
    words = QUERIES["a19_item_lines"](spark, sf).where("doc_id = 61").collect()
    assert sum(len(r.text.split()) for r in words) == 901
    lines = {r.line_no: r.text for r in QUERIES["c01_reader_lines"](spark, sf).where("doc_id = 60").collect()}
    assert lines[0] == "x" * 300 and lines[39] == "x" * 300 and lines[40].startswith("_A picture") and lines[41].startswith("_A picture")
    assert lines[38] == "x" * 900


def test_all_rows_are_sorted(spark, sf):
    assert [r.id for r in QUERIES["o08_vault"](spark, sf).collect()] == list(range(60, -1, -1))
    rows = [(r.id, r.title.lower(), min(r.tags)) for r in queries_records._cards(spark, sf).collect()]
    key = {"manual": lambda r: r[0], "name": lambda r: r[1], "date": lambda r: r[0], "tag": lambda r: r[2]}
    for name in queries_records.SORTS:
        got = [r.id for r in QUERIES[f"k01_sorted_{name}"](spark, sf).collect()]
        falls = name in ("name_desc", "date_new", "tag_desc")
        assert got == [r[0] for r in sorted(sorted(rows), key=key[name.split("_")[0]], reverse=falls)], name
