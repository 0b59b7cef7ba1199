"""Steps whose cost must not grow beyond the input: plans and batches, on small tables."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
from pyspark.util import PythonEvalType

import __spark_entry__
from docloom.functions import text as T
from docloom.operators import lexicon, matching, outline, reading, scan, shelf, stitching
from docloom.passes import lines as L
from docloom.passes import tidy
from docloom.passes.spark import rows_of
from docloom.sources import office


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, texts):
    return spark.createDataFrame([(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))], "doc_id long, line_no int, text string")


BOOKS = ["## Corrupted and\n\nWhy It Is\n```\nx\n```\n\n\n\nso on", "a king-\ndom\n<!-- page 1 -->\n## A\n<!-- page 1 -->\nA\nb"]


def test_no_line_table_is_sent_to_all(spark):
    own = lines(spark, BOOKS)
    for edits in (scan.hyphens, scan.repeated_marks, scan.blank_runs, scan.subheadings, scan.joined_headings):
        made = edits(own)
        assert "BroadcastExchange" not in plan(made), edits.__name__
    assert "BroadcastExchange" not in plan(scan.line_map(own, scan.blank_runs(own)))


def test_no_words_or_lines_of_split_words_are_sent_to_all(spark):
    own = lines(spark, ["when when when\nwh en it Wh en\nwh en wh en wh en\n```\nwh en\n```\n<!-- wh en -->\nthe wh  en, wh en. En wh en", "Wh enx wh en\nxwh en"])
    words = lexicon.lexicon(own)
    split, odd = lexicon.split_pairs(own, words), lexicon.suspects(own, words)
    # the pairs that hold may be sent, which are few; a pair of that kind is the only thing in a broadcast
    assert plan(split).count("BroadcastExchange") <= 1 and plan(odd).count("BroadcastExchange") <= 1
    assert "BroadcastExchange" not in plan(lexicon.with_neighbours(own.select("doc_id", "line_no"), own))
    assert sorted((r.doc_id, r.line_no, r.at) for r in split.collect()) == []
    fewer = spark.createDataFrame([("when", 3), ("it", 3)], "word string, times long")
    got = sorted((r.doc_id, r.line_no, r.at, r.first, r.second) for r in lexicon.split_pairs(own, fewer).collect())
    assert got == [(0, 1, 0, "wh", "en"), (0, 1, 6, "Wh", "en"), (0, 2, 0, "wh", "en"), (0, 2, 4, "wh", "en"), (0, 2, 8, "wh", "en"), (0, 7, 6, "wh", "en"), (0, 7, 12, "wh", "en")] + [(1, 0, 4, "wh", "en")]
    assert {(r.doc_id, r.line_no) for r in lexicon.suspects(own, fewer).collect()} == {(0, 1), (0, 2), (0, 4), (0, 7), (1, 0), (1, 1)}


class _Docs:
    """A table that keeps the step it is given."""

    def __init__(self, spark):
        self.empty = spark.createDataFrame([], "doc_id long, text string")

    def select(self, *columns):
        return self.empty.select(*columns) if columns == ("doc_id",) else self

    def mapInArrow(self, run, made):
        self.run = run


def test_passes_hold_few_texts(spark):
    docs = _Docs(spark)
    rows_of(docs, lambda x: [(x * 2,)], "value string", "text")
    big = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["x" * 100_000] * 99 + [None]})
    made = list(docs.run(iter([big])))
    assert max(b.nbytes for b in made) < 2 << 20
    assert [v for b in made for v in b.column(0).to_pylist()] == list(range(99))
    assert all(v == "x" * 200_000 for b in made for v in b.column(1).to_pylist())


def test_sample_files_come_a_few_at_a_time(spark):
    docs = spark.createDataFrame([(i, None if i == 7 else f"a{i}\nb") for i in range(50)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r.f for r in docs.select("doc_id", office.sample("pptx")(docs.text).alias("f")).collect()}
    assert len(rows) == 50 and rows[7] is None
    assert all(office.converted(f"/in/{i}.pptx", bytes(f)) for i, f in rows.items() if f is not None)
    assert office.sample("pptx").evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


def oracle(name, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_paired_titles_keep_the_sharp_s(spark, tmp_path):
    text = "\n".join(["Beß ﬁ x"] * 64)
    spark.createDataFrame([(i, text, "de", "s", len(text)) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["f16_paired_titles"](spark, str(tmp_path)).collect())
    assert got == oracle("f16_paired_titles", tmp_path) and any("BEẞ" in r[2] for r in got)
    words = spark.createDataFrame([("aßΐ𝒶ﬁ",), ("",), (None,)], "w string")
    assert [r[0] for r in words.select(T.upper_letters(words.w)).collect()] == ["Aẞΐ𝒶ﬁ", "", None]


def test_pairs_of_an_origin_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(shelf, "DEAL", 3)
    # repeated ids, one of them with two cards, and a name and a source that many share
    given = [(i, f"/a/{i % 2}.md", "/s" if i % 3 else "") for i in range(12)] + [(3, "/b/9.md", "/t"), (4, "/a/0.md", "/s"), (20, "/b/9.md", "/s"), (None, "/b/9.md", "/s")]
    cards = spark.createDataFrame(given, "id long, markdown_path string, source_path string")
    made = shelf.origin_pairs(cards)
    has = {}
    for i, path, source in given:
        has.setdefault(i, set()).update({path} | ({source} - {""}))
    has.pop(None)
    assert sorted(map(tuple, made.collect())) == sorted((a, b) for a in has for b in has if a != b and has[a] & has[b])
    assert not any("id#" in x and "mate#" in x for x in plan(made).splitlines() if "Exchange" in x or "HashAggregate" in x)


def test_lines_of_page_marks_are_exchanged_once(spark, monkeypatch):
    monkeypatch.setattr(stitching, "STRETCH", 2)
    text = "It was a long and winding road\nthat went down to the sea\nno\nand then we came to the old harbour wall again\nthe old harbour wall"
    own = lines(spark, [text, text, "<!-- page 1 -->\n<!-- page 2 -->\nthe old harbour wall"])
    pages = spark.createDataFrame([(0, 0, "winding road that goes"), (0, 1, "the old harbour wall"), (0, 2, "x"), (1, 0, "so that went down to the sea at last"), (2, 0, "the old harbour wall")], "doc_id long, page int, text string")
    made = stitching.page_marks(pages, own)
    got = sorted((r.doc_id, r.page, r.at) for r in made.collect())
    assert got == [(0, 0, 1), (0, 1, 3), (0, 2, 5), (1, 0, 1)]
    sizes = spark.createDataFrame([(0, 5), (1, 5)], "doc_id long, n int")
    found = stitching._needle_lines(pages.withColumnRenamed("text", "needle"), sizes, own)
    assert "BroadcastExchange" not in plan(found) and "BroadcastExchange" not in plan(made)
    assert sorted(map(tuple, found.select("doc_id", "line_no", "needle").collect())) == [(0, 3, "the old harbour wall"), (0, 4, "the old harbour wall"), (1, 1, "so that went down to the sea at last")]


def test_a_long_line_is_gone_through_once(monkeypatch):
    real, seen = tidy.cut, []
    monkeypatch.setattr(tidy, "cut", lambda line, usual, limit: (seen.append(len(line) - limit), real(line, usual, limit))[1])
    rng = random.Random(7)
    for n in [0, 1, 30, 95, 96, 97, 110, 120, 140, 141] + [rng.randrange(60, 900) for _ in range(400)]:
        line = "".join(rng.choice(["word", "a", "longer", " ", " ", "  ", ". ", ", ", "\u00a0", "x" * 40]) for _ in range(n // 4))
        rest, parts, free = L.trim(line), [], tidy.prose(L.trim(line)) and len(L.trim(line)) > 99
        while free and len(rest) > 99 and (at := real(rest, 68, 99)) is not None:
            a, b = L.trim(rest[:at]), L.trim(rest[at:])
            if len(a) < 12 or len(b) < 12:
                break
            parts.append(a)
            rest = b
        usual = tidy.usual_length([line])
        if max(usual + 28, int(usual * 1.45 + 0.5)) != 99:
            continue
        want = [p if k else line[: len(line) - len(line.lstrip(" \t"))] + p for k, p in enumerate(parts + ([rest] if rest else []))] if free else [line]
        assert tidy.long_lines([line]).lines == want
    assert seen and max(seen) <= 32


FRONT = ["---\n# a\n---\n# b\n---\n# c", "# a\n---\n# b\n---\n# c", "---\n# a", "x\n" * 38 + "---\n---\n---\n# a", " --- \n## a\n" + "x\n" * 39 + "---\n## b", "---\n### a\n  ---\n<!--ym-tr-->## b\n## Page 3\n# Outline\n#", ""]


def test_headings_read_their_lines_once(spark):
    own = lines(spark, FRONT)
    found = outline.headings(own)
    assert plan(found).count("Scan") == 1
    said = {d: [r.title for r in sorted(found.collect(), key=lambda r: r.ord) if r.doc_id == d] for d in range(len(FRONT))}
    assert said == {0: ["b", "c"], 1: ["a", "b", "c"], 2: ["a"], 3: ["a"], 4: ["a", "b"], 5: ["b"], 6: []}


def test_no_gram_or_key_of_all_lines_is_exchanged(spark, monkeypatch):
    own = lines(spark, ["## One\nof Two things here\n# Two\nThree\nand three\n<!-- page 2 -->\nNot there, of two things", "One\nTwo\n\nThree of them"])
    marks = spark.createDataFrame([(d, i, x, 1, p) for d in (0, 1) for i, (x, p) in enumerate([("One", None), ("two things", 2), ("Three", None), ("Not there", 1)])], "doc_id long, ord int, title string, level int, page int")
    monkeypatch.setattr(matching, "_grams", None)  # a gram of each place in a line was exchanged
    placed = {(r.doc_id, r.title): (r["at"], r["head"]) for r in stitching.placed(marks, own).collect()}
    assert placed == {(0, "One"): (0, True), (0, "two things"): (1, False), (0, "Three"): (3, False), (0, "Not there"): (6, False), (1, "One"): (0, False), (1, "two things"): (1, False), (1, "Three"): (3, False), (1, "Not there"): (4, False)}
    assert {(r.doc_id, r.line_no) for r in matching.lines_saying(outline.headings(own), own).collect()} == {(0, 0), (0, 2)}
    assert "array_contains" in plan(stitching.anchors(marks, own))


def test_titles_meet_every_stretch_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(matching, "STRETCH", 2)
    own = lines(spark, ["a title\nx\nx\nthe a title\nx\nx\na title so"])
    asked = spark.createDataFrame([(0, "a title", 7), (0, "", 7)], "doc_id long, needle string, size int")
    assert sorted(r.line_no for r in matching.said_in_document(asked, own).collect()) == [0, 6]


def test_placed_words_are_exchanged_once(spark):
    items = spark.createDataFrame([(0, 2.0, 9.0, "b"), (0, 1.0, 10.0, "a"), (0, 1.0, 1.0, " "), (1, 5.0, 0.0, "c")], "doc_id long, x double, y double, s string")
    held = reading.item_lines(items)
    assert plan(held).count("Exchange") == 1
    assert sorted(map(tuple, held.collect())) == [(0, 0, "a b"), (1, 0, "c")]
