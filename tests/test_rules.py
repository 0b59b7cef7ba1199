"""Golden cases of the line rules and of cleanup passes, and streams against their batch form."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import cleanup, library, tables
from docloom.streaming import changes


@pytest.mark.parametrize(
    ("rule", "line", "value"),
    [
        (T.numbered_heading, "8.1 Controls and Indicators", "## 8.1 Controls and Indicators"), (T.numbered_callout, "1 Engine Fire Switches", "**1 Engine Fire Switches**"),
        (T.contents_entry, "Chapter 1: Title ........ 13", "Chapter 1: Title|13"), (T.heading_text, "#Title", "Title"), (T.heading_text, "####### x", None), (T.atx_heading, "#Title", None),
        (T.roman, "XIV.", True), (T.roman, "IIX", False), (T.valid_isbn, "ISBN 978-0-306-40615-7", "9780306406157"), (T.valid_isbn, "0-306-40615-2", "0306406152"), (T.valid_isbn, "978-0-306-40615-8", None),
        (T.tag_slug, " ##My Tag! ", "my-tag"), (T.language_tag, "en-US", "en-us"), (T.language_tag, "und", None), (T.page_like, "Seite 12", True), (T.tracked, "Y O U R G I F T", True),
        (T.close_gap, "a   b 12", "a b  12"), (T.home_scrubbed, "/Users/me/x", "/Users/<user>/x"), (T.home_scrubbed, "/home/me/x", "/home/me/x"), (T.heading_text, None, None),
    ],
)
def test_rule(spark, rule, line, value):
    assert spark.createDataFrame([(line,)], "s string").select(rule(F.col("s")).alias("v")).first().v == value


def test_drop_caps_and_maps(spark):
    rows = [(1, 0, "T"), (1, 1, "he final"), (1, 2, "12"), (1, 3, "end"), (1, 4, "7"), (2, 0, "3")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    assert [r.text for r in cleanup.drop_caps(lines).orderBy("doc_id", "line_no").collect()] == ["The final", "12", "end", "7", "3"]
    kept = cleanup.hidden_page_numbers(lines)
    got = {(r.doc_id, r.old_line): r.new_line for r in cleanup.line_map(lines, kept).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 2, (2, 0): 0}


def test_tables_and_names(spark):
    line = spark.createDataFrame([("| a |  | b |",), ("|---|:-:|",)], "s string")
    assert [list(r.c) for r in line.select(tables.cells(F.col("s")).alias("c")).collect()] == [["a", "", "b"], ["---", ":-:"]]
    assert [r.x for r in line.select(tables.separator(F.col("s")).alias("x")).collect()] == [False, True]
    cards = spark.range(1000).withColumn("p", F.lit("same"))
    names = {r.id: r.name for r in library.unique_names(cards, F.col("p")).collect()}
    assert names[0] == "same" and names[1] == "same-2" and names[999] == "same-1000"


def test_stream_of_changes(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.floor(F.col("id") / 20).cast("double").alias("value"), F.col("id").alias("event_id"))
    batch = changes.changes(rows)
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = changes.watch(spark, f"{tmp_path}/in", "path string, ts timestamp, fingerprint double, event_id long")
    q = changes.real_changes_stream(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("seen").collect()) == sorted(r.event_id for r in changes.real_changes(batch).collect())
