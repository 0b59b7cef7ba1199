"""Reading order and pairing: text items to lines, front matter, page chrome by place, zips and line edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import library
from .outline import doc


def item_lines(items: DataFrame) -> DataFrame:
    """(doc_id, line, text): placed words (doc_id, x, y, s) in rows three units high, from the top, left to right.

    White space within a row is one blank; rows without words are left out.
    """
    # words are dealt by document before they are gathered, or each task would sort all that it reads to gather a part
    own = items.select("doc_id", (F.round(F.col("y") / 3) * 3).alias("row"), "x", "s").repartition("doc_id")
    held = own.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("x", "s"))).alias("r"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("r", lambda x: x.s), " "), r"\s+", " "))
    line = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("row"))) - 1
    return held.select("doc_id", "row", text.alias("text")).where("text <> ''").select("doc_id", line.alias("line"), "text")


#: What stands in the reader for a picture that is held in the text.
PICTURE = "_A picture is stored as a file in the figures folder (Finder)._"


def reader_lines(lines: DataFrame, most: int = 40_000, longest: int = 1_800) -> DataFrame:
    """The first ``most`` lines, cut at ``longest`` characters; pictures held in the text as a remark."""
    cut = F.when(F.length("text") > longest, F.concat(F.substring("text", 1, longest), F.lit("…"))).otherwise(F.col("text"))
    return lines.where(F.col("line_no") < most).select("doc_id", "line_no", F.when(F.contains("text", F.lit("data:image")), PICTURE).otherwise(cut).alias("text"))


def scanned(pages: DataFrame) -> DataFrame:
    """(doc_id, scan): of sampled pages at least half have under 2 text marks, or under 48 characters a page.

    ``pages`` is (doc_id, page from 0, chars, ops); sampled are the first two, the third of over 8, the
    half, the three quarters and the last.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    p = F.col("page")
    chosen = p.isin(0, 1) | ((p == 2) & (F.col("n") > 8)) | (p == F.floor(F.col("n") / 2)) | (p == F.floor(F.col("n") * 3 / 4)) | (p == F.col("n") - 1)
    s = pages.join(n, "doc_id").where(chosen).groupBy("doc_id").agg(F.count("*").alias("k"), F.sum((F.col("ops") < 2).cast("int")).alias("thin"), F.sum("chars").alias("chars"))
    return s.select("doc_id", ((F.col("thin") * 2 >= F.col("k")) | (F.col("chars") < 48 * F.col("k"))).alias("scan"))


def body_starts(lines: DataFrame) -> DataFrame:
    """(doc_id, start): the line after front matter that closes within 40 lines, and after one blank line."""
    t = T.trim(F.col("text"))
    marks = lines.where("line_no <= 41").groupBy("doc_id").agg(
        F.max(F.when((F.col("line_no") == 0) & (t == "---"), 1)).alias("open"), F.min(F.when((F.col("line_no") > 0) & (F.col("line_no") <= 40) & (t == "---"), F.col("line_no"))).alias("close")
    )
    after = lines.select("doc_id", (F.col("line_no") - 1).alias("close"), (t == "").alias("blank"))
    got = marks.join(after, ["doc_id", "close"], "left")
    return got.select("doc_id", F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.col("close") + 1 + F.coalesce(F.col("blank"), F.lit(False)).cast("int")).otherwise(0).alias("start"))


def opening_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines that are not blank of the first two marked pages, 160 at most, or
    the first 80 where no page is marked before them."""
    t = T.trim(F.col("text"))
    mark = F.startswith(t, F.lit("<!-- page ")) & F.endswith(t, F.lit("-->"))
    told = lines.withColumns({"mark": mark, "pages": F.sum(mark.cast("int")).over(doc())}).where((t != "") & (F.col("pages") <= 2))
    told = told.withColumn("n", F.sum((~F.col("mark")).cast("int")).over(doc())).where("not mark and n <= 160")
    at80 = F.max(F.when(F.col("n") == 80, F.col("pages"))).over(W.partitionBy("doc_id"))
    return told.withColumn("at80", at80).where("n <= 80 or at80 > 0").select("doc_id", "line_no", "text")


def place_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[0-9./:-]+", "#"))


def edge_chrome(pages: DataFrame) -> DataFrame:
    """(doc_id, key, times): first and last two lines of each page, digits alike, on 0.45 of the pages.

    ``pages`` is (doc_id, page, lines as an array); a short page gives a line twice.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    k = F.size("lines")
    ends = F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(k - 1, F.lit(1)), 2))
    keyed = pages.select("doc_id", F.explode(ends).alias("t")).select("doc_id", place_key(F.col("t")).alias("key")).where((F.length("key") >= 4) & (F.length("key") < 70))
    counts = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    return counts.join(n, "doc_id").where((F.col("n") >= 3) & (F.col("times") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.45)))).select("doc_id", "key", "times")


def guarded(before: Column, after: Column) -> Column:
    """The tidied text, or the original where too little is left, white space at the ends apart."""
    size = lambda c: F.length(F.regexp_replace(c, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", ""))
    a, b = size(before), size(after)
    lost = (b < 40) | ((a > 200) & (b < F.floor(a / 5)))
    return F.when(lost, before).otherwise(after)


def edit_map(lines: DataFrame, dropped: Column) -> DataFrame:
    """(doc_id, old_line, new_line): a dropped line goes back to the last kept, at the start to the first."""
    told = lines.withColumn("kept", ~dropped)
    at = F.sum(F.col("kept").cast("int")).over(doc().rowsBetween(W.unboundedPreceding, 0)) - 1
    return told.select("doc_id", F.col("line_no").alias("old_line"), F.greatest(at, F.lit(0)).cast("int").alias("new_line"))


def fences(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, inside): within a fence that either mark opens and closes."""
    mark = T.trim(F.col("text")).rlike("^(```|~~~)")
    upto = F.coalesce(F.sum(mark.cast("int")).over(doc().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.select("doc_id", "line_no", (upto % 2 == 1).alias("inside"))


def first_of_each(lines: DataFrame) -> DataFrame:
    """Lines met for the first time in their document."""
    r = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("line_no"))
    return lines.withColumn("r", r).where("r = 1").select("doc_id", "line_no", "text")


def natural_key(c: Column) -> Column:
    """Numbers in a name by value."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "([0-9]+)", "0000000000$1"), "[0-9]*([0-9]{10})", "$1")


def zipped(text: Column, other: Column) -> Column:
    """Each paragraph with that of the other text below it as a quote, unless they are equal."""
    a, b = F.split(text, "\n{2,}"), F.split(other, "\n{2,}")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: F.struct(F.get(a, i).alias("a"), F.get(b, i).alias("b")))
    quote = lambda p: F.when((p["b"] != "") & ~p["b"].eqNullSafe(p["a"]), F.concat(F.lit("> "), F.replace(p["b"], F.lit("\n"), F.lit("\n> "))))
    parts = F.flatten(F.transform(pairs, lambda p: F.array(F.when(p["a"] != "", p["a"]), quote(p))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")


def figure_name(line: Column) -> Column:
    """File name of the picture that a line begins with; null for other lines."""
    t = T.trim(line)
    path = F.regexp_extract(t, r"(?s)^!\[.*?\]\(([^)]*)\)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "(?s) .*$", ""), "^[\"' ]+|[\"' ]+$", "")
    name = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when(name != "", name).when(path.rlike("^/+$"), F.lit("/"))


def ordered_pair(path: Column, other: Column) -> Column:
    """Whether ``path`` comes first of a pair: the original before its translation, else the shorter name."""
    base, a, b = F.lower(library.pairing_stem(path)), library.stem(path), library.stem(other)
    return F.when(F.lower(a) == base, True).when(F.lower(b) == base, False).otherwise(F.length(a) <= F.length(b))
