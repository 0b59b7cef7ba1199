"""A reader of one text followed in its pair: where a line of one stands in the other.

A line is in the section of the heading above it. That heading's counterpart in the other text gives the
section there; where both sections hold the same page, that page's part. The line's share of its
section, or of its page's part, is its share of the other. Sections and pages are paired by joins of
the few headings and marks; lines only look up the heading and the mark above, in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .outline import headings
from .scan import CHUNK, nearest


def interpolated(line: Column, start: Column, end: Column, to: Column, past: Column) -> Column:
    """The line between ``to`` and ``past`` at the share that ``line`` has between ``start`` and ``end``."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (line - start) / F.greatest(F.lit(1), end - start)))
    return (to + F.floor(F.greatest(F.lit(0), past - to) * share)).cast("int")


def _sections(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, level, nth, key, line, end): headings with the line at which the next one stands."""
    size = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n"))
    h = headings(lines).join(size, "doc_id")
    order = W.partitionBy("doc_id").orderBy("ord")
    return h.select("doc_id", "ord", "level", F.row_number().over(W.partitionBy("doc_id", "level").orderBy("ord")).alias("nth"), F.lower("title").alias("key"), F.col("line_no").alias("line"), F.coalesce(F.lead("line_no").over(order), "n").alias("end"), "n")


def _marks(lines: DataFrame) -> DataFrame:
    """(doc_id, page, start, next): the first mark of each page, and the mark after it, of any page."""
    marks = lines.select("doc_id", F.col("line_no").alias("start"), T.page_comment(F.col("text")).alias("page")).where("page is not null")
    told = marks.withColumn("next", F.lead("start").over(W.partitionBy("doc_id").orderBy("start")))
    return told.groupBy("doc_id", "page").agg(F.min(F.struct("start", "next")).alias("m")).select("doc_id", "page", "m.start", "m.next")


def counterparts(own: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, ord, key): of each heading the title of that at the same place among those of its level in the
    other outline, else at the same place of all."""
    level = other.select("doc_id", "level", "nth", F.col("key").alias("at_level"))
    place = other.select("doc_id", "ord", F.col("key").alias("at_place"))
    both = own.select("doc_id", "ord", "level", "nth").join(level, ["doc_id", "level", "nth"], "left").join(place, ["doc_id", "ord"], "left")
    return both.select("doc_id", "ord", F.coalesce("at_level", "at_place").alias("key")).where("key is not null")


def followed(lines: DataFrame, others: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, other): the line of the text in ``others`` that each line of ``lines`` stands for, both
    (doc_id, line_no, text); null where neither a heading nor a page leads there.

    The section there is that of the heading with the same title, else of the counterpart of the first
    heading so named, else of this one's; without any, that of the page's mark.
    """
    own, other = written(_sections(lines), "sections"), written(_sections(others), "others")
    title = F.lower(T.heading_text(F.col("text")))
    first = written(others.select("doc_id", F.col("line_no").alias("line"), title.alias("key")).where("key is not null").groupBy("doc_id", "key").agg(F.min("line").alias("line")), "titles")
    pair = counterparts(own, other).join(first, ["doc_id", "key"]).select("doc_id", "ord", F.col("line").alias("pair"))
    named = own.groupBy("doc_id", "key").agg(F.min("ord").alias("ord")).join(pair, ["doc_id", "ord"]).select("doc_id", "key", F.col("pair").alias("named"))
    to = own.join(first.withColumnRenamed("line", "same"), ["doc_id", "key"], "left").join(named, ["doc_id", "key"], "left").join(pair, ["doc_id", "ord"], "left")
    to = to.select("doc_id", "ord", F.col("line").alias("start"), F.greatest(F.col("end"), F.col("line") + 1).alias("end"), F.coalesce("same", "named", "pair").alias("to"))
    heads = own.select("doc_id", F.col("line").alias("line_no"), F.col("ord").alias("own_ord"))
    told = lines.select("doc_id", "line_no", T.page_comment(F.col("text")).alias("own_page")).join(heads, ["doc_id", "line_no"], "left")
    told = nearest(told, {"ord": F.col("own_ord"), "page": F.col("own_page")}, chunk=chunk)
    told = told.select("doc_id", "line_no", F.coalesce("own_ord", "ord").alias("ord"), F.coalesce("own_page", "page").alias("page"))
    marks, there = _marks(lines), written(_marks(others), "pages")
    sizes = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n"))
    there_sizes = others.groupBy("doc_id").agg((F.max("line_no") + 1).alias("past"))
    at = told.join(to, ["doc_id", "ord"], "left").join(sizes, "doc_id").join(there_sizes, "doc_id", "left")
    at = at.join(there.select("doc_id", "page", F.col("start").alias("page_to"), F.col("next").alias("page_past")), ["doc_id", "page"], "left")
    at = at.join(marks.select("doc_id", "page", F.col("start").alias("page_start"), F.col("next").alias("page_end")), ["doc_id", "page"], "left")
    at = at.withColumn("to", F.coalesce("to", "page_to"))
    inside = other.select("doc_id", F.col("line").alias("in_start"), F.col("end").alias("in_end"), F.col("n").alias("in_n"))
    places = at.select("doc_id", "to").where("to is not null").distinct()
    last = F.col("in_end") == F.col("in_n")
    sections = places.join(inside, "doc_id").where((F.col("to") >= F.col("in_start")) & ((F.col("to") < F.col("in_end")) | last)).groupBy("doc_id", "to").agg(F.max(F.struct("in_start", "in_end")).alias("s"))
    at = at.join(sections, ["doc_id", "to"], "left")
    start, end = F.coalesce("start", F.lit(0)), F.coalesce("end", F.greatest("n", F.col("line_no") + 1))
    to_start = F.coalesce("s.in_start", "to")
    to_end = F.when(F.col("s").isNotNull(), F.greatest(F.col("s.in_end"), F.col("s.in_start") + 1)).otherwise(F.greatest(F.col("past"), F.col("to") + 1))
    at = at.select("doc_id", "line_no", "to", "page_start", "page_end", "page_to", "page_past", start.alias("start"), end.alias("end"), to_start.alias("to_start"), to_end.alias("to_end"))
    paged = F.coalesce((F.col("page_start") < F.col("end")) & (F.col("page_to") < F.col("to_end")), F.lit(False))
    until = lambda nxt, begin, stop: F.greatest(F.when(F.col(nxt) < F.col(stop), F.col(nxt)).otherwise(F.col(stop)), F.col(begin) + 1)
    pick = lambda a, b: F.when(paged, a).otherwise(b)
    line = interpolated(F.col("line_no"), pick(F.col("page_start"), F.col("start")), pick(until("page_end", "page_start", "end"), F.col("end")), pick(F.col("page_to"), F.col("to_start")), pick(until("page_past", "page_to", "to_end"), F.col("to_end")))
    return at.select("doc_id", "line_no", F.when(F.col("to").isNotNull(), line).alias("other"))
