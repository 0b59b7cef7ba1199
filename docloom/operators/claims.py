"""Outline entries and the headings of another text: equal titles by their occurrence, then what is left in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .outline import headings


def _zipped(marks: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, ord, line): entries and headings of a document by their rank."""
    a = marks.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
    b = heads.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("line")))
    return a.join(b, ["doc_id", "nth"]).select("doc_id", "ord", "line")


def claimed(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, line, how): the line of each entry of ``marks`` (doc_id, ord, title, page) in a translated text.

    The n-th entry of a title takes the n-th heading that says it (``title``). Entries left take the
    headings left, in order, page headings and that of the outline itself apart (``order``); the others the
    mark of their page (``page``), or no line.
    """
    t = T.heading_text(F.col("text"))
    heads = lines.select("doc_id", F.col("line_no").alias("line"), t.alias("title")).where("title is not null").withColumn("key", T.folded(F.col("title")))
    by = W.partitionBy("doc_id", "key")
    a = marks.where("title <> ''").select("doc_id", "ord", T.folded(F.col("title")).alias("key")).withColumn("nth", F.row_number().over(by.orderBy("ord")))
    b = heads.withColumn("nth", F.row_number().over(by.orderBy("line")))
    said = a.join(b, ["doc_id", "key", "nth"]).select("doc_id", "ord", "line")
    free = heads.where(~T.page_like(F.col("title")) & (F.lower("title") != "outline")).join(said, ["doc_id", "line"], "left_anti").select("doc_id", "line")
    rest = _zipped(marks.join(said, ["doc_id", "ord"], "left_anti").select("doc_id", "ord"), free)
    pages = lines.select("doc_id", "line_no", (T.page_comment(F.col("text")) - 1).alias("page")).where("page is not null").groupBy("doc_id", "page").agg(F.min("line_no").alias("at"))
    found = said.withColumn("how", F.lit("title")).unionByName(rest.withColumn("how", F.lit("order")))
    out = marks.select("doc_id", "ord", "page").join(found, ["doc_id", "ord"], "left").join(pages, ["doc_id", "page"], "left")
    return out.select("doc_id", "ord", F.coalesce("line", "at").alias("line"), F.coalesce("how", F.when(F.col("at").isNotNull(), "page")).alias("how"))


def relocated(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, line): the entries of an outline (doc_id, ord, title) in an edited text, each at the first
    heading of its title; the others in order at headings of the text that no entry has."""
    title = T.heading_text(F.col("text"))
    first = lines.select("doc_id", "line_no", F.lower(title).alias("key")).where("key is not null").groupBy("doc_id", "key").agg(F.min("line_no").alias("line"))
    said = marks.select("doc_id", "ord", F.lower("title").alias("key")).join(first, ["doc_id", "key"]).select("doc_id", "ord", "line")
    free = headings(lines).select("doc_id", F.col("line_no").alias("line")).join(said.select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    rest = _zipped(marks.join(said, ["doc_id", "ord"], "left_anti").select("doc_id", "ord"), free)
    return marks.select("doc_id", "ord").join(said.unionByName(rest), ["doc_id", "ord"], "left").select("doc_id", "ord", "line")
