"""Headings, sections, pages and trees: document-local windows, so a document is the unit of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T


def doc() -> WindowSpec:
    """The lines of a document in order."""
    return W.partitionBy("doc_id").orderBy("line_no")


def candidates() -> Column:
    """Whether ``headings`` looks at a line: all with a mark, and those that may open or close front matter."""
    return F.contains("text", F.lit("#")) | (F.contains("text", F.lit("---")) & (F.col("line_no") <= 40))


def headings(lines: DataFrame, cap: int | None = 180) -> DataFrame:
    """(doc_id, ord, line_no, level, title): levels 1 to 3; front matter that closes within 40 lines, page-like
    titles and the outline's own are left out; the first ``cap`` of a document, or all."""
    # one scan: headings and the lines that may open or close front matter; few lines are looked at by patterns
    told = lines.where(candidates())
    rule = F.coalesce((F.col("line_no") <= 40) & (T.trim(F.col("text")) == "---"), F.lit(False))
    told = told.select("doc_id", "line_no", T.heading_text(F.col("text")).alias("title"), F.least(T.heading_marks(F.col("text")), F.lit(3)).alias("level"), rule.alias("rule"))
    told = told.where(F.col("rule") | (F.col("title").isNotNull() & ~T.page_like(F.col("title")) & (F.col("title") != "Outline")))
    own, line = W.partitionBy("doc_id"), F.when(F.col("rule"), F.col("line_no"))
    told = told.withColumns({"open": F.min(line).over(own), "close": F.min(F.when(F.col("line_no") > 0, line)).over(own)})
    h = told.where("not rule and not (open <=> 0 and close is not null and line_no <= close)")
    h = h.withColumn("ord", F.row_number().over(doc()))
    return (h if cap is None else h.where(F.col("ord") <= cap)).select("doc_id", "ord", "line_no", "level", "title")


def paired_titles(main: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, title, other): titles (doc_id, ord, title) of two outlines by place, then those left of the
    first by equal name."""
    o = other.select("doc_id", "ord", F.col("title").alias("other"))
    placed = main.join(o, ["doc_id", "ord"]).select("doc_id", "ord", "title", "other")
    used = placed.select("doc_id", F.lower("title").alias("key")).distinct()
    left = main.join(o.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").withColumn("key", F.lower("title")).join(used, ["doc_id", "key"], "left_anti")
    left = left.groupBy("doc_id", "key").agg(F.min_by("title", "ord").alias("title"))
    first = o.groupBy("doc_id", F.lower("other").alias("key")).agg(F.min_by("other", "ord").alias("other"))
    return placed.select("doc_id", "title", "other").unionByName(left.join(first, ["doc_id", "key"]).select("doc_id", "title", "other"))


def sections(lines: DataFrame, *, any_level: bool = False, cap: int | None = 180) -> DataFrame:
    """(doc_id, title, level, first, last): to the next heading of the same or a higher level, or the end.

    With ``any_level`` the next heading of any level ends a section. The first ``cap`` headings count, or all.
    """
    h = headings(lines, cap)
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("end"))
    if any_level:
        nxt = F.lead("line_no").over(doc())
        cut = h.withColumn("nxt", nxt)
    else:  # the headings of a document are few: those after it, in order, until one that is no deeper
        later = F.collect_list(F.struct("line_no", "level")).over(doc().rowsBetween(1, W.unboundedFollowing))
        cut = h.withColumn("later", later).withColumn("nxt", F.get(F.filter("later", lambda x: x.level <= F.col("level")), F.lit(0))["line_no"])
    return cut.join(n, "doc_id").select("doc_id", "ord", "title", "level", F.col("line_no").alias("first"), F.coalesce(F.col("nxt") - 1, "end").cast("int").alias("last"))


def section_at(lines: DataFrame) -> DataFrame:
    """As-of: the title that each line stands under, and that of the page at or above it."""
    h = T.heading_text(F.col("text"))
    title = F.last(F.when(h.isNotNull() & ~T.page_like(h), h), ignorenulls=True).over(doc().rowsBetween(W.unboundedPreceding, 0))
    page = F.last(T.page_comment(F.col("text")), ignorenulls=True).over(doc().rowsBetween(W.unboundedPreceding, 0))
    return lines.select("doc_id", "line_no", title.alias("section"), page.alias("page"))


def page_starts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, first, last) of each marked page; the first mark of a number holds."""
    marks = lines.select("doc_id", "line_no", T.page_comment(F.col("text")).alias("page")).where("page is not null")
    first = marks.groupBy("doc_id", "page").agg(F.min("line_no").alias("first"))
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("end"))
    nxt = F.lead("first").over(W.partitionBy("doc_id").orderBy("first"))
    return first.withColumn("nxt", nxt).join(n, "doc_id").select("doc_id", "page", "first", F.coalesce(F.col("nxt") - 1, "end").cast("int").alias("last"))


def tree(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, title, parent): the parent is the nearest earlier heading of a lower level."""
    h = headings(lines)
    earlier = F.collect_list(F.struct("ord", "level")).over(doc().rowsBetween(W.unboundedPreceding, -1))
    up = F.filter(earlier, lambda x: x.level < F.col("level"))
    return h.withColumn("up", up).select("doc_id", "ord", "title", F.when(F.size("up") > 0, F.element_at("up", -1)["ord"]).alias("parent"))


def slugs(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, slug): lower case and dashes; ``h-`` before what begins with a number or xml, and
    -2, -3 and so on until no earlier slug of the document is equal."""
    s = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}\p{M}]+", "-"), "^-+|-+$", "")
    base = F.when(s == "", "h-section").when(s.rlike(r"^(xml|\p{N})"), F.concat(F.lit("h-"), s)).otherwise(s)
    held = headings(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", base.alias("base")))).alias("h"))

    def step(used: Column, h: Column) -> Column:
        free = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.size(used) + 3), lambda n: F.concat_ws("-", h["base"], n.cast("string"))), lambda c: ~F.array_contains(used, c)), F.lit(0))
        return F.array_append(used, F.when(F.array_contains(used, h["base"]), free).otherwise(h["base"]))

    made = held.withColumn("s", F.aggregate("h", F.array().cast("array<string>"), step))
    return made.select("doc_id", F.explode(F.arrays_zip("h", "s")).alias("x")).select("doc_id", F.col("x.h.ord").alias("ord"), F.col("x.s").alias("slug"))


def chapters(lines: DataFrame) -> DataFrame:
    """(doc_id, first, title): cut at the shallowest level present; front matter if any line before is not blank.

    All headings count, however many a document has.
    """
    h = headings(lines, None)
    top = h.groupBy("doc_id").agg(F.min("level").alias("level"))
    cuts = h.join(top, ["doc_id", "level"]).select("doc_id", F.col("line_no").alias("first"), "title")
    start = cuts.groupBy("doc_id").agg(F.min("first").alias("start"))
    front = lines.join(start, "doc_id").where((F.col("line_no") < F.col("start")) & (T.trim(F.col("text")) != "")).select("doc_id").distinct()
    return cuts.unionByName(front.select("doc_id", F.lit(0).alias("first"), F.lit("Front matter").alias("title")))


def level_ordinals(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, level, nth): the place of each heading among those of its level."""
    return headings(lines).select("doc_id", "ord", "level", F.row_number().over(W.partitionBy("doc_id", "level").orderBy("ord")).alias("nth"))


def changed_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section): lines at which the heading above is another than before."""
    at = section_at(lines)
    before = F.lag("section").over(doc())
    return at.withColumn("before", before).where(F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("before"))).select("doc_id", "line_no", "section")
