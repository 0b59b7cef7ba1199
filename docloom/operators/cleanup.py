"""Cleanup passes over lines: repeated chrome, page numbers, drop caps, and the line maps they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .outline import doc


def with_chrome_key(lines: DataFrame) -> DataFrame:
    """``lines`` with ``key``, that of a line which may be a running header: 2 to 14 words with a letter or
    a web address, 80 characters at most. In steps, so that each rule is computed once a line."""
    steps = lines.withColumn("t", T.trim(F.col("text")))
    steps = steps.withColumn("title", F.coalesce(T.heading_text(F.col("t")), F.col("t")))
    words = F.size(F.filter(F.split("title", r"\s+"), lambda w: w.rlike(r"\p{L}")))
    plain = (F.col("t") != "") & ~F.col("t").rlike(r"^(!\[|\|)") & T.page_comment(F.col("t")).isNull() & ~F.col("t").rlike(r"\.{3,}")
    contents = (F.col("title") == F.col("t")) & F.col("t").rlike(r"\s{2,}[0-9]{1,4}\s*$")
    fits = words.between(2, 14) & (F.length(T.folded(F.col("title"))) >= 2)
    short = (F.length("t") <= 80) | F.startswith("t", F.lit("#")) | F.startswith("t", F.lit(T.MARKER))  # the cheap part first
    steps = steps.withColumn("ok", short & plain & ~contents & (F.length("title") <= 80) & (T.footer_address(F.col("title")) | fits))
    return steps.withColumn("key", F.when(F.col("ok"), T.folded(F.col("title")))).drop("t", "title", "ok")


def repeated_lines(lines: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, key, times) of the keys that stand ``least`` times in a document."""
    keyed = with_chrome_key(lines).where("key is not null")
    return keyed.groupBy("doc_id", "key").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def without_repeated(lines: DataFrame, least: int = 10) -> DataFrame:
    """Lines without those repeats; the first copy that is a heading stays.

    Only keys are exchanged to be counted; what repeats is then joined to the lines.
    """
    keyed = with_chrome_key(lines)
    head = F.when(T.heading_text(F.col("text")).isNotNull(), F.col("line_no"))
    often = keyed.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("times"), F.min(head).alias("kept")).where(F.col("times") >= least).drop("times")
    told = keyed.join(often.withColumn("often", F.lit(True)), ["doc_id", "key"], "left")
    return told.where("often is null or line_no = kept").select("doc_id", "line_no", "text")


def page_chrome(lines: DataFrame) -> DataFrame:
    """(doc_id, key, pages): keys of 4 to 60 characters on a third of a document's pages, three at least.

    Only page marks and keys are exchanged.
    """
    t = F.col("t")
    plain = (t != "") & T.page_comment(t).isNull() & (T.numbered_heading(t) == t) & T.numbered_callout(t).isNull() & (F.length(T.fold_line(t)).between(4, 60))
    told = lines.select("doc_id", "line_no", T.trim(F.col("text")).alias("t"))
    told = told.select("doc_id", "line_no", T.page_comment(t).alias("mark"), F.when(plain, T.fold_line(t)).alias("key")).where("mark is not null or key is not null")
    paged = told.withColumn("page", F.last("mark", ignorenulls=True).over(doc().rowsBetween(W.unboundedPreceding, 0))).where("page is not null")
    n = paged.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    counts = paged.where("key is not null").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    return counts.join(n, "doc_id").where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.34))).select("doc_id", "key", "pages")


def hidden_page_numbers(lines: DataFrame) -> DataFrame:
    """Lines with page headings as comments and lone page numbers gone."""
    t = F.col("text")
    n = F.regexp_extract(T.trim(t), r"^#{1,6}\s*(?i:page)\s+([0-9]{1,9})$", 1)
    return lines.where(~T.lone_page_number(t)).select("doc_id", "line_no", F.when(n != "", F.concat(F.lit("<!-- page "), n, F.lit(" -->"))).otherwise(t).alias("text"))


def line_map(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, old_line, new_line): a dropped line goes forward to the next kept, those at the end to the last."""
    new = F.row_number().over(doc()) - 1
    kept = kept.select("doc_id", "line_no", new.alias("at"))
    both = lines.select("doc_id", "line_no").join(kept, ["doc_id", "line_no"], "left")
    ahead = F.first("at", ignorenulls=True).over(doc().rowsBetween(0, W.unboundedFollowing))
    last = F.max("at").over(W.partitionBy("doc_id"))
    return both.select("doc_id", F.col("line_no").alias("old_line"), F.coalesce(ahead, last, F.lit(0)).cast("int").alias("new_line"))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """One line map after another."""
    then = second.select("doc_id", F.col("old_line").alias("new_line"), F.col("new_line").alias("final"))
    return first.join(then, ["doc_id", "new_line"]).select("doc_id", "old_line", F.col("final").alias("new_line"))


def drop_caps(lines: DataFrame) -> DataFrame:
    """A lone capital joined with the next line, if that begins in lower case."""
    cap = T.trim(F.col("text")).rlike(r"^[“\"‘'(]?\p{Lu}$")
    nxt = F.lead("text").over(doc())
    joins = F.coalesce(cap & nxt.rlike(r"^\p{Ll}"), F.lit(False))
    told = lines.withColumns({"joins": joins, "nxt": nxt})
    told = told.withColumn("eaten", F.coalesce(F.lag("joins").over(doc()), F.lit(False)))
    return told.where("not eaten").select("doc_id", "line_no", F.when(F.col("joins"), F.concat(T.trim(F.col("text")), F.col("nxt"))).otherwise(F.col("text")).alias("text"))


def usual_length(lines: DataFrame) -> DataFrame:
    """(doc_id, usual): the upper median of prose lines of 20 to 110 characters, 68 where there are none."""
    n = F.length(T.trim(F.col("text")))
    held = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(n.between(20, 110), n))).alias("a"))
    return held.select("doc_id", F.coalesce(F.get("a", (F.size("a") / 2).cast("int")), F.lit(68)).alias("usual"))


def mashed(lines: DataFrame) -> DataFrame:
    """(doc_id, mashed): at most two lines with over 280 characters, or a mean over 160; table lines do not count."""
    body = F.when(~F.startswith("text", F.lit("|")), F.length("text"))
    g = lines.groupBy("doc_id").agg(F.count(body).alias("n"), F.coalesce(F.sum(body), F.lit(0)).alias("s"))
    return g.select("doc_id", ((F.col("n") > 0) & (((F.col("n") <= 2) & (F.col("s") > 280)) | (F.floor(F.col("s") / F.greatest(F.col("n"), F.lit(1))) > 160))).alias("mashed"))


def blank_runs(lines: DataFrame) -> DataFrame:
    """Lines with one blank line for each run of them."""
    blank = T.trim(F.col("text")) == ""
    before = F.lag(blank, 1, False).over(doc())
    return lines.withColumn("gone", blank & before).where("not gone").select("doc_id", "line_no", "text")
