"""Letter-spaced titles written as the source of their file writes them.

A title's letters and digits in a row, whatever else stands between them in the source, are one
pattern; all its places come from one pass over that source. Only the sources of documents with such
a title are read, and only their titles meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .scan import free

_REST, _GLUED = r"[^\p{L}\p{N}]*", r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}\p{L}\p{N}]*"
LEAST, SOURCE = 5, 8
#: A source has letters enough: looked for to the last of them, however long it is.
ENOUGH = rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{SOURCE}}}"


def _letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]"), F.lit(0))


def tracked_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, head, body): lines outside fences whose letters are set apart by blanks; ``head`` is what
    stands before, blanks and marks."""
    head = F.regexp_extract("text", r"^([ \t]*(?:#{1,6} +)?)", 1)
    told = lines.select("doc_id", "line_no", head.alias("head"), F.col("text").alias("body")).withColumn("body", F.expr("substring(body, length(head) + 1)"))
    told = told.where(~F.col("body").rlike(r"^(<!--|!\[|\||>)") & T.tracked(F.col("body")))
    return told.join(free(lines).where("free"), ["doc_id", "line_no"], "left_semi")


def closed_letters(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits (doc_id, line_no, text, back): letter-spaced titles as ``sources`` (doc_id, text) have them; of several
    places that with most capitals alike, then the shortest, then the first. A title that its source lacks stays."""
    titles = written(tracked_titles(lines), "titles")
    text = sources.select("doc_id", F.col("text").alias("source")).join(titles.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("source").rlike(ENOUGH))
    asked = titles.withColumn("own", _letters(F.col("body"))).where(F.size("own") >= LEAST)
    pattern = F.concat(F.lit(f"(?iu){_GLUED}"), F.array_join("own", _REST), F.lit(_GLUED))
    found = asked.withColumn("pattern", pattern).join(text, "doc_id").withColumn("places", F.regexp_extract_all("source", F.col("pattern"), F.lit(0)))
    upper = lambda x: x.rlike(r"^\p{Lu}")
    alike = lambda s: F.size(F.filter(F.zip_with("own", _letters(s), lambda a, b: upper(a) == upper(b)), lambda x: x))
    said = lambda s: F.trim(F.regexp_replace(s, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))
    best = F.array_min(F.transform("places", lambda s, i: F.struct((-alike(s)).alias("alike"), F.length(s).alias("n"), i.alias("i"), said(s).alias("said"))))
    # generated, since a filter on a plain column would look through the source again for each use of it
    told = found.select("doc_id", "line_no", "head", F.explode(F.array(best["said"])).alias("said")).where("said <> ''")
    return told.where(~T.tracked(F.col("said"))).select("doc_id", "line_no", F.concat("head", "said").alias("text"), F.lit(False).alias("back"))
