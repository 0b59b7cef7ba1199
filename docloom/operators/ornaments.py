"""Ornaments: small pictures of a document that share a size at least ten times, and the lines that show them.

Pictures of one size are one class with its count, so copies meet no copies. Classes of near sizes meet
in the cells of a logarithmic grid. Which of them go depends on what went before, so a document's
classes, in order of their first names, are folded; only sizes and counts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written
from . import outline, scan

SMALL, TIMES, SLACK = 150_000, 10, 0.15


def near_classes(pictures: DataFrame, slack: float = SLACK) -> DataFrame:
    """(doc_id, w, h, first, n, other, m): classes of equal size with those of near sizes, themselves among them;
    ``first`` and ``other`` are the least names, ``n`` and ``m`` the counts."""
    step = -F.log(F.lit(1 - slack))
    cell = lambda c: F.floor(F.log(F.col(c).cast("double")) / step)
    own = pictures.where("w > 0 and h > 0").groupBy("doc_id", "w", "h").agg(F.min("name").alias("first"), F.count("*").alias("n"))
    left = own.withColumns({"kw": cell("w"), "kh": cell("h")})
    near = lambda c: F.explode(F.array(*(F.col(c) + F.lit(k) for k in (-1, 0, 1))))
    right = left.select("doc_id", F.col("w").alias("ow"), F.col("h").alias("oh"), F.col("first").alias("other"), F.col("n").alias("m"), near("kw").alias("kw"), "kh")
    right = right.select("doc_id", "ow", "oh", "other", "m", "kw", near("kh").alias("kh"))
    alike = lambda a, b: F.abs(F.col(a) - F.col(b)) <= slack * F.greatest(a, b, F.lit(1))
    return left.join(right, ["doc_id", "kw", "kh"]).where(alike("w", "ow") & alike("h", "oh")).select("doc_id", "w", "h", "first", "n", "other", "m")


def ornaments(pictures: DataFrame, *, small: int = SMALL, times: int = TIMES, slack: float = SLACK) -> DataFrame:
    """(doc_id, name): of the pictures (doc_id, name, w, h) with an area under ``small`` those of a group of ``times``
    or more near the size of one, which are looked at by name; a picture is in one group."""
    own = pictures.where(F.col("w").cast("long") * F.col("h") < small)
    groups = near_classes(own, slack).groupBy("doc_id", "w", "h", "first").agg(F.collect_list(F.struct("other", "m")).alias("near"))
    rows = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "near"))).alias("rows"))

    def step(gone: Column, row: Column) -> Column:
        left = F.filter(row["near"], lambda x: ~F.array_contains(gone, x["other"]))
        count = F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x["m"])
        return F.when(~F.array_contains(gone, row["first"]) & (count >= times), F.concat(gone, F.transform(left, lambda x: x["other"]))).otherwise(gone)

    gone = rows.select("doc_id", F.explode(F.aggregate("rows", F.array().cast("array<string>"), step)).alias("first"))
    sizes = groups.select("doc_id", "w", "h", "first").join(gone, ["doc_id", "first"]).select("doc_id", "w", "h")
    return own.join(sizes, ["doc_id", "w", "h"]).select("doc_id", "name")


def linked_name(line: Column) -> Column:
    """File name of the picture that a line begins with; null for other lines."""
    path = F.regexp_extract(T.trim(line), r"(?s)^!\[.*?\]\(([^)]*)\)", 1)
    path = F.btrim(F.split(path, " ", 2)[0], F.lit("\"' "))
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.when(name != "", name)


def without_ornaments(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """Edits (doc_id, line_no, text, back): the lines that show an ornament go."""
    shown = lines.where(F.startswith(T.trim(F.col("text")), F.lit("!["))).select("doc_id", "line_no", linked_name(F.col("text")).alias("name"))
    shown = written(shown, "shown")
    own = pictures.join(by_shuffle(shown.select("doc_id").distinct()), "doc_id", "left_semi")  # of documents that show any
    return shown.join(ornaments(own), ["doc_id", "name"], "left_semi").select("doc_id", "line_no", F.lit(None).cast("string").alias("text"), F.lit(False).alias("back"))


def outline_after(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """(doc_id, ord, title, line): the headings, at the lines that they have once ornaments are gone. The lines are made
    once: those that are looked at are written."""
    looked = written(lines.where(outline.candidates() | F.contains("text", F.lit("!["))), "marks")
    return scan.renumbered(outline.headings(looked), without_ornaments(looked, pictures)).select("doc_id", "ord", "title", "line")
