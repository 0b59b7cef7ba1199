"""Markdown tables: cells, separators, empty columns and table text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(T.trim(line), r"^\|", ""), r"\|$", ""), r"\|"), lambda c: T.trim(c))


def separator(line: Column) -> Column:
    return F.forall(cells(line), lambda c: F.regexp_replace(c, r"[:\s]", "").rlike("^-+$"))


def row_text(columns: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(columns, " | "), F.lit(" |"))


def escaped(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def used_columns(rows: DataFrame) -> DataFrame:
    """(doc_id, col): columns of a table (doc_id, row_no, cells) that hold anything, partial sums first."""
    held = rows.select("doc_id", F.posexplode("cells").alias("col", "cell"))
    return held.groupBy("doc_id", "col").agg(F.max((F.col("cell") != "").cast("int")).alias("used")).where("used = 1").select("doc_id", "col")


def without_empty_columns(rows: DataFrame) -> DataFrame:
    """(doc_id, row_no, text) with the empty columns gone."""
    keep = used_columns(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list("col")).alias("keep"))
    return rows.join(keep, "doc_id").select("doc_id", "row_no", row_text(F.transform("keep", lambda i: F.get("cells", i))).alias("text"))
