"""Split words put together by a lexicon that the corpus itself gives.

Words are counted over all lines. Pieces that stand side by side are looked up as pairs of words, each
pair once however often it occurs, in joins with the lexicon on the joined form and on each piece;
neither words nor lines are sent to all tasks. Then the places of the pairs that hold are found in the
lines, and only those places meet the fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written
from .scan import free

#: How often a word has to stand in the corpus to be one.
LEAST = 3
TOKEN = r"\p{L}+|[^\p{L}]+"


def lexicon(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, times): the words in lower case that stand ``least`` times or more."""
    words = lines.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def _pieces(first: str, second: str) -> str:
    """Pattern of two words with a single space between them, the second in lower case, of so many letters; the second
    is only looked at, as it may be the first of the next two."""
    return rf"(?<!\p{{L}})(\p{{L}}{{{first}}}) (?=(\p{{Ll}}\p{{L}}{{{second}}})(?!\p{{L}}))"


def _places(lines: DataFrame, holds: Column) -> DataFrame:
    """(doc_id, line_no, at, first, second): words with a single space between them for which ``holds``; ``at`` is
    the place of the first among the words and gaps of the line."""
    told = lines.select("doc_id", "line_no", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("t")).where("size(t) >= 3")
    pair = lambda i: F.struct(i.alias("at"), F.get("t", i).alias("first"), F.get("t", i + 1).alias("gap"), F.get("t", i + 2).alias("second"))
    every = told.select("doc_id", "line_no", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size("t") - 3), pair), lambda x: (x["gap"] == " ") & x["first"].rlike(r"^\p{L}"))).alias("x"))
    return every.select("doc_id", "line_no", "x.at", "x.first", "x.second").where(holds)


def _beside(lines: DataFrame, pieces: str) -> DataFrame:
    """(doc_id, line_no, a, b): the pieces of each line by a pattern of ``_pieces``, in lower case."""
    found = lambda k: F.regexp_extract_all("text", F.lit(pieces), F.lit(k))
    both = F.arrays_zip(found(1).alias("a"), found(2).alias("b"))
    return lines.where(F.col("text").rlike(pieces)).select("doc_id", "line_no", F.explode(both).alias("x")).select("doc_id", "line_no", F.lower("x.a").alias("a"), F.lower("x.b").alias("b"))


def _judged(beside: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, whole, left, right): each pair of pieces once, and whether their joined form and each alone are words."""
    pairs = beside.select("a", "b").distinct()
    known = lambda name: by_shuffle(words.select(F.col("word").alias(name), F.lit(True).alias(f"is_{name}")))
    told = pairs.withColumn("ab", F.concat("a", "b")).join(known("ab"), "ab", "left").join(known("a"), "a", "left").join(known("b"), "b", "left")
    yes = lambda c: F.coalesce(f"is_{c}", F.lit(False))
    return told.select("a", "b", yes("ab").alias("whole"), yes("a").alias("left"), yes("b").alias("right"))


def split_pairs(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no, at, first, second): pieces of up to eight and six letters, the second in lower case, that are
    a word together and not both alone; of pieces in a row the first two, then the next two."""
    body = lines.where(~F.startswith(T.trim(F.col("text")), F.lit("<!--")))
    short = (F.length("first") <= 8) & (F.length("second") <= 6) & F.col("second").rlike(r"^\p{Ll}")
    good = written(_judged(_beside(body, _pieces("1,8", "0,5")), words).where("whole and not (left and right)").select("a", "b"), "split")
    hits = _places(body, short).join(good, (F.lower("first") == F.col("a")) & (F.lower("second") == F.col("b"))).select("doc_id", "line_no", "at", "first", "second")
    hits = hits.join(by_shuffle(free(lines).where("free").select("doc_id", "line_no")), ["doc_id", "line_no"], "left_semi")
    row = W.partitionBy("doc_id", "line_no").orderBy("at")
    chain = hits.withColumn("run", F.col("at") - 2 * F.row_number().over(row))
    nth = F.row_number().over(W.partitionBy("doc_id", "line_no", "run").orderBy("at"))
    return chain.withColumn("nth", nth).where("nth % 2 = 1").select("doc_id", "line_no", "at", "first", "second")


def rejoined(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Edits (doc_id, line_no, text, back): lines with their split words put together, in lower case with the first
    capital kept."""
    pairs = split_pairs(lines, words)
    whole = F.lower(F.concat("first", "second"))
    whole = F.when(F.col("first").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, 2, 1 << 30))).otherwise(whole)
    by_line = written(pairs.groupBy("doc_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("at", whole))).alias("made")), "rejoined")
    told = lines.select("doc_id", "line_no", "text").join(by_shuffle(by_line), ["doc_id", "line_no"]).select("doc_id", "line_no", "made", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("t"))
    at = F.map_keys("made")
    token = lambda x, i: F.when(F.array_contains(at, i - 1) | F.array_contains(at, i - 2), "").otherwise(F.coalesce(F.element_at("made", i), x))
    return told.select("doc_id", "line_no", F.array_join(F.transform("t", token), "").alias("text"), F.lit(False).alias("back"))


def suspects(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no): lines that may hold a split word: two pieces of two to four letters of which the second,
    in lower case, is no word, or two of two letters of which the first is none."""
    body = lines.where(~T.trim(F.col("text")).rlike(r"^(#|<!--|!\[|\||>)"))
    beside = _beside(body, _pieces("2,4", "1,3"))
    odd = written(_judged(beside, words).where("not right or (not left and length(a) = 2 and length(b) = 2)").select("a", "b"), "odd")
    return beside.join(odd, ["a", "b"], "left_semi").select("doc_id", "line_no").distinct()


def with_neighbours(marked: DataFrame, lines: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, line_no, before, after): the last ``most`` words of the line before each marked line, and the first of
    the line after."""
    said = lambda c: F.filter(F.split(c, r"[\s\p{Z}]+"), lambda w: w != "")
    ends = lines.select("doc_id", "line_no", F.array_join(F.slice(F.reverse(said("text")), 1, most), " ").alias("tail"), F.array_join(F.slice(said("text"), 1, most), " ").alias("head"))
    tails = ends.select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.array_join(F.reverse(F.split("tail", " ")), " ").alias("before"))
    heads = ends.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("head").alias("after"))
    return marked.join(by_shuffle(tails), ["doc_id", "line_no"], "left").join(by_shuffle(heads), ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
