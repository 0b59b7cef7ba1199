"""Fuzzy join of titles and lines: an index of prefixes and rare grams, and a check of each candidate.

A line says a title when the two are the same after folding, when the line goes on after it with no
letter, when the line, of 16 characters or more, is the title's beginning, or when a line of 120
characters or fewer that is no heading holds it, if the title has 8 or more. Every one of these pairs
has a key in common:

* beginnings: a title of 16 characters or more gives its beginning of 16 x 2^k characters, the
  longest that it has, and a line each of them that it has; the other way round for lines that begin
  a title; a shorter title gives itself, and a line each beginning of up to 15 characters that no
  letter follows;
* parts: a title gives the one of its grams of eight characters that the fewest lines hold, a line all.

Texts that are the same count once, so a header on all pages of all books is one row. Lines of a key
that very many hold are dealt over parts, to each of which the titles of that key are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written

SHORT, GRAM, HELD, LEVELS = 16, 8, 120, 8
HOT = 50_000


def line_texts(lines: DataFrame, most: int, *, whole: bool = False) -> DataFrame:
    """``lines`` (.., text) as (.., said, n, head): the first ``most`` characters of a folded line, its
    length, and whether it is a heading. Contents lines and those of under three characters are left out.
    With ``whole`` a longer line has a digest of all of it besides, ``rest``, which tells those that begin alike."""
    told = lines.withColumns({"head": T.heading_text(F.col("text")).isNotNull(), "said": T.folded(F.col("text")), "out": T.contents_line(F.col("text"))})
    told = told.where("not out").withColumn("n", F.length("said")).where("n >= 3")
    told = told.withColumn("rest", F.when(F.col("n") > most, F.sha2("said", 256))) if whole else told
    return told.withColumn("said", F.substring("said", 1, most)).drop("text", "out")


def says(needle: Column, said: Column, n: Column, head: Column) -> Column:
    """The rule itself, on a folded title and what ``line_texts`` gives of a line."""
    after = F.substring(said, F.length(needle) + 1, F.lit(1))
    begins = F.startswith(said, needle) & ~after.rlike(r"^\p{L}")
    begun = (n >= SHORT) & (n == F.length(said)) & F.startswith(needle, said) & ~F.startswith(said, F.lit("page "))
    return (F.length(needle) >= 3) & (begins | begun | (~head & (n <= HELD) & (F.length(needle) >= GRAM) & ~F.startswith(said, needle) & F.contains(said, needle)))


def _key(by: tuple[str, ...], tag: str, text: Column) -> Column:
    return F.xxhash64(*by, F.lit(tag), text)


def _beginnings(text: Column, size: Column) -> Column:
    """All beginnings of 16 x 2^k characters; the last is the longest."""
    return F.transform(F.filter(F.array(*(F.lit(SHORT << k) for k in range(LEVELS))), lambda m: m <= size), lambda m: F.substring(text, F.lit(1), m))


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def matches(needles: DataFrame, texts: DataFrame, *by: str, hot: int = HOT) -> DataFrame:
    """(*by, needle, said, n, head): the pairs of distinct ``needles`` (*by, needle) and ``texts`` (*by, said, n,
    head) that match; columns ``by`` are equal on both sides."""
    needle, said, n = F.col("needle"), F.col("said"), F.col("n")
    size = F.length(needle)
    asked = written(needles.select(*by, "needle").distinct(), "needles")
    held = written(texts.select(*by, "said", "n", "head").distinct(), "texts")
    one = lambda a: F.slice(a, F.greatest(F.size(a), F.lit(1)), 1)
    title_keys = F.concat(
        F.transform(one(_beginnings(needle, size)), lambda t: _key(by, "title", t)), F.transform(_beginnings(needle, size), lambda t: _key(by, "line", t)),
        F.when((size >= 3) & (size < SHORT), F.array(_key(by, "short", needle))).otherwise(F.array().cast("array<bigint>")),
    )
    ends = F.filter(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(n, F.lit(SHORT - 1)))), lambda m: ~F.substring(said, m + 1, F.lit(1)).rlike(r"^\p{L}"))
    whole = F.when(n == F.length(said), one(_beginnings(said, n))).otherwise(F.array().cast("array<string>"))
    line_keys = F.concat(F.transform(_beginnings(said, F.length(said)), lambda t: _key(by, "title", t)), F.transform(whole, lambda t: _key(by, "line", t)), F.transform(ends, lambda m: _key(by, "short", F.substring(said, F.lit(1), m))))

    grams = asked.where(size >= GRAM).select(*by, "needle", F.explode(_grams(needle)).alias("gram")).withColumn("key", _key(by, "part", F.col("gram")))
    parts = held.where(~F.col("head") & n.between(GRAM, HELD)).select(*by, "said", "n", "head", F.explode(F.transform(_grams(said), lambda g: _key(by, "part", g))).alias("key"))
    often = parts.join(grams.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("times"))
    rare = grams.join(often, "key", "left").groupBy(*by, "needle").agg(F.min_by("key", F.struct(F.coalesce("times", F.lit(0)), "key")).alias("key"), F.bool_and(F.col("times").isNotNull()).alias("all"))
    left = asked.select(*by, "needle", F.explode(title_keys).alias("key")).unionByName(rare.where("all").select(*by, "needle", "key"))
    left = written(left, "title-keys")
    right = held.select(*by, "said", "n", "head", F.explode(line_keys).alias("key")).unionByName(parts)
    right = written(right.join(left.select("key").distinct(), "key", "left_semi"), "line-keys")
    full = right.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > hot).select("key", F.ceil(F.col("times") / hot).cast("int").alias("deals"))
    left = left.join(full, "key", "left").select(*by, "needle", "key", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal"))
    right = right.join(full, "key", "left").select(*by, "said", "n", "head", "key", F.pmod(F.xxhash64("said"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
    found = left.join(right, [*by, "key", "deal"]).where(says(needle, said, n, F.col("head")))
    return found.select(*by, "needle", "said", "n", "head").distinct()


def width(titles: DataFrame) -> int:
    """How many characters of a line decide whether it says one of these ``titles`` (needle)."""
    longest = titles.agg(F.max(F.length("needle"))).first()[0]  # one number
    return max(HELD, longest or 0) + 1


def with_needle(titles: DataFrame) -> DataFrame:
    return titles.withColumn("needle", T.folded(F.col("title")))


#: Lines of a document that meet its titles in one task.
STRETCH = 4096


def said_in_document(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``asked`` (doc_id, needle, size, ..), ``size`` the document's lines, with each line_no of ``lines``
    (doc_id, line_no, text) that says the needle.

    A document has few titles, so they come to its lines: a line is exchanged once, and no gram of it.
    """
    texts = line_texts(lines, width(asked)).withColumn("stretch", F.floor(F.col("line_no") / STRETCH).cast("int"))
    dealt = asked.where(F.length("needle") >= 3).withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("size", F.lit(1)) - 1) / STRETCH).cast("int"))))
    return texts.join(by_shuffle(dealt), ["doc_id", "stretch"]).where(says(F.col("needle"), F.col("said"), F.col("n"), F.col("head"))).drop("stretch", "size", "said", "n", "head")


def lines_saying(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, title): lines of a document that say a title of the same document's outline."""
    size = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("size"))
    asked = with_needle(titles).select("doc_id", "title", "needle").distinct().join(by_shuffle(size), "doc_id")
    return said_in_document(written(asked, "titles"), lines.select("doc_id", "line_no", "text")).select("doc_id", "line_no", "title")


def titles_elsewhere(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(title, texts, lines, first_doc): of each folded title, how many different lines of all documents say it,
    how many lines in all, and the least document with one; titles that no line says are left out.

    Lines that are the same are one class with its size, so no pair of copies is made; those that differ beyond
    what decides whether they say a title are matched once, and counted as so many texts.
    """
    asked = written(with_needle(titles).select("needle").distinct(), "titles")
    texts = line_texts(lines.select("doc_id", "text"), width(asked), whole=True).groupBy("said", "n", "head", "rest").agg(F.count("*").alias("times"), F.min("doc_id").alias("first_doc"))
    texts = texts.groupBy("said", "n", "head").agg(F.count("*").alias("alike"), F.sum("times").alias("times"), F.min("first_doc").alias("first_doc"))
    texts = written(texts, "lines")
    pairs = matches(asked, texts)
    told = pairs.join(texts, ["said", "n", "head"]).groupBy("needle").agg(F.sum("alike").alias("texts"), F.sum("times").alias("lines"), F.min("first_doc").alias("first_doc"))
    return told.withColumnRenamed("needle", "title")


WINDOW = 16


def _minima(text: Column) -> Column:
    """Of each stretch of 16 characters the least hash of its grams of eight; the same stretch has the same."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(GRAM))))
    # one array of hashes a text, of which each stretch looks at its own nine
    held = F.array(F.struct(grams.alias("g")))
    return F.array_distinct(F.flatten(F.transform(held, lambda h: F.transform(F.sequence(F.lit(1), F.size(h["g"]) - (WINDOW - GRAM)), lambda i: F.array_min(F.slice(h["g"], i, WINDOW - GRAM + 1))))))


def containing(needles: DataFrame, texts: DataFrame, *by: str) -> DataFrame:
    """(*by, needle, said): the pairs of distinct ``needles`` (*by, needle) of 16 characters or more and ``texts``
    (*by, said) that hold them anywhere, with equal columns ``by``.

    A needle's first 16 characters have one least gram, and a text that holds the needle has the same among
    those of its stretches, so equal keys miss no pair.
    """
    asked = needles.where(F.length("needle") >= WINDOW).select(*by, "needle").distinct()
    left = asked.withColumn("key", F.element_at(_minima(F.substring("needle", 1, WINDOW)), 1))
    right = texts.where(F.length("said") >= WINDOW).select(*by, "said").distinct().select(*by, "said", F.explode(_minima(F.col("said"))).alias("key"))
    return left.join(right, [*by, "key"]).where(F.contains("said", F.col("needle"))).select(*by, "needle", "said")
