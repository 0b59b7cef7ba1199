"""Answers from the text itself: paragraphs or sentences scored by the words of the question."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import search
from ..sources.relations import lines as lines_of
from ..sources.relations import unix_lines

# Words of a question that say nothing.
STOP = {"the", "and", "for", "that", "this", "with", "from", "what", "when", "where", "which", "about", "does", "into", "have", "been"}


def question_words(question: str, over: int = 2) -> list[str]:
    return [w for w in re.split(r"[\W_]+", question.lower()) if len(w) > over and w not in STOP]


def _score(c, words):  # noqa: ANN001, ANN202
    out = F.lit(0)
    for w in words:
        out = out + F.contains(F.lower(c), F.lit(w)).cast("int")
    return out


def best_passages(docs: DataFrame, question: str, *, pieces=None, over: int = 2, longer: int = 40, top: int = 3) -> DataFrame:  # noqa: ANN001
    """(doc_id, rank, passage, score): the ``top`` passages of each document with most question words.

    A word asked twice counts twice; ties stay in text order. Passages are paragraphs unless
    ``pieces`` gives others.
    """
    split = pieces if pieces is not None else F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    rows = docs.select("doc_id", F.posexplode(split).alias("pos", "passage")).where((F.length("passage") > longer) & ~F.startswith("passage", F.lit(">")))
    rows = rows.withColumn("score", _score(F.col("passage"), question_words(question, over))).where("score > 0")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "passage", "score")


def _let(value, of):  # noqa: ANN001, ANN202
    """``of`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _hits(docs: DataFrame, query: str, cap: int = 120) -> DataFrame:
    """(doc_id, lines, hits): the lines of each text, and which of them ``hit_lines`` gives. A text is gone through
    where it is read: paragraphs are stretches of its lines, so that no line is exchanged."""
    node = search.parse(query)
    asked, every = search.highlights(node), search.terms(node)
    plain = all(search.bare(t).isascii() for t in every)
    own = docs.where("text is not null").select("doc_id", unix_lines(F.col("text")).alias("text"))
    own = own.select("doc_id", "text", search.comparable(F.col("text"), every).alias("low") if plain else F.col("text").alias("low"))
    may = (F.col("low").isNotNull() & ~search.is_ascii(F.col("low"))) | search.possible(node, F.col("low"), search.in_folded) if plain else F.lit(True)
    none = F.array().cast("array<string>")
    own = own.select("doc_id", F.split("text", "\n").alias("lines"), F.when(may, F.split("low", "\n")).otherwise(none).alias("low"))
    stops = F.filter(F.transform("lines", lambda x, i: F.when(T.trim(x).rlike("^($|#|<!--)"), i)), lambda i: i.isNotNull())
    own = own.withColumn("stops", F.when(F.size("low") > 0, F.concat(F.array(F.lit(-1)), stops, F.array(F.size("lines")))).otherwise(F.array().cast("array<int>")))
    part = F.transform(F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0))), lambda at, k: F.struct((at + 1).alias("first"), (F.get("stops", k + 1) - at - 1).alias("n")))
    part = F.transform(F.filter(part, lambda x: x["n"] > 0), lambda x: x.withField("p", F.array_join(F.slice("low", x["first"] + 1, x["n"]), " ")))

    def answers(p, has):  # noqa: ANN001, ANN202
        whole = lambda x: search.compiled(node, x, has)
        # without a NOT a sentence has nothing that its paragraph lacks
        return search.possible(node, p, has) & (whole(p) | F.exists(T.sentences(p), whole)) if search.negates(node) else whole(p)

    def found(x):  # noqa: ANN001, ANN202
        told = _let(F.array_join(F.slice("lines", x["first"] + 1, x["n"]), " "), lambda p: answers(p, search.contains))
        return F.when(search.is_ascii(x["p"]), answers(x["p"], search.in_folded)).otherwise(told) if plain else told

    def marked(i):  # noqa: ANN001, ANN202
        told = _any(F.get("lines", i), asked, search.contains)
        return _let(F.get("low", i), lambda low: F.when(search.is_ascii(low), _any(low, asked, search.in_folded)).otherwise(told)) if plain else told

    def said(x):  # noqa: ANN001, ANN202
        every = F.sequence(x["first"], x["first"] + x["n"] - 1)
        return _let(F.filter(every, marked), lambda at: F.when(F.size(at) > 0, at).otherwise(every))

    own = own.withColumn("part", part)
    return own.select("doc_id", "lines", F.slice(F.flatten(F.transform(F.filter("part", found), said)), 1, cap).alias("hits"))


def hit_lines(docs: DataFrame, query: str, cap: int = 120) -> DataFrame:
    """(doc_id, line_no): in a paragraph that matches, the lines with a term asked for, or all of them.

    A paragraph is a row of its own, so that a term is looked for in plain columns and Spark's code stays small;
    of what is found only numbers of lines are exchanged.
    """
    node = search.parse(query)
    asked, every = search.highlights(node), search.terms(node)
    plain = all(search.bare(t).isascii() for t in every)
    fold = (lambda c: search.comparable(c, every)) if plain else lambda c: c
    stop = lambda x: T.trim(x).rlike("^($|#|<!--)")
    # a paragraph is what lies between two lines that end one
    def cut(lines):  # noqa: ANN001, ANN202
        stops = F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
        part = lambda at, a, k: F.struct((a + 1).alias("first"), F.slice(lines, a + 2, F.get(at, k + 1) - a - 1).alias("part"))
        return _let(F.concat(F.array(F.lit(-1)), stops, F.array(F.size(lines))), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, k: part(at, a, k)))

    # lines are split once a text, not once a paragraph, and no row has those of another paragraph
    own = docs.where("text is not null").select("doc_id", F.explode(_let(F.split(unix_lines(F.col("text")), "\n"), cut)).alias("x")).select("doc_id", "x.*").where(F.size("part") > 0)
    own = own.select("doc_id", "first", "part", F.array_join("part", " ").alias("p"))
    own = own.select("doc_id", "first", "part", "p", fold(F.col("p")).alias("low"))
    plainly = search.is_ascii(F.col("low")) if plain else F.lit(False)
    own = own.select("doc_id", "first", "part", "p", "low", plainly.alias("plainly"))

    def answers(p, has):  # noqa: ANN001, ANN202
        whole = lambda x: search.compiled(node, x, has)
        # without a NOT a sentence has nothing that its paragraph lacks
        return search.possible(node, p, has) & (whole(p) | F.exists(T.sentences(p), whole)) if search.negates(node) else whole(p)

    found = own.where(F.when(F.col("plainly"), answers(F.col("low"), search.in_folded)).otherwise(answers(F.col("p"), search.contains)))
    said = F.transform("part", lambda x, i: F.when(F.when(F.col("plainly"), _any(fold(x), asked, search.in_folded)).otherwise(_any(x, asked, search.contains)), i))
    found = found.select("doc_id", "first", F.size("part").alias("n"), F.filter(said, lambda i: i.isNotNull()).alias("at"))
    hits = found.select("doc_id", "first", F.explode(F.when(F.size("at") > 0, F.col("at")).otherwise(F.sequence(F.lit(0), F.col("n") - 1))).alias("i"))
    hits = hits.select("doc_id", (F.col("first") + F.col("i")).alias("line_no"))
    return hits.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))).where(F.col("nth") <= cap).select("doc_id", "line_no")


def _any(c, terms, has):  # noqa: ANN001, ANN202
    out = F.lit(False)
    for t in terms:
        out = out | has(c, t)
    return out


def occurrences(lines: DataFrame, term: str, per_line: int = 6, cap: int = 120) -> DataFrame:
    """(doc_id, line_no, n): how often the term stands in a line, up to ``per_line``; ``cap`` a document."""
    found = lines.select("doc_id", "line_no", F.least(F.lit(per_line), F.regexp_count(F.lower("text"), F.lit(re.escape(term.lower())))).alias("n")).where("n > 0")
    before = F.sum("n").over(W.partitionBy("doc_id").orderBy("line_no")) - F.col("n")
    return found.withColumn("before", before).where(F.col("before") < cap).select("doc_id", "line_no", F.least("n", F.lit(cap) - F.col("before")).cast("int").alias("n"))


def bag_difference(rows: DataFrame) -> DataFrame:
    """(doc_id, word, n): words that ``need`` has more often than ``taken``, and how much more."""
    count = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda w: F.struct(w, F.size(F.filter(c, lambda x: x == w)).cast("long"))))
    told = rows.select("doc_id", F.explode(count(F.col("need"))).alias("word", "have"), count(F.col("taken")).alias("less"))
    return told.withColumn("n", F.col("have") - F.coalesce(F.try_element_at("less", F.col("word")), F.lit(0))).where("n > 0").select("doc_id", "word", "n")


def passages(lines, hits, *, ahead: int = 6, longest: int = 500):  # noqa: ANN001, ANN201
    """What stands at each of the lines ``hits`` that has something, in order: ``ahead`` lines at most, to the next
    heading or until there are over ``longest`` characters; comments and blank lines are passed over."""

    def said(at):  # noqa: ANN001, ANN202
        def step(acc, r):  # noqa: ANN001, ANN202
            t = T.trim(r["text"])
            grown = F.when((t == "") | F.startswith(t, F.lit("<!--")), acc["said"]).when(acc["said"] == "", r["text"]).otherwise(F.concat_ws("\n", acc["said"], r["text"]))
            past = (r["off"] > 0) & F.startswith(t, F.lit("#"))
            more = F.struct(grown.alias("said"), F.lit(False).alias("past"))
            full = _let(more, lambda m: F.struct(m["said"].alias("said"), (~F.startswith(t, F.lit("<!--")) & (F.length(m["said"]) > longest)).alias("past")))
            return F.when(acc["past"], acc).when(past, F.struct(acc["said"].alias("said"), F.lit(True).alias("past"))).otherwise(full)

        part = F.transform(F.slice(lines, at + 1, ahead), lambda x, i: F.struct(i.alias("off"), x.alias("text")))
        return F.aggregate(part, F.struct(F.lit("").alias("said"), F.lit(False).alias("past")), step)["said"]

    return F.filter(F.transform(hits, said), lambda p: p != "")


def boolean_plan(docs: DataFrame, query: str, *, budget: int = 12_000) -> DataFrame:
    """(doc_id, hits, excerpt): how many lines of a document answer a boolean query, and the passages at them, in
    order, before the first that takes the document over its budget of characters."""

    def step(acc, p):  # noqa: ANN001, ANN202
        used = acc["used"] + F.length(p)
        return F.when(acc["full"] | (used > budget), acc.withField("full", F.lit(True))).otherwise(F.struct(used.alias("used"), F.lit(False).alias("full"), (acc["n"] + 1).alias("n")))

    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("n"))
    told = _hits(docs, query).select("doc_id", F.size("hits").cast("long").alias("hits"), passages("lines", F.col("hits")).alias("passages"))
    excerpt = F.array_join(F.slice("passages", 1, F.aggregate("passages", zero, step)["n"]), "\n\n")
    return told.select("doc_id", F.explode(F.when(F.col("hits") > 0, F.array(F.struct("hits", excerpt.alias("excerpt"))))).alias("x")).select("doc_id", "x.*")


def excerpts(docs: DataFrame, query: str, *, before: int = 2, after: int = 8, each: int = 2_400) -> DataFrame:
    """(doc_id, excerpt) of documents that match: the lines round the first that answers, else round the first that
    holds the query by itself, else the beginning; ``each`` characters at most."""
    own = docs.select("doc_id", "text")
    lines = lines_of(own)
    first = hit_lines(own, query).groupBy("doc_id").agg(F.min("line_no").alias("hit"))
    alone = search.matching(lines, query).groupBy("doc_id").agg(F.min("line_no").alias("alone"))
    at = own.join(first, "doc_id", "left").join(alone, "doc_id", "left").withColumn("at", F.coalesce("hit", "alone"))
    begin = F.greatest(F.lit(0), F.col("at") - before)
    part = F.slice(F.split(unix_lines(F.col("text")), "\n"), begin + 1, F.col("at") + after - begin)
    return at.select("doc_id", F.left(F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(part, "\n")), F.lit(each)).alias("excerpt"))


def tagged(cards: DataFrame, tags: list[str], query: str, *, budget: int = 12_000, each: int = 2_400, least: int = 400) -> DataFrame:
    """(id, title, excerpt) of the cards with all tags whose text matches the query, in order of ids, while the
    budget has ``least`` left; each gives the lines round its first hit.

    Cards are taken in growing numbers until the budget is used, since an excerpt may be short: the driver
    holds the lengths of excerpts that were looked at, no more of them than the budget has characters.
    """
    from . import library

    found = library.with_tags(search.matching(cards, query), tags)
    count = budget // least + 1
    while True:
        first = found.select("id", "title", "text").orderBy("id").limit(count)
        cut = excerpts(first.select(F.col("id").alias("doc_id"), "text"), query, each=each).withColumnRenamed("doc_id", "id").where("excerpt <> ''")
        told = first.select("id", "title").join(cut, "id")
        looked, used = first.count(), told.agg(F.sum(F.length("excerpt"))).first()[0] or 0
        if looked < count or budget - used < least or count > budget:
            break
        count *= 4
    held = told.agg(F.array_sort(F.collect_list(F.struct("id", "title", "excerpt"))).alias("a"))  # a bounded list
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<id:bigint,title:string,excerpt:string>>").alias("out"))

    def step(acc, c):  # noqa: ANN001, ANN202
        part = F.left(c["excerpt"], acc["left"])
        took = F.struct((acc["left"] - F.length(part)).alias("left"), F.array_append(acc["out"], F.struct(c["id"].alias("id"), c["title"].alias("title"), part.alias("excerpt"))).alias("out"))
        return F.when(acc["left"] >= least, took).otherwise(acc)

    return held.select(F.explode(F.aggregate("a", zero, step)["out"]).alias("c")).select("c.*")


def highlight_ranges(lines: DataFrame, term: str, *, per_line: int = 6, most: int = 200) -> DataFrame:
    """(doc_id, line_no, at): where a term stands in each line, up to ``per_line``; ``most`` in a document."""
    parts = F.split(F.lower("text"), re.escape(term.lower()))
    places = F.transform(F.sequence(F.lit(1), F.least(F.lit(per_line), F.size("p") - 1)), lambda k: F.length(F.array_join(F.slice("p", 1, k), term)))
    found = lines.select("doc_id", "line_no", parts.alias("p")).where(F.size("p") > 1).select("doc_id", "line_no", F.posexplode(places).alias("k", "at"))
    return found.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "k"))).where(F.col("n") <= most).select("doc_id", "line_no", "at")


# What the web page answers where the chapter says nothing.
NOT_TOGETHER = "That chapter does not say. AND, OR, and NOT must be capitals, in the same sentence."
NOT_SAID = "That chapter does not say. Try another heading, or the Mac app with your own key."


def page_answers(docs: DataFrame, question: str, top: int = 3) -> DataFrame:
    """(doc_id, answer) as the web page gives it: the three sentences with most words of the question, in one
    scan; a question with AND, OR or NOT must hold in one sentence."""
    words = [w for w in re.split(r"[^A-Za-z0-9_]+", question.lower()) if len(w) > 3]
    said = F.split(F.regexp_replace("text", "\n+", " "), r"(?<=[.?!])\s+")
    scored = F.transform(said, lambda s, i: F.struct((-_score(s, words)).alias("n"), i.alias("i"), s.alias("s")))
    best = F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] < 0)), 1, top), lambda x: F.trim(x["s"]))
    told = F.when(F.size("best") == 0, NOT_SAID).otherwise(F.array_join("best", " "))
    if re.search(r"\b(AND|OR|NOT)\b", question):
        told = F.when(~search.holds_by_word(F.col("text"), question), NOT_TOGETHER).otherwise(told)
    return docs.withColumn("best", best).select("doc_id", told.alias("answer"))
