"""Outlines put into texts: where each entry's title stands, and the text with the entries as headings.

Titles meet lines by equal keys. A heading's key is its folded title without a number; two or three
short lines in a row have that of what they say together. What an entry with a page finds does not
depend on the entries before it, so it is a least line over the candidates; only entries without one
go on from where the entry before them ended, in a fold over a document's entries and their candidate
lines. Keys, line numbers and short pieces are exchanged, no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written
from . import matching, outline
from .outline import doc

PIECE = 80


def entry_key(title: Column) -> Column:
    """A folded title without its number, unless under three characters are left."""
    f = T.folded(title)
    core = F.regexp_replace(f, r"^[0-9]+(\.[0-9]+)*\s+", "")
    return F.when(F.length(core) >= 3, core).otherwise(f)


def page_map(lines: DataFrame) -> DataFrame:
    """(doc_id, page, start), pages from 0: the last heading ``Page N``, else the first mark of that page."""
    title = T.folded(T.heading_text(F.col("text")))
    n = F.regexp_extract(title, r"^page +([0-9]{1,9})$", 1).try_cast("int")
    told = lines.select("doc_id", "line_no", F.when(n > 0, n).alias("head"), T.page_comment(F.col("text")).alias("mark")).where("head is not null or mark is not null")
    of = told.withColumn("page", F.coalesce("head", "mark") - 1)
    return of.groupBy("doc_id", "page").agg(F.coalesce(F.max(F.when(F.col("head").isNotNull(), F.col("line_no"))), F.min("line_no")).alias("start"))


def candidates() -> Column:
    """Whether ``anchors`` or ``outline.headings`` looks at a line."""
    return outline.candidates() | (F.length("text") <= PIECE) | (F.length(T.trim(F.col("text"))) <= PIECE)


def anchors(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, line, span, head): the places where an entry's title stands, as a heading or over ``span``
    lines of 80 characters at most; ``titles`` are (doc_id, ord, title). Lines that are no ``candidates`` may be left out."""
    t = F.col("t")
    told = lines.select("doc_id", "line_no", T.trim(F.col("text")).alias("t"), T.heading_text(F.col("text")).alias("title"), "text")
    # most of a text is in long lines, which give no key and are not looked at further
    told = told.select("doc_id", "line_no", "title", "t", F.when((F.length(t) <= PIECE) | F.col("title").isNotNull(), T.contents_line(F.col("text"))).otherwise(True).alias("out"))
    told = told.select("doc_id", "line_no", "title", F.when((t != "") & ~t.rlike(r"^(<!--|```|~~~)") & ~F.col("out"), t).alias("t"))
    piece = F.when(t.isNotNull() & (F.length(t) <= PIECE) & ~t.rlike(r"^(!\[|\|)"), T.folded(F.coalesce("title", "t")))
    keys = told.select("doc_id", "line_no", F.when(t.isNotNull() & F.col("title").isNotNull(), entry_key(F.col("title"))).alias("one"), piece.alias("piece"))
    after = lambda k: F.when(F.lead("line_no", k).over(doc()) == F.col("line_no") + k, F.lead("piece", k).over(doc()))
    near = keys.withColumns({"second": after(1), "third": after(2)})
    head = F.col("one").isNotNull()
    joined = lambda *p: F.when(sum((F.col(x).isNull().cast("int") for x in p), F.lit(0)) == 0, F.concat_ws(" ", *p))
    every = F.array(F.struct(F.col("one").alias("key"), F.lit(1).alias("span")), F.struct(joined("piece", "second").alias("key"), F.lit(2).alias("span")), F.struct(joined("piece", "second", "third").alias("key"), F.lit(3).alias("span")))
    asked = titles.select("doc_id", "ord", entry_key(F.col("title")).alias("key")).where(F.length("key") >= 3)
    # a document's few keys come to its lines, which lie together already; only what they ask for is exchanged
    by_doc = asked.groupBy("doc_id").agg(F.collect_set("key").alias("asked"))
    held = near.join(by_shuffle(by_doc), "doc_id").select("doc_id", F.col("line_no").alias("line"), head.alias("head"), F.explode(F.filter(every, lambda x: F.array_contains("asked", x.key))).alias("x"))
    return asked.join(by_shuffle(held.select("doc_id", "line", "head", "x.key", "x.span")), ["doc_id", "key"]).groupBy("doc_id", "ord", "line", "head").agg(F.min("span").alias("span"))


def _bounds(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries with ``lo`` and ``hi``, the lines of their page, ``until``, where the next entry of a later page
    begins, ``n`` lines, and whether they share their page with the entry before."""
    starts = written(page_map(lines), "page-starts")
    size = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n"))
    by_page = W.partitionBy("doc_id").orderBy("page")
    paged = starts.withColumn("next", F.lead("start").over(by_page))
    # A page of the outline that the text does not mark ends where the next that it marks begins.
    later = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "start"))).alias("pages"))
    own = marks.join(size, "doc_id").join(paged.select("doc_id", "page", F.col("start").alias("lo")), ["doc_id", "page"], "left").join(later, "doc_id", "left")
    after = F.filter(F.coalesce("pages", F.array().cast("array<struct<page: int, start: int>>")), lambda x: x.page > F.col("page"))
    own = own.withColumn("hi", F.coalesce(F.get(after, F.lit(0))["start"], "n")).drop("pages")
    order = W.partitionBy("doc_id").orderBy("ord")
    more = F.collect_list(F.struct("page", "lo")).over(order.rowsBetween(1, W.unboundedFollowing))
    hit = F.filter("more", lambda x: x.lo.isNotNull() & (F.col("page").isNull() | (x.page > F.col("page"))))
    own = own.withColumns({"more": more, "shares": F.coalesce(F.lag("page").over(order) == F.col("page"), F.lit(False))})
    return own.withColumn("until", F.coalesce(F.get(hit, F.lit(0))["lo"], "n")).drop("more")


def next_page_lines(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, until): where the next entry of a later page begins, the end of the text without one."""
    return _bounds(marks, lines).select("doc_id", "ord", "until")


def placed(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, title, level, at, head): the line at which each entry of ``marks`` (doc_id, ord, title,
    level, page) goes; with ``head`` it takes the place of a heading there, else it is put before the line.

    An entry goes where its title stands between its page and the next later one of the outline, else to
    a line of its page that says it, else below the page's first line; one that shares its page with the
    entry before it has no place then. Without a page it is looked for from the place before on. Titles
    of white space have no place. Lines are read as they came, also where an entry before took one.
    """
    own = written(_bounds(marks, lines).where(F.trim("title") != ""), "entries")
    stand = anchors(own, lines)
    span = F.struct(F.col("line").alias("line"), "span", "head")
    inside = (F.col("line") >= F.coalesce("lo", F.lit(0))) & (F.col("line") + F.col("span") <= F.col("until"))
    hits = own.join(stand, ["doc_id", "ord"]).where(inside).groupBy("doc_id", "ord").agg(F.min(span).alias("first"), F.array_sort(F.collect_list(F.when(F.col("lo").isNull(), span))).alias("later"))
    hits = written(hits, "hits")
    # A line that says the title is asked for only where it does not stand.
    rest = own.join(hits.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").where("not (shares and page is not null)").unionByName(own.join(hits, ["doc_id", "ord"], "left_semi").where("lo is null"))
    asked = written(matching.with_needle(rest.select("doc_id", "ord", "title", "lo", "hi", F.col("n").alias("size"))), "sought")
    near = matching.said_in_document(asked, lines.select("doc_id", "line_no", "text"))
    near = near.where(F.col("lo").isNull() | (F.col("line_no") >= F.col("lo")) & (F.col("line_no") < F.col("hi")))
    near = near.groupBy("doc_id", "ord").agg(F.min("line_no").alias("near"), F.array_sort(F.collect_list(F.when(F.col("lo").isNull(), F.col("line_no")))).alias("nears"))
    told = own.join(hits, ["doc_id", "ord"], "left").join(near, ["doc_id", "ord"], "left")
    entry = F.struct("ord", "title", "level", "page", "lo", "until", "n", "shares", "first", F.coalesce("later", F.array().cast("array<struct<line: int, span: int, head: boolean>>")).alias("later"), "near", F.coalesce("nears", F.array().cast("array<int>")).alias("nears"))
    done = F.array().cast("array<struct<ord: int, title: string, level: int, at: int, head: boolean>>")

    def step(state: Column, e: Column) -> Column:
        hit = F.when(e["lo"].isNotNull(), e["first"]).otherwise(F.get(F.filter(e["later"], lambda x: x["line"] >= state["cursor"]), F.lit(0)))
        near = F.when(e["lo"].isNotNull(), F.coalesce(e["near"], F.least(e["lo"] + 1, e["n"]))).otherwise(F.coalesce(F.get(F.filter(e["nears"], lambda x: x >= state["cursor"]), F.lit(0)), F.least(state["cursor"], e["n"])))
        at = F.when(hit.isNotNull(), hit["line"]).when(e["shares"] & e["page"].isNotNull(), F.lit(None)).otherwise(near)
        head = F.coalesce(hit["head"], F.lit(False))
        made = F.struct(e["ord"].alias("ord"), e["title"].alias("title"), e["level"].alias("level"), at.alias("at"), head.alias("head"))
        cursor = F.when(at.isNull(), state["cursor"]).when(head, at + 1).otherwise(F.least(e["n"], at + 1))
        return F.struct(cursor.cast("int").alias("cursor"), F.when(at.isNull(), state["done"]).otherwise(F.array_append(state["done"], made)).alias("done"))

    folded = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    made = folded.select("doc_id", F.explode(F.aggregate("entries", F.struct(F.lit(0).alias("cursor"), done.alias("done")), step)["done"]).alias("x"))
    return made.select("doc_id", "x.*")


def _heading(level: Column, title: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level))), F.lit(" "), F.trim(title))


def located(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, title, line): the entries with the lines that they have in the stitched text."""
    gone = lines.where(F.lower(T.heading_text(F.col("text"))) == "outline").select("doc_id", F.col("line_no").alias("at"), F.lit(None).cast("int").alias("ord"))
    taken = places.where("head").select("doc_id", "at").distinct()
    gone = gone.join(taken, ["doc_id", "at"], "left_anti")  # a heading that an entry took is written anew
    every = places.select("doc_id", "ord", "title", "at", "head").unionByName(gone, allowMissingColumns=True)
    put = F.when(F.col("ord").isNull(), F.lit(-1)).when(F.col("head"), F.lit(0)).otherwise(F.lit(3))
    # what is put before a line stands before that line itself, so an entry counts those at its line but later ones
    rank = F.struct(F.col("at"), F.coalesce(F.col("head"), F.lit(True)).alias("own"), F.col("ord"))
    before = F.coalesce(F.sum(put).over(W.partitionBy("doc_id").orderBy(rank).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return every.withColumn("line", (F.col("at") + before + F.when(F.col("head"), F.lit(0)).otherwise(F.lit(1))).cast("int")).where("ord is not null").select("doc_id", "ord", "title", "line")


def stitched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with the entries as headings; a heading that says Outline goes.

    The edits of a document are one row of it; only here does a text meet them, in a join by document.
    """
    edits = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ord", "head", _heading(F.col("level"), F.col("title")).alias("line")))).alias("edits"))
    own = docs.select("doc_id", F.split(F.concat(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\n")), "\n").alias("lines")).join(edits, "doc_id", "left")
    own = own.withColumn("edits", F.coalesce("edits", F.array().cast(edits.schema["edits"].dataType)))
    by_line = F.map_from_entries(F.transform(F.array_distinct(F.transform("edits", lambda e: e["at"])), lambda at: F.struct(at, F.filter("edits", lambda e: e["at"] == at))))
    own = own.withColumn("by_line", by_line).withColumn("last", F.size("lines") - 1)

    def line(x: Column, i: Column) -> Column:
        here = F.coalesce(F.element_at("by_line", i), F.array().cast(edits.schema["edits"].dataType))
        put = F.flatten(F.transform(F.filter(here, lambda e: ~e["head"]), lambda e: F.array(F.lit(""), e["line"], F.lit(""))))
        heads = F.filter(here, lambda e: e["head"])
        outline = F.coalesce(F.lower(T.heading_text(x)) == "outline", F.lit(False))
        own_line = F.when(i == F.col("last"), F.array().cast("array<string>")).when(F.size(heads) > 0, F.array(F.element_at(heads, -1)["line"])).when(outline, F.array().cast("array<string>")).otherwise(F.array(x))
        return F.concat(put, own_line)

    return own.select("doc_id", F.array_join(F.flatten(F.transform("lines", line)), "\n").alias("text"))


def distinctive(page: Column) -> Column:
    """The first line of a page of 28 characters or more, else of 20, up to 160, with a letter; no contents line."""
    said = F.filter(F.split(page, "\n"), lambda x: F.length(T.trim(x)).between(20, 160) & x.rlike(r"\p{L}") & ~T.contents_line(x))
    told = F.transform(said, lambda x: T.trim(x))
    return F.coalesce(F.get(F.filter(told, lambda x: F.length(x) >= 28), F.lit(0)), F.get(told, F.lit(0)))


#: Lines of a document that meet its pages' distinctive lines in one task.
STRETCH = 4096


def _words(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def _inner_word(text: Column) -> Column:
    """The longest word of a text that has a blank before and after it; null for one of two words. A text that holds
    this one has it among its words."""
    words = F.split(text, " ")
    return F.xxhash64(F.array_max(F.transform(F.slice(words, 2, F.size(words) - 2), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])


def _needle_lines(own: DataFrame, sizes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, needle, line_no): the lines that hold a needle of their document (``own`` has doc_id, needle) or are part
    of it, both of 16 characters or more; no contents lines. The needles of a document come to its lines with
    words of theirs, of which a line that is to be looked at has one; a line's words are gone through once."""
    few = lambda c: F.size(F.split(c, " ")) < 3
    asked = own.where(F.length("needle") >= matching.WINDOW).select("doc_id", "needle").distinct()
    asked = asked.select("doc_id", "needle", few(F.col("needle")).alias("few"), F.when(~few(F.col("needle")), _inner_word(F.col("needle"))).alias("begun"), _words(F.col("needle")).alias("keys"))
    by_doc = asked.groupBy("doc_id").agg(F.collect_list("needle").alias("needles"), F.max(F.length("needle")).alias("longest"), F.bool_or("few").alias("few"), F.collect_set("begun").alias("begun"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    by_doc = by_doc.join(by_shuffle(sizes), "doc_id").select("doc_id", "needles", "longest", "few", "begun", "keys", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / STRETCH).cast("int"))).alias("stretch"))
    said = lines.where(~T.contents_line(F.col("text"))).select("doc_id", "line_no", F.floor(F.col("line_no") / STRETCH).cast("int").alias("stretch"), T.folded(F.col("text")).alias("said"))
    both = said.where(F.length("said") >= matching.WINDOW).join(by_shuffle(by_doc), ["doc_id", "stretch"])
    part = F.when(F.length("said") <= F.col("longest"), F.when(few(F.col("said")), F.lit(True)).otherwise(F.array_contains("keys", _inner_word(F.col("said"))))).otherwise(F.lit(False))
    near = both.where(F.col("few") | part | F.arrays_overlap(_words(F.col("said")), "begun"))
    found = F.filter("needles", lambda x: F.contains("said", x) | F.contains(x, F.col("said")))
    return near.select("doc_id", "line_no", F.explode(found).alias("needle"))


def page_marks(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, at, put): the line that each page of ``pages`` (doc_id, page, text), from 0, begins at, and
    whether a mark is put before it; none for a text that has two marks or two page headings already.

    A page begins at the first line after the one before that holds its distinctive line or is part of it,
    else at its share of the lines left. Candidates come from equal keys; a line is exchanged once, its
    keys never, and only line numbers are folded.
    """
    title = T.folded(T.heading_text(F.col("text")))
    headed = title.rlike("^page +[0-9]{1,9}$") & ~title.rlike("^page +0+$")
    told = lines.select("doc_id", "line_no", T.page_comment(F.col("text")).alias("mark"), F.coalesce(headed, F.lit(False)).cast("int").alias("headed"))
    sizes = told.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n"), F.count_distinct("mark").alias("marks"), F.sum("headed").alias("heads")).where("marks < 2 and heads < 2").select("doc_id", "n")
    sizes = written(sizes, "unmarked")
    needles = pages.select("doc_id", "page", T.folded(distinctive(F.col("text"))).alias("needle"))
    own = written(needles.join(by_shuffle(sizes), "doc_id", "left_semi"), "pages")
    hits = _needle_lines(own, sizes, lines).groupBy("doc_id", "needle").agg(F.array_sort(F.collect_set("line_no")).alias("hits"))
    rows = own.join(by_shuffle(hits), ["doc_id", "needle"], "left").select("doc_id", F.struct("page", F.coalesce("hits", F.array().cast("array<int>")).alias("hits")).alias("row"))
    folded = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows")).join(by_shuffle(sizes), "doc_id")

    def step(acc: Column, row: Column) -> Column:
        hit = F.get(F.filter(row["hits"], lambda x: x >= acc["cursor"]), F.lit(0))
        share = acc["cursor"] + F.floor(F.greatest(F.lit(1), F.col("n") - acc["cursor"]) / F.greatest(F.lit(1), F.size("rows") - F.size(acc["out"]))).cast("int")
        at = F.coalesce(hit, F.least(F.col("n"), share))
        return F.struct(F.least(F.col("n"), at + 1).alias("cursor"), F.array_append(acc["out"], F.struct(row["page"].alias("page"), at.alias("at"))).alias("out"))

    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<page: int, at: int>>").alias("out"))
    made = folded.select("doc_id", "n", F.explode(F.aggregate("rows", zero, step)["out"]).alias("x")).select("doc_id", "n", "x.*")
    marks = lines.where(F.contains("text", F.lit("<!-- page"))).select("doc_id", "line_no", "text")
    here = marks.select("doc_id", F.col("line_no").alias("at"), F.lit(True).alias("here"))
    above = marks.select("doc_id", (F.col("line_no") + 1).alias("at"), F.col("text").alias("above"))
    last = F.max("page").over(W.partitionBy("doc_id", "at"))
    out = made.withColumn("last", last).join(by_shuffle(here), ["doc_id", "at"], "left").join(by_shuffle(above), ["doc_id", "at"], "left")
    said_so = F.contains("above", F.concat(F.lit("<!-- page "), (F.col("page") + 1).cast("string")))
    return out.select("doc_id", "page", "at", (F.col("here").isNull() & ~F.coalesce(said_so, F.lit(False)) & (F.col("page") == F.col("last"))).alias("put"))
