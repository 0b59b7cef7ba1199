"""Catalog records, clips, jobs and batches: small records as Columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def yaml_quoted(c: Column) -> Column:
    """A scalar on one line, quoted where YAML would read something else."""
    t = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
    odd = t.rlike(r"[:#\[\]{}&*!|>'\"%@`]|^[-?]|^$")
    return F.when(odd, F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(t)


def yaml_escaped(c: Column) -> Column:
    """A value in double quotes on one line."""
    flat = F.regexp_replace(c, "\r\n|\n|\r", " ")
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


#: Keys of a record's block in their order, and the fields they come from; authors and subjects are lists.
BLOCK = [
    ("title", "title"), ("author", "authors"), ("publisher", "publisher"), ("date", "date"), ("rights", "rights"), ("description", "summary"), ("subject", "subjects"),
    ("lang", "lang"), ("identifier", "isbn"), ("source", "source_name"), ("created", "created"), ("pdf-creator", "pdf_creator"), ("pdf-producer", "pdf_producer"),
]


def yaml_block(have: dict[str, Column]) -> Column:
    """Front matter of a record's fields that are not empty, with an empty line below; null without any."""
    rows = []
    for key, field in BLOCK:
        c = have.get(field)
        if c is None:
            continue
        if key in ("author", "subject"):
            items = F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
            listed = F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), yaml_escaped(x))), "\n"))
            rows.append(F.when(F.size(items) > 0, listed).when(F.size(c) > 0, F.lit(f"{key}:")))
        elif key == "identifier":
            n = T.valid_isbn(c)
            rows.append(F.when(n.isNotNull(), F.concat(F.lit("identifier:\n  - scheme: ISBN-"), F.length(n).cast("string"), F.lit("\n    text: "), yaml_escaped(n))))
        else:
            t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
            rows.append(F.when(t != "", F.concat(F.lit(f"{key}: "), yaml_escaped(t))))
    body = F.concat_ws("\n", *rows)
    return F.when(body != "", F.concat(F.lit("---\n"), body, F.lit("\n---\n\n")))


def titled(text: Column, title: Column, source: Column) -> Column:
    """A block of title and source in front, unless the text begins with one or there is no title."""
    named = F.coalesce(F.trim(title), F.lit(""))
    block = F.concat(F.lit("---\ntitle: "), yaml_quoted(named), F.lit("\nsource: "), yaml_quoted(source), F.lit("\n---\n\n"), text)
    return F.when(F.regexp_replace(text, r"^\s+", "").startswith("---") | (named == ""), text).otherwise(block)


def opf(fields: list[tuple[str, Column]]) -> Column:
    rows = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<dc:{k}>"), T.xml_escape(c), F.lit(f"</dc:{k}>"))) for k, c in fields]
    return F.concat_ws("\n", *rows)


def filled(*sources: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*(F.when(s != "", s) for s in sources))


def newer(a: Column, b: Column) -> Column:
    """Dotted versions as numbers: the digits of each part, parts without any left out, missing ones zero."""
    parts = lambda c: F.filter(F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, r"[^0-9]", "").try_cast("long")), lambda n: n.isNotNull())
    x, y = parts(a), parts(b)
    padded = lambda p, other: F.concat(p, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.size(other) - F.size(p))))
    return padded(x, y) > padded(y, x)


_DOT = r"^[ .]+|[ .]+$"


def copyright_fields(line: Column) -> Column:
    """rights|year|author of a copyright line; null for other lines."""
    t, r = T.plain_line(line), r"(?i)^copyright\b(?:\s*(?:©|\(c\)))?\s*[, ]*\s*([0-9]{4})?(?:\s+by\s+(.+))?$"
    year, name = F.regexp_extract(t, r, 1), F.regexp_replace(F.regexp_extract(t, r, 2), _DOT, "")
    author = F.when(F.length(name) >= 2, name).otherwise("")
    rights = F.concat(F.lit("Copyright"), F.when(year != "", F.concat(F.lit(" © "), year)).otherwise(""), F.when(author != "", F.concat(F.lit(" by "), author)).otherwise(""))
    return F.when(t.rlike(r), F.concat_ws("|", rights, year, author))


def published_by(line: Column) -> Column:
    """The house that a line says published the book; null for other lines."""
    t, r = T.plain_line(line), r"(?i)^published by\s+(.{2,80})$"
    name = F.regexp_replace(F.regexp_extract(t, r, 1), _DOT, "")
    return F.when(t.rlike(r) & (F.length(name) >= 2), name)


def isbn_line(line: Column) -> Column:
    t, r = T.plain_line(line), r"(?i)^isbn(?:-1[03])?\s*[:#]?\s*([0-9x][0-9x \-]{8,22})$"
    return F.when(t.rlike(r), F.regexp_extract(t, r, 1))


def page_tick(c: Column) -> Column:
    """page|count of ``page N of M``."""
    r = r"(?i)page ([0-9]+) of ([0-9]+)"
    return F.when(c.rlike(r), F.concat_ws("|", F.regexp_extract(c, r, 1), F.regexp_extract(c, r, 2)))


# What an answer says when the source has none.
SILENT = [
    "excerpt does not", "excerpt is silent", "not in the excerpt", "not in this chapter", "not in this file", "does not define", "does not provide an answer",
    "does not mention", "not mentioned", "not defined in",
]


def silent(c: Column) -> Column:
    """An answer that says the source has none."""
    low, out = F.lower(c), F.lit(False)
    for phrase in SILENT:
        out = out | F.contains(low, F.lit(phrase))
    return out


def web_query(*parts: Column) -> Column:
    """Question, title, chapter and note, so far as there are any."""
    return F.concat_ws(" — ", *(F.when(p != "", p) for p in parts))


def clip(text: Column, chapter: Column, title: Column, page: Column) -> Column:
    cite = F.concat(F.lit("*"), F.concat_ws(" · ", title, F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string")))), F.lit("*"))
    return F.concat_ws("\n\n", F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit("### "), chapter)), F.regexp_replace(text, r"^\s+|\s+$", ""), cite)


def passages(lines: DataFrame, hits: DataFrame, *, ahead: int = 6, longest: int = 500) -> DataFrame:
    """(doc_id, line_no, passage): up to six lines from a hit, to the next heading, or over 500 characters."""
    near = hits.select("doc_id", F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no"), F.col("line_no") + ahead - 1)).alias("line_no"))
    rows = near.join(lines, ["doc_id", "line_no"])
    at = W.partitionBy("doc_id", "hit").orderBy("line_no")
    t = T.trim(F.col("text"))
    stops = F.sum((F.startswith(t, F.lit("#")) & (F.col("line_no") > F.col("hit"))).cast("int")).over(at)
    use = (t != "") & ~F.startswith(t, F.lit("<!--"))
    size = F.sum(F.when(use, F.length("text") + 1).otherwise(0)).over(at)
    rows = rows.withColumns({"stops": stops, "use": use, "size": size})
    before = F.coalesce(F.lag("size").over(at), F.lit(0)) - 1
    rows = rows.withColumn("before", before).where("use and stops = 0 and before <= %d" % longest)
    held = rows.groupBy("doc_id", "hit").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("r"))
    return held.select("doc_id", F.col("hit").alias("line_no"), F.array_join(F.transform("r", lambda x: x.text), "\n").alias("passage"))


def progress(ticks: DataFrame) -> DataFrame:
    """(job, at, page, eta): time left at the pace since the first tick; ticks are (job, at, page, pages)."""
    w = W.partitionBy("job").orderBy("at", "page")
    first = ticks.withColumns({"at0": F.first("at").over(w), "page0": F.first("page").over(w)})
    pace = (F.col("at") - F.col("at0")) / F.nullif(F.col("page") - F.col("page0"), F.lit(0))
    return first.select("job", "at", "page", F.when(F.col("page") > F.col("page0"), pace * (F.col("pages") - F.col("page"))).alias("eta"))


def chunks(text: Column, most: int) -> Column:
    """Paragraphs put together up to ``most`` characters, greedily; a longer paragraph stands alone."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n{2,}")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["buf"], F.lit("\n\n"), p)
        over = (F.length(joined) > most) & (acc["buf"] != "")
        done = F.when(over, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over | (acc["buf"] == ""), p).otherwise(joined).alias("buf"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]))


def fixed_batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def numbered_reply(c: Column, count: int = 1 << 30) -> Column:
    """Texts of a reply marked ``<<<n>>>``, numbers from 1 to ``count``; the last of a number holds."""
    parts = F.filter(F.split(c, "<<<"), lambda p: p.rlike("^[0-9]+>>>") & F.regexp_extract(p, "^([0-9]+)", 1).try_cast("int").between(1, count))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([0-9]+)>>>", 1).cast("int").alias("n"), F.regexp_replace(F.regexp_replace(p, "^[0-9]+>>>", ""), r"^\s+|\s+$", "").alias("t")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["n"] == p["n"]))
    return F.transform(F.array_sort(last), lambda p: F.concat_ws("|", p["n"].cast("string"), p["t"]))


def unquoted(c: Column) -> Column:
    """A YAML scalar without the quotes round it, its escapes undone."""
    t = T.trim(c)
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    for a, b in (('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    return F.when((F.length(t) >= 2) & F.left(t, F.lit(1)).isin('"', "'") & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))), inner).otherwise(t)
