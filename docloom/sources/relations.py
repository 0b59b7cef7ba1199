"""The relations that documents, pages and conversations are read into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File kinds that are taken in; those that need no conversion.
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "md", "markdown", "txt", "epub", "csv", "json", "xml", "msg", "jpg", "jpeg", "png", "gif", "webp", "tif", "tiff", "zip", "rtf"]
READY = ["md", "markdown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(doc_id, line_no, text): one row a line, empty ones too; a null text has none."""
    keys = keys or ("doc_id",)
    return docs.select(*keys, F.posexplode(F.split(unix_lines(F.col(text)), "\n")).alias("line_no", "text"))


def html_text(html: Column) -> Column:
    """Tags as blanks, scripts and styles left out, four entities decoded."""
    for r in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", r"<[^>]+>"):
        html = F.regexp_replace(html, r, " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        html = F.replace(html, F.lit(a), F.lit(b))
    return html


def html_markdown(html: Column) -> Column:
    """Headings, list items, paragraphs and breaks as Markdown; other tags go, five entities are decoded."""
    for r, to in (("<h1[^>]*>", "\n# "), ("<h2[^>]*>", "\n## "), ("<h3[^>]*>", "\n### "), ("</h[1-6]>", "\n"), ("<li[^>]*>", "\n- "), ("<p[^>]*>", "\n\n"), (r"<br\s*/?>", "\n")):
        html = F.regexp_replace(html, f"(?i){r}", to)
    html = F.regexp_replace(html, "<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        html = F.replace(html, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.regexp_replace(html, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(text == "", "_Empty Word file._").otherwise(text)


def xml_text(xml: Column) -> Column:
    """Paragraph ends as line ends, tags out, three entities decoded, no blanks at line ends nor white space round it."""
    t = F.regexp_replace(F.regexp_replace(xml, "</(w:p|a:p|si)>", "\n"), "<[^>]+>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def url_source(url: Column) -> Column:
    """Absolute path that an application URL asks to open, by its file, path or url parameter; null without one."""
    pairs = F.transform(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.split(p, "=", 2))
    asked = F.filter(pairs, lambda p: F.lower(F.get(p, F.lit(0))).isin("file", "path", "url") & (F.coalesce(F.get(p, F.lit(1)), F.lit("")) != ""))
    raw = F.url_decode(F.replace(F.get(F.get(asked, F.lit(0)), F.lit(1)), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(raw, "^file://", "")
    return F.when(F.startswith(path, F.lit("/")), path)


def bounded(data: Column, most: int = 2_000_000) -> Column:
    """The first ``most`` bytes of a file; null for one of eight bytes or fewer."""
    return F.when(F.length(data) > 8, F.substring(data, 1, most))


def decoded(data: Column) -> Column:
    """UTF-8, up to four bytes of a cut character left out at the end, or else Latin-1."""
    tries = [F.try_validate_utf8(F.when(F.length(data) > 8 + k - 1, F.substring(data, F.lit(1), F.length(data) - k)).cast("string")) for k in range(1, 5)]
    return F.coalesce(F.try_validate_utf8(data.cast("string")), *tries, F.decode(data, "ISO-8859-1"))


def letters_left(text: Column) -> Column:
    """Letters and marks of a converted text beside pictures, comments and page headings."""
    body = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " "), r"<!--[\s\S]*?-->", " ")
    return F.regexp_count(F.regexp_replace(body, r"(?m)^#+\s*Page\s+[0-9]+\s*$", " "), F.lit(r"[\p{L}\p{M}]"))


def thin(text: Column, pages: Column) -> Column:
    """Whether a converted text has under 25 letters a page, or under 60."""
    return letters_left(text) < F.greatest(F.lit(60), pages * 25)


def blank(text: Column) -> Column:
    """Whether a converted text has under 80 characters beside Markdown's marks."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[>#*\-\[\]()`]", " "), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")) < 80


def csv_markdown(text: Column) -> Column:
    """A Markdown table of comma-separated lines; commas always separate."""
    rows = F.filter(F.split(text, "[\n\r]+"), lambda r: r != "")
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.split(r, ","), lambda c: F.trim(c)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.split(F.element_at(rows, 1), ","), lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.concat(F.array(row(F.element_at(rows, 1)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), row))
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(F.array_join(body, "\n"), F.lit("\n")))


#: A line as one of 64 forms, so that every line rule has something to find and something to refuse; valid in both SQL dialects.
PROBE = """CASE (doc_id * 7 + line_no) % 64
 WHEN 0 THEN '## ' || substr(text, 1, 60) WHEN 1 THEN '#' || substr(text, 1, 30) WHEN 2 THEN '**' || substr(text, 1, 20) || '**'
 WHEN 3 THEN '<!-- page ' || CAST(line_no AS VARCHAR(9)) || ' -->' WHEN 4 THEN '8.1 ' || substr(text, 1, 40) WHEN 5 THEN '1 ' || substr(text, 1, 30)
 WHEN 6 THEN CAST(doc_id % 12000 AS VARCHAR(9)) WHEN 7 THEN 'S o m e t' WHEN 8 THEN 'Chapter ' || substr(text, 1, 10) || ' ...... ' || CAST(line_no AS VARCHAR(9))
 WHEN 9 THEN '- ' || substr(text, 1, 25) WHEN 10 THEN '  3. ' || substr(text, 1, 25) WHEN 11 THEN 'Page ' || CAST(line_no AS VARCHAR(9))
 WHEN 12 THEN 'XIV.' WHEN 13 THEN '| ' || substr(text, 1, 12) || ' | b | |' WHEN 14 THEN '| --- | :-: |' WHEN 15 THEN '   '
 WHEN 16 THEN 'MIX' WHEN 17 THEN '#### ' WHEN 18 THEN substr(text, 1, 20) || '   ' || CAST(line_no % 100 AS VARCHAR(9)) WHEN 19 THEN 'Published by Some House, ' || CAST(1400 + doc_id % 700 AS VARCHAR(9))
 WHEN 23 THEN '  # ' || substr(text, 1, 20) || '  ' WHEN 24 THEN '#######' || ' x' WHEN 25 THEN '###' || chr(9) || substr(text, 1, 9) WHEN 26 THEN '** a * b **' WHEN 27 THEN '**a** and **b**'
 WHEN 28 THEN '<!-- page   ' || CAST(line_no AS VARCHAR(9)) || '   -->' WHEN 29 THEN '<!-- page 0 -->' WHEN 30 THEN '<!-- page x -->' WHEN 31 THEN chr(9) || '* ' || substr(text, 1, 25) WHEN 32 THEN '12) ' || substr(text, 1, 9)
 WHEN 33 THEN '1234567. ' || substr(text, 1, 9) WHEN 34 THEN '12345678. x' WHEN 35 THEN 'a. b .. ' || CAST(line_no AS VARCHAR(9)) WHEN 36 THEN 'x..7' WHEN 37 THEN '  ' || substr(text, 1, 12) || '   12  ' WHEN 38 THEN '   77'
 WHEN 39 THEN '/Users/ann smith/books/' || substr(text, 1, 8) WHEN 40 THEN '![a](figures/' || substr(text, 1, 5) || '.png "t")' WHEN 41 THEN 'see ![x](a/b.png)' WHEN 42 THEN '![y](' || chr(39) || 'p/q.jpg' || chr(39) || ') tail' WHEN 43 THEN '![z]()'
 WHEN 44 THEN '# 12 ' || substr(text, 1, 9) WHEN 45 THEN '## XML ' || substr(text, 1, 4) WHEN 46 THEN '## ?!' WHEN 47 THEN '## ' || substr(text, 1, 3) WHEN 48 THEN 'Copyright (c) ' || CAST(1900 + doc_id % 120 AS VARCHAR(9)) || ' by A. Name.' WHEN 49 THEN 'copyright'
 WHEN 50 THEN 'published by ' || substr(text, 1, 12) || '.' WHEN 51 THEN 'ISBN-13: 978-0-306-40615-7' WHEN 52 THEN 'www.example.org' WHEN 53 THEN 'https://example.org/a' WHEN 54 THEN 'The www.example.org' WHEN 55 THEN '“A'
 WHEN 56 THEN 'ver 1.2 ' || substr(text, 1, 9) WHEN 57 THEN '8.1.2Title glued to it' WHEN 58 THEN '9.9 page of things' WHEN 59 THEN '- ' WHEN 60 THEN 'he final ' || substr(text, 1, 9) WHEN 61 THEN '<!--ym-tr-->## ' || substr(text, 1, 9) WHEN 62 THEN '  -x: y'
 WHEN 20 THEN '/home/user' || CAST(line_no AS VARCHAR(9)) || '/books/' || substr(text, 1, 8) WHEN 21 THEN 'ISBN 978-0-306-40615-' || CAST(line_no % 10 AS VARCHAR(9)) WHEN 22 THEN 'en-US' ELSE text END"""


def probe_lines(docs: DataFrame) -> DataFrame:
    return lines(docs).select("doc_id", "line_no", F.expr(PROBE).alias("text"))


def page_lines(chats: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): a book for each conversation, a page for each turn, with a page mark, a
    running header, a numbered heading and a page number."""
    n = (F.col("turn") + 1).cast("string")
    page = F.concat(
        F.array(F.concat(F.lit("<!-- page "), n, F.lit(" -->")), F.lit("Reader Notes"), F.concat(n, F.lit(".1 Opening Remarks"))),
        F.split(unix_lines(F.col("text")), "\n"),
        F.array(F.lit(""), n),
    )
    rows = chats.where("text is not null").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(page).alias("k", "text"))
    order = W.partitionBy("doc_id").orderBy("turn", "k")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), "text")


def markdown_lines(pages: DataFrame) -> DataFrame:
    return lines(pages.select(F.col("page_id").alias("doc_id"), html_markdown(F.col("html")).alias("text")))


def cards(docs: DataFrame) -> DataFrame:
    """A library card for each document."""
    path = F.concat(F.lit("/lib/"), "source", F.when(F.col("lang") != "en", F.concat(F.lit("."), "lang")).otherwise(""), F.lit(".md"))
    return docs.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.array("lang", "source").alias("tags"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("/lib/"), "source", F.lit(".PDF"))).otherwise("").alias("source_path"),
        F.concat(F.col("source"), F.lit(".pdf")).alias("source_name"), path.alias("markdown_path"), F.col("doc_id").alias("added"), (F.col("doc_id") * 37 % 1009).alias("opened"), F.octet_length("text").alias("bytes"),
    )
