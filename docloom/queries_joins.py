"""Queries of joins between outlines, lines, words and answers, with DuckDB SQL written apart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from . import queries
from .functions import text as T
from .operators import budgets, claims, following, lexicon, matching, ornaments, outline, scan, stitching, tracking
from .queries_passes import BOOK, _book
from .sources import relations as R
from .sources.shared import by_shuffle, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _probe(s: SparkSession, d: str) -> DataFrame:
    return R.probe_lines(_docs(s, d))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return R.lines(_book(s, d))


#: The books of ``queries_passes`` in the other dialect.
BOOKS = "b AS (SELECT doc_id, " + re.sub(r"\bi\b", "(j - 1)", BOOK.replace("array_join(transform(split(text, '\n'), (x, i) ->", "array_to_string(list_transform(string_split(text, '\n'), lambda x, j:")) + " AS text FROM documents WHERE text IS NOT NULL), probe AS (" + O.split_lines("b", "doc_id", "text") + ")"
_heads = "h0 AS (SELECT doc_id, line_no, " + O.heading_text("text") + " AS title, least(" + O.heading_marks("text") + ", 3) AS level FROM probe), h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord, line_no, level::INT AS level, title FROM h0 WHERE title IS NOT NULL AND title <> 'Outline' AND NOT " + O.page_like("title") + " QUALIFY ord <= 180)"
_said = f"s AS (SELECT doc_id, line_no, {O.folded('text')} AS a, ({O.heading_text('text')}) IS NOT NULL AS head FROM probe WHERE NOT {O.contents_line('text')})"
_says = "length(x) >= 3 AND length(a) >= 3 AND ((starts_with(a, x) AND NOT regexp_matches(substr(a, length(x) + 1, 1), '^\\p{L}')) OR (length(a) >= 16 AND starts_with(x, a) AND NOT starts_with(a, 'page ')) OR (NOT head AND length(a) <= 120 AND length(x) >= 8 AND NOT starts_with(a, x) AND contains(a, x)))"
_add(
    "f03_fuzzy_lines", lambda s, d: (lambda p: matching.lines_saying(outline.headings(p), p))(_probe(s, d)),
    f"WITH {O.PROBES}, {_heads}, {_said}, n AS (SELECT DISTINCT doc_id, title, {O.folded('title')} AS x FROM h) SELECT doc_id, line_no, title FROM n JOIN s USING (doc_id) WHERE {_says}",
)
_add(
    "i09_fuzzy_join", lambda s, d: (lambda p: matching.titles_elsewhere(outline.headings(p), p))(_probe(s, d)),
    f"WITH {O.PROBES}, {_heads}, {_said}, c AS (SELECT a, head, count(*) AS times, min(doc_id) AS f FROM s GROUP BY 1, 2), n AS (SELECT DISTINCT {O.folded('title')} AS x FROM h) SELECT x AS title, count(*) AS texts, CAST(sum(times) AS BIGINT) AS lines, min(f) AS first_doc FROM n JOIN c ON {_says} GROUP BY 1",
)


# Outlines put into texts.
def _outline(s: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """An outline of a book's own headings, a third of them without a page, and two entries besides: a title
    that wraps and one that stands nowhere. ``lines`` are those of the books, if they are at hand."""
    h = written(outline.headings(_pages(s, d) if lines is None else lines), "headings")
    own = h.select("doc_id", (F.col("ord") * 2).alias("ord"), "title", (1 + F.col("ord") % 3).alias("level"), F.when(F.col("ord") % 3 != 0, F.col("ord") % 7).cast("int").alias("page"))
    more = F.expr("stack(2, 1, 'Why Life Is Not Working—and Why Another Way', 2, cast(null as int), 5, 'Not there', 2, 1) as (ord, title, level, page)")
    return own.unionByName(h.select("doc_id").distinct().select("doc_id", more))


_marks = "m AS (SELECT doc_id, ord * 2 AS ord, title, CASE WHEN ord % 3 <> 0 THEN ord % 7 END AS page FROM h UNION ALL SELECT DISTINCT doc_id, 1, 'Why Life Is Not Working—and Why Another Way', NULL FROM h UNION ALL SELECT DISTINCT doc_id, 5, 'Not there', 1 FROM h)"
_core = lambda x: f"(CASE WHEN length({O.sub(O.folded(x), '^[0-9]+([.][0-9]+)*[ ]+')}) >= 3 THEN {O.sub(O.folded(x), '^[0-9]+([.][0-9]+)*[ ]+')} ELSE {O.folded(x)} END)"
_start = f"g AS (SELECT doc_id, line_no, try_cast(regexp_extract({O.folded('(' + O.heading_text('text') + ')')}, '^page +([0-9]{{1,9}})$', 1) AS INT) AS hd, ({O.page_comment('text')}) AS mk FROM probe), starts AS (SELECT doc_id, coalesce(hd, mk) - 1 AS page, coalesce(max(CASE WHEN hd > 0 THEN line_no END), min(line_no)) AS start FROM g WHERE hd > 0 OR mk IS NOT NULL GROUP BY ALL)"
_add("f04_page_map", lambda s, d: stitching.page_map(_pages(s, d)), f"WITH {BOOKS}, {_start} SELECT * FROM starts")
_add(
    "f02_title_anchors", lambda s, d: (lambda p: stitching.anchors(_outline(s, d, p), p))(written(_pages(s, d).where(stitching.candidates()), "pieces")).groupBy("doc_id", "ord").agg(F.min(F.struct("line", "span")).alias("x")).select("doc_id", "ord", "x.line", "x.span"),
    f"""WITH {BOOKS}, {_heads}, {_marks}, l AS (SELECT doc_id, line_no, {O.trim('text')} AS t, ({O.heading_text('text')}) AS ht, {O.contents_line('text')} AS c FROM probe), k AS (SELECT doc_id, line_no, ht, t <> '' AND NOT regexp_matches(t, '^(<!--|```|~~~)') AND NOT c AS ok, CASE WHEN ok AND length(t) <= 80 AND NOT regexp_matches(t, '^(!\\[|\\|)') THEN {O.folded('coalesce(ht, t)')} END AS p FROM l),
    w AS (SELECT *, lead(p) OVER o AS p2, lead(p, 2) OVER o AS p3 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)), e AS (SELECT doc_id, line_no, {_core('ht')} AS key, 1 AS span FROM w WHERE ok AND ht IS NOT NULL UNION ALL SELECT doc_id, line_no, p || ' ' || p2, 2 FROM w UNION ALL SELECT doc_id, line_no, p || ' ' || p2 || ' ' || p3, 3 FROM w),
    a AS (SELECT doc_id, ord, {_core('title')} AS key FROM m), f AS (SELECT a.doc_id, ord, min((line_no, span)) AS x FROM a JOIN e ON a.doc_id = e.doc_id AND a.key = e.key WHERE length(a.key) >= 3 GROUP BY ALL) SELECT doc_id, ord, x[1] AS line, x[2] AS span FROM f""",
)
_add(
    "s24_next_page_lines", lambda s, d: stitching.next_page_lines(_outline(s, d), _pages(s, d)),
    f"WITH {BOOKS}, {_heads}, {_marks}, {_start}, n AS (SELECT doc_id, max(line_no) + 1 AS n FROM probe GROUP BY 1), later AS (SELECT a.doc_id, a.ord, arg_min(start, b.ord) AS line FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.ord > a.ord AND (a.page IS NULL OR b.page > a.page) JOIN starts s ON s.doc_id = b.doc_id AND s.page = b.page GROUP BY ALL) SELECT m.doc_id, m.ord, coalesce(line, n)::INT AS until FROM m JOIN n USING (doc_id) LEFT JOIN later USING (doc_id, ord)",
)
_add("f01_stitched", lambda s, d: stitching.stitched(_book(s, d), stitching.placed(_outline(s, d), _pages(s, d))))
_add("f01b_stitched_outline", lambda s, d: (lambda p: stitching.located(stitching.placed(_outline(s, d), p), p))(_pages(s, d)))

# Rules that go from line to line, as scans in two levels; tests/test_scan.py holds them against the plain passes.
for _name, _edits in {"d04_broken_words": scan.hyphens, "d06_repeated_marks": scan.repeated_marks, "d21_blank_run_text": scan.blank_runs, "d24_subheadings": scan.subheadings, "d27_joined_headings": scan.joined_headings}.items():
    _add(_name, lambda s, d, edits=_edits: edits(_pages(s, d)))
_add("d36_edited_lines", lambda s, d: (lambda p: scan.line_map(p, scan.blank_runs(p)))(_pages(s, d)))
_add(
    "j10_running_state", lambda s, d: scan.free(_pages(s, d)),
    f"WITH {BOOKS}, f AS (SELECT doc_id, line_no, regexp_matches({O.trim('text')}, '^(```|~~~)')::INT AS mark FROM probe) SELECT doc_id, line_no, mark = 0 AND coalesce(sum(mark) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS free FROM f",
)

# Outlines and the headings of another text.
_hd = f"hd AS (SELECT doc_id, line_no, ({O.heading_text('text')}) AS title FROM probe), hk AS (SELECT doc_id, line_no, title, {O.folded('title')} AS key, row_number() OVER (PARTITION BY doc_id, {O.folded('title')} ORDER BY line_no) AS nth FROM hd WHERE title IS NOT NULL)"
_add(
    "f06_claimed_outline", lambda s, d: claims.claimed(_outline(s, d), _pages(s, d)),
    f"""WITH {BOOKS}, {_heads}, {_marks}, {_hd}, mk AS (SELECT doc_id, ord, {O.folded('title')} AS key, row_number() OVER (PARTITION BY doc_id, {O.folded('title')} ORDER BY ord) AS nth FROM m WHERE title <> ''), said AS (SELECT mk.doc_id, ord, line_no FROM mk JOIN hk USING (doc_id, key, nth)),
    fh AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM hk WHERE NOT {O.page_like('title')} AND lower(title) <> 'outline' AND (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM said)), fm AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM m WHERE (doc_id, ord) NOT IN (SELECT doc_id, ord FROM said)),
    pg AS (SELECT doc_id, ({O.page_comment('text')}) - 1 AS page, min(line_no) AS pl FROM probe WHERE ({O.page_comment('text')}) IS NOT NULL GROUP BY ALL), fd AS (SELECT *, 'title' AS how FROM said UNION ALL SELECT fm.doc_id, ord, line_no, 'order' FROM fm JOIN fh USING (doc_id, r))
    SELECT m.doc_id, m.ord, coalesce(line_no, pl)::INT AS line, coalesce(how, CASE WHEN pl IS NOT NULL THEN 'page' END) AS how FROM m LEFT JOIN fd ON m.doc_id = fd.doc_id AND m.ord = fd.ord LEFT JOIN pg ON m.doc_id = pg.doc_id AND m.page = pg.page""",
)
_add(
    "f26_relocated_outline", lambda s, d: claims.relocated(_outline(s, d), _pages(s, d)),
    f"""WITH {BOOKS}, {_heads}, {_marks}, {_hd}, said AS (SELECT m.doc_id, ord, min(line_no) AS line_no FROM m JOIN hd ON m.doc_id = hd.doc_id AND lower(m.title) = lower(hd.title) GROUP BY ALL), fh AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM h WHERE (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM said)),
    fm AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM m WHERE (doc_id, ord) NOT IN (SELECT doc_id, ord FROM said)) SELECT m.doc_id, m.ord, coalesce(said.line_no, fh.line_no)::INT AS line FROM m LEFT JOIN said ON m.doc_id = said.doc_id AND m.ord = said.ord LEFT JOIN fm ON m.doc_id = fm.doc_id AND m.ord = fm.ord LEFT JOIN fh ON fm.doc_id = fh.doc_id AND fm.r = fh.r""",
)


# Requests under a budget.
def _items(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("doc_id", F.col("line_no").alias("pos"), F.length("text").alias("size"))


def _fold(fits: str) -> str:
    """The fold itself: each item goes with the one before it while ``fits``."""
    return f"WITH RECURSIVE {BOOKS}, i AS (SELECT doc_id, line_no AS pos, length(text) AS size FROM probe), f AS (SELECT doc_id, pos, size, 0 AS batch, 1 AS n, size AS held FROM i WHERE pos = 0 UNION ALL SELECT i.doc_id, i.pos, i.size, CASE WHEN {fits} THEN f.batch ELSE f.batch + 1 END, CASE WHEN {fits} THEN f.n + 1 ELSE 1 END, CASE WHEN {fits} THEN f.held + i.size ELSE i.size END FROM f JOIN i ON i.doc_id = f.doc_id AND i.pos = f.pos + 1) SELECT doc_id, batch, count(*) AS texts, CAST(sum(size) AS BIGINT) AS chars FROM f GROUP BY 1, 2"


def _requests(items: DataFrame, **how: int) -> DataFrame:
    return budgets.batched(items, **how).groupBy("doc_id", "batch").agg(F.count("*").alias("texts"), F.sum("size").alias("chars"))


_add("c22_chat_batches", lambda s, d: _requests(_items(s, d), budget=2800, extra=8), _fold("f.held + 8 * f.n + i.size + 8 <= 2800"))
_add("n02_requests", lambda s, d: _requests(_items(s, d), budget=4499, most=32), _fold("f.n < 32 AND f.held + i.size < 4500"))

# Split words, by the corpus's own words.
_lex = "lex AS (SELECT word, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM probe) GROUP BY 1 HAVING count(*) >= 3), tk AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS t FROM probe), ps AS (SELECT doc_id, line_no, text, k - 1 AS k, t[k] AS x, t[k + 2] AS y FROM (SELECT *, unnest(range(1, greatest(1, len(t) - 1))) AS k FROM tk) WHERE t[k + 1] = ' ' AND regexp_matches(t[k], '^\\p{L}') AND regexp_matches(t[k + 2], '^\\p{Ll}')), jd AS (SELECT ps.*, w.word IS NOT NULL AS whole, l.word IS NOT NULL AS left_, r.word IS NOT NULL AS right_ FROM ps LEFT JOIN lex w ON w.word = lower(x || y) LEFT JOIN lex l ON l.word = lower(x) LEFT JOIN lex r ON r.word = lower(y))"
_add("d05_lexicon", lambda s, d: lexicon.lexicon(_pages(s, d)), f"WITH {BOOKS}, {_lex} SELECT * FROM lex")
_add(
    "d05_split_pairs", lambda s, d: (lambda p: lexicon.split_pairs(p, lexicon.lexicon(p)))(_pages(s, d)),
    f"WITH {BOOKS}, {_lex}, fc AS (SELECT doc_id, line_no, regexp_matches({O.trim('text')}, '^(```|~~~)')::INT AS mark FROM probe), fr AS (SELECT doc_id, line_no FROM (SELECT *, coalesce(sum(mark) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS o FROM fc) WHERE o = 0 AND mark = 0), hit AS (SELECT jd.* FROM jd JOIN fr USING (doc_id, line_no) WHERE length(x) <= 8 AND length(y) <= 6 AND whole AND NOT (left_ AND right_) AND NOT starts_with({O.trim('text')}, '<!--')), run AS (SELECT *, k - 2 * row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) AS g FROM hit) SELECT doc_id, line_no, k::INT AS \"at\", x AS first, y AS second FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, g ORDER BY k) % 2 = 1",
)
_add("d05_split_words", lambda s, d: (lambda p: lexicon.rejoined(p, lexicon.lexicon(p)))(_pages(s, d)))
_sus = f"su AS (SELECT DISTINCT doc_id, line_no FROM jd WHERE length(x) BETWEEN 2 AND 4 AND length(y) BETWEEN 2 AND 4 AND (NOT right_ OR (NOT left_ AND length(x) = 2 AND length(y) = 2)) AND NOT regexp_matches({O.trim('text')}, '^(#|<!--|!\\[|\\||>)'))"
_add("d41_suspect_lines", lambda s, d: (lambda p: lexicon.suspects(p, lexicon.lexicon(p)))(_pages(s, d)), f"WITH {BOOKS}, {_lex}, {_sus} SELECT * FROM su")
_add(
    "d41c_neighbours", lambda s, d: (lambda p: lexicon.with_neighbours(lexicon.suspects(p, lexicon.lexicon(p)), p))(_pages(s, d)),
    f"WITH {BOOKS}, {_lex}, {_sus}, wd AS (SELECT doc_id, line_no, list_filter(string_split_regex(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS w FROM probe) SELECT su.doc_id, su.line_no, coalesce(array_to_string(a.w[-6:], ' '), '') AS before, coalesce(array_to_string(b.w[:6], ' '), '') AS after FROM su LEFT JOIN wd a ON a.doc_id = su.doc_id AND a.line_no = su.line_no - 1 LEFT JOIN wd b ON b.doc_id = su.doc_id AND b.line_no = su.line_no + 1",
)
_add("s49_rejoined_lines", lambda s, d: (lambda p: (lambda w: lexicon.rejoined(p, w).join(by_shuffle(lexicon.suspects(p, w)), ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", "text"))(lexicon.lexicon(p)))(_pages(s, d)))


# A text followed in its pair: the same book, cut into other lines.
def _pair(s: SparkSession, d: str) -> DataFrame:
    return R.lines(_book(s, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n"))))


_add("f18_followed_lines", lambda s, d: following.followed(_pages(s, d), _pair(s, d)))
_size = lambda df, name: df.groupBy("doc_id").agg((F.max("line_no") + 1).alias(name))
_add(
    "f14_interpolated", lambda s, d: _pages(s, d).select("doc_id", "line_no").join(_size(_pages(s, d), "n"), "doc_id").join(_size(_pair(s, d), "m"), "doc_id").select("doc_id", "line_no", following.interpolated(F.col("line_no"), F.lit(0), F.col("n"), F.lit(0), F.col("m")).alias("other")),
    f"WITH {BOOKS}, n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS m FROM b) SELECT doc_id, line_no, floor(m * (line_no::DOUBLE / n))::INT AS other FROM probe JOIN n USING (doc_id)",
)


# Letter-spaced titles: each book begins with its own first words so set; its text is the source.
def _spaced(s: SparkSession, d: str) -> DataFrame:
    first = F.regexp_replace(F.upper(F.substring("text", 1, 40)), r"[^\p{L}\p{N}]", "")
    return R.lines(_docs(s, d).select("doc_id", F.concat(F.lit("## "), F.array_join(F.split(first, ""), " "), F.lit("\n"), "text").alias("text")))


_add("s13_tracked_titles", lambda s, d: tracking.tracked_titles(_spaced(s, d)))
_add("d31_closed_letters", lambda s, d: tracking.closed_letters(_spaced(s, d), _docs(s, d)))


# Rules on one line.
def _rule(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """(doc_id, line_no, value) of the lines of the books for which a rule says something."""
    _add(name, lambda s, d: _pages(s, d).select("doc_id", "line_no", value(T.trim(F.col("text"))).alias("value")).where("value is not null"), f"WITH {BOOKS}, v AS (SELECT doc_id, line_no, {sql} AS value FROM probe) SELECT * FROM v WHERE value IS NOT NULL")


_st = O.trim("text")
_true = lambda c: F.when(c, F.lit(True))
_yes = lambda x: f"CASE WHEN {x} THEN true END"
_verse = r"(?:[1-3]\s+)?[A-Za-z][A-Za-z'’]*(?:\s+[A-Za-z][A-Za-z'’]*){0,3}\s+[0-9]{1,3}\s*:\s*[0-9]{1,3}(?:\s*[-–—]\s*[0-9]{1,3})?"
_name = f"trim(coalesce(({O.heading_text('text')}), {_st}), '()[]“”\"''.')"
_rule("d22b_sentence_ends", lambda t: _true(scan.ends_sentence(t)), _yes(O.has(_st, "[.!?…][\"”’')\\]}»]*$")))
_rule("d25_citation_lines", lambda t: _true(scan.citation(t)), _yes(f"length({_name}) BETWEEN 3 AND 80 AND {O.has(_name, f'^{_verse}(?:' + chr(92) + 's*;' + chr(92) + f's*{_verse})*$')}"))
_rule("s07_banners", lambda t: _true(F.startswith(t, F.lit(">")) & F.contains("text", F.lit("bookmarks taken from the PDF"))), _yes(f"starts_with({_st}, '>') AND contains(text, 'bookmarks taken from the PDF')"))
_rule("s11_short_titles", lambda t: _true(scan.short_title(t)), _yes(f"({O.heading_text('text')}) IS NOT NULL OR ({_st} <> '' AND NOT {O.roman('text')} AND NOT {O.has(_st, '^(<!--|!' + chr(92) + '[|' + chr(92) + '||•|- |[*] )')} AND length({_st}) <= 60 AND NOT {O.has(_st, '[.!?]$')} AND len({O.title_words('text')}) BETWEEN 1 AND 10)"))
_rule("s15_levels", lambda t: F.when(t.rlike("^#{1,6} "), F.length(F.regexp_extract(t, "^(#+)", 1))), f"CASE WHEN {O.has(_st, '^#{1,6} ')} THEN length({O.ext(_st, '^(#+)')})::INT END")
_rule("s16_fences", lambda t: _true(scan.is_fence(t)), _yes(f"substr({_st}, 1, 3) IN ('```', '~~~')"))
_rule("s34_rules", lambda t: _true(F.replace(t, F.lit(" "), F.lit("")).rlike(r"^(-{3,}|\*{3,}|_{3,})$")), _yes(f"length(replace({_st}, ' ', '')) >= 3 AND translate(replace({_st}, ' ', ''), substr({_st}, 1, 1), '') = '' AND substr({_st}, 1, 1) IN ('-', '*', '_')"))
_rule("c15_kept_lines", lambda t: _true(t.rlike(r"^(<!--|!\[|\||---|\*\*\*)") | F.contains(t, F.lit("](figures/")) | F.contains(t, F.lit("](./figures/"))), _yes(f"starts_with({_st}, '<!--') OR starts_with({_st}, '![') OR starts_with({_st}, '|') OR substr({_st}, 1, 3) IN ('---', '***') OR contains({_st}, '](figures/') OR contains({_st}, '](./figures/')"))
_rule("s21_letters", lambda t: F.when(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "") != "", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")), f"nullif({O.sub('lower(text)', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}, '')")
_rule("s04_unreadable", lambda t: F.when(F.regexp_count("text", F.lit(T.UNREADABLE)) > 0, F.regexp_count("text", F.lit(T.UNREADABLE))), f"nullif(len(regexp_extract_all(text, {O.q(O.UNREADABLE)})), 0)::INT")


# Ornaments: each book has fourteen pictures, of sizes that its number sets.
def _pictures(s: SparkSession, d: str) -> DataFrame:
    own = _docs(s, d).where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("i"))
    return own.select("doc_id", F.format_string("figure-%03d.png", "i").alias("name"), F.expr("cast(40 + doc_id * i % 13 as int)").alias("w"), F.lit(30).alias("h"))


_add("d40_without_ornaments", lambda s, d: ornaments.without_ornaments(_pages(s, d), _pictures(s, d)))
_add("s58_outline_after_ornaments", lambda s, d: ornaments.outline_after(_pages(s, d), _pictures(s, d)))


# Page marks: every seventh sentence of a text, as it stands in the file, is a page's.
def _file_pages(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", r"(?<=\.) ")).alias("k", "text")).where("k % 7 = 0").select("doc_id", F.expr("cast(k / 7 as int)").alias("page"), "text")


_add("f05_page_marks", lambda s, d: stitching.page_marks(_file_pages(s, d), R.lines(_docs(s, d))))
_long = lambda low: f"list_filter(string_split(text, chr(10)), lambda x: length({O.trim('x')}) BETWEEN {low} AND 160 AND regexp_matches(x, '\\p{{L}}') AND NOT {O.contents_line('x')})[1]"
_add("s23_distinctive_lines", lambda s, d: _docs(s, d).where("text is not null").select("doc_id", stitching.distinctive(F.col("text")).alias("line")), f"SELECT doc_id, {O.trim(f'coalesce({_long(28)}, {_long(20)})')} AS line FROM documents WHERE text IS NOT NULL")
_add("s26_body_starts", lambda s, d: _pages(s, d).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.contains("text", F.lit("<!-- page 1 -->")), F.col("line_no"))), F.lit(0)).alias("start")), f"WITH {BOOKS} SELECT doc_id, coalesce(min(CASE WHEN contains(text, '<!-- page 1 -->') THEN line_no END), 0)::INT AS start FROM probe GROUP BY 1")

# An as-of join without a window over all of a document.
_add("i07_as_of", lambda s, d: scan.as_of(_probe(s, d)), queries.ORACLE_SQL["f11_section_at"])
