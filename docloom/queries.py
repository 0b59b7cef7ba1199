"""One query for each operator, and its DuckDB SQL. Keys begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as T
from .operators import cleanup, library, outline, retrieval, tables
from .plans import search
from .sources import relations as R
from .streaming import changes as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return R.lines(_docs(s, d))


def _probe(s: SparkSession, d: str) -> DataFrame:
    return R.probe_lines(_docs(s, d))


def _md(s: SparkSession, d: str) -> DataFrame:
    return R.markdown_lines(R.table(s, d, "pages"))


def _book(s: SparkSession, d: str) -> DataFrame:
    return R.page_lines(R.table(s, d, "conversations"))


def _cards(s: SparkSession, d: str) -> DataFrame:
    return R.cards(_docs(s, d))


def _changes(s: SparkSession, d: str) -> DataFrame:
    return C.changes(R.table(s, d, "events"))


# Rules on one line: the value of each line where there is one.
def _rule(name: str, rule: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        return _probe(s, d).select("doc_id", "line_no", rule(F.col("text")).alias("value")).where("value is not null")

    _add(name, query, f"WITH {O.PROBES} SELECT * FROM (SELECT doc_id, line_no, {sql('text')} AS value FROM probe) WHERE value IS NOT NULL")


for _name, _rule_of, _sql_of in (
    ("c05_heading_text", T.heading_text, O.heading_text), ("c06_atx_heading", T.atx_heading, O.atx_heading), ("c07_bold_line", T.bold_line, O.bold_line),
    ("c09_page_comment", T.page_comment, O.page_comment), ("c25_list_item", T.list_item, O.list_item), ("c26_contents_entry", T.contents_entry, O.contents_entry),
    ("d01_readable", T.readable, O.readable), ("d02_close_gap", T.close_gap, O.close_gap), ("d16_numbered_heading", T.numbered_heading, O.numbered_heading),
    ("d17_numbered_callout", T.numbered_callout, O.numbered_callout), ("d18_plain_numbered_heading", T.plain_numbered_heading, O.plain_numbered_heading),
    ("d32_tracked_line", T.tracked, O.tracked), ("d34_page_like", T.page_like, O.page_like), ("d35_contents_line", T.contents_line, O.contents_line),
    ("s03_fold_line", T.fold_line, O.fold_line), ("s09_heading_marks", T.heading_marks, O.heading_marks), ("s17_lone_page_number", T.lone_page_number, O.lone_page_number),
    ("m01_tag_slug", T.tag_slug, O.tag_slug), ("m02_folded_title", T.folded, O.folded), ("m03_outline_core", T.outline_core, O.outline_core),
    ("m04_title_words", T.title_words, O.title_words), ("m05_roman", T.roman, O.roman), ("m06_isbn", T.valid_isbn, O.valid_isbn),
    ("m07_publication_date", T.publication_date, O.publication_date), ("m08_language_tag", T.language_tag, O.language_tag),
    ("m18_home_scrub", T.home_scrubbed, O.home_scrubbed), ("m19_xml_escape", T.xml_escape, O.xml_escape), ("m26_catalog_title", T.catalog_title, O.catalog_title),
    ("c13_sentences", T.sentences, O.sentences),
    ("e02_table_cells", lambda c: F.when(F.contains(c, F.lit("|")), tables.cells(c)), lambda x: f"CASE WHEN contains({x}, '|') THEN list_transform(string_split({O.sub(O.sub(O.trim(x), '^[|]'), '[|]$')}, '|'), lambda c: {O.trim('c')}) END"),
    ("e02b_table_separator", tables.separator, lambda x: f"len(list_filter(string_split({O.sub(O.sub(O.trim(x), '^[|]'), '[|]$')}, '|'), lambda c: NOT {O.has(O.sub('c', '[:' + chr(92) + 's]'), '^-+$')})) = 0"),
):
    _rule(_name, _rule_of, _sql_of)

# Sources.
def _kind() -> Column:
    return F.element_at(F.array(*map(F.lit, [*R.EXTENSIONS, "exe", "PDF"])), (F.col("doc_id") % 26 + 1).cast("int")).alias("kind")


_kinds = "[" + ", ".join(O.q(x) for x in [*R.EXTENSIONS, "exe", "PDF"]) + "]"
_add("a01_accepted_files", lambda s, d: _docs(s, d).select("doc_id", _kind()).where(F.lower("kind").isin(R.EXTENSIONS)), f"SELECT * FROM (SELECT doc_id, {_kinds}[doc_id % 26 + 1] AS kind FROM documents) WHERE lower(kind) IN ({', '.join(map(O.q, R.EXTENSIONS))})")
_add("a02_ready_markdown", lambda s, d: _docs(s, d).select("doc_id", _kind()).where(F.lower("kind").isin(R.READY)), f"SELECT * FROM (SELECT doc_id, {_kinds}[doc_id % 26 + 1] AS kind FROM documents) WHERE lower(kind) IN ('md', 'markdown')")
_add("a03_url_source", lambda s, d: _docs(s, d).select("doc_id", F.concat(F.lit("app://open?file=/in/"), "source", F.lit(".md&n="), F.col("doc_id").cast("string")).alias("u")).select("doc_id", F.parse_url("u", F.lit("QUERY"), F.lit("file")).alias("path")), "SELECT doc_id, '/in/' || source || '.md' AS path FROM documents")
_add("a07_html_text", lambda s, d: R.table(s, d, "pages").select("page_id", R.html_text(F.col("html")).alias("text")), f"SELECT page_id, {O.html_text('html')} AS text FROM pages")
_add("a13_html_markdown", lambda s, d: R.table(s, d, "pages").select("page_id", R.html_markdown(F.col("html")).alias("text")), f"SELECT page_id, {O.html_markdown('html')} AS text FROM pages")
_add(
    "a08_csv_markdown",
    lambda s, d: _docs(s, d).select("doc_id", R.csv_markdown(F.concat(F.lit("id, lang ,note\n"), F.col("doc_id").cast("string"), F.lit(", "), "lang", F.lit(","), F.regexp_replace(F.substring("text", 1, 30), "\n", ","))).alias("text")),
    """WITH raw AS (SELECT doc_id, [doc_id::VARCHAR || ', ' || lang || ',' || replace(substr(text, 1, 30), chr(10), ',')] AS rows FROM documents)
    SELECT doc_id, '| id | lang | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || list_aggregate(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(string_split(r, ','), lambda c: trim(c)), ' | ') || ' |'), 'string_agg', chr(10)) || chr(10) AS text FROM raw""",
)

# Sinks.
def _base() -> Column:
    return library.pairing_stem(F.col("markdown_path"))


_base_sql = r"regexp_replace(regexp_replace(regexp_extract(markdown_path, '([^/]*)$', 1), '\.[^.]*$', ''), '(?i)\.(" + "|".join(library.CODES) + r")(-[0-9]+)?$', '')"
_add("b02_unique_names", lambda s, d: library.unique_names(_cards(s, d), _base()), f"WITH {O.CARDS}, k AS (SELECT id, {_base_sql} AS stem FROM cards), n AS (SELECT id, stem, row_number() OVER (PARTITION BY stem ORDER BY id) AS r FROM k) SELECT id, CASE WHEN r = 1 THEN stem ELSE stem || '-' || r END AS name FROM n")

# Lines, pages, paragraphs.
_heads = "h0 AS (SELECT doc_id, line_no, " + O.heading_text("text") + " AS title, least(" + O.heading_marks("text") + ", 3) AS level FROM src), h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord, line_no, level::INT AS level, title FROM h0 WHERE title IS NOT NULL AND title <> 'Outline' AND NOT " + O.page_like("title") + ")"
_MD = f"WITH {O.MARKDOWN}, src AS (SELECT * FROM md), {_heads}, ends AS (SELECT doc_id, max(line_no) AS e FROM src GROUP BY 1)"
_PR = f"WITH {O.PROBES}, src AS (SELECT * FROM probe), {_heads}, ends AS (SELECT doc_id, max(line_no) AS e FROM src GROUP BY 1)"
_BK = f"WITH {O.BOOK}"
_add("c03_headings", lambda s, d: outline.headings(_probe(s, d)), f"{_PR} SELECT * FROM h WHERE ord <= 180")
_add("c04_page_headings", lambda s, d: _md(s, d).select("doc_id", "line_no", T.page_heading(F.col("text")).alias("title")).where("title is not null"), f"WITH {O.MARKDOWN} SELECT * FROM (SELECT doc_id, line_no, {O.page_heading('text')} AS title FROM md) WHERE title IS NOT NULL")
_add("c10_pages", lambda s, d: outline.section_at(_book(s, d)).where("page is not null").groupBy("doc_id", "page").agg(F.count("*").alias("n")), f"{_BK}, p AS (SELECT doc_id, last_value({O.page_comment('text')} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM book) SELECT doc_id, page, count(*) AS n FROM p WHERE page IS NOT NULL GROUP BY 1, 2")
_para = "list_filter(list_transform(string_split(array_to_string(list_transform(string_split(text, '\n'), lambda t: CASE WHEN " + O.has(O.trim("t"), "^($|#|<!--)") + " THEN '\u0001' ELSE " + O.trim("t") + " END), ' '), '\u0001'), lambda p: " + O.sub("p", r"^\s+|\s+$") + "), lambda p: p <> '')"
_add("c12_paragraphs", lambda s, d: R.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(search.paragraphs(R.unix_lines(R.html_markdown(F.col("html"))))).alias("pos", "paragraph")), f"WITH {O.MARKDOWN}, t AS (SELECT doc_id, string_agg(text, '\n' ORDER BY line_no) AS text FROM md GROUP BY 1), p AS (SELECT doc_id, {_para} AS ps FROM t) SELECT doc_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS paragraph FROM p")

# Cleanup.
_key = "CASE WHEN t <> '' AND NOT " + O.has("t", r"^(!\[|\|)") + f" AND ({O.page_comment('t')}) IS NULL AND NOT {O.contents_line('t')} AND length(coalesce({O.heading_text('t')}, t)) <= 80 AND len(list_filter(string_split_regex(coalesce({O.heading_text('t')}, t), '\\s+'), lambda w: {O.has('w', chr(92) + 'p{L}')})) BETWEEN 2 AND 14 THEN {O.folded('coalesce(' + O.heading_text('t') + ', t)')} END"
_keyed = f"keyed AS (SELECT doc_id, line_no, text, {_key} AS key FROM (SELECT *, {O.trim('text')} AS t FROM book))"
_add("d08_chrome_key", lambda s, d: cleanup.with_chrome_key(_book(s, d)).where("key is not null").select("doc_id", "line_no", "key"), f"{_BK}, {_keyed} SELECT doc_id, line_no, key FROM keyed WHERE key IS NOT NULL")
_add(
    "d10_page_chrome", lambda s, d: cleanup.page_chrome(_book(s, d)),
    f"{_BK}, p AS (SELECT doc_id, last_value({O.page_comment('text')} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page, {O.trim('text')} AS t FROM book), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM p WHERE page IS NOT NULL GROUP BY 1), k AS (SELECT doc_id, page, {O.fold_line('t')} AS key FROM p WHERE page IS NOT NULL AND t <> '' AND ({O.page_comment('t')}) IS NULL AND {O.numbered_heading('t')} = t AND ({O.numbered_callout('t')}) IS NULL), c AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE length(key) BETWEEN 4 AND 60 GROUP BY 1, 2) SELECT c.* FROM c JOIN n USING (doc_id) WHERE pages >= greatest(3, ceil(n * 0.34))",
)
_add("d13_mashed", lambda s, d: cleanup.mashed(_lines(s, d)), f"WITH {O.LINES}, g AS (SELECT doc_id, count(*) FILTER (NOT starts_with(text, '|')) AS n, coalesce(sum(length(text)) FILTER (NOT starts_with(text, '|')), 0) AS s FROM lines GROUP BY 1) SELECT doc_id, n > 0 AND ((n <= 2 AND s > 280) OR s // greatest(n, 1) > 160) AS mashed FROM g")
_add("d03_drop_caps", lambda s, d: cleanup.drop_caps(_probe(s, d).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.when(F.col("line_no") % 3 == 0, "T").otherwise(F.lower("text"))))), f"WITH {O.PROBES}, v AS (SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 0 THEN lower(text) WHEN line_no % 3 = 0 THEN 'T' ELSE lower(text) END AS text FROM probe), j AS (SELECT *, lead(text) OVER w AS nxt, coalesce({O.has(O.trim('text'), '^[“' + chr(34) + '‘' + chr(39) + '(]?' + chr(92) + 'p{Lu}$')} AND {O.has('lead(text) OVER w', '^' + chr(92) + 'p{Ll}')}, false) AS joins FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), e AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS eaten FROM j) SELECT doc_id, line_no, CASE WHEN joins THEN {O.trim('text')} || nxt ELSE text END AS text FROM e WHERE NOT eaten")
_add("d21_blank_runs", lambda s, d: cleanup.blank_runs(_md(s, d)), f"WITH {O.MARKDOWN}, b AS (SELECT *, {O.trim('text')} = '' AS blank, lag({O.trim('text')} = '', 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM md) SELECT doc_id, line_no, text FROM b WHERE NOT (blank AND before)")
_add("d33_hidden_page_numbers", lambda s, d: cleanup.hidden_page_numbers(_book(s, d)), f"{_BK} SELECT doc_id, line_no, text FROM book WHERE NOT {O.lone_page_number('text')}")
_add("d36_line_map", lambda s, d: (lambda b: cleanup.line_map(b, cleanup.hidden_page_numbers(b)))(_book(s, d)), f"{_BK}, k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM book WHERE NOT {O.lone_page_number('text')}) SELECT b.doc_id, b.line_no AS old_line, coalesce(min(k.pos) OVER (PARTITION BY b.doc_id ORDER BY b.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(k.pos) OVER (PARTITION BY b.doc_id), 0)::INT AS new_line FROM book b LEFT JOIN k USING (doc_id, line_no)")
_add("j03_upper_median", lambda s, d: cleanup.usual_length(_lines(s, d)), f"WITH {O.LINES}, a AS (SELECT doc_id, list(length({O.trim('text')}) ORDER BY length({O.trim('text')})) FILTER (length({O.trim('text')}) BETWEEN 20 AND 110) AS a FROM lines GROUP BY 1) SELECT doc_id, coalesce(a[len(a) // 2 + 1], 68)::INT AS usual FROM a")

# Tables.
_add("e08_table_lines", lambda s, d: R.table(s, d, "conversations").select("conv_id", "turn", tables.row_text(F.array(F.col("turn").cast("string"), "role", tables.escaped(F.substring("text", 1, 20)))).alias("text")), r"SELECT conv_id, turn, '| ' || turn || ' | ' || role || ' | ' || replace(regexp_replace(substr(text, 1, 20), '\s*\n\s*', ' ', 'g'), '|', '\|') || ' |' AS text FROM conversations")
_add("e04_empty_columns", lambda s, d: tables.without_empty_columns(R.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("row_no"), F.array(F.col("turn").cast("string"), F.lit(""), "role").alias("cells"))), "SELECT conv_id AS doc_id, turn AS row_no, '| ' || turn || ' | ' || role || ' |' AS text FROM conversations")

# Outline.
_sec = "SELECT a.doc_id, a.ord, a.title, a.level, a.line_no AS first, coalesce((SELECT min(b.line_no) - 1 FROM h b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.ord <= 180 {cond}), e)::INT AS last FROM h a JOIN ends USING (doc_id) WHERE a.ord <= 180"
_add("f08_sections", lambda s, d: outline.sections(_probe(s, d)), f"{_PR} " + _sec.replace("{cond}", "AND b.level <= a.level"))
_add("f10_chapter_ranges", lambda s, d: outline.sections(_md(s, d), any_level=True, cap=None), f"{_MD} " + _sec.replace(" AND b.ord <= 180 {cond}", "").replace(" WHERE a.ord <= 180", ""))
_asof = f"SELECT doc_id, line_no, last_value(CASE WHEN NOT {O.page_like(O.heading_text('text'))} THEN {O.heading_text('text')} END IGNORE NULLS) OVER w AS section, last_value({O.page_comment('text')} IGNORE NULLS) OVER w AS page FROM @table WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"
_add("f11_section_at", lambda s, d: outline.section_at(_probe(s, d)), f"WITH {O.PROBES} " + _asof.replace("@table", "probe"))
_add("f12_page_at", lambda s, d: outline.section_at(_book(s, d)).select("doc_id", "line_no", "page"), f"{_BK} SELECT doc_id, line_no, page FROM (" + _asof.replace("@table", "book") + ")")
_add("f04_page_starts", lambda s, d: outline.page_starts(_book(s, d)).select("doc_id", "page", "first"), f"{_BK} SELECT doc_id, {O.page_comment('text')} AS page, min(line_no) AS first FROM book WHERE ({O.page_comment('text')}) IS NOT NULL GROUP BY 1, 2")
_add("f13_page_bounds", lambda s, d: outline.page_starts(_book(s, d)), f"{_BK}, m AS (SELECT doc_id, {O.page_comment('text')} AS page, min(line_no) AS first FROM book WHERE ({O.page_comment('text')}) IS NOT NULL GROUP BY 1, 2), e AS (SELECT doc_id, max(line_no) AS e FROM book GROUP BY 1) SELECT doc_id, page, first, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first) - 1, e)::INT AS last FROM m JOIN e USING (doc_id)")
_add("f15_level_ordinals", lambda s, d: outline.level_ordinals(_probe(s, d)), f"{_PR} SELECT doc_id, ord, level, row_number() OVER (PARTITION BY doc_id, level ORDER BY ord) AS nth FROM h WHERE ord <= 180")
_add("f19_heading_tree", lambda s, d: outline.tree(_probe(s, d)), f"{_PR} SELECT a.doc_id, a.ord, a.title, (SELECT max(b.ord) FROM h b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent FROM h a WHERE a.ord <= 180")
_add("f21_chapters", lambda s, d: outline.chapters(_probe(s, d)), f"{_PR}, t AS (SELECT doc_id, min(level) AS level FROM h GROUP BY 1), c AS (SELECT doc_id, line_no AS first, title FROM h JOIN t USING (doc_id, level)), s AS (SELECT doc_id, min(first) AS start FROM c GROUP BY 1) SELECT * FROM c UNION ALL SELECT DISTINCT doc_id, 0, 'Front matter' FROM src JOIN s USING (doc_id) WHERE line_no < start AND {O.trim('text')} <> ''")

# Search.
_QUERY = "(the of OR clown) NOT idiot"
_like = lambda x, t: f"contains(lower(strip_accents({x})), {O.q(t)})"
_cond = lambda x: f"(({_like(x, 'the')} AND {_like(x, 'of')}) OR {_like(x, 'clown')}) AND NOT {_like(x, 'idiot')}"
_add("g04_boolean_search", lambda s, d: search.matching(_docs(s, d), _QUERY).select("doc_id"), f"WITH p AS (SELECT doc_id, unnest({_para}) AS p FROM documents) SELECT DISTINCT doc_id FROM p WHERE ({_cond('p')}) OR len(list_filter({O.sentences('p')}, lambda s: {_cond('s')})) > 0")
_add("g08_contains", lambda s, d: _docs(s, d).where(search.contains(F.col("text"), "ELLE")).select("doc_id"), f"SELECT doc_id FROM documents WHERE {_like('text', 'elle')}")
_add("g05_hit_lines", lambda s, d: retrieval.hit_lines(_docs(s, d), _QUERY), f"WITH {O.LINES}, p AS (SELECT *, sum(({O.has(O.trim('text'), '^($|#|<!--)')})::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS para, {O.has(O.trim('text'), '^($|#|<!--)')} AS stop FROM lines), j AS (SELECT doc_id, para, string_agg(text, ' ' ORDER BY line_no) AS p, max(({_like('text', 'the')} OR {_like('text', 'of')} OR {_like('text', 'clown')})::INT) AS asked FROM p WHERE NOT stop GROUP BY 1, 2), k AS (SELECT * FROM j WHERE ({_cond('p')}) OR len(list_filter({O.sentences('p')}, lambda s: {_cond('s')})) > 0), h AS (SELECT p.doc_id, p.line_no, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.line_no) AS n FROM p JOIN k USING (doc_id, para) WHERE NOT stop AND (asked = 0 OR {_like('text', 'the')} OR {_like('text', 'of')} OR {_like('text', 'clown')})) SELECT doc_id, line_no FROM h WHERE n <= 120")
_add("g10_occurrences", lambda s, d: retrieval.occurrences(_lines(s, d), "the"), f"WITH {O.LINES}, f AS (SELECT doc_id, line_no, least(6, len(regexp_extract_all(lower(text), 'the'))) AS n FROM lines), b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) - n AS before FROM f WHERE n > 0) SELECT doc_id, line_no, least(n, 120 - before)::INT AS n FROM b WHERE before < 120")
_sent = "string_split(" + O.sub("text", r"([.?!])\s+|\n+", "\\1\u0001") + ", '\u0001')"
_add("g13_word_search", lambda s, d: search.matching_by_word(_docs(s, d), "the AND of OR clown NOT idiot").select("doc_id"), f"SELECT doc_id FROM documents WHERE len(list_filter({_sent}, lambda s: (contains(lower(s), 'the') AND contains(lower(s), 'of')) OR contains(lower(s), 'clown') OR NOT contains(lower(s), 'idiot'))) > 0")

# Answers.
_Q = "What about the ention and thing, thing?"
_words = retrieval.question_words(_Q)
_sum = lambda x, ws: " + ".join(f"contains(lower({x}), {O.q(w)})::INT" for w in ws)
_best = lambda ps, ws: f"WITH p AS (SELECT doc_id, unnest(range(len({ps}))) AS pos, unnest({ps}) AS passage FROM documents), s AS (SELECT *, {_sum('passage', ws)} AS score FROM p WHERE length(passage) > 40 AND NOT starts_with(passage, '>')), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)::INT AS rank FROM s WHERE score > 0) SELECT doc_id, rank, passage, score::INT AS score FROM r WHERE rank <= 3"
_edge = r"^\s+|\s+$"
_add("h01_answers", lambda s, d: retrieval.best_passages(_docs(s, d), _Q), _best(f"list_transform(string_split(text, '\n\n'), lambda p: {O.sub('p', _edge)})", _words))

# Library.
_origin = f"CASE WHEN source_path <> '' THEN lower(source_path) ELSE lower(regexp_replace(markdown_path, '/[^/]*$', '')) || '|' || lower({_base_sql}) END"
_groups = f"WITH {O.CARDS}, k AS (SELECT *, {_origin} AS origin FROM cards), g AS (SELECT origin, count(*) AS n, coalesce(min(id) FILTER (lower(regexp_replace(regexp_extract(markdown_path, '([^/]*)$', 1), '\\.[^.]*$', '')) = lower({_base_sql})), arg_min(id, (length(title), id))) AS master, arg_max(id, (added, id)) AS newest, min(id) AS first, min(coalesce(list_min(tags), chr(65535))) AS first_tag, max(opened) AS opened FROM k GROUP BY 1)"
_add("j01_groups", lambda s, d: library.groups(_cards(s, d)), f"{_groups} SELECT origin, n, master, newest, first_tag, first FROM g")
_add("i01_twins", lambda s, d: library.twins(_cards(s, d)), f"{_groups} SELECT id, master FROM k JOIN g USING (origin) WHERE id <> master")
_add("i11_unique_title", lambda s, d: library.unique_titles(_cards(s, d), _cards(s, d).select(T.catalog_title(F.col("title")).alias("want")).distinct(), T.catalog_title(F.col("title"))), f"WITH {O.CARDS}, t AS (SELECT {O.catalog_title('title')} AS want, count(*) AS n, min(id) AS id FROM cards GROUP BY 1) SELECT want, CASE WHEN n = 1 THEN id END AS id FROM t")
_add("j05_tag_counts", lambda s, d: library.tag_counts(_cards(s, d)), f"WITH {O.CARDS} SELECT tag, count(*) AS cards FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM cards) GROUP BY 1")
_add("j14_cost", lambda s, d: _cards(s, d).agg((F.sum("bytes") / 4 * 18 / 1e6).alias("usd")), f"WITH {O.CARDS} SELECT sum(bytes) / 4 * 18 / 1e6 AS usd FROM cards")
_add("k05_newest_finished", lambda s, d: (lambda e: e.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).unionByName(e.where("event_type <> 'purchase'")))(R.table(s, d, "events").select("event_id", "event_type", "ts")).select("event_id"), "(SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 10) UNION ALL SELECT event_id FROM events WHERE event_type <> 'purchase'")
_add("k07_recent_languages", lambda s, d: _docs(s, d).groupBy("lang").agg(F.max("doc_id").alias("last")).orderBy(F.desc("last")).limit(6).select("lang"), "SELECT lang FROM documents GROUP BY lang ORDER BY max(doc_id) DESC LIMIT 6")
_add("l01_with_tags", lambda s, d: library.with_tags(_cards(s, d), ["fr", "src0"]).select("id"), "SELECT doc_id AS id FROM documents WHERE lang = 'fr' AND source = 'src0'")
_add("l02_union_paths", lambda s, d: _cards(s, d).select(F.col("source_path").alias("path")).union(_cards(s, d).select("markdown_path")).distinct(), f"WITH {O.CARDS} SELECT source_path AS path FROM cards UNION SELECT markdown_path FROM cards")
_add("l05_renamed_tag", lambda s, d: library.renamed_tag(_cards(s, d), "src1", "fr").select("id", F.array_join("tags", ",").alias("tags")), "SELECT doc_id AS id, CASE WHEN source = 'src1' AND lang = 'fr' THEN 'fr' WHEN source = 'src1' THEN lang || ',fr' ELSE lang || ',' || source END AS tags FROM documents")
_add("l06_toggled_tag", lambda s, d: library.toggled_tag(_cards(s, d), "src2").select("id", F.array_join("tags", ",").alias("tags")), "SELECT doc_id AS id, CASE WHEN source = 'src2' THEN lang ELSE lang || ',' || source || ',src2' END AS tags FROM documents")
_add("l07_without_tag", lambda s, d: library.without_tag(_cards(s, d), "en").select("id", F.array_join("tags", ",").alias("tags")), "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN source ELSE lang || ',' || source END AS tags FROM documents")
_add("m14_pairing_stem", lambda s, d: _cards(s, d).select("id", _base().alias("stem")), f"WITH {O.CARDS} SELECT id, {_base_sql} AS stem FROM cards")
_add("m15_origin_key", lambda s, d: _cards(s, d).select("id", library.origin_key().alias("origin")), f"WITH {O.CARDS} SELECT id, {_origin} AS origin FROM cards")

# Streams, in their batch form.
_add("p04_real_changes", lambda s, d: C.real_changes(_changes(s, d)).select("path", "event_id"), "SELECT path, event_id FROM (SELECT '/in/' || user_id || '.md' AS path, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value IS DISTINCT FROM before")
_add("p08_latest", lambda s, d: _changes(s, d).groupBy("path").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")), "SELECT '/in/' || user_id || '.md' AS path, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
