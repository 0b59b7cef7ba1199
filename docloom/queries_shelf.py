"""Queries of the shelf, jobs, margins, outlines and the search language, with DuckDB SQL written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from . import queries, queries_reading
from .functions import text as T
from .operators import cleanup, library, outline, records, retrieval, shelf
from .passes.spark import rows_of
from .plans import search
from .sources import relations as R
from .streaming import changes as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NL = "chr(10)"
_READING = {k: (q, queries_reading.ORACLE_SQL[k]) for k, q in queries_reading.QUERIES.items()}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return R.lines(_docs(s, d))


def _probe(s: SparkSession, d: str) -> DataFrame:
    return R.probe_lines(_docs(s, d))


def _cards(s: SparkSession, d: str) -> DataFrame:
    """Cards of many origins: names by id, translations among them."""
    return R.cards(_docs(s, d)).withColumns({"markdown_path": F.expr("concat('/lib/', id % 40, '/', id % 90, if(id % 4 = 1, '.de', if(id % 4 = 2, '.FR-2', '')), '.md')"), "source_path": F.expr("if(id % 3 = 0, concat('/src/', id % 70, '.pdf'), '')")})


CARDS = f"""{O.CARDS.replace('cards AS', 'c0 AS')}, cards AS (SELECT * REPLACE ('/lib/' || id % 40 || '/' || id % 90 || CASE WHEN id % 4 = 1 THEN '.de' WHEN id % 4 = 2 THEN '.FR-2' ELSE '' END || '.md' AS markdown_path,
  CASE WHEN id % 3 = 0 THEN '/src/' || id % 70 || '.pdf' ELSE '' END AS source_path) FROM c0)"""
_name = "'/lib/' || id % 40 || '|' || id % 90"
_pairs = f"p AS (SELECT a.id, b.id AS mate, b.opened FROM cards a JOIN cards b ON a.id <> b.id AND ((a.source_path <> '' AND a.source_path = b.source_path) OR (a.id % 40 = b.id % 40 AND a.id % 90 = b.id % 90)))"
_add("i02_same_origin", lambda s, d: shelf.origin_pairs(_cards(s, d)), f"WITH {CARDS}, {_pairs} SELECT DISTINCT id, mate FROM p")
_add("i03_recent_mates", lambda s, d: shelf.recent_mates(_cards(s, d)), f"WITH {CARDS}, {_pairs} SELECT id, arg_max(mate, (opened, -mate)) AS mate FROM p GROUP BY 1")
_add("s51_original_and_mate", lambda s, d: shelf.recent_mates(_cards(s, d)).join(_cards(s, d).where(library.is_original()).select("id"), "id"), f"WITH {CARDS}, {_pairs} SELECT id, arg_max(mate, (opened, -mate)) AS mate FROM p WHERE id % 4 IN (0, 3) GROUP BY 1")
_add("s61_originals", lambda s, d: _cards(s, d).where(library.is_original()).select("id"), f"WITH {CARDS} SELECT id FROM cards WHERE id % 4 IN (0, 3)")
_add("j09_newest", lambda s, d: shelf.newest(_cards(s, d), 0), f"WITH {CARDS} SELECT arg_max(id, (added, -id)) AS id FROM cards WHERE id <> 0")
_pics = "SELECT doc_id // 20 AS doc_id, 'p' || doc_id AS name, 20 + doc_id * 37 % 400 AS w, 20 + doc_id * 53 % 300 AS h FROM documents"
_add(
    "i13_similar_sizes", lambda s, d: shelf.similar_sizes(_docs(s, d).select(F.floor(F.col("doc_id") / 20).alias("doc_id"), F.expr("concat('p', doc_id)").alias("name"), F.expr("20 + doc_id * 37 % 400").alias("w"), F.expr("20 + doc_id * 53 % 300").alias("h"))),
    f"WITH p AS ({_pics}) SELECT a.doc_id, a.name, b.name AS other FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.name < b.name AND abs(a.w - b.w) <= 0.15 * greatest(a.w, b.w, 1) AND abs(a.h - b.h) <= 0.15 * greatest(a.h, b.h, 1)",
)
_now = "element_at(array('manual', 'name_asc', 'name_desc', 'date_new', 'date_old', 'tag_asc', 'tag_desc'), cast({} as int))"
_sorts = "['manual', 'name_asc', 'name_desc', 'date_new', 'date_old', 'tag_asc', 'tag_desc']"
_add(
    "k02_toggled_sort", lambda s, d: _docs(s, d).select("doc_id", shelf.toggled_sort(F.expr(_now.format("doc_id % 7 + 1")), F.expr(_now.format("doc_id * 3 % 7 + 1"))).alias("sort")),
    f"SELECT doc_id, CASE WHEN a <> b THEN b WHEN ends_with(a, '_asc') THEN replace(a, '_asc', '_desc') WHEN ends_with(a, '_desc') THEN replace(a, '_desc', '_asc') WHEN a = 'date_new' THEN 'date_old' WHEN a = 'date_old' THEN 'date_new' ELSE a END AS sort FROM (SELECT doc_id, {_sorts}[doc_id % 7 + 1] AS a, {_sorts}[doc_id * 3 % 7 + 1] AS b FROM documents)",
)
_order = "SELECT row_number() OVER (ORDER BY source) - 1 AS o, source AS origin FROM (SELECT DISTINCT source FROM documents)"


def _groups(s: SparkSession, d: str) -> DataFrame:
    found = _docs(s, d).select(F.col("source").alias("origin")).distinct()
    return found.select((F.rank().over(library.W.partitionBy(F.lit(1)).orderBy("origin")) - 1).cast("long").alias("at"), "origin")  # one row a source


for _n, _src, _dst in (("k03_dropped_on", 7, 2), ("k03b_dropped_after", 2, 7), ("k03c_dropped_first", 5, None)):
    _add(
        _n, lambda s, d, a=_src, b=_dst: shelf.moved(_groups(s, d), a, b),
        f"WITH g AS ({_order}), k AS (SELECT origin, o, row_number() OVER (ORDER BY o) - 1 AS p FROM g WHERE o <> {_src}), t AS (SELECT coalesce((SELECT p FROM k WHERE o = {'NULL' if _dst is None else _dst}), 0) AS p) SELECT CASE WHEN k.p >= t.p THEN k.p + 1 ELSE k.p END AS \"at\", origin FROM k, t UNION ALL SELECT t.p, origin FROM g, t WHERE o = {_src}",
    )
_add("j02_repeated_keys", lambda s, d: _lines(s, d).groupBy("doc_id", F.lower("text").alias("key")).agg(F.count("*").alias("n")).where("n >= 3"), f"WITH {O.LINES} SELECT doc_id, lower(text) AS key, count(*) AS n FROM lines GROUP BY 1, 2 HAVING count(*) >= 3")
_add("j04_pages_of_keys", lambda s, d: R.table(s, d, "conversations").where("text is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.split("text", "\n"))).alias("key")).groupBy("conv_id", "key").agg(F.count_distinct("turn").alias("pages")), f"SELECT conv_id, key, count(DISTINCT turn) AS pages FROM (SELECT conv_id, turn, unnest(string_split(text, {NL})) AS key FROM conversations) GROUP BY 1, 2")
_add(
    "j07_bag_difference", lambda s, d: retrieval.bag_difference(_docs(s, d).select("doc_id", F.split(F.lower(F.left("text", F.lit(200))), r"\s+").alias("need"), F.split(F.lower(F.substring("text", 41, 100)), r"\s+").alias("taken"))),
    r"WITH n AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(string_split_regex(lower(substr(text, 1, 200)), '\s+')) AS w FROM documents) GROUP BY 1, 2), t AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(string_split_regex(lower(substr(text, 41, 100)), '\s+')) AS w FROM documents) GROUP BY 1, 2) SELECT n.doc_id, w AS word, n.c - coalesce(t.c, 0) AS n FROM n LEFT JOIN t USING (doc_id, w) WHERE n.c > coalesce(t.c, 0)",
)
_add("j08_mean_length", lambda s, d: _lines(s, d).groupBy("doc_id").agg(F.floor(F.sum(F.length("text")) / F.count("*")).alias("mean")), f"WITH {O.LINES} SELECT doc_id, sum(length(text)) // count(*) AS mean FROM lines GROUP BY 1")
_add("k04_best_three", lambda s, d: retrieval.best_passages(_docs(s, d), "the thing and the idea of it").select("doc_id", "rank", "score"), "WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS pos, unnest(string_split(text, chr(10) || chr(10))) AS x FROM documents), s AS (SELECT doc_id, pos, contains(lower(x), 'thing')::INT + contains(lower(x), 'idea')::INT AS score, x FROM p WHERE length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 40 AND NOT starts_with(ltrim(x), '>')), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)::INT AS rank FROM s WHERE score > 0) SELECT doc_id, rank, score FROM r WHERE rank <= 3")
_add("k09_capped_headings", lambda s, d: outline.headings(_probe(s, d), 2), f"WITH {O.PROBES}, h AS (SELECT doc_id, line_no, {O.heading_text('text')} AS title, least({O.heading_marks('text')}, 3)::INT AS level FROM probe), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord FROM h WHERE title IS NOT NULL AND title <> 'Outline' AND NOT {O.page_like('title')}) SELECT doc_id, ord, line_no, level, title FROM k WHERE ord <= 2")

# The search language: its terms, and whole texts in place of paragraphs.
ASKED = ["a b", "a OR b c", '"a b" -c', "(a OR b) NOT c", "a and b", "a AND", "a)", '""', "(a OR b", "low-speed", "-(a)", "NOT"]
_terms = ["a|b", "a|b|c", "a b", "a|b", "a|and|b", "a", "a)", '""', "a|b", "low-speed", "-|a", "NOT"]
_operators = [False, True, True, True, False, True, False, False, True, False, False, True]


def _asked(s: SparkSession, d: str) -> DataFrame:
    """(item_id, query): a search for each text of the table, in one of the forms above, with the text's own words."""
    said = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    own = R.table(s, d, "benchmark").select("item_id", F.get(F.array(*map(F.lit, ASKED)), (F.col("item_id") % len(ASKED)).cast("int")).alias("query"), said.alias("w")).where("size(w) >= 3")
    for k, letter in enumerate("abc"):
        own = own.withColumn("query", F.regexp_replace("query", rf"\b{letter}\b", F.get("w", F.lit(k))))
    return own.select("item_id", "query")


def asked_sql(answers: list, name: str) -> str:
    """The same searches, and the answers to their forms with the same words."""
    put = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '\\ba\\b', w[1], 'g'), '\\bb\\b', w[2], 'g'), '\\bc\\b', w[3], 'g')"
    of = lambda rows: "[" + ", ".join(O.q(x) if isinstance(x, str) else str(x).lower() for x in rows) + f"][item_id % {len(ASKED)} + 1]"
    told = put(of(answers)) if isinstance(answers[0], str) else of(answers)
    return f"SELECT item_id, {put(of(ASKED))} AS query, {told} AS {name} FROM (SELECT item_id, regexp_extract_all(text, '[a-z]{{4,}}') AS w FROM benchmark) WHERE len(w) >= 3"


def parsed(name: str, kind: str, of: Callable[[str], object]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rows_of(_asked(s, d).withColumn("asked", F.col("query")), lambda q: [(q, of(q))], f"query string, {name} {kind}", "asked", key="item_id")


_add("g06_highlight_terms", parsed("terms", "string", lambda q: "|".join(search.highlights(search.parse(q)))), asked_sql(_terms, "terms"))
_add("g07_has_operators", parsed("has", "boolean", search.has_operators), asked_sql(_operators, "has"))
_has = lambda x, t: f"contains(lower(strip_accents({x})), '{t}')"
_add("g03_evaluated", lambda s, d: _docs(s, d).select("doc_id", search.compiled(search.parse("(thing OR elle) NOT idiot the"), F.col("text")).alias("holds")), f"SELECT doc_id, ({_has('text', 'thing')} OR {_has('text', 'elle')}) AND NOT {_has('text', 'idiot')} AND {_has('text', 'the')} AS holds FROM documents")
_add("g09_found_cards", lambda s, d: search.matching(_docs(s, d).select("doc_id", R.decoded(R.bounded(F.encode("text", "UTF-8"))).alias("text")), "Élle").select(F.col("doc_id").alias("id")), f"SELECT doc_id AS id FROM documents WHERE octet_length(encode(text)) > 8 AND {_has('text', 'elle')}")
_add(
    "g11_highlight_ranges", lambda s, d: retrieval.highlight_ranges(_lines(s, d), "the"),
    f"WITH {O.LINES}, w AS (SELECT doc_id, line_no, unnest(range(1, least(7, len(string_split(lower(text), 'the'))))) AS k, string_split(lower(text), 'the') AS parts FROM lines), r AS (SELECT doc_id, line_no, k, length(array_to_string(parts[1:k], 'the'))::INT AS \"at\", row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) AS n FROM w) SELECT doc_id, line_no, \"at\" FROM r WHERE n <= 200",
)
_hits = f"hits AS ({queries.ORACLE_SQL['g05_hit_lines']}), matched AS ({queries.ORACLE_SQL['g04_boolean_search']})"
_add(
    "h04_boolean_plan", lambda s, d: retrieval.boolean_plan(_docs(s, d), queries._QUERY),
    f"""WITH {O.LINES}, {_hits}, near AS (SELECT h.doc_id, h.line_no, l.line_no - h.line_no AS off, l.text, {O.trim('l.text')} AS t FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no AND h.line_no + 5),
    cut AS (SELECT *, min(CASE WHEN off > 0 AND starts_with(t, '#') THEN off END) OVER (PARTITION BY doc_id, line_no) AS head FROM near), own AS (SELECT * FROM cut WHERE off < coalesce(head, 9) AND t <> '' AND NOT starts_with(t, '<!--')), sized AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM own),
    said AS (SELECT doc_id, line_no, string_agg(text, {NL} ORDER BY off) AS p FROM sized WHERE before <= 500 GROUP BY 1, 2), kept AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM said), told AS (SELECT doc_id, string_agg(p, {NL} || {NL} ORDER BY line_no) AS excerpt FROM kept WHERE upto <= 12000 GROUP BY 1)
    SELECT h.doc_id, h.hits, coalesce(excerpt, '') AS excerpt FROM (SELECT doc_id, count(*) AS hits FROM hits GROUP BY 1) h LEFT JOIN told USING (doc_id)""",
)
_add(
    "h05_tagged_excerpts", lambda s, d: retrieval.tagged(R.cards(_docs(s, d)).join(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id"), ["en"], queries._QUERY).select("id", "excerpt"),
    f"""WITH RECURSIVE {O.LINES}, {_hits}, f AS (SELECT doc_id, min(line_no) AS i FROM hits GROUP BY 1), e AS (SELECT d.doc_id AS id, substr(CASE WHEN i IS NULL THEN d.text ELSE array_to_string(string_split(d.text, {NL})[greatest(0, i - 2) + 1 : i + 8], {NL}) END, 1, 2400) AS x FROM documents d JOIN matched m ON m.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id WHERE lang = 'en'),
    m AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM e WHERE x <> ''), w AS (SELECT id, r, x AS excerpt, 12000 - length(x) AS leftover FROM m WHERE r = 1 UNION ALL SELECT m.id, m.r, substr(m.x, 1, leftover), leftover - length(substr(m.x, 1, leftover)) FROM w JOIN m ON m.r = w.r + 1 WHERE leftover >= 400) SELECT id, excerpt FROM w""",
)
_add("h10_page_history", lambda s, d: R.table(s, d, "events").groupBy(F.col("event_type").alias("q")).agg(F.max(F.struct("ts", "event_id")).alias("at")).orderBy(F.desc("at")).limit(20).select("q", "at.event_id"), "SELECT event_type AS q, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 ORDER BY max(ts) DESC LIMIT 20")

# Texts and outlines.
_note = "Only the first part of this file is shown."
_add(
    "c02_packed", lambda s, d: _docs(s, d).select("doc_id", shelf.packed_text(F.col("text"), 900, _note).alias("text")),
    f"SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE CASE WHEN contains(substr(text, 1, 900), {NL}) THEN array_to_string(list_reverse(list_reverse(string_split(substr(text, 1, 900), {NL}))[2:]), {NL}) ELSE substr(text, 1, 900) END || {NL} || {NL} || '_{_note}_' || {NL} END AS text FROM documents",
)
_pr = f"WITH {O.PROBES}, h0 AS (SELECT doc_id, line_no, {O.heading_text('text')} AS title, least({O.heading_marks('text')}, 3)::INT AS level FROM probe), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord FROM h0 WHERE title IS NOT NULL AND title <> 'Outline' AND NOT {O.page_like('title')}), e AS (SELECT doc_id, max(line_no) + 1 AS n FROM probe GROUP BY 1)"
_add(
    "f09_rejoin_ranges", lambda s, d: shelf.section_of(outline.headings(_probe(s, d)).select("doc_id", "ord", "level", "line_no"), _probe(s, d).groupBy("doc_id").agg((F.max("line_no") + 1).alias("n"))),
    f"{_pr} SELECT a.doc_id, a.ord, a.line_no AS first, coalesce((SELECT min(b.line_no) FROM h b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.ord <= 180 AND b.level <= a.level), n)::INT AS past FROM h a JOIN e USING (doc_id) WHERE a.ord <= 180",
)
_add("s45_heading_lines", lambda s, d: outline.headings(_probe(s, d)).groupBy("doc_id", F.lower("title").alias("title")).agg(F.min("line_no").alias("line_no")), f"{_pr} SELECT doc_id, lower(title) AS title, min(line_no) AS line_no FROM h WHERE ord <= 180 GROUP BY 1, 2")
_add(
    "s46_heading_at", lambda s, d: (lambda p: p.select("doc_id", "line_no").where("line_no % 3 = 0").join(outline.headings(p).select("doc_id", "ord", F.col("line_no").alias("at")), "doc_id").where("at <= line_no").groupBy("doc_id", "line_no").agg(F.max("ord").alias("ord")))(_probe(s, d)),
    f"{_pr} SELECT p.doc_id, p.line_no, max(ord) AS ord FROM probe p JOIN h ON h.doc_id = p.doc_id AND h.line_no <= p.line_no AND ord <= 180 WHERE p.line_no % 3 = 0 GROUP BY 1, 2",
)
_add(
    "s47_moved_bookmarks", lambda s, d: (lambda b: shelf.moved_bookmarks(b.where("line_no % 4 = 1").select("doc_id", F.col("line_no").alias("ord"), "line_no"), cleanup.line_map(b, cleanup.hidden_page_numbers(b))))(R.page_lines(R.table(s, d, "conversations"))),
    f"WITH {O.BOOK}, k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM book WHERE NOT {O.lone_page_number('text')}), m AS (SELECT b.doc_id, b.line_no AS old, coalesce(min(k.pos) OVER (PARTITION BY b.doc_id ORDER BY b.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(k.pos) OVER (PARTITION BY b.doc_id), 0)::INT AS new FROM book b LEFT JOIN k USING (doc_id, line_no)) SELECT doc_id, old AS ord, new AS line_no FROM m WHERE old % 4 = 1",
)
_add("s56_wants_chapters", lambda s, d: shelf.wants_chapters(_docs(s, d), outline.headings(_probe(s, d)), most=900, few=2), f"{_pr} SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM h WHERE ord <= 180 GROUP BY 1) USING (doc_id) WHERE octet_length(encode(text)) < 900 AND coalesce(n, 0) < 2")
_add("s59_changed_headings", lambda s, d: outline.changed_sections(_probe(s, d)), f"WITH {O.PROBES}, a AS (SELECT doc_id, line_no, last_value(CASE WHEN NOT {O.page_like(O.heading_text('text'))} THEN {O.heading_text('text')} END IGNORE NULLS) OVER w AS section FROM probe WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), b AS (SELECT *, lag(section) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM a) SELECT doc_id, line_no, section FROM b WHERE section IS NOT NULL AND section IS DISTINCT FROM before")
_margin = "SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 4 < 3 THEN 'Reader  Notes ' || turn ELSE substr(text, 1, 20) END AS text, (700 + turn)::DOUBLE AS mid_y, (8 + turn % 4 * 40)::DOUBLE AS height, 0.0::DOUBLE AS box_min_y, 800.0::DOUBLE AS box_height FROM conversations"
_add(
    "d39_margin_lines", lambda s, d: shelf.margin_lines(R.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.expr("if(turn % 4 < 3, concat('Reader  Notes ', turn), left(text, 20))").alias("text"), F.expr("cast(700 + turn as double)").alias("mid_y"), F.expr("cast(8 + turn % 4 * 40 as double)").alias("height"), F.lit(0.0).alias("box_min_y"), F.lit(800.0).alias("box_height")), share=0.1),
    rf"WITH m AS ({_margin}), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM m GROUP BY 1 HAVING count(DISTINCT page) >= 3), k AS (SELECT doc_id, page, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS key FROM m WHERE height <= 96 AND (mid_y >= 656 OR mid_y <= 144)), c AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE key <> '' GROUP BY 1, 2) SELECT c.* FROM c JOIN n USING (doc_id) WHERE pages >= greatest(3, ceil(n * 0.1))",
)

# Cards as JSON, paths, jobs and notes.
_add("b05_library_json", lambda s, d: _cards(s, d).select("id", F.to_json(F.struct("id", "title", "tags")).alias("json")).select("id", F.get_json_object("json", "$.tags[1]").alias("tag"), F.length("json").cast("long").alias("n")).select("id", "tag"), f"WITH {CARDS} SELECT id, tags[2] AS tag FROM cards")
_add(
    "a31_library_read", lambda s, d: _docs(s, d).select("doc_id", F.from_json(F.expr("if(doc_id % 4 = 0, '{broken', concat('{\"title\": \"', lang, '\", \"tags\": [\"', source, '\"]}'))"), "title string, tags array<string>").alias("c")).select("doc_id", "c.title", F.coalesce(F.size("c.tags"), F.lit(0)).alias("tags")).withColumn("tags", F.greatest("tags", F.lit(0))),
    "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lang END AS title, (doc_id % 4 > 0)::INT AS tags FROM documents",
)
_add("a35_batch_outputs", lambda s, d: _cards(s, d).select("id", library.output_path(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".tar.pdf"))).alias("path")), f"WITH {CARDS} SELECT id, '/in/' || id || '.tar/' || id || '.tar.md' AS path FROM cards")
_add("b10_export_lists", lambda s, d: _docs(s, d).groupBy((F.length("text") > 200).alias("written")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "SELECT length(text) > 200 AS written, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
_add(
    "a28_distinct_pictures", lambda s, d: _docs(s, d).select(F.floor(F.col("doc_id") / 20).alias("book"), "doc_id", F.expr("doc_id * 7 % 90").alias("w"), F.expr("doc_id % 60").alias("print")).where("w >= 48").groupBy("book", "print").agg(F.min("doc_id").alias("doc_id")),
    "SELECT doc_id // 20 AS book, doc_id % 60 AS print, min(doc_id) AS doc_id FROM documents WHERE doc_id * 7 % 90 >= 48 GROUP BY 1, 2",
)
_add("s31_names", lambda s, d: _docs(s, d).select("doc_id", F.array_join(shelf.listed(F.expr("concat(' ', lang, '  x ;; ', source, ';')")), "|").alias("names")), "SELECT doc_id, lang || ' x|' || source AS names FROM documents")
_add("s53_moved_paths", lambda s, d: _cards(s, d).select("id", shelf.rewritten_path(F.col("markdown_path"), "/lib/3", "/new").alias("path")), f"WITH {CARDS} SELECT id, CASE WHEN starts_with(markdown_path, '/lib/3/') THEN '/new' || substr(markdown_path, 7) ELSE markdown_path END AS path FROM cards")
_add("s55_enqueued", lambda s, d: _docs(s, d).select(F.expr("concat(source, '/', doc_id % 9)").alias("path")).distinct().join(_docs(s, d).where("doc_id < 40").select(F.expr("concat(source, '/', doc_id % 9)").alias("path")).distinct(), "path", "left_anti"), "SELECT DISTINCT source || '/' || doc_id % 9 AS path FROM documents WHERE (source || '/' || doc_id % 9) NOT IN (SELECT source || '/' || doc_id % 9 FROM documents WHERE doc_id < 40)")
_add("s62_stored", lambda s, d: R.table(s, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).where("user_id % 5 <> 0"), "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
_add("s63_page_finds", lambda s, d: _docs(s, d).select("doc_id", F.regexp_count(F.lower("text"), F.lit("the")).alias("n")).where("n > 0"), "SELECT doc_id, len(regexp_extract_all(lower(text), 'the'))::INT AS n FROM documents WHERE contains(lower(text), 'the')")
_add(
    "s64_daily_notes", lambda s, d: R.table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.concat(F.lit("## "), e.event_type, F.lit("\n"), e.event_id.cast("string"))), "\n\n").alias("note")).select(F.col("day").cast("string").alias("day"), "note"),
    f"SELECT ts::DATE::VARCHAR AS day, string_agg('## ' || event_type || {NL} || event_id, {NL} || {NL} ORDER BY event_id) AS note FROM events GROUP BY 1",
)
_add("s66_dispatched", lambda s, d: _docs(s, d).select("doc_id", F.expr("concat('A.B', doc_id, element_at(array('.PDF', '.html', '.md', '.xyz'), cast(doc_id % 4 + 1 as int)))").alias("f")).select("doc_id", F.regexp_replace("f", r"\.[^.]+$", "").alias("title"), F.when(F.lower("f").rlike(r"\.pdf$"), "pdf").when(F.lower("f").rlike(r"\.html?$"), "html").when(F.lower("f").rlike(r"\.(md|markdown|txt)$"), "text").otherwise("other").alias("kind")), "SELECT doc_id, 'A.B' || doc_id AS title, ['pdf', 'html', 'text', 'other'][doc_id % 4 + 1] AS kind FROM documents")
_jobs = "SELECT user_id, event_id AS id, ts, CASE event_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'running' ELSE 'failed' END AS event FROM events"
_add(
    "p07_job_states", lambda s, d: shelf.latest_states(R.table(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.expr("case event_id % 7 when 0 then 'done' when 1 then 'running' when 2 then 'running' else 'failed' end").alias("event")), "user_id"),
    f"WITH j AS ({_jobs}) SELECT user_id, CASE WHEN bool_or(event = 'done') THEN 'done' WHEN arg_max(event, (ts, id)) = 'failed' AND count(*) FILTER (event = 'failed') < 3 THEN 'queued' ELSE arg_max(event, (ts, id)) END AS status, count(*) FILTER (event = 'failed') AS tries FROM j GROUP BY 1",
)
_add("p09_autosaves", lambda s, d: shelf.autosaves(_docs(s, d).select(F.col("doc_id").alias("key"), F.expr("cast(doc_id * 13 % 700 as int)").alias("seconds"))), "SELECT doc_id AS key, unnest(range(60, doc_id * 13 % 700 + 1, 180))::INT AS at FROM documents")
_add(
    "p06_upserted", lambda s, d: (lambda c: shelf.upserted_cards(c.where("id % 3 <> 1"), c.where("id % 3 = 1").withColumn("id", F.col("id") + 100_000)))(_cards(s, d)).select("path", "id", F.col("place.after").alias("after")),
    f"WITH {CARDS}, a AS (SELECT id + CASE WHEN id % 3 = 1 THEN 100000 ELSE 0 END AS id, markdown_path, source_path, (id % 3 = 1)::INT AS fresh FROM cards), k AS (SELECT markdown_path, arg_max(id, (fresh, id)) AS id, arg_max(source_path, (fresh, id)) AS source_path, max(fresh) AS fresh FROM a GROUP BY 1), o AS (SELECT *, CASE WHEN source_path <> '' THEN source_path ELSE regexp_replace(regexp_replace(markdown_path, '(\\.de|\\.FR-2)?\\.md$', ''), '/([^/]*)$', '|\\1') END AS origin, NOT regexp_matches(markdown_path, '\\.(de|FR-2)\\.md$') AS original FROM k) SELECT markdown_path AS path, id, (fresh = 1 AND NOT original AND origin IN (SELECT origin FROM o WHERE original))::INT AS after FROM o",
)
_LANGS = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
_add("m28_language_labels", lambda s, d: _docs(s, d).select("doc_id", F.coalesce(library.label_of(F.col("lang"), _LANGS), "lang").alias("label")), "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS label FROM documents")
_add("m19b_comments_out", lambda s, d: _docs(s, d).select("doc_id", T.without_comments(F.expr("concat('a<!-- x', chr(10), 'y -->', left(text, 9), '<!-- open ', source)")).alias("text")), "SELECT doc_id, 'a' || substr(text, 1, 9) AS text FROM documents")

# Rules that were covered in part.
_fronted = f"CASE WHEN doc_id % 3 = 0 THEN '---' || {NL} || '# x' || {NL} || '---' || {NL} || '# A ' || text WHEN doc_id % 3 = 1 THEN '---' || {NL} || '# y' || {NL} || text ELSE '# z' || {NL} || '---' || {NL} || text || {NL} || '---' END"
_add(
    "c03b_headings_after_front", lambda s, d: outline.headings(R.lines(_docs(s, d).select("doc_id", F.expr(_fronted).alias("text")))),
    f"WITH f AS (SELECT doc_id, {_fronted} AS text FROM documents), l AS ({O.split_lines('f', 'doc_id', 'text')}), h AS (SELECT doc_id, line_no, {O.heading_text('text')} AS title, least({O.heading_marks('text')}, 3)::INT AS level FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord FROM h WHERE title IS NOT NULL AND title <> 'Outline' AND NOT {O.page_like('title')} AND NOT (doc_id % 3 = 0 AND line_no <= 2)) SELECT doc_id, ord, line_no, level, title FROM k WHERE ord <= 180",
)
_add(
    "f16_paired_titles", lambda s, d: (lambda h: outline.paired_titles(h.where("doc_id % 2 = 0"), h.where("doc_id % 2 = 1 and (ord > 1 or doc_id % 3 = 0)").select((F.col("doc_id") - 1).alias("doc_id"), "ord", F.when(F.col("ord") % 2 == 0, T.upper_letters(F.col("title"))).otherwise(F.lit("8.1")).alias("title"))))(outline.headings(_probe(s, d)).select("doc_id", "ord", F.lit("8.1").alias("t"), "title").select("doc_id", "ord", F.substring("title", 1, 4).alias("title"))),
    f"{_pr}, m AS (SELECT doc_id, ord, substr(title, 1, 4) AS title FROM h WHERE doc_id % 2 = 0 AND ord <= 180), o AS (SELECT doc_id - 1 AS doc_id, ord, CASE WHEN ord % 2 = 0 THEN upper(substr(title, 1, 4)) ELSE '8.1' END AS title FROM h WHERE doc_id % 2 = 1 AND ord <= 180 AND (ord > 1 OR doc_id % 3 = 0)), p AS (SELECT m.doc_id, m.title, o.title AS other FROM m JOIN o USING (doc_id, ord)), u AS (SELECT DISTINCT doc_id, lower(title) AS k FROM p), l AS (SELECT m.doc_id, lower(m.title) AS k, arg_min(m.title, m.ord) AS title FROM m WHERE (m.doc_id, m.ord) NOT IN (SELECT (doc_id, ord) FROM o) AND (m.doc_id, lower(m.title)) NOT IN (SELECT (doc_id, k) FROM u) GROUP BY 1, 2), f AS (SELECT doc_id, lower(title) AS k, arg_min(title, ord) AS other FROM o GROUP BY 1, 2) SELECT * FROM p UNION ALL SELECT l.doc_id, l.title, f.other FROM l JOIN f USING (doc_id, k)",
)
_words = ["what", "about", "thing", "thing", "ention"]
_n = lambda x: " + ".join(f"contains(lower({x}), '{w}')::INT" for w in _words)
_pieces = r"string_split(regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))"
_best = f"WITH p AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, {_pieces} AS a FROM documents)), r AS (SELECT *, {_n('s')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY {_n('s')} DESC, i) AS k FROM p), b AS (SELECT doc_id, string_agg(trim(s), ' ' ORDER BY k) AS best FROM r WHERE n > 0 AND k <= 3 GROUP BY 1)"
_add("h02_page_answers", lambda s, d: retrieval.page_answers(_docs(s, d), "What about thing, thing? Ention"), f"{_best} SELECT doc_id, coalesce(best, {O.q(retrieval.NOT_SAID)}) AS answer FROM documents LEFT JOIN b USING (doc_id)")
_sentences = r"string_split(regexp_replace(text, '([.?!])\s+|\n+', '\1' || chr(1), 'g'), chr(1))"
_add(
    "h02b_page_answers_guarded", lambda s, d: retrieval.page_answers(_docs(s, d), "thing AND ention"),
    f"WITH p AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, {_pieces} AS a FROM documents)), r AS (SELECT *, contains(lower(s), 'thing')::INT + contains(lower(s), 'ention')::INT AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM r), b AS (SELECT doc_id, string_agg(trim(s), ' ' ORDER BY k) AS best FROM k WHERE n > 0 AND k <= 3 GROUP BY 1) SELECT doc_id, CASE WHEN len(list_filter({_sentences}, lambda s: contains(lower(s), 'thing') AND contains(lower(s), 'ention'))) = 0 THEN {O.q(retrieval.NOT_TOGETHER)} ELSE coalesce(best, {O.q(retrieval.NOT_SAID)}) END AS answer FROM documents LEFT JOIN b USING (doc_id)",
)
_add("c28_numbered_reply", lambda s, d: _docs(s, d).select("doc_id", F.array_join(records.numbered_reply(F.concat(F.lit("x <<<1>>> a <<<2>>>"), F.col("text"), F.lit("<<<1>>> "), "lang", F.lit(" <<<3>>> z <<<0>>> y")), 2), ";").alias("parts")), r"SELECT doc_id, '1|' || lang || ';2|' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS parts FROM documents")
_add(
    "p03_heard_changes", lambda s, d: (lambda e: C.heard(C.changes(e.where("event_id % 3 > 0")), e.where("event_id % 3 = 0"), 4).select("path", "event_id"))(R.table(s, d, "events")),
    "WITH o AS (SELECT ts FROM events WHERE event_id % 3 = 0), e AS (SELECT * FROM events WHERE event_id % 3 > 0) SELECT '/in/' || user_id || '.md' AS path, event_id FROM e ASOF LEFT JOIN o ON e.ts >= o.ts WHERE o.ts IS NULL OR e.ts - o.ts >= INTERVAL 4 SECOND",
)

# Joins that other rows have: as-of, interval, by place.
_add("i08_interval", *_READING["f24_page_chapter"])
_add(
    "i10_zipped", lambda s, d: (lambda c, a, b: c.select("conv_id", "turn", F.posexplode(a).alias("k", "a")).join(c.select("conv_id", "turn", F.posexplode(b).alias("k", "b")), ["conv_id", "turn", "k"]))(R.table(s, d, "conversations"), F.split("text", " "), F.split("text", r"\.")),
    "WITH a AS (SELECT conv_id, turn, unnest(range(len(x)))::INT AS k, unnest(x) AS a FROM (SELECT conv_id, turn, string_split(text, ' ') AS x FROM conversations)), b AS (SELECT conv_id, turn, unnest(range(len(x)))::INT AS k, unnest(x) AS b FROM (SELECT conv_id, turn, string_split(text, '.') AS x FROM conversations)) SELECT * FROM a JOIN b USING (conv_id, turn, k)",
)
_add(
    "s50_deleted_files", lambda s, d: library.deleted_files(_cards(s, d), _docs(s, d).where("doc_id % 40 in (3, 5) or doc_id % 7 = 0").select(F.col("doc_id").alias("id"))),
    f"WITH {CARDS}, t AS (SELECT markdown_path AS p, regexp_replace(markdown_path, '\\.md$', '') AS stem, '/lib/' || id % 40 AS f, id % 40 IN (3, 5) OR id % 7 = 0 AS gone FROM cards) SELECT p AS path FROM t WHERE gone UNION SELECT stem || '.outline.json' FROM t WHERE gone UNION SELECT stem || '.searchable.pdf' FROM t WHERE gone UNION SELECT f || '/figures' FROM t GROUP BY f HAVING bool_and(gone)",
)
_add(
    "s54_imported", lambda s, d: library.new_files(_docs(s, d).select(F.expr("concat('/In/', source, '/', doc_id % 30, '.md')").alias("path")), _docs(s, d).where("doc_id % 3 = 0").select(F.expr("concat('/in/', source, '/', doc_id % 30, '.md')").alias("path"))).select("path", library.sidecar(F.col("path")).alias("outline")),
    "SELECT DISTINCT '/in/' || source || '/' || doc_id % 30 || '.md' AS path, '/in/' || source || '/' || doc_id % 30 || '.outline.json' AS outline FROM documents WHERE (source, doc_id % 30) NOT IN (SELECT (source, doc_id % 30) FROM documents WHERE doc_id % 3 = 0)",
)
