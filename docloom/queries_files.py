"""Queries of files, records and the library, with DuckDB SQL written apart from the Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as T
from .operators import cleanup, library, outline, reading, records
from .sources import relations as R
from .streaming import changes as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NL = "chr(10)"
EDGE = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _probe(s: SparkSession, d: str) -> DataFrame:
    return R.probe_lines(_docs(s, d))


def _cards(s: SparkSession, d: str) -> DataFrame:
    return R.cards(_docs(s, d))


def _rule(name: str, rule: Callable[[Column], Column], sql: str) -> None:
    """A rule on each line of the fixture, where it gives a value."""
    _add(name, lambda s, d: _probe(s, d).select("doc_id", "line_no", rule(F.col("text")).alias("value")).where("value is not null"), f"WITH {O.PROBES} SELECT * FROM (SELECT doc_id, line_no, {sql} AS value FROM probe) WHERE value IS NOT NULL")


def _edges(x: str) -> str:
    return O.sub(x, EDGE)


# Sources: bounded reads, decoding, and what a conversion left.
_add(
    "a04_bounded_read", lambda s, d: _docs(s, d).select("doc_id", R.bounded(F.encode("text", "UTF-8")).alias("b")).where("b is not null").select("doc_id", F.length("b").cast("long").alias("kept"), F.md5("b").alias("digest")),
    "SELECT doc_id, least(octet_length(encode(text)), 2000000)::BIGINT AS kept, md5(encode(text)[:2000000]) AS digest FROM documents WHERE octet_length(encode(text)) > 8".replace("md5(encode(text)[:2000000])", "md5(text)"),
)
_cut = "9 + doc_id % 61"
_add(
    "a05_decoded", lambda s, d: _docs(s, d).select("doc_id", R.decoded(F.expr(f"substring(encode(text, 'UTF-8'), 1, cast({_cut} as int))")).alias("text")).where("length(text) > 0"),
    f"WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS k, ({_cut}) AS most FROM (SELECT doc_id, substr(text, 1, 80) AS text FROM documents)), m AS (SELECT doc_id, max(k) AS k FROM c WHERE octet_length(encode(substr(text, 1, k))) <= most GROUP BY 1) SELECT doc_id, substr(text, 1, k) AS text FROM documents JOIN m USING (doc_id)",
)
_add("a06_passed_through", lambda s, d: _docs(s, d).select("doc_id", R.decoded(F.encode("text", "UTF-8")).alias("text")), "SELECT doc_id, text FROM documents")
_add(
    "a03_url_parameters", lambda s, d: _docs(s, d).select("doc_id", F.expr("concat('docs://open?', element_at(array('file', 'path', 'url', 'other'), cast(doc_id % 4 + 1 as int)), '=', if(doc_id % 3 = 0, '', '%2F'), 'in%20box/', source, '.md&x=1')").alias("u")).select("doc_id", R.url_source(F.col("u")).alias("path")).where("path is not null"),
    "SELECT doc_id, '/in box/' || source || '.md' AS path FROM documents WHERE doc_id % 4 < 3 AND doc_id % 3 <> 0",
)
_xml = "'<w:p><w:t>A &amp;lt; B</w:t></w:p>' || html || '<si>x  ' || chr(9) || '</si>'"
_plain = O.sub(O.sub(O.sub(O.sub(_xml, "</w:p>", "\n"), "</a:p>", "\n"), "</si>", "\n"), "<[^>]+>")
_add(
    "a12_xml_text", lambda s, d: R.table(s, d, "pages").select("page_id", R.xml_text(F.expr("concat('<w:p><w:t>A &amp;lt; B</w:t></w:p>', html, '<si>x  ', chr(9), '</si>')")).alias("text")),
    "SELECT page_id, " + _edges(O.sub(f"replace(replace(replace({_plain}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')", "[ \t]+\n", "\n")) + " AS text FROM pages",
)
_made = "concat('# Page ', cast(doc_id % 9 as string), chr(10), '![alt text of it](figures/long-name.png)', chr(10), '<!-- a', chr(10), 'comment of some length -->', chr(10), substring(text, 1, cast(doc_id % 160 as int)), chr(10), '##  Page 12')"
_made_sql = f"'# Page ' || (doc_id % 9) || {NL} || '![alt text of it](figures/long-name.png)' || {NL} || '<!-- a' || {NL} || 'comment of some length -->' || {NL} || substr(text, 1, doc_id % 160) || {NL} || '##  Page 12'"
_add(
    "a24_thin_output", lambda s, d: _docs(s, d).select("doc_id", R.thin(F.expr(_made), F.col("doc_id") % 7).alias("thin")),
    rf"SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({_made_sql}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?m)^#+\s*Page\s+[0-9]+\s*$', ' ', 'g'), '[\p{{L}}\p{{M}}]')) < greatest(60, doc_id % 7 * 25) AS thin FROM documents",
)
_few = f"'# - [' || substr(text, 1, doc_id % 120) || '](x) |' || {NL}"
_add(
    "a25_empty_output", lambda s, d: _docs(s, d).select("doc_id", R.blank(F.expr("concat('# - [', substring(text, 1, cast(doc_id % 120 as int)), '](x) |', chr(10))")).alias("blank")),
    f"SELECT doc_id, length({_edges(f'translate({_few}, ' + O.q('>#*-[]()`') + ', ' + O.q(' ' * 9) + ')')}) < 80 AS blank FROM documents",
)
_words = "WITH w AS (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS s FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)), i AS (SELECT doc_id, k % 5 * 10 + k / 1000 AS x, round((500 - k // 5 * 9 - k % 2) / 3.0) * 3 AS r, s FROM w)"
_add(
    "a19_item_lines", lambda s, d: reading.item_lines(_docs(s, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "s")).select("doc_id", (F.col("k") % 5 * 10 + F.col("k") / 1000).alias("x"), (500 - F.floor(F.col("k") / 5) * 9 - F.col("k") % 2).cast("double").alias("y"), "s")),
    f"{_words}, g AS (SELECT doc_id, r, trim(regexp_replace(string_agg(s, ' ' ORDER BY x, s), '\\s+', ' ', 'g')) AS text FROM i GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) - 1 AS line, text FROM g WHERE text <> ''",
)

# Sinks and names.
_stem = r"regexp_replace(regexp_extract(markdown_path, '([^/]*)$', 1), '\.[^.]*$', '')"
_add("b01_output_path", lambda s, d: _cards(s, d).select("id", library.output_path(F.col("markdown_path")).alias("path")), f"WITH {O.CARDS} SELECT id, regexp_replace(markdown_path, '/[^/]*$', '') || '/' || {_stem} || '/' || {_stem} || '.md' AS path FROM cards")
_base = rf"regexp_replace({_stem}, '(?i)\.({'|'.join(library.CODES)})(-[0-9]+)?$', '')"
_add(
    "b03_translation_copies", lambda s, d: library.translation_copies(_cards(s, d).withColumn("lang", F.get("tags", F.lit(0)))),
    f"WITH {O.CARDS}, r AS (SELECT id, regexp_replace(markdown_path, '/[^/]*$', '') || '/' || {_stem} || '.' || tags[1] AS base FROM cards), n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM r) SELECT id, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' AS path FROM n",
)

# Lines.
_picture = "_A picture is stored as a file in the figures folder (Finder)._"
_shown = f"CASE WHEN line_no % 9 = 4 THEN 'x ![p](data:image/png;base64,AA) ' || text ELSE repeat(text, 1 + line_no % 3) END"
_add(
    "c01_reader_lines", lambda s, d: reading.reader_lines(R.lines(_docs(s, d)).withColumn("text", F.expr(_shown.replace("'x ![p](data:image/png;base64,AA) ' || text", "concat('x ![p](data:image/png;base64,AA) ', text)").replace("1 + line_no % 3", "cast(1 + line_no % 3 as int)")))),
    f"WITH {O.LINES}, v AS (SELECT doc_id, line_no, {_shown} AS text FROM lines) SELECT doc_id, line_no, CASE WHEN contains(text, 'data:image') THEN '{_picture}' WHEN length(text) > 1800 THEN substr(text, 1, 1800) || '…' ELSE text END AS text FROM v WHERE line_no < 40000",
)
_add(
    "c20_opening_lines", lambda s, d: reading.opening_lines(R.lines(_docs(s, d)).withColumn("text", F.expr("if((doc_id + line_no) % 37 = 5, '<!-- page 2 -->', text)"))),
    f"WITH RECURSIVE {O.LINES}, v AS (SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 37 = 5 THEN '<!-- page 2 -->' ELSE text END AS text FROM lines), w AS (SELECT doc_id, line_no, text, {O.trim('text')} = '<!-- page 2 -->' AS mark, {O.trim('text')} <> '' AS said FROM v), r AS (SELECT doc_id, line_no, text, mark::INT AS pages, (said AND NOT mark)::INT AS n, said AND NOT mark AS kept, false AS done FROM w WHERE line_no = 0 UNION ALL SELECT w.doc_id, w.line_no, w.text, pages + w.mark::INT, r.n + (said AND NOT mark AND pages <= 2)::INT, said AND NOT mark AND pages <= 2, (pages = 0 AND r.n >= 80) OR r.n >= 160 OR pages + w.mark::INT > 2 FROM r JOIN w ON w.doc_id = r.doc_id AND w.line_no = r.line_no + 1 WHERE NOT done) SELECT doc_id, line_no, text FROM r WHERE kept AND NOT done",
)
_inner = "regexp_extract(" + O.trim("text") + ", '(?s)^!\\[.*?\\]\\(([^)]*)\\)', 1)"
_path = f"trim(split_part({_inner}, ' ', 1), '\"'' ')"
_rule("c27_figure_name", reading.figure_name, f"nullif(list_last(string_split({_path}, '/')), '')")
_guard = "CASE WHEN length(b) < 40 OR (length(a) > 200 AND length(b) < length(a) // 5) THEN text ELSE short END"
_add(
    "d19_guarded", lambda s, d: _docs(s, d).select("doc_id", reading.guarded(F.col("text"), F.expr("concat('  ', substring(text, 1, cast(30 + doc_id % 300 as int)), chr(10))")).alias("text")),
    f"SELECT doc_id, {_guard} AS text FROM (SELECT *, {_edges('text')} AS a, {_edges('short')} AS b FROM (SELECT doc_id, text, '  ' || substr(text, 1, 30 + doc_id % 300) || {NL} AS short FROM documents))",
)
_rule("d08_footer_address", lambda c: F.when(T.footer_address(c), T.folded(c)), f"CASE WHEN {O.footer_address('text')} THEN {O.folded('text')} END")

# A book of twenty documents, a page each, with a running header.
_pages = "SELECT doc_id // 20 AS conv_id, doc_id % 20 AS turn, text FROM documents"
BOOK20 = O.BOOK.replace("FROM conversations", f"FROM ({_pages})")


def _book20(s: SparkSession, d: str) -> DataFrame:
    return R.page_lines(_docs(s, d).select(F.floor(F.col("doc_id") / 20).alias("conv_id"), (F.col("doc_id") % 20).alias("turn"), "text"))


_t, _h = "t", O.heading_text("t")
_title = f"coalesce({_h}, t)"
_key = (
    "CASE WHEN t <> '' AND NOT " + O.has("t", r"^(!\[|\|)") + f" AND ({O.page_comment('t')}) IS NULL AND NOT {O.contents_line('t')} AND length({_title}) <= 80"
    f" AND ({O.footer_address(_title)} OR (len(list_filter(string_split_regex({_title}, '\\s+'), lambda w: {O.has('w', chr(92) + 'p{L}')})) BETWEEN 2 AND 14 AND length({O.folded(_title)}) >= 2)) THEN {O.folded(_title)} END"
)
_keyed = f"keyed AS (SELECT doc_id, line_no, text, {_key} AS key FROM (SELECT *, {O.trim('text')} AS t FROM book))"
_add("d07_repeated_lines", lambda s, d: cleanup.repeated_lines(_book20(s, d)), f"WITH {BOOK20}, {_keyed} SELECT doc_id, key, count(*) AS times FROM keyed WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")
_add(
    "d07b_without_repeated", lambda s, d: cleanup.without_repeated(_book20(s, d)),
    f"WITH {BOOK20}, {_keyed}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS times, ({O.heading_text('text')}) IS NOT NULL AS head, sum((({O.heading_text('text')}) IS NOT NULL)::INT) OVER (PARTITION BY doc_id, key ORDER BY line_no) AS nth FROM keyed) SELECT doc_id, line_no, text FROM c WHERE key IS NULL OR times < 10 OR (head AND nth = 1)",
)

# Outline: slugs one after another, as later ones look at all before.
_heads = "h0 AS (SELECT doc_id, line_no, " + O.heading_text("text") + " AS title FROM probe), h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord, lower(title) AS low FROM h0 WHERE title IS NOT NULL AND title <> 'Outline' AND NOT " + O.page_like("title") + ")"
_slug = O.sub(O.sub("low", r"[^\p{L}\p{N}\p{M}]+", "-"), "^-+|-+$")
_add(
    "f23_slugs", lambda s, d: outline.slugs(_probe(s, d)),
    f"WITH RECURSIVE {O.PROBES}, {_heads}, b AS (SELECT doc_id, ord, CASE WHEN s = '' THEN 'h-section' WHEN starts_with(s, 'xml') OR {O.has('s', '^' + chr(92) + 'p{N}')} THEN 'h-' || s ELSE s END AS s FROM (SELECT doc_id, ord, {_slug} AS s FROM h WHERE ord <= 180)), r AS (SELECT doc_id, ord, [s] AS used FROM b WHERE ord = 1 UNION ALL SELECT b.doc_id, b.ord, list_append(used, CASE WHEN list_contains(used, s) THEN list_filter(list_transform(range(2, len(used) + 4), lambda n: s || '-' || n), lambda c: NOT list_contains(used, c))[1] ELSE s END) FROM r JOIN b ON b.doc_id = r.doc_id AND b.ord = r.ord + 1) SELECT doc_id, ord, list_last(used) AS slug FROM r",
)

# Records.
_one = _edges("replace(text, chr(10), ' ')")
_yq = lambda x: f"CASE WHEN {x} = '' OR {O.has(x, '[]:#{}&*!|>' + chr(39) + chr(34) + '%@`[]')} OR {x}[1] IN ('-', '?') THEN '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE {x} END"
_rule("a16_yaml_scalar", lambda c: records.yaml_quoted(F.concat(c, F.lit("\n "))), _yq(_edges("replace(text || chr(10) || ' ', chr(10), ' ')")))
_add(
    "a15_titled", lambda s, d: _docs(s, d).select("doc_id", records.titled(F.expr("if(doc_id % 3 = 0, concat(' ', chr(10), '---', chr(10), text), text)"), F.expr("if(doc_id % 5 = 0, ' ', concat('T: ', lang, ' '))"), F.expr("concat(source, '.pdf')")).alias("text")),
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || {NL} || '---' || {NL} || text WHEN doc_id % 5 = 0 OR starts_with(ltrim(text, ' ' || {NL}), '---') THEN text ELSE '---' || {NL} || 'title: \"T: ' || lang || '\"' || {NL} || 'source: ' || source || '.pdf' || {NL} || '---' || {NL} || {NL} || text END AS text FROM documents",
)
_strip = lambda x: f"trim({x}, ' .')"
_pl = f"(CASE WHEN {O.has(O.trim('text'), '^#{1,6} ')} THEN {O.trim(O.sub(O.trim('text'), '^#+ '))} ELSE {O.trim('text')} END)"
_pl = f"(CASE WHEN starts_with({_pl}, '**') AND ends_with({_pl}, '**') AND length({_pl}) > 4 THEN {O.trim(f'substr({_pl}, 3, length({_pl}) - 4)')} ELSE {_pl} END)"
_cr = r"(?i)^copyright\b(?:\s*(?:©|\(c\)))?\s*[, ]*\s*([0-9]{4})?(?:\s+by\s+(.+))?$"
_add(
    "m11_copyright_line", lambda s, d: _probe(s, d).select("doc_id", "line_no", records.copyright_fields(F.col("text")).alias("value")).where("value is not null"),
    f"WITH {O.PROBES}, p AS (SELECT doc_id, line_no, {_pl} AS t FROM probe), f AS (SELECT doc_id, line_no, {O.ext('t', _cr, 1)} AS y, CASE WHEN length({_strip(O.ext('t', _cr, 2))}) >= 2 THEN {_strip(O.ext('t', _cr, 2))} ELSE '' END AS a FROM p WHERE {O.has('t', _cr)}) SELECT doc_id, line_no, 'Copyright' || CASE WHEN y <> '' THEN ' © ' || y ELSE '' END || CASE WHEN a <> '' THEN ' by ' || a ELSE '' END || '|' || y || '|' || a AS value FROM f",
)
_pub = r"(?i)^published by\s+(.{2,80})$"
_rule("m11b_published_by", records.published_by, f"CASE WHEN {O.has(_pl, _pub)} AND length({_strip(O.ext(_pl, _pub))}) >= 2 THEN {_strip(O.ext(_pl, _pub))} END")
_isbn = r"(?i)^isbn(?:-1[03])?\s*[:#]?\s*([0-9x][0-9x \-]{8,22})$"
_rule("m11c_isbn_line", records.isbn_line, f"nullif({O.ext(_pl, _isbn)}, '')")
_add(
    "m16_ordered_pair", lambda s, d: (lambda c: library.twins(c).join(c.select("id", "markdown_path"), "id").join(c.select(F.col("id").alias("master"), F.col("markdown_path").alias("other")), "master").select("id", "master", F.when(reading.ordered_pair(F.col("markdown_path"), F.col("other")), F.col("id")).otherwise(F.col("master")).alias("left")))(_cards(s, d)),
    f"WITH {O.CARDS}, k AS (SELECT *, CASE WHEN source_path <> '' THEN lower(source_path) ELSE lower(regexp_replace(markdown_path, '/[^/]*$', '')) || '|' || lower({_base}) END AS origin, {_stem} AS own, {_base} AS base FROM cards), g AS (SELECT origin, coalesce(min(id) FILTER (lower(own) = lower(base)), arg_min(id, (length(title), id))) AS master FROM k GROUP BY 1) SELECT a.id, b.id AS master, CASE WHEN lower(a.own) = lower(a.base) THEN a.id WHEN lower(b.own) = lower(a.base) THEN b.id WHEN length(a.own) <= length(b.own) THEN a.id ELSE b.id END AS \"left\" FROM k a JOIN g USING (origin) JOIN k b ON b.id = master WHERE a.id <> b.id",
)
_ver = "CASE doc_id % 4 WHEN 0 THEN (doc_id % 3) || '.' || (doc_id % 12) WHEN 1 THEN 'v1.9.0.' || (doc_id % 2) WHEN 2 THEN '1.9.x.1' ELSE '1.beta.9.0.0.0.0.' || (doc_id % 3) END"
_nums = "list_filter(list_transform(string_split({x}, '.'), lambda p: TRY_CAST(regexp_replace(p, '[^0-9]', '', 'g') AS BIGINT)), lambda n: n IS NOT NULL)"
_add(
    "m17_newer", lambda s, d: _docs(s, d).select("doc_id", records.newer(F.expr("case doc_id % 4 when 0 then concat(doc_id % 3, '.', doc_id % 12) when 1 then concat('v1.9.0.', doc_id % 2) when 2 then '1.9.x.1' else concat('1.beta.9.0.0.0.0.', doc_id % 3) end"), F.lit("1.9.0")).alias("newer")),
    f"SELECT doc_id, list_resize(v, 9, 0) > list_resize([1, 9, 0]::BIGINT[], 9, 0) AS newer FROM (SELECT doc_id, {_nums.format(x=_ver)} AS v FROM documents)",
)
_add("m27_web_query", lambda s, d: _docs(s, d).select("doc_id", records.web_query(F.lit("what is it?"), F.expr("if(doc_id % 2 = 0, '', source)"), F.expr("if(lang = 'en', '', lang)"), F.lit("note")).alias("q")), "SELECT doc_id, array_to_string(list_filter(['what is it?', CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, CASE WHEN lang = 'en' THEN '' ELSE lang END, 'note'], lambda x: x <> ''), ' — ') AS q FROM documents")
_says = ["The excerpt does not say.", "Not in this chapter", "It does NOT mention it", "This is not mentioned", "does not contain", "is not defined in it", "no answer", "An answer"]
_add(
    "g15_silent", lambda s, d: _docs(s, d).where(records.silent(F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, _says)), (F.col("doc_id") % 8 + 1).cast("int"))))).select("doc_id"),
    f"SELECT doc_id FROM documents WHERE len(list_filter(['excerpt does not', 'excerpt is silent', 'not in the excerpt', 'not in this chapter', 'not in this file', 'does not define', 'does not provide an answer', 'does not mention', 'not mentioned', 'not defined in'], lambda n: contains(lower(coalesce(text || ' ', '') || [{', '.join(map(O.q, _says))}][doc_id % 8 + 1]), n))) > 0",
)
_add("m25_unquoted", lambda s, d: _docs(s, d).select("doc_id", records.unquoted(F.expr("case doc_id % 3 when 0 then concat('\"', lang, ' ', source, '\"') when 1 then concat(chr(39), source, chr(39)) else concat(' ', lang, ' ') end")).alias("v")), "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || source WHEN 1 THEN source ELSE lang END AS v FROM documents")
_below = f"CASE doc_id % 4 WHEN 0 THEN 'A' || {NL} || 'a' || {NL} || {NL} || {NL} || 'B' || {NL} || {NL} || 'C' WHEN 1 THEN lang WHEN 2 THEN '' ELSE lang || {NL} || {NL} || source END"
_mine = f"lang || {NL} || {NL} || source"
_add(
    "n04_zipped", lambda s, d: _docs(s, d).select("doc_id", reading.zipped(F.expr("concat(lang, chr(10), chr(10), source)"), F.expr("case doc_id % 4 when 0 then concat('A', chr(10), 'a', chr(10), chr(10), chr(10), 'B', chr(10), chr(10), 'C') when 1 then lang when 2 then '' else concat(lang, chr(10), chr(10), source) end")).alias("text")),
    f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || {NL} || {NL} || '> A' || {NL} || '> a' || {NL} || {NL} || source || {NL} || {NL} || '> B' || {NL} || {NL} || '> C' ELSE {_mine} END AS text FROM documents",
)

_b6 = {
    "title": "substring(text, 1, cast(doc_id % 30 as int))", "authors": "if(doc_id % 4 = 0, array(concat('A. ', chr(34), 'N', chr(34)), '', source), array())", "publisher": "if(doc_id % 5 = 0, '  ', concat(' House ', lang))",
    "subjects": "if(doc_id % 3 = 0, array(lang, source), array())", "lang": "lang", "isbn": "concat('978-0-306-40615-', doc_id % 10)", "source_name": "source", "pdf_producer": "if(doc_id % 2 = 0, 'x', null)",
}
_e = lambda x: "'\"' || replace(replace(" + O.sub(x, "\r\n|\n|\r", " ") + ", chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
_add(
    "b06_yaml_block", lambda s, d: _docs(s, d).select("doc_id", records.yaml_block({k: F.expr(v) for k, v in _b6.items()}).alias("block")),
    f"""SELECT doc_id, array_to_string(list_filter(['---', CASE WHEN t <> '' THEN 'title: ' || {_e('t')} END, CASE WHEN doc_id % 4 = 0 THEN 'author:' || {NL} || '  - "A. ' || chr(92) || '"N' || chr(92) || '""' || {NL} || '  - "' || source || '"' END,
    CASE WHEN doc_id % 5 > 0 THEN 'publisher: "House ' || lang || '"' END, CASE WHEN doc_id % 3 = 0 THEN 'subject:' || {NL} || '  - "' || lang || '"' || {NL} || '  - "' || source || '"' END, 'lang: "' || lang || '"',
    CASE WHEN doc_id % 10 = 7 THEN 'identifier:' || {NL} || '  - scheme: ISBN-13' || {NL} || '    text: "9780306406157"' END, 'source: "' || source || '"', CASE WHEN doc_id % 2 = 0 THEN 'pdf-producer: "x"' END, '---', '', ''], lambda x: x IS NOT NULL), {NL}) AS block
    FROM (SELECT *, {_edges('substr(text, 1, doc_id % 30)')} AS t FROM documents)""",
)

# Library.
_low = "lower(title || ' ' || source_name)"
for _n, _q, _where in (
    ("g12_title_hits", "ention er", f"contains({_low}, 'ention er') OR len(list_filter(tags, lambda t: contains(lower(t), 'ention er'))) > 0 OR contains({_low}, 'ention')"),
    ("g12b_title_tag_hits", " #FR ", f"contains({_low}, '#fr') OR len(list_filter(tags, lambda t: contains(lower(t), 'fr'))) > 0"),
    ("g12c_title_word_hits", "The SRC12 of und", f"contains({_low}, 'the src12 of und') OR len(list_filter(tags, lambda t: contains(lower(t), 'the src12 of und'))) > 0 OR (contains({_low}, 'src12') AND contains({_low}, 'und')) OR contains({_low}, 'src12')"),
):
    _add(_n, lambda s, d, q=_q: library.title_hits(_cards(s, d), q).select("id"), f"WITH {O.CARDS} SELECT id FROM cards WHERE {_where}")
_wide = "SELECT * REPLACE ('' AS source_path, '/lib/' || (id % 211) || '/' || id % 7 || '.md' AS markdown_path) FROM cards"
_add(
    "k06_least_recent", lambda s, d: library.victim(_cards(s, d).withColumns({"source_path": F.lit(""), "markdown_path": F.expr("concat('/lib/', id % 211, '/', id % 7, '.md')")}), 100, kept=[1, 27]),
    f"WITH {O.CARDS}, w AS ({_wide}), g AS (SELECT '/lib/' || (id % 211) || '|' || id % 7 AS origin, max(opened) AS opened, max((id IN (1, 27))::INT) AS spared FROM w GROUP BY 1) SELECT arg_min(origin, (opened, origin)) FILTER (WHERE spared = 0) AS origin FROM g HAVING count(*) > 100",
)
_jobs = "SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' WHEN 3 THEN 'running' ELSE 'done' END AS status FROM events"
_add(
    "j15_job_counts", lambda s, d: library.job_counts(R.table(s, d, "events").select("user_id", F.expr("case event_id % 5 when 0 then 'queued' when 1 then 'failed' when 2 then 'done' when 3 then 'running' else 'done' end").alias("status")), "user_id"),
    f"SELECT user_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'failed') AS failed, bool_or(status = 'running') AS running, bool_or(status IN ('done', 'failed')) AS recent FROM ({_jobs}) GROUP BY 1",
)
_vault = "SELECT doc_id AS id FROM documents WHERE contains(source, 'src1') ORDER BY doc_id DESC"
_add("o08_vault", lambda s, d: _cards(s, d).where(F.contains("markdown_path", F.lit("src1"))).orderBy(F.desc("added"), "id").select("id"), _vault)
_hist = "SELECT event_id AS id, ts AS at_, CASE WHEN event_id % 2 = 0 THEN 'WHAT ' ELSE 'what ' END || event_type AS question, 'c' || user_id % 3 AS chapter, '/in/' || user_id || '.md' AS file FROM events"
_add(
    "h09_history", lambda s, d: library.upserted(R.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.expr("concat(if(event_id % 2 = 0, 'WHAT ', 'what '), event_type)").alias("question"), F.expr("concat('c', user_id % 3)").alias("chapter"), F.expr("concat('/in/', user_id, '.md')").alias("file"))).select("id", "question"),
    f"SELECT id, question FROM (SELECT *, row_number() OVER (PARTITION BY lower(question), lower(chapter), lower(file) ORDER BY at_ DESC, id DESC) AS r FROM ({_hist})) WHERE r = 1 ORDER BY at_ DESC, id DESC LIMIT 25",
)
_add("i04_semi", lambda s, d: library.groups_with(_cards(s, d), R.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))), f"WITH {O.CARDS}, k AS (SELECT id, CASE WHEN source_path <> '' THEN lower(source_path) ELSE lower(regexp_replace(markdown_path, '/[^/]*$', '')) || '|' || lower({_base}) END AS origin FROM cards) SELECT DISTINCT origin FROM k WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add(
    "i05_anti", lambda s, d: library.new_files(_docs(s, d).select(F.expr("concat('/In/./', source, '/', doc_id % 50, '.MD')").alias("path")), _docs(s, d).where("doc_id % 2 = 0").select(F.expr("concat('/in/', source, '/', doc_id % 50, '.md')").alias("path"))),
    "SELECT DISTINCT '/in/' || source || '/' || doc_id % 50 || '.md' AS path FROM documents WHERE ('/in/' || source || '/' || doc_id % 50 || '.md') NOT IN (SELECT '/in/' || source || '/' || doc_id % 50 || '.md' FROM documents WHERE doc_id % 2 = 0)",
)
_add(
    "i06_left_default", lambda s, d: library.with_bookmarks(_cards(s, d), outline.headings(_probe(s, d))),
    f"WITH {O.PROBES}, {_heads}, {O.CARDS}, b AS (SELECT doc_id AS id, count(*) AS n FROM h WHERE ord <= 180 GROUP BY 1) SELECT id, coalesce(n, 0) AS bookmarks FROM cards LEFT JOIN b USING (id)",
)
_add("l03_difference", lambda s, d: library.watch_changes(_cards(s, d).where("id % 3 > 0").select(F.col("markdown_path").alias("path")), _cards(s, d).where("id % 5 > 0").select(F.col("markdown_path").alias("path"))), f"WITH {O.CARDS}, a AS (SELECT DISTINCT markdown_path AS path FROM cards WHERE id % 3 > 0), b AS (SELECT DISTINCT markdown_path AS path FROM cards WHERE id % 5 > 0) SELECT path, 'stop' AS \"do\" FROM a ANTI JOIN b USING (path) UNION ALL SELECT path, 'start' FROM b ANTI JOIN a USING (path)")

# Changes: one pending task for all paths.
_add(
    "p02_debounced", lambda s, d: C.debounced(C.changes(R.table(s, d, "events"))).select("path", "event_id"),
    "SELECT '/in/' || user_id || '.md' AS path, event_id FROM (SELECT *, lead(ts) OVER (ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR following - ts >= INTERVAL 1 SECOND",
)
_add(
    "p10_debounced_search", lambda s, d: C.debounced(C.changes(R.table(s, d, "events")), 0.35).select("path", "event_id"),
    "SELECT '/in/' || user_id || '.md' AS path, event_id FROM (SELECT *, lead(ts) OVER (ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR following - ts >= INTERVAL 350 MILLISECOND",
)
_add(
    "p05_inbox", lambda s, d: C.inbox(_docs(s, d).select(F.expr("concat('/in/', case doc_id % 6 when 0 then '' when 1 then concat(source, '/') when 2 then 'a/b/' when 3 then 'figures/' when 4 then concat(source, '/figures/') else '' end, doc_id % 90, case when doc_id % 7 = 0 then '.png' when doc_id % 6 = 5 then '_Forage.md' else '.md' end)").alias("path")), "/in", _docs(s, d).where("doc_id % 4 = 0").select(F.expr("concat('/IN/', doc_id % 90, '.md')").alias("path"))),
    "WITH f AS (SELECT DISTINCT '/in/' || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN source || '/' WHEN 2 THEN 'a/b/' WHEN 3 THEN 'figures/' WHEN 4 THEN source || '/figures/' ELSE '' END || doc_id % 90 || CASE WHEN doc_id % 7 = 0 THEN '.png' WHEN doc_id % 6 = 5 THEN '_Forage.md' ELSE '.md' END AS path FROM documents) SELECT path FROM f WHERE ends_with(path, '.md') AND NOT ends_with(path, '_Forage.md') AND (regexp_matches(path, '^/in/[^/]+$') OR (regexp_matches(path, '^/in/[^/]+/[^/]+$') AND NOT starts_with(path, '/in/figures/'))) AND lower(path) NOT IN (SELECT '/in/' || doc_id % 90 || '.md' FROM documents WHERE doc_id % 4 = 0)",
)
