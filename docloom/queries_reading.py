"""Queries of reading order, page chrome by place, pairing and line edits, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .operators import library, outline, reading
from .sources import relations as R
from .streaming import changes as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


def _probe(s: SparkSession, d: str) -> DataFrame:
    return R.probe_lines(_docs(s, d))


_add(
    "a22_scanned", lambda s, d: reading.scanned(R.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.length("text").alias("chars"), (F.length("text") % 4).alias("ops"))),
    "WITH p AS (SELECT conv_id AS doc_id, turn AS page, length(text) AS chars, length(text) % 4 AS ops, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT doc_id, count(*) AS k, sum((ops < 2)::INT) AS thin, sum(chars) AS chars FROM p WHERE page IN (0, 1) OR (page = 2 AND n > 8) OR page = n // 2 OR page = n * 3 // 4 OR page = n - 1 GROUP BY 1) SELECT doc_id, thin * 2 >= k OR chars < 48 * k AS scan FROM s",
)
_front = "CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END || text WHEN doc_id % 3 = 1 THEN '---' || chr(10) || text ELSE text END"
_add(
    "c18_body_starts", lambda s, d: reading.body_starts(R.lines(_docs(s, d).select("doc_id", F.expr(_front).alias("text")))),
    f"WITH d AS (SELECT doc_id, {_front} AS text FROM documents), l AS ({O.split_lines('d', 'doc_id', 'text')}), m AS (SELECT doc_id, max(CASE WHEN line_no = 0 AND {O.trim('text')} = '---' THEN 1 END) AS o, min(CASE WHEN line_no BETWEEN 1 AND 40 AND {O.trim('text')} = '---' THEN line_no END) AS c FROM l GROUP BY 1) SELECT m.doc_id, CASE WHEN o IS NOT NULL AND c IS NOT NULL THEN c + 1 + coalesce(({O.trim('l.text')} = '')::INT, 0) ELSE 0 END AS start FROM m LEFT JOIN l ON l.doc_id = m.doc_id AND l.line_no = m.c + 1",
)
_add(
    "d11_edge_chrome", lambda s, d: reading.edge_chrome(R.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.split(F.concat(F.lit("Notes "), F.col("turn").cast("string"), F.lit("\nMore\n"), "text", F.lit("\nPage "), F.col("turn").cast("string")), "\n").alias("lines"))),
    r"WITH p AS (SELECT conv_id AS doc_id, string_split('Notes ' || turn || chr(10) || 'More' || chr(10) || text || chr(10) || 'Page ' || turn, chr(10)) AS l FROM conversations), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), e AS (SELECT doc_id, unnest(list_concat(l[1:2], l[greatest(len(l) - 1, 1):len(l)])) AS t FROM p), k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(t), '\s+', ' ', 'g'), '[0-9./:-]+', '#', 'g')) AS key FROM e), c AS (SELECT doc_id, key, count(*) AS times FROM k WHERE length(key) >= 4 AND length(key) < 70 GROUP BY 1, 2) SELECT c.* FROM c JOIN n USING (doc_id) WHERE n >= 3 AND times >= greatest(3, floor(n * 0.45))",
)
_add("d37_edit_map", lambda s, d: reading.edit_map(_probe(s, d), (F.col("doc_id") + F.col("line_no")) % 3 == 0), f"WITH {O.PROBES} SELECT doc_id, line_no AS old_line, greatest(sum(((doc_id + line_no) % 3 <> 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, 0)::INT AS new_line FROM probe")
_add("j10_fences", lambda s, d: reading.fences(_probe(s, d).withColumn("text", F.when(F.col("line_no") % 5 == 2, "```x").otherwise(F.col("text")))), f"WITH {O.PROBES} SELECT doc_id, line_no, coalesce(sum((line_no % 5 = 2)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM probe")
_add("j11_first_of_each", lambda s, d: reading.first_of_each(R.page_lines(R.table(s, d, "conversations"))), f"WITH {O.BOOK} SELECT doc_id, min(line_no) AS line_no, text FROM book GROUP BY doc_id, text")
_add("k08_natural_order", lambda s, d: _docs(s, d).select("source", reading.natural_key(F.col("source")).alias("key")).distinct(), "SELECT DISTINCT source, regexp_replace(regexp_replace(lower(source), '([0-9]+)', '0000000000\\1', 'g'), '[0-9]*([0-9]{10})', '\\1', 'g') AS key FROM documents")
_heads = "h0 AS (SELECT doc_id, line_no, " + O.heading_text("text") + " AS title, least(" + O.heading_marks("text") + ", 3) AS level FROM probe), h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS ord, line_no, level::INT AS level, title FROM h0 WHERE title IS NOT NULL AND title <> 'Outline' AND NOT " + O.page_like("title") + ")"
_add(
    "f17_outlines_align", lambda s, d: (lambda h: h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"), F.col("t").alias("u")), "doc_id").select("doc_id", ((F.col("n") == F.col("m")) & (F.size(F.array_except("t", "u")) == 0)).alias("align")))(outline.headings(_probe(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(F.lower("title")).alias("t"))),
    f"WITH {O.PROBES}, {_heads}, g AS (SELECT doc_id, count(*) AS n, list(DISTINCT lower(title)) AS t FROM h WHERE ord <= 180 GROUP BY 1) SELECT a.doc_id, a.n = b.n AND list_has_all(b.t, a.t) AS align FROM g a JOIN g b ON b.doc_id = a.doc_id + 1",
)
_add(
    "f24_page_chapter", lambda s, d: (lambda p: outline.page_starts(p).join(outline.sections(p, any_level=True).select("doc_id", "title", F.col("first").alias("f"), F.col("last").alias("l")), "doc_id").where("first between f and l").select("doc_id", "page", "title"))(_probe(s, d)),
    f"WITH {O.PROBES}, {_heads}, e AS (SELECT doc_id, max(line_no) AS e FROM probe GROUP BY 1), c AS (SELECT doc_id, title, line_no AS f, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, e) AS l FROM h JOIN e USING (doc_id) WHERE ord <= 180), p AS (SELECT doc_id, {O.page_comment('text')} AS page, min(line_no) AS first FROM probe WHERE ({O.page_comment('text')}) IS NOT NULL GROUP BY 1, 2) SELECT p.doc_id, page, title FROM p JOIN c ON c.doc_id = p.doc_id AND first BETWEEN f AND l",
)
_add("b04_sidecar", lambda s, d: outline.headings(_probe(s, d)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "level"))), lambda h: F.concat_ws("|", h.ord.cast("string"), h.level.cast("string"), h.title)), "\n").alias("outline")), f"WITH {O.PROBES}, {_heads} SELECT doc_id, string_agg(ord || '|' || level || '|' || title, chr(10) ORDER BY ord) AS outline FROM h WHERE ord <= 180 GROUP BY 1")
_add("l04_catalog_keys", lambda s, d: _docs(s, d).select(F.col("lang").alias("k")).union(_docs(s, d).select("source")).subtract(_docs(s, d).where("doc_id % 7 = 0 and doc_id < 40").select("source")), "(SELECT lang AS k FROM documents UNION SELECT source FROM documents) EXCEPT SELECT source FROM documents WHERE doc_id % 7 = 0 AND doc_id < 40")
