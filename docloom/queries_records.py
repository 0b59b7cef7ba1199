"""Queries of catalog records, clips, jobs, joins and batches, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracle as O
from .operators import cleanup, library, outline, records
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


def _cards(s: SparkSession, d: str) -> DataFrame:
    return R.cards(_docs(s, d))


_odd = r"[:#\[\]{}&*!|>'\"%@`,]|^[-?\s]|\s$|^$"
_yq = lambda x: f"CASE WHEN {O.has(x, _odd)} THEN '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE {x} END"
_add("a23_scan_rule", lambda s, d: R.table(s, d, "conversations").groupBy("conv_id").agg((F.sum(F.regexp_count("text", F.lit(r"\p{L}"))) < F.count("*") * 40).alias("scan")), r"SELECT conv_id, sum(len(regexp_extract_all(text, '\p{L}'))) < count(*) * 40 AS scan FROM conversations GROUP BY 1")
_add("b12_opf", lambda s, d: _docs(s, d).select("doc_id", records.opf([("title", F.substring("text", 1, 30)), ("language", F.col("lang")), ("publisher", F.lit(""))]).alias("opf")), f"SELECT doc_id, concat_ws('\n', CASE WHEN substr(text, 1, 30) <> '' THEN '<dc:title>' || {O.xml_escape('substr(text, 1, 30)')} || '</dc:title>' END, '<dc:language>' || lang || '</dc:language>') AS opf FROM documents")
_add(
    "c21_chunks", lambda s, d: _docs(s, d).select("doc_id", F.posexplode(records.chunks(F.regexp_replace(F.col("text"), "\n", "\n\n"), 400)).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n")),
    """WITH RECURSIVE p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS a FROM documents),
    q AS (SELECT doc_id, list_filter(string_split_regex(array_to_string(a, chr(10) || chr(10)), '\\n{2,}'), lambda x: true) AS a FROM p),
    r AS (SELECT doc_id, a, 0 AS i, []::BIGINT[] AS done, 0::BIGINT AS buf FROM q
      UNION ALL SELECT doc_id, a, i + 1, CASE WHEN buf + 2 + length(a[i + 1]) > 400 AND buf > 0 THEN list_append(done, buf) ELSE done END,
        CASE WHEN (buf + 2 + length(a[i + 1]) > 400 AND buf > 0) OR buf = 0 THEN length(a[i + 1]) ELSE buf + 2 + length(a[i + 1]) END FROM r WHERE i < len(a)),
    f AS (SELECT doc_id, CASE WHEN buf > 0 THEN list_append(done, buf) ELSE done END AS done FROM r WHERE i = len(a))
    SELECT doc_id, unnest(range(len(done)))::INT AS pos, unnest(done)::INT AS n FROM f""",
)
_add("m13_fill_empty", lambda s, d: _cards(s, d).select("id", records.filled(F.col("source_path"), F.col("markdown_path")).alias("path")), f"WITH {O.CARDS} SELECT id, coalesce(nullif(source_path, ''), nullif(markdown_path, '')) AS path FROM cards")
_hits = "h AS (SELECT doc_id, line_no AS hit FROM probe WHERE contains(lower(text), 'tion') AND line_no % 5 = 0)"
_add(
    "h03_passages", lambda s, d: (lambda p: records.passages(p, p.where("contains(lower(text), 'tion') and line_no % 5 = 0")))(_probe(s, d)),
    f"WITH {O.PROBES}, {_hits}, n AS (SELECT h.doc_id, hit, line_no, text, {O.trim('text')} AS t FROM h JOIN probe p ON p.doc_id = h.doc_id AND p.line_no BETWEEN hit AND hit + 5), w AS (SELECT *, sum((starts_with(t, '#') AND line_no > hit)::INT) OVER o AS stops, t <> '' AND NOT starts_with(t, '<!--') AS use, sum(CASE WHEN t <> '' AND NOT starts_with(t, '<!--') THEN length(text) + 1 ELSE 0 END) OVER o AS size FROM n WINDOW o AS (PARTITION BY doc_id, hit ORDER BY line_no)), b AS (SELECT *, coalesce(lag(size) OVER (PARTITION BY doc_id, hit ORDER BY line_no), 0) - 1 AS before FROM w) SELECT doc_id, hit AS line_no, string_agg(text, '\n' ORDER BY line_no) AS passage FROM b WHERE use AND stops = 0 AND before <= 500 GROUP BY doc_id, hit",
)
_add("i12_composed_maps", lambda s, d: (lambda b: (lambda k: cleanup.composed(cleanup.line_map(b, k), cleanup.line_map(k.select("doc_id", (F.row_number().over(outline.doc()) - 1).alias("line_no"), "text"), k.select("doc_id", (F.row_number().over(outline.doc()) - 1).alias("line_no"), "text"))))(cleanup.hidden_page_numbers(b)))(R.page_lines(R.table(s, d, "conversations"))), f"WITH {O.BOOK}, k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM book WHERE NOT {O.lone_page_number('text')}) SELECT b.doc_id, b.line_no AS old_line, coalesce(min(k.pos) OVER (PARTITION BY b.doc_id ORDER BY b.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(k.pos) OVER (PARTITION BY b.doc_id), 0)::INT AS new_line FROM book b LEFT JOIN k USING (doc_id, line_no)")
_add("j06_tag_sort_key", lambda s, d: library.groups(_cards(s, d)).select("origin", "first_tag"), f"WITH {O.CARDS} SELECT CASE WHEN source_path <> '' THEN lower(source_path) ELSE lower(regexp_replace(markdown_path, '/[^/]*$', '')) || '|' || lower(regexp_replace(regexp_replace(regexp_extract(markdown_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '(?i)\\.({'|'.join(library.CODES)})(-[0-9]+)?$', '')) END AS origin, min(list_min(tags)) AS first_tag FROM cards GROUP BY 1")
_add("j12_progress", lambda s, d: records.progress(R.table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), (F.col("event_id") % 97).alias("page"), F.lit(100).alias("pages"))), "WITH t AS (SELECT user_id AS job, event_id AS at_, event_id % 97 AS page FROM events), f AS (SELECT *, first_value(at_) OVER w AS at0, first_value(page) OVER w AS page0 FROM t WINDOW w AS (PARTITION BY job ORDER BY at_, page)) SELECT job, at_ AS \"at\", page, CASE WHEN page > page0 THEN (at_ - at0) / (page - page0)::DOUBLE * (100 - page) END AS eta FROM f")
_add("j13_page_tick", lambda s, d: _docs(s, d).select("doc_id", records.page_tick(F.concat(F.lit("Reading Page "), F.col("doc_id").cast("string"), F.lit(" of 900"))).alias("tick")), "SELECT doc_id, doc_id || '|900' AS tick FROM documents")
_add("n03_fixed_batches", lambda s, d: records.fixed_batches(R.table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 5), "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5)::INT AS batch FROM conversations")
_add("o01_clips", lambda s, d: _docs(s, d).select("doc_id", records.clip(F.substring("text", 1, 50), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("clip")), r"SELECT doc_id, concat_ws(E'\n\n', CASE WHEN doc_id % 2 = 0 THEN '### ' || lang END, regexp_replace(substr(text, 1, 50), '^\s+|\s+$', '', 'g'), '*' || concat_ws(' · ', source, CASE WHEN doc_id % 3 = 0 THEN 'Page ' || doc_id END) || '*') AS clip FROM documents")
_add("o06_merged_spans", lambda s, d: (lambda e: e.union(e.where("start % 2 = 0")).distinct())(R.table(s, d, "events").select("user_id", (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 7).alias("length"))), "SELECT DISTINCT user_id, event_id % 50 AS start, event_id % 7 AS length FROM events")
_TAG = "coalesce(array_min(tags), '\uffff')"  # no tags: last
#: The library's seven sorts: key, its SQL, whether it falls; ties by id.
SORTS = {
    "manual": ("id", "id", False), "name_asc": ("lower(title)", "lower(title)", False), "name_desc": ("lower(title)", "lower(title)", True), "date_new": ("added", "added", True),
    "date_old": ("added", "added", False), "tag_asc": (_TAG, _TAG.replace("array", "list"), False), "tag_desc": (_TAG, _TAG.replace("array", "list"), True),
}
for _name, (_key, _sql, _falls) in SORTS.items():
    _add(
        f"k01_sorted_{_name}", lambda s, d, key=_key, falls=_falls: _cards(s, d).orderBy(F.expr(key).desc() if falls else F.expr(key).asc(), "id").select("id", "title"),
        f"WITH {O.CARDS} SELECT id, title FROM cards ORDER BY {_sql}{' DESC' if _falls else ''}, id",
    )
