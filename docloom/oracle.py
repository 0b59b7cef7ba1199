"""DuckDB SQL twins of the shared relations and line rules, from which the oracle queries are put together."""

from __future__ import annotations

from .sources.relations import PROBE

#: Written here anew, so that a wrong constant of the rules does not pass twice.
SPACE = r"[\t \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
TRIM = f"^{SPACE}+|{SPACE}+$"
UNREADABLE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{fdd0}-\x{fdef}\x{fffc}-\x{ffff}]"
ROMAN = r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
PAGE_LIKE = r"(?i)^(?:page|página|pagina|seite|pág\.?|стр\.?|страница)\s*[0-9]+$|^第\s*[0-9]+\s*页$|^[0-9]+\s*(?:ページ|페이지)$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, r: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(r)}, {q(to)}, 'g')"


def has(x: str, r: str) -> str:
    return f"regexp_matches({x}, {q(r)})"


def ext(x: str, r: str, g: int = 1) -> str:
    return f"regexp_extract({x}, {q(r)}, {g})"


def trim(x: str) -> str:
    return sub(x, TRIM)


def heading_text(x: str) -> str:
    t = trim(sub(trim(x), "^<!--ym-tr-->"))
    return f"CASE WHEN {has(t, '^#{1,6}([^#]|$)')} THEN nullif({trim(sub(t, '^[# ]+'))}, '') END"


def heading_marks(x: str) -> str:
    return f"length({ext(trim(x), '^(#+)')})"


def atx_heading(x: str) -> str:
    t = trim(x)
    return f"nullif({trim(sub(t, '^#+'))}, '') || CASE WHEN {has(t, r'^#{1,6}[^#]') } AND {has(sub(t, '^#+'), r'^[\s\p{Z}]')} THEN '' END"


def page_heading(x: str) -> str:
    head = r"^#{1,6}\s+"
    body = ext(x, r"^#{1,6}\s+(.*)")
    return f"CASE WHEN {has(x, head)} THEN trim({sub(body, chr(92) + 's+', ' ')}) END"


def bold_line(x: str) -> str:
    t = trim(x)
    inner = f"substr({t}, 3, length({t}) - 4)"
    return f"CASE WHEN starts_with({t}, '**') AND ends_with({t}, '**') AND length({t}) > 4 AND NOT contains({inner}, '**') THEN {inner} END"


def page_comment(x: str) -> str:
    t = trim(x)
    inner = trim(f"substr({t}, 11, length({t}) - 13)")
    n = f"TRY_CAST({inner} AS INT)"
    return f"CASE WHEN starts_with({t}, '<!-- page ') AND ends_with({t}, '-->') AND {has(inner, '^[0-9]{1,9}$')} AND {n} > 0 THEN {n} END"


def contents_line(x: str) -> str:
    dots, end = r"\.{3,}", r"\s{2,}[0-9]{1,4}\s*$"
    return f"({has(x, dots)} OR (({heading_text(x)}) IS NULL AND {has(trim(x), end)}))"


def contents_entry(x: str) -> str:
    t = trim(x)
    page, title = ext(t, r"([0-9]{1,4})\s*$"), trim(sub(t, r"\.{2,}\s*[0-9]{1,4}\s*$"))
    return f"CASE WHEN {has(t, r'[.]{2,}' + chr(92) + 's*[0-9]{1,4}' + chr(92) + 's*$')} AND length({title}) > 1 THEN {title} || '|' || CAST({page} AS INT) END"


def folded(x: str) -> str:
    t = trim(sub(sub(trim(x), r"\x{a0}", " "), "^#+"))
    t = f"CASE WHEN substr({t}, 1, 2) = '[]' THEN {trim(f'substr({t}, 3)')} ELSE {t} END"
    return f"lower({sub(sub(t, '[–—−]', '-'), chr(92) + 's+', ' ')})"


def fold_line(x: str) -> str:
    return f"lower(replace({trim(x)}, '  ', ' '))"


def outline_core(x: str) -> str:
    core = sub(folded(x), r"^[0-9]+(\.[0-9]+)*\.?\s+")
    return f"coalesce(nullif({core}, ''), {folded(x)})"


def title_words(x: str) -> str:
    t = sub(sub(folded(x), r"^[0-9]+(\.[0-9]+)*\s+"), "’", "'")
    r = r"[^\p{L}\p{N}']+"
    return f"list_filter(string_split_regex({t}, {q(r)}), lambda w: w <> '')"


def roman(x: str) -> str:
    t = sub(trim(x), r"\.$")
    return f"(length({t}) BETWEEN 1 AND 7 AND {has(t, ROMAN)})"


def page_like(x: str) -> str:
    return has(f"trim({x})", PAGE_LIKE)


def numbered_heading(x: str) -> str:
    r = r"^([0-9]+(?:\.[0-9]+){1,5})\.?\s+(\p{Lu}.{2,90})$"
    n = ext(x, r, 1)
    return f"CASE WHEN {has(x, r)} THEN repeat('#', least(6, greatest(2, length({n}) - length(replace({n}, '.', '')) + 1))) || ' ' || {n} || ' ' || {ext(x, r, 2)} ELSE {x} END"


def plain_numbered_heading(x: str) -> str:
    r = r"^([0-9]+(?:\.[0-9]+){0,5})\s+(\S.{2,90})$"
    n = ext(x, r, 1)
    return f"CASE WHEN {has(x, r)} THEN repeat('#', least(6, length({n}) - length(replace({n}, '.', '')) + 1)) || ' ' || {n} || ' ' || trim({ext(x, r, 2)}) ELSE {x} END"


def numbered_callout(x: str) -> str:
    t = trim(x)
    head, rest_r = r"^[0-9]{1,2}\s", r"^[0-9]{1,2}\s(.*)$"
    rest, cap = trim(ext(t, rest_r)), r"^\p{Lu}"
    return f"CASE WHEN {has(t, head)} AND {has(rest, cap)} AND length({rest}) BETWEEN 6 AND 80 AND NOT contains({rest}, '.') THEN '**' || {t} || '**' END"


def lone_page_number(x: str) -> str:
    return has(trim(x), "^[0-9]{1,4}$")


def tracked(x: str) -> str:
    parts = f"list_filter(string_split({trim(x)}, ' '), lambda p: p <> '')"
    thin, letter = r"^[\p{L}\p{N}][^\p{L}\p{N}]*$", r"^\p{L}"
    return f"(len({parts}) >= 5 AND len(list_filter({parts}, lambda p: NOT (length(p) <= 1 OR {has('p', thin)}))) = 0 AND len(list_filter({parts}, lambda p: {has('p', letter)})) >= 5)"


def readable(x: str) -> str:
    return sub(x, UNREADABLE)


def close_gap(x: str) -> str:
    t = sub(x, " +", " ")
    w = r"[\t\n\f\r\p{Z}]"
    head = trim(sub(t, f"{w}[0-9]{{1,4}}{w}*$"))
    return f"CASE WHEN {has(t, f'{w}[0-9]{{1,4}}{w}*$')} AND {head} <> '' THEN {head} || '  ' || {ext(t, f'([0-9]{{1,4}}){w}*$')} ELSE {t} END"


def list_item(x: str) -> str:
    t = f"replace({x}, chr(9), '    ')"
    rest = f"ltrim({t}, ' ')"
    indent = f"length({t}) - length({rest})"
    counted = r"^\p{N}{1,7}\. "
    return f"CASE WHEN {has(rest, '^[-*+] ')} THEN ({indent}) || '|0|' || substr({rest}, 3) WHEN {has(rest, counted)} THEN ({indent}) || '|1|' || {sub(rest, counted)} END"


def sentences(x: str) -> str:
    cut = sub(x, r"([.!?])(\s|$)", "\\1\u0001\\2")
    edge = r"^\s+|\s+$"
    return f"list_filter(list_transform(string_split({cut}, '\u0001'), lambda s: {sub('s', edge)}), lambda s: length(s) >= 3)"


def tag_slug(x: str) -> str:
    t = sub(f"lower(trim({x}))", "^[#＃ ]+")
    return f"substr({sub(f'replace({t}, {q(chr(32))}, {q(chr(45))})', chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}-]')}, 1, 24)"


def catalog_title(x: str) -> str:
    return f"trim({sub(sub(f'lower({x})', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]'), chr(92) + 's+', ' ')})"


def valid_isbn(x: str) -> str:
    t = sub(f"upper({x})", "[^0-9X]")
    d = lambda i: f"TRY_CAST(substr({t}, {i}, 1) AS INT)"
    s13 = " + ".join(f"{d(i)} * {1 if i % 2 else 3}" for i in range(1, 13))
    s10 = " + ".join(f"{d(i)} * {11 - i}" for i in range(1, 10)) + f" + CASE WHEN substr({t}, 10, 1) = 'X' THEN 10 ELSE {d(10)} END"
    return f"CASE WHEN {has(t, '^[0-9]{13}$')} AND (10 - ({s13}) % 10) % 10 = {d(13)} THEN {t} WHEN {has(t, '^[0-9]{9}[0-9X]$')} AND ({s10}) % 11 = 0 THEN {t} END"


def publication_date(x: str) -> str:
    t = f"trim({x})"
    year = r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b"
    return f"CASE WHEN {has(t, '^[0-9]{4}$')} OR {has(t, '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')} THEN {t} ELSE nullif({ext(t, year)}, '') END"


def language_tag(x: str) -> str:
    t = f"lower(trim({x}))"
    return f"CASE WHEN {t} <> 'und' AND {has(t, '^[a-z]{2,3}(-[a-z0-9]{2,8})*$')} THEN {t} END"


def xml_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def home_scrubbed(x: str) -> str:
    return sub(x, "/Users/[^/]+", "/Users/<user>")


def footer_address(x: str) -> str:
    t = trim(x)
    body = sub(sub(f"lower({t})", "^https?://"), r"^www\.")
    return f"(length({t}) BETWEEN 8 AND 80 AND NOT {has(t, chr(92) + 's')} AND contains({t}, '.') AND contains({body}, '.') AND NOT starts_with({body}, '.') AND NOT ends_with({body}, '.') AND {has(body, '^[a-z0-9.-]+$')})"


def html_text(x: str) -> str:
    for r in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", r"<[^>]+>"):
        x = sub(x, r, " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def html_markdown(x: str) -> str:
    for r, to in (("<h1[^>]*>", "\n# "), ("<h2[^>]*>", "\n## "), ("<h3[^>]*>", "\n### "), ("</h[1-6]>", "\n"), ("<li[^>]*>", "\n- "), ("<p[^>]*>", "\n\n"), (r"<br\s*/?>", "\n")):
        x = sub(x, f"(?i){r}", to)
    x = sub(x, "<[^>]+>")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"replace({x}, {q(a)}, {q(b)})"
    edge = r"^\s+|\s+$"
    return f"coalesce(nullif({sub(sub(x, chr(10) + '{3,}', chr(10) * 2), edge)}, ''), '_Empty Word file._')"


def split_lines(source: str, key: str, text: str) -> str:
    return f"SELECT doc_id, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS text FROM (SELECT {key} AS doc_id, string_split(regexp_replace({text}, '\r\n?', '\n', 'g'), '\n') AS parts FROM {source})"


LINES = f"lines AS ({split_lines('documents', 'doc_id', 'text')})"
PROBES = f"{LINES}, probe AS (SELECT doc_id, line_no, {PROBE} AS text FROM lines)"
MARKDOWN = f"md AS ({split_lines('pages', 'page_id', html_markdown('html'))})"
BOOK = """raw AS (SELECT conv_id, turn, list_concat(['<!-- page ' || (turn + 1) || ' -->', 'Reader Notes', (turn + 1) || '.1 Opening Remarks'],
  string_split(regexp_replace(text, '\r\n?', '\n', 'g'), '\n'), ['', (turn + 1)::VARCHAR]) AS parts FROM conversations WHERE text IS NOT NULL),
 cut AS (SELECT conv_id, turn, unnest(range(len(parts))) AS k, unnest(parts) AS text FROM raw),
 book AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS line_no, text FROM cut)"""
CARDS = """cards AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, [lang, source] AS tags, CASE WHEN doc_id % 3 <> 0 THEN '/lib/' || source || '.PDF' ELSE '' END AS source_path,
  source || '.pdf' AS source_name, '/lib/' || source || CASE WHEN lang <> 'en' THEN '.' || lang ELSE '' END || '.md' AS markdown_path, doc_id AS added, doc_id * 37 % 1009 AS opened, octet_length(encode(text)) AS bytes FROM documents)"""
