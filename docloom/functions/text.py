"""Scalar rules on one line of text, as Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that a trim removes: tab, space and the Unicode spaces, but no line ends.
BLANK = r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
BLANKS = "\t \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Control characters, replacement characters and noncharacters that conversion leaves behind.
UNREADABLE = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{fffc}\x{fffd}\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]"
# Roman numerals, and the spellings of a page title.
ROMAN = r"^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
PAGE_LIKE = r"(?i)^((page|página|pagina|seite|pág\.?|стр\.?|страница)\s*[0-9]+|第\s*[0-9]+\s*页|[0-9]+\s*(ページ|페이지))$"
CITATION = r"^[0-9]? ?\p{L}[\p{L} ]* [0-9]{1,3}:[0-9]{1,3}([–,;: 0-9-]|\p{L}[\p{L} ]* [0-9]{1,3}:)*$"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))  # looks at the ends alone


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


# Fixed value: the mark of a translated line below its original.
MARKER = "<!--ym-tr-->"


def heading_text(line: Column) -> Column:
    """Title of a line of one to six ``#`` marks, with or without a space, a translated one too; null for other lines."""
    t = trim(line)
    t = F.when(F.startswith(t, F.lit(MARKER)), trim(F.substring(t, len(MARKER) + 1, 1 << 30))).otherwise(t)
    return F.when(F.startswith(t, F.lit("#")) & t.rlike("^#{1,6}([^#]|$)"), _or_null(trim(F.ltrim(t, F.lit("# ")))))


def heading_marks(line: Column) -> Column:
    return F.length(F.regexp_extract(trim(line), "^(#+)", 1))


def atx_heading(line: Column) -> Column:
    """Title after one to six marks and white space; null for other lines."""
    return _or_null(trim(F.regexp_extract(trim(line), r"(?s)^#{1,6}([\s\p{Z}].*)$", 1)))


def page_heading(line: Column) -> Column:
    """The title as the web page reads it: marks at the start of the line, white space as one space."""
    return F.when(line.rlike(r"^#{1,6}\s+"), F.trim(F.regexp_replace(F.regexp_extract(line, r"^#{1,6}\s+(.*)", 1), r"\s+", " ")))


def bold_line(line: Column) -> Column:
    """What stands between two pairs of stars that hold the whole line; null where a pair stands inside."""
    t = trim(line)
    inner = F.substring(t, F.lit(3), F.length(t) - 4)
    return F.when(F.startswith(t, F.lit("**")) & F.endswith(t, F.lit("**")) & (F.length(t) > 4) & ~F.contains(inner, F.lit("**")), inner)


def page_comment(line: Column) -> Column:
    """Number, from 1, of a page mark; null for other lines."""
    t = trim(line)
    n = F.when(F.startswith(t, F.lit("<!-- page ")), F.regexp_extract(t, rf"^<!-- page {BLANK}*([0-9]{{1,9}}){BLANK}*-->$", 1).try_cast("int"))
    return F.when(n > 0, n)


def contents_line(line: Column) -> Column:
    return line.rlike(r"\.{3,}") | (heading_text(line).isNull() & trim(line).rlike(r"\s{2,}[0-9]{1,4}\s*$"))


def contents_entry(line: Column) -> Column:
    """title|page of ``Title .... 13``, with two dots or more and a title of two characters; null for other lines."""
    t, r = trim(line), r"^(.*?)\.{2,}\s*([0-9]{1,4})\s*$"
    title = trim(F.regexp_extract(t, r, 1))
    return F.when(t.rlike(r) & (F.length(title) > 1), F.concat_ws("|", title, F.regexp_extract(t, r, 2).cast("int").cast("string")))


def folded(c: Column) -> Column:
    """Title for comparison: no marks, no empty box, plain dashes, single spaces, lower case."""
    t = trim(F.ltrim(trim(F.replace(c, F.lit("\xa0"), F.lit(" "))), F.lit("#")))
    for dash in "–—−":
        t = F.replace(t, F.lit(dash), F.lit("-"))
    # each step uses the one before once, so that nothing is computed twice
    return F.lower(F.regexp_replace(trim(F.regexp_replace(t, r"^\[\]", "")), r"\s\s+|[\t\n\x0b\f\r]", " "))


def upper_letters(c: Column) -> Column:
    """Upper case a letter at a time, so that the length stays: the sharp s has its own capital."""
    one = lambda x: F.when(x == "ß", "ẞ").when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(c, ""), one), "")


def fold_line(c: Column) -> Column:
    """Trimmed, double spaces made single once, lower case."""
    return F.lower(F.replace(trim(c), F.lit("  "), F.lit(" ")))


def outline_core(c: Column) -> Column:
    core = F.regexp_replace(folded(c), r"^[0-9]+(\.[0-9]+)*\.?\s+", "")
    return F.when(core == "", folded(c)).otherwise(core)


def title_words(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(folded(c), r"^[0-9]+(\.[0-9]+)*\s+", ""), "’", "'")
    return F.filter(F.split(t, r"[^\p{L}\p{N}']+"), lambda w: w != "")


def roman(c: Column) -> Column:
    t = F.regexp_replace(trim(c), r"\.$", "")
    return F.length(t).between(1, 7) & t.rlike(ROMAN)


def page_like(c: Column) -> Column:
    return F.trim(c).rlike(PAGE_LIKE)


def numbered_heading(line: Column) -> Column:
    """``8.1 Title`` as a heading with a mark more than it has dots, two to six; else the line."""
    r = r"^([0-9]+(?:\.[0-9]+){1,5})\.?\s+(\p{Lu}.{2,90})$"
    number = F.regexp_extract(line, r, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    made = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(2), dots + 1))), F.lit(" "), number, F.lit(" "), F.regexp_extract(line, r, 2))
    return F.when(line.rlike(r), made).otherwise(line)


def plain_numbered_heading(line: Column) -> Column:
    """As above with a mark for each number, plain numbers too."""
    r = r"^([0-9]+(?:\.[0-9]+){0,5})\s+(\S.{2,90})$"
    number = F.regexp_extract(line, r, 1)
    depth = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    return F.when(line.rlike(r), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), number, F.lit(" "), F.trim(F.regexp_extract(line, r, 2)))).otherwise(line)


def numbered_callout(line: Column) -> Column:
    """``1 Engine Fire Switches`` in bold; null for other lines."""
    t = trim(line)
    rest = trim(F.regexp_extract(t, r"^[0-9]{1,2}\s(.*)$", 1))
    ok = t.rlike(r"^[0-9]{1,2}\s") & rest.rlike(r"^\p{Lu}") & F.length(rest).between(6, 80) & ~F.contains(rest, F.lit("."))
    return F.when(ok, F.concat(F.lit("**"), t, F.lit("**")))


def lone_page_number(line: Column) -> Column:
    return trim(line).rlike("^[0-9]{1,4}$")


def tracked(line: Column) -> Column:
    """Five letters or more set apart by spaces, and nothing longer."""
    parts = F.filter(F.split(trim(line), " "), lambda p: p != "")
    thin = F.forall(parts, lambda p: (F.length(p) <= 1) | p.rlike(r"^[\p{L}\p{N}][^\p{L}\p{N}]*$"))
    return (F.size(parts) >= 5) & thin & (F.size(F.filter(parts, lambda p: p.rlike(r"^\p{L}"))) >= 5)


def readable(c: Column) -> Column:
    return F.regexp_replace(c, UNREADABLE, "")


def close_gap(c: Column) -> Column:
    """Single spaces, but two before a number of up to four digits that ends a line of something else."""
    t = F.regexp_replace(c, " {2,}", " ")
    r = r"(?s)^(.*?)[\t\n\f\r\p{Z}]([0-9]{1,4})[\t\n\f\r\p{Z}]*$"
    head = trim(F.regexp_extract(t, r, 1))
    return F.when(t.rlike(r) & (head != ""), F.concat(head, F.lit("  "), F.regexp_extract(t, r, 2))).otherwise(t)


def list_item(line: Column) -> Column:
    """indent|ordered|text of a list line, tabs as four spaces; null for other lines."""
    t = F.replace(line, F.lit("\t"), F.lit("    "))
    plain, counted = r"(?s)^ *[-*+] (.*)$", r"(?s)^ *\p{N}{1,7}\. (.*)$"
    indent = F.length(F.regexp_extract(t, "^( *)", 1)).cast("string")
    return F.when(t.rlike(plain), F.concat_ws("|", indent, F.lit("0"), F.regexp_extract(t, plain, 1))).when(t.rlike(counted), F.concat_ws("|", indent, F.lit("1"), F.regexp_extract(t, counted, 1)))


def sentences(c: Column) -> Column:
    """Pieces up to ``.``, ``!`` or ``?`` before white space or the end; three characters at least."""
    cut = F.split(F.regexp_replace(c, r"([.!?])(\s|$)", "$1\u0001$2"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= 3)


def tag_slug(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"^[#＃ ]+", "")
    return F.substring(F.regexp_replace(F.replace(t, F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", ""), 1, 24)


def catalog_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def valid_isbn(c: Column) -> Column:
    """Digits of a right ISBN-10 or ISBN-13; null otherwise."""
    t = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    at = lambda i: F.substring(t, i, 1)
    num = lambda i: at(i).try_cast("int")
    sum13 = sum((num(i) * (1 if i % 2 else 3) for i in range(2, 13)), num(1))
    ok13 = t.rlike("^[0-9]{13}$") & ((10 - sum13 % 10) % 10 == num(13))
    last = F.when(at(10) == "X", F.lit(10)).otherwise(F.regexp_extract(at(10), "([0-9])", 1).try_cast("int"))
    sum10 = sum((num(i) * (11 - i) for i in range(2, 10)), num(1) * 10) + last
    ok10 = t.rlike("^[0-9]{9}[0-9X]$") & (sum10 % 11 == 0)
    return F.when(F.coalesce(F.when(t.rlike("^[0-9]{13}$"), ok13), F.when(t.rlike("^[0-9]{9}[0-9X]$"), ok10), F.lit(False)), t)


def publication_date(c: Column) -> Column:
    t = F.trim(c)
    day = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
    return F.when(t.rlike("^[0-9]{4}$") | t.rlike(day), t).otherwise(_or_null(F.regexp_extract(t, r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b", 1)))


def language_tag(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when((t != "und") & t.rlike("^[a-z]{2,3}(-[a-z0-9]{2,8})*$"), t)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def home_scrubbed(c: Column) -> Column:
    """Names of users' folders left out."""
    return F.regexp_replace(c, "/Users/[^/]+", "/Users/<user>")


def footer_address(c: Column) -> Column:
    """A line that is a web address and nothing else."""
    t = trim(c)
    body = F.regexp_replace(F.regexp_replace(F.lower(t), "^https?://", ""), r"^www\.", "")
    return F.length(t).between(8, 80) & F.contains(t, F.lit(".")) & body.rlike(r"^[a-z0-9-][a-z0-9.-]*[a-z0-9-]$") & F.contains(body, F.lit("."))


def plain_line(c: Column) -> Column:
    """A line without heading marks and the stars round all of it."""
    t = trim(c)
    t = F.when(t.rlike("^#{1,6} "), trim(F.regexp_replace(t, "^#{1,6} ", ""))).otherwise(t)
    return F.when(F.startswith(t, F.lit("**")) & F.endswith(t, F.lit("**")) & (F.length(t) > 4), trim(F.substring(t, F.lit(3), F.length(t) - 4))).otherwise(t)


def without_comments(c: Column) -> Column:
    """Comments left out; one that is not closed goes to the end."""
    return F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", "")
