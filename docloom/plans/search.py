"""The boolean search language: words and phrases with AND, OR, NOT and parentheses.

A query compiles to one boolean Column, so a search is a filter that Spark fuses with the scan. Words
next to each other are all asked for; AND, OR and NOT count only in capitals; ``-word`` is NOT. What
does not parse to the end is one literal term. Terms match without regard to case or accents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, trim

_TOKEN = re.compile(r'"([^"]*)(?:"|$)|([()])|([^\s()"]+)')


@dataclass(frozen=True)
class Node:
    """``kind``: term, and, or, not."""

    kind: str
    text: str = ""
    parts: tuple[Node, ...] = ()


def _tokens(query: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for phrase, mark, word in _TOKEN.findall(query):
        if mark:
            out.append((mark, mark))
        elif word in ("AND", "OR", "NOT"):
            out.append((word, word))
        elif word.startswith("-") and len(word) > 1:
            out += [("NOT", "-"), ("term", word[1:])]
        elif word:
            out.append(("term", word))
        elif phrase.strip():
            out.append(("term", phrase))
    return out


def parse(query: str) -> Node | None:
    """OR binds least, then AND (also unwritten), then NOT; blank queries are None."""
    if not query.strip():
        return None
    tokens, at = _tokens(query), 0
    peek = lambda: tokens[at][0] if at < len(tokens) else ""

    def joined(kind: str, parts: list[Node]) -> Node:
        return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))

    def any_of() -> Node | None:
        nonlocal at
        parts = [first] if (first := all_of()) else []
        while parts and peek() == "OR":
            at += 1
            if (more := all_of()) is None:
                break
            parts.append(more)
        return joined("or", parts) if parts else None

    def all_of() -> Node | None:
        nonlocal at
        parts = [first] if (first := one()) else []
        while parts and peek() in ("AND", "NOT", "term", "("):
            at += peek() == "AND"
            if (more := one()) is None:
                break
            parts.append(more)
        return joined("and", parts) if parts else None

    def one() -> Node | None:
        nonlocal at
        if peek() == "NOT":
            at += 1
            inner = one()
            return Node("not", parts=(inner,)) if inner else None
        if peek() == "(":
            at += 1
            inner = any_of()
            at += peek() == ")"
            return inner
        if peek() == "term":
            at += 1
            return Node("term", tokens[at - 1][1])
        return None

    found = any_of()
    return found if found and at == len(tokens) else Node("term", query.strip())


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents, and the letters under them."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xE0, 0x180) if chr(i).islower()]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def bare(term: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(x))


def _collated(c: Column, term: str) -> Column:
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))


def in_folded(c: Column, term: str) -> Column:
    return F.contains(c, F.lit(bare(term)))


def contains(c: Column, term: str) -> Column:
    """Case and accents do not count. ASCII texts are searched in lower case, others by collation, which is far slower."""
    if not bare(term).isascii():
        return _collated(c, term)
    return F.when(F.octet_length(c) == F.length(c), in_folded(F.lower(c), term)).otherwise(_collated(c, term))


def folded(c: Column) -> Column:
    """Lower case, Latin letters without their accents."""
    low = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    for one, two in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        low = F.replace(low, F.lit(one), F.lit(two))
    return low


def comparable(c: Column, terms: list[str]) -> Column:
    """A text in lower case without accents, in which ``terms`` stand where the collation finds them in ``c``, if it
    is ASCII; only a text that keeps other letters needs the collation. A ligature stands for letters of its own,
    of which no part is found: it is a mark, unless a term has one of them."""
    used = set("".join(map(bare, terms)))
    marks = "".join(x for x, letters in (("ß", "s"), ("œ", "oe"), ("æ", "ae")) if not used & {*letters, "_"})
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(F.lower(c), _ACCENTED + marks, _PLAIN + "_" * len(marks)))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def possible(node: Node, c: Column, has: Callable[[Column, str], Column]) -> Column:
    """What a text has in which ``node`` holds, or holds in a part: ``node`` without all that is under NOT."""
    if node.kind == "term":
        return has(c, node.text)
    out = F.lit(node.kind != "or")
    for p in node.parts if node.kind != "not" else ():
        out = out | possible(p, c, has) if node.kind == "or" else out & possible(p, c, has)
    return out


def required(node: Node) -> list[str]:
    """Terms without which nothing matches."""
    if node.kind == "term":
        return [node.text]
    return [t for p in node.parts for t in required(p)] if node.kind == "and" else []


def compiled(node: Node, c: Column, has: Callable[[Column, str], Column] = contains) -> Column:
    if node.kind == "term":
        return has(c, node.text)
    parts = [compiled(p, c, has) for p in node.parts]
    if node.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if node.kind == "or" else out & p
    return out


def highlights(node: Node | None, under_not: bool = False) -> list[str]:
    """Terms that are asked for, not those under NOT."""
    if node is None:
        return []
    if node.kind == "term":
        return [] if under_not else [node.text]
    return [t for p in node.parts for t in highlights(p, under_not != (node.kind == "not"))]


def has_operators(query: str) -> bool:
    """Whether a query holds AND, OR or NOT in capitals, or a word with a minus."""
    return any(kind in ("AND", "OR", "NOT") for kind, _ in _tokens(query))


def is_boolean(node: Node | None) -> bool:
    return node is not None and node.kind != "term"


def paragraphs(c: Column) -> Column:
    """Runs of lines between blank lines, headings and comments, each joined by spaces."""
    marked = F.transform(F.split(c, "\n"), lambda t: F.when(trim(t).rlike("^($|#|<!--)"), "\u0001").otherwise(trim(t)))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), "\u0001"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def matching(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that match: a lone term anywhere, anything else within one paragraph or one sentence."""
    node = parse(query)
    if node is None:
        return docs
    c = F.col(text)
    if not is_boolean(node):
        return docs.where(compiled(node, c))
    def test(x: Column, has: Callable[[Column, str], Column]) -> Column:
        # without a NOT a sentence has nothing that its paragraph lacks
        whole = lambda p: compiled(node, p, has)
        either = lambda p: whole(p) | F.exists(sentences(p), whole)
        found = F.exists(paragraphs(x), either if negates(node) else whole)
        for term in required(node):  # asked of whole texts first
            found = has(x, term) & found
        return found

    if not all(bare(t).isascii() for t in terms(node)):
        return docs.where(test(c, _collated))
    # a text is folded once; one that has other letters is left to collation
    told = docs.withColumn("__folded", folded(c))
    plain = F.octet_length("__folded") == F.length("__folded")
    return told.where(F.when(plain, test(F.col("__folded"), in_folded)).otherwise(test(c, _collated))).drop("__folded")


def terms(node: Node) -> list[str]:
    return [node.text] if node.kind == "term" else [t for p in node.parts for t in terms(p)]


def negates(node: Node) -> bool:
    return node.kind == "not" or any(map(negates, node.parts))


def holds_by_word(c: Column, query: str) -> Column:
    """The plain form: words one after another with no precedence, AND or OR holding until changed;
    any of the capitals asks for one sentence, else the whole query is looked for as it stands."""
    q = query.strip()
    if not re.search(r"\b(AND|OR|NOT)\b", q):
        return F.contains(F.lower(c), F.lit(q.lower()))

    def holds(sentence: Column) -> Column:
        low, mode, negate, out = F.lower(sentence), "AND", False, None
        for raw in q.split():
            if raw in ("AND", "OR"):
                mode = raw
            elif raw == "NOT":
                negate = True
            elif word := re.sub(r"^[\"']|[\"']$", "", raw).lower():
                bit = F.contains(low, F.lit(word))
                bit, negate = (~bit if negate else bit), False
                out = bit if out is None else out | bit if mode == "OR" else out & bit
        return F.lit(False) if out is None else out

    return F.exists(F.split(F.regexp_replace(c, r"([.?!])\s+|\n+", "$1\u0001"), "\u0001"), holds)


def matching_by_word(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold a query in its plain form; a blank one has all."""
    return docs.where(holds_by_word(F.col(text), query)) if query.strip() else docs
