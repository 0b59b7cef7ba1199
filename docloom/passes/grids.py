"""Markdown tables in a text: where they stand, narrower columns, prose that they cut, plain copies of them."""

from __future__ import annotations

import html
import re

from . import lines as L
from .lines import Rewrite


def cells(line: str) -> list[str]:
    return [L.trim(c) for c in L.trim(line).removeprefix("|").removesuffix("|").split("|")]


def separator(line: str) -> bool:
    return all(re.fullmatch(r"[:\s]*-[-:\s]*", c) for c in cells(line))


def end_of(text: list[str], start: int) -> int | None:
    """The line after the table that begins at ``start``; None where no table does."""
    if start + 1 >= len(text) or "|" not in text[start] or not separator(text[start + 1]):
        return None
    return next((i for i in range(start + 2, len(text)) if "|" not in text[i] or L.trim(text[i]).startswith("#")), len(text))


def tables(text: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each table outside fences."""
    free, out, i = L.free(text), [], 0
    while i < len(text):
        end = end_of(text, i) if free[i] else None
        if end:
            out.append((i, end))
        i = end or i + 1
    return out


def compact(rows: list[list[str]]) -> list[list[str]]:
    """Rows padded alike, empty columns out; a column without a title that never stands beside the titled
    one to its right is folded into it."""
    width = max(map(len, rows))
    columns = [c for c in zip(*(r + [""] * (width - len(r)) for r in rows), strict=True) if any(c)]
    out: list[tuple[str, ...]] = []
    for right in columns:
        left = out[-1] if out else None
        if left and not left[0] and right[0] and any(left[1:]) and not any(a and b for a, b in zip(left, right, strict=True)):
            out[-1] = tuple(a or b for a, b in zip(left, right, strict=True))
        else:
            out.append(right)
    return [list(r) for r in zip(*out, strict=True)] if out else rows


def written(rows: list[list[str]]) -> list[str]:
    """The lines of a table; the first row is its header."""
    line = lambda r: "|" + "|".join(f" {c} " for c in r) + "|"
    return [line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]


def grid(text: list[str], start: int, end: int) -> list[list[str]]:
    return compact([cells(text[start]), *(cells(x) for x in text[start + 2 : end])])


def ended(line: str) -> bool:
    """Whether a line ends a sentence, a colon or nothing included."""
    t = L.trim(line).rstrip("\"”'»)]")
    return not t or t[-1] in ".!?…:"


def goes_on(line: str) -> bool:
    """Whether a line goes on with a sentence: it begins in lower case."""
    t = L.trim(line)
    return bool(t) and not t.startswith(("#", "<!--")) and "|" not in t and t.lstrip("\"“‘'([{")[:1].islower()


def lifted(text: list[str], most: int = 40) -> list[str]:
    """Prose that a table cuts in two put together above the table."""
    new = list(text)
    for start, end in reversed(tables(text)):
        above = L.last_said(new, start)
        lead = L.trim(new[above]) if above is not None else "#"
        first = L.next_said(new, end - 1)
        if lead.startswith(("#", "<!--")) or ended(lead) or first is None or not goes_on(new[first]):
            continue
        stops = lambda i: not (t := L.trim(new[i])) or t.startswith(("#", "<!--")) or end_of(new, i) is not None
        last = next((i for i in range(first, min(len(new), first + most)) if stops(i)), min(len(new), first + most))
        if last == len(new) or not stops(last):  # no break: to the first finished sentence
            done = next((i for i in range(first, last) if ended(new[i])), None)
            if done is None:
                continue
            last = done + 1
        if last > first:
            new[above + 1 : last] = new[first:last] + new[above + 1 : first]
    return new


def said(text: str) -> list[str]:
    return text.replace("’", "'").replace("‘", "'").split()


def interleaves(words: list[str], columns: list[list[str]]) -> bool:
    """Whether ``words`` are the columns' words woven together, each column in its order.

    The places reached after each word are kept as a set; over two columns, up to four and 160 words.
    """
    total = sum(map(len, columns))
    if len(words) != total or total < 12 or len(columns) < 2 or not all(columns) or (len(columns) > 2 and (len(columns) > 4 or total > 160)):
        return False
    front = {(0,) * len(columns)}
    for w in words:
        front = {at[:k] + (at[k] + 1,) + at[k + 1 :] for at in front for k, c in enumerate(columns) if at[k] < len(c) and c[at[k]] == w}
        if not front:
            return False
    return True


def plain_runs(text: list[str]) -> list[range]:
    """Runs of lines that are no table, heading, comment or blank; a fence mark begins none."""
    out, start = [], None
    for i, line in enumerate([*text, ""]):
        t = L.trim(line)
        if not t or "|" in line or t.startswith(("#", "<!--")) or (start is None and L.is_fence(t)):
            out += [range(start, i)] if start is not None else []
            start = None
        elif start is None:
            start = i
    return out


def echoes(text: list[str], found: list[tuple[int, list[list[str]]]]) -> set[int]:
    """Lines that say a table (first line, rows) again in plain text: a run that begins with its words, or
    the line above it with its header."""
    gone: set[int] = set()
    runs = plain_runs(text)
    for start, rows in found:
        if len(rows[0]) < 2 or len(rows) < 5:
            continue
        for body in (rows, rows[1:]):
            columns = [[w for r in body if k < len(r) for w in said(r[k])] for k in range(len(rows[0]))]
            total = sum(map(len, columns))
            for run in runs:
                if run[0] in gone:
                    continue
                words: list[str] = []
                for i in run:
                    words += said(text[i])
                    if len(words) >= total:
                        break
                if len(words) == total and interleaves(words, columns):
                    gone.update(range(run[0], i + 1))
        above = L.last_said(text, start)
        t, head = L.trim(text[above]) if above is not None else "", [w for c in rows[0] for w in said(c)]
        if t and "|" not in t and not t.startswith(("#", "<!--")) and len(head) >= 4 and said(t) == head:
            gone.add(above)
    return gone


def compacted(text: list[str]) -> Rewrite:
    """Tables made narrower, prose that they cut lifted, plain copies of them dropped."""
    new, found = list(text), []
    for start, end in tables(text):
        rows = grid(text, start, end)
        if len(rows) + 1 == end - start:
            new[start:end] = written(rows)
        found.append((start, rows))
    moved = lifted(new)
    if moved != new:
        new, found = moved, [(s, grid(moved, s, e)) for s, e in tables(moved)]
    gone = echoes(new, found)
    return L.each(new, lambda i, x: None if i in gone else x)


def as_html(text: list[str], start: int, end: int) -> str:
    """A table as HTML, its header in its own part."""
    row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells(line)) + "</tr>"
    return "\n".join(["<table>", "<thead>", row(text[start], "th"), "</thead>", "<tbody>", *(row(x, "td") for x in text[start + 2 : end]), "</tbody>", "</table>"])


def extracted(rows: list[list[str | None]]) -> list[str]:
    """A grid read from a page as a Markdown table; rows without words go, and fewer than two give none."""
    clean = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    if len(clean) < 2:
        return []
    width = max(map(len, clean))
    return written([r + [""] * (width - len(r)) for r in clean])


def selected(text: list[str], start: int, end: int, chosen: set[tuple[int, int]]) -> list[str]:
    """Chosen (row, column) cells of a table as a table: the header comes along with cells of the body, other cells are
    empty, and fewer than two cells give none."""
    table = grid(text, start, end)
    picked = {(r, c) for r, c in chosen if r < len(table) and c < len(table[0])}
    if len(picked) < 2:
        return []
    told = {r for r, _ in picked}
    head = max(told) > 0 and 0 not in told and any(table[0])
    shown = sorted(told | ({0} if head else set()))
    made = [[table[r][c].replace("|", "\\|").replace("\n", " ") if (r, c) in picked or (head and r == 0) else "" for c in range(len(table[0]))] for r in shown]
    return written(made)


def woven(text: list[str], pages: list[tuple[str, list[list[list[str]]]]], most: int = 220) -> list[str]:
    """Tables that a page has and the text lacks put after the line that says the page's snippet, with a mark
    of the page; pages without a snippet in the text put them at the end."""
    new, tail = list(text), []
    have = {tuple(cells(new[a])) for a, _ in tables(new)}
    for n, (snippet, found) in enumerate(pages[:most], 1):
        fresh = [t for rows in found if (t := extracted(rows)) and tuple(cells(t[0])) not in have]
        have |= {tuple(cells(t[0])) for t in fresh}
        at = next((i for i, x in enumerate(new) if snippet and snippet in x), None)
        body = [f"<!-- page {n} -->"] + [y for t in fresh for y in ("", *t, "")]
        if at is not None:
            new[at + 1 : at + 1] = body
        elif fresh:
            tail += body
    return new + tail
