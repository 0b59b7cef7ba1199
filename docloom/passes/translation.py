"""Texts as blocks to translate, requests of bounded size, and the translated text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import lines as L
from .lines import MARKER

_heading = re.compile(r"(#{1,6})\s(.*)", re.S).fullmatch


@dataclass(frozen=True)
class Block:
    """``text`` blocks are translated, others kept; ``raw`` is ``prefix`` and ``body``."""

    text: bool
    raw: str
    prefix: str = ""
    body: str = ""


def kept_line(line: str) -> bool:
    """Comments, pictures, tables and rules are not translated."""
    t = L.trim(line)
    return t.startswith((*L.NOT_PROSE, "---", "***")) or "](figures/" in t or "](./figures/" in t


def _block(raw: str) -> Block:
    m = _heading(L.trim(raw))
    return Block(True, raw, m[1] + " ", L.trim(m[2])) if m else Block(True, raw, "", raw)


def blocks(text: str) -> list[Block]:
    """Headings, paragraphs, kept lines and blank lines of a text, in order."""
    out: list[Block] = []
    para: list[str] = []
    for line in [*text.split("\n"), None]:
        own = line is None or not L.trim(line) or kept_line(line) or _heading(L.trim(line))
        if own and para:
            out.append(_block("\n".join(para)))
            para = []
        if line is None:
            break
        if not L.trim(line):
            out.append(Block(False, ""))
        elif kept_line(line):
            out.append(Block(False, line, "", line))
        elif own:
            out.append(_block(line))
        else:
            para.append(line)
    return out


def rendered(parts: list[Block], translations: list[str], *, below: bool = True) -> list[str]:
    """The text with its translations in place of the originals, or marked below them."""
    out: list[str] = []
    left = iter(translations)
    for b in parts:
        if not b.text:
            out += [b.raw] if b.raw or (not out or out[-1]) else []
            continue
        new = (b.prefix + next(left, b.body).strip()).split("\n")
        out += [b.raw, "", *(MARKER + x for x in new)] if below else new
    while out and not out[-1]:
        out.pop()
    return out


def batches(texts: list[str], most: int = 32, chars: int = 4500) -> list[list[str]]:
    """Requests of ``most`` texts and under ``chars`` characters; a longer text goes alone."""
    out: list[list[str]] = []
    size = 0
    for t in texts:
        if not out or len(out[-1]) >= most or size + len(t) >= chars:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


_link = re.compile(r"!?\[[^\]]*\]\([^)]+\)")


def protected(text: str) -> tuple[str, list[str]]:
    """Links and pictures as numbered places, and what they were."""
    links: list[str] = []
    return _link.sub(lambda m: f"[[{links.append(m[0]) or len(links) - 1}]]", text), links


def restored(text: str, links: list[str]) -> str:
    return re.sub(r"\[\[\s*(\d+)\s*\]\]", lambda m: links[int(m[1])] if int(m[1]) < len(links) else m[0], text)
