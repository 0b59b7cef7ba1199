"""Token counts by rank-synchronous merging of ragged numpy arrays.

A byte-level tokenizer cuts a text into pre-tokens and merges the pairs of each by rank. Here the
pre-tokens of a batch stand one after another in a single array of symbols. Each round finds the
lowest rank among the pairs of every sequence, merges that pair in all sequences at once, and drops
the sequences that have no pair left; what remains of a sequence then is its count. Texts are cut at
places that no pre-token crosses, so that a piece met before is looked up.

Nulls and empty texts have no tokens; the strings of added tokens count as one each, as in the
library; repeated rows stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Coder, slices, sums_by_text
from .token_corpus import _WS, pieces

#: The byte-level pre-tokenizer's expression; a fixed value. L, N and O stand for letters, numbers and the rest.
PRE_TOKEN = "'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!\\S)|S+"
LIMIT = 512
_NONE = np.int32(2**31 - 1)


def _ranges(points: list[int]) -> str:
    """A regular expression's class members for ascending code points."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def _cutter() -> regex.Pattern:
    """The pre-tokenizer's expression with the letters and numbers that the tokenizers library knows.

    Libraries follow different versions of Unicode, so each letter and number of this one is tried there.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
    classes = {}
    for name, before in (("L", "a"), ("N", "1")):
        met = regex.findall(rf"\p{{{name}}}", every)
        begins = {at for _, (at, _) in ByteLevel(add_prefix_space=False).pre_tokenize_str("\n".join(before + c for c in met))}
        classes[name] = _ranges([ord(c) for i, c in enumerate(met) if 3 * i + 1 not in begins])
    letter, number = "A-Za-z" + classes["L"], "0-9" + classes["N"]
    parts = {"L": f"[{letter}]", "N": f"[{number}]", "O": f"[^{_WS}{letter}{number}]", "\\S": f"[^{_WS}]", "S": f"[{_WS}]"}
    return regex.compile(re.sub(r"\\?[LNOS]", lambda m: parts[m[0]], PRE_TOKEN))


class Merges:
    """The ranks of a byte-level BPE file (``tokenizers`` JSON) as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        added = told.get("added_tokens", [])
        if model.get("type") != "BPE" or not plain or told.get("normalizer") or odd or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(pieces(t["content"]) != [t["content"]] for t in added):
            raise ValueError(f"{path}: an added token may cross pieces")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.cut = _cutter().findall
        vocab = model["vocab"]
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.lexsort((np.arange(len(keys)), keys))
        self.keys, self.ranks = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), _NONE)
        # A rank of which a product is part of a lower rank is applied to one place a round, the leftmost.
        lowest = np.full(self.width, _NONE, np.int64)
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        self.single = np.append(lowest[self.product] < np.arange(len(pairs)), False)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def survivors(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; ``data`` holds the bytes of all, ``sizes`` (over 0) their lengths."""
        out = np.ones(len(sizes), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = self.symbol[data]
        ranks = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(ranks, starts)
            done = best == _NONE
            if done.any():
                out[owner[starts[done]]] = lengths[done]
                stay = np.repeat(~done, lengths)
                owner, symbols, ranks = owner[stay], symbols[stay], ranks[stay]
                best, lengths = best[~done], lengths[~done]
                if not len(owner):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, lengths))
            # of pairs that overlap (one symbol repeated) every other one is merged, from the left
            fresh = np.r_[True, np.diff(hits) != 1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            rank = ranks[hits]
            if self.single[rank].any():
                first = np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]
                hits = hits[first | ~self.single[rank]]
                rank = ranks[hits]
            symbols[hits] = self.product[rank]
            stay = np.ones(len(owner), bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            owner, symbols, ranks = owner[stay], symbols[stay], ranks[stay]
            at = place[hits]
            at = np.concatenate([at, at[at > 0] - 1])
            last = at + 1 >= len(owner)
            ranks[at[last]] = _NONE
            at = at[~last]
            inside = owner[at] == owner[at + 1]
            ranks[at[~inside]] = _NONE
            at = at[inside]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, cut into pre-tokens; a pre-token met twice is merged once."""
        out = np.zeros(len(texts), np.int64)
        known: dict[str, int] = {}
        number = known.setdefault
        found, totals = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.added and self.added.search(text):
                parts = self.added.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                tokens = self.cut(part)
                totals[i] += len(tokens)
                found += [number(t, len(known)) for t in tokens]
        if known:
            cells = [t.encode() for t in known]
            left = self.survivors(np.frombuffer(b"".join(cells), np.uint8), np.fromiter(map(len, cells), np.int64, len(cells)))
            out += sums_by_text(left[np.array(found)], totals).astype(np.int64)
        return out


def _as_is(text: str) -> str:
    return text


@lru_cache(maxsize=1)
def _counter(path: str) -> Coder:
    """One a worker: pieces met in one task are known in the next."""
    merges = Merges(path)
    return Coder(lambda found: (merges.counts(found),), lower=_as_is, limit=400_000, words=pieces)


def counted(docs: DataFrame, vocabulary: str, *, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, by the byte-level BPE file ``vocabulary``.

    ``n_bytes`` is the UTF-8 length; ``over_limit`` says whether there are over ``limit`` tokens.
    """
    frame = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _counter(vocabulary)
        for whole in batches:
            for b in slices(whole, 2):
                codes, sizes, columns = coder.encode(b.column(2).to_pylist())
                tokens = sums_by_text(columns[0][codes], sizes).astype(np.int64) if len(codes) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return frame.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
