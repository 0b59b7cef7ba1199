"""Runs of repeated words by harmonic grid probing.

A run is a stretch with smallest period p (words p apart are the same) of length 4 p or more, 6 at
least, that no neighbouring word extends. The texts of a batch stand one after another as word
numbers, a number of its own between two of them. For each p the words at the grid points j p and
(j + 1) p are compared: every run covers three such equal pairs in a row, so n / p probes a period,
n ln n in all, miss none. Survivors are compared word by word in growing chunks and then extended
past the grid by p words at most. Pairs inside a found run whose period divides p are passed over,
since they belong to that run.

Nulls and empty texts have no words and no runs; rows with a null id count as id "" where the id
decides; repeated rows stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import find_words, fold_of, slices

TIMES, LEAST = 4, 6


def _equal_from(x: np.ndarray, at: np.ndarray, step: int, p: int, most: int) -> np.ndarray:
    """How many places from ``at`` on, going by ``step``, equal the word p later; ``most`` at most. In chunks."""
    out, rows, done, width = np.zeros(len(at), np.int64), np.arange(len(at)), 0, 16
    while len(rows) and done < most:
        width = min(width, most - done, max(16, 2_000_000 // len(rows)))
        i = at[rows, None] + step * np.arange(done, done + width)
        same = (i >= 0) & (x[np.maximum(i, 0)] == x[i + p])
        whole = same.all(1)
        out[rows] += np.where(whole, width, same.argmin(1))
        rows, done, width = rows[whole], done + width, width * 8
    return out


def runs(codes: np.ndarray, counts: np.ndarray, *, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period.

    ``codes`` numbers the words of all texts from 0, ``counts`` says how many each has. ``times`` is 4 or more.
    """
    if times < 4:
        raise ValueError("the grid finds runs of four periods or more")
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= max(least, times)]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    sizes, begins = counts[order], (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) // times
    at = np.cumsum(sizes + 1) - (sizes + 1)
    x = -1 - np.arange(int(at[-1] + sizes[-1]) + 1 + 2 * longest, dtype=np.int64)  # no two the same, none a word
    for to, begin, n in zip(at.tolist(), begins.tolist(), sizes.tolist(), strict=True):
        x[to : to + n] = codes[begin : begin + n]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    inside: defaultdict[int, list[int]] = defaultdict(list)  # period -> periods that divide it and have long runs
    for p in range(1, longest + 1):
        k = int(np.searchsorted(-sizes, -max(least, times * p), side="right"))
        grid = x[0 : int(at[k - 1] + sizes[k - 1]) + 1 : p]
        same = grid[:-1] == grid[1:]
        base = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        for q in inside.pop(p, ()):
            if len(base):
                starts, ends = found[q]
                i = np.searchsorted(starts, base, side="right") - 1
                base = base[(i < 0) | (base + p >= ends[i])]
        if not len(base):
            continue
        base = base[_equal_from(x, base, 1, p, 2 * p) == 2 * p]
        if not len(base):
            continue
        cut = np.flatnonzero(np.diff(base) != p)
        first, last = base[np.r_[0, cut + 1]], base[np.r_[cut, len(base) - 1]] + 2 * p
        starts = first - _equal_from(x, first - 1, -1, p, p)
        ends = last + _equal_from(x, last, 1, p, p + 1) + p
        keep = ends - starts >= max(least, times * p)
        if not keep.any():
            continue
        found[p] = starts[keep], ends[keep]
        for multiple in range(2 * p, min(longest, int((ends - starts).max())) + 1, p):
            inside[multiple].append(p)
    if not found:
        return np.zeros((0, 4), np.int64)
    starts, ends = (np.concatenate([pair[i] for pair in found.values()]) for i in (0, 1))
    period = np.repeat(list(found), [len(pair[0]) for pair in found.values()])
    text = np.searchsorted(at, starts, side="right") - 1
    out = np.stack([order[text], starts - at[text], ends - starts, period], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept(runs_of_all: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each word, whether no run holds it after that run's first period."""
    begins = np.cumsum(counts) - counts
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    text, start, length, period = runs_of_all.T
    np.add.at(change, begins[text] + start + period, 1)
    np.add.at(change, begins[text] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def strongest(rows: list[list[int]]) -> list[int]:
    """(start, length, period) of the greatest length / period; ties: the smallest start, then period."""
    best = rows[0]
    for r in rows[1:]:
        a, b = r[1] * best[2], best[1] * r[2]
        if a > b or a == b and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def with_planted(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth id, by its hash, repeats words from a place on with a period, both set by the hash."""
    h = fold_of(doc_id, 1 << 32)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic(docs: DataFrame, *, planted: bool = False, with_runs: bool = False) -> DataFrame:
    """Runs of the words of every text.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): of the
    strongest run, nulls without one; digests of all runs and of the text without repeats.
    ``with_runs`` adds ``runs``, all of them, and ``collapsed``, that text. ``planted`` repeats words
    of a tenth of the texts first (see ``with_planted``).
    """
    cell = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                ids = b.column(0).to_pylist()
                words = [find_words(t) if t else [] for t in b.column(1).to_pylist()]
                if planted:
                    words = [with_planted(w, i) for w, i in zip(words, ids, strict=True)]
                numbers: defaultdict[str, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                counts = np.fromiter(map(len, words), np.int64, len(words))
                codes = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
                all_runs = runs(codes, counts)
                stay, begins = kept(all_runs, counts), np.cumsum(counts) - counts
                bounds = np.searchsorted(all_runs[:, 0], np.arange(len(ids) + 1))
                out: list[list] = [[] for _ in range(7)]
                lists, texts = [], []
                for i, w in enumerate(words):
                    mine = all_runs[bounds[i] : bounds[i + 1], 1:].tolist()
                    best = strongest(mine) if mine else [None] * 3
                    if mine:
                        w = [x for x, k in zip(w, stay[begins[i] : begins[i] + len(w)].tolist(), strict=True) if k]
                    text = " ".join(w)
                    for column, value in zip(out, [len(mine), *best, 1000 * best[1] // best[2] if mine else None, _hex("".join(f"{s},{n},{q}\n" for s, n, q in mine)), _hex(text)], strict=True):
                        column.append(value)
                    if with_runs:
                        lists.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                        texts.append(text)
                arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:5]), *(pa.array(c, pa.string()) for c in out[5:])]
                if with_runs:
                    arrays += [pa.array(lists, cell), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    if with_runs:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
