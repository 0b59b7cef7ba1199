"""Bags of hashed character n-grams, averaged into a linear softmax and trained in numpy.

The model of both the toxicity and the language operator. A word is its lower-cased text between
``<`` and ``>``; its features are its hashed character n-grams and the whole word. A
text's vector is the mean over its words of the mean of their feature embeddings; class scores are
a linear map of that vector. A run of over 65,536 characters counts as several words of that length. Embeddings and map are trained jointly by stochastic gradient descent
(Adagrad steps). As scores are linear in the words, a trained model collapses to one row of class
scores for each feature, so that scoring is a table look-up for each distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Coder, runs_of, slices, sums_by_text

find_words = re.compile("[^\x20\x09-\x0d]{1,65536}").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lower(text: str) -> str:
    return text.lower()


def features(words: list[str], buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature id) of every n-gram of ``words``; vectorised over all of them."""
    flat = np.frombuffer(("<" + ">\x20<".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = flat == 32
    owner = np.cumsum(gap)
    flat = flat + np.uint64(1)
    owners, ids = [], []
    h = flat.copy()
    with np.errstate(over="ignore"):
        for n in range(2, max(grams) + 1):
            h = h[:-1] * _MIX + flat[n - 1 :] if len(h) > 1 else h[:0]
            if n not in grams or not len(h):
                continue
            first = owner[: len(h)]
            keep = (first == owner[n - 1 :]) & ~gap[: len(h)]
            x = h[keep] ^ np.uint64(n)
            owners.append(first[keep])
            ids.append(((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(40))
        # the whole word, by a position-weighted sum
        starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
        place = np.arange(len(flat)) - starts[owner]
        weights = _MIX * (2 * place.astype(np.uint64) + np.uint64(1))
        mixed = flat * weights
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        mixed[gap] = 0
        whole = np.add.reduceat(mixed, starts)
        owners.append(np.arange(len(words)))
        ids.append((whole ^ (whole >> np.uint64(33))) * _MIX >> np.uint64(40))
    return np.concatenate(owners).astype(np.int64), (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """``table``: class scores of each feature; ``bias``: of each class; ``scale``: inverse temperature."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    grams: tuple[int, ...]
    scale: float = 1.0

    def coder(self) -> Coder:
        def word_scores(words: list[str]) -> tuple[np.ndarray, ...]:
            owner, ids = features(words, len(self.table), self.grams)
            n = np.bincount(owner, minlength=len(words))
            return (np.stack([np.bincount(owner, self.table[ids, c], len(words)) / n for c in range(self.table.shape[1])], 1),)

        return Coder(word_scores, lower, words=find_words)

    def probabilities(self, coder: Coder, texts: list[str | None]) -> np.ndarray:
        """A row of class probabilities for each text; a text without words has the bias alone."""
        codes, counts, columns = coder.encode(texts)
        sums = sums_by_text(columns[0][codes], counts) if columns else np.zeros((len(texts), len(self.bias)))
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) * self.scale
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(1, keepdims=True)


class Bags:
    """Feature ids and their shares summed over the words of many texts; a feature's weight is its share
    by the text's ``words``.

    Texts are held in blocks of some hundred, one after another, so that memory goes back to the
    system when training is done. ``at`` has a row for each text: its block, start and end.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.at, self.words = np.zeros((0, 3), np.int64), np.zeros(0, np.float32)

    def add(self, texts: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        ends = np.cumsum([len(x[0]) for x in texts])
        at = np.stack([np.full(len(ends), len(self.blocks)), np.append(0, ends[:-1]), ends], 1)
        self.blocks.append((np.concatenate([x[0] for x in texts]), np.concatenate([x[1] for x in texts])))
        self.at, self.words = np.concatenate([self.at, at]), np.append(self.words, np.array([x[2] for x in texts], np.float32))

    def ordered(self, order: np.ndarray) -> None:
        self.at, self.words = self.at[order], self.words[order]

    def common(self, buckets: int, least: float) -> np.ndarray:
        """Which features stand in ``least`` texts or more; the weights of the others become zero."""
        n = np.zeros(buckets, np.int64)
        for ids, _ in self.blocks:
            n += np.bincount(ids, minlength=buckets)
        for ids, shares in self.blocks:
            shares[n[ids] < least] = 0
        return n >= least

    def weighted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, weights, number of features) of some texts, one after another."""
        spans = [(self.blocks[k], slice(s, e)) for k, s, e in self.at[rows].tolist()]
        sizes = self.at[rows, 2] - self.at[rows, 1]
        weights = np.concatenate([x[1][y] for x, y in spans]).astype(np.float32) / np.repeat(self.words[rows], sizes)
        return np.concatenate([x[0][y] for x, y in spans]), weights, sizes


def bag(text: str | None, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    words = find_words(lower(text or ""))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    ids, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
    for run in runs_of(list(seen)):
        owner, own = features(run, buckets, grams)
        times = np.array([seen[w] for w in run], np.float64)
        ids.append(own)
        shares.append((times / np.bincount(owner, minlength=len(run)))[owner])
    found, at = np.unique(np.concatenate(ids), return_inverse=True)
    return found.astype(np.int32), np.bincount(at, np.concatenate(shares), len(found)).astype(np.float16), max(1, len(words))


def bags_of(rows: DataFrame, most: int, buckets: int, grams: tuple[int, ...]) -> tuple[Bags, list]:
    """Bags and labels of ``rows`` (doc_id, text, label), in the order of ids: at most ``most`` rows.

    Bags are made where the texts are; what reaches the driver is 6 bytes for each of a text's
    features, ``buckets`` at most, a partition of 250 texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                made = [bag(t, buckets, grams) for t in b.column(1).to_pylist()]
                columns = [pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([x[2] for x in made], pa.int64()), b.column(2)], names=["doc_id", "ids", "shares", "words", "label"])

    schema = rows.select("doc_id", F.lit(b"").alias("ids"), F.lit(b"").alias("shares"), F.lit(0).cast("long").alias("words"), "label").schema
    made = rows.select("doc_id", "text", "label").repartition(max(1, most // 250)).mapInArrow(run, schema)
    out, held, keys = Bags(), [], []
    for r in made.toLocalIterator():
        held.append((np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float16), r.words))
        keys.append((r.doc_id, r.label))
        if len(held) == 250:
            out.add(held)
            held = []
    if held:
        out.add(held)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out.ordered(np.array(order, np.int64))
    return out, [keys[i][1] for i in order]


def train(data: Bags, labels: list, *, buckets: int, grams: tuple[int, ...] = (3, 4, 5), dim: int = 8, epochs: int = 8, rate: float = 0.5, batch: int = 64, seed: int = 7, rare: float = 0.0) -> Model:
    """Fit embeddings and softmax jointly; a tenth of the rows sets the temperature.

    Features that stand in less than a share ``rare`` of the rows are not learned, but count in the
    mean. No rows, or one class only: the model always answers the one class (or 0) with its share.
    """
    classes = sorted(set(labels))
    if len(classes) < 2:
        classes = classes or [0]
        return Model(classes, np.zeros((buckets, len(classes)), np.float32), np.zeros(len(classes)), grams)
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(v) for v in labels])
    common = data.common(buckets, rare * len(y))
    order = rng.permutation(len(y))
    held = order[: max(1, len(y) // 10)] if len(y) >= 200 else order
    fit = order[len(held) :] if len(y) >= 200 else order
    C = len(classes)
    E = (rng.normal(0, 0.1, (buckets, dim)) * common[:, None]).astype(np.float32)
    W = rng.normal(0, 0.3, (dim, C)).astype(np.float32)
    b = np.zeros(C, np.float32)
    ge, gw, gb = np.full(E.shape, 1e-6, np.float32), np.full(W.shape, 1e-6, np.float32), np.full(C, 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            rows = rows[data.at[rows, 2] > data.at[rows, 1]]
            if not len(rows):
                continue
            ids, weight, sizes = data.weighted(rows)
            weight = weight[:, None]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vector = np.add.reduceat(E[ids] * weight, starts)
            z = vector @ W + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p = p.astype(np.float32)
            dw, db = vector.T @ p, p.sum(0)
            each = np.repeat(p @ W.T, sizes, 0) * weight
            touched, back = np.unique(ids, return_inverse=True)
            de = np.stack([np.bincount(back, each[:, k], len(touched)) for k in range(dim)], 1).astype(np.float32)
            ge[touched] += de * de
            E[touched] -= step * de / np.sqrt(ge[touched])
            gw += dw * dw
            gb += db * db
            W -= step * 0.3 * dw / np.sqrt(gw)
            b -= step * 0.3 * db / np.sqrt(gb)
    model = Model(classes, E @ W, b.astype(np.float64), grams)
    logits = np.stack([(lambda ids, w, _: w @ model.table[ids] + b)(*data.weighted(held[k : k + 1])) for k in range(len(held))]).astype(np.float64)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 4, 40):
        z = logits * t
        z -= z.max(1, keepdims=True)
        nll = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), y[held]]).mean())
        best = min(best, (nll, float(t)))
    model.scale = best[1]
    return model
