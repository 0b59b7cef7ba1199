"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts of all training tokens are gathered by 64-bit word key (collisions: about V^2 / 2^65 pairs).
The ``shortlist`` most frequent words are classes of their own; every other word falls in one of
``tails`` classes by its ending, and within a class it has the add-one share of its count (with one
place for all unknown words). The log-bilinear model gives the class of a token from the class before
it: score(class, before) = q_class . C r_before + b_class. It is trained on the class pairs of the
whole training corpus, whose counts are gathered too, so the statistics grow with the corpus while
the model stays bounded. Scores are normalised exactly: one matrix product gives the log-probability
of every class after every other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Coder, fold, fold_of, slices, written

FOLDS, HELD = 7, 2
END = "\n"  # no word holds white space
SHORTLIST, TAILS, DIM, HEAD = 1000, 128, 32, 200_000


def key_of(word: str) -> int:
    k = xxhash.xxh64_intdigest(word, 42)
    return k - (1 << 64) if k >> 63 else k


def tail_of(word: str) -> int:
    """Class of a word that is not in the shortlist: by its last two characters."""
    return xxhash.xxh32_intdigest(word[-2:]) % TAILS


END_KEY = key_of(END)


def _class_coder(short: dict[int, int]) -> Coder:
    def classes(words: list[str]) -> tuple[np.ndarray, ...]:
        return (np.array([short.get(key_of(w), -1 - tail_of(w)) for w in words]),)

    return Coder(classes)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tail, n) of the words in one task's share, so far as they fit in memory together."""

    def attributes(words: list[str]) -> tuple[np.ndarray, ...]:
        return np.array([key_of(w) for w in words]), np.array([tail_of(w) for w in words], np.int32)

    coder = Coder(attributes)
    total, texts, columns = np.zeros(0, np.int64), 0, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(total)], names=["key", "tail", "n"])

    for whole in batches:
        for b in slices(whole, 0):
            if coder.full() and columns is not None:
                yield close()
                total, columns = np.zeros(0, np.int64), None
            codes, _, found = coder.encode(b.column(0).to_pylist())
            texts += b.num_rows
            if found:
                columns = found
                c = np.bincount(codes, minlength=len(columns[0]))
                c[: len(total)] += total
                total = c
    if columns is not None:
        yield close()
    yield pa.RecordBatch.from_arrays([pa.array([END_KEY]), pa.array([0], pa.int32()), pa.array([texts])], names=["key", "tail", "n"])


def word_counts(spark: SparkSession, train: DataFrame) -> DataFrame:
    """(key, tail, n) of every word of the training texts, the end token included."""
    found = train.select("text").mapInArrow(_word_counts, "key long, tail int, n long")
    return written(spark, found.groupBy("key").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")).where("n > 0"), "word-counts")


def _pairs(codes: np.ndarray, counts: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class) of each token, with the end of each text; the end stands before the first."""
    ends = np.cumsum(counts + 1)
    after = np.full(int(ends[-1]) if len(ends) else 0, end)
    inner = np.ones(len(after), bool)
    inner[ends - 1] = False
    after[inner] = classes[codes] if len(codes) else []
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[:1] = end
    return before, after


@dataclass
class Model:
    """``log_p[i, j]``: log10 probability of class j after class i. ``share``: log10 of each tail
    class's N + V + 1. ``short``: shortlist classes by key; ``head``: counts by key."""

    short: dict[int, int]
    log_p: np.ndarray
    share: np.ndarray
    head: dict[int, int]
    head_is_all: bool
    tokens: int
    types: int


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows at each index."""
    order = np.argsort(at, kind="stable")
    found, starts = np.unique(at[order], return_index=True)
    out = np.zeros((size, rows.shape[1]))
    out[found] = np.add.reduceat(rows[order], starts)
    return out


def train_nce(cells: np.ndarray, n: np.ndarray, size: int, *, dim: int = DIM, steps: int | None = None, batch: int = 4096, noise: int = 256, seed: int = 11) -> np.ndarray:
    """Log-probabilities of the class (column) after each class (row), from counted class pairs.

    Noise-contrastive estimation: each seen pair is told from ``noise`` draws of the unigram, shared by
    the batch, by the logistic loss on score - log(noise * unigram); Adagrad steps, 600 and one more for
    each 500 distinct pairs, so that what is learned grows with what was counted.
    """
    steps = steps or 600 + len(cells) // 500
    rng = np.random.default_rng(seed)
    before, after = cells // size, cells % size
    unigram = np.bincount(after, n, size) + 0.5
    unigram /= unigram.sum()
    log_noise = np.log(unigram * noise)
    R = rng.normal(0, 0.1, (size, dim))
    Q = rng.normal(0, 0.1, (size, dim))
    C = np.eye(dim) + rng.normal(0, 0.01, (dim, dim))
    b = np.log(unigram)
    squares = [np.full(x.shape, 1e-6) for x in (R, Q, C, b)]

    def step(k: int, x: np.ndarray, g: np.ndarray, rate: float) -> None:
        squares[k] += g * g
        x -= rate * g / np.sqrt(squares[k])

    upto, noise_upto = np.cumsum(n / n.sum()), np.cumsum(unigram)
    for t in range(steps):
        rate = 0.1 / (1 + 3 * t / steps)
        rows = np.minimum(np.searchsorted(upto, rng.random(batch)), len(cells) - 1)
        h, w = before[rows], after[rows]
        v = np.minimum(np.searchsorted(noise_upto, rng.random(noise)), size - 1)
        context = R[h] @ C
        good = (context * Q[w]).sum(1) + b[w] - log_noise[w]
        bad = context @ Q[v].T + b[v] - log_noise[v]
        dg = 1 / (1 + np.exp(-np.clip(good, -40, 40))) - 1
        db = 1 / (1 + np.exp(-np.clip(bad, -40, 40)))
        d_context = dg[:, None] * Q[w] + db @ Q[v]
        gq = _sums(np.concatenate([w, v]), np.concatenate([dg[:, None] * context, db.T @ context]), size)
        gb = np.bincount(np.concatenate([w, v]), np.concatenate([dg, db.sum(0)]), size)
        gc = R[h].T @ d_context
        gr = _sums(h, d_context @ C.T, size)
        step(0, R, gr / batch, rate)
        step(1, Q, gq / batch, rate)
        step(2, C, gc / batch, rate * 0.1)
        step(3, b, gb / batch, rate * 0.3)
    z = R @ C @ Q.T + b
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(spark: SparkSession, docs: DataFrame, *, shortlist: int = SHORTLIST, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words.

    To the driver go the ``head`` most frequent words (keys and counts), a sum for each tail class
    and the counts of class pairs, (shortlist + tails + 1)^2 at most.
    """
    train = docs.where(fold("doc_id", FOLDS) != HELD).select("text")
    counts = word_counts(spark, train)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the most frequent words by a histogram of their counts, 64 bins to a doubling, so that no task
    # sends more than it has of them and their number is known before they are fetched
    binned = counts.withColumn("bin", F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int"))
    left, least = head, None
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("v")).collect(), reverse=True):
        left -= r.v
        if left < 0:
            break
        least = r.bin
    top = binned.where((F.col("key") == END_KEY) | (F.col("bin") >= (2**31 - 1 if least is None else least))).select("key", "tail", "n").collect()
    top.sort(key=lambda r: (-r.n, r.key))
    chosen = [r for r in top if r.key != END_KEY][:shortlist]
    short = {r.key: i for i, r in enumerate(chosen)}
    size, end = len(chosen) + 1 + TAILS, len(chosen)
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n_of, v_of = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        n_of[r.tail], v_of[r.tail] = r.n, r.v
    for r in [*chosen, *(r for r in top if r.key == END_KEY)]:
        n_of[r.tail] -= r.n
        v_of[r.tail] -= 1
    shared = spark.sparkContext.broadcast(short)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _class_coder(shared.value)
        dense = np.zeros(size * size, np.int64)
        some: list[np.ndarray] = []
        for whole in batches:
            for b in slices(whole, 0):
                codes, n, found = coder.encode(b.column(0).to_pylist())
                classes = np.where(found[0] < 0, end - found[0], found[0]) if found else np.zeros(0, np.int64)
                before, after = _pairs(codes, n, classes, end)
                some.append(before * size + after)
                if sum(map(len, some)) > 2_000_000:
                    dense += np.bincount(np.concatenate(some), minlength=len(dense))
                    some = []
        if some:
            dense += np.bincount(np.concatenate(some), minlength=len(dense))
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], names=["cell", "n"])

    cells = train.mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    log_p = train_nce(cell, n, size) / np.log(10) if len(cell) else np.full((size, size), -np.log10(size))
    model = Model(short, log_p.astype(np.float32), np.log10(n_of + v_of + 1), {r.key: r.n for r in top}, total.v <= head, total.n, total.v)
    return model, counts


def scored(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Base and model log10 probability of every whole text; null texts have the end token alone.

    Words beyond the head are looked up by a join on their keys, so no vocabulary has to fit in a
    task. Repeated rows get equal scores; an empty table gives an empty table.
    """
    shared = spark.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, keys array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end = len(m.short)
        size = len(m.log_p)
        log_p = m.log_p.ravel()
        all_log = np.log10(m.tokens + 1.0 * (m.types + 1))

        def attributes(words: list[str]) -> tuple[np.ndarray, ...]:
            keys = [key_of(w) for w in words]
            cls = np.array([m.short.get(k, end + 1 + tail_of(w)) for k, w in zip(keys, words, strict=True)])
            n = np.array([m.head.get(k, 0 if m.head_is_all else -1) for k in keys])
            own = np.log10(np.maximum(n, 0) + 1.0)
            within = np.where(cls > end, own - m.share[np.maximum(cls - end - 1, 0)], 0.0)
            return np.array(keys), cls, n, own, within

        coder = Coder(attributes)
        end_log = np.log10(m.head.get(END_KEY, 0) + 1.0)
        for whole in batches:
            for b in slices(whole, 2):
                ids = b.column(1).to_pylist()
                codes, counts, found = coder.encode(b.column(2).to_pylist())
                keys, cls, n, own, within = found if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
                owner = np.repeat(np.arange(len(ids)), counts)
                by = lambda values, o=owner: np.bincount(o, values, len(ids))
                base = by(own[codes]) + end_log - (counts + 1) * all_log
                before, after = _pairs(codes, counts, cls, end)
                every = np.repeat(np.arange(len(ids)), counts + 1)
                score = np.bincount(every, log_p[before * size + after].astype(np.float64), len(ids)) + by(within[codes])
                known = by((n[codes] > 0).astype(np.float64)).astype(np.int64) + (m.head.get(END_KEY, 0) > 0)
                far = n[codes] < 0
                # words to be looked up: distinct within each text
                pair, times = np.unique(owner[far] * max(1, len(keys)) + codes[far], return_counts=True)
                whose = pair // max(1, len(keys))
                offsets = np.searchsorted(whose, np.arange(len(ids) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (keys[pair % max(1, len(keys))], times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([fold_of(i, FOLDS) == HELD for i in ids]), pa.array(counts + 1), pa.array(known), pa.array(base), pa.array(score), *lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "keys", "times"],
                )

    first = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)
    first = written(spark, first, "scores")
    far = first.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    least = min((n for k, n in model.head.items() if k != END_KEY), default=2**62)
    rare = counts.where(F.col("n") <= least).select("key", "n")  # a word beyond the head is no more frequent
    gained = far.join(rare, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("known"))
    out = first.drop("keys", "times").join(gained, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
