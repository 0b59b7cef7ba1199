"""Nearest neighbours by learned partitions.

On a bounded sample: the exact neighbour graph, a balanced partition of that graph, and a small network
that learns which parts a vector's neighbours lie in. Every row is then indexed under its most probable
part; a query goes to its several most probable parts and is ranked there exactly. How many is measured:
the fewest that find ``RECALL`` of the neighbours of a tenth of the sample that is kept from training.
(The whole table's neighbours are closer than the sample's, so it finds more there.) A part is held
in blocks of bounded size, so a part with a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import sampled, written

SAMPLE, RECALL, NEIGHBOURS = 6_000, 0.93, 10


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1000):
        d = squared(x[at : at + 1000], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 1000] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, *, slack: float = 0.1, sweeps: int = 12) -> np.ndarray:
    """Part of each node: halves by the main axis, then moves and swaps that cut fewer edges.

    No part grows over ``1 + slack`` times the mean.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(own.T @ own)[0][:, 0]
        order = rows[np.argsort(own @ axis, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    both: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    room = int(n / parts * (1 + slack) + 1e-9)
    least = int(n / parts * (1 - slack))
    size = np.bincount(label, minlength=parts)
    rng = np.random.default_rng(3)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[both[i]], minlength=parts)
            here, to = label[i], int(votes.argmax())
            if votes[to] > votes[here] and size[to] < room and size[here] > least:
                label[i] = to
                size[to] += 1
                size[here] -= 1
                moved += 1
        if moved < n // 500:
            break
    return label


@dataclass
class Router:
    """One hidden layer over standardised vectors; ``probes``: parts that a query goes to."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def train_router(x: np.ndarray, share: np.ndarray, *, hidden: int = 128, steps: int = 800, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> Router:
    """Cross-entropy against the parts of each vector's neighbours and its own; Adam in numpy."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    d, p = x.shape[1], share.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(z), batch)
        h = np.maximum(z[rows] @ w[0] + w[1], 0)
        o = h @ w[2] + w[3]
        o -= o.max(1, keepdims=True)
        q = np.exp(o)
        q /= q.sum(1, keepdims=True)
        g = (q - share[rows]) / batch
        gh = (g @ w[2].T) * (h > 0)
        for k, grad in enumerate((z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] -= rate * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *w)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles; null, zero and non-finite ones, null ids and those of another
    length than most are left out."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def fit(spark: SparkSession, rows: DataFrame, n: int, *, sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL) -> Router | None:
    """Learn parts from at most about ``sample`` vectors (a hash sample).

    Their number grows with the root of the rows, as far as the sample has 20 vectors for each. Fewer
    than 40 distinct vectors are one part.
    """
    parts = parts or int(np.clip(round(np.sqrt(n / 200)), 2, sample // 25))
    found = sampled(rows, "vec_id", n, sample).orderBy("vec_id").collect()
    if not found:
        return None
    x = np.stack([r.v for r in found])
    # equal vectors would be each other's only neighbours: one of each
    x = np.random.default_rng(2).permutation(np.unique(x, axis=0))
    k = NEIGHBOURS
    kept, x = x[: len(x) // 10], x[len(x) // 10 :]
    if len(x) < 20 * parts or len(x) <= k + 1:
        return None
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1)
    share[np.arange(len(x)), label] += 2
    router = train_router(x, share / share.sum(1, keepdims=True))
    near = np.argpartition(squared(kept, x), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-router.scores(kept), axis=1), axis=1)
    place = np.take_along_axis(place, router.scores(x).argmax(1)[near], 1)
    router.probes = next(m for m in range(1, parts + 1) if (place < m).mean() >= recall)
    return router


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, *, top: int = 10, probes: int | None = None, router: Router | None | str = "fit", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query, its own id left out.

    Ties go to the smaller vec_id; ``score`` is the Euclidean distance in double precision. A query
    goes to more parts than ``probes`` (by default the router's) if those hold too few rows, so each gets ``top`` where there
    are as many. Repeated ids are separate candidates.
    """
    clean = written(spark, usable(rows), "vectors")
    n = clean.count()
    router = fit(spark, clean, n) if router == "fit" else router
    shared = spark.sparkContext.broadcast(router)
    parts = len(router.b2) if router else 1
    probes = probes or (router.probes if router else 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            part = r.scores(_matrix(b.column(1), b.num_rows)).argmax(1) if r and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    indexed = written(spark, clean.mapInArrow(index, "vec_id long, v array<double>, part int"), "index")
    counts = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").count().collect():  # a row a part
        counts[r.part] = r["count"]
    block_rows = block_rows or int(np.clip(n // 256, 1024, 16_384))
    blocks = np.maximum(1, -(-counts // block_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            s = r.scores(_matrix(b.column(1), b.num_rows)) if r else np.zeros((b.num_rows, 1))
            order = np.argsort(-np.where(counts > 0, s, -np.inf), axis=1, kind="stable")
            upto = np.cumsum(counts[order], axis=1) - counts[order]
            take = (np.arange(parts) < probes) | (upto < top + 1)
            to = [o[t & (counts[o] > 0)].astype(np.int32) for o, t in zip(order, take, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "v", "to"])

    asked = clean.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi") if queries is not None else clean
    asked = asked.dropDuplicates(["vec_id"]).mapInArrow(route, "vec_id long, v array<double>, to array<int>")
    n_blocks = F.array(*(F.lit(int(x)) for x in blocks))
    asked = asked.select("vec_id", "v", F.explode("to").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(n_blocks, F.col("part") + 1) - 1)))
    held = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(n_blocks, F.col("part") + 1)).cast("int"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(c):
            return none
        x, y = np.stack(q["v"].to_list()), np.stack(c["v"].to_list())
        ids, own = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        found = []
        for at in range(0, len(x), 256):
            d = squared(x[at : at + 256], y)
            d[own[at : at + 256, None] == ids[None, :]] = np.inf
            k = min(top, len(y)) - 1
            edge = np.partition(d, k, axis=1)[:, k]
            slack = 1e-9 * ((x[at : at + 256] ** 2).sum(1) + (y * y).sum(1).max())
            for i in range(len(d)):
                near = np.flatnonzero(np.isfinite(d[i]) & (d[i] <= edge[i] + slack[i]))
                exact = np.sqrt(((y[near] - x[at + i]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:top]
                found.append(pd.DataFrame({"query_id": own[at + i], "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(found) if found else none

    by = ["part", "block"]
    pairs = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
