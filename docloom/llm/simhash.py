"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join.

Fingerprints are made in one pass over the texts; from there on only 8-byte numbers move. Equal
fingerprints are one trie leaf. Two fingerprints within ``budget`` bits agree on at least one of
``budget + 1`` blocks of bits, so each leaf enters that many tries, each rooted at an exact block. A
trie with more than ``limit`` leaves is not held by one task: its remaining bits are split in blocks
again, and its leaves go down to tries that agree on more bits, until all are small. (That ends, as
a trie with r bits left has 2**r leaves at most.) Within a trie, node pairs are traversed together
from the root: each step adds the differing bit, and a pair over the budget is pruned with all below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_words, lower_ascii, slices, written
from .components import components

SEED = 42
#: Near copies: five-word shingles, 0.8 of them in common. Candidates share one of 20 bands of 4 minima
#: (two texts at 0.8 share none with a chance of 3 in 100,000) and agree in 84 of 128 minima (the mean
#: at 0.8 is 102, four standard deviations above); the texts decide.
SHINGLE, BANDS, BAND, SIGNATURE, LEAST = 5, 20, 4, 128, 84
#: Pairs between groups already found agree in 768 of 1,024 minima (the mean at 0.8 is 819, four standard
#: deviations above; 0.72 agrees in so many with a chance of 2 in 100).
LONG, LONG_LEAST = 1024, 768
_ODD = np.random.default_rng(SEED).integers(0, 2**63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_ODD = np.random.default_rng(SEED + 1).integers(0, 2**63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def shingles(text: str | None, size: int) -> list[str]:
    words = find_words(lower_ascii(text or ""))
    if not words:
        return []
    if len(words) < size:
        return [" ".join(words)]
    return list(map(" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprints_of(texts: list[str | None], size: int = 3) -> np.ndarray:
    """The fingerprint of each text (signed 64-bit): a bit is set if it is set in over half the shingle hashes."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        grams = shingles(text, size)
        counts[i] = len(grams)
        if grams:
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))
    out = np.zeros(len(texts), np.uint64)
    if parts:
        octets = np.concatenate(parts).view(np.uint8).reshape(-1, 8)
        base = np.repeat(np.arange(len(texts)) * 256, counts)
        for k in range(8):
            set_in = np.bincount(base + octets[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS
            for bit in range(8):
                out |= (2 * set_in[:, bit] > counts).astype(np.uint64) << np.uint64(8 * k + bit)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, *, keep: list, text: str = "text", size: int = 3) -> DataFrame:
    """``keep`` columns of every row and ``fp``. Null and empty texts have fingerprint zero."""
    kept = docs.select(*keep)
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1):
                fp = fingerprints_of(b.column(b.num_columns - 1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=schema.names)

    return frame.mapInArrow(run, schema)


def trie_pairs(fps: np.ndarray, starts: np.ndarray, budget: int, *, equal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits, within each group; a group is a trie.

    ``fps`` (unsigned) is sorted within groups, which begin at ``starts``. A trie node is a range of
    leaves; all node pairs of one depth are advanced at once. Fingerprints are distinct within a
    group, or ``equal`` is set; then what is left at the end of the way is paired too.
    """
    ends = np.append(starts[1:], len(fps))
    own = np.stack([starts, ends], 1)[ends - starts > 1]
    cross = np.zeros((0, 5), np.int64)  # from, to, from, to, differing bits
    found_a, found_b = [], []
    for depth in range(63, -1, -1):
        if not len(own) and not len(cross):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)])
        cut = lambda s, e: e - (ones[e] - ones[s])
        new = []
        if len(cross):
            s1, e1, s2, e2, d = cross.T
            m1, m2 = cut(s1, e1), cut(s2, e2)
            new += [np.stack(x, 1) for x in ((s1, m1, s2, m2, d), (m1, e1, m2, e2, d), (s1, m1, m2, e2, d + 1), (m1, e1, s2, m2, d + 1))]
        if len(own):
            s, e = own.T
            m = cut(s, e)
            new.append(np.stack((s, m, m, e, np.ones_like(s)), 1))
            own = np.concatenate([np.stack((s, m), 1), np.stack((m, e), 1)])
            own = own[own[:, 1] - own[:, 0] > 1]
        cross = np.concatenate(new) if new else cross
        cross = cross[(cross[:, 0] < cross[:, 1]) & (cross[:, 2] < cross[:, 3]) & (cross[:, 4] <= budget)]
        single = (cross[:, 1] - cross[:, 0] == 1) & (cross[:, 3] - cross[:, 2] == 1)
        if single.any():  # two leaves: the rest of the way is one count of bits
            a, b = cross[single, 0], cross[single, 2]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            found_a.append(a[near])
            found_b.append(b[near])
            cross = cross[~single]
    if equal:  # nodes of equal leaves, beside each other and within
        ranges = [*cross[:, :4].tolist(), *([s, e, s, e] for s, e in own.tolist())]
        for s1, e1, s2, e2 in ranges:
            a, b = np.meshgrid(np.arange(s1, e1), np.arange(s2, e2), indexing="ij")
            found_a.append(a[a < b])
            found_b.append(b[a < b])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join two trees: the rest add nothing to the components."""
    top: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = up = top.get(up, up)
            x = up
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := find(x)) != (q := find(y)):
            top[max(p, q)] = min(p, q)
            keep[i] = True
    return keep


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` runs of its free bits fixed in addition."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[cuts[k] : cuts[k + 1]]) for k in range(parts)]


def links(spark: SparkSession, leaves: DataFrame, *, budget: int = 2, limit: int = 512) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs
    within ``budget`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(t: pa.Table) -> pa.RecordBatch:
            trie, key, fp = (t.column(i).to_numpy() for i in range(3))
            order = np.lexsort((fp.view(np.uint64), key, trie))
            trie, key, fp = trie[order], key[order], fp[order].view(np.uint64)
            fresh = np.ones(len(fp), bool)
            fresh[1:] = (trie[1:] != trie[:-1]) | (key[1:] != key[:-1])
            a, b = trie_pairs(fp, np.flatnonzero(fresh), budget)
            kept = forest(fp[a], fp[b])
            return pa.RecordBatch.from_arrays([pa.array(fp[x[kept]].view(np.int64)) for x in (a, b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by trie and key: cut before the last key, which may go on
            held.append(batch)
            if sum(x.num_rows for x in held) < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            trie, key = t.column(0).to_numpy(), t.column(1).to_numpy()
            last = np.flatnonzero((trie != trie[-1]) | (key != key[-1]))
            if len(last):
                yield close(t.slice(0, int(last[-1]) + 1))
                held = t.slice(int(last[-1]) + 1).to_batches()
        if held and sum(x.num_rows for x in held):
            yield close(pa.Table.from_batches(held).combine_chunks())

    parts = budget + 1
    masks, rows, out = [0], leaves.select("fp", F.lit(0).alias("trie")), None
    while True:
        masks = [m for mask in masks for m in blocks(mask, parts)]
        fixed = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
        rows = rows.select("fp", F.explode(F.array(*((F.col("trie") * parts + k).cast("int") for k in range(parts)))).alias("trie"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.element_at(fixed, F.col("trie") + 1)))
        hot = written(spark, rows.groupBy("trie", "key").count().where(F.col("count") > limit).select("trie", "key"), "hot")
        n_hot = hot.count()
        few = (lambda df: F.broadcast(df)) if n_hot <= 100_000 else (lambda df: df)
        calm = rows.join(few(hot), ["trie", "key"], "left_anti") if n_hot else rows
        found = calm.select("trie", "key", "fp").repartition("trie", "key").sortWithinPartitions("trie", "key").mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not n_hot:
            return out
        rows = written(spark, rows.join(few(hot), ["trie", "key"], "left_semi").select("fp", "trie"), "deeper")


def near_duplicates(spark: SparkSession, rows: DataFrame, *, of: Column | str, budget: int = 2) -> DataFrame:
    """(fp, least): for each distinct fingerprint of ``rows`` the least ``of`` in its component.

    ``rows`` has ``fp``; ``of`` is any orderable column, whose nulls are passed over unless a
    component has nothing else.
    """
    leaves = written(spark, rows.groupBy("fp").agg(F.min(of).alias("least")), "leaves")
    roots = written(spark, components(spark, links(spark, leaves.select("fp"), budget=budget)), "roots")
    linked = written(spark, roots.join(leaves, roots.node == leaves.fp).select("fp", "root", "least"), "linked")
    least = written(spark, linked.groupBy("root").agg(F.min("least").alias("__least")), "component-least")
    joined = linked.join(least, "root").select("fp", F.col("__least").alias("least"))
    return leaves.join(roots, leaves.fp == roots.node, "left_anti").select("fp", "least").unionByName(joined)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a text without words has one of its own."""
    out = []
    for text in texts:
        grams = shingles(text, size)
        out.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))) if grams else np.zeros(1, np.uint64))
    return out


def minima(sets: list[np.ndarray], odds: np.ndarray) -> np.ndarray:
    """The least of each set's hashes under each of the multipliers."""
    out = np.zeros((len(sets), len(odds)), np.uint64)
    if sets:
        h = np.concatenate(sets)
        h ^= h >> np.uint64(32)
        starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
        for j, odd in enumerate(odds):
            out[:, j] = np.minimum.reduceat(h * odd, starts)
    return out


def signatures_of(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, keys of the bands, a byte of each minimum) of the distinct shingles of each text.

    The node is a hash of the whole set, so texts with one set of shingles are one node. No words:
    a set of its own.
    """
    sets = shingle_sets(texts, size)
    node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
    mins = minima(sets, _ODD)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for t in range(BANDS):
        x = np.full(len(sets), t + 1, np.uint64)
        for m in mins[:, BAND * t : BAND * t + BAND].T:
            x = (x ^ m) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        keys[:, t] = x
    return node, keys.view(np.int64), (mins >> np.uint64(20)).astype(np.uint8)


def with_long_signature(texts: DataFrame) -> DataFrame:
    """(node, signature) with ``LONG`` minima, of the few nodes whose ``text`` decides links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                sig = (minima(shingle_sets(b.column(1).to_pylist()), _LONG_ODD) >> np.uint64(20)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "signature"])

    return texts.select("node", "text").mapInArrow(run, "node long, signature binary")


def with_signature(docs: DataFrame, *, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns of every row with its ``node``, ``keys`` and ``signature``."""
    schema = docs.select(*keep).withColumns({"node": F.lit(0).cast("long"), "keys": F.array().cast("array<long>"), "signature": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1):
                node, keys, sig = signatures_of(b.column(b.num_columns - 1).to_pylist())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(node), keys, pa.array([x.tobytes() for x in sig], pa.binary())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def nearest_trees(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the trees of greatest ``same`` (a square of counts) over the pairs with ``least`` or more."""
    n = len(same)
    best, via, out = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
    a, b = [], []
    for _ in range(n):
        i = int(np.where(out, -2, best).argmax())
        if best[i] >= least:
            a.append(via[i])
            b.append(i)
        out[i] = True
        better = same[i] > best
        best[better], via[better] = same[i][better], i
    return np.array(a, np.int64), np.array(b, np.int64)


def band_members(spark: SparkSession, leaves: DataFrame, *, limit: int = 512) -> DataFrame:
    """(group, band, node) of the nodes that share a band with another. A band of more than ``limit`` nodes
    is dealt out as pairs of chunks, so all of its pairs are seen and no task holds over two chunks."""
    dealt = leaves.select("node", F.posexplode("keys").alias("band", "key"))
    shared = written(spark, dealt.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / limit).cast("int").alias("chunks")), "shared-bands")
    told = dealt.join(F.broadcast(shared) if shared.count() <= 500_000 else shared, "key")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, F.col("mine")) * F.lit(1 << 31) + F.greatest(j, F.col("mine")))
    calm = told.where("chunks = 1").select(F.col("key").alias("group"), "band", "node")
    split = told.where("chunks > 1").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")))
    split = split.withColumn("pair", F.explode(others)).select(F.xxhash64("key", "pair").alias("group"), "band", "node")
    return written(spark, calm.unionByName(split), "band-members")


def candidate_links(members: DataFrame, leaves: DataFrame, *, least: int = LEAST) -> DataFrame:
    """Pairs (a, b) of ``members`` of one group whose ``signature``s agree in ``least`` places or more.

    With a ``root`` in ``leaves``: all such pairs of different roots, each in the first band that both
    have in common. Without: of each group the trees of greatest agreement, which reach every node
    that is in any such pair.
    """
    crossing = "root" in leaves.columns

    def close(t: pa.Table) -> pa.RecordBatch:
        group, node, root, band = (t.column(i).to_numpy() for i in (0, 1, 3, 4))
        keys = t.column(5).combine_chunks().flatten().to_numpy().reshape(len(group), -1) if crossing else None
        sig = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(group), -1)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        two = starts[sizes == 2]
        two = two[((sig[two] == sig[two + 1]).sum(1) >= least) & ((root[two] != root[two + 1]) | (not crossing))]
        found_a, found_b = [two], [two + 1]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own, top = sig[s : s + n], root[s : s + n]
            same = np.stack([(x == own).sum(1) for x in own])
            if crossing:
                a, b = np.nonzero(np.triu((same >= least) & (top[:, None] != top[None]), 1))
            else:
                a, b = nearest_trees(same, least)
            found_a.append(a + s)
            found_b.append(b + s)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if crossing:
            first = (keys[a] == keys[b]).argmax(1) == band[a]
            a, b = a[first], b[first]
        a, b = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by group: cut before the last one, which may go on
            held.append(batch)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            t = pa.Table.from_batches(held)
            group = t.column(0).to_numpy()
            last = np.flatnonzero(group != group[-1])
            if len(last):
                yield close(t.slice(0, int(last[-1]) + 1))
                held = t.slice(int(last[-1]) + 1).to_batches()
        if held and sum(x.num_rows for x in held):
            yield close(pa.Table.from_batches(held))

    told = leaves.select("node", "signature", *(["root", "keys"] if crossing else [F.lit(0).cast("long").alias("root"), F.array().cast("array<long>").alias("keys")]))
    rows = members.join(told, "node").select("group", "node", "signature", "root", "band", "keys").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near(one: str | None, two: str | None) -> bool:
    """Whether 0.8 or more of the distinct five-word shingles of two texts are common to both."""
    a, b = set(shingles(one, SHINGLE)), set(shingles(two, SHINGLE))
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def true_links(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``links`` (a, b) whose ``texts`` (node, text) are ``near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [near(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_copies(spark: SparkSession, leaves: DataFrame, texts_of: Callable[[DataFrame], DataFrame], *, limit: int = 512) -> DataFrame:
    """(node, root) of the nodes of ``leaves`` (node, keys, signature) that have a near copy.

    Every link is decided by the texts, which ``texts_of`` gives for a table of nodes. First the
    nearest links of each band are decided; then all candidates between the components so found, told
    by longer signatures, so that of a crowd of texts that are near, but not near enough, few pairs
    are left. No candidate that could join two components goes undecided, and a crowd of copies is
    not dealt out as all of its pairs.
    """
    members = band_members(spark, leaves, limit=limit)
    first = written(spark, candidate_links(members, leaves), "candidates")
    nodes = written(spark, first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), "candidate-nodes")
    texts = written(spark, texts_of(nodes), "candidate-texts")
    links = written(spark, true_links(first, texts), "links")
    roots = written(spark, components(spark, links), "first-roots")
    told = with_long_signature(texts).join(leaves.select("node", "keys"), "node").join(roots, "node", "left").select("node", "signature", "keys", F.coalesce("root", "node").alias("root"))
    told = written(spark, told, "candidate-leaves")
    rest = candidate_links(members.join(nodes, "node", "left_semi"), told, least=LONG_LEAST)
    rest = written(spark, rest.join(first, ["a", "b"], "left_anti"), "more-candidates")
    if rest.isEmpty():
        return roots
    more = written(spark, true_links(rest, texts), "more-links")
    return written(spark, components(spark, links.unionByName(more)), "roots")


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that of the least ``doc_id`` (ties: a content hash).

    Near-duplicates have 0.8 or more of their distinct five-word shingles in common, decided on the
    texts; groups are what such links connect. All columns are kept. Null ids come last in a group;
    rows equal in every column count once.
    """
    cols = docs.columns
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    rows = written(spark, with_signature(docs, keep=["doc_id", one.alias("h1"), two.alias("h2")]), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h1", "h2")
    leaves = written(spark, rows.groupBy("node").agg(F.min(rank).alias("least"), F.first("keys").alias("keys"), F.first("signature").alias("signature")), "leaves")

    def texts_of(nodes: DataFrame) -> DataFrame:
        want = written(spark, leaves.join(nodes, "node").select("node", "least.h1", "least.h2"), "wanted")
        want = F.broadcast(want) if want.count() <= 500_000 else want
        return docs.select(F.col("text"), one.alias("h1"), two.alias("h2")).join(want, ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])

    roots = near_copies(spark, leaves.select("node", "keys", "signature"), texts_of)
    linked = written(spark, leaves.join(roots, "node").select("node", "root", "least"), "linked")
    best = written(spark, linked.groupBy("root").agg(F.min("least").alias("__least")), "component-least")
    joined = linked.join(best, "root").select("node", F.col("__least").alias("least"))
    least = written(spark, leaves.join(roots, "node", "left_anti").select("node", "least").unionByName(joined), "kept")
    is_best = F.struct(F.col("h1"), F.col("h2")) == F.struct(F.col("least.h1"), F.col("least.h2"))
    told = rows.select("node", "h1", "h2").join(least, "node").select("h1", "h2", is_best.alias("best"))
    told = told.groupBy("h1", "h2").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    told = written(spark, told.where("not best or n > 1"), "dropped")
    few = (lambda df: F.broadcast(df)) if told.count() <= 500_000 else (lambda df: df)
    # the row as one value, so that no column of the input can clash with those used here
    keyed = docs.select(F.struct(*cols).alias("doc"), one.alias("h1"), two.alias("h2"))
    lone = keyed.join(few(told), ["h1", "h2"], "left_anti").select("doc.*")
    repeated = keyed.join(few(told.where("best")), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("doc.*")
    return lone.unionByName(repeated)
