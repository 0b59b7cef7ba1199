"""Order MinHash fingerprints: likeness that follows edit distance, not only shared k-mers.

Each k-mer of a text carries its occurrence number. Their hashes are dealt into ``slots`` bins; a slot
keeps the ``length`` least of its bin, puts them back in text order and hashes that tuple. A slot
whose bin holds too few takes the least under its own hash of all k-mers, so short texts have full
fingerprints too. Two texts are as like as the share of slots on which they agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

K, SLOTS, LENGTH = 10, 64, 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` code points (a shorter text is one run), by doubling."""
    h, width = (points.astype(np.uint64) + np.uint64(1)) * _B, 1
    k = min(k, len(points))
    power = {1: _A}
    bits = bin(k)[3:]
    for bit in bits:
        h = h[:-width] * power[width] + h[width:]
        power[2 * width] = power[width] * power[width]
        width *= 2
        if bit == "1":
            h = h[:-1] * _A + ((points[width : width + len(h) - 1].astype(np.uint64) + np.uint64(1)) * _B)
            power[width + 1] = power[width] * _A
            width += 1
    return _mix(h)


def signature(points: np.ndarray, *, k: int = K, slots: int = SLOTS, length: int = LENGTH) -> np.ndarray:
    """``slots`` 16-bit values of a text given as code points; no points: zeros."""
    n = len(points)
    if not n:
        return np.zeros(slots, np.uint16)
    with np.errstate(over="ignore"):
        h = _kmers(points, k)
        n = len(h)
        # occurrence numbers: sort by hash and then by place
        if n < 1 << 24:
            key = np.sort((h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64))
            place, value = (key & np.uint64((1 << 24) - 1)).astype(np.int64), key >> np.uint64(24)
        else:
            place = np.argsort(h, kind="stable")
            value = h[place] >> np.uint64(24)
        fresh = np.ones(n, bool)
        fresh[1:] = value[1:] != value[:-1]
        order = np.arange(n)
        number = order - np.maximum.accumulate(np.where(fresh, order, 0))
        g = _mix(value + number.astype(np.uint64) * _A)
        bins = g % np.uint64(slots)
        # few enough to sort, and in a long text surely the least of each bin
        some = np.flatnonzero(g <= np.uint64((slots * length * 12 << 64) // n)) if n > 24 * slots * length else order
        if len(some) < n and np.bincount(bins[some].astype(np.int64), minlength=slots).min() < length:
            some = order
        by = some[np.lexsort((g[some], bins[some]))]
        b = bins[by].astype(np.int64)
        first = np.searchsorted(b, np.arange(slots))
        filled = np.searchsorted(b, np.arange(slots), side="right") - first >= length
        picks = np.zeros((slots, length), np.int64)
        size = np.full(slots, length)
        full = np.flatnonzero(filled)
        picks[full] = by[first[full][:, None] + np.arange(length)]
        for s in np.flatnonzero(~filled):
            own = _mix(g ^ (np.uint64(s + 1) * _C))
            m = min(length, n)
            picks[s, :m] = np.argpartition(own, m - 1)[:m]
            size[s] = m
        where = np.where(np.arange(length) < size[:, None], place[picks], np.iinfo(np.int64).max)
        turn = np.argsort(where, axis=1, kind="stable")
        tuples = np.take_along_axis(g[picks], turn, 1)
        out = np.arange(1, slots + 1, dtype=np.uint64) * _A
        for j in range(length):
            out = np.where(j < size, _mix(out * _B + tuples[:, j]), out)
        return (out >> np.uint64(48)).astype(np.uint16)


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_pairs(spark: SparkSession, docs: DataFrame, *, ranges: int | None = None, **how: int) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of
    the next document in descending doc_id (null ids last; equal ids in order of their texts; after
    the last comes the first). Null texts are empty; two empty texts are alike. A lone document is its
    own next. Ranges of ids are dealt to tasks; each range also gets the row that follows it, so the
    texts move once. Only one id for each range reaches the driver.
    """
    docs = docs.select("doc_id", "text")
    count = docs.select("doc_id").count()
    ranges = ranges or int(min(65_536, max(1, count // 250)))
    ends = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = np.unique(np.array(ends, np.int64)) if ends else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # 0 holds the null ids; higher ranges hold higher ids
        values = np.array([0 if v is None or v != v else int(v) for v in ids.astype(object)], np.int64)
        known = ids.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(cuts, values, side="right") + 1, 0).astype(np.int32))

    tagged = docs.withColumn("range", range_of("doc_id"))
    tops = tagged.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()
    order = sorted(((r.range, r.top) for r in tops), reverse=True)
    # the range whose following row is the first of this one: the next higher in use
    above = {order[(i + 1) % len(order)][0]: (order[i][0], order[(i + 1) % len(order)][1]) for i in range(len(order))}
    halo = spark.createDataFrame([(r, top, to) for r, (to, top) in above.items()], "range int, top long, to int")
    # every row with the top id of its range may be its first
    extra = tagged.join(F.broadcast(halo), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    if any(r.range == 0 for r in tops):  # of many null ids the one with the least text comes first
        extra_ids = extra.where("range > 0")
        least = tagged.where("range = 0").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        nulls = least.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(above[0][0]).alias("to"))
        extra = extra_ids.select("doc_id", "text", "to").unionByName(nulls)
    own = tagged.select("doc_id", "text", "range", F.lit(False).alias("extra"))
    extra = extra.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    by = [F.col("range"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit(""))]
    dealt = own.unionByName(extra).repartition("range").sortWithinPartitions(*by)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (doc_id, points, signature, range) of a row whose next is still to come
        out: list[tuple] = []
        closed = None

        def row(of: tuple, nxt: np.ndarray, sig: np.ndarray) -> tuple:
            doc, points, mine, _ = of
            half = len(points) // 2
            new = np.concatenate([points[: len(points) - half], nxt[:half]])
            edited = signature(new, **how)
            digest = hashlib.sha256(new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(points), digest, as_text(mine), as_text(edited), likeness(mine, edited), likeness(mine, sig)

        for whole in batches:
            for b in slices(whole, 1):
                for doc, text, at, halo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if halo and closed == at:
                        continue
                    points = points_of(text)
                    sig = signature(points, **how)
                    if before is not None:
                        out.append(row(before, points, sig))
                    before, closed = (None, at) if halo else ((doc, points, sig, at), closed)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) if i else pa.array(list(c), pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)
                    out = []

    return dealt.select("doc_id", "text", "range", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
