"""Packing into optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket boundaries with the
least padding (each document is padded to its bucket's boundary). Within a bucket, batches hold as
many documents as fit the token budget at that boundary. Documents are numbered within a bucket by
(shard, doc_id): counts by shard give each shard its first number, so no bucket meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .mixing import n_words

BUCKETS, BUDGET, SHARD_ROWS, SHARDS = 8, 32_768, 500, 4096


def boundaries(lengths: list[int] | np.ndarray, counts: list[int] | np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least padding (ties: earlier cuts).

    The padding cost obeys the quadrangle inequality, so the best cut grows with the prefix, and
    each layer of the programme is filled by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    L = np.array(lengths, np.int64)
    C = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    S = np.concatenate([[0], np.cumsum(L * np.array(counts, np.int64))])
    cost = L * C[1:] - S[1:]  # one bucket over the first j+1 lengths
    back = []
    for _ in range(min(buckets, n) - 1):
        now, arg = np.full(n, np.iinfo(np.int64).max // 4), np.zeros(n, np.int64)
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            w = cost[i] + L[j] * (C[j + 1] - C[i + 1]) - (S[j + 1] - S[i + 1])
            best = int(w.argmin())
            now[j], arg[j] = w[best], i[best]
            todo += [(lo, j - 1, first, int(arg[j])), (j + 1, hi, int(arg[j]), last)]
        back.append(arg)
        cost = now
    ends, j = [n - 1], n - 1
    for arg in reversed(back):
        j = int(arg[j])
        ends.append(j)
    return L[ends[::-1]].tolist()


def packed(spark: SparkSession, docs: DataFrame, *, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, place, padding) of every row.

    ``n_tokens`` counts words (null text: 0). ``batch`` numbers within the bucket and ``place``
    within the batch, both from 0. A bucket longer than the budget has batches of one document.
    Null ids come last in their shard; rows equal in id and length are interchangeable. The
    histogram of lengths reaches the driver as two arrays and is never rounded.
    """
    rows = written(spark, docs.select("doc_id", n_words().alias("n_tokens")), "lengths")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("c"))
    got = hist.toArrow().sort_by("n_tokens")
    lengths, counted = got.column("n_tokens").to_numpy(), got.column("c").to_numpy()
    bounds = boundaries(lengths, counted, buckets)
    total = int(counted.sum())
    shards = max(1, min(SHARDS, -(-total // SHARD_ROWS)))
    ends = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("n_tokens").cast("string")).cast("binary"))
    told = rows.withColumns({
        "bucket": F.size(F.filter(ends, lambda b: b < F.col("n_tokens"))),
        "shard": (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % shards).cast("int"),
    })
    told = told.withColumn("bucket_len", F.element_at(ends, F.col("bucket") + 1))
    counts = told.groupBy("bucket", "shard").agg(F.count("*").alias("c"))  # SHARDS rows a bucket at most
    first = F.sum("c").over(W.partitionBy("bucket").orderBy("shard")) - F.col("c")
    counts = counts.select("bucket", "shard", first.alias("first"))
    order = W.partitionBy("bucket", "shard").orderBy(F.col("doc_id").asc_nulls_last(), "n_tokens")
    numbered = told.withColumn("r", F.row_number().over(order)).join(F.broadcast(counts), ["bucket", "shard"])
    at = F.col("first") + F.col("r") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


ORACLE_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), hist AS (
  SELECT n_tokens AS n, count(*)::BIGINT AS c FROM sized GROUP BY 1
), idx AS (
  SELECT row_number() OVER (ORDER BY n) AS i, n, sum(c) OVER (ORDER BY n)::BIGINT AS cc, sum(c * n) OVER (ORDER BY n)::BIGINT AS ss FROM hist
), dp AS (
  SELECT 1 AS k, i, cc, ss, n * cc - ss AS cost, [n] AS path FROM idx
  UNION ALL
  SELECT k, i, cc, ss, best.c AS cost, best.p AS path FROM (
    SELECT d.k + 1 AS k, b.i, b.cc, b.ss, min({{'c': d.cost + b.n * (b.cc - d.cc) - (b.ss - d.ss), 'i': d.i, 'p': list_append(d.path, b.n)}}) AS best
    FROM dp d JOIN idx b ON b.i > d.i WHERE d.k < {BUCKETS} GROUP BY d.k + 1, b.i, b.cc, b.ss)
), bounds AS (
  SELECT path FROM dp WHERE i = (SELECT max(i) FROM idx) ORDER BY k DESC LIMIT 1
), told AS (
  SELECT doc_id, n_tokens, len(list_filter(path, lambda b: b < n_tokens))::INT AS bucket, path,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || n_tokens), 1, 6))::BIGINT % greatest(1, least({SHARDS}, ceil((SELECT count(*) FROM sized) / {SHARD_ROWS}.0)::BIGINT)) AS shard
  FROM sized, bounds
), numbered AS (
  SELECT doc_id, n_tokens, bucket, path[bucket + 1] AS bucket_len,
    row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id NULLS LAST, n_tokens) - 1 AS pos
  FROM told
), room AS (
  SELECT *, greatest(1, {BUDGET} // greatest(bucket_len, 1))::BIGINT AS room FROM numbered
)
SELECT doc_id, n_tokens, bucket, bucket_len, (pos // room)::BIGINT AS batch, (pos % room)::BIGINT AS place, bucket_len - n_tokens AS padding FROM room
"""
