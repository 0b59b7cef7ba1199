"""Ranked lexical search over document-sharded postings with integer impacts.

``build`` reads the texts once and writes once. Each shard holds some thousand documents at most and
its postings as compressed sparse rows: for each of its terms the documents that hold it, with its
occurrences there. The impact of a posting, a 64-bit integer rule of the occurrences, the document's
length and the corpus's mean length, is made where a shard is searched, as the mean is known only
when all texts are read. Row groups are small, so that neither side holds a file's shards at once.

``search`` takes the queries in blocks. Every shard adds, a term at a time, weight x impact into dense
arrays, one row a query, and keeps its best by a partition of that array with ties cut by document
id; the best of tasks, of groups of tasks, and of all follow.

Nulls and texts without terms are in no posting and count neither as documents nor for the mean.
Rows with one doc_id are documents of their own; rows with one item_id are one query, whose terms
are those of all their texts. Null ids stand last among equal scores. An empty corpus or query table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, slices, written

#: A term: a run of ASCII letters and digits and of all beyond ASCII.
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
find_terms = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 50
#: Bounds of a shard (rows, bytes of text) and of a block of queries. Small shards keep rows and arrays small.
SHARD_ROWS, SHARD_BYTES, ROW_BLOCK, BLOCK_ITEMS, BLOCK_TERMS = 4096, 250_000, 256, 4096, 400_000
#: Terms are one string with their ends, so that no row is made of each on the way to the files and back.
_SHARD = "docs array<long>, sizes binary, terms binary, ends binary, ptr binary, posting binary, tf binary"
#: Bytes of a row group, looked at after each shard (the writer would hold a hundred of them else).
_GROUP = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def _cells(batch: pa.RecordBatch, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), dtype) for c in batch.column(name)]


def _terms(batch: pa.RecordBatch) -> Iterator[pa.StringArray]:
    """The terms of each shard of a batch, without a copy."""
    for ends, data in zip(batch.column("ends"), batch.column("terms"), strict=True):
        yield pa.StringArray.from_buffers(len(ends.as_buffer()) // 4 - 1, ends.as_buffer(), data.as_buffer())


def _shards(shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in slices(whole, 1, SHARD_BYTES):
                for at in range(0, piece.num_rows, shard_rows):
                    b = piece.slice(at, shard_rows)
                    numbers: defaultdict[str, int] = defaultdict()
                    numbers.default_factory = numbers.__len__
                    found = [np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)) for terms in (find_terms(lower_ascii(t)) if t else [] for t in b.column(1).to_pylist())]
                    sizes = np.fromiter(map(len, found), np.int64, len(found))
                    keys, tf = np.unique(np.concatenate(found) * b.num_rows + np.repeat(np.arange(b.num_rows), sizes), return_counts=True)
                    ptr = np.searchsorted(keys, np.arange(len(numbers) + 1) * b.num_rows)
                    cells = [sizes.tobytes(), ptr.astype(np.int64).tobytes(), (keys % b.num_rows).astype(np.uint16).tobytes(), tf.astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.int32).tobytes()]
                    names = pa.array(numbers, pa.string()).cast(pa.binary())
                    ends = np.concatenate([[0], np.cumsum(pc.binary_length(names).to_numpy())])
                    cells += [b"".join(names.to_pylist()), ends.astype(np.int32).tobytes()]
                    sizes, ptr, posting, tf, terms, ends = (pa.array([c], pa.binary()) for c in cells)
                    docs = pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([docs, sizes, terms, ends, ptr, posting, tf], names=["docs", "sizes", "terms", "ends", "ptr", "posting", "tf"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for b in batches:
        for sizes in _cells(b, "sizes", np.int64):
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


def impacts(tf: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of postings with ``tf`` occurrences in documents of ``sizes`` terms, in a corpus of ``n`` documents and ``total`` terms."""
    return _impacts(tf, _lengths(sizes, n, total))


def _lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    each, back = np.unique(sizes, return_inverse=True)
    return np.array([100 - 50 + (50 * s * n) // total for s in each.tolist()], np.int64)[back]


def _impacts(tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * lengths)


def build(spark: SparkSession, docs: DataFrame, path: str, *, shard_rows: int = SHARD_ROWS) -> None:
    """Write the index of ``docs`` (doc_id, text) to ``path``: ``shards`` of ``shard_rows`` (65,536 at most), and ``totals`` of one row."""
    made = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_shards(shard_rows), _SHARD)
    made.write.options(**_GROUP).parquet(f"{path}/shards")
    sizes = spark.read.schema("sizes binary").parquet(f"{path}/shards")
    n, total = sizes.mapInArrow(_totals, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.parquet(f"{path}/totals")


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Queries of a block as arrays: for groups of ``at_once`` queries, the terms and, by term, the queries."""

    def __init__(self, rows: list[tuple[int | None, str]], df: dict[str, int], n: int, at_once: int) -> None:
        self.items = sorted({r[0] for r in rows}, key=lambda x: (x is None, x or 0))
        place = {item: i for i, item in enumerate(self.items)}
        self.groups = []
        by_group: defaultdict[int, defaultdict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, term in rows:
            if df.get(term):
                by_group[place[item] // at_once][term].append(place[item] % at_once)
        for g, held in sorted(by_group.items()):
            terms = sorted(held)
            self.groups.append((g * at_once, min(at_once, len(self.items) - g * at_once), terms, [_weight(n, df[t]) for t in terms], [np.array(sorted(held[t])) for t in terms]))


def best(scores: np.ndarray, docs: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` greatest ``scores`` above 0, equal ones by ascending ``docs``, in that order."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        over, level = at[scores[at] > least], at[scores[at] == least]
        room = top - len(over)
        if len(level) > room:
            level = level[np.argpartition(docs[level], room - 1)[:room]]
        at = np.concatenate([over, level])
    return at[np.lexsort((docs[at], -scores[at]))]


_LAST = np.int64(2**63 - 1)


def _search(block: Block, n: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, (terms, sizes, ptr, posting) in enumerate(zip(_terms(b), _cells(b, "sizes", np.int64), _cells(b, "ptr", np.int64), _cells(b, "posting", np.uint16), strict=True)):
                docs = b.column("docs")[k].values
                docs = pc.fill_null(docs, int(_LAST)).to_numpy(zero_copy_only=False)
                data = b.column("tf")[k].as_buffer()  # two bytes a posting, or four where some document needs them
                impact = _impacts(np.frombuffer(data, np.uint16 if data.size == posting.nbytes else np.int32), _lengths(sizes, n, total)[posting])
                for first, count, wanted, weights, queries in block.groups:
                    scores = np.zeros((count, len(docs)), np.int64)
                    rows = pc.index_in(pa.array(wanted, pa.string()), value_set=terms)
                    there = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
                    for t, row in zip(there.tolist(), rows.drop_null().to_pylist(), strict=True):
                        span = slice(ptr[row], ptr[row + 1])
                        add = weights[t] * impact[span]
                        where = posting[span]
                        if len(queries[t]) == 1:
                            scores[queries[t][0]][where] += add
                        else:
                            scores[queries[t][:, None], where] += add
                    for q in np.flatnonzero((scores > 0).any(1)).tolist():
                        at = best(scores[q], docs, top)
                        s, d = scores[q][at], docs[at]
                        if first + q in held:
                            s, d = np.concatenate([held[first + q][0], s]), np.concatenate([held[first + q][1], d])
                            at = best(s, d, top)
                            s, d = s[at], d[at]
                        held[first + q] = s, d
        items = np.repeat(list(held), [len(s) for s, _ in held.values()]).astype(np.int64)
        scores, docs = (np.concatenate([x[i] for x in held.values()] or [np.zeros(0, np.int64)]) for i in (0, 1))
        names = [block.items[i] for i in items]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(docs, mask=docs == _LAST), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return run


def _holding(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64)
        for b in batches:
            for held, ptr in zip(_terms(b), _cells(b, "ptr", np.int64), strict=True):
                rows = pc.index_in(wanted, value_set=held)
                there = rows.is_valid().to_numpy(zero_copy_only=False)
                total[there] += np.diff(ptr)[rows.drop_null().to_numpy()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, *, top: int = TOP, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, at_once: int = ROW_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of the index at ``path`` for each query (item_id, text).

    Queries go in blocks of about ``block_items`` and ``block_terms`` terms, one pass over the shards each;
    a shard holds the scores of ``at_once`` queries at a time.
    """
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    n, total = spark.read.schema("n long, total long").parquet(f"{path}/totals").first()
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM_RE), F.lit(0))
    asked = written(spark, queries.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct(), "asked")
    items, pairs = asked.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.count("*")).first()
    blocks = max(1, -(-items // block_items), -(-pairs // block_terms))
    salts = max(1, math.isqrt(shards.rdd.getNumPartitions()))
    results = []
    for k in range(blocks):
        rows = [(r.item_id, r.term) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]  # of about block_terms
        terms = sorted({t for _, t in rows})
        held = shards.select("terms", "ends", "ptr").mapInArrow(_holding(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        block = Block(rows, {terms[r.term]: r.df for r in held}, n, at_once)
        made = shards.mapInArrow(_search(block, n, total, top), "item_id long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % salts)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        near = made.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
        results.append(near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
        if blocks > 1:
            results[-1] = written(spark, results[-1], "found")
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


ORACLE_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_RE}')) AS term FROM documents
), postings AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY row
), totals AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM sizes
), frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term
), asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_RE}')) AS term FROM benchmark
), scored AS (
  SELECT item_id, p.row, p.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * t.n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * s.n * t.n) // t.total)))) AS BIGINT) AS score
  FROM asked JOIN postings p USING (term) JOIN frequencies USING (term) JOIN sizes s USING (row), totals t GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
