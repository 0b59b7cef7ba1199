"""Token-id output: whole texts to ids, ids to a range-coded corpus, and back.

A corpus is a folder with three Parquet tables, so it lies in any store that Spark writes to and a
lost task is simply written again: ``table`` (id, freq) is the shared frequency table, ``shards``
(shard, first, n) says where each shard begins, and ``blocks`` (shard, seq, doc_ids, block) holds the
coded blocks of ``rans`` in ascending document order.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import drop_table, slices, table_path

END = 2
BLOCK_IDS = 1 << 20
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe
#: A byte-level tokenizer's pre-tokens never cross from a non-space to a space, from a letter to
#: ASCII punctuation, or back from it to a space, so a text's ids are those of these pieces in turn.
pieces = re.compile(f"[{_WS}]*[{_LETTER}]+(?=[{_WS}{_MARK}]|\\Z)|[{_MARK}]+(?=[{_WS}]|\\Z)|[{_WS}]*[^{_WS}]+|[{_WS}]+").findall


_word = re.compile(f" ?[{_LETTER}]+").fullmatch
_id = attrgetter("id")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: a printable byte stands for itself, the others for 256 and up in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts by the tokenizers library; a piece is encoded when it is first met.

    Two generations of pieces are kept, ``limit`` each: when the new one is full it becomes the old
    one, and pieces met again move to the new. A piece of over ``longest`` characters is encoded each
    time. So the bytes held are bounded, and what is frequent stays.
    A word alone is one pre-token of a byte-level tokenizer, so the library's model takes it directly.
    A tokenizer that is not plainly byte-level, or normalises, gets whole texts instead of pieces.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.longest, self.old = Tokenizer.from_file(path), limit, longest, {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.letters = "H" if self.dtype.itemsize == 2 else "I", _byte_letters()
        self.tokenize, self.blank = self.tokenizer.model.tokenize, chr(self.letters[32])
        self.by_piece = self._byte_level()
        tried = [" the", "The", " éçü", "x", " Aßy", "internationalisation"]
        self.direct = self.by_piece and all(self._direct(w) == self._whole(w) for w in tried)

    def _byte_level(self) -> bool:
        """Whether pre-tokens are those of the byte-level expression alone, without a prefix or a normaliser,
        and no added token could stand across pieces."""
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        inside = all(pieces(t["content"]) == [t["content"]] and not (t.get("lstrip") or t.get("rstrip")) for t in told.get("added_tokens", []))
        return plain and inside and told.get("normalizer") is None and told["model"].get("type") == "BPE"

    def _direct(self, word: str) -> list[int]:
        plain = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return list(map(_id, self.tokenize(plain)))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array(self.code, self._direct(piece) if self.direct and _word(piece) else self._whole(piece)).tobytes()
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, in ``dtype``."""
        if not self.by_piece:
            return [array(self.code, self._whole(text)).tobytes() if text else b"" for text in texts]
        get, out = self.__getitem__, []
        gc.disable()  # tokens are many and in no cycles
        try:
            for text in texts:
                out.append(b"".join(map(get, pieces(text))) if text else b"")
                if len(self) > self.limit:
                    self.old = dict(self)
                    self.clear()
        finally:
            gc.enable()
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a worker: pieces met in one task are known in the next."""
    return Encoder(path)


def tokenized(docs: DataFrame, vocabulary: str, *, end: int = END) -> DataFrame:
    """(doc_id, tie, place, ids, width, counts) of every row; ids end with ``end``. Null and empty texts have ``end`` alone.

    Each task adds a row without ids, whose ``counts`` are pairs of an id and its occurrences in the task.
    """
    frame = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        last = np.array([end], encoder.dtype).tobytes()
        names, total = ["doc_id", "tie", "place", "ids", "width", "counts"], np.zeros(0, np.int64)
        for whole in batches:
            for b in slices(whole, 3):
                ids = [x + last for x in encoder.encode(b.column(3).to_pylist())]
                c = np.bincount(np.frombuffer(b"".join(ids), encoder.dtype), minlength=len(total))
                c[: len(total)] += total
                total = c
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary()), pa.array([encoder.dtype.itemsize] * b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([np.stack([at, total[at]]).tobytes()], pa.binary())], names=names)

    return frame.mapInArrow(run, "doc_id long, tie long, place long, ids binary, width int, counts binary")


def _ids(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if width == 2 else "<u4").astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoder.cache_clear()  # the pieces are not needed from here on
    total = np.zeros(0, np.int64)
    for b in batches:
        for cell in b.column(0):
            at, n = np.frombuffer(cell.as_buffer(), np.int64).reshape(2, -1)
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(at[-1] + 1 - len(total), np.int64)])
            total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def write_corpus(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, *, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write ``docs`` (doc_id, text) to ``path`` in ascending doc_id order, null ids first.

    Rows with one doc_id stand in the order of a hash of their texts; equal rows, however many, may be
    dealt to several tasks. The ids of all rows are counted
    (a row for each id in use reaches the driver); texts are encoded once and only ids are shuffled.
    A block ends with the first document that fills it, so a very long one makes a longer block.
    """
    raw_path = table_path(spark, "ids")
    made = tokenized(docs, vocabulary, end=end)
    made.write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(made.schema).parquet(raw_path)
    found = raw.select("counts").where("counts is not null").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    table = rans.Table.of_counts(counts)
    shared = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        table = rans.Table(shared.value)
        shard, seq, first = TaskContext.get().partitionId(), 0, 0
        owners: list[int | None] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, first
            ids, sizes = np.concatenate(held), np.array([len(x) for x in held])
            block = rans.encode(ids, sizes, first, table)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([owners], pa.list_(pa.int64())), pa.array([block], pa.binary())], names=["shard", "seq", "n", "doc_ids", "block"])
            seq, first = seq + 1, first + len(ids)
            owners.clear()
            held.clear()
            return row

        size = 0
        for b in batches:
            for doc, cell, width in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                owners.append(doc)
                held.append(_ids(cell.as_buffer(), width))
                size += len(held[-1])
                if size >= block_ids:
                    yield close()
                    size = 0
        if held:
            yield close()

    ordered = raw.where("ids is not null").repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "ids", "width")
    blocks = ordered.mapInArrow(run, "shard int, seq int, n long, doc_ids array<long>, block binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(spark, raw_path)
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row a partition
    shards, at = [], 0
    for r in sorted(sizes):
        shards.append((r.shard, at, r.n))
        at += r.n
    spark.createDataFrame(shards, "shard int, first long, n long").coalesce(1).write.parquet(f"{path}/shards")
    rows = [(int(i), int(table.freq[i])) for i in np.flatnonzero(table.freq)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")


def read_corpus(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and on demand ids) of every document of a corpus.

    Each block decodes alone and its checksum is held against its ids.
    """
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint64)
    for r in rows:
        freq[r.id] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for b in batches:
            for shard_first, owners, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                block = rans.Block.parse(data.as_py())
                ids = block.decode(table).astype("<u4")
                ends = np.cumsum(block.sizes)
                begins = ends - block.sizes
                parts = [ids[s:e] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(owners, pa.int64()), pa.array(shard_first + block.first + begins), pa.array(block.sizes), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    blocks = spark.read.schema("shard int, seq int, n long, doc_ids array<long>, block binary").parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, first long, n long").parquet(f"{path}/shards")  # a row a partition of the writer
    placed = blocks.join(F.broadcast(shards.select("shard", "first")), "shard").select("first", "doc_ids", "block")
    return placed.mapInArrow(run, schema)
