"""Shared plumbing of the training-data operators: shared tables, batching, word codes."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII space, tab, LF, VT, FF and CR.
WORD_RE = r"[^\x20\x09-\x0D]+"
find_words = re.compile("[^\x20\x09-\x0d]+").findall
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z alone (``str.lower`` where the text is plain ASCII)."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session in one process may go without one: a folder of
    its machine serves then. On a cluster ``spark.checkpoint.dir`` has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


_folders: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; its store deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"
    if path not in _folders:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders.add(path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = path or table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: the text is empty)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fold_of(value: int | None, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def least_ids(ids: DataFrame, bound: int, seed: int = 17) -> list:
    """At most ``bound`` of the distinct rows ``ids`` (``doc_id`` first): those of the least hash of the id."""
    return [r for r in ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound).collect()]


def sampled(df: DataFrame, key: str, eligible: int, bound: int) -> DataFrame:
    """Rows whose hashed id falls under bound/eligible: about ``bound`` rows, the same in each run."""
    if eligible <= bound:
        return df
    share = int(2**30 * bound / eligible)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(2**30)) < share)


def slices(batch: pa.RecordBatch, text_at: int, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``max_bytes`` of text, and one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(text_at).nbytes / n
    if sizes * n <= max_bytes:
        yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def beside_text(docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns and last, for Python, ``text`` as ``__text``; a ``text`` of the form ``doc.text`` is not sent
    beside the column ``doc`` of ``keep`` that holds it."""
    return docs.select(*keep) if "." in text else docs.select(*keep, F.col(text).alias("__text"))


def with_text(batch: pa.RecordBatch, text: str = "text") -> pa.RecordBatch:
    """A batch of ``beside_text`` with the text as its last column, without a copy."""
    if "." not in text:
        return batch
    column, field = text.split(".", 1)
    return batch.append_column("__text", batch.column(column).field(field))


def runs_of(words: list[str], chars: int = 200_000) -> Iterator[list[str]]:
    """``words`` in runs of about ``chars`` characters, so that what is computed of a run stays small."""
    start, held = 0, 0
    for i, word in enumerate(words):
        held += len(word)
        if held >= chars:
            yield words[start : i + 1]
            start, held = i + 1, 0
    if start < len(words):
        yield words[start:]


class WordCodes(dict):
    """Word -> small integer, first come first numbered; ``fresh`` lists words that have no attributes yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return code


class Coder:
    """Texts -> arrays of word codes, with per-word attributes computed once a worker for each word.

    ``attributes(words)`` returns a tuple of arrays, one row for each new word. Beyond ``limit``
    distinct words, or 20 characters to each of them, the cache starts anew, so memory stays bounded
    and results do not change.
    """

    def __init__(self, attributes: Callable[[list[str]], tuple[np.ndarray, ...]], lower=lower_ascii, limit: int = 600_000, words=find_words) -> None:
        self.attributes, self.lower, self.limit, self.words = attributes, lower, limit, words
        self.codes, self.parts = WordCodes(), []
        self.columns: tuple[np.ndarray, ...] = ()

    def full(self) -> bool:
        return len(self.codes) > self.limit or self.codes.chars > 20 * self.limit

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(codes of all words, words of each text, attributes by code)."""
        if self.full():
            self.codes, self.columns = WordCodes(), ()
        get, lower, find_words = self.codes.__getitem__, self.lower, self.words
        found, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = find_words(lower(text))
                counts[i] = len(words)
                found.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.codes.fresh:
            runs = [self.attributes(words) for words in runs_of(self.codes.fresh)]
            self.codes.fresh = []
            self.columns = tuple(map(np.concatenate, zip(*([self.columns] if self.columns else []), *runs, strict=True)))
        codes = np.concatenate(found) if found else np.zeros(0, np.int64)
        return codes, counts, list(self.columns)


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one row for each word) within each text, in double precision."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if values.ndim == 1:
        return np.bincount(owner, values, len(counts))
    return np.stack([np.bincount(owner, values[:, c], len(counts)) for c in range(values.shape[1])], 1)
