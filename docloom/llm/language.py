"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subword
from .common import beside_text, fold, least_ids, slices, with_text

UNKNOWN = "und"
FOLDS, HELD = 4, 2


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(spark: SparkSession, docs: DataFrame, *, max_docs: int = 3000, buckets: int = 2**16, held: int = HELD) -> subword.Model:
    """Learn from ``text`` and non-null ``lang`` of the rows outside the held-out fold.

    ``max_docs`` bounds the training documents, by the least hashes of their ids. An id on several
    rows is learned from once, by the least of its languages and texts; null ids are left out.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != held))
    some = spark.createDataFrame([(r.doc_id,) for r in least_ids(rows.select("doc_id").distinct(), max_docs)], "doc_id long")
    texts = rows.select("doc_id", "text", "lang").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.text", F.col("x.lang").alias("label"))
    data, langs = subword.bags_of(texts, max_docs, buckets, (3, 4, 5))
    return subword.train(data, langs, buckets=buckets, epochs=4)


def label(spark: SparkSession, docs: DataFrame, model: subword.Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, with ``lang_pred`` and its calibrated probability ``score``.

    A null text or one without a letter is ``und`` with score 0. Ties go to the first class in
    order. Repeated rows get the same answer; an empty table gives an empty table.
    """
    shared = spark.sparkContext.broadcast(model)
    frame = beside_text(docs, keep, text)
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    known = bool(model.classes) and isinstance(model.classes[0], str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        coder = model.coder()
        names = np.array([str(c) for c in model.classes] + [UNKNOWN], object)
        for whole in batches:
            whole = with_text(whole, text)
            for b in slices(whole, whole.num_columns - 1):
                texts = b.column(b.num_columns - 1).to_pylist()
                p = model.probabilities(coder, texts)
                best = p.argmax(1)
                score = p[np.arange(len(best)), best]
                bad = np.array([not known or t is None or not has_letter(t) for t in texts], bool)
                best[bad], score[bad] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=schema.names)

    return frame.mapInArrow(run, schema)


def rejects(score: str = "score", pred: str = "lang_pred", *, least: float = 0.5):
    """The pipeline's rejection: no language, or a calibrated probability under ``least``."""
    return (F.col(pred) == UNKNOWN) | (F.col(score) < least)
