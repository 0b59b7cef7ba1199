"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subword
from .common import beside_text, fold, least_ids, slices, with_text, written

FOLDS, HELD = 5, 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_docs: int = 8_000, buckets: int = 2**19, held: int = HELD) -> subword.Model:
    """Learn ``labels.toxic`` from the texts of labelled rows outside the held-out fold.

    ``max_docs`` bounds the training documents, by the least hashes of their ids: toxic ones for a
    quarter of them at most, clean ones for the rest, so a rare class is learned from a fixed number.
    A document counts as toxic if any of its labels says so, and an id on several rows is learned
    from once, by the least of its texts. Null labels, ids and texts are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != held))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    known = written(spark, known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    chosen = least_ids(known.where("label = 1"), max_docs // 4)
    chosen += least_ids(known.where("label = 0"), max_docs - len(chosen))
    some = spark.createDataFrame([(r.doc_id, r.label) for r in chosen], "doc_id long, label int")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    grams = (2, 3, 4, 5, 6)
    data, marks = subword.bags_of(texts, max_docs, buckets, grams)
    return subword.train(data, marks, buckets=buckets, grams=grams, dim=4, epochs=6, rate=4.0, rare=0.002)


def scored(spark: SparkSession, docs: DataFrame, model: subword.Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, with ``score`` (probability of toxic) and ``predicted`` (score >= 0.5).

    Null and empty texts get the score of the bias alone. Repeated rows get the same answer; an
    empty table gives an empty table.
    """
    shared = spark.sparkContext.broadcast(model)
    frame = beside_text(docs, keep, text)
    schema = docs.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        coder = model.coder()
        for whole in batches:
            whole = with_text(whole, text)
            for b in slices(whole, whole.num_columns - 1):
                p = model.probabilities(coder, b.column(b.num_columns - 1).to_pylist())
                score = p[:, model.classes.index(1)] if 1 in model.classes else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return frame.mapInArrow(run, schema)
