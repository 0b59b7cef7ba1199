"""The queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_template, language, lbl, learned_ann, lexical, merge_counts, mixing, order_minhash, packing, periodic, simhash, token_corpus, toxicity
from .common import fold, read, table_path, written


def op1_range_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = table_path(spark, "corpus")
    token_corpus.write_corpus(spark, read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_corpus.read_corpus(spark, path)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(spark, simhash.with_fingerprint(read(spark, sf_dir, "documents"), keep=["doc_id"]), "fingerprints")
    least = written(spark, simhash.near_duplicates(spark, rows, of="doc_id"), "components")
    return rows.join(least, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extracted(spark, read(spark, sf_dir, "pages"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, counts = lbl.fit(spark, docs)
    return lbl.scored(spark, docs, model, counts)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, read(spark, sf_dir, "labels"))
    out = toxicity.scored(spark, docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", toxicity.FOLDS) == toxicity.HELD).alias("held_out"), "score", "predicted")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_pairs(spark, read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(spark, docs)
    out = language.label(spark, docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", language.FOLDS) == language.HELD).alias("held_out"), "lang_pred", "score")


def op10_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return learned_ann.nearest(spark, rows, rows.where("vec_id % 100 = 0"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "index")
    lexical.build(spark, read(spark, sf_dir, "documents"), path)
    return lexical.search(spark, path, read(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return merge_counts.counted(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic(read(spark, sf_dir, "documents"), planted=True)


QUERIES = {f.__name__: f for f in (op1_range_ans, op2_simhash, op3_html_template, op4_log_bilinear, op5_mixing, op6_toxicity, op7_order_minhash, op8_packing, op9_language_id, op10_learned_ann, op11_lexical_search, op12_token_counts, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op8_packing": packing.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL}
