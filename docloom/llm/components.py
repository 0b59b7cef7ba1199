"""Connected components by alternating large-star and small-star steps over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, table_path, written


def _with_least(spark: SparkSession, links: DataFrame) -> tuple[DataFrame, str]:
    """Each link (u, v) with the least v of its u. The minima are written first, so that both sides
    of the join are plain exchanges and a node with very many links can be split."""
    path = table_path(spark, "least")
    least = written(spark, links.groupBy("u").agg(F.min("v").alias("least")), "least", path)
    return links.join(least, "u"), path


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the smallest node that it reaches.

    Links may repeat and run either way; self links are ignored, no links give an empty table. The
    links stay in tables of the shared folder; only their number and a checksum reach the driver.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = table_path(spark, "links")
    links = written(spark, links, "links", path)
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)))
    before, now = None, links.agg(mark.alias("m")).first().m
    while now != before:  # each step brings links nearer to stars, which stay as they are
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, p1 = _with_least(spark, both)
        step = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v").distinct()
        large = table_path(spark, "large")
        step = written(spark, step, "large", large)
        joined, p2 = _with_least(spark, step)
        step = joined.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = table_path(spark, "links")
        links = written(spark, step, "links", small)
        for old in (path, p1, p2, large):
            drop_table(spark, old)
        path = small
        before, now = now, links.agg(mark.alias("m")).first().m
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
