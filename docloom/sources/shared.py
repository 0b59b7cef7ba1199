"""Tables written once and read where they are needed again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one. A session in one process may go without: a folder
    of its machine serves then. On a cluster the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: later steps read it and do not make it again, and a lost executor costs
    one of them at most. The store deletes it when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/docloom-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never to be a broadcast. A table's size is taken from its files, in which
    numbers and marks of lines lie at a fraction of a byte each; in memory millions of rows come of it."""
    return df.hint("merge")
