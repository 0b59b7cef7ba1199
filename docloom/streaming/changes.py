"""File changes as streams: debounce by session windows, and changes that really change something."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(events: DataFrame) -> DataFrame:
    """(path, ts, fingerprint, event_id) of an event table."""
    return events.select(F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "ts", F.col("value").alias("fingerprint"), "event_id")


def sessions(rows: DataFrame, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """(path, start, n): changes of a path with no longer pause than ``gap``; works on streams with ``late``."""
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), "n")


def debounced(rows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(path, ts, event_id) of the changes that fire: one pending task for all paths, so a change fires if
    none of any path comes within ``seconds`` after it.

    Time is cut in buckets of that length. Of a bucket only the last change can fire, and only the first
    of the next bucket can stop it, so buckets meet by an equal join and never in one task.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    bucket = F.floor(F.unix_micros("ts") / int(seconds * 1e6))
    ends = rows.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("ts", "event_id", "path")).alias("last"), F.min("ts").alias("first"))
    nxt = ends.select((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("following"))
    alone = F.col("following").isNull() | (F.unix_micros("following") - F.unix_micros("last.ts") >= int(seconds * 1e6))
    return ends.join(nxt, "bucket", "left").where(alone).select("last.path", "last.ts", "last.event_id")


def heard(rows: DataFrame, own: DataFrame, seconds: float) -> DataFrame:
    """Changes that come when no write of our own (``own`` with ``ts``) was made within ``seconds`` before.

    In buckets of that length the first write of the same bucket and the last of the one before decide,
    so writes meet changes by equal joins, two numbers a bucket.
    """
    size = int(seconds * 1e6)
    at = lambda df: df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bucket", F.floor(F.col("us") / size))
    ends = at(own).groupBy("bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    before = ends.select((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("late"))
    told = at(rows).join(ends.select("bucket", "first"), "bucket", "left").join(before, "bucket", "left")
    quiet = F.coalesce(F.col("first") <= F.col("us"), F.lit(False)) | F.coalesce(F.col("us") - F.col("late") < size, F.lit(False))
    return told.where(~quiet).drop("us", "bucket", "first", "late")


def real_changes(rows: DataFrame) -> DataFrame:
    """Changes whose fingerprint differs from the last one of the path."""
    before = F.lag("fingerprint").over(W.partitionBy("path").orderBy("ts", "event_id"))
    return rows.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("fingerprint"))).drop("before")


def real_changes_stream(rows: DataFrame) -> DataFrame:
    """The same on a stream: the last fingerprint of each path is state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values(["ts", "event_id"])
            before = part["fingerprint"].shift(1)
            before.iloc[0] = last
            yield part[part["fingerprint"] != before][["path", "ts", "fingerprint", "event_id"]]
            last = part["fingerprint"].iloc[-1]
        state.update((last,))

    out = "path string, ts timestamp, fingerprint double, event_id long"
    return rows.groupBy("path").applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def inbox(files: DataFrame, root: str, library: DataFrame) -> DataFrame:
    """(path) of ready Markdown files in ``root`` or one folder below it that the library does not have.

    Pictures' folders, hidden files and notes of clips are passed over. Works on a stream of files too.
    """
    low, rest = F.lower("path"), F.substring(F.col("path"), len(root) + 2, 1 << 30)
    near = F.startswith("path", F.lit(f"{root}/")) & rest.rlike("^[^./][^/]*(/[^./][^/]*)?$") & ~F.lower(rest).startswith("figures/")
    ready = low.rlike(r"\.(md|markdown)$") & ~F.endswith(low, F.lit("_forage.md"))
    have = library.select(F.lower("path").alias("key"))
    return files.where(near & ready).select("path", low.alias("key")).distinct().join(have, "key", "left_anti").select("path")
