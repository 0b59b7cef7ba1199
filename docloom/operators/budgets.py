"""Greedy requests under a budget, without going through a document item by item.

From each item the request that began there would end at a known place: an as-of lookup in the running
sums. That gives every item a pointer to the next beginning. The items where requests do begin are
those that pointers reach from the first, found by pointers of doubled reach: as many rounds as the
number of items has binary digits, and a document of any length spans tasks throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

CHUNK, SPAN = 4096, 1 << 20


def running(rows: DataFrame, name: str, value: Column, *, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (doc_id, pos, ..) with ``name``: the sum of ``value`` up to and with each row, in two levels."""
    own = rows.withColumns({"part": F.floor(F.col("pos") / chunk), "own": value})
    sums = own.groupBy("doc_id", "part").agg(F.sum("own").alias("sum"))
    sums = sums.select("doc_id", "part", (F.sum("sum").over(W.partitionBy("doc_id").orderBy("part")) - F.col("sum")).alias("base"))
    inner = F.sum("own").over(W.partitionBy("doc_id", "part").orderBy("pos"))
    return own.withColumn("inner", inner).join(sums, ["doc_id", "part"]).select(*rows.columns, (F.col("base") + F.col("inner")).alias(name))


def next_cuts(items: DataFrame, budget: int, *, extra: int = 0, most: int | None = None, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(doc_id, pos, next): where the request that begins at an item of ``items`` (doc_id, pos, size) ends, as the
    position after its last. Positions count from 0 without gaps; an item over the budget goes alone."""
    cost = F.col("size") + extra
    sums = running(items.select("doc_id", "pos", cost.cast("long").alias("cost")), "end", F.col("cost"), chunk=chunk)
    ends = sums.select("doc_id", F.col("end").alias("key"), F.lit(0).alias("kind"), F.col("pos").alias("last"), F.lit(None).cast("int").alias("pos"))
    asks = sums.select("doc_id", (F.col("end") - F.col("cost") + budget).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("last"), "pos")
    both = ends.unionByName(asks).withColumn("part", F.floor(F.col("key") / span))
    far = both.groupBy("doc_id", "part").agg(F.max("last").alias("far"))
    far = far.select("doc_id", "part", F.max("far").over(W.partitionBy("doc_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    near = F.max("last").over(W.partitionBy("doc_id", "part").orderBy("key", "kind", "last").rowsBetween(W.unboundedPreceding, W.currentRow))
    told = both.withColumn("near", near).where("kind = 1").join(far, ["doc_id", "part"])
    last = F.greatest(F.col("pos"), F.coalesce("near", F.lit(-1)), F.coalesce("far", F.lit(-1)))
    if most:
        last = F.least(last, F.col("pos") + (most - 1))
    return told.select("doc_id", "pos", (last + 1).cast("int").alias("next"))


def reached(cuts: DataFrame) -> DataFrame:
    """(doc_id, pos): the positions that pointers ``cuts`` (doc_id, pos, next) reach from position 0."""
    jumps = [written(cuts.select("doc_id", "pos", "next"), "cuts")]
    longest = jumps[0].agg(F.max("pos")).first()[0]  # one number
    if longest is None:
        return cuts.select("doc_id", "pos")
    while 1 << len(jumps) <= longest:
        ahead = jumps[-1].select("doc_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        more = jumps[-1].join(ahead, ["doc_id", "next"]).select("doc_id", "pos", F.col("far").alias("next"))
        more = written(more, "cuts")
        if more.isEmpty():
            break
        jumps.append(more)
    found = jumps[0].where("pos = 0").select("doc_id", "pos")
    sizes = jumps[0].groupBy("doc_id").agg(F.max("pos").alias("end"))
    for jump in reversed(jumps):
        to = found.join(jump, ["doc_id", "pos"]).select("doc_id", F.col("next").alias("pos"))
        found = written(found.unionByName(to).distinct(), "begun")
    return found.join(sizes, "doc_id").where("pos <= end").select("doc_id", "pos")


def batched(items: DataFrame, budget: int, *, extra: int = 0, most: int | None = None, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(doc_id, pos, size, batch): ``items`` with the number, from 0, of the request that each is in."""
    begun = reached(next_cuts(items, budget, extra=extra, most=most, chunk=chunk, span=span)).withColumn("first", F.lit(1))
    marked = items.select("doc_id", "pos", "size").join(begun, ["doc_id", "pos"], "left")
    return running(marked, "batch", F.coalesce("first", F.lit(0)), chunk=chunk).select("doc_id", "pos", "size", (F.col("batch") - 1).cast("int").alias("batch"))
