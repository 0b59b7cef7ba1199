"""Mixing sources to target weights by subset sums over exact lengths.

Each source's target is its share by weight, up to ``cap`` times what it has; what is over goes to
the others by weight. A source is taken whole as often as its target holds it. What remains is filled
from counts of documents by exact length: first the same share of each length, then the longest that
still fit, then a bounded-knapsack dynamic programme over the last words. Which documents of a length
are taken is settled by a seeded hash: those below a cut value, found by radix selection on counts,
so no group of equal lengths is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

CAP = 3


def n_words(text: str = "text") -> Column:
    """Words, by their first characters: ``regexp_count`` would hold every word of a text as a string."""
    first = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]*+([^\x20\x09-\x0D]?+)[^\x20\x09-\x0D]*+", "$1")
    return F.coalesce(F.length(first), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weight: Callable[[int], float], cap: float = CAP) -> dict[str | None, float]:
    """Target of each source; sources stand in code-point order, null last, and weigh by their place.

    Shares add up to all sizes, as far as the caps allow. No sources, or none with words: zeros.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: weight(i) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def targets_of(spark: SparkSession, sizes: DataFrame, weight: Callable, cap: int = CAP) -> DataFrame:
    """(sk, source_size, target) of each row (sk, s) of ``sizes``, as ``targets`` has them, for any number of sources.

    ``weight`` is applied to the place, a Column. Sources over their cap at one level are so at every
    higher one, so a round needs no more than the level: one number goes to the driver each time.
    """
    by = [F.col("sk") == "n", F.col("sk")]
    dealt = written(spark, sizes.repartitionByRange(*by).select("sk", "s", F.spark_partition_id().alias("pid")), "sources")
    first, starts = 0, []
    for r in sorted(dealt.groupBy("pid").count().collect()):  # a row a partition
        starts.append((r.pid, first))
        first += r["count"]
    starts = spark.createDataFrame(starts, "pid int, first long")
    place = F.row_number().over(W.partitionBy("pid").orderBy(*by)) - 1 + F.col("first")
    rows = written(spark, dealt.join(F.broadcast(starts), "pid").select("sk", "s", weight(place).cast("double").alias("w")), "source-weights")
    total = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    left, open_, closed = float(total.s), total.w, 0
    while open_:
        over = F.lit(left) * F.col("w") / F.lit(open_) > cap * F.col("s")
        r = rows.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap * F.col("s")).otherwise(0)).alias("s"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not r.n or r.n == closed:
            break
        left, open_, closed = float(total.s - r.s), r.w, r.n
    most = F.col("s").cast("double") * cap
    goal = F.lit(left) * F.col("w") / F.lit(open_ or 1.0) if open_ else most
    return rows.select("sk", F.col("s").alias("source_size"), F.least(goal, most).alias("target"))


def fill(lengths: list[int], counts: list[int], budget: int, *, reserve: int = 20_000) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget`` or just under."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if lengths[i] and left > reserve:
            more = min(counts[i] - take[i], max(0, left - reserve) // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    reach, steps = 1, []  # bit b of reach: some choice comes to b words; before each step for the way back
    full = (1 << (left + 1)) - 1
    for i in reversed(order):
        n, spare = lengths[i], counts[i] - take[i]
        if not 0 < n <= left:
            continue
        spare, part = min(spare, left // n), 1
        while spare and not reach >> left & 1:
            now = min(part, spare)
            steps.append((reach, i, now))
            reach |= reach << (n * now) & full
            spare, part = spare - now, part * 2
    at = reach.bit_length() - 1
    for before, i, now in reversed(steps):
        if not before >> at & 1:
            take[i] += now
            at -= now * lengths[i]
    return take


def _cuts(spark: SparkSession, rows: DataFrame, wanted: DataFrame, *, small: int = 4096) -> DataFrame:
    """(sk, size, cut, tie_take, ties): of each length the hash of the last row taken.

    ``wanted`` has (sk, size, n), 0 < n < rows of that length. Radix selection: 8 bits of the hash at
    a time, until a bucket is small; then ranks within that bucket.
    """
    live, out, shift = wanted.withColumn("prefix", F.lit(0).cast("long")), None, 63
    while True:
        before, shift = shift, max(0, shift - 8)  # the last step has 7 bits
        inside = rows.join(live, ["sk", "size"]).where(F.shiftright("h", before) == F.col("prefix"))
        hist = inside.groupBy("sk", "size", "n", F.shiftright("h", shift).alias("bucket")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy("sk", "size").orderBy("bucket"))
        cut = hist.withColumn("upto", upto).where("upto >= n and upto - c < n")
        cut = written(spark, cut.select("sk", "size", (F.col("n") - F.col("upto") + F.col("c")).alias("n"), F.col("bucket").alias("prefix"), "c"), "cuts")
        done = cut if shift == 0 else cut.where(F.col("c") <= small)
        found = rows.join(done, ["sk", "size"]).where(F.shiftright("h", shift) == F.col("prefix"))
        rank = W.partitionBy("sk", "size").orderBy("h")
        if shift == 0:  # one hash value each: equal rows
            part = done.select("sk", "size", F.col("prefix").alias("cut"), F.col("n").alias("tie_take"), F.col("c").alias("ties"))
        else:
            found = found.select("sk", "size", "n", "h", F.row_number().over(rank).alias("r"), F.count("*").over(W.partitionBy("sk", "size", "h")).alias("ties"), F.rank().over(rank).alias("first"))
            part = found.where("r = n").select("sk", "size", F.col("h").alias("cut"), (F.col("n") - F.col("first") + 1).cast("long").alias("tie_take"), "ties")
        out = part if out is None else out.unionByName(part)
        live = cut.where(F.col("c") > small).select("sk", "size", "n", "prefix")
        if shift == 0 or live.isEmpty():
            return written(spark, out, "selected")


def mixed(spark: SparkSession, docs: DataFrame, *, weight: Callable = lambda i: 1 + i % 3, cap: int = CAP, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` with __size, __source_size, __target and __copies, the times it is taken.

    Sizes are words; a null text has none. A null ``source`` is a source of its own, last in order.
    The hash covers all columns, so reruns agree; rows equal in all columns are interchangeable.
    """
    cols = docs.columns
    sk = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    h = F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))
    # the row as one value, so that no column of the input can clash with those used here
    keyed = docs.select(F.struct(*cols).alias("doc"), sk.alias("sk"), n_words().alias("size"), h.alias("h"))
    rows = written(spark, keyed.select("sk", "size", "h"), "sizes")
    hist = written(spark, rows.groupBy("sk", "size").agg(F.count("*").alias("c")), "lengths")
    goal = targets_of(spark, hist.groupBy("sk").agg(F.sum(F.col("c") * F.col("size")).alias("s")), weight, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).otherwise(0).cast("int")
    per_source = written(spark, goal.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "source-plan")
    n_sources = per_source.count()
    few = (lambda df: F.broadcast(df)) if n_sources <= 100_000 else (lambda df: df)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        n = fill(group["size"].tolist(), group["c"].tolist(), int(group["rest"].iloc[0]))
        return pd.DataFrame({"sk": group["sk"], "size": group["size"], "n": n, "c": group["c"]})

    # a group is the distinct lengths of one source, never its documents
    counts = hist.join(few(per_source), "sk").select("sk", "size", "c", "rest").groupBy("sk").applyInPandas(choose, "sk string, size long, n long, c long")
    counts = written(spark, counts, "length-counts")
    cut = _cuts(spark, rows, counts.where("n > 0 and n < c").select("sk", "size", "n"))
    all_ = F.lit((1 << 63) - 1)
    cut = cut.unionByName(counts.where("n = c").select("sk", "size", all_.alias("cut"), F.lit(1).cast("long").alias("tie_take"), F.lit(1).cast("long").alias("ties")))
    cut = written(spark, cut, "cuts")
    some = (lambda df: F.broadcast(df)) if cut.count() <= 200_000 else (lambda df: df)
    told = keyed.join(few(per_source), "sk").join(some(cut), ["sk", "size"], "left")
    extra = [F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")]
    split = "ifnull(h = cut and tie_take < ties, false)"
    chosen = F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("int")
    out = told.where(f"not {split}").select("doc.*", *extra, (F.col("whole") + chosen).alias("__copies"))
    if not cut.where("tie_take < ties").isEmpty():  # of equal rows some are taken once more, some not
        first = [F.first(c).alias(c) for c in ("doc", "source_size", "target", "whole", "tie_take", "ties")]
        equal = told.where(split).groupBy("sk", "size", "h").agg(*first)
        equal = equal.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "ties")))
        out = out.unionByName(equal.select("doc.*", *extra, (F.col("whole") + (F.col("__i") <= F.col("tie_take")).cast("int")).alias("__copies")))
    return out


def repeated(docs: DataFrame, cols: list[str]) -> DataFrame:
    """Each row as often as it is taken."""
    return docs.withColumn("__i", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*cols)
