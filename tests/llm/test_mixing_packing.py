"""Targets, knapsack fill, radix selection and optimal buckets against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, packing
from docloom.llm.common import find_words


def test_targets_stop_at_the_cap_and_share_the_excess():
    got = mixing.targets({"a": 10, "b": 10, None: 70}, lambda i: 1 + i % 3)
    assert got == {"a": 15.0, "b": 30.0, None: 45.0}
    got = mixing.targets({"a": 80, "b": 5, "c": 15}, lambda i: 1 + i % 3)
    assert got["b"] == 15 and got["c"] == 45 and got["a"] == 40
    assert mixing.targets({}, lambda i: 1) == {} and mixing.targets({"z": 0}, lambda i: 1) == {"z": 0.0}


@pytest.mark.parametrize("seed", range(12))
def test_fill_is_as_close_as_any_choice(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(set(rng.integers(0, 30, 5).tolist()))
    counts = rng.integers(1, 4, len(lengths)).tolist()
    budget = int(rng.integers(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 5))
    take = mixing.fill(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    got = sum(a * b for a, b in zip(lengths, take, strict=True))
    base = [c * budget // max(1, sum(a * b for a, b in zip(lengths, counts, strict=True))) for c in counts]
    sums = {sum(n * t for n, t in zip(lengths, x, strict=True)) for x in itertools.product(*(range(min(b, c), c + 1) for b, c in zip(base, counts, strict=True)))}
    assert got == max(s for s in sums if s <= budget)


def test_mixed_rows(spark):
    rows = [(i, "w " * (i % 7), ["s", "t", None][i % 3], 1) for i in range(120)] + [(500, "same text here", "s", 1)] * 40 + [(None, None, "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    docs = docs.withColumns({"size": F.lit("clash"), "sk": F.lit(1), "h": F.lit(2), "cut": F.lit(3), "doc": F.lit(4)})
    one, two = mixing.mixed(spark, docs).toPandas(), mixing.mixed(spark, docs).toPandas()
    assert len(one) == len(rows) and sorted(one["__copies"]) == sorted(two["__copies"])
    assert one["__copies"].max() <= 3
    for source, part in one.groupby("source", dropna=False):
        taken = (part["__size"] * part["__copies"]).sum()
        assert part["__source_size"].iloc[0] == part["__size"].sum()
        assert 0 <= part["__target"].iloc[0] - taken < 7
    assert mixing.mixed(spark, docs.where(F.lit(False))).count() == 0
    assert mixing.repeated(mixing.mixed(spark, docs), docs.columns).count() == one["__copies"].sum()


def test_radix_selection_in_a_crowded_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("three words here").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mixed(spark, docs).groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("t"), F.first("__target").alias("g")).collect()
    assert all(0 <= r.g - r.t < 3 for r in got)


def test_selection_among_equal_rows(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("a").alias("source"))
    docs = docs.unionByName(spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.lit("b").alias("source")))
    got = mixing.mixed(spark, docs).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("__size") * F.col("__copies")).alias("t"), F.first("__target").alias("g")).collect()
    assert {r.source: r.n for r in got} == {"a": 5000, "b": 2500}
    assert all(0 <= r.g - r.t < 3 and r.t for r in got)
    assert any(r.source == "a" and r.g % 15000 for r in got)  # a part is taken


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_have_the_least_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(set(rng.integers(0, 60, 9).tolist()))
    counts = rng.integers(1, 9, len(lengths)).tolist()
    pad = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
    best = min(pad([*x, lengths[-1]]) for x in itertools.combinations(lengths[:-1], 2))
    got = packing.boundaries(lengths, counts, 3)
    assert len(got) == 3 and pad(got) == best
    assert packing.boundaries([], [], 3) == [] and packing.boundaries([5], [2], 3) == [5]


def test_packed_rows(spark):
    rows = [(i % 90, "w " * (i % 23)) for i in range(400)] + [(None, None)] * 5 + [(7, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = packing.packed(spark, docs).toPandas()
    assert len(got) == len(rows) and (got.padding >= 0).all()
    for (_, _), part in got.groupby(["bucket", "batch"]):
        assert len(part) * max(1, part.bucket_len.iloc[0]) <= max(packing.BUDGET, part.bucket_len.iloc[0])
        assert sorted(part.place) == list(range(len(part)))
    assert packing.packed(spark, docs.where(F.lit(False))).count() == 0


def test_boundaries_stay_exact_with_very_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "n_words", lambda: F.col("text").cast("long"))
    docs = spark.range(200_101).select(F.col("id").alias("doc_id"), (F.col("id") + 1).cast("string").alias("text"))
    got = packing.packed(spark, docs, buckets=2)
    assert [r.bucket_len for r in got.select("bucket_len").distinct().orderBy("bucket_len").collect()] == packing.boundaries(list(range(1, 200_102)), [1] * 200_101, 2)


def test_targets_of_many_sources_are_those_of_the_plain_version(spark):
    rng = np.random.default_rng(3)
    sizes = {None if i == 0 else f"s{rng.integers(0, 10**9)}é{i}": int(x) for i, x in enumerate(np.concatenate([rng.integers(0, 50, 150), rng.integers(1000, 10**6, 50)]))}
    table = spark.createDataFrame([("n" if s is None else f"s{s}", n) for s, n in sizes.items()], "sk string, s long").repartition(7)
    want = mixing.targets(sizes, lambda i: 1 + i % 3)
    got = {None if r.sk == "n" else r.sk[1:]: (r.source_size, r.target) for r in mixing.targets_of(spark, table, lambda i: 1 + i % 3).collect()}
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(abs(got[s][1] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)
    assert mixing.targets_of(spark, table.where("s < 0"), lambda i: 1 + i % 3).count() == 0


def test_boundaries_of_very_many_lengths():
    rng = np.random.default_rng(8)
    lengths = np.cumsum(rng.integers(1, 4, 300_000))
    counts = rng.integers(1, 9, 300_000)
    whole = lambda a, b: lengths[b - 1] * counts[a:b].sum() - (lengths[a:b] * counts[a:b]).sum()
    C, S = np.cumsum(counts), np.cumsum(lengths * counts)
    cost = lengths[:-1] * C[:-1] - S[:-1] + lengths[-1] * (C[-1] - C[:-1]) - (S[-1] - S[:-1])
    k = packing.boundaries(lengths, counts, 2)
    at = int(np.searchsorted(lengths, k[0])) + 1
    assert k[1] == lengths[-1] and whole(0, at) + whole(at, len(lengths)) == cost.min()


def test_words_are_counted_without_a_string_each(spark):
    texts = [None, "", " ", "\t\n\r ", "a", " a ", "a\x0bb\x0cc", "   x", "😀 😀😀\n", "\x1c\x1d \x00 \x7f", "one  two\r\nthree", "é" * 3000 + " " * 3000 + "x", "$1 \\1 $"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, text string")
    counted = docs.select("i", mixing.n_words().alias("n"))
    assert {r.i: r.n for r in counted.collect()} == {i: len(find_words(x or "")) for i, x in enumerate(texts)}
    assert "regexp_extract_all" not in counted._jdf.queryExecution().executedPlan().toString()
