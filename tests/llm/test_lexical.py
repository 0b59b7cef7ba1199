"""Search over shards against the rule written out for every pair of a query and a document."""

import glob
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import lexical


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if bag[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


@pytest.fixture
def tables(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "naïve", "B2b", "中文"]

    def text(n):
        return rng.choice([" ", ", ", "-", "  "]).join(rng.choice(words[: rng.choice([5, 30, 65])]) for _ in range(n))

    docs = [(i, text(rng.randrange(30)), "x") for i in range(400)]
    docs += [(900 + i, "w1 w2 w3 same", "x") for i in range(80)] + [(7, "w1 w2 w3 same", "x"), (None, "w1 w2 w3 same", "x"), (901, None, "x"), (902, "", "x"), (903, " .,!", "x"), (904, "w4 " * 30_000, "x"), (905, "w5 " * 70_000, "x")]
    rng.shuffle(docs)
    items = [(i, text(rng.randrange(8)), 1) for i in range(30)] + [(50, "SAME w1", 1), (50, "w2 w2", 1), (51, None, 1), (52, "nowhere", 1), (None, "same", 1), (53, "", 1)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5), spark.createDataFrame(items, "item_id long, text string, rank int")


def answers(spark, path, items, **how):
    return sorted((tuple(r) for r in lexical.search(spark, path, items, **how).collect()), key=repr)


@pytest.mark.parametrize("top", [1, 50])
def test_best_documents(spark, tables, tmp_path, top):
    docs, items, documents, queries = tables
    lexical.build(spark, documents, f"{tmp_path}/i")
    assert answers(spark, f"{tmp_path}/i", queries, top=top) == plain([d[:2] for d in docs], [q[:2] for q in items], top)


def test_blocks_and_small_shards(spark, tables, tmp_path):
    """Queries over several blocks and groups, documents over many shards: the same rows."""
    docs, items, documents, queries = tables
    lexical.build(spark, documents, f"{tmp_path}/i", shard_rows=7)
    assert spark.read.parquet(f"{tmp_path}/i/shards").count() > 60
    assert answers(spark, f"{tmp_path}/i", queries, top=20, block_items=10, at_once=3) == plain([d[:2] for d in docs], [q[:2] for q in items], 20)


def test_empty_tables(spark, tables, tmp_path):
    _, _, documents, queries = tables
    lexical.build(spark, documents.limit(0), f"{tmp_path}/e")
    assert answers(spark, f"{tmp_path}/e", queries) == []
    lexical.build(spark, documents, f"{tmp_path}/i")
    assert answers(spark, f"{tmp_path}/i", queries.limit(0)) == []


def test_ties_are_cut_by_document():
    scores, docs = np.array([5, 7, 5, 0, 5, 9, -1]), np.array([40, 3, 10, 1, 20, 8, 2])
    assert lexical.best(scores, docs, 4).tolist() == [5, 1, 2, 4]
    assert lexical.best(scores, docs, 50).tolist() == [5, 1, 2, 4, 0]
    assert lexical.best(np.zeros(3, np.int64), docs[:3], 2).tolist() == []


def test_impacts_stay_exact_beyond_64_bits():
    got = lexical.impacts(np.array([1, 3]), np.array([10**7, 10]), 10**13, 5 * 10**15)
    assert got.tolist() == [(10**9 * tf) // (1000 * tf + 20 * (50 + (50 * n * 10**13) // (5 * 10**15))) for tf, n in ((1, 10**7), (3, 10))]


def test_row_groups_are_small(spark, tmp_path):
    """Neither the writer of the shards nor a reader holds a file's shards at once."""
    rows = spark.range(0, 2000, 1, 1).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 700), i -> substring(sha2(cast(id * 700 + i as string), 256), 1, 12))) text")
    lexical.build(spark, rows, f"{tmp_path}/i")
    (file,) = glob.glob(f"{tmp_path}/i/shards/*.parquet")
    meta = pq.read_metadata(file)
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 16_000_000 and max(sizes) < 8_000_000
