"""Runs by grid probing against a plain scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm.periodic import periodic, runs


def plain(words):
    """Every run, by the definition: for each period the maximal stretches, smallest period first."""
    out = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - p:
            start = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(6, 4 * p) and i > start:
                out.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def a_text(rng):
    words = []
    while rng.random() < 0.9 and len(words) < 150:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.randrange(3)] * rng.randrange(1, 12)
        elif kind < 0.8:
            some = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 12))]
            words += (some * rng.randrange(1, 9))[: rng.randrange(1, 80)]
        else:
            words += [rng.randrange(50) for _ in range(rng.randrange(10))]
    return words * rng.choice([1, 1, 1, 2, 4, 5])


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_the_scan(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [a_text(rng) for _ in range(rng.randrange(1, 8))]
        codes = np.array([c for w in texts for c in w], np.int64)
        got = runs(codes, np.array([len(w) for w in texts])).tolist()
        assert got == [[i, *r] for i, w in enumerate(texts) for r in plain(w)]


def test_borders():
    assert runs(np.array([1] * 5), np.array([5])).tolist() == []
    assert runs(np.array([1] * 6), np.array([6])).tolist() == [[0, 0, 6, 1]]
    assert runs(np.array([1] * 12), np.array([6, 6])).tolist() == [[0, 0, 6, 1], [1, 0, 6, 1]]
    assert runs(np.array([1, 2] * 3 + [1]), np.array([7])).tolist() == []
    assert runs(np.array([1, 2] * 4), np.array([8])).tolist() == [[0, 0, 8, 2]]
    assert runs(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    some = list(range(2000)) * 4 + [5]
    assert runs(np.array(some), np.array([8001])).tolist() == [[0, 0, 8000, 2000]]
    with pytest.raises(ValueError):
        runs(np.array([1] * 6), np.array([6]), times=3)


def by_contract(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    strongest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    every = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    return (doc_id, len(found), *strongest, every, hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \t", "a", "a " * 6, "A a " * 20, "é é " * 9, "one two three " * 50 + "four"]
    texts += [" ".join(f"w{x}" for x in a_text(rng)) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "b b b b b b", "x"), (4, "a " * 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = sorted((tuple(r) for r in periodic(docs, planted=True).collect()), key=repr)
    assert got == sorted((by_contract(i, t) for i, t, _ in rows), key=repr)
    assert periodic(docs.limit(0)).count() == 0
    whole = periodic(docs.where("doc_id = 7"), with_runs=True).first()
    assert [tuple(r) for r in whole.runs] == [(0, 150, 3)] and whole.collapsed == "one two three four"


def test_query_is_whole(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, sf).collect()), key=repr)
    assert got == sorted((by_contract(r.doc_id, r.text) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 10
