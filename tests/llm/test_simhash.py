"""SimHash linking against brute force, edge rows and the one-of-a-group filter."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.components import components


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps, budget=2):
    n, label = len(ids), list(range(len(ids)))
    near = [[j for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= budget] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append(min((ids[j] for j in seen if ids[j] is not None), default=None))
    return out


def test_fingerprints_match_brute_force():
    texts = [None, "", " \t\n", "One", "A b", "a B", "Éa b c d e", "x y z " * 50, "q" * 10_000]
    assert [int(x) & (1 << 64) - 1 for x in simhash.fingerprints_of(texts)] == [brute_fingerprint(t) for t in texts]


def test_trie_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    roots = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(roots.tolist()) | set(rng.integers(0, 2**63, 200, dtype=np.uint64).tolist())
    for r in roots.tolist():
        x = r
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    dense = {int(roots[0]) ^ int(m) for m in rng.integers(0, 2**11, 700)}  # one crowded trie
    fps = sorted(fps | dense)
    ids = list(range(len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    for limit in (512, 16):
        found = simhash.links(spark, df.select("fp"), limit=limit)
        roots_of = {r.node: r.root for r in components(spark, found).collect()}
        least = {}
        for i, s in zip(ids, signed, strict=True):
            k = roots_of.get(s, s)
            least[k] = min(least.get(k, i), i)
        assert [least[roots_of.get(s, s)] for s in signed] == brute_components(ids, fps)


def test_components_edge_cases(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components(spark, empty).count() == 0
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark, spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == 100


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text, "x"), (1, text, "y"), (1, text, "y"), (None, text, "z"), (5, "quite another text of its own kind", None), (7, None, None), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({c: F.lit("clash") for c in ("h1", "best", "n", "doc", "node")})
    got = simhash.deduplicated(spark, docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 5, 7]
    assert simhash.deduplicated(spark, docs.where(F.lit(False))).count() == 0
