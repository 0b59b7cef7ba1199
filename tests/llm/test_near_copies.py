"""Near copies by minima of shingles, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import simhash


def jaccard(a, b):
    a, b = set(simhash.shingles(a, 5)), set(simhash.shingles(b, 5))
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("limit", [512, 20])
def test_groups_are_those_of_all_pairs(spark, limit):
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    texts = [" ".join(word() for _ in range(150)) for _ in range(40)]
    for k in range(60):  # a crowd around one text
        w = texts[0].split()
        w[int(rng.integers(0, 150))] = word()
        texts.append(" ".join(w))
    for i in range(1, 15):  # and copies with 1 to 14 words changed
        w = texts[i].split()
        for at in rng.choice(150, i, replace=False):
            w[at] = word()
        texts.append(" ".join(w))
    texts += ["", "", "one", "two"]
    base = [word() for _ in range(150)]
    for _ in range(40):  # and a crowd of texts that are near each other, but not near enough
        w = list(base)
        for at in rng.choice(150, 3, replace=False):
            w[at] = word()
        texts.append(" ".join(w))
    rows = simhash.with_signature(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id", "text"]).cache()
    leaves = rows.select("node", "keys", "signature").dropDuplicates(["node"])
    roots = dict(simhash.near_copies(spark, leaves, lambda nodes: rows.join(nodes, "node").select("node", "text").dropDuplicates(["node"]), limit=limit).collect())
    node = {r.doc_id: r.node for r in rows.collect()}
    n = len(texts)
    near = [[jaccard(a, b) >= 0.8 or a == b for b in texts] for a in texts]
    label = list(range(n))
    while (new := [min(label[j] for j in range(n) if near[i][j]) for i in range(n)]) != label:
        label = new
    found: dict = {}
    assert [found.setdefault(roots.get(node[i], node[i]), i) for i in range(n)] == label


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.deduplicated(spark, docs).count() == 0
    assert simhash.deduplicated(spark, spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").where(F.lit(True))).count() == 1


def _edits(rng, word):
    """Texts and copies with one run replaced, appended or cut, on both sides of 0.8."""
    pairs = []
    for n in (200, 500):
        for share in (0.02, 0.06, 0.09, 0.1, 0.105, 0.15, 0.19, 0.24, 0.3):
            k = int(share * n)
            for edit in (lambda w, run: w[:50] + run + w[50 + len(run) :], lambda w, run: w + run, lambda w, run: w[: -len(run)], lambda w, run: w[:30] + w[30 + len(run) :]):
                w = [word() for _ in range(n)]
                pairs.append((w, edit(w, [word() for _ in range(k)])))
    return [(" ".join(a), " ".join(b)) for a, b in pairs]


def test_runs_replaced_appended_or_cut(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    pairs = _edits(rng, word)
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    left = {r.doc_id for r in simhash.deduplicated(spark, docs).collect()}
    like = [jaccard(*p) >= 0.8 for p in pairs]
    assert 20 < sum(like) < len(like) - 10 and sum(0.8 <= jaccard(*p) < 0.83 for p in pairs) > 5
    assert [2 * i + 1 in left for i in range(len(pairs))] == [not x for x in like]
    assert left >= {2 * i for i in range(len(pairs))}


def test_a_repeated_line_does_not_make_copies(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    line = " ".join(word() for _ in range(10))
    texts = [" ".join([*(word() for _ in range(400)), *[line] * 40]) for _ in range(30)]
    assert max(jaccard(texts[0], t) for t in texts[1:]) < 0.1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.deduplicated(spark, docs).count() == 30


@pytest.mark.parametrize("limit", [512, 20])
def test_groups_are_those_of_all_true_pairs(spark, limit):
    """A crowd around 0.8, where candidates fail and links are to be found past them."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    base, texts = [[word() for _ in range(150)] for _ in range(3)], []
    for k in range(150):
        w = list(base[k % 3])
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            w[at] = word()
        texts.append(" ".join(w))
    node, keys, sig = simhash.signatures_of(texts)
    rows = {int(n): (int(n), k.tolist(), bytes(s), t) for n, k, s, t in zip(node, keys, sig, texts, strict=True)}
    df = spark.createDataFrame(list(rows.values()), "node long, keys array<long>, signature binary, text string")
    texts_of = lambda nodes: df.join(nodes, "node").select("node", "text")
    got = dict(simhash.near_copies(spark, df.drop("text"), texts_of, limit=limit).collect())
    ids = sorted(rows)
    like = {i: [j for j in ids if jaccard(rows[i][3], rows[j][3]) >= 0.8] for i in ids}
    label = {i: i for i in ids}
    for _ in ids:
        label = {i: min(label[j] for j in like[i]) for i in ids}
    assert {i: got.get(i, i) for i in ids} == label and len(set(label.values())) > 3
