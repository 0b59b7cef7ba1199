"""Log-bilinear scores: counts and base against brute force, exact normalisation, gain over the base."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import lbl
from docloom.llm.common import fold_of


def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        lang = "xyz"[i % 3]
        rows.append((i, " ".join(f"{lang}{min(60, x)}{'Q' if x % 5 == 0 else ''}" for x in rng.zipf(1.4, 40)), "c"))
    rows += [(None, "null id text", "c"), (9, None, "c"), (14, "", "c"), (14, "", "c"), (21, "\t new-word\n" * 3, "c"), (22, "long " * 20_000, "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.mark.parametrize("head", [lbl.HEAD, 20])
def test_scores(spark, head):
    rows, docs = corpus(spark)
    model, counts = lbl.fit(spark, docs, shortlist=15, head=head)
    got = lbl.scored(spark, docs, model, counts).toPandas()
    c = Counter(t for d, text, _ in rows if fold_of(d, 7) != 2 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows) and set(got.train_tokens) == {n}
    key = lambda x: (x[0] is None or x[0] != x[0], x[0] or 0, x[1], x[2], round(x[3], 6))
    want = sorted(((d, len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, t in ((d, tokens(x)) for d, x, _ in rows)), key=key)
    have = sorted(zip(got.doc_id, got.n_tokens, got.n_known, got.base_score, strict=True), key=key)
    for a, b in zip(want, have, strict=True):
        assert a[1:3] == b[1:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(a[3]))
    held = got[got.held_out & (got.n_tokens > 5)]
    assert held.score.sum() > held.base_score.sum()
    # all words after any class, known or not, add up to one
    short, end = model.short, len(model.short)
    mass = 10 ** model.log_p.astype(float)
    per_class = np.zeros(len(mass))
    per_class[: end + 1] = 1
    for t in range(lbl.TAILS):
        words = [w for w in c if w is not None and lbl.key_of(w) not in short and lbl.tail_of(w) == t]
        per_class[end + 1 + t] = (sum(c[w] + 1 for w in words) + 1) / 10 ** model.share[t]
    assert np.allclose(per_class, 1) and np.allclose(mass.sum(1), 1, atol=1e-4)
    assert lbl.scored(spark, docs.where(F.lit(False)), model, counts).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, counts = lbl.fit(spark, docs)
    assert lbl.scored(spark, docs, model, counts).count() == 0
