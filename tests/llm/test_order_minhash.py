"""Order MinHash against a brute-force fingerprint, and the edited texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import order_minhash as omh


def brute(text, k=omh.K, slots=omh.SLOTS, length=omh.LENGTH):
    """The same fingerprint from its definition, one k-mer at a time."""
    if not text:
        return np.zeros(slots, np.uint16)
    m = (1 << 64) - 1
    a, b, c = int(omh._A), int(omh._B), int(omh._C)

    def mix(x):
        x = ((x ^ x >> 30) * b) & m
        x = ((x ^ x >> 27) * c) & m
        return x ^ x >> 31

    width = min(k, len(text))
    seen, marks = {}, []
    for i in range(len(text) - width + 1):
        h = 0
        for ch in text[i : i + width]:
            h = (h * a + (ord(ch) + 1) * b) & m
        value = mix(h) >> 24
        n = seen[value] = seen.get(value, -1) + 1
        marks.append((mix((value + n * a) & m), i))
    out = []
    for s in range(slots):
        mine = sorted(x for x in marks if x[0] % slots == s)[:length]
        if len(mine) < length:
            mine = sorted(marks, key=lambda x: mix(x[0] ^ ((s + 1) * c & m)))[:length]
        v = (s + 1) * a & m
        for g, _ in sorted(mine, key=lambda x: x[1]):
            v = mix((v * b + g) & m)
        out.append(v >> 48)
    return np.array(out, np.uint16)


@pytest.mark.parametrize("text", ["", "a", "short", "exactly10!", "ab" * 40, "the quick brown fox " * 30, "".join(chr(97 + i * i % 26) for i in range(4000)), "é中😀" * 900])
def test_signature_matches_brute_force(text):
    assert (omh.signature(omh.points_of(text)) == brute(text)).all()


def test_order_counts():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(300)]
    sig = lambda t: omh.signature(omh.points_of(t))
    text, moved = " ".join(words), " ".join(words[150:] + words[:150])
    near = " ".join(words[:100] + ["other"] + words[100:])
    assert omh.likeness(sig(text), sig(near)) > 0.8 > omh.likeness(sig(text), sig(moved)) > 0.2
    assert omh.likeness(sig(text), sig(text)) == 1


def test_edited_pairs(spark):
    rows = [(i, f"text {i} " * (i % 9), "x") for i in range(90)] + [(7, "tie b", "x"), (7, "tie a", "x"), (50, None, "x"), (None, "null b", "x"), (None, "null a", "x"), (None, None, "x"), (30, "long " * 4000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (doc, text, _) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        a, b, c = brute(text), brute(new), brute(nxt)
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), omh.as_text(a), omh.as_text(b), omh.likeness(a, b), omh.likeness(a, c)))
    key = lambda r: tuple(map(str, r))
    for ranges in (None, 1, 7, 40):
        assert sorted(map(tuple, omh.edited_pairs(spark, docs, ranges=ranges).collect()), key=key) == sorted(want, key=key)
    assert omh.edited_pairs(spark, docs.where(F.lit(False))).count() == 0
    assert omh.edited_pairs(spark, docs.limit(1)).count() == 1
