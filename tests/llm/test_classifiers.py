"""Language and toxicity models: held-out accuracy, unseen misspellings, and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language, subword, toxicity
from docloom.llm.common import fold_of

SYLLABLES = {"xx": ["ka", "lo", "mi", "tun"], "yy": ["schr", "eng", "ber", "ö"], "zz": ["ción", "ra", "ñe", "el"]}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(600):
        lang = ["xx", "yy", "zz"][i % 3]
        words = sentence(rng, lang).split()
        toxic = int(rng.random() < 0.25)
        if toxic:
            for k in rng.integers(0, len(words), 3):
                words[k] = rng.choice(["wretchbag", "Wretchbags", "gloomface"])
        out.append((i, " ".join(words), lang, toxic))
    return out


def test_language(spark, rows):
    extra = [(1000, None, "xx"), (1001, "", "yy"), (1002, "1234 !!", "zz"), (1003, "中", None), (None, "ka lo mi", None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([r[:3] for r in rows] + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.fit(spark, docs, max_docs=300)
    got = language.label(spark, docs.drop("score"), model, keep=["doc_id", "lang"]).toPandas()
    assert len(got) == len(rows) + len(extra)
    held = got[[d == d and d < 1000 and fold_of(int(d), 4) == 2 for d in got.doc_id]]
    assert len(held) > 80 and (held.lang_pred == held.lang).mean() > 0.98
    assert set(got[got.doc_id.isin([1000, 1001, 1002])].lang_pred) == {"und"}
    assert got.score.between(0, 1).all()
    assert language.label(spark, docs.drop("score").where(F.lit(False)), model, keep=["doc_id"]).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    model = language.fit(spark, docs)
    assert [r.lang_pred for r in language.label(spark, docs, model, keep=["doc_id"]).collect()] == ["und", "und"]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(spark, docs, toxicity.fit(spark, docs, labels), keep=["doc_id"]).collect()
    assert [r.predicted for r in got] == [0, 0]


def test_toxicity(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(2000, None), (2001, ""), (None, "wretchbag gloomface")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 7] + [(5, None), (None, 1), (6, rows[6][3])], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels, max_docs=400, buckets=2**14)
    got = toxicity.scored(spark, docs.drop("predicted"), model, keep=["doc_id"]).toPandas()
    assert len(got) == len(rows) + 3 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    truth = {r[0]: r[3] for r in rows}
    held = got[[d == d and d in truth and fold_of(int(d), 5) == 0 for d in got.doc_id]]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    rng = np.random.default_rng(9)
    words = sentence(rng, "xx").split()
    clean, odd = " ".join(words), " ".join([*words, "wretchbagg", "gloomfacce", "wretchba"])
    p = model.probabilities(model.coder(), [clean, odd])[:, 1]
    assert p[1] > 2 * p[0]


def test_features_match_a_plain_version():
    words = ["ab", "abcdef", "é中😀x"]
    owner, ids = subword.features(words, 1 << 20, (3, 4))
    for i, w in enumerate(words):
        marked = f"<{w}>"
        grams = sum(max(0, len(marked) - n + 1) for n in (3, 4)) + 1
        assert (owner == i).sum() == grams
    again = subword.features(["zzz", "abcdef"], 1 << 20, (3, 4))
    assert sorted(ids[owner == 1]) == sorted(again[1][again[0] == 1])


@pytest.mark.parametrize("classes", [2, 3])
def test_scores_against_a_plain_softmax(classes):
    rng = np.random.default_rng(classes)
    model = subword.Model(list(range(classes)), rng.normal(0, 1, (1 << 12, classes)).astype(np.float32), rng.normal(0, 1, classes), (2, 3, 5), 1.7)
    texts = ["One two  two", "", None, "é中 x", "long " * 300, "x" * 70_000, "One two  two"]
    got = model.probabilities(model.coder(), texts)
    for text, p in zip(texts, got, strict=True):
        words = subword.find_words((text or "").lower())
        sums = np.zeros(classes)
        for w in words:
            _, ids = subword.features([w], 1 << 12, (2, 3, 5))
            sums += model.table[ids].astype(np.float64).mean(0)
        z = (sums / max(1, len(words)) + model.bias) * 1.7
        want = np.exp(z - z.max())
        assert np.allclose(p, want / want.sum(), atol=1e-6)
    assert (got[0] == got[6]).all()


def test_bags_against_counts_written_out():
    ids, shares, words = subword.bag("ab cd ab", 1 << 12, (2, 3))
    plain: dict[int, float] = {}
    for w in ["ab", "cd", "ab"]:
        _, own = subword.features([w], 1 << 12, (2, 3))
        for i in own:
            plain[int(i)] = plain.get(int(i), 0) + 1 / len(own)
    assert words == 3 and sorted(plain) == ids.tolist() and np.allclose([plain[i] for i in ids.tolist()], shares, atol=1e-3)


def test_repeated_and_null_ids_and_clashing_columns(spark, rows):
    many = [(100_007, "ka lo mi schr", "xx")] * 3000 + [(None, "ra el", "zz")] * 50 + [r[:3] for r in rows[:200]]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("score", "predicted", "lang_pred", "label", "ids", "words", "shares")})
    model = language.fit(spark, docs, max_docs=60)
    got = language.label(spark, docs, model, keep=["doc_id"])
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == len(many) and set(model.classes) == {"xx", "yy", "zz"}
    labels = spark.createDataFrame([(100_007, 1), (100_007, 0), (None, 1), *((r[0], r[3]) for r in rows[:200])], "doc_id long, toxic int").withColumns({c: F.lit("clash") for c in ("label", "text")})
    scored = toxicity.scored(spark, docs, toxicity.fit(spark, docs, labels, max_docs=60, buckets=2**12), keep=["doc_id"])
    assert scored.columns == ["doc_id", "score", "predicted"] and scored.where("doc_id = 100007").distinct().count() == 1 and scored.count() == len(many)
