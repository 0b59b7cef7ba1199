"""The pipeline's stages on a small corpus, each held against a plain version of its rule."""

import corpus_pipeline as cp
import numpy as np
import pytest

from docloom.llm import language, packing, simhash, subword, toxicity
from docloom.llm.common import find_words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    syllables = {"en": ["tha", "ing", "er", "ou"], "de": ["sch", "keit", "ung", "ö"]}
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        words = ["".join(rng.choice(syllables[lang], 3)) for _ in range(int(rng.integers(20, 60)))]
        toxic = i % 8 == 0
        if toxic:
            words[3] = words[9] = words[15] = "wretchbag"
        rows.append((i, " ".join(words), lang, f"s{i % 3}" if i % 10 else None, 0))
        labels.append((i, 1, int(toxic)))
    copies = [(1000 + k, rows[33][1], "en", "s1", 0) for k in range(5)] + [(1100, rows[35][1] + " ", "en", "s2", 0)]
    bad = [(2000, "12 34 !!", "en", "s1", 0), (2001, None, None, None, None), (2002, "", "de", "s1", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows + copies + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stage = dict(cp.STAGES)
    assert list(stage) == ["language", "toxicity", "near-duplicates", "mixing", "packing"]
    one = stage["language"](spark, docs, corpus)
    assert one.columns == docs.columns
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in one.collect()} == ids - {2000, 2001, 2002}
    two = stage["toxicity"](spark, one, corpus)
    gone = {r.doc_id for r in one.collect()} - {r.doc_id for r in two.collect()}
    assert gone == {i for i in range(0, 240, 8)}
    three = stage["near-duplicates"](spark, two, corpus)
    rows = {r.doc_id: r.text for r in two.collect()}
    fps = dict(zip(rows, simhash.fingerprints_of(list(rows.values())).view(np.uint64).tolist(), strict=True))
    left = set()
    for i in sorted(rows):  # components are tiny here: a row goes if it is near one that stays
        if not any((fps[i] ^ fps[j]).bit_count() <= 2 for j in left):
            left.add(i)
    assert {r.doc_id for r in three.collect()} == left and not left & set(range(1000, 1101))
    four = stage["mixing"](spark, three, corpus)
    assert four.columns == docs.columns
    taken = {}
    for r in four.collect():
        taken[r.source] = taken.get(r.source, 0) + len(find_words(r.text))
    size = {}
    for r in three.collect():
        size[r.source] = size.get(r.source, 0) + len(find_words(r.text))
    from docloom.llm.mixing import targets

    for s, goal in targets(size, lambda i: 1 + i % 3).items():
        assert 0 <= goal - taken.get(s, 0) < 20
    five = stage["packing"](spark, four, corpus)
    assert five.count() == four.count()
    for (b, _), part in five.toPandas().groupby(["bucket", "batch"]):
        assert len(part) * part.bucket_len.iloc[0] <= packing.BUDGET, b


def test_run(spark, corpus):
    got = cp.run(spark, corpus)
    assert got.count() > 100 and "batch" in got.columns


def test_a_text_goes_to_python_once(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    plain = subword.Model(["de", "en"], np.ones((64, 2), np.float32), np.array([0.0, 1.0]), (3,))
    whole = cp._whole(docs)
    assert whole.columns == ["doc"]
    for rows in (language.label(spark, whole, plain, keep=["doc"], text="doc.text"), toxicity.scored(spark, whole, subword.Model([0, 1], plain.table, plain.bias, (3,)), keep=["doc"], text="doc.text")):
        assert "__text" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, rows.select("doc.*").collect())) == sorted(map(str, docs.collect()))
    told = language.label(spark, docs, plain, keep=["doc_id"]).collect()
    inside = language.label(spark, whole, plain, keep=["doc"], text="doc.text").select("doc.doc_id", "lang_pred", "score").collect()
    assert sorted(map(str, told)) == sorted(map(str, inside))
