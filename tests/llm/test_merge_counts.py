"""Merging by arrays against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm.common import sums_by_text
from docloom.llm.merge_counts import Merges, _counter, counted

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
CODER = _counter(PATH)


def by_library(texts):
    return [len(e.ids) for e in WHOLE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def by_arrays(texts):
    codes, sizes, columns = CODER.encode(texts)
    return sums_by_text(columns[0][codes], sizes).astype(int).tolist() if len(codes) else [0] * len(texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" \n\t\x1c\x85\xa0 '.,!<|>abAé9²œß中́", "<|endoftext|>", "'s", "'ll", "  ", "the", "ing"]), st.characters(codec="utf-8")), max_size=40).map("".join), min_size=1, max_size=4))
def test_counts_are_those_of_the_library(texts):
    assert by_arrays(texts) == by_library(texts)


def test_repeats_and_long_sequences():
    rng = random.Random(1)
    texts = ["a" * n for n in range(1, 40)] + ["=" * 1001, "ha" * 3000, "x" * 20_000, "".join(rng.choice("abcdefgh123+/") for _ in range(10_000)), "中文" * 999]
    assert by_arrays(texts) == by_library(texts)


def test_characters_newer_than_the_library_follow_it():
    texts = [f"a{c}1{c}!{c} {c}" for c in map(chr, [0x558, 0x88F, 0x10940, 0x2EBF0, 0x1FAE9, 0x16A0, 0x660, 0xA7D2])]
    assert by_arrays(texts) == by_library(texts)


def test_other_order_of_merges_than_training_gives(tmp_path):
    """A product that is part of a lower rank is merged one place at a time, as the library does."""
    letters = {c: i for i, c in enumerate(sorted({chr(b) for b in range(33, 127)} | {chr(b) for b in range(161, 256) if b != 173} | {chr(256 + i) for i in range(68)}))}
    vocab = letters | {t: len(letters) + i for i, t in enumerate(["cd", "ab", "abab", "xab", "abx"])}
    merges = [["a", "b"], ["x", "ab"], ["ab", "x"], ["ab", "ab"], ["c", "d"]]
    rng = random.Random(4)
    for _ in range(6):
        rng.shuffle(merges)
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
        told = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": model}
        path = tmp_path / "t.json"
        path.write_text(json.dumps(told))
        texts = ["".join(rng.choice("abxcd") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
        library = Tokenizer.from_file(str(path))
        assert Merges(str(path)).counts(texts).tolist() == [len(library.encode(t).ids) for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark):
    texts = [None, "", " ", "One two, two.", "Ünï cödé “quotes” 中文", "x" * 30_000, "a\n\nb\t c", "One two, two.", "word " * 600]
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(texts)] + [(5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in counted(docs, PATH).collect()), key=repr)
    sizes = by_library([t for _, t, _ in rows])
    assert got == sorted(((i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, sizes, strict=True)), key=repr)
    assert counted(docs.limit(0), PATH).count() == 0


def test_query_is_whole(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in entry.queries()["op12_token_counts"](spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], by_library([r.text for r in rows]), strict=True))
    assert np.sum(list(got.values())) > 10_000
