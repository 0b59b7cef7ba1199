"""Pieces against the whole-text encoder, the range coder's round trip, and corpora."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import rans
from docloom.llm.token_corpus import Encoder, read_corpus, write_corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\t\x1c\x85\xa0\u2003'.,!<|>abAé9²œß中\u0301", "<|endoftext|>", "'s", "'ll", "  "]), st.characters(codec="utf-8")), max_size=60).map("".join))
def test_pieces_give_the_ids_of_the_whole(text):
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 140_001])
def test_round_trip_and_pieces(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_256)
    table = rans.Table.of_counts(np.bincount(ids, minlength=60))
    assert table.freq.sum() == 1 << rans.BITS
    block = rans.Block.parse(rans.encode(ids, np.array([n]), 5, table))
    assert block.first == 5 and (block.decode(table) == ids).all()
    step = rans.CHECKPOINT * rans.LANES
    for k in range(len(block.points)):
        assert (block.piece(k, table) == ids[k * step : (k + 1) * step]).all()


def test_damage_is_seen():
    ids = np.arange(3000) % 50
    table = rans.Table.of_counts(np.bincount(ids))
    data = bytearray(rans.encode(ids, np.array([3000]), 0, table))
    data[-5] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.Block.parse(bytes(data)).decode(table)


def test_corpus_matches_plain_encoding(spark, tmp_path):
    texts = [None, "", " ", "One two, two.", "Ünï cödé “quotes” 中文", "x" * 30_000, "a\n\nb\t c", "One two, two."]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts * 30)] + [(5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    write_corpus(spark, docs, f"{tmp_path}/c", PATH, block_ids=4000)
    got = read_corpus(spark, f"{tmp_path}/c", with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted(((WHOLE.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows))
    assert sorted(r.ids for r in got) == want
    write_corpus(spark, docs.where(F.lit(False)), f"{tmp_path}/e", PATH)
    assert read_corpus(spark, f"{tmp_path}/e").count() == 0
