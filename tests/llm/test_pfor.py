"""The block format: exact round trips, and documents against the tokenizer itself."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import pfor

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=400), st.integers(1, 64),
       st.sampled_from([0, 50, 95, 100]))
def test_blocks_give_back_what_they_got(ids, block, percentile):
    given_ids = np.array(ids, dtype="<u4")
    payload, starts = pfor.pack(given_ids, block, percentile)
    assert np.array_equal(pfor.unpack(payload, starts), given_ids)
    for i, at in enumerate(starts):
        assert np.array_equal(pfor.unpack(payload, [at]), given_ids[i * block:(i + 1) * block])


def test_outliers_go_to_the_exception_list():
    ids = np.array([7] * 1000 + [49407] * 3, dtype="<u4")
    payload, starts = pfor.pack(ids, 1024)
    head = np.frombuffer(payload, pfor.HEADER, 1)[0]
    assert (head["width"], head["patched"], len(starts)) == (0, 3, 1) and len(payload) == pfor.HEADER.itemsize + 24


def plain(rows):
    tokenizer, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in pfor.round_trip(docs, VOCABULARY).collect()) == plain(rows)


def test_awkward_rows(spark):
    texts = [None, "", " ", "\n\n", "Ünï  ́x\tTab\x0bVT\x1cFS LS", "<|endoftext|> x<|startoftext|>y", "İSTANBUL ΣΑΣ ǅ", "é ́e",
             "it's we'll 12345 ½", "\x85a\xa0b\x1cC\x1fd µßÿÀ×÷ª 10²³¹¼ IT'S ''s,", "".join(map(chr, range(1, 256))), "𝒜🤦🏽‍♂️", "word " * 50000, "a" * 30000]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, ids STRING, part INT").repartition(5)
    assert sorted(tuple(r) for r in pfor.round_trip(df, VOCABULARY).collect()) == plain([r[:2] for r in rows])


def test_ties_and_frames(spark, tmp_path):
    rows = [(None, "no id"), (3, "b"), (3, "a"), (3, "a"), (1, "first " * 40), (2, None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    pfor.write_tokens(df, f"{tmp_path}/t", VOCABULARY, block=4, frame=3)
    out = pfor.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 3]
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1]]
    assert sorted(r.ids for r in out[3:]) == sorted(np.array([*Tokenizer.from_file(VOCABULARY).encode(t).ids, 1], "<u4").tobytes() for t in "baa")


def test_empty(spark):
    assert pfor.round_trip(spark.createDataFrame([], "doc_id LONG, text STRING"), VOCABULARY).collect() == []


def test_blocks_can_be_read_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three " * 900)], "doc_id LONG, text STRING")
    pfor.write_tokens(df, f"{tmp_path}/t", VOCABULARY)
    row = spark.read.parquet(f"{tmp_path}/t/frames").first()
    whole = pfor.unpack(row.payload, row.block_starts)
    assert len(row.block_starts) > 1
    assert np.array_equal(pfor.unpack(row.payload, row.block_starts[1:2]), whole[pfor.BLOCK:2 * pfor.BLOCK])


def test_plain_pieces_skip_the_steps_before_the_model():
    encoder, library, given = pfor.PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []
    signs = [chr(c) for c in range(256)]
    pieces = sorted({p for a in signs for b in signs for p in (a + b).split()} | {"'song", "''s", "i̇", "a\xadb", "<|endoftext|>", "été", "x" * 3000, "字"})

    class Counted:
        def encode_batch_fast(self, some, **told):
            given.extend(some)
            return library.encode_batch_fast(some, **told)

    encoder.tokenizer = Counted()
    assert encoder.encode(pieces) == [np.array(library.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert "字" in given and not {"été", "x" * 3000, "öß", "a", "''"} & set(given)
