"""Recursive merging against the public library, and decoding back to the text."""

import base64
import subprocess
import sys
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def worker():
    return bpe.Ranks(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(worker):
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=worker.ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_any_text(worker, library, texts):
    encoded = worker.encode(texts)
    assert [ids_of(e) for e in encoded] == [library.encode_ordinary(t) for t in texts]
    assert worker.decode(encoded) == [t.encode() for t in texts]


def test_white_space(worker, library):
    text = "".join(f"a{chr(c)} b {chr(c)}{chr(c)}c" for c in [*range(0, 33), 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF])
    assert ids_of(worker.encode([text])[0]) == library.encode_ordinary(text)


def plain(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest(), True))
    return sorted(out, key=str)


def test_given_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in bpe.round_trip(docs, RANKS, PATTERN).collect()), key=str) == plain(library, rows)


def test_awkward_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "x" * 3000), (5, "don't 🤦🏽‍♂️ ½ ١٢٣" * 2000), (6, " \n\t ")]
    df = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "doc_id LONG, text STRING, n_tokens INT, ids STRING")
    assert sorted((tuple(r) for r in bpe.round_trip(df, RANKS, PATTERN).collect()), key=str) == plain(library, rows)
    tokens = bpe.encode(df, RANKS, PATTERN)
    back = sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in bpe.decode(tokens, RANKS, PATTERN).collect())
    assert back == sorted((k or 0, t or "") for k, t in rows)


def test_empty(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id LONG, text STRING"), RANKS, PATTERN).collect() == []


def test_long_words(worker, library):
    """Words of every kind over `LONG`, where a round contracts many pairs; and over 100,000 bytes in seconds, not hours."""
    import random

    draw = random.Random(5)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "eainst", "ACGT", "éàüßçñ漢字仮名", "aA", "ािीुकखग"]
    words = ["".join(draw.choice(alphabets[k % 7]) for _ in range(draw.choice([130, 200, 400, 900]))) for k in range(70)]
    words += ["".join(draw.choice(["the", "ing", "tion", "er", "ly", "aa", "aaaa"]) for _ in range(150)) for _ in range(20)]
    words += ["a" * 30_000, "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(40_000))]
    assert [ids_of(i) for i in worker.encode(words)] == [library.encode_ordinary(w) for w in words]


def test_little_memory(worker, library):
    """Pieces that were forgotten are learnt again."""
    from marquee.llm.common import Remembered

    kept, worker.known = worker.known, Remembered(20_000)
    texts = [f"word{i % 700} und Straße{i % 90} {i}" for i in range(2000)]
    try:
        for at in range(0, len(texts), 50):
            assert [ids_of(i) for i in worker.encode(texts[at:at + 50])] == [library.encode_ordinary(t) for t in texts[at:at + 50]]
        assert worker.known.held < 40_000
    finally:
        worker.known = kept


SMALL = """
import resource
import duckdb, pandas, public_tokenizers, pyspark.sql, regex
from marquee.llm import bpe

peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = peak()
worker = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
print(peak() - before)
"""


def test_a_worker_loads_small():
    grown = subprocess.run([sys.executable, "-c", SMALL], capture_output=True, text=True, check=True, cwd=Path(bpe.__file__).parents[2]).stdout
    assert int(grown) < 62  # MB; 67 with a list of tuples
