"""Near copies by one-permutation hashing against every pair compared, and on rows made to be awkward."""

import random

import numpy as np
import pytest

from marquee.llm import minhash


def shingle_set(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def plain(rows, above=85, below=100):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for at, (_, s) in enumerate(sets):
        for shingle in s:
            holders.setdefault(shingle, []).append(at)
    for at, (_, s) in enumerate(sets):
        for other in {o for shingle in s for o in holders[shingle] if o < at}:
            met = len(s & sets[other][1])
            if below * met >= above * (len(s) + len(sets[other][1]) - met):
                root[find(at)] = find(other)
    least = {}
    for at, (i, _) in enumerate(sets):
        if i is not None:
            least[find(at)] = min(i, least.get(find(at), i))
    return sorted(((i, len(s), c := least.get(find(at)), None if i is None else i == c) for at, (i, s) in enumerate(sets)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in minhash.near_copies(df, **options).collect()), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(docs) == expected
    assert sum(not kept for *_, kept in expected) > 10


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "a b c d e", "x"), (4, "A B c d\x0be", None), (4, "A B c d\x0be", None),
            (5, "Éa é b", "x"), (6, long, "x"), (7, long + " tail", "x"), (8, "one two", "x"), (9, "ONE two", "x"), (None, "alone here", "x"),
            (None, "alone here", "x"), (None, None, "x"), (10, "one two three", "x"), (11, "", "x")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, component_id STRING")
    assert got(df) == plain([r[:2] for r in rows])
    assert got(spark.createDataFrame([], "doc_id LONG, text STRING")) == []


def test_chains_and_crowds_lose_no_link(spark):
    """Groups whose members lie just over and just under the border, so that no star's centre reaches all of them."""
    draw, rows = random.Random(2), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(120)]
        for member in range(25):
            words = list(base)
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = f"m{draw.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    walk = [f"c{i}" for i in range(200)]
    for step in range(40):
        walk[step * 5 % 200] = f"s{step}"
        rows.append((len(rows), " ".join(walk)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    expected = plain(rows)
    assert got(df) == expected
    assert len({c for _, _, c, _ in expected}) > 13


@pytest.mark.parametrize("size", [1, 6, 40, 5000])
def test_bins_agree_as_often_as_sets_do(size):
    """Also where most bins are empty."""
    signer, draw, agree, similar = minhash.Signer(), np.random.default_rng(size), [], []
    for _ in range(60 if size > 100 else 400):
        every = np.unique(draw.integers(1 << 63, size=size + 2, dtype=np.uint64) * np.uint64(2))
        gone = draw.integers(len(every), size=2)
        a, b = np.delete(every, gone[0]), np.delete(every, gone[1])
        agree.append((signer.signature(a) == signer.signature(b)).mean())
        similar.append(len(np.intersect1d(a, b)) / len(every if gone[0] != gone[1] else a))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.03


def test_sketches_differ_in_no_more_bits_than_sets():
    draw = np.random.default_rng(4)
    every = np.unique(draw.integers(1 << 63, size=600, dtype=np.uint64))
    for apart in (0, 1, 5, 60):
        other = np.delete(every, draw.choice(len(every), apart, replace=False))
        bits = int(np.bitwise_count((minhash.sketch(every) ^ minhash.sketch(other)).view(np.uint64)).sum())
        assert bits <= apart
