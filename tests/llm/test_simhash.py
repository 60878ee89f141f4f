"""SimHash groups against a plain reading of the definition, and on rows made to be awkward."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marquee.llm import simhash


def plain_print(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def plain_groups(rows, radius=4):
    prints = [(i, plain_print(t)) for i, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (_, a) in enumerate(prints):
        for _, b in prints[:k]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=str)


def bits(value):
    return (value & (1 << 64) - 1).bit_count()


def got(df, **options):
    return sorted((tuple(r) for r in simhash.near_groups(df, **options).collect()), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == plain_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "a b c d e", "x"), (4, "A B c d\x0be", None), (4, "A B c d\x0be", None),
            (5, "Éa é b", "x"), (6, long, "x"), (7, long + " tail", "x"), (8, "one two", "x"), (9, "ONE two", "x"), (None, "alone here", "x")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, component_id STRING")
    assert got(df) == plain_groups([r[:2] for r in rows])
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 8, None, None], key=str)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id LONG, text STRING")) == []


@pytest.mark.parametrize("chunk", [7, 8192])
def test_large_groups_are_cut_without_loss(spark, chunk):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 4), replace=False)) for _ in range(120)}
    values = {v - (1 << 64) if v >> 63 else v for v in values} | {int(v) for v in rng.integers(1 << 62, size=80)}
    prints = spark.createDataFrame([(v,) for v in values], "fp LONG")
    links = [tuple(r) for r in simhash.links_between(prints, "fp", chunk=chunk).collect()]
    assert all(bits(a ^ b) <= 4 for a, b in links)

    def groups(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    order = sorted(values)
    assert groups(links) == groups((a, b) for i, a in enumerate(order) for b in order[:i] if bits(a ^ b) <= 4)


def test_links_over_the_sign_bit():
    top = np.iinfo(np.int64).min
    assert {b for _, b in simhash.forest(np.array([5, top + 5, top + 4, 1 << 40]))} == {top + 5, top + 4, 1 << 40}
    assert simhash.forest(np.array([-1, 0])) == []


def test_chain_of_components(spark):
    from marquee.llm.common import components
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.range(1000, 1400).select(F.lit(999), F.col("id")))
    roots = dict(tuple(r) for r in components(links, "a", "b").collect())
    assert roots == {i: 0 for i in range(301)} | {i: 999 for i in range(999, 1400)}
