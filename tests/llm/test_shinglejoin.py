"""The near-dedup stage against brute-force Jaccard over five-word shingles."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from marquee.llm import shinglejoin


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def plain(rows):
    """The (doc_id, text) that stay: of each group connected by similarities of 0.8 the smallest doc_id, rows without one last."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            if a == sets[j] or len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                root[find(k)] = find(j)
    best = {}
    for k, (i, t) in enumerate(rows):
        place = (i is None, i or 0, k)
        best[find(k)] = min(place, best.get(find(k), place))
    return sorted((rows[k] for *_, k in best.values()), key=str)


def got(df):
    return sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(df.sparkSession, df, "").select("doc_id", "text").collect()), key=str)


def test_rewrapped_and_changed_copies(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 30, 80, 200]))]
        rows.append((20 * k, " ".join(words)))
        rows.append((20 * k + 1, "\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7))))
        for c in range(2, 12):
            some = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 20)):
                some[rng.randrange(len(some))] = rng.choice(["new", f"v{rng.randrange(50)}"])
            rows.append((20 * k + c, " ".join(some)))
    expected = plain(rows)
    assert 100 < len(expected) < len(rows) - 150
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    assert got(df) == expected


def test_no_link_below_the_similarity(spark):
    """One of 30 words differs: 21 of 31 shingles in common."""
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join([*base[:15], f"x{i}", *base[16:]])) for i in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id LONG, text STRING")) == sorted(rows, key=str)


def test_crowd_and_awkward_rows(spark):
    base = " ".join(f"k{i}" for i in range(100))
    rows = [(i, f"{base} n{i}") for i in range(300)] + [(None, base), (None, "alone"), (None, "alone"), (900, None), (901, ""), (902, " \n"),
            (903, "same id"), (903, "other text"), (903, "same id"), (905, "one two"), (906, "one  two")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id LONG, text STRING, row_no INT")
    assert got(df) == sorted([(0, f"{base} n0"), (None, "alone"), (900, None), (903, "same id"), (903, "other text"), (905, "one two")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, df, "").columns == df.columns


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id LONG, text STRING")) == []


def test_files_are_not_copied_and_rows_told_apart_by_their_place(spark, tmp_path, monkeypatch):
    base = " ".join(f"k{i}" for i in range(100))
    rows = [(i, f"{base} n{i}") for i in range(80)] + [(None, base), (None, "alone"), (None, "alone"), (900, None), (901, ""),
            (903, "same id"), (903, "other text"), (903, "same id"), (905, "one two"), (906, "one  two")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3).write.parquet(f"{tmp_path}/docs")
    written, stored = [], shinglejoin.stored
    monkeypatch.setattr(shinglejoin, "stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    found = got(spark.read.parquet(f"{tmp_path}/docs"))
    assert found == sorted([(0, f"{base} n0"), (None, "alone"), (900, None), (903, "same id"), (903, "other text"), (905, "one two")], key=str)
    assert written and not [name for name, columns in written if "text" in columns]


def described(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    rows = df.select("id", shinglejoin.described(df["text"], 5, (4, 5), shinglejoin.rarity(df, 5)).alias("s")).select("id", "s.*")
    return rows, {r["id"]: r["set"] for r in rows.collect()}


def test_large_sets_with_a_passage_in_common_are_ruled_out_by_their_counts(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(200)]
    own = [[f"w{rng.randrange(10 ** 9)}" for _ in range(n)] for n in (3000, 3200, 9000, 9500)]
    # the last two are similar to the first and the third, and their sets have more buckets: 4,100 shingles instead of 4,090
    near = own[0] + [f"x{i}" for i in range(894)], own[0] + [f"x{i}" for i in range(904)]
    texts = [" ".join(passage + w) for w in [*own, *near]]
    rows, name = described(spark, texts)
    pairs = spark.createDataFrame([(name[a], name[b]) for a, b in ((0, 1), (2, 3), (4, 5))], "a LONG, b LONG")
    left = shinglejoin._likely(rows, pairs, (4, 5)).collect()
    assert [tuple(r) for r in left] == [(name[4], name[5])]


def test_counts_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n, m, common in ((1025, 5000, 1000), (4095, 4096, 4000), (2047, 2048, 0), (20000, 18000, 17000)):
        held = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        x, y = np.unique(held[:n]), np.unique(held[n - common:])
        assert shinglejoin.spread(shinglejoin.bucketed(x), shinglejoin.bucketed(y)) <= len(np.setxor1d(x, y))
    crowded = (np.arange(1, 3001, dtype=np.uint64) << np.uint64(20))
    assert shinglejoin.spread(shinglejoin.bucketed(crowded), shinglejoin.bucketed(crowded[:1100])) <= 1900


def test_a_common_shingle_comes_after_rare_ones(spark, monkeypatch):
    """Of the prefixes of many texts none holds the passage they all begin with, though each bucket holds more rare shingles than there are texts."""
    monkeypatch.setattr(shinglejoin, "BUCKETS", 1 << 8)
    rng = random.Random(6)
    texts = [" ".join([*(f"p{i}" for i in range(29)), *(f"w{rng.randrange(10 ** 9)}" for _ in range(1200))]) for _ in range(100)]
    rows, _ = described(spark, texts)
    prefixes = Counter(t for r in rows.select("prefix").collect() for t in r["prefix"])
    assert max(prefixes.values()) == 1
