"""Dual-tree search against every score computed."""

import numpy as np
import pytest

from marquee.llm import covertree


def plain(rows, queries, k=10, scale=1024):
    def whole(v):
        return None if not v or any(x is None or not np.isfinite(x) for x in v) else tuple(int(np.floor(scale * float(x))) for x in v)

    points = sorted({(i, whole(v)) for i, v in rows if i is not None and whole(v)})
    out = []
    for q in sorted({i for i, _ in queries if i is not None}):
        scores = set()
        for _, a in ((i, whole(v)) for i, v in queries if i == q and whole(v)):
            scores |= {(-sum(x * y for x, y in zip(a, p)), i) for i, p in points if i != q and len(p) == len(a)}
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def got(data, queries, **options):
    return sorted(tuple(r) for r in covertree.nearest(data, queries, **options).collect())


def test_given_vectors(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in data.collect()]
    expected = plain(rows, [r for r in rows if r[0] % 100 == 0])
    assert got(data, data.where("vec_id % 100 = 0")) == expected
    assert got(data, data.where("vec_id % 100 = 0"), block=60, sample=20, pivots=5) == expected


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3).round(1)]) for i in range(60)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(100, 160)] + [(0, rows[0][1])] * 3
    rows += [(200, None), (300, []), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [1.0, float("inf"), 0.0]), (None, [9.0, 9.0, 9.0]),
             (700, [1.0, 2.0]), (701, [3.0, 2.0]), (800, [1e12, -1e12, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, score STRING")
    ids = [i for i, _ in rows]
    assert got(df, df.where("vec_id % 100 = 0"), block=16, sample=16) == plain(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0])


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert got(df, df.where("vec_id = 0")) == [(0, 1, 2, 3 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024)]
    assert got(df.where("vec_id > 9"), df) == [] and got(df, df.where("vec_id > 9")) == []


def test_trees_cover_and_separate():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(10, 4))[rng.integers(10, size=800)] * 9 + rng.normal(size=(800, 4)) * 0.3
    tree = covertree.Tree(points, leaf=8)
    assert len(tree.centre) > 10
    for n in range(len(tree.centre)):
        members = tree.order[tree.first[n]:tree.last[n]]
        assert tree.centre[n] in members
        assert np.linalg.norm(points[members] - points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-12
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        middles = points[[tree.centre[c] for c in kids]]
        assert not len(middles) or tree.centre[n] in [tree.centre[c] for c in kids]
        for i in range(len(middles)):
            assert (np.linalg.norm(middles[:i] - middles[i], axis=1) > tree.radius[n] / 2).all()


def test_trees_of_random_points_cover_and_separate(monkeypatch):
    monkeypatch.setattr(covertree, "SPREAD", 1)  # random points are split as well
    points = np.random.default_rng(1).normal(size=(500, 4))
    tree = covertree.Tree(points, leaf=8)
    assert len(tree.centre) > 10
    for n in range(len(tree.centre)):
        members = tree.order[tree.first[n]:tree.last[n]]
        assert tree.centre[n] in members
        assert np.linalg.norm(points[members] - points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-12
        middles = points[[tree.centre[c] for c in range(tree.child[n], tree.child[n] + tree.children[n])]]
        for i in range(len(middles)):
            assert (np.linalg.norm(middles[:i] - middles[i], axis=1) > tree.radius[n] / 2).all()
