"""Hard negatives against every score computed, and on rows made to be awkward."""

import numpy as np
import pytest

from marquee.llm import hardneg


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    def whole(some):
        return sorted({(i, label, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v, label in some
                       if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)})

    points, out = whole(rows), []
    for i, label, a in whole(anchors):
        scored = sorted((-sum(x * y for x, y in zip(a, p)), j, other) for j, other, p in points if j != i and len(p) == len(a))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-t, n) for t, n, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank + 1, n, -s, t) for rank, (t, n) in enumerate(fit[:negatives])]
    return sorted(out)


def got(data, anchors, **options):
    return sorted(tuple(r) for r in hardneg.mine(data, anchors, **options).collect())


def test_given_vectors(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in data.collect()]
    expected = plain(rows, [r for r in rows if r[0] % 20 == 0])
    asked = data.where("vec_id % 20 = 0")
    assert got(data, asked) == expected and len(expected) > 500
    assert got(data, asked, cells=64 * 30, most=7, groups=3) == expected
    assert got(data, asked, positives=2, negatives=3, low=0, high=100) == plain(rows, [r for r in rows if r[0] % 20 == 0], 2, 3, 0, 100)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3).round(1)], int(i % 3)) for i in range(80)]
    rows += [(i, [0.5, 0.5, 0.5], i % 2) for i in range(100, 180)] + [(0, rows[0][1], 0)] * 3 + [(0, [0.1, 0.7, -0.2], 1)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None, 2.0], 1), (203, [float("nan"), 1.0, 1.0], 0), (204, [1.0, float("inf"), 0.0], 0),
             (None, [9.0, 9.0, 9.0], 1), (205, [1.0, 2.0, 2.0], None), (206, [1.0, 2.0], 1), (207, [3.0, 2.0], 1), (208, [2.0, 1.0], 2),
             (209, [1e12, -1e12, 3.0], 1), (210, [0.0, 0.0, 0.0], 0), (211, [0.0, 0.0, 0.0], 0), (212, [0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, anchor STRING")
    expected = plain(rows, rows)
    assert got(df, df) == expected
    assert got(df, df, cells=36, most=11, groups=2) == expected


def test_empty_and_alone(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], schema)
    assert got(none, none) == got(one, none) == got(none, one) == got(one, one) == []


def test_stops_before_the_end_where_scores_are_apart():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(200, 256, size=(40, 8)), rng.integers(0, 30, size=(4000, 8))]).astype("<i8")
    order = np.argsort(points, axis=0, kind="stable").astype("<i4")
    lists = hardneg.Lists(np.arange(len(points)).tobytes(), np.zeros(len(points), "<i8").tobytes(), points.tobytes(), order.tobytes(), 8)
    anchor, best = points[0], hardneg.Best(-np.inf, np.inf, 5)
    scored = hardneg.threshold_search(lists, anchor, 0, np.ones(len(points), bool), lists.thresholds(anchor[None])[0], [best])
    order = sorted((-int(points[i] @ anchor), i) for i in range(1, len(points)))
    assert list(zip(-best.scores, best.ids)) == order[:5]
    assert scored < len(points) // 4


def test_ties_at_the_threshold_are_met():
    points = np.array([[1, 0]] * 300 + [[0, 1]] * 300, dtype="<i8")[::-1].copy()
    order = np.argsort(points, axis=0, kind="stable").astype("<i4")
    lists = hardneg.Lists(np.arange(600).tobytes(), np.zeros(600, "<i8").tobytes(), points.tobytes(), order.tobytes(), 2)
    for anchor in ([1, 0], [-1, 1], [0, -1], [1, 1]):
        best = hardneg.Best(-np.inf, np.inf, 4)
        a = np.array(anchor)
        hardneg.threshold_search(lists, a, -1, np.ones(600, bool), lists.thresholds(a[None])[0], [best])
        assert list(zip(-best.scores, best.ids)) == sorted((-int(p @ a), i) for i, p in enumerate(points))[:4]


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 3, 10, 11, 33, 1000])
def test_window_borders(score):
    low, high = hardneg.window(score)
    assert [n for n in range(-30, 1000) if 30 * score <= 100 * n <= 90 * score] == list(range(low, high + 1))[:1030]
