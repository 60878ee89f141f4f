"""Points on the map against plain ray casting over whole rings."""

import math
import random

import pytest

from marquee.operators import places as J

SHAPE = "ord INT, name STRING, polygon ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"


def in_ring(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def plain(points, boundaries):
    return {i: next((name for _, name, rings in sorted(boundaries, key=lambda b: b[0])
                     if in_ring(x, y, rings[0]) and not any(in_ring(x, y, h) for h in rings[1:])), None)
            if x is not None and y is not None else None for i, x, y in points}


def got(spark, points, boundaries, cell):
    df = J.point_in_polygon(spark.createDataFrame(points, "id INT, longitude DOUBLE, latitude DOUBLE"), spark.createDataFrame(boundaries, SHAPE), cell=cell)
    rows = df.collect()
    assert df.columns == ["id", "longitude", "latitude", "neighborhood"] and len(rows) == len(points)
    return {r["id"]: r["neighborhood"] for r in rows}


def star(draw, cx, cy, corners, size):
    turn = sorted(draw.random() * 2 * math.pi for _ in range(corners))
    return [(cx + size * draw.uniform(0.3, 1) * math.cos(a), cy + size * draw.uniform(0.3, 1) * math.sin(a)) for a in turn]


@pytest.mark.parametrize("cell", [0.05, 0.25, 3.0])
def test_given_shapes(spark, cell):
    draw = random.Random(4)
    boundaries = [(k, f"star {k}", [star(draw, draw.uniform(-2, 2), draw.uniform(-2, 2), 12, 1.2), star(draw, 0, 0, 5, 0.3)][:1 + k % 2]) for k in range(8)]
    boundaries += [(20, "long and thin", [[(-3.0, -0.31), (3.0, -0.30), (3.0, -0.29), (-3.0, -0.28)]]), (21, "slanted", [[(-3.0, -3.0), (3.0, 2.9), (3.0, 3.0)]]),
                   (22, "grid", [[(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.25, 0.5), (0.25, 1.0), (0.0, 1.0)]]), (23, "self-crossing", [[(1.0, 1.0), (2.0, 2.0), (2.0, 1.0), (1.0, 2.0)]]),
                   (24, "line", [[(1.5, -2.0), (2.5, -2.0)]]), (25, "point", [[(1.0, 1.0)]]), (26, "everything", [[(-2.9, -2.9), (2.9, -2.9), (2.9, 2.9), (-2.9, 2.9)]]), (27, "none", [])]
    points = [(draw.uniform(-3.2, 3.2), draw.uniform(-3.2, 3.2)) for _ in range(1500)]
    points += [(i * 0.25, j * 0.25) for i in range(-12, 13) for j in range(-12, 13)]  # corners of cells, corners and edges of shapes
    points += [p for _, _, rings in boundaries for ring in rings for p in ring] + [(None, 0.1), (0.1, None), (99.0, 99.0)]
    points = [(i, x, y) for i, (x, y) in enumerate(points)]
    want = plain(points, [b for b in boundaries if b[2]])
    assert got(spark, points, boundaries, cell) == want
    assert len(set(want.values())) > 8


def test_repeated_polygons_do_not_cancel(spark):
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    assert got(spark, [(1, 0.5, 0.5), (2, 1.5, 0.5)], [(0, "a", square), (0, "a", square)], 0.1) == {1: "a", 2: None}


def test_cells_hold_their_own_edges_only(spark):
    """A ring of 6,000 corners over 400 cells: what a cell holds is what crosses it, and inner cells hold one number."""
    ring = [(math.cos(2 * math.pi * k / 6000) * (1 + 0.02 * (k % 2)), math.sin(2 * math.pi * k / 6000) * (1 + 0.02 * (k % 2))) for k in range(6000)]
    cells = J.boundary_cells(spark.createDataFrame([(0, "ring", [ring])], SHAPE), 0.1)
    held = cells.selectExpr("size(candidates) AS n", "size(candidates[0].outer.edges) AS edges", "size(candidates[0].outer.turns) AS turns", "candidates[0].outer.flips AS flips").collect()
    assert all(r["n"] == 1 for r in held)
    assert max(r["edges"] for r in held) < 300 and max(r["turns"] for r in held) < 300
    assert sum(r["edges"] == 0 and r["turns"] == 0 and r["flips"] == 1 for r in held) > 200
    assert "points" not in cells.schema["candidates"].dataType.simpleString()
