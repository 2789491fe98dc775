"""Unions of polygons against a raster of unit cells."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import dissolve, zones


def edges(spark, parts):
    """(region, part, ring) triples."""
    rows = [(r, p, [(float(x), float(y)) for x, y in ring]) for r, p, ring in parts]
    return zones.edges_from_rings(spark.createDataFrame(rows, "region string, part int, ring array<struct<x: double, y: double>>"))


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def plane(ordered):
    """Area, perimeter, rings of ordered edges in the plane; every ring must be closed and in order."""
    by_ring = {}
    for e in ordered.collect():
        by_ring.setdefault(e.ring, []).append(e)
    area = perimeter = 0.0
    for ring in by_ring.values():
        ring.sort(key=lambda e: e.seq)
        assert [e.seq for e in ring] == list(range(len(ring)))
        for a, b in zip(ring, ring[1:] + ring[:1]):
            assert (a.x2, a.y2) == (b.x1, b.y1)
            area += (a.x1 * a.y2 - a.x2 * a.y1) / 2
            perimeter += ((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2) ** 0.5
    return pytest.approx(area), pytest.approx(perimeter), len(by_ring)


def by_cells(boxes):
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    border = sum((i + di, j + dj) not in cells for i, j in cells for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return len(cells), border


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boxes_that_overlap_touch_and_repeat(spark, seed):
    rng = random.Random(seed)
    boxes = [(rng.randrange(10), rng.randrange(10), rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(14)]
    boxes += boxes[:2]
    # Some are wound the other way.
    ordered = dissolve.dissolve_rings(edges(spark, [("z", i, box(*b)[:: -1 if i % 3 else 1]) for i, b in enumerate(boxes)]))
    area, perimeter, _ = plane(ordered)
    assert (area, perimeter) == by_cells(boxes)


def test_borders_cut_at_other_places(spark):
    parts = [("z", 0, box(0, 0, 4, 4)), ("z", 1, box(4, 0, 2, 1)), ("z", 2, box(4, 1, 2, 3)), ("y", 0, box(0, 0, 1, 1))]
    ordered = dissolve.dissolve_rings(edges(spark, parts))
    assert plane(ordered.where("region = 'z'")) == (24.0, 20.0, 1) and plane(ordered.where("region = 'y'")) == (1.0, 4.0, 1)


def test_holes_corners_and_slanted_edges(spark):
    ring_of_four = [("a", i, box(*b)) for i, b in enumerate([(0, 0, 3, 1), (2, 1, 1, 2), (0, 2, 2, 1), (0, 1, 1, 1)])]
    corner = [("b", 0, box(0, 0, 1, 1)), ("b", 1, box(1, 1, 1, 1))]
    star = [("c", 0, [(0, 0), (4, 0), (2, 3)]), ("c", 1, [(0, 2), (2, -1), (4, 2)])]
    hole = [("d", 0, box(0, 0, 5, 5)), ("d", 0, box(1, 1, 1, 1)[::-1]), ("d", 1, box(1, 1, 1, 1))]
    of = lambda z: plane(ordered.where(F.col("region") == z))
    ordered = dissolve.dissolve_rings(edges(spark, ring_of_four + corner + star + hole))
    assert of("a") == (8.0, 16.0, 2) and of("b") == (2.0, 8.0, 2) and of("d") == (25.0, 20.0, 1)
    area, _, n = of("c")
    assert n == 1 and area.expected == pytest.approx(12 - star_overlap(), rel=1e-4)


def star_overlap():
    """Area that the two triangles share, by fine cells."""
    inside = lambda x, y: 0 <= y <= 3 and 1.5 * x >= y and 1.5 * (4 - x) >= y and y <= 2 and 1.5 * x >= 2 - y and 1.5 * (4 - x) >= 2 - y
    n = 800
    return sum(inside((i + 0.5) * 4 / n, (j + 0.5) * 3 / n) for i in range(n) for j in range(n)) * 12 / n**2


def test_star_overlap_is_close():
    assert 3 < star_overlap() < 5


def test_ring_rows_and_empty(spark):
    ordered = dissolve.dissolve_rings(edges(spark, [("z", 0, box(0, 0, 1, 1)), ("z", 1, box(1, 0, 1, 1))]))
    (ring,) = dissolve.rings(ordered).collect()
    assert len(ring.ring) == 6 and {(p.x, p.y) for p in ring.ring} == {(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)}
    again = zones.edges_from_rings(dissolve.rings(ordered))
    assert again.count() == 6
    assert dissolve.dissolve_rings(again.limit(0)).collect() == []


def test_points_see_the_same_region(spark):
    parts = edges(spark, [("z", 0, box(0, 40, 2, 2)), ("z", 1, box(1, 41, 3, 2)), ("z", 2, box(8, 40, 1, 1))])
    rng = random.Random(7)
    points = spark.createDataFrame([(i, 39.5 + rng.random() * 4, rng.random() * 9.5) for i in range(400)], "id long, lat_mean double, lon_mean double")
    of = lambda e: {r.id for r in zones.assign_region(points, e).collect()}
    assert of(zones.dissolve(parts, F.lit("all"))) == of(dissolve.dissolve_rings(parts)) != set()
