"""Covers and nearest polygons against brute force over all edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposim.operators import cover
from toposim.operators.spatial import Step, attach, match_cascade, nearby_matches, within_matches


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


def star(n, x, y, inner, outer):
    p = [(x + (inner if k % 2 else outer) * math.cos(math.pi * k / n), y + (inner if k % 2 else outer) * math.sin(math.pi * k / n)) for k in range(2 * n)]
    return p + p[:1]


SHAPES = {
    1: [square(0, 0, 10), square(0, 0, 4)],  # a hole
    2: [square(0, 0, 4), square(1, 1, 1)],  # lies in the hole, has one itself
    3: [star(150, 40, -7.1, 11, 30)],  # concave, many edges
    4: [square(100, 100, 0.01)],  # tiny
    5: [star(5, -30, 0, 3, 8), star(7, -60, 5, 3, 9)],  # two parts
    6: [square(0, 0, 500)],  # large, holds the others
    7: [[(2000, 2000), (2010, 2000), (2010, 2000), (2005, 2010), (2000, 2000)]],  # a repeated vertex
}


def edges(rings):
    return [(*p, *q) for r in rings for p, q in zip(r, r[1:])]


def odd(es, x, y):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for ax, ay, bx, by in es) % 2 == 1


def on(es, x, y):
    return any((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for ax, ay, bx, by in es)


def gap(es, x, y):
    best = math.inf
    for ax, ay, bx, by in es:
        dx, dy = bx - ax, by - ay
        q = dx * dx + dy * dy
        t = 0.0 if q == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / q))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(9)
    points = [(rnd.uniform(-80, 120), rnd.uniform(-50, 110)) for _ in range(150)] + [(rnd.randint(-12, 12), rnd.randint(-12, 12)) for _ in range(80)]
    points += [(100.0, 100.0), (100.01, 100.0), (4.0, 0.0), (10.0, 10.0), (9000.0, -7000.0), (2005.0, 2003.0), (-499.9, 3.0)]
    pts = [(i, float(x), float(y), f"place {i}") for i, (x, y) in enumerate(points)]
    polys = [(i, [f"place {i}"] if i % 2 else [], [[(float(x), float(y)) for x, y in r] for r in rings], float(i * 100)) for i, rings in SHAPES.items()]
    return (spark.createDataFrame(pts, "poi_id long, x double, y double, name string"),
            spark.createDataFrame(polys, "id long, names array<string>, rings array<array<struct<x:double,y:double>>>, area double"), pts)


def test_cells_are_right():
    rnd = random.Random(3)
    for rings in SHAPES.values():
        es = edges(rings)
        a = np.array(es)
        cells = {c[:3]: c[3:] for c in cover.cells_of(a)}
        xs, ys = a[:, ::2], a[:, 1::2]
        for _ in range(300):
            x, y = rnd.uniform(xs.min() - 1, xs.max() + 1), rnd.uniform(ys.min() - 1, ys.max() + 1)
            hits = [cells[k] for k in ((e, math.floor(x / 2.0**e), math.floor(y / 2.0**e)) for e in {c[0] for c in cells}) if k in cells]
            assert len(hits) <= 1  # cells of a cover do not overlap
            got = bool(hits) and (hits[0][3] is None or hits[0][0] != bool(cover._crossed(hits[0][3], hits[0][1], hits[0][2], x, y) % 2))
            assert got == odd(es, x, y)
    large = [c for c in cover.cells_of(np.array(edges(SHAPES[3])))]
    assert max(len(c[6]) for c in large if c[6] is not None) <= cover.EDGES and any(c[6] is None for c in large)


def test_within_equals_brute_force(world):
    points, polys, pts = world
    want = {}
    for i, x, y, _ in pts:
        ids = [k for k, rings in SHAPES.items() if odd(edges(rings), x, y) and not on(edges(rings), x, y)]
        if ids:
            want[i] = min(ids)
    assert {r.poi_id: r.id for r in within_matches(points, polys).collect()} == want


@pytest.mark.parametrize("bound", [None, 6.0])
def test_nearest_equals_brute_force(world, bound):
    points, polys, pts = world
    want = {}
    for i, x, y, _ in pts:
        ways = [(0.0 if odd(edges(r), x, y) or on(edges(r), x, y) else round(gap(edges(r), x, y), 9), k) for k, r in SHAPES.items() if k != 6]
        d, k = min(ways)
        if bound is None or d < bound:
            want[i] = (k, d)
    got = nearby_matches(points, polys.where("id <> 6"), bound).collect()
    assert {r.poi_id: (r.id, round(r.distance, 9)) for r in got} == want


def test_cascade_steps(world):
    points, polys, pts = world
    steps = [Step("within", area_max=400.0), Step("nearby", named=True, area_max=450.0, dist_max=5.0), Step("within"), Step("nearby", area_max=150.0)]
    got = {r.poi_id: (r.id, r.step) for r in match_cascade(points, polys, steps).collect()}
    for i, x, y, _ in pts:
        inside = [k for k, r in SHAPES.items() if odd(edges(r), x, y) and not on(edges(r), x, y)]
        d = {k: 0.0 if odd(edges(r), x, y) or on(edges(r), x, y) else round(gap(edges(r), x, y), 9) for k, r in SHAPES.items()}
        one = [k for k in inside if k * 100 < 400]
        two = [(d[k], k) for k in SHAPES if k % 2 and k * 100 < 450 and d[k] < 5.0]
        want = (min(one), 1) if one else (min(two)[1], 2) if two else (min(inside), 3) if inside else (1, 4)
        assert got[i] == want
    both = attach(match_cascade(points, polys, steps), points.select("poi_id", "name"), polys.select("id", "area")).collect()
    assert len(both) == len(pts) and all(r.name_x == f"place {r.poi_id}" and r.area_y == r.id * 100 for r in both)


def test_term_split_similarity(world):
    points, polys, _ = world
    step = Step("nearby", named=True, measure="jaccard", sim_min=0.99, term_split=True)
    got = match_cascade(points.where("poi_id < 10"), polys, [step], frequent=["place"]).collect()
    # the meta-similarity is 1 only where the point's number is the polygon's
    assert all(r.poi_id == r.id for r in got)


def test_hot_cell_and_empty(spark, world):
    points, polys, _ = world
    crowd = spark.range(20_000).selectExpr("id poi_id", "0.5 + id / 1e6 x", "0.25 y", "'p' name")
    assert within_matches(crowd, polys).where("id = 6").count() == 20_000  # in both holes: only the large one is left
    assert within_matches(points.where("false"), polys).count() == 0
    assert within_matches(points, polys.where("false")).count() == 0
    assert nearby_matches(points, polys.where("false")).count() == 0


def test_a_point_takes_the_best_of_a_row_of_edges(spark):
    from toposim.operators.cover import _cell_rows, edges_of, nearest

    polys = spark.createDataFrame([(k, [[(float(k), 0.0), (k + 0.5, 0.0), (k + 0.5, 0.5), (float(k), 0.0)]]) for k in range(40)],
                                  "id long, rings array<array<struct<x:double,y:double>>>")
    edges = edges_of(polys)
    rows = _cell_rows(edges, 1024.0, row=8)
    held = {}
    for r in rows.collect():
        assert len(r.edges) < 40  # 120 edges of a cell, about 8 a row
        held.setdefault((r.cx, r.cy), []).extend(tuple(e) for e in r.edges)
    want = sorted(tuple(r) for r in edges.collect())
    assert held and all(sorted(h) == want for h in held.values())
    points = spark.createDataFrame([(1, 5.2, 30.0), (2, 500.0, -3.0), (2, 3.1, -1.0)], "poi_id long, x double, y double")
    got = {r.poi_id: (r.id, round(r.distance, 6)) for r in nearest(points, polys).collect()}
    assert got[2] == (3, 1.0)
    assert got[1][0] in (4, 5) and abs(got[1][1] - 29.5) < 0.05
