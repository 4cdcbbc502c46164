"""The covering index against plain geometry, on polygons of many edges, holes and several parts."""

import math
import random
import re

import numpy as np
import pytest

from waymetric.operators import cover as C
from waymetric.operators.network import clip_ways

from .plain_geometry import line_meets, rings_of, within

SHAPES = "shape string, polygons array<array<array<array<double>>>>"


def star(r, n, x, y, size, spike=1.0):
    """A ring with n corners around a point."""
    far = [size * (1 + spike * (r.random() - 0.5)) for _ in range(n)]
    corners = [[x + far[k] * math.cos(2 * math.pi * k / n), y + far[k] * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*corners, corners[0]]


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(1)
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    return {
        "many": [[star(r, 3000, 0, 0, 10, 0.005)]], "spiky": [[star(r, 300, 0, 0, 10)]], "holes": [[square(-8.0, -8.0, 16.0), square(-4.0, -4.0, 8.0)], [star(r, 40, 20, 0, 3)]], "corners": [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)]],
        "flat": [[[[0.0, 0.0], [5.0, 0.0], [0.0, 0.0]]]], "point": [[[[1.0, 1.0]]]], "none": None,
    }


@pytest.mark.parametrize("tolerance", [1e-12, 0.5])
def test_points(spark, shapes, tolerance, monkeypatch):
    r = random.Random(2)
    points = [(k, float(x), float(y)) for k in shapes for x, y in {(r.uniform(-20, 25), r.uniform(-20, 20)) for _ in range(400)} | {(float(i), float(j)) for i in range(-8, 9) for j in range(-8, 9)}]
    edges = C.edges_of(spark.createDataFrame(list(shapes.items()), SHAPES))
    want = {}
    for k, polygons in shapes.items():
        own = [(x, y) for s, x, y in points if s == k]
        rings = rings_of(polygons or [])
        if rings:
            inside = within(np.array([p[0] for p in own]), np.array([p[1] for p in own]), rings, tolerance)
            want |= {(k, *p): bool(i) for p, i in zip(own, inside, strict=True)}
    for lengths in (2, 0.03):
        monkeypatch.setattr(C, "EDGE_LENGTHS", lengths)
        got = {(x.shape, x.x, x.y): x.inside for x in C.contained(spark.createDataFrame(points, "shape string, x double, y double"), edges, tolerance).collect()}
        assert got == want


def test_most_points_of_a_large_polygon_meet_no_edge(spark, shapes):
    """Inner cells are settled by their centre, by joins without Python."""
    edges = C.edges_of(spark.createDataFrame([("many", shapes["many"])], SHAPES))
    sizes = C.grids(edges, 0.0)
    border = C.in_cells(edges.join(sizes, "shape"), C.LITTLE).select("i", "j").distinct().count()
    cell = sizes.first()["cell"]
    assert border < 0.5 * (math.pi * 15**2) / cell**2
    plan = C.contained(spark.createDataFrame([("many", 0.0, 0.0)], "shape string, x double, y double"), edges, 0.1)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_ways(spark, shapes):
    r = random.Random(3)
    step = lambda: r.choice([-1, 0, 1, r.uniform(-3, 3)])
    ways = []
    for i in range(120):
        x, y = float(r.randint(-20, 25)), float(r.randint(-20, 20))
        line = [(x, y)]
        for _ in range(r.randint(0, 5)):
            x, y = x + step(), y + step()
            line.append((x, y))
        ways.append((i, "w", [{"lon": a, "lat": b} for a, b in line]))
    ways += [(1000, "empty", []), (1001, "inside", [{"lon": 0.5, "lat": 0.5}]), (1002, "across", [{"lon": -20.0, "lat": 0.1}, {"lon": 20.0, "lat": 0.1}])]
    frame = spark.createDataFrame(ways, "way_id long, name string, coords array<struct<lon:double,lat:double>>")
    for names in (["many", "spiky", "point", "none"], ["holes", "corners"], ["flat"]):
        districts = spark.createDataFrame([(k, "Dep", shapes[k]) for k in names], "ubigeo string, department string, polygons array<array<array<array<double>>>>")
        got = {x.way_id for x in clip_ways(frame, districts, "dep").collect()}
        want = {i for i, _, line in ways if line and any(line_meets(np.array([(p["lon"], p["lat"]) for p in line]), rings_of(shapes[k])) for k in names if shapes[k] and rings_of(shapes[k]))}
        assert got == want
    with pytest.raises(ValueError):
        clip_ways(frame, districts, "nowhere")


def test_large_polygon(spark):
    """100,000 edges and 50,000 points."""
    ring = star(random.Random(4), 100_000, 0, 0, 10, 0.0005)
    r = np.random.default_rng(5)
    xy = r.uniform(-16, 16, (50_000, 2))
    points = spark.createDataFrame([("s", float(x), float(y)) for x, y in xy], "shape string, x double, y double")
    rows = C.contained(points, C.edges_of(spark.createDataFrame([("s", [[ring]])], SHAPES)), 1e-12).collect()
    assert len(rows) == 50_000
    some = rows[::500]
    want = within(np.array([x.x for x in some]), np.array([x.y for x in some]), [np.array(ring)], 1e-12)
    assert [x.inside for x in some] == want.tolist()
