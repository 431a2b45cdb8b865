"""Simplification of a ball, and mesh distances and containment, against plain geometry."""

import math

import numpy as np
import pytest

from voxframe.operators import polygon, spatial, surface
from voxframe.operators.measure import FAR, euler_number, lower_envelope
from voxframe.sources import mesh_files


def ball(splits):
    """Corners and faces of an octahedron split ``splits`` times, on the unit sphere."""
    points = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    faces = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    for _ in range(splits):
        seen, out = {}, []

        def middle(a, b):
            key = (min(a, b), max(a, b))
            if key not in seen:
                p = np.add(points[a], points[b])
                points.append(tuple(p / np.linalg.norm(p)))
                seen[key] = len(points) - 1
            return seen[key]

        for a, b, c in faces:
            x, y, z = middle(a, b), middle(b, c), middle(c, a)
            out += [(a, x, z), (x, b, y), (z, y, c), (x, y, z)]
        faces = out
    return points, faces


def tables(spark, points, faces):
    v = spark.createDataFrame([(1, n + 1, *map(float, p)) for n, p in enumerate(points)], "sample_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(1, n, *(c + 1 for c in face)) for n, face in enumerate(faces)], "sample_id long, face_id long, v1 long, v2 long, v3 long")
    return v, f


def test_ball_to_three_quarters(spark):
    """Target met within a percent, closed, of one ball, and nowhere far from the sphere."""
    points, faces = ball(2)
    v, f, report = surface.simplify(*tables(spark, points, faces), ratio=0.75)
    r = report.first()
    assert r["status"] == "ok" and r["faces_before"] == 128 and r["faces_after"] == f.count() and abs(r["faces_after"] - 96) <= 1
    kept = {x["vertex_id"]: np.array([x["x"], x["y"], x["z"]]) for x in v.collect()}
    left = [(x["v1"], x["v2"], x["v3"]) for x in f.collect()]
    edges = {}
    for face in left:
        for a, b in zip(face, face[1:] + face[:1]):
            edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
    assert set(edges.values()) == {2} and len(kept) - len(edges) + len(left) == 2
    grid = [np.average([kept[c] for c in face], axis=0, weights=w) for face in left for w in ((1, 1, 1), (1, 0, 0), (1, 1, 0), (4, 1, 1))]
    assert max(abs(np.linalg.norm(p) - 1) for p in grid) < 0.2


def test_simplify_says_why_it_stops(spark):
    points, faces = ball(1)
    assert surface.simplify(*tables(spark, points, faces), ratio=0.01, max_rounds=1)[2].first()["status"] == "rounds"
    stuck = surface.simplify(*tables(spark, points, faces), ratio=0.1, max_error=0.0)[2].first()
    assert stuck["status"] == "stuck" and stuck["faces_after"] == 32 and stuck["error"] == 0.0


def soup(spark, points, faces, shift=(0.0, 0.0, 0.0), size=1.0):
    rows = [(1, n, *(float(x) * size + s for c in face for x, s in zip(points[c], shift))) for n, face in enumerate(faces)]
    return spark.createDataFrame(rows, "sample_id long, tri_id long, " + ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz"))


def slow_distance(p, tri):
    best = math.inf
    for a, b, c in tri:
        best = min(best, float(spatial.triangle_distances(*(np.array([x]) for x in (p, a, b, c)))[0]))
    return best


def test_triangle_distance_by_sampling():
    rng = np.random.default_rng(2)
    for _ in range(40):
        p, a, b, c = rng.normal(size=(4, 3))
        w = rng.dirichlet((1, 1, 1), 20000)
        got = spatial.triangle_distances(*(np.array([x]) for x in (p, a, b, c)))[0]
        seen = np.linalg.norm(p - w @ np.array([a, b, c]), axis=1).min()
        assert got <= seen + 1e-12 and seen - got < 0.05


@pytest.mark.parametrize("cell", [0.5])
def test_signed_distance_of_a_ball(spark, cell):
    points, faces = ball(2)
    shift, size = (0.31, -0.17, 0.23), 1.3
    mesh = soup(spark, points, faces, shift, size)
    rng = np.random.default_rng(4)
    spots = np.concatenate([rng.uniform(-2, 2, (60, 3)), rng.uniform(-40, 40, (12, 3))])
    table = spark.createDataFrame([(1, n, *map(float, p)) for n, p in enumerate(spots)], "sample_id long, point_id long, x double, y double, z double")
    got = {r["point_id"]: r["distance"] for r in spatial.mesh_signed_distance(table, mesh, ["point_id"], cell).collect()}
    tri = [[np.array(points[c]) * size + shift for c in face] for face in faces]
    normals = [(np.cross(b - a, c - a), a) for a, b, c in tri]
    for n, p in enumerate(spots):
        inside = all(np.dot(m, p - a) < 0 for m, a in normals)  # the ball is convex
        assert got[n] == pytest.approx((-1 if inside else 1) * slow_distance(p, tri), abs=1e-9)


def test_band_agrees_with_exact_distances(spark):
    points, faces = ball(1)
    mesh = soup(spark, points, faces, (0.01, 0.02, 0.03), 6.0)
    voxels = spark.createDataFrame([(1, i, j, k, i * 2.0 - 15, j * 2.0 - 15, k * 2.0 - 15) for i in range(0, 16) for j in range(16) for k in range(8)],
                                   "sample_id long, i int, j int, k int, x double, y double, z double")
    exact = {(r["i"], r["j"], r["k"]): r["distance"] for r in spatial.mesh_signed_distance(voxels, mesh, ["i", "j", "k"], 2.0).collect()}
    band = spatial.banded_mesh_distance(voxels, mesh, 2, 0.5, (2.0, 2.0, 2.0), 2.0).collect()
    assert len(band) == 16 * 16 * 8 and {r["kind"] for r in band} == {"outside", "exact"}
    for r in band:
        true = exact[r["i"], r["j"], r["k"]]
        if r["kind"] == "exact":
            assert r["distance"] == pytest.approx(true, abs=1e-9)
        else:
            assert 0.5 < r["distance"] <= true + 1e-9


def test_lower_envelope():
    rng = np.random.default_rng(5)
    at = np.sort(np.array([rng.choice(60, 17, replace=False) for _ in range(40)]), axis=1)
    value = np.where(rng.random((40, 17)) < 0.3, FAR, rng.integers(0, 400, (40, 17)))
    value[3] = FAR
    got = lower_envelope(at, value)
    for row in range(40):
        for q in range(17):
            want = min((int(value[row, w] + (at[row, q] - at[row, w]) ** 2) for w in range(17) if value[row, w] < FAR), default=int(FAR))
            assert got[row, q] == want


def test_euler_number_of_known_shapes(spark):
    ring = [(i, j, 0) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    shell = [(i, j, k) for i in range(3) for j in range(3) for k in range(3) if (i, j, k) != (1, 1, 1)]
    shapes = {1: [(0, 0, 0)], 2: ring, 3: shell, 4: [(0, 0, 0), (5, 5, 5)], 5: [(0, 0, 0), (1, 1, 0)], 6: [(0, 0, 0), (0, 0, 0)]}
    df = spark.createDataFrame([(s, *c) for s, cells in shapes.items() for c in cells], "sample_id long, i int, j int, k int")
    assert {r["sample_id"]: r["chi"] for r in euler_number(df).collect()} == {1: 1, 2: 0, 3: 2, 4: 2, 5: 1, 6: 1}


def test_points_in_polygons_on_whole_numbers(spark):
    """Points on vertices and edges too, polygons with long edges, notches and crossings."""
    shapes = {1: [(0, 0), (9, 0), (9, 9), (0, 9)], 2: [(2, 1), (15, 3), (7, 7), (14, 14), (3, 12), (6, 6)], 3: [(0, 0), (12, 12), (12, 0), (0, 12)], 4: [(-5, -5), (-1, -5), (-3, 4)]}
    polys = spark.createDataFrame([(p, n + 1, float(x), float(y)) for p, s in shapes.items() for n, (x, y) in enumerate(s)], "poly_id long, seq int, x double, y double")
    spots = [(x, y) for x in range(-6, 17) for y in range(-6, 17)]
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(spots)], "point_id long, x double, y double")
    want = set()
    for p, s in shapes.items():
        edges = list(zip(s, s[1:] + s[:1]))
        for n, (x, y) in enumerate(spots):
            on = any((bx - ax) * (y - ay) == (x - ax) * (by - ay) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for (ax, ay), (bx, by) in edges)
            cut = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges)
            if cut % 2 and not on:
                want.add((n, p))
    for cell in (1.0, 2.5, 40.0):
        got = [(r["point_id"], r["poly_id"]) for r in polygon.points_in_polygons(points, polys, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want, cell


def test_broken_ascii_facets_are_errors():
    good = "solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\n"
    assert len(mesh_files.parse_stl((good + "endsolid").encode())) == 1
    with pytest.raises(ValueError, match="1 of 2 facets"):
        mesh_files.parse_stl((good + "facet normal 0 0 1\nouter loop\nvertex 0 0\nendloop\nendfacet\nendsolid").encode())


def test_radius_beyond_the_cell(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 10, (30, 3)), rng.uniform(0, 10, (40, 3))
    left = spark.createDataFrame([(1, n, *map(float, p)) for n, p in enumerate(a)], "sample_id long, point_id long, x double, y double, z double")
    right = spark.createDataFrame([(1, n, *map(float, p)) for n, p in enumerate(b)], "sample_id long, seed_id long, x double, y double, z double")
    got = {(r["point_id"], r["seed_id"]) for r in spatial.radius_join(left, right, 3.7, cell=1.0).collect()}
    assert got == {(m, n) for m in range(30) for n in range(40) if np.linalg.norm(a[m] - b[n]) <= 3.7}


def test_inscribed_circles_are_proven(spark):
    """Within the tolerance of the best of many places, in shapes with notches and slivers."""
    shapes = {1: [(0, 0), (4, 0), (4, 2), (0, 2)], 2: [(0, 0), (6, 0), (6, 6), (5, 6), (5, 1), (0, 1)], 3: [(0, 0), (10, 0.3), (0, 0.6)], 4: [(0, 0), (3, 0), (3, 3), (1.5, 0.8), (0, 3)]}
    polys = spark.createDataFrame([(p, n + 1, float(x), float(y)) for p, s in shapes.items() for n, (x, y) in enumerate(s)], "poly_id long, seq int, x double, y double")
    got = {r["poly_id"]: r for r in polygon.inscribed_circles(polys, tolerance=1e-3).collect()}
    for p, s in shapes.items():
        edges = list(zip(np.array(s, float), np.array(s[1:] + s[:1], float)))

        def clearance(x, y):
            inside = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2
            near = min(np.linalg.norm(np.array([x, y]) - a - np.clip(np.dot(np.array([x, y]) - a, b - a) / np.dot(b - a, b - a), 0, 1) * (b - a)) for a, b in edges)
            return near if inside else -near

        low, high = np.min(s, axis=0), np.max(s, axis=0)
        best = max(clearance(x, y) for x in np.linspace(low[0], high[0], 81) for y in np.linspace(low[1], high[1], 81))
        r = got[p]
        assert r["radius"] == pytest.approx(clearance(r["x"], r["y"])) and r["radius"] >= best - 1e-3 * max(high - low)
