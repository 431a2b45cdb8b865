"""Known values: tortuosity of small fields, components by brute force, partition independence, STL errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import bricks, graph, grid, measure, sampling, spatial, surface
from voxframe.sources import mesh_files

N = 6


def opened(spark, cells):
    return spark.createDataFrame([(0, *map(int, c)) for c in cells], "sample_id long, i int, j int, k int")


SIZES = [(0, N, N, N)]


@pytest.mark.parametrize("case, cells, status, ratio", [
    ("box", [(i, j, k) for i in range(N) for j in range(N) for k in range(N)], "ok", 1.0),
    ("channel", [(3, 3, k) for k in range(N)], "ok", 1.0),
    ("stair", [(k, 3, k) for k in range(N)], "ok", math.sqrt(2)),
    ("blocked", [], "no open planes", None),
    ("gap", [(3, 3, k) for k in range(N) if k != 2], "no path", None),
])
def test_tortuosity(spark, case, cells, status, ratio):
    sizes = spark.createDataFrame(SIZES, "sample_id long, ni int, nj int, nk int")
    got = measure.tortuosity(opened(spark, cells), sizes).first()
    assert got["status"] == status
    if ratio:
        assert got["tortuosity"] == pytest.approx(ratio, abs=1e-3)


def test_end_distance_ratio(spark):
    """A way one step aside for two slices: length over the distance of its ends, which is the axial one here."""
    cells = [(3, 3, 0), (3, 3, 1), (4, 3, 2), (4, 3, 3), (3, 3, 4), (3, 3, 5)]
    sizes = spark.createDataFrame(SIZES, "sample_id long, ni int, nj int, nk int")
    got = measure.tortuosity(opened(spark, cells), sizes, mode=1).first()
    assert got["status"] == "ok" and got["tortuosity"] == pytest.approx((2 * math.sqrt(2) + 1) / 3, abs=1e-6)
    stair = measure.tortuosity(opened(spark, [(k, 3, k) for k in range(N)]), sizes, mode=1).first()
    assert stair["tortuosity"] == pytest.approx(1.0)


@pytest.mark.parametrize("cells, status, ratio", [
    ([(3, 3, k) for k in range(N)], "ok", 1.0),
    ([(2, 2, 0), (3, 3, 1), (2, 2, 2), (3, 3, 3), (2, 2, 4), (3, 3, 5)], "ok", 5 * math.sqrt(3) / 6),
    ([(0, 0, k) for k in range(N)], "no open planes", None),
    ([(3, 3, k) for k in range(N) if k != 3], "no path", None),
    ([], "no open planes", None),
])
def test_plane_tortuosity(spark, cells, status, ratio):
    sizes = spark.createDataFrame(SIZES, "sample_id long, ni int, nj int, nk int")
    got = measure.plane_tortuosity(opened(spark, cells), sizes, margin=2).first()
    assert got["status"] == status and got["tortuosity"] == (pytest.approx(ratio) if ratio else None)


def test_window_choices(spark):
    box = "sample_id long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double"
    samples = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0)], box)
    bounds = spark.createDataFrame([(1, 2.0, 12.0, 1.0, 9.0, -1.0, 5.0)], box)
    rois = spark.createDataFrame([(1, 7, 0.0, 3.0, 0.0, 3.0, 0.0, 3.0), (1, 8, 20.0, 30.0, 0.0, 3.0, 0.0, 3.0)], box.replace("long,", "long, roi_id long,", 1))
    mesh = grid.choose_windows(samples, bounds, choice="mesh").first()
    assert (mesh["xmin"], mesh["xmax"], mesh["zmin"], mesh["status"]) == (2.0, 10.0, 0.0, "ok")
    found = {r["roi_id"]: r for r in grid.choose_windows(samples, bounds, rois, "roi").collect()}
    assert (found[7]["xmin"], found[7]["ymin"], found[7]["status"], found[8]["status"]) == (2.0, 1.0, "ok", "empty")
    with pytest.raises(ValueError):
        grid.choose_windows(samples, bounds, choice="all")


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    want = {x: c for x, c in components([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_largest_part_by_brute_force(spark):
    rng = np.random.default_rng(4)
    cells = np.argwhere(rng.random((6, 6, 6)) < 0.4)
    present = {tuple(c) for c in cells}
    index = {c: (c[0] * 100 + c[1]) * 100 + c[2] for c in present}
    edges = [(index[c], index[d]) for c in present for d in ((c[0] + 1, c[1], c[2]), (c[0], c[1] + 1, c[2]), (c[0], c[1], c[2] + 1)) if d in present]
    label = components(edges)
    groups = {}
    for c, i in index.items():
        groups.setdefault(label.get(i, i), set()).add(c)
    want = max(groups.items(), key=lambda kv: (len(kv[1]), -kv[0]))[1]
    got = {(r["i"], r["j"], r["k"]) for r in bricks.largest_component(opened(spark, cells)).collect()}
    assert got == {tuple(map(int, c)) for c in want}


def test_thinning_keeps_distance_and_is_maximal(spark):
    rng = np.random.default_rng(5)
    pts = rng.random((120, 3)) * 6
    df = spark.createDataFrame([(0, n, *map(float, p)) for n, p in enumerate(pts)], "sample_id long, seed_id long, x double, y double, z double")
    kept = sorted(r["seed_id"] for r in sampling.thin_by_distance(df, 1.5, 1.5).collect())
    want = []
    for n, p in enumerate(pts):
        if all(np.linalg.norm(p - pts[m]) > 1.5 for m in want):
            want.append(n)
    assert kept == want


@pytest.mark.parametrize("parts", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(200).select(F.col("id").alias("row_id")).repartition(int(parts))
        got = sorted(tuple(round(v, 9) for v in r) for r in sampling.latin_hypercube(df, 2, 9).collect())
        assert hash(tuple(got)) == hash(tuple(sorted(tuple(round(v, 9) for v in r) for r in sampling.latin_hypercube(df.repartition(3), 2, 9).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_knn_of_cells_equals_knn_of_arrays(spark):
    rng = np.random.default_rng(6)
    make = lambda n, name: spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rng.random((n, 3)) * 9)], f"sample_id long, {name} long, x double, y double, z double")
    left, right = make(60, "point_id"), make(80, "seed_id")
    key = lambda df: sorted((r["point_id"], r["rank"], r["seed_id"]) for r in df.collect())
    assert key(spatial.knn_join(left, right, 3, ["point_id"])) == key(spatial.knn_join(left, right, 3, ["point_id"], cell=1.0, small_right=0))


def test_sphere_surface_is_closed_and_round(spark):
    shapes = spark.createDataFrame([(0, "sphere", 4.0, 1.0)], "sample_id long, shape string, feature double, voxel double")
    field = sampling.phantom_grid(shapes)
    vertices, faces = surface.iso_surface(field, 1e-6)
    t = surface.topology(faces).first()
    assert t["watertight"] and vertices.count() - t["edges"] + faces.count() == 2
    m = measure.mesh_area_volume(surface.to_soup(vertices, faces)).first()
    assert m["area"] == pytest.approx(4 * math.pi * 4, rel=0.1) and m["volume"] == pytest.approx(4 / 3 * math.pi * 8, rel=0.15)


def test_stl_errors_are_rows(spark, tmp_path):
    (tmp_path / "short.stl").write_bytes(b"x" * 20)
    (tmp_path / "cut.stl").write_bytes(b"\0" * 80 + (3).to_bytes(4, "little") + b"\0" * 60)
    (tmp_path / "ok.stl").write_bytes(b"\0" * 80 + (1).to_bytes(4, "little") + np.zeros(1, mesh_files.RECORD).tobytes())
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in mesh_files.read_stl(spark, str(tmp_path)).collect()}
    assert got["short.stl"] == "shorter than its header" and got["cut.stl"] == "ends within its triangles" and got["ok.stl"] is None


def test_every_point_meets_every_polygon_as_it_is(spark, sf):
    """The query asks all points against all polygons in their own place, where they overlap."""
    from voxframe.operators import polygon
    from voxframe.plans import registry
    from voxframe.plans.fixtures import Fixtures

    tables = Fixtures(spark, sf)
    points = tables.common("points").selectExpr("point_id", "floor(x*60) AS x", "floor(y*60) AS y").toPandas()
    x, y, want = points["x"].to_numpy(float), points["y"].to_numpy(float), set()
    for poly, rows in polygon.counter_clockwise(tables.common("corners")).toPandas().groupby("poly_id"):
        c = rows.sort_values("seq")[["x", "y"]].to_numpy()
        odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(c, np.roll(c, -1, 0)):
            side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
            odd ^= ((ay > y) != (by > y)) & ((side > 0) == (by > ay))
            on |= (side == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        want |= {(int(p), int(poly)) for p in points["point_id"][odd & ~on]}
    got = [tuple(r) for r in registry.queries()["gp9_points_in_polygons"](spark, sf).select("point_id", "poly_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
