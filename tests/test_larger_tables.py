"""What only larger tables bring about: part numbers that reach into those of the suppliers, points on borders, large shares of a table in one place."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import geometry as g
from voxframe.operators import fields, measure, plates, spatial, surface
from voxframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(tuple, df.itertuples(index=False)))
    return key(got) == key(want)


@pytest.mark.parametrize("name", ["gp5_vertex_counts", "gp1_added_edges", "gp2_removed"])
def test_parts_numbered_like_suppliers(spark, tmp_path, name):
    """Part 1000007 and supplier 7 (vertex 1000007) are two vertices."""
    lines = [(1, p, s, 0.09) for p in (3, 1000006, 1000007, 1000014, 1000021) for s in (6, 7, 14, 20, 21)] + [(2, 5, 20, 0.08), (2, 1000020, 5, 0.1), (1, 21, 3, 0.09)]
    spark.createDataFrame(lines, "l_linenumber int, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, 14), (1000007, 3), (1000014, 20), (1000021, 7), (1000003, 21)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert same(spark, tmp_path, name)

def test_rays_on_a_border_hit(spark):
    """Places on the long side of a triangle, of which u + v is one in numbers divided once."""
    rows = [(n / 100, 16 - n / 100) for n in range(100, 1501)]
    on = [r for r in rows if (r[0] - 1) / 14.0 + (r[1] - 1) / 14.0 <= 1]
    three = lambda *v: tuple(F.lit(float(x)) for x in v)
    hit = g.ray_meets_triangle((F.lit(0.0), F.col("y"), F.col("z")), three(1, 0, 0), three(12, 1, 1), three(12, 15, 1), three(12, 1, 15))
    assert spark.createDataFrame(rows, "y double, z double").filter(hit.isNotNull()).count() == len(on)


def test_nearest_columns_by_brute_force(spark, monkeypatch):
    """Ranks side by side and as rows, with ties, few seeds, keys without any, and keys dealt to several tasks."""
    rng = np.random.default_rng(3)
    left = [(k, n, *map(float, rng.integers(0, 4, 3))) for k in range(4) for n in range(40)]
    right = [(k, n, *map(float, rng.integers(0, 4, 3))) for k, m in ((0, 30), (1, 2), (2, 9)) for n in range(m)]
    points = spark.createDataFrame(left, "sample_id long, point_id long, x double, y double, z double")
    seeds = spark.createDataFrame(right[::-1], "sample_id long, seed_id long, x double, y double, z double")
    want = {}
    for k, n, *p in left:
        order = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), s) for j, s, *q in right if j == k)
        if order:
            want[k, n] = [d2 ** 0.5 for d2, _ in order[:4]] + [None] * (4 - len(order[:4])) + [s for _, s in order[:4]] + [None] * (4 - len(order[:4]))
    for most in (1 << 20, 7):
        monkeypatch.setattr(spatial, "KEY_ROWS", most)
        for small in (5000, 0):
            got = spatial.nearest_columns(points, seeds, 4, ["point_id"], small_right=small)
            assert {(r["sample_id"], r["point_id"]): [*r[5:]] for r in got.collect()} == want
        rows = {(r["sample_id"], r["point_id"], r["rank"]): r["seed_id"] for r in spatial.knn_join(points, seeds, 4, ["point_id"]).collect()}
        assert rows == {(*key, n + 1): row[4 + n] for key, row in want.items() for n in range(4) if row[4 + n] is not None}


@pytest.mark.parametrize("name", ["fd1_contrasts", "fd9_gradient_normalised", "fd20_legacy_field", "sj10_voronoi_cells"])
def test_a_grid_is_never_broadcast(spark, sf, name):
    """Spark takes a grid for as small as the samples it is made of."""
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_plates_over_bricks(spark):
    """Counts by bricks of four voxels, for two settings at once, are those of windows along the lines."""
    rng = np.random.default_rng(5)
    rows = [(n, i, j, k, float(rng.random())) for n in range(2) for i in range(9) for j in range(6) for k in range(5)]
    field = spark.createDataFrame(rows, "sample_id long, i int, j int, k int, value double")
    settings = spark.createDataFrame([(n, s, s / 4) for n in range(2) for s in (1, 2)], "sample_id long, step int, iso double")
    counts = plates.plate_counts(plates.plate_bricks(field, ["value"], side=4), ["value"], settings, lambda v, s: v["value"] < s["iso"], side=4)
    got = {(r["sample_id"], r["step"]): (r["solid_voxels"], r["faces"], r["porosity"], r["thickness"]) for r in plates.plate_figures(counts, 2.0).collect()}
    levels = field.join(settings, "sample_id").withColumn("solid", F.col("value") < F.col("iso"))
    want = measure.plate_thickness(levels, 2.0, ["sample_id", "step"]).collect()
    assert got == {(r["sample_id"], r["step"]): (r["solid_voxels"], r["faces"], r["porosity"], r["thickness"]) for r in want}


def test_weld_in_tasks_and_by_windows(spark):
    """Both ways give the same numbers, also where samples are welded a few triangles at a time."""
    rng = np.random.default_rng(7)
    rows = [(s, t * 3, *map(float, rng.integers(-2, 3, 9) * 0.5)) for s in range(5) for t in range(12)]
    soup = spark.createDataFrame(rows[::-1], "sample_id long, tri_id long, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz"))
    parts = [[sorted(map(tuple, df.select(*names).collect())) for df, names in zip(surface.weld(soup, 1e-6, small), (["sample_id", "vertex_id", "x", "y", "z"], ["sample_id", "face_id", "v1", "v2", "v3"]))]
             for small in (1 << 20, 0)]
    assert parts[0] == parts[1] and len(parts[0][1]) == 60


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_sides_are_not_broadcast(spark):
    """Tables that an explode multiplies inside joins keep out of the driver, however small Spark takes them for."""
    points = spark.createDataFrame([(0, n, float(n), 0.0, 0.0) for n in range(4)], "sample_id long, seed_id long, x double, y double, z double")
    assert "BroadcastHashJoin" not in joins(spatial.radius_join(points.withColumnRenamed("seed_id", "own"), points, 1.5, 1.5))
    voxels = spark.createDataFrame([(0, i, j, k, 1, True) for i in range(3) for j in range(3) for k in range(3)], "sample_id long, i int, j int, k int, d2 long, solid boolean")
    assert "BroadcastHashJoin" not in joins(measure.paint_spheres(voxels, voxels))
    assert "Inner, BuildRight" not in joins(measure.ridge(voxels)) and "Inner, BuildLeft" not in joins(measure.ridge(voxels))
    assert "BroadcastHashJoin" not in joins(fields.seal(voxels.withColumn("value", F.lit(0.5)), 0.4, 1.0))
