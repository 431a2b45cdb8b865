"""Maximal minimum-distance points: apart, without room for another, the same for a seed whatever the partitions."""

import numpy as np
from pyspark.sql import functions as F

from voxframe.operators import sampling

BOX = "sample_id long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double"


def drawn(df):
    return np.array(sorted((r["x"], r["y"], r["z"]) for r in df.collect()))


def nearest(spots, points):
    return np.sqrt(((spots[:, None] - points[None]) ** 2).sum(-1)).min(axis=1)


def test_points_fill_their_box(spark):
    box = spark.createDataFrame([(1, 0.0, 5.0, -1.0, 3.0, 2.0, 8.0), (2, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], BOX)
    got = sampling.maximal_points(box, 1.3, seed=3).cache()
    points = drawn(got.filter("sample_id = 1"))
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) + np.eye(len(points)) * 9
    assert gaps.min() > 1.3 and got.select("seed_id").distinct().count() == got.count()
    spots = np.random.default_rng(0).uniform((0, -1, 2), (5, 3, 8), (20000, 3))
    assert nearest(spots, points).max() <= 1.3 + 1e-3
    again = sampling.maximal_points(box.repartition(3, "xmax"), 1.3, seed=3)
    assert (drawn(again.filter("sample_id = 1")) == points).all()
    assert len(drawn(got.filter("sample_id = 2"))) >= 1


def test_points_keep_inside(spark):
    box = spark.createDataFrame([(1, -2.0, 2.0, -2.0, 2.0, -2.0, 2.0)], BOX)
    points = drawn(sampling.maximal_points(box, 1.0, 5, F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= 4.0, levels=4))
    assert (np.linalg.norm(points, axis=1) <= 2).all()
    spots = np.random.default_rng(1).uniform(-2, 2, (8000, 3))
    assert nearest(spots[np.linalg.norm(spots, axis=1) <= 2], points).max() < 1.0 + 0.1


def test_seed_rule():
    assert sampling.resolve_seed(9) == 9 and sampling.resolve_seed(0) != sampling.resolve_seed(0)
