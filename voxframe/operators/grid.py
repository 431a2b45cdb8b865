"""Regular grids as rows, regions, and resampling of a stored field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import lit

CELL = ["i", "j", "k"]
#: Side of the bricks by which regions find their voxels.
BRICK = 16


def grid_size(extent: Column, step: Column, rule: str = "ceil") -> Column:
    """Points along an axis: ``ceil`` gives ceil(extent / step) + 1, ``floor`` max(2, int(extent / step))."""
    if rule == "ceil":
        return (F.ceil(extent / step) + 1).cast("int")
    return F.greatest(F.lit(2), F.floor(extent / step).cast("int"))


def grid_points(samples: DataFrame, pad: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """All (i, j, k) of each sample with their position.

    ``samples``: sample_id, xmin..zmax, nx, ny, nz. The step is extent / (n - 1); ``pad``
    layers are added on every side with the same step, their indices below 0 and from n on.
    The rows of a sample are spread over tasks by slab before they multiply.
    """
    step = {a: ((F.col(f"{a}max") - F.col(f"{a}min")) / (F.col(f"n{a}") - 1)) for a in "xyz"}
    base = samples.select("sample_id", *keep, *(F.col(f"{a}min").alias(f"_{a}") for a in "xyz"), *(step[a].alias(f"_d{a}") for a in "xyz"), "nx", "ny", "nz")
    span = lambda n: F.sequence(F.lit(-pad), F.col(n) - 1 + pad)
    slabs = base.withColumn("k", F.explode(span("nz"))).repartition("sample_id", "k")
    return slabs.withColumn("j", F.explode(span("ny"))).withColumn("i", F.explode(span("nx"))).select(
        "sample_id", *keep, "i", "j", "k", *((F.col(f"_{a}") + F.col(c) * F.col(f"_d{a}")).alias(a) for a, c in zip("xyz", CELL)))


def grid_index(point: Column, low: Column, step: Column) -> Column:
    """Index of the grid point nearest below a position."""
    return F.floor((point - low) / step).cast("int")


def flat_index(nx: Column, ny: Column) -> Column:
    """Position of (i, j, k) in an array with i fastest."""
    return (F.col("k").cast("long") * ny + F.col("j")) * nx + F.col("i")


def scale_about_centre(points: DataFrame, factor: Column | float, by: str = "sample_id") -> DataFrame:
    """Points moved away from (or towards) the centre of their bounds; the bounds travel as one small row per sample."""
    middle = points.groupBy(by).agg(*(((F.min(a) + F.max(a)) / 2).alias(f"_{a}") for a in "xyz"))
    f = lit(factor)
    return points.join(middle, by).withColumns({a: F.col(f"_{a}") + (F.col(a) - F.col(f"_{a}")) * f for a in "xyz"}).drop("_x", "_y", "_z")


def clip_regions(rois: DataFrame, bounds: DataFrame) -> DataFrame:
    """Regions (sample_id, roi_id, xmin..zmax) cut to their sample's bounds; status 'ok' or 'empty'."""
    b = bounds.select("sample_id", *(F.col(f"{a}{m}").alias(f"_{a}{m}") for a in "xyz" for m in ("min", "max")))
    cut = rois.join(b, "sample_id").select(
        "sample_id", "roi_id", *(F.greatest(f"{a}min", f"_{a}min").alias(f"{a}min") for a in "xyz"),
        *(F.least(f"{a}max", f"_{a}max").alias(f"{a}max") for a in "xyz"))
    full = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")) & (F.col("zmin") < F.col("zmax"))
    return cut.withColumn("status", F.when(full, "ok").otherwise("empty"))


def choose_windows(samples: DataFrame, bounds: DataFrame | None = None, rois: DataFrame | None = None, choice: str = "grid") -> DataFrame:
    """sample_id, roi_id, xmin..zmax, status: the boxes to which measures of a sample are limited.

    ``grid`` is the whole grid, ``mesh`` the bounds of the sample's mesh, ``roi`` its regions cut to these
    bounds; all are cut to the grid. Status ``empty`` where nothing is left.
    """
    if choice not in ("grid", "mesh", "roi"):
        raise ValueError(f"unknown window {choice}")
    box = [f"{a}{m}" for a in "xyz" for m in ("min", "max")]
    if choice == "roi":
        wanted = clip_regions(rois, bounds).drop("status")
    else:
        wanted = (samples if choice == "grid" else bounds).select("sample_id", F.lit(0).cast("long").alias("roi_id"), *box)
    return clip_regions(wanted, samples)


def extract_regions(voxels: DataFrame, rois: DataFrame, samples: DataFrame) -> DataFrame:
    """The part of the stored field in each region as a sample (sample_id, roi_id) of its own, indices from 0.

    Bounds are snapped outwards to grid points and kept within the grid. Regions are met brick by brick,
    so a voxel is only compared with regions that touch its brick.
    """
    axes = list(zip("xyz", CELL))
    meta = samples.select("sample_id", *(F.col(f"{a}min").alias(f"_{a}") for a in "xyz"), *(
        ((F.col(f"{a}max") - F.col(f"{a}min")) / (F.col(f"n{a}") - 1)).alias(f"_d{a}") for a in "xyz"), "nx", "ny", "nz")
    snapped = rois.join(meta, "sample_id").select("sample_id", "roi_id", *(
        F.greatest(F.floor((F.col(f"{a}min") - F.col(f"_{a}")) / F.col(f"_d{a}")).cast("int"), F.lit(0)).alias(f"{c}0") for a, c in axes), *(
        F.least(F.ceil((F.col(f"{a}max") - F.col(f"_{a}")) / F.col(f"_d{a}")).cast("int"), F.col(f"n{a}") - 1).alias(f"{c}1") for a, c in axes))
    brick = lambda c: F.floor(c / BRICK).cast("int")
    for c in CELL:
        snapped = snapped.filter(F.col(f"{c}0") <= F.col(f"{c}1"))
    for c in CELL:
        snapped = snapped.withColumn(f"_b{c}", F.explode(F.sequence(brick(F.col(f"{c}0")), brick(F.col(f"{c}1")))))
    hit = voxels.withColumns({f"_b{c}": brick(F.col(c)) for c in CELL}).join(snapped, ["sample_id", *(f"_b{c}" for c in CELL)])
    for c in CELL:
        hit = hit.filter(F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")))
    return hit.select("sample_id", "roi_id", *((F.col(c) - F.col(f"{c}0")).alias(c) for c in CELL), "value")


def resample(voxels: DataFrame, targets: DataFrame, iso: float, inverse: bool = False) -> DataFrame:
    """Trilinear values of the stored field at target voxels, and whether they are solid.

    ``targets``: sample_id, i, j, k and the position in grid units (gx, gy, gz). Each target
    needs eight field rows: it is exploded to weighted corners and met by an equi-join, so a
    grid of any size is joined by shuffle. Targets outside the grid are not solid, inverted or not.
    """
    frac = {c: F.col(f"g{a}") - F.floor(F.col(f"g{a}")) for a, c in zip("xyz", CELL)}
    corners = [F.struct(*((F.floor(F.col(f"g{a}")).cast("int") + int(d)).alias(f"c{c}") for a, c, d in zip("xyz", CELL, bits)),
                        _weight(frac, bits).alias("weight")) for bits in ((x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1))]
    spread = targets.select("sample_id", *CELL, F.explode(F.array(*corners)).alias("c")).select("sample_id", *CELL, "c.*").filter("weight > 0")
    field = voxels.select("sample_id", *(F.col(c).alias(f"c{c}") for c in CELL), "value")
    mixed = spread.join(field, ["sample_id", "ci", "cj", "ck"], "left").groupBy("sample_id", *CELL).agg(
        F.sum(F.col("weight") * F.col("value")).alias("value"), F.count("*").alias("n"), F.count("value").alias("m"))
    value = F.when(F.col("n") == F.col("m"), F.col("value"))
    solid = (value >= iso) if inverse else (value < iso)
    return mixed.select("sample_id", *CELL, value.alias("value"), F.coalesce(solid, F.lit(False)).alias("solid"))


def _weight(frac: dict[str, Column], bits: tuple[int, int, int]) -> Column:
    out = F.lit(1.0)
    for c, d in zip(CELL, bits):
        out = out * (frac[c] if d else 1.0 - frac[c])
    return out
