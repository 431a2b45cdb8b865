"""The plate model over many settings: solid, rest and the faces between them, counted brick by brick.

A grid's values are stored once, as bricks of SIDE voxels with the layer before them along each axis; a setting (levels, knobs)
then costs one numpy step a brick, and no voxel is a row again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import by_shuffle, materialize
from .bricks import BRICK, CELL, SIDE, _lists

COUNTS = ["solid_voxels", "all_voxels", *(f"faces_{c}" for c in CELL)]


def plate_bricks(voxels: DataFrame, values: list[str], by: list[str] | None = None, side: int = SIDE) -> DataFrame:
    """by, bi, bj, bk, place and an array per value: one stored row a brick, with the voxels before it along each axis."""
    by = by or ["sample_id"]
    home = [F.floor(F.col(c) / side).cast("int") for c in CELL]
    near = [F.when(F.pmod(F.col(c), F.lit(side)) == side - 1, F.struct(*((b + (1 if n == m else 0)).alias(name) for m, (b, name) in enumerate(zip(home, BRICK))))) for n, c in enumerate(CELL)]
    copies = F.filter(F.array(F.struct(*(b.alias(name) for b, name in zip(home, BRICK))), *near), lambda b: b.isNotNull())
    rows = voxels.select(*by, *CELL, *values, F.explode(copies).alias("_b"))
    # places count from the layer before the brick
    at = [(F.col(c) - F.col(f"_b.{b}") * side + 1).cast("int") for c, b in zip(CELL, BRICK)]
    place = (at[0] * (side + 1) + at[1]) * (side + 1) + at[2]
    listed = rows.select(*by, "_b.*", F.struct(place.alias("place"), *values).alias("v")).groupBy(*by, *BRICK).agg(F.collect_list("v").alias("v"))
    return materialize(listed.select(*by, *BRICK, *(F.col(f"v.{c}").alias(c) for c in ("place", *values))), "plates")


def plate_counts(bricks: DataFrame, values: list[str], settings: DataFrame, solid: Callable[[dict[str, np.ndarray], dict], np.ndarray], by: list[str] | None = None, side: int = SIDE) -> DataFrame:
    """Columns of ``settings`` (by, and any number of rows for each) with solid_voxels, all_voxels and the faces between solid and rest along i, j and k.

    ``solid`` takes the values of a brick by name and a row of settings. Faces lie between voxels that are next to one another.
    """
    by = by or ["sample_id"]
    chosen = [c for c in settings.columns if c not in by]
    packed = settings.groupBy(*by).agg(F.collect_list(F.struct(*chosen)).alias("_s"))
    met = bricks.select(*by, "place", *values).join(by_shuffle(packed), by)
    asked = settings.columns
    out = StructType([settings.schema[c] for c in asked])
    for c in COUNTS:
        out = out.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, said, counts = [], [], []
            lists = {c: _lists(batch, c) for c in ("place", *values)}
            for n, every in enumerate(batch["_s"].to_pylist()):
                place = lists["place"][n]
                at = [place // (side + 1) ** 2, place // (side + 1) % (side + 1), place % (side + 1)]
                shape = [int(a.max()) + 1 for a in at]
                flat = (at[0] * shape[1] + at[1]) * shape[2] + at[2]
                own = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
                known = np.zeros(shape, bool)
                known.ravel()[flat] = True
                here = {c: lists[c][n] for c in values}
                for setting in every:
                    is_solid = solid(here, setting)
                    dense = np.zeros(shape, bool)
                    dense.ravel()[flat] = is_solid
                    faces = []
                    for axis in range(3):
                        low = tuple(slice(None, -1) if a == axis else slice(1, None) for a in range(3))
                        high = (slice(1, None),) * 3
                        faces.append(int(np.count_nonzero(known[low] & known[high] & (dense[low] != dense[high]))))
                    rows.append(n)
                    said.append(setting)
                    counts.append([int(np.count_nonzero(is_solid & own)), int(np.count_nonzero(own)), *faces])
            if rows:
                took = pa.array(rows)
                columns = [batch[c].take(took) if c in by else pa.array([s[c] for s in said], batch["_s"].type.value_type.field(c).type) for c in asked]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*counts))], names=out.names)

    return met.mapInArrow(run, out).groupBy(*asked).agg(*(F.sum(c).alias(c) for c in COUNTS))


def plate_figures(counts: DataFrame, step: float) -> DataFrame:
    """The columns of ``counts`` with faces, porosity and thickness (twice the solid over its faces), as ``measure.plate_thickness`` has them."""
    faces = sum((F.col(f"faces_{c}") for c in CELL[1:]), F.col("faces_i"))
    return counts.withColumns({"faces": faces, "porosity": 1 - F.col("solid_voxels") / F.col("all_voxels"), "thickness": F.try_divide(F.col("solid_voxels") * 2.0 * step, faces)})


def axis_ratio() -> Column:
    """Intercepts along i over those across it: faces across over faces along."""
    return F.try_divide((F.col("faces_j") + F.col("faces_k")) / 2.0, F.col("faces_i"))
