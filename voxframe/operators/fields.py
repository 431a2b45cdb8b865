"""Scalar fields from seeds: distance contrasts, blending, clipping, caging, smoothing, sealing.

A field is rows (sample_id, i, j, k, value); solid is value < iso. ``contrasts`` depends on
seeds and grid only and is worth storing; everything after it is a narrow projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.scratch import by_shuffle
from .spatial import nearest_columns

CELL = ["i", "j", "k"]


def contrasts(grid: DataFrame, seeds: DataFrame, gradients: bool = False) -> DataFrame:
    """Grid rows with wall = d2 - d1, strut = d3 - d1, edge = d4 - d1 (d3 where there are three seeds), id1, id2.

    Samples with fewer than three seeds have no such field and give no rows. Gradients are
    differences of the unit vectors from the seeds.
    """
    near = nearest_columns(grid.select("sample_id", *CELL, "x", "y", "z"), seeds, 4, CELL, positions=gradients)
    wide = near.filter("d3 is not null")
    if gradients:
        away = lambda n, a: F.when(F.col(f"d{n}").isNotNull(), F.coalesce(F.try_divide(F.col(a) - F.col(f"s{a}{n}"), F.col(f"d{n}")), F.lit(0.0)))
        wide = wide.withColumns({f"u{n}{a}": away(n, a) for n in range(1, 5) for a in "xyz"}).drop(*(f"s{a}{n}" for n in range(1, 5) for a in "xyz"))
    out = wide.withColumns({"wall": F.col("d2") - F.col("d1"), "strut": F.col("d3") - F.col("d1"), "edge": F.coalesce("d4", "d3") - F.col("d1")})
    if gradients:
        last = lambda a: F.coalesce(f"u4{a}", f"u3{a}")
        out = out.withColumns({f"g{n}{a}": e - F.col(f"u1{a}") for a in "xyz" for n, e in (("w", F.col(f"u2{a}")), ("s", F.col(f"u3{a}")), ("e", last(a)))})
        out = out.drop(*(f"u{n}{a}" for n in range(1, 5) for a in "xyz"))
    return out.withColumn("face_p", g.pair_value(F.col("id1"), F.col("id2"))).drop("d1", "d2", "d3", "d4", "id3", "id4")


def openness(threshold: Column, spread: Column, face_p: Column) -> Column:
    return g.clamp(threshold + spread * (face_p - 0.5), 0, 1)


def boundary_frame(tau: Column, container_distance: Column, depth: Column) -> Column:
    """Openness taken back to 0 within ``depth`` of the container's wall."""
    return tau * g.smoothstep(g.clamp(-container_distance / depth, 0, 1))


def blend(wall: Column, strut: Column, tau: Column) -> Column:
    return (1.0 - tau) * wall + tau * strut


def rounded_edges(wall: Column, strut: Column, edge: Column, k: Column) -> tuple[Column, Column]:
    return g.smooth_min(wall, strut, k), g.smooth_min(strut, edge, k)


def junction_fillet(value: Column, wall: Column, strut: Column, tau: Column, k: Column) -> Column:
    return g.smooth_min(value, strut + (1.0 - tau) * (strut - wall), k)


def gradient_normalised(value: Column, gradient: g.Vector, local_iso: Column, iso: Column) -> Column:
    n = g.norm(gradient)
    return F.when(n > 1e-4, F.try_divide(value, n) * 2.0).otherwise(value) - local_iso + iso


def air_level(iso: Column, largest_step: Column) -> Column:
    return iso + largest_step * 2.0


def stamp_exterior(value: Column, container_distance: Column, iso: Column, largest_step: Column) -> Column:
    return F.when(container_distance > largest_step * 3.0, air_level(iso, largest_step)).otherwise(value)


def clip_to_container(value: Column, container_distance: Column, iso: Column) -> Column:
    return F.greatest(value, container_distance + iso)


def box_edge_distance(p: g.Vector, lo: g.Vector, hi: g.Vector) -> Column:
    """Distance of an inner point to the nearest of the box's twelve edges: its two nearest walls."""
    walls = F.array_sort(F.array(*(F.least(x - a, b - x) for x, a, b in zip(p, lo, hi))))
    return F.sqrt(walls[0] * walls[0] + walls[1] * walls[1])


def cylinder_rim_distance(p: g.Vector, center: tuple[Column, Column], radius: Column, height: Column) -> Column:
    dx, dz = p[0] - center[0], p[2] - center[1]
    side, cap = radius - F.sqrt(dx * dx + dz * dz), F.least(p[1], height - p[1])
    return F.sqrt(side * side + cap * cap)


def edge_cage(value: Column, edge_distance: Column, container_distance: Column, beam: Column, iso: Column) -> Column:
    """Beams along the container's edges, inside it only."""
    return F.when(container_distance <= 0, F.least(value, edge_distance - beam + iso)).otherwise(value)


def legacy_value(d: tuple[Column, Column, Column], threshold: Column, foam: bool = False) -> Column:
    """Older field: d2 - d1 for foam, else d3 - d1 with smoothly lowered second distances."""
    d1, d2, d3 = d
    if foam:
        return d2 - d1
    k = g.lit(0.5)
    return (d3 - d1) + threshold * (g.smooth_min(d2, d3, k) - g.smooth_min(d1, d2, k))


def assemble(cached: DataFrame, iso: float, threshold: float, spread: float = 0.0) -> DataFrame:
    """Field rows of stored contrasts for one recipe; changing the recipe re-runs only this projection."""
    tau = openness(F.lit(threshold), F.lit(spread), F.col("face_p"))
    return cached.select("sample_id", *CELL, blend(F.col("wall"), F.col("strut"), tau).alias("value"))


def seal(field: DataFrame, iso: float, step: float) -> DataFrame:
    """Outermost index layer of each sample set to air; the sizes travel as one small row per sample."""
    ends = field.groupBy("sample_id").agg(*(f(c).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in CELL))
    rim = reduce(lambda a, b: a | b, (F.col(c).isin(F.col(f"_lo{c}"), F.col(f"_hi{c}")) for c in CELL))
    return field.join(by_shuffle(ends), "sample_id").withColumn("value", F.when(rim, air_level(F.lit(iso), F.lit(step))).otherwise(F.col("value"))).select(*field.columns)


def porosity(field: DataFrame, iso: float, domain: Column | None = None) -> DataFrame:
    """1 - solid / domain voxels per sample."""
    dom = F.lit(True) if domain is None else domain
    return field.groupBy("sample_id").agg(F.count_if(dom).alias("domain_voxels"), F.count_if(dom & (F.col("value") < iso)).alias("solid_voxels")).withColumn(
        "porosity", 1.0 - F.col("solid_voxels") / F.col("domain_voxels"))


# stencils

def axis_neighbours(field: DataFrame, axis: str, value: str = "value") -> tuple[Column, Column]:
    """Values one step back and ahead along an axis (null at the border or a gap)."""
    order = Window.partitionBy("sample_id", *(c for c in CELL if c != axis)).orderBy(axis)
    step = lambda f, d: F.when(f(axis).over(order) == F.col(axis) + d, f(value).over(order))
    return step(F.lag, -1), step(F.lead, 1)


def box_blur(field: DataFrame) -> DataFrame:
    """Mean of the 3x3x3 neighbourhood where it is whole; the border keeps its value.

    Separable: three sums along lines, so no row is multiplied.
    """
    out = field.withColumn("_s", F.col("value")).withColumn("_n", F.lit(1))
    for axis in CELL:
        back, ahead = axis_neighbours(out, axis, "_s")
        nb, na = axis_neighbours(out, axis, "_n")
        out = out.select(*field.columns, (F.coalesce(back, F.lit(0.0)) + F.col("_s") + F.coalesce(ahead, F.lit(0.0))).alias("_s"),
                         (F.coalesce(nb, F.lit(0)) + F.col("_n") + F.coalesce(na, F.lit(0))).alias("_n"))
    return out.withColumn("value", F.when(F.col("_n") == 27, F.col("_s") / 27.0).otherwise(F.col("value"))).select(*field.columns)


def binomial_blur(field: DataFrame, air: float) -> DataFrame:
    """1-2-1 weights along each axis over the rows below ``air``; air rows and rows with air around stay as they are apart from the missing weight."""
    weight = F.when(F.col("value") < air, 1.0).otherwise(0.0)
    out = field.withColumn("_w", weight).withColumn("_s", F.col("_w") * F.col("value"))
    zero = F.lit(0.0)
    for axis in CELL:
        sb, sa = axis_neighbours(out, axis, "_s")
        wb, wa = axis_neighbours(out, axis, "_w")
        out = out.select(*field.columns, (F.coalesce(sb, zero) + F.col("_s") * 2.0 + F.coalesce(sa, zero)).alias("_s"),
                         (F.coalesce(wb, zero) + F.col("_w") * 2.0 + F.coalesce(wa, zero)).alias("_w"))
    return out.withColumn("value", F.when((F.col("value") < air) & (F.col("_w") > 0), F.try_divide("_s", "_w")).otherwise(F.col("value"))).select(*field.columns)


def taubin_pass(field: DataFrame, factor: float, steps: tuple[float, float, float] = (1.0, 1.0, 1.0), air: float | None = None) -> DataFrame:
    """One pass of value + factor * (weighted neighbour mean - value); border and air rows stay."""
    weights = {c: 1.0 / (s * s) for c, s in zip(CELL, steps)}
    out = field.withColumn("_m", F.lit(0.0))
    for axis in CELL:
        back, ahead = axis_neighbours(out, axis)
        out = out.withColumn("_m", F.col("_m") + (back + ahead) * weights[axis])
    mean = F.col("_m") / (2.0 * sum(weights.values()))
    moved = F.col("value") + (mean - F.col("value")) * factor
    free = mean.isNotNull() if air is None else mean.isNotNull() & (F.col("value") < air)
    return out.withColumn("value", F.when(free, moved).otherwise(F.col("value"))).select(*field.columns)


def taubin_smooth(field: DataFrame, rounds: int, lam: float = 0.5, mu: float = -0.53, **kw) -> DataFrame:
    for n in range(rounds):
        field = taubin_pass(taubin_pass(field, lam, **kw), mu, **kw)
        if n % 3 == 2:  # six passes are eighteen exchanges: store before the plan grows on
            from ..sources.scratch import materialize

            field = materialize(field, "smooth")
    return field


BRICK = 16


def taubin_bricks(field: DataFrame, rounds: int, lam: float = 0.5, mu: float = -0.53, steps: tuple[float, float, float] = (1.0, 1.0, 1.0), halo: int = 4) -> DataFrame:
    """The same smoothing on bricks of 16^3 voxels with ``halo`` layers of their neighbours: one shuffle per ``halo`` passes.

    Group size is bounded by (16 + 2 halo)^3 rows whatever the grid. Voxels must fill the sample's box.
    """
    from ..sources.scratch import materialize

    passes = [f for _ in range(rounds) for f in (lam, mu)]
    w = [1.0 / (s * s) for s in steps]
    size = field.groupBy("sample_id").agg(*(F.max(c).alias(f"_n{c}") for c in CELL))
    field = field.select("sample_id", *CELL, "value")
    for at in range(0, len(passes), halo):
        part = passes[at:at + halo]
        reach = len(part)
        spread = field.join(size, "sample_id")
        for c in CELL:
            inside = F.floor(F.col(c) / BRICK).cast("int")
            around = F.array_distinct(F.array(*(F.floor((F.col(c) + d) / BRICK).cast("int") for d in (-reach, 0, reach))))
            spread = spread.withColumn(f"b{c}", F.explode(around)).withColumn(f"_own{c}", F.col(f"b{c}") == inside)

        field = materialize(spread.groupBy("sample_id", "bi", "bj", "bk").applyInPandas(
            _brick_passes(part, w), "sample_id long, i int, j int, k int, value double"), "bricks")
    return field


def _brick_passes(factors: list[float], w: list[float]):
    """Function that runs the passes on one brick with its halo and returns the brick's own voxels."""
    import numpy as np
    import pandas as pd

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = pdf[CELL].min().to_numpy()
        shape = pdf[CELL].max().to_numpy() - lo + 1
        at = tuple((pdf[c] - lo[n]).to_numpy() for n, c in enumerate(CELL))
        v = np.full(shape, np.nan)
        v[at] = pdf["value"]
        top = pdf[["_ni", "_nj", "_nk"]].iloc[0].to_numpy()
        fixed = np.zeros(shape, bool)
        for n in range(3):
            index = np.arange(shape[n]) + lo[n]
            rim = (index == 0) | (index == top[n])
            fixed |= np.expand_dims(rim, tuple(m for m in range(3) if m != n))
        for factor in factors:
            padded = np.pad(v, 1, constant_values=np.nan)
            mean = sum(w[n] * (np.take(padded, range(0, shape[n]), n) + np.take(padded, range(2, shape[n] + 2), n))[
                tuple(slice(None) if m == n else slice(1, -1) for m in range(3))] for n in range(3)) / (2 * sum(w))
            v = np.where(fixed, v, v + (mean - v) * factor)
        own = pdf["_owni"] & pdf["_ownj"] & pdf["_ownk"]
        out = pdf.loc[own, ["sample_id", *CELL]].copy()
        out["value"] = v[tuple(a[own.to_numpy()] for a in at)]
        return out

    return smooth
