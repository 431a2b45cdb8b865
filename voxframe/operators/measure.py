"""Measures: areas and volumes, distance transform, local thickness, intercepts, anisotropy, Euler number, tortuosity, statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.scratch import by_shuffle, materialize
from .bricks import FAR, shortest_paths, trace_back

CELL = ["i", "j", "k"]
KEY = ["sample_id", *CELL]


# meshes

def mesh_area_volume(soup: DataFrame) -> DataFrame:
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    area = g.norm(g.cross(g.sub(b, a), g.sub(c, a))) / 2
    return soup.groupBy("sample_id").agg(F.sum(area).alias("area"), (F.abs(F.sum(g.dot(a, g.cross(b, c)))) / 6).alias("volume"))


def mesh_ratios(measured: DataFrame, domain: DataFrame) -> DataFrame:
    """porosity = 1 - V / domain, bs_bv = area / V, bs_tv = area / domain; ``domain``: sample_id, domain_volume."""
    return measured.join(domain, "sample_id").withColumns({
        "porosity": 1.0 - F.col("volume") / F.col("domain_volume"), "bs_bv": F.try_divide("area", "volume"), "bs_tv": F.col("area") / F.col("domain_volume")})


def structure_model_index(vertices: DataFrame, faces: DataFrame, step: float) -> DataFrame:
    """6 V S' / S^2 with S' from the area after moving vertices by 0.05 x step along their normals: 0 plates, 3 rods, 4 balls."""
    from .surface import to_soup, vertex_normals

    h = 0.05 * step
    moved = vertex_normals(vertices, faces, "area").select("sample_id", "vertex_id", *((F.col(a) + F.col(f"n{a}") * h).alias(a) for a in "xyz"))
    before, after = mesh_area_volume(to_soup(vertices, faces)), mesh_area_volume(to_soup(moved, faces))
    return before.join(after.select("sample_id", F.col("area").alias("_grown")), "sample_id").withColumn(
        "smi", 6.0 * F.col("volume") * (F.col("_grown") - F.col("area")) / h / (F.col("area") * F.col("area"))).drop("_grown")


def connectivity_density(vertices: DataFrame, faces: DataFrame, domain: DataFrame) -> DataFrame:
    """chi = V - E + F of the mesh and (1 - chi / 2) / domain volume."""
    from .surface import mesh_edges

    counts = [df.groupBy("sample_id").agg(F.count("*").alias(n)) for df, n in ((vertices, "n_vertices"), (mesh_edges(faces), "n_edges"), (faces, "n_faces"))]
    joined = reduce(lambda a, b: a.join(b, "sample_id"), counts).join(domain, "sample_id")
    return joined.withColumn("chi", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).withColumn(
        "conn_d", (1.0 - F.col("chi") / 2) / F.col("domain_volume"))


def _corner_shares() -> list[int]:
    """Eight times the share of a corner in vertices - edges + faces - cubes, for each choice of solid voxels around it.

    Bit x + 2y + 4z stands for the voxel on side (x, y, z). The corner is one vertex; an edge runs to each of six sides and
    belongs to two corners, a face to four, a cube to eight; each is there if any voxel it touches is.
    """
    cells = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    touch = {c: sum(1 << (x + 2 * y + 4 * z) for x in (0, 1) for y in (0, 1) for z in (0, 1) if all(d == 0 or d == 2 * s - 1 for d, s in zip(c, (x, y, z)))) for c in cells}
    size = lambda c: sum(d != 0 for d in c)
    return [sum((-1) ** size(c) * 8 // 2 ** size(c) for c in cells if code & touch[c]) for code in range(256)]


def euler_number(solid: DataFrame) -> DataFrame:
    """chi of each sample's solid voxels as closed cubes: vertices - edges + faces - cubes, each counted once.

    A voxel sends one bit to each of its eight corners; a corner's bits name its share in a table of 256.
    """
    spots = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(a) for c, d, a in zip(CELL, s, "xyz")), F.lit(1 << sum((1 - d) << n for n, d in enumerate(s))).alias("bit"))
                                for s in [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)])))
    codes = solid.select("sample_id", *CELL).distinct().select("sample_id", spots.alias("p")).groupBy("sample_id", "p.x", "p.y", "p.z").agg(F.sum("p.bit").cast("int").alias("code"))
    share = F.element_at(F.array(*map(F.lit, _corner_shares())), F.col("code") + 1)
    return codes.groupBy("sample_id").agg((F.sum(share) / 8).cast("long").alias("chi"))


# distance transform and local thickness

def lower_envelope(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """min over w of value(w) + (u - w)^2 at every place u, for many lines at once (rows; places ascend, FAR marks no value).

    One sweep keeps the parabolas of the lower envelope as a stack per line, a second reads them; both are linear in
    the length of a line, and each step works on all lines.
    """
    lines, n = at.shape
    rows = np.arange(lines)
    stack, start = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    for q in range(n):
        todo = rows[value[:, q] < FAR]
        cut = np.full(lines, -np.inf)
        while len(todo):
            todo = todo[top[todo] >= 0]
            v = stack[todo, top[todo]]
            a, b = at[todo, v], at[todo, q]
            cut[todo] = ((value[todo, q] + b * b) - (value[todo, v] + a * a)) / (2.0 * (b - a))
            todo = todo[cut[todo] <= start[todo, top[todo]]]
            top[todo] -= 1
            cut[todo] = -np.inf
        own = rows[value[:, q] < FAR]
        top[own] += 1
        stack[own, top[own]], start[own, top[own]] = q, cut[own]
        start[own, top[own] + 1] = np.inf
    out, here = np.full((lines, n), FAR), np.zeros(lines, np.int64)
    some = rows[top >= 0]
    for q in range(n):
        ahead = some
        while len(ahead):
            ahead = ahead[start[ahead, here[ahead] + 1] < at[ahead, q]]
            here[ahead] += 1
        v = stack[some, here[some]]
        out[some, q] = value[some, v] + (at[some, q] - at[some, v]) ** 2
    return out


def _line_minimum(df: DataFrame, axis: str, value: str) -> DataFrame:
    """min over the line along ``axis`` of value(w) + (u - w)^2, for every row u; lines are arrays of at most one grid side."""
    rest = [c for c in CELL if c != axis]
    lines = df.groupBy("sample_id", *rest).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).cast("long").alias("u"), F.coalesce(value, F.lit(int(FAR))).alias("g")))).alias("line"))
    schema = f"sample_id long, {rest[0]} int, {rest[1]} int, {axis} int, {value} long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch["u"].offsets.to_numpy()
            sizes, n = np.diff(offsets), int(np.diff(offsets).max(initial=0))
            # places are filled up to the longest line of the batch; nothing lies there
            row, col = np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], sizes)
            at, known = np.zeros((len(sizes), n), np.int64), np.full((len(sizes), n), FAR)
            at[:] = np.arange(n) + (1 << 22)
            at[row, col], known[row, col] = batch["u"].values.to_numpy()[offsets[0]:offsets[-1]], batch["g"].values.to_numpy()[offsets[0]:offsets[-1]]
            best = lower_envelope(at, known)[row, col]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(row)) for c in ("sample_id", *rest)), pa.array(at[row, col].astype(np.int32)), pa.array(best, mask=best >= FAR)],
                                             names=["sample_id", *rest, axis, value])

    return lines.select("sample_id", *(F.col(c).cast("int") for c in rest), F.col("line.u").alias("u"), F.col("line.g").alias("g")).mapInArrow(run, schema)


def distance_transform(image: DataFrame) -> DataFrame:
    """sample_id, i, j, k, d2: exact squared distance of every voxel to the nearest background voxel.

    ``image``: all voxels with ``solid``. Three separable passes keyed by line; null where a sample has no background.
    """
    order = Window.partitionBy("sample_id", "j", "k").orderBy("i")
    back = F.last(F.when(~F.col("solid"), F.col("i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(~F.col("solid"), F.col("i")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("i") - back, ahead - F.col("i"))
    first = image.select(*KEY, (near * near).cast("long").alias("d2"))
    return _line_minimum(_line_minimum(first, "j", "d2"), "k", "d2").select(*KEY, "d2")


def ridge(distances: DataFrame) -> DataFrame:
    """Foreground voxels (d2 > 0) whose ball no neighbour's ball contains: r + distance <= r of the neighbour + 0.001."""
    offsets = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x or y or z]
    fore = distances.filter("d2 > 0")
    near = fore.select("sample_id", F.sqrt("d2").alias("_r"), F.explode(F.array(*(
        F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, o)), F.lit(math.sqrt(sum(d * d for d in o))).alias("w")) for o in offsets))).alias("o")).select("sample_id", "o.*", "_r")
    covered = fore.join(by_shuffle(near), KEY).filter(F.sqrt("d2") + F.col("w") <= F.col("_r") + 0.001).select(*KEY).distinct()
    return fore.join(covered, KEY, "left_anti")


def paint_spheres(ridges: DataFrame, voxels: DataFrame) -> DataFrame:
    """sample_id, i, j, k, diameter: the widest 2r of any ridge ball that covers each given voxel.

    A ball is a run of i per (j, k) line; runs of one line are merged by a sweep that keeps, at each
    start and end, the widest open run, so voxels meet a line's runs once and no ball is exploded to voxels.
    """
    r = F.sqrt("d2")
    whole = F.ceil(r).cast("int") - 1
    rows = ridges.filter("d2 > 0").withColumn("dk", F.explode(F.sequence(-whole, whole))).withColumn("dj", F.explode(F.sequence(-whole, whole)))
    left = F.col("d2") - F.col("dk") * F.col("dk") - F.col("dj") * F.col("dj")
    half = (F.ceil(F.sqrt(left)) - 1).cast("int")
    runs = rows.filter(left > 0).select("sample_id", (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"), F.col("i").alias("_c"), half.alias("_h"), (r * 2).alias("diameter"))
    best = runs.groupBy("sample_id", "j", "k", "_c", "_h").agg(F.max("diameter").alias("diameter"))
    lines = best.groupBy("sample_id", "j", "k").agg(F.sort_array(F.collect_list(F.struct(F.col("diameter"), (F.col("_c") - F.col("_h")).alias("lo"), (F.col("_c") + F.col("_h")).alias("hi"))), asc=False).alias("runs"))
    widest = F.get(F.filter("runs", lambda x: (x["lo"] <= F.col("i")) & (F.col("i") <= x["hi"])), F.lit(0))["diameter"]
    return voxels.select(*KEY).join(by_shuffle(lines), ["sample_id", "j", "k"]).select(*KEY, widest.alias("diameter")).filter("diameter is not null")


def local_thickness(image: DataFrame, voxel: float, inverse: bool = False) -> DataFrame:
    """sample_id, mean and population sd of the local thickness of the solid (or, inverted, of the pores) in length units.

    ``image``: all voxels with ``solid`` and, if only part counts, ``inside``.
    """
    image = image.withColumn("solid", ~F.col("solid") if inverse else F.col("solid"))
    distances = materialize(distance_transform(image), "distances")
    counted = image.filter(F.col("solid") & F.col("inside") if "inside" in image.columns else F.col("solid"))
    painted = paint_spheres(ridge(distances), counted)
    return painted.groupBy("sample_id").agg((F.avg("diameter") * voxel).alias("thickness"), (F.stddev_pop("diameter") * voxel).alias("thickness_sd"))


def plate_thickness(voxels: DataFrame, step: float, keys: list[str] | None = None) -> DataFrame:
    """keys, solid_voxels, faces, porosity, thickness of gridded voxels with ``solid``: twice the solid over the faces between solid and rest.

    The plate model: a cheap stand-in for local thickness inside sweeps and solvers, one pass of windows along the lines.
    """
    keys = keys or ["sample_id"]
    turns = {}
    for c in CELL:
        order = Window.partitionBy(*keys, *(o for o in CELL if o != c)).orderBy(c)
        turns[f"_{c}"] = F.coalesce((F.col("solid") != F.lag("solid").over(order)).cast("int"), F.lit(0))
    counted = voxels.withColumns(turns).groupBy(*keys).agg(F.count_if("solid").alias("solid_voxels"), F.count("*").alias("_all"), F.sum(sum((F.col(f"_{c}") for c in CELL[1:]), F.col("_i"))).alias("faces"))
    return counted.select(*keys, "solid_voxels", "faces", (1 - F.col("solid_voxels") / F.col("_all")).alias("porosity"), F.try_divide(F.col("solid_voxels") * 2.0 * step, F.col("faces")).alias("thickness"))


def number_by_ratio(bv_tv: Column, thickness: Column) -> Column:
    return F.try_divide(bv_tv, thickness)


def number_by_separation(separation: Column) -> Column:
    return F.try_divide(F.lit(1.0), separation)


# intercepts along rays (see ``rays``)

def trabecular_number(intercepts: DataFrame, voxel: float) -> DataFrame:
    """Half the crossings per length over all directions."""
    return intercepts.groupBy("sample_id").agg(F.try_divide(F.sum("crossings") * 0.5, F.sum("length") * voxel).alias("tb_n"))


def mean_intercept_lengths(intercepts: DataFrame) -> DataFrame:
    """Intercepts of the directions that cross the phases, with ``mil``, their length per crossing in voxels."""
    return intercepts.filter("crossings > 0").withColumn("mil", F.col("length") / F.col("crossings"))


def degree_of_anisotropy(mils: DataFrame, mode: int = 3) -> DataFrame:
    """sample_id, da from mean intercept lengths (dir, dx, dy, dz, mil): quadric least squares, then its eigenvalues.

    The normal equations are sums per sample; only the 9 x 9 system and the 3 x 3 eigenvalues of each
    sample run in Python. Modes: 0 sqrt(largest / least), 2 least / largest, 3 one minus that; 0 if any is not positive.
    """
    top = mils.groupBy("sample_id").agg(F.max("mil").alias("_top"))
    x, y, z = (F.col(f"d{a}") * F.col("mil") / F.col("_top") for a in "xyz")
    terms = [x * x, y * y, z * z, x * y * 2, x * z * 2, y * z * 2, x * 2, y * 2, z * 2]
    rows = mils.join(top, "sample_id").select("sample_id", *(e.alias(f"t{n}") for n, e in enumerate(terms)))
    sums = rows.groupBy("sample_id").agg(*(F.sum(F.col(f"t{p}") * F.col(f"t{q}")).alias(f"m{p}{q}") for p in range(9) for q in range(p, 9)), *(F.sum(f"t{p}").alias(f"r{p}") for p in range(9)))

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                m = np.array([[row[f"m{min(p, q)}{max(p, q)}"] for q in range(9)] for p in range(9)], float)
                c = np.linalg.lstsq(m, np.array([row[f"r{p}"] for p in range(9)], float), rcond=None)[0]
                a = np.array([[c[0], c[3], c[4]], [c[3], c[1], c[5]], [c[4], c[5], c[2]]])
                centre = np.linalg.lstsq(a, -c[6:], rcond=None)[0]
                e = np.linalg.eigvalsh(a / (1 + centre @ a @ centre))
                lo, hi = e[0], e[-1]
                da = 0.0 if lo <= 0 else {0: math.sqrt(hi / lo), 2: lo / hi, 3: 1 - lo / hi}[mode]
                out.append((row["sample_id"], da))
            yield pd.DataFrame(out, columns=["sample_id", "da"]).astype({"sample_id": "int64", "da": "float64"})

    return sums.mapInPandas(solve, "sample_id long, da double")


# tortuosity

MOVES = [(x, y, z, math.sqrt(x * x + y * y + z * z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x or y or z]


def _axial_ends(opened: DataFrame, sizes: DataFrame, axis: str, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes with the first and last usable slice of each sample, inlets, outlets); see ``tortuosity``."""
    others = [c for c in CELL if c != axis]
    n = sizes.select("sample_id", *(F.col(f"n{c}") for c in CELL))
    sized = opened.join(n, "sample_id")
    inner = sized
    for c in others:
        low = F.greatest(F.floor(F.col(f"n{c}") * margin).cast("int"), F.lit(1))
        inner = inner.filter(F.col(c).between(low, F.col(f"n{c}") - 1 - low))
    deep = F.col(axis).between(1, F.col(f"n{axis}") - 2)
    usable = inner.filter(deep & (F.col(f"n{axis}") >= 4))
    planes = usable.groupBy("sample_id").agg(F.min(axis).alias("_first"))
    lasts = sized.filter(deep).groupBy("sample_id").agg(F.max(axis).alias("_last"))
    span = planes.join(lasts, "sample_id").filter("_first < _last")
    inlets = usable.join(span, "sample_id").filter(F.col(axis) == F.col("_first")).select(*KEY)
    outlets = opened.join(span, "sample_id").filter(F.col(axis) == F.col("_last")).select(*KEY)
    return n.join(span, "sample_id", "left"), inlets, outlets


def _best_ends(paths: DataFrame, outlets: DataFrame) -> DataFrame:
    """sample_id and the cheapest outlet as ``_b`` (cost, i, j, k)."""
    return paths.join(outlets, KEY, "left_semi").groupBy("sample_id").agg(F.min(F.struct("cost", *CELL)).alias("_b"))


def tortuosity(opened: DataFrame, sizes: DataFrame, axis: str = "k", voxel: float = 1.0, mode: int = 0, margin: float = 0.15) -> DataFrame:
    """sample_id, status, length, tortuosity of the shortest 26-connected way through the open voxels along ``axis``.

    Inlets lie in the first slice (from 1) with open voxels inside the central window, outlets in the last
    (from n - 2). Statuses: ok, too thin (under 4 slices), no open planes, no path. The ratio is length over
    axial span (mode 0) or over the distance of the ends (mode 1), at least 1; null unless ok.
    """
    spans, inlets, outlets = _axial_ends(opened, sizes, axis, margin)
    best = shortest_paths(opened.select(*KEY), MOVES, inlets, outlets, parents=mode == 1)
    cost = _best_ends(best, outlets)
    out = spans.join(cost, "sample_id", "left")
    status = F.when(F.col(f"n{axis}") < 4, "too thin").when(F.col("_first").isNull(), "no open planes").when(F.col("_b").isNull(), "no path").otherwise("ok")
    length = F.col("_b.cost")
    ratio = F.when(length.isNotNull(), F.greatest(F.lit(1.0), length / (F.col("_last") - F.col("_first"))))
    if mode == 1:
        ends = materialize(cost.select("sample_id", *(F.col(f"_b.{c}") for c in CELL), F.col("_b.cost").alias("length")), "ends")
        ratio = F.col("_by_ends")
        traced = endpoint_tortuosity(ends.select("sample_id", "length"), trace_back(best, ends))
        out = out.join(traced.withColumnRenamed("tortuosity", "_by_ends"), "sample_id", "left")
    return out.select("sample_id", status.alias("status"), (length * voxel).alias("length"), ratio.alias("tortuosity"))


def path_rows(opened: DataFrame, sizes: DataFrame, axis: str = "k", voxel: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), margin: float = 0.15) -> DataFrame:
    """sample_id, step (0 at the outlet), i, j, k, x, y, z: the way that ``tortuosity`` measures, by voxel centres in length units."""
    _, inlets, outlets = _axial_ends(opened, sizes, axis, margin)
    best = shortest_paths(opened.select(*KEY), MOVES, inlets, outlets, parents=True)
    ends = materialize(_best_ends(best, outlets).select("sample_id", *(F.col(f"_b.{c}") for c in CELL)), "ends")
    return trace_back(best, ends).select("sample_id", "step", *CELL, *((F.lit(o) + (F.col(c) + 0.5) * voxel).alias(a) for a, c, o in zip("xyz", CELL, origin)))


def plane_tortuosity(opened: DataFrame, sizes: DataFrame, margin: int = 10, voxel: float = 1.0) -> DataFrame:
    """The older form along k: inlets in slice 0, ``margin`` voxels from its sides, outlets anywhere in the last slice.

    Ways keep one voxel from the sides. sample_id, status (ok, no open planes, no path), length and length
    over the extent of the sample along k, at least 1; null unless ok.
    """
    n = sizes.select("sample_id", *(F.col(f"n{c}") for c in CELL))
    within = lambda low: reduce(lambda a, b: a & b, (F.col(c).between(low, F.col(f"n{c}") - 1 - low) for c in CELL[:2]))
    sized = opened.join(n, "sample_id")
    inlets = sized.filter((F.col("k") == 0) & within(margin)).select(*KEY)
    nodes = sized.filter(within(1)).select(*KEY)
    outlets = sized.filter((F.col("k") == F.col("nk") - 1) & within(1)).select(*KEY)
    # an inlet on the rim itself may start a way that none may enter again
    best = shortest_paths(nodes.unionByName(inlets).distinct(), MOVES, inlets, outlets)
    cost = best.join(outlets, KEY, "left_semi").groupBy("sample_id").agg(F.min("cost").alias("_cost"))
    out = n.join(inlets.select("sample_id").distinct().withColumn("_in", F.lit(True)), "sample_id", "left").join(cost, "sample_id", "left")
    status = F.when(F.col("_in").isNull(), "no open planes").when(F.col("_cost").isNull(), "no path").otherwise("ok")
    return out.select("sample_id", status.alias("status"), (F.col("_cost") * voxel).alias("length"),
                      F.greatest(F.lit(1.0), F.col("_cost") / F.col("nk")).alias("tortuosity")).withColumn(
        "tortuosity", F.when(F.col("status") == "ok", F.col("tortuosity")))


def endpoint_tortuosity(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """Length over the straight distance of a path's two ends, from traced rows (step 0 at the outlet)."""
    first = ends.groupBy("sample_id").agg(F.min(F.struct("step", *CELL)).alias("a"), F.max(F.struct("step", *CELL)).alias("b"))
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in CELL[1:]), (F.col("a.i") - F.col("b.i")) * (F.col("a.i") - F.col("b.i"))))
    return first.join(paths, "sample_id").select("sample_id", F.greatest(F.lit(1.0), F.try_divide("length", d)).alias("tortuosity"))


# statistics

def unpivot_metrics(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    return metrics.unpivot(by, names, "metric", "value")


def replicate_statistics(long_metrics: DataFrame, by: list[str]) -> DataFrame:
    return long_metrics.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.count("value").alias("n"))


def stale_metrics(metrics: DataFrame, meshes: DataFrame, names: list[str]) -> DataFrame:
    """Per metric (with ``<name>_version``) whether it was computed on another mesh version than the present one; null if never."""
    out = metrics.join(meshes.select("sample_id", F.col("mesh_version").alias("_now")), "sample_id", "left")
    return out.select("sample_id", *((F.col(f"{n}_version") != F.col("_now")).alias(f"{n}_stale") for n in names))


def metric_row(voxels: DataFrame, soup: DataFrame, vertices: DataFrame, faces: DataFrame, voxel: float, domain_volume: float, directions: int = 2000, per_side: int = 100,
               jitter: bool = True, smooth_step: float | None = None, anisotropy_mode: int | None = None) -> DataFrame:
    """The full set of measures of each sample as one row, by the names of the metrics file.

    ``voxels``: all voxels with ``solid``; ``soup``, ``vertices`` and ``faces``: the mesh; ``voxel`` the edge of a voxel and
    ``domain_volume`` in the mesh's units. The structure model index is taken with ``smooth_step`` (the grid step), the degree
    of anisotropy with ``anisotropy_mode``; either is left out without. Samples lacking a measure have null there.
    """
    from .rays import image_sizes, sampled_intercepts, walked_intercepts

    domain = voxels.select("sample_id").distinct().withColumn("domain_volume", F.lit(domain_volume))
    size = mesh_area_volume(soup)
    named = lambda df, first: df.select("sample_id", F.col("thickness").alias(first), F.col("thickness_sd").alias(f"{first}_sd"))
    way = tortuosity(voxels.filter("not solid"), image_sizes(voxels), voxel=voxel)
    parts = [size, mesh_ratios(size, domain).select("sample_id", "porosity", "bs_bv", "bs_tv"), euler_number(voxels.filter("solid")), connectivity_density(vertices, faces, domain).select("sample_id", "conn_d"),
             named(local_thickness(voxels, voxel), "tb_th"), named(local_thickness(voxels, voxel, inverse=True), "tb_sp"),
             trabecular_number(walked_intercepts(voxels, directions, per_side, jitter=jitter), voxel), way.select("sample_id", F.col("status").alias("tortuosity_status"), "tortuosity")]
    if smooth_step is not None:
        parts.append(structure_model_index(vertices, faces, smooth_step).select("sample_id", "smi"))
    if anisotropy_mode is not None:
        parts.append(degree_of_anisotropy(mean_intercept_lengths(sampled_intercepts(voxels, directions, per_side, jitter=jitter)), anisotropy_mode))
    return measure_all([materialize(part, "measure") for part in parts], domain)


def measure_all(parts: list[DataFrame], samples: DataFrame) -> DataFrame:
    """One row per sample with the columns of all measures; null where a measure has none."""
    return reduce(lambda a, b: a.join(b, "sample_id", "left"), parts, samples.select("sample_id"))
