"""Spatial joins over keyed tables: nearest neighbours, radius, nearest triangle, containment by rays.

Points of both sides carry x, y, z and the key ``by``. Space is cut into cubic cells,
so that all joins are equi-joins on (key, cell): both sides are hashed, a crowded cell is
split by adaptive execution, and nothing is broadcast without Spark's own size check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g
from ..sources.scratch import by_shuffle, materialize

#: Cell columns; named apart from the corners of triangles.
CELL = ["_cell_x", "_cell_y", "_cell_z"]


def cell_of(size: Column | float, names: str = "xyz") -> list[Column]:
    return [F.floor(F.col(a) / g.lit(size)).cast("int").alias(c) for a, c in zip(names, CELL)]


def spread_cells(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row copied to the cells at most ``reach`` away from its own, axis by axis."""
    for c in CELL:
        df = df.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    return df


def _right(points: DataFrame, rid: str, by: str) -> DataFrame:
    return points.select(by, F.col(rid).alias("_rid"), *(F.col(a).alias(f"_r{a}") for a in "xyz"))


def radius_join(left: DataFrame, right: DataFrame, radius: Column | float, cell: float, by: str = "sample_id", right_id: str = "seed_id") -> DataFrame:
    """Pairs within ``radius`` (a number, or of the left row): left columns, right id, distance.

    Right rows are copied to as many cells around their own as the largest radius reaches, which is measured first.
    """
    largest = left.agg(F.max(g.lit(radius))).first()[0] or 0.0
    reach = max(1, math.ceil(largest / cell))
    r = _right(right, right_id, by)
    near = spread_cells(r.select("*", *[F.floor(F.col(f"_r{a}") / cell).cast("int").alias(c) for a, c in zip("xyz", CELL)]), reach)
    joined = left.select("*", *cell_of(cell)).join(by_shuffle(near), [by, *CELL])
    d = g.point_distance(g.vec(), (F.col("_rx"), F.col("_ry"), F.col("_rz")))
    return joined.withColumn("distance", d).filter(F.col("distance") <= g.lit(radius)).select(
        *left.columns, F.col("_rid").alias(right_id), "distance")


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: list[str], cell: float | None = None, by: str = "sample_id",
             right_id: str = "seed_id", small_right: int = 5000) -> DataFrame:
    """The ``k`` nearest right rows of every left row: left columns, rank from 1, right id, position, distance squared.

    Ties go to the smaller right id. A right side of at most ``small_right`` rows per key is
    compared within its key. Otherwise rings of cells are searched: a left row is done when its
    k-th distance is no more than the searched radius, the rest go on with a doubled ring, so
    the result is exact.
    """
    sizes = right.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    r = _right(right, right_id, by)
    d2 = g.dot(*[g.sub(g.vec(), (F.col("_rx"), F.col("_ry"), F.col("_rz")))] * 2)
    order = Window.partitionBy(by, *left_id).orderBy("d2", "_rid")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("d2", d2).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def shape(found: DataFrame) -> DataFrame:
        return found.select(*left.columns, "rank", F.col("_rid").alias(right_id), F.col("_rx").alias("sx"), F.col("_ry").alias("sy"), F.col("_rz").alias("sz"), "d2")

    if sizes <= small_right:
        near = _within_key(left, right, k, by, right_id, True, left_id)
        ranks = [F.struct(F.lit(n).alias("rank"), F.col(f"_id{n}").alias("_rid"), *(F.col(f"_s{a}{n}").alias(f"_r{a}") for a in "xyz"), F.col(f"_d{n}").alias("d2")) for n in range(1, k + 1)]
        return shape(near.select(*left.columns, F.explode(F.filter(F.array(*ranks), lambda b: b["d2"].isNotNull())).alias("_b")).select(*left.columns, "_b.*"))
    if cell is None:
        box = right.agg(*(f(a).alias(f"{f.__name__}{a}") for f in (F.min, F.max) for a in "xyz")).first()
        volume = reduce(lambda p, a: p * max(1e-9, box[f"max{a}"] - box[f"min{a}"]), "xyz", 1.0)
        cell = (volume * k / sizes) ** (1 / 3) or 1.0
    todo, done, ring = left, None, 1
    while True:
        placed = todo.select("*", *cell_of(cell * ring))
        near = spread_cells(r.select("*", *[F.floor(F.col(f"_r{a}") / (cell * ring)).cast("int").alias(c) for a, c in zip("xyz", CELL)]))
        found = materialize(ranked(placed.join(by_shuffle(near), [by, *CELL])).drop(*CELL), "knn")
        have = Window.partitionBy(by, *left_id)
        whole = ring * cell > 1e9
        ok = found.withColumn("_n", F.count("*").over(have)).withColumn("_far", F.max("d2").over(have)).filter(
            ((F.col("_n") == k) & (F.col("_far") <= (cell * ring) ** 2)) if not whole else F.lit(True)).drop("_n", "_far")
        done = ok if done is None else done.unionByName(ok)
        if whole:
            break
        todo = materialize(todo.join(ok.select(by, *left_id).distinct(), [by, *left_id], "left_anti"), "knn-left")
        if not todo.limit(1).count():
            break
        ring *= 2
        if todo.join(right.groupBy(by).agg(F.count("*").alias("_n")), by).filter(F.col("_n") >= k).limit(1).count() == 0 and ring * cell > 1e6:
            ring = int(2e9 / cell)
    return shape(done)


#: Left rows of a key that one task holds against the key's right rows; a key with more is dealt to several.
KEY_ROWS = 1 << 20
#: Distances worked out at a time.
DISTANCES = 1 << 20


def _within_key(left: DataFrame, right: DataFrame, k: int, by: str, right_id: str, positions: bool, left_id: list[str]) -> DataFrame:
    """Left columns and, for the n-th nearest right row of the key, _dn (squared), _idn and with ``positions`` _sxn, _syn, _szn; null beyond the last.

    Both sides meet in one shuffle, a key's right rows first, and are measured in numpy: no pair is a row. A key's right
    rows are held by a task (bounded by the caller), its left rows stream.
    """
    many = left.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > KEY_ROWS)
    many = materialize(many.select(by, F.ceil(F.col("_n") / KEY_ROWS).cast("int").alias("_tasks")), "large-keys")
    rows = left.filter(F.col(by).isNotNull()).withColumns({a: F.col(a).cast("double") for a in "xyz"})
    seeds = right.filter(F.col(by).isNotNull()).select(by, F.col(right_id).alias("_rid"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    if many.limit(1).count():
        tasks = F.coalesce("_tasks", F.lit(1))
        rows = rows.join(many, by, "left").withColumn("_part", F.pmod(F.xxhash64(*left_id), tasks).cast("int")).drop("_tasks")
        seeds = seeds.join(many, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    else:
        rows, seeds = (df.withColumn("_part", F.lit(0)) for df in (rows, seeds))
    met = rows.withColumn("_stage", F.lit(1)).unionByName(seeds.withColumn("_stage", F.lit(0)), allowMissingColumns=True)
    dealt = met.repartition(by, "_part").sortWithinPartitions(by, "_part", "_stage", "_rid")
    out = StructType([met.schema[c] for c in left.columns])
    for n in range(1, k + 1):
        out = out.add(f"_d{n}", "double").add(f"_id{n}", met.schema["_rid"].dataType)
        if positions:
            for a in "xyz":
                out = out.add(f"_s{a}{n}", "double")
    return dealt.mapInArrow(_ranks(left.columns, by, k, positions, out.names), out)


def _ranks(columns: list[str], by: str, k: int, positions: bool, names: list[str]):
    """Per key its right rows, then its left rows in batches; each left row with its ``k`` nearest, the first of equal ones first."""
    def measured(part: pa.RecordBatch, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = part.num_rows, min(k, len(spots))
        best, which = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
        p = np.column_stack([part[a].to_numpy(zero_copy_only=False) for a in "xyz"])
        step = max(1, DISTANCES // max(1, len(spots)))
        for low in range(0, n if most else 0, step):
            some = p[low:low + step]
            d = [some[:, a, None] - spots[None, :, a] for a in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            d2[np.isnan(d2)] = np.inf
            at = np.arange(len(some))
            for rank in range(most):
                c = d2.argmin(axis=1)
                best[low:low + step, rank], which[low:low + step, rank] = d2[at, c], c
                d2[at, c] = np.inf
        return best, which

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, spots = None, [], None, np.empty((0, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch[c].to_numpy(zero_copy_only=False) for c in (by, "_part", "_stage")]
            edges = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            kept, found = [], []
            for low, high in zip([0, *edges], [*edges, batch.num_rows]):
                now, part = (marks[0][low], marks[1][low]), batch.slice(low, high - low)
                if marks[2][low] == 0:
                    if now != key:
                        key, held = now, []
                    held.append(part)
                    ids = pa.concat_arrays([h["_rid"] for h in held])
                    spots = np.concatenate([np.column_stack([h[a].to_numpy(zero_copy_only=False) for a in "xyz"]) for h in held])
                elif now == key:
                    best, which = measured(part, spots)
                    kept.append(part)
                    found.append((best, np.isinf(best), which, ids, spots))
            if not kept:
                continue
            arrays = [pa.concat_arrays([part[c] for part in kept]) for c in columns]
            for n in range(k):
                gone = np.concatenate([f[1][:, n] for f in found])
                arrays.append(pa.array(np.concatenate([f[0][:, n] for f in found]), mask=gone))
                arrays.append(pa.concat_arrays([f[3].take(pa.array(f[2][:, n], mask=f[1][:, n])) for f in found]))
                if positions:
                    for a in range(3):
                        arrays.append(pa.array(np.concatenate([f[4][f[2][:, n], a] for f in found]), mask=gone))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def nearest_columns(left: DataFrame, right: DataFrame, k: int, left_id: list[str], positions: bool = False, by: str = "sample_id", right_id: str = "seed_id", small_right: int = 5000) -> DataFrame:
    """``knn_join`` with the ranks side by side: left columns and d1..dk (distances), id1..idk and, with ``positions``, sx1..szk; null beyond the last.

    Left rows of a key without right rows are left out.
    """
    largest = right.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    place = [f"s{a}" for a in "xyz"] if positions else []
    if largest <= small_right:
        near = _within_key(left, right, k, by, right_id, positions, left_id)
        return near.select(*left.columns, *(F.sqrt(f"_d{n}").alias(f"d{n}") for n in range(1, k + 1)), *(F.col(f"_id{n}").alias(f"id{n}") for n in range(1, k + 1)),
                           *(F.col(f"_{s}{n}").alias(f"{s}{n}") for n in range(1, k + 1) for s in place))
    rows = knn_join(left, right, k, left_id, by=by, right_id=right_id, small_right=small_right)
    pick = lambda n, c: F.max(F.when(F.col("rank") == n, c))
    return rows.groupBy(*left.columns).agg(*(pick(n, F.sqrt("d2")).alias(f"d{n}") for n in range(1, k + 1)), *(pick(n, F.col(right_id)).alias(f"id{n}") for n in range(1, k + 1)),
                                           *(pick(n, F.col(s)).alias(f"{s}{n}") for n in range(1, k + 1) for s in place))


def nearest(left: DataFrame, right: DataFrame, left_id: list[str], **kw) -> DataFrame:
    return knn_join(left, right, 1, left_id, **kw).drop("rank")


def voronoi_assign(neighbours: DataFrame, left_id: list[str], by: str = "sample_id", right_id: str = "seed_id") -> DataFrame:
    """Nearest and second nearest seed of every left row (from ``knn_join`` with k >= 2) and their unordered pair."""
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    return neighbours.groupBy(by, *left_id).agg(at(1, right_id).alias("id1"), at(2, right_id).alias("id2")).withColumns(
        {"face_a": F.least("id1", "id2"), "face_b": F.greatest("id1", "id2")})


def voronoi_cells(left: DataFrame, right: DataFrame, left_id: list[str], by: str = "sample_id", right_id: str = "seed_id") -> DataFrame:
    """``voronoi_assign`` from the two sides themselves: no neighbour is a row."""
    owned = nearest_columns(left, right, 2, left_id, by=by, right_id=right_id)
    return owned.select(by, *left_id, "id1", "id2", F.least("id1", "id2").alias("face_a"), F.greatest("id1", "id2").alias("face_b"))


def local_metric_knn(neighbours: DataFrame, metric: list[Column], left_id: list[str], k: int = 4, by: str = "sample_id") -> DataFrame:
    """Re-rank a Euclidean shortlist (``knn_join`` rows with the six metric entries of the left row) by the metric."""
    d = (F.col("sx") - F.col("x"), F.col("sy") - F.col("y"), F.col("sz") - F.col("z"))
    order = Window.partitionBy(by, *left_id).orderBy("m2", "rank")
    return neighbours.withColumn("m2", g.metric_distance_sq(metric, d)).withColumn("metric_rank", F.row_number().over(order)).filter(F.col("metric_rank") <= k)


def seed_adjacency(owned: DataFrame) -> DataFrame:
    """Touching cells of a voxel Voronoi diagram: sample_id, a, b, contact voxel faces and their centre in index units.

    ``owned``: sample_id, i, j, k, id1. A voxel approximation of the exact diagram.
    """
    sides = []
    for axis in ("i", "j", "k"):
        rest = [c for c in ("i", "j", "k") if c != axis]
        order = Window.partitionBy("sample_id", *rest).orderBy(axis)
        nxt = owned.withColumn("_next", F.lead("id1").over(order)).withColumn("_at", F.lead(axis).over(order))
        touching = nxt.filter((F.col("_at") == F.col(axis) + 1) & (F.col("_next") != F.col("id1")))
        sides.append(touching.select("sample_id", F.least("id1", "_next").alias("a"), F.greatest("id1", "_next").alias("b"), *(
            (F.col(c) + (0.5 if c == axis else 0.0)).alias(f"m{c}") for c in ("i", "j", "k"))))
    return reduce(DataFrame.unionByName, sides).groupBy("sample_id", "a", "b").agg(
        F.count("*").alias("faces"), *(F.avg(f"m{c}").alias(f"m{c}") for c in ("i", "j", "k")))


def open_contacts(adjacency: DataFrame, field: DataFrame, iso: Column | float) -> DataFrame:
    """The touching cells of ``seed_adjacency`` with ``open``: the field at the grid point nearest to the contact's centre lies over ``iso``.

    ``field``: sample_id, i, j, k, value. Contacts whose centre lies beyond the field are not open.
    """
    at = {c: F.floor(F.col(f"m{c}") + 0.5).cast("int") for c in "ijk"}
    value = field.select("sample_id", *(F.col(c).cast("int").alias(c) for c in "ijk"), F.col("value").alias("_value"))
    return adjacency.withColumns(at).join(value, ["sample_id", "i", "j", "k"], "left").withColumn("open", F.coalesce(F.col("_value") > g.lit(iso), F.lit(False))).select(*adjacency.columns, "open")


# triangles: columns ax..cz, tri_id

def corners() -> tuple[g.Vector, g.Vector, g.Vector]:
    return g.vec("a"), g.vec("b"), g.vec("c")


def _triangle_cells(triangles: DataFrame, cell: float, axes: list[tuple[str, str]], reach: int = 0, plane: bool = False) -> DataFrame:
    """Triangles copied to the cells their boxes cover (grown by ``reach`` cells); with ``plane`` only where their plane passes."""
    for a, c in axes:
        lo, hi = F.least(f"a{a}", f"b{a}", f"c{a}"), F.greatest(f"a{a}", f"b{a}", f"c{a}")
        triangles = triangles.withColumn(c, F.explode(F.sequence(
            F.floor(lo / cell).cast("int") - reach, F.floor(hi / cell).cast("int") + reach)))
    if plane:
        a, b, c = corners()
        normal = g.cross(g.sub(b, a), g.sub(c, a))
        middle = tuple((F.col(n) + 0.5) * cell for n in CELL)
        half = (F.abs(normal[0]) + F.abs(normal[1]) + F.abs(normal[2])) * (cell / 2 * 1.000001)
        triangles = triangles.filter(F.abs(g.dot(normal, g.sub(middle, a))) <= half)
    return triangles


def triangle_distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of each point to its triangle (rows of three): to the plane over the face, else to the nearest edge."""
    def dot(u, v):
        return np.einsum("ij,ij->i", u, v)

    def to_segment(u, v):
        way = v - u
        t = np.clip(dot(p - u, way) / np.maximum(dot(way, way), 1e-300), 0, 1)
        return np.linalg.norm(p - u - t[:, None] * way, axis=1)

    e0, e1, q = b - a, c - a, p - a
    n = np.cross(e0, e1)
    size = dot(n, n)
    v, w = dot(np.cross(q, e1), n), dot(np.cross(e0, q), n)
    over = (size > 1e-24) & (v >= 0) & (w >= 0) & (v + w <= size)
    plane = np.abs(dot(q, n)) / np.sqrt(np.maximum(size, 1e-300))
    return np.where(over, plane, np.minimum(np.minimum(to_segment(a, b), to_segment(b, c)), to_segment(c, a)))


def _measured(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distance, tri_id of point and triangle pairs, measured in Arrow batches."""
    numbers = ["x", "y", "z", *(f"{v}{a}" for v in "abc" for a in "xyz")]
    kept = pairs.select(*keys, "tri_id", *(F.col(n).cast("double").alias(n) for n in numbers))
    schema = StructType([f for f in kept.schema.fields if f.name in {*keys, "tri_id"}]).add("distance", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [np.column_stack([batch[n].to_numpy() for n in numbers[3 * k:3 * k + 3]]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in [*keys, "tri_id"]), pa.array(triangle_distances(*spots))], names=[*keys, "tri_id", "distance"])

    return kept.mapInArrow(run, schema)


def _box_gap(lo: str, hi: str) -> tuple[Column, Column]:
    """Squared distances of a point to the nearest and to the farthest place of a box."""
    near = [F.greatest(F.col(f"{lo}{a}") - F.col(a), F.lit(0.0), F.col(a) - F.col(f"{hi}{a}")) for a in "xyz"]
    far = [F.greatest(F.abs(F.col(a) - F.col(f"{lo}{a}")), F.abs(F.col(a) - F.col(f"{hi}{a}"))) for a in "xyz"]
    return sum((x * x for x in near[1:]), near[0] * near[0]), sum((x * x for x in far[1:]), far[0] * far[0])


#: Boxes along the side of a ring's cells, beyond the first ring.
BOXES = 8


def nearest_triangle(points: DataFrame, triangles: DataFrame, point_id: list[str], cell: float, by: str = "sample_id") -> DataFrame:
    """Distance of every point to its mesh and the nearest triangle (smaller id first): rings of cells, exact.

    In the first ring a point is measured against the triangles of the cells around its own. Points left over meet boxes
    of triangles in ever larger rings: a box whose near side lies beyond the far side of another cannot hold the nearest
    triangle, so only the triangles of the few boxes left are measured.
    """
    names = [f"{v}{a}" for v in "abc" for a in "xyz"]
    ends = {f"{m}{a}": f(*(f"{v}{a}" for v in "abc")) for m, f in (("_lo", F.least), ("_hi", F.greatest)) for a in "xyz"}
    tri = triangles.select(by, "tri_id", *names).withColumns(ends)
    keys = [by, *point_id]
    todo, done, ring = points.select(*keys, "x", "y", "z"), None, 1
    while True:
        size = cell * ring
        placed = todo.select("*", *cell_of(size))
        if ring == 1:
            near = _triangle_cells(tri, size, list(zip("xyz", CELL)), reach=1)
            pairs = placed.join(by_shuffle(near), [by, *CELL]).filter(_box_gap("_lo", "_hi")[0] <= size * size)
        else:
            home = [F.floor(F.col(f"_lo{a}") / (size / BOXES)).cast("long").alias(f"_home{a}") for a in "xyz"]
            homed = tri.select("*", *home)
            boxes = homed.groupBy(by, *(f"_home{a}" for a in "xyz")).agg(*(F.min(f"_lo{a}").alias(f"_lo{a}") for a in "xyz"), *(F.max(f"_hi{a}").alias(f"_hi{a}") for a in "xyz"))
            for a, c in zip("xyz", CELL):
                boxes = boxes.withColumn(c, F.explode(F.sequence(F.floor(F.col(f"_lo{a}") / size).cast("int") - 1, F.floor(F.col(f"_hi{a}") / size).cast("int") + 1)))
            nearest_side, farthest = _box_gap("_lo", "_hi")
            met = placed.join(by_shuffle(boxes), [by, *CELL]).withColumns({"_near": nearest_side, "_least": F.min(farthest).over(Window.partitionBy(*keys))})
            left = met.filter((F.col("_near") <= F.col("_least")) & (F.col("_near") <= size * size)).select(*keys, "x", "y", "z", *(f"_home{a}" for a in "xyz"))
            pairs = left.join(by_shuffle(homed).select(by, "tri_id", *names, *(f"_home{a}" for a in "xyz")), [by, *(f"_home{a}" for a in "xyz")])
        best = _measured(pairs, keys).groupBy(*keys).agg(F.min(F.struct("distance", "tri_id")).alias("_b")).select(*keys, "_b.*")
        ok = materialize(best.filter(F.col("distance") <= size) if size < 1e9 else best, "nearest-triangle")
        done = ok if done is None else done.unionByName(ok)
        if size >= 1e9:
            break
        todo = materialize(todo.join(ok.select(*keys), keys, "left_anti").join(tri.select(by).distinct(), by, "left_semi"), "points-left")
        if not todo.limit(1).count():
            break
        ring *= 4
    return points.join(done, keys)


#: Where a cell's line runs across it, as shares of its side; off any likely vertex or face of the mesh.
LINE = (0.48713, 0.51287)


def _lines(triangles: DataFrame, axis: int, cell: float, by: str) -> DataFrame:
    """by, the two cell columns across ``axis``, hits: where the line through each column of cells crosses the mesh."""
    a, others = "xyz"[axis], [n for n in range(3) if n != axis]
    tri = _triangle_cells(triangles, cell, [("xyz"[n], CELL[n]) for n in others])
    at = {n: (F.col(CELL[n]) + share) * cell for n, share in zip(others, LINE)}
    for n in others:
        tri = tri.filter(at[n].between(F.least(*(f"{v}{'xyz'[n]}" for v in "abc")), F.greatest(*(f"{v}{'xyz'[n]}" for v in "abc"))))
    start = F.least(*(f"{v}{a}" for v in "abc")) - 1.0
    origin = tuple(start if n == axis else at[n] for n in range(3))
    hit = g.ray_meets_triangle(origin, tuple(F.lit(float(n == axis)) for n in range(3)), *corners(), scaled=False)
    return tri.select(by, *(CELL[n] for n in others), (start + hit).alias("hit")).filter("hit is not null").groupBy(by, *(CELL[n] for n in others)).agg(
        F.collect_list("hit").alias(f"_hits{axis}"))


def inside_mesh(points: DataFrame, triangles: DataFrame, point_id: list[str], cell: float, by: str = "sample_id") -> DataFrame:
    """point ids of the points inside the closed mesh: three rays, odd crossings, two of three votes.

    A ray runs from the point across its cell to the line of its column of cells and on along that line. How often
    a line crosses the mesh is found once per column; the way to the line lies in the point's own cell, so a
    point meets the triangles of that cell only, for all three rays in one join, and none if the cell is empty. A
    column holds the crossings of one line.
    """
    points = points.select(by, *point_id, "x", "y", "z", *cell_of(cell))
    line = [[(F.col(CELL[n]) + share) * cell for n, share in zip([m for m in range(3) if m != axis], LINE)] for axis in range(3)]
    in_cell = _triangle_cells(triangles, cell, list(zip("xyz", CELL)), plane=True).select(by, *CELL, *(f"{v}{a}" for v in "abc" for a in "xyz"))
    crossed = []
    for axis in range(3):
        ends = iter(line[axis])
        way = tuple(F.lit(0.0) if n == axis else next(ends) - F.col("xyz"[n]) for n in range(3))
        crossed.append(F.count_if(F.coalesce(g.ray_meets_triangle(g.vec(), way, *corners(), scaled=False) <= 1.0, F.lit(False))).alias(f"_near{axis}"))
    near = points.join(by_shuffle(in_cell), [by, *CELL]).groupBy(by, *point_id).agg(*crossed)
    out = points.join(near, [by, *point_id], "left")
    votes = F.lit(0)
    for axis in range(3):
        out = out.join(_lines(triangles, axis, cell, by), [by, *(CELL[n] for n in range(3) if n != axis)], "left")
        beyond = F.coalesce(F.size(F.filter(f"_hits{axis}", _further("xyz"[axis]))), F.lit(0))
        votes = votes + (F.greatest(beyond, F.lit(0)) + F.coalesce(f"_near{axis}", F.lit(0))) % 2
    return out.filter(votes >= 2).select(by, *point_id)


def _further(axis: str):
    return lambda hit: hit > F.col(axis)


def mesh_signed_distance(points: DataFrame, triangles: DataFrame, point_id: list[str], cell: float, by: str = "sample_id") -> DataFrame:
    """Distance of every point to its mesh, negative inside, and the nearest triangle."""
    inner = inside_mesh(points, triangles, point_id, cell, by).withColumn("_in", F.lit(-1.0))
    return nearest_triangle(points, triangles, point_id, cell, by).join(inner, [by, *point_id], "left").withColumn(
        "distance", F.col("distance") * F.coalesce("_in", F.lit(1.0))).drop("_in")


def banded_mesh_distance(voxels: DataFrame, triangles: DataFrame, stride: int, margin: float, steps: tuple[float, float, float], cell: float, by: str = "sample_id") -> DataFrame:
    """by, i, j, k, kind, distance: the mesh's signed distance where it matters, and a proven bound elsewhere.

    ``voxels``: by, i, j, k (from 0) and positions ``steps`` apart. Distances are taken at every ``stride``-th node and at
    the last ones; a coarse cell whose eight corners all lie further out (or in) than ``margin`` and its diagonal is proven
    outside (inside), and its voxels get the bound corner distance minus (plus) diagonal. The rest, a band along the
    mesh, get exact distances. Without triangles there is no distance and no row.
    """
    grid_cell = [f"_c{c}" for c in "ijk"]
    ends = voxels.groupBy(by).agg(*(F.max(c).alias(f"_n{c}") for c in "ijk"))
    sized = voxels.join(ends, by)
    node = [(F.col(c) % stride == 0) | (F.col(c) == F.col(f"_n{c}")) for c in "ijk"]
    coarse = materialize(mesh_signed_distance(sized.filter(node[0] & node[1] & node[2]), triangles, ["i", "j", "k"], cell, by), "coarse-distances")
    spread = coarse
    for c, g_cell in zip("ijk", grid_cell):
        # a node on a cell's edge is a corner of the cells on both sides
        at = F.floor(F.col(c) / stride).cast("int")
        spread = spread.withColumn(g_cell, F.explode(F.array_distinct(F.array(at, F.greatest(F.ceil(F.col(c) / stride).cast("int") - 1, F.lit(0))))))
    kinds = needs_exact(spread, grid_cell, margin, stride * sum(s * s for s in steps) ** 0.5, by)
    classed = materialize(sized.withColumns({g_cell: F.floor(F.col(c) / stride).cast("int") for c, g_cell in zip("ijk", grid_cell)}).join(kinds, [by, *grid_cell]), "voxel-kinds")
    diagonal = stride * sum(s * s for s in steps) ** 0.5
    bound = F.when(F.col("kind") == "outside", F.col("lo") - diagonal).otherwise(F.col("hi") + diagonal)
    proven = classed.filter("kind <> 'exact'").select(by, "i", "j", "k", "kind", bound.alias("distance"))
    exact = mesh_signed_distance(classed.filter("kind = 'exact'").select(by, "i", "j", "k", "x", "y", "z"), triangles, ["i", "j", "k"], cell, by)
    return proven.unionByName(exact.select(by, "i", "j", "k", F.lit("exact").alias("kind"), "distance"))


def needs_exact(coarse: DataFrame, cell_columns: list[str], margin: float, diagonal: float, by: str = "sample_id") -> DataFrame:
    """Class of coarse cells from the distances at their corners: a distance changes by at most the way walked.

    'outside' and 'inside' are proven; only 'exact' cells need distances of their fine voxels.
    """
    far = margin + diagonal
    return coarse.groupBy(by, *cell_columns).agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).withColumn(
        "kind", F.when(F.col("lo") > far, "outside").when(F.col("hi") < -far, "inside").otherwise("exact"))
