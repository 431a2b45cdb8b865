"""Surfaces: crossing cells, shared edge vertices, marching tetrahedra, weld, checks, normals, smoothing, simplification.

Triangle soup is (sample_id, tri_id, ax..cz); an indexed mesh is vertices (sample_id,
vertex_id, x, y, z) and faces (sample_id, face_id, v1, v2, v3).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.scratch import by_shuffle, materialize

CELL = ["i", "j", "k"]
CORNERS = ["a", "b", "c"]


def cell_codes(field: DataFrame, iso: float) -> DataFrame:
    """sample_id, i, j, k, code of the cells that the surface crosses.

    Bit dx + 2 dy + 4 dz is set when that corner is solid. Chains of ``lead`` along the three
    axes bring the corners together: three exchanges whatever the grid, and no row is multiplied.
    """
    out = field.select("sample_id", *CELL, F.when(F.col("value") < iso, 1).otherwise(0).alias("code"))
    for axis, shift in (("i", 1), ("j", 2), ("k", 4)):
        order = Window.partitionBy("sample_id", *(c for c in CELL if c != axis)).orderBy(axis)
        follows = F.lead(axis).over(order) == F.col(axis) + 1
        out = out.withColumn("_n", F.when(follows, F.lead("code").over(order))).filter("_n is not null").select(
            "sample_id", *CELL, F.col("code").bitwiseOR(F.shiftleft("_n", shift)).alias("code"))
    return out.filter("code not in (0, 255)")


def edge_vertices(field: DataFrame, iso: float) -> DataFrame:
    """One vertex per crossed grid edge (sample_id, i, j, k, axis): linear interpolation, natural key.

    ``field`` also has x, y, z. A value equal to iso is moved off it by 1e-9.
    """
    off = F.when(F.abs(F.col("value") - iso) < 1e-9, F.lit(iso + 1e-9)).otherwise(F.col("value"))
    base, parts = field.withColumn("v", off), []
    for axis in CELL:
        order = Window.partitionBy("sample_id", *(c for c in CELL if c != axis)).orderBy(axis)
        ahead = {n: F.lead(c).over(order) for n, c in (("_v", "v"), ("_at", axis), ("_x", "x"), ("_y", "y"), ("_z", "z"))}
        crossed = base.withColumns(ahead).filter((F.col("_at") == F.col(axis) + 1) & ((F.col("v") < iso) != (F.col("_v") < iso)))
        t = (iso - F.col("v")) / (F.col("_v") - F.col("v"))
        parts.append(crossed.select("sample_id", *CELL, F.lit(axis).alias("axis"), *((F.col(a) + (F.col(f"_{a}") - F.col(a)) * t).alias(a) for a in "xyz")))
    return reduce(DataFrame.unionByName, parts)


def grid_gradients(field: DataFrame, steps: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Central differences gx, gy, gz (one-sided at borders) of a field."""
    out = field
    for axis, name, h in zip(CELL, ("gx", "gy", "gz"), steps):
        order = Window.partitionBy("sample_id", *(c for c in CELL if c != axis)).orderBy(axis)
        back, ahead = F.lag("value").over(order), F.lead("value").over(order)
        out = out.withColumn(name, F.when(back.isNull(), (ahead - F.col("value")) / h).when(ahead.isNull(), (F.col("value") - back) / h).otherwise((ahead - back) / (2 * h)))
    return out


def gradient_normals(vertices: DataFrame, field: DataFrame, iso: float, steps: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Normals nx, ny, nz of ``edge_vertices``: the gradients of both ends, interpolated, of length one."""
    grad = grid_gradients(field, steps).select("sample_id", *CELL, "value", "gx", "gy", "gz")
    ends = [grad.select("sample_id", *CELL, *(F.col(c).alias(f"{p}{c}") for c in ("value", "gx", "gy", "gz"))) for p in ("p_", "q_")]
    ahead = vertices.withColumns({f"n{c}": F.col(c) + F.when(F.col("axis") == c, 1).otherwise(0) for c in CELL})
    both = ahead.join(ends[0], ["sample_id", *CELL]).join(ends[1].select("sample_id", *(F.col(c).alias(f"n{c}") for c in CELL), *(c for c in ends[1].columns if c.startswith("q_"))), ["sample_id", "ni", "nj", "nk"])
    t = (iso - F.col("p_value")) / (F.col("q_value") - F.col("p_value"))
    mixed = tuple(F.col(f"p_g{a}") + (F.col(f"q_g{a}") - F.col(f"p_g{a}")) * t for a in "xyz")
    return both.select("sample_id", *CELL, "axis", "x", "y", "z", *(e.alias(f"n{a}") for a, e in zip("xyz", g.unit(mixed, (0.0, 0.0, 1.0)))))


def _tetrahedra() -> list[list[tuple[int, int, int]]]:
    """Six tetrahedra of a cube around its diagonal: one per order of the axes, all of one handedness."""
    out = []
    for order in permutations(range(3)):
        at, path = [0, 0, 0], [(0, 0, 0)]
        for axis in order:
            at[axis] = 1
            path.append(tuple(at))
        odd = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3)) % 2
        out.append([path[0], path[2], path[1], path[3]] if odd else path)
    return out


def _cases() -> list[list[tuple[tuple[int, int], ...]]]:
    """Triangles per 4-bit case of a tetrahedron (bit set: corner solid), as pairs of corners (solid, air); normals point to air."""
    table = []
    for code in range(16):
        inn = [c for c in range(4) if code >> c & 1]
        out = [c for c in range(4) if not code >> c & 1]
        if len(inn) == 1:
            tris = [tuple((inn[0], o) for o in out)]
        elif len(inn) == 3:
            tris = [tuple((n, out[0]) for n in inn)]
        elif len(inn) == 2:
            p, q = [(inn[0], o) for o in out], [(inn[1], o) for o in out]
            tris = [(p[0], p[1], q[1]), (p[0], q[1], q[0])]
        else:
            tris = []
        table.append(tris)
    return table


def iso_surface(field: DataFrame, iso: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface value = iso by marching tetrahedra; ``field`` also has x, y, z.

    Every cell is cut into the same six tetrahedra, so neighbours agree on their common faces and
    the mesh is closed wherever the surface does not leave the grid. A vertex belongs to a pair of
    grid points, which is its key: no coordinates are matched. Only crossing cells are read further;
    the case table is a broadcast of about a hundred fixed rows.
    """
    codes = cell_codes(field, iso).select("sample_id", *CELL)
    span = 1 << 20
    node = lambda d: ((F.col("i").cast("long") + d[0]) * span + F.col("j") + d[1]) * span + F.col("k") + d[2]
    off = F.when(F.abs(F.col("value") - iso) < 1e-9, F.lit(iso + 1e-9)).otherwise(F.col("value"))
    points = by_shuffle(field).select("sample_id", ((F.col("i").cast("long") * span + F.col("j")) * span + F.col("k")).alias("node"), off.alias("v"), "x", "y", "z")
    cube = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    wanted = codes.select("sample_id", *CELL, F.posexplode(F.array(*(node(d) for d in cube))).alias("c", "node"))
    corner = wanted.join(points.select("sample_id", "node", "v"), ["sample_id", "node"]).groupBy("sample_id", *CELL).agg(
        F.sum(F.when(F.col("v") < iso, F.expr("shiftleft(1, c)")).otherwise(0)).alias("code"))
    # case table: for each tetrahedron and case, its triangles as offsets of node pairs from the cell's own node
    shift = lambda d: (d[0] * span + d[1]) * span + d[2]
    table = []
    for n, tet in enumerate(_tetrahedra()):
        for case, tris in enumerate(_cases()):
            for t, tri in enumerate(tris):
                pairs = [sorted((shift(tet[p]), shift(tet[q]))) for p, q in tri]
                table.append((n, case, t, *(o for pair in pairs for o in pair), shift(tet[tri[0][0]])))
    columns = [f"e{n}{end}" for n in range(3) for end in ("lo", "hi")]
    cases = field.sparkSession.createDataFrame(table, "tet int, case int, t int, " + ", ".join(f"{c} long" for c in columns) + ", inner long")
    bits = [[cube.index(d) for d in tet] for tet in _tetrahedra()]
    code = lambda b: reduce(lambda x, y: x + y, (F.shiftleft(F.shiftright("code", c).bitwiseAND(1), n) for n, c in enumerate(b)))
    split = corner.select("sample_id", *CELL, F.posexplode(F.array(*(code(b) for b in bits))).alias("tet", "case"))
    base = node((0, 0, 0))
    rows = split.join(F.broadcast(cases), ["tet", "case"]).select(
        "sample_id", F.struct(*CELL, "tet", "t").alias("key"), (base + F.col("inner")).alias("inner"),
        *(F.struct((base + F.col(f"e{n}lo")).alias("lo"), (base + F.col(f"e{n}hi")).alias("hi")).alias(f"e{n}") for n in range(3)))
    faces = materialize(rows, "faces")
    edges = reduce(DataFrame.union, (faces.select("sample_id", F.col(f"e{n}.lo").alias("lo"), F.col(f"e{n}.hi").alias("hi")) for n in range(3))).distinct()
    ends = edges
    for end in ("lo", "hi"):
        ends = ends.join(points.select("sample_id", F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("v", "x", "y", "z"))), ["sample_id", end])
    t = (iso - F.col("lo_v")) / (F.col("hi_v") - F.col("lo_v"))
    placed = ends.select("sample_id", "lo", "hi", *((F.col(f"lo_{a}") + (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * t).alias(a) for a in "xyz"))
    vertices = materialize(placed.withColumn("vertex_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("lo", "hi")).cast("long")), "vertices")
    named, inner = faces, points.select("sample_id", F.col("node").alias("inner"), *(F.col(a).alias(f"s{a}") for a in "xyz"))
    for n in range(3):
        v = by_shuffle(vertices).select("sample_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("vertex_id").alias(f"v{n + 1}"), *(F.col(a).alias(f"{CORNERS[n]}{a}") for a in "xyz"))
        named = named.withColumns({"_lo": F.col(f"e{n}.lo"), "_hi": F.col(f"e{n}.hi")}).join(v, ["sample_id", "_lo", "_hi"]).drop("_lo", "_hi")
    named = named.join(inner, ["sample_id", "inner"])
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    outward = g.dot(g.cross(g.sub(b, a), g.sub(c, a)), g.sub(a, g.vec("s"))) >= 0
    order = Window.partitionBy("sample_id").orderBy("key")
    out = named.select("sample_id", F.row_number().over(order).cast("long").alias("face_id"), "v1",
                       F.when(outward, F.col("v2")).otherwise(F.col("v3")).alias("v2"), F.when(outward, F.col("v3")).otherwise(F.col("v2")).alias("v3"))
    return vertices.select("sample_id", "vertex_id", "x", "y", "z"), out


#: Triangles of a sample that one task welds in numpy; larger samples are welded by windows and joins.
SMALL_MESH = 1 << 20
#: Triangles that are welded at a time, whole samples each.
WELDED = 1 << 16


def weld(triangles: DataFrame, tolerance: float, small: int = SMALL_MESH) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a soup: corners that round to the same multiple of the tolerance are one vertex.

    Vertices are numbered by first use (triangle, corner); the position is that of the first use. The triangles are
    counted first: where no sample has more than ``small``, a sample's triangles meet in one task, else corners meet by place.
    """
    largest = triangles.groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= small:
        kinds = {c: triangles.schema[c].dataType.simpleString() for c in ("sample_id", "tri_id")}
        soup = triangles.select("sample_id", "tri_id", *(F.col(f"{c}{a}").cast("double") for c in CORNERS for a in "xyz"))
        rows = soup.repartition("sample_id").sortWithinPartitions("sample_id", "tri_id").mapInArrow(
            _welded(tolerance), f"sample_id {kinds['sample_id']}, face_id {kinds['tri_id']}, v1 long, v2 long, v3 long, new array<struct<vertex_id: long, x: double, y: double, z: double>>")
        # a face brings along the vertices that it is the first to use
        numbered = materialize(rows, "welded")
        return numbered.select("sample_id", F.explode("new").alias("v")).select("sample_id", "v.*"), numbered.drop("new")
    corners = triangles.select("sample_id", "tri_id", F.posexplode(F.array(*(
        F.struct(*(F.col(f"{c}{a}").alias(a) for a in "xyz")) for c in CORNERS))).alias("corner", "p")).select("sample_id", "tri_id", "corner", "p.*")
    keyed = corners.withColumns({f"k{a}": F.floor(F.col(a) / tolerance + 0.5) for a in "xyz"})
    key = ["sample_id", "kx", "ky", "kz"]
    first = keyed.groupBy(*key).agg(F.min(F.struct("tri_id", "corner", "x", "y", "z")).alias("f"))
    vertices = materialize(first.withColumn("vertex_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("f.tri_id", "f.corner")).cast("long")), "vertices")
    named = keyed.join(by_shuffle(vertices.select(*key, "vertex_id")), key).groupBy("sample_id", "tri_id").agg(*(
        F.max(F.when(F.col("corner") == n, F.col("vertex_id"))).alias(f"v{n + 1}") for n in range(3)))
    return vertices.select("sample_id", "vertex_id", "f.x", "f.y", "f.z"), named.select("sample_id", F.col("tri_id").alias("face_id"), "v1", "v2", "v3")


def _welded(tolerance: float):
    """Whole samples at a time, sorted by triangle: the numbers of the corners and, per face, the vertices new with it."""
    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        spots = np.column_stack([batch[f"{c}{a}"].to_numpy(zero_copy_only=False) for c in CORNERS for a in "xyz"]).reshape(3 * n, 3)
        samples = batch["sample_id"].to_numpy(zero_copy_only=False)
        sample = np.repeat(np.concatenate([[0], np.cumsum(samples[1:] != samples[:-1])]), 3)
        # numbers by first appearance, axis by axis: equal ones lie at the same place
        place = sample
        for k in np.floor(spots / tolerance + 0.5).astype(np.int64).T:
            at, seen = pd.factorize(k)
            place = pd.factorize(place * len(seen) + at)[0]
        first = np.empty(place.max() + 1, np.int64)
        first[place[::-1]] = np.arange(3 * n)[::-1]
        own = sample[first]
        number = np.arange(len(first)) - np.searchsorted(own, own) + 1
        corner = number[place]
        count = np.bincount(first // 3, minlength=n)
        made = pa.StructArray.from_arrays([pa.array(number), *(pa.array(np.ascontiguousarray(spots[first, a])) for a in range(3))], names=["vertex_id", "x", "y", "z"])
        news = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), made)
        return pa.RecordBatch.from_arrays([batch["sample_id"], batch["tri_id"], *(pa.array(np.ascontiguousarray(c)) for c in corner.reshape(n, 3).T), news],
                                          names=["sample_id", "face_id", "v1", "v2", "v3", "new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            samples = batch["sample_id"].to_numpy(zero_copy_only=False)
            tail = batch.num_rows - int(np.argmax(samples[::-1] != samples[-1])) if samples[0] != samples[-1] else 0
            if not tail and held and held[-1]["sample_id"][-1].as_py() != batch["sample_id"][0].as_py() and n >= WELDED:
                yield numbered(pa.concat_batches(held))
                held, n = [], 0
            if tail and n + tail >= WELDED:
                yield numbered(pa.concat_batches([*held, batch.slice(0, tail)]))
                held, n, batch = [], 0, batch.slice(tail)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield numbered(pa.concat_batches(held))

    return run


def to_soup(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles with corner positions and the face's normal."""
    out = faces
    for n, c in enumerate(CORNERS):
        out = out.join(vertices.select("sample_id", F.col("vertex_id").alias(f"v{n + 1}"), *(F.col(a).alias(f"{c}{a}") for a in "xyz")), ["sample_id", f"v{n + 1}"])
    normal = g.unit(g.cross(g.sub(g.vec("b"), g.vec("a")), g.sub(g.vec("c"), g.vec("a"))))
    return out.select("sample_id", F.col("face_id").alias("tri_id"), *(f"{c}{a}" for c in CORNERS for a in "xyz"), *(e.alias(f"n{a}") for a, e in zip("xyz", normal)))


def mesh_edges(faces: DataFrame) -> DataFrame:
    """Undirected edges with the number of faces at each."""
    pairs = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v1", "v2"), ("v2", "v3"), ("v3", "v1")))))
    return faces.select("sample_id", pairs.alias("e")).select("sample_id", "e.*").groupBy("sample_id", "a", "b").agg(F.count("*").alias("n_faces"))


def topology(faces: DataFrame) -> DataFrame:
    """Per sample: edges, boundary (one face), manifold (two), non-manifold (more), watertight."""
    kinds = mesh_edges(faces).groupBy("sample_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("n_faces") == 1).alias("boundary"), F.count_if(F.col("n_faces") == 2).alias("manifold"), F.count_if(F.col("n_faces") > 2).alias("non_manifold"))
    return kinds.withColumn("watertight", (F.col("boundary") == 0) & (F.col("non_manifold") == 0))


def vertex_neighbours(faces: DataFrame) -> DataFrame:
    """(sample_id, vertex_id, neighbour) rows, each once."""
    e = mesh_edges(faces)
    return e.select("sample_id", F.col("a").alias("vertex_id"), F.col("b").alias("neighbour")).unionByName(e.select("sample_id", F.col("b").alias("vertex_id"), F.col("a").alias("neighbour")))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """(sample_id, vertex_id, faces sorted)."""
    return faces.select("sample_id", F.explode(F.array("v1", "v2", "v3")).alias("vertex_id"), "face_id").groupBy("sample_id", "vertex_id").agg(
        F.sort_array(F.collect_set("face_id")).alias("faces"))


def mesh_bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("sample_id").agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def _corner_rows(soup: DataFrame, faces: DataFrame, weights: list[Column], vector: g.Vector) -> DataFrame:
    joined = soup.join(faces.select("sample_id", F.col("face_id").alias("tri_id"), "v1", "v2", "v3"), ["sample_id", "tri_id"])
    spread = F.explode(F.array(*(F.struct(F.col(f"v{n + 1}").alias("vertex_id"), w.alias("w")) for n, w in enumerate(weights))))
    return joined.select("sample_id", spread.alias("s"), *(e.alias(f"_{a}") for a, e in zip("xyz", vector))).select("sample_id", "s.*", "_x", "_y", "_z").filter("w > 0")


def vertex_normals(vertices: DataFrame, faces: DataFrame, weight: str = "mean", fallback: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> DataFrame:
    """Unit normals per vertex: the mean of its faces' normals ('mean'), by area ('area') or by corner angle ('angle')."""
    soup = to_soup(vertices, faces)
    corner = [g.vec(c) for c in CORNERS]
    full = g.cross(g.sub(corner[1], corner[0]), g.sub(corner[2], corner[0]))
    proper = g.norm(full) > 1e-12
    one = F.when(proper, 1.0).otherwise(0.0)
    vector = full if weight == "area" else g.vec("n")
    weights = [one] * 3
    if weight == "angle":
        def angle(n: int) -> Column:
            p, q = g.sub(corner[(n + 1) % 3], corner[n]), g.sub(corner[(n + 2) % 3], corner[n])
            return F.when(proper, F.acos(g.clamp(F.try_divide(g.dot(p, q), g.norm(p) * g.norm(q)), -1, 1))).otherwise(0.0)

        weights = [angle(n) for n in range(3)]
    rows = _corner_rows(soup, faces, weights, vector)
    summed = rows.groupBy("sample_id", "vertex_id").agg(*(F.sum(F.col(f"_{a}") * F.col("w")).alias(f"_{a}") for a in "xyz"))
    joined = vertices.join(summed, ["sample_id", "vertex_id"], "left")
    total = tuple(F.coalesce(f"_{a}", F.lit(0.0)) for a in "xyz")
    n = g.norm(total)
    return joined.select(*vertices.columns, *(F.when(n > 1e-12, F.try_divide(t, n)).otherwise(F.lit(f)).alias(f"n{a}") for t, f, a in zip(total, fallback, "xyz")))


def taubin_mesh(vertices: DataFrame, faces: DataFrame, rounds: int, lam: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Vertices moved by rounds of (lam, mu) towards the mean of their neighbours; neighbours are stored once."""
    near = materialize(vertex_neighbours(faces), "neighbours")
    out = vertices
    for n in range(rounds):
        for f in (lam, mu):
            mean = near.join(out.select("sample_id", F.col("vertex_id").alias("neighbour"), "x", "y", "z"), ["sample_id", "neighbour"]).groupBy("sample_id", "vertex_id").agg(
                *(F.avg(a).alias(f"_{a}") for a in "xyz"))
            out = out.join(mean, ["sample_id", "vertex_id"], "left").select("sample_id", "vertex_id", *(
                (F.col(a) + F.coalesce(F.col(f"_{a}") - F.col(a), F.lit(0.0)) * f).alias(a) for a in "xyz"))
        if n % 3 == 2 or n == rounds - 1:
            out = materialize(out, "smoothed")
    return out


QUADRIC = ["q00", "q01", "q02", "q03", "q11", "q12", "q13", "q22", "q23", "q33"]


def _lowest(q: dict[str, Column], fallback: Column) -> tuple[g.Vector, Column]:
    """(place where the quadric is least, whether it is well defined): the 3 x 3 system by Cramer's rule."""
    m = [[q[f"q{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]
    right = [-q[f"q{i}3"] for i in range(3)]

    def det(c: list[list[Column]]) -> Column:
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    whole, trace = det(m), m[0][0] + m[1][1] + m[2][2]
    place = tuple(F.try_divide(det([[right[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), whole) for k in range(3))
    return place, F.coalesce(F.abs(whole) > fallback * trace * trace * trace, F.lit(False))


def simplify(vertices: DataFrame, faces: DataFrame, ratio: float = 0.25, max_rounds: int = 40, max_error: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quadric simplification in rounds of independent collapses: (vertices, faces, report) with about ``ratio`` of the faces.

    The report (sample_id, faces_before, faces_after, target, status, error) says ``ok`` where the target is met, ``stuck``
    where no collapse was left that keeps the surface sound or below ``max_error``, ``rounds`` where rounds ran out; error is
    the largest quadric cost of any collapse made.

    Area-weighted plane quadrics are summed per vertex. In a round an edge is collapsed, to the place where the sum of
    its ends' quadrics is least, or where that is singular or farther off than the edge is long to the cheaper of its ends
    and middle, if its (cost, id) is the least among all edges at either end and at
    their neighbours, so that no two collapses touch; those that would turn a face over, touch a
    boundary or link more than two common neighbours are left out. Rounds stop at the target.
    """
    target = materialize(faces.groupBy("sample_id").agg(F.count("*").alias("faces_before"), (F.count("*") * ratio).alias("_target")), "targets")
    errors: list[DataFrame] = []
    status = "rounds"
    n = g.cross(g.sub(g.vec("b"), g.vec("a")), g.sub(g.vec("c"), g.vec("a")))
    for _ in range(max_rounds):
        soup = to_soup(vertices, faces).withColumn("area", g.norm(n) / 2)
        d = -g.dot(g.vec("n"), g.vec("a"))
        plane = [F.col("nx"), F.col("ny"), F.col("nz"), d]
        parts = soup.join(faces.select("sample_id", F.col("face_id").alias("tri_id"), "v1", "v2", "v3"), ["sample_id", "tri_id"]).select(
            "sample_id", F.explode(F.array("v1", "v2", "v3")).alias("vertex_id"),
            *((plane[p] * plane[q] * F.col("area")).alias(f"q{p}{q}") for p in range(4) for q in range(p, 4)))
        quadrics = vertices.join(parts.groupBy("sample_id", "vertex_id").agg(*(F.sum(q).alias(q) for q in QUADRIC)), ["sample_id", "vertex_id"])
        edges = mesh_edges(faces)
        locked = edges.filter("n_faces <> 2").select("sample_id", F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
        free = quadrics.join(locked, ["sample_id", "vertex_id"], "left_anti")
        ends = edges.select("sample_id", "a", "b")
        for e in ("a", "b"):
            ends = ends.join(free.select("sample_id", F.col("vertex_id").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in ("x", "y", "z", *QUADRIC))), ["sample_id", e])
        q = {c: F.col(f"a_{c}") + F.col(f"b_{c}") for c in QUADRIC}

        def cost(p: g.Vector) -> Column:
            v = (*p, F.lit(1.0))
            return reduce(lambda s, t: s + t, (q[f"q{i}{j}"] * v[i] * v[j] * (1.0 if i == j else 2.0) for i in range(4) for j in range(i, 4)))

        middle = g.scale(g.add(g.vec("a_"), g.vec("b_")), F.lit(0.5))
        # the place is worked out in a frame about the edge's middle, where the system is best conditioned
        moved_q = {f"q{i}{j}": q[f"q{i}{j}"] for i in range(3) for j in range(i, 3)} | {
            f"q{i}3": q[f"q{i}3"] + sum((q[f"q{min(i, j)}{max(i, j)}"] * middle[j] for j in range(1, 3)), q[f"q0{i}"] * middle[0]) for i in range(3)}
        offset, sound = _lowest(moved_q, F.lit(1e-6))
        length = g.norm(g.sub(g.vec("b_"), g.vec("a_")))
        placed = ends.withColumns({"_ox": offset[0], "_oy": offset[1], "_oz": offset[2], "_sound": sound, "_length": length})
        near_by = F.col("_sound") & (g.norm(g.vec("_o")) <= F.col("_length"))
        optimum = tuple(F.when(near_by, m + o) for m, o in zip(middle, g.vec("_o")))
        spots = [g.vec("a_"), g.vec("b_"), middle, optimum]
        priced_at = [F.struct(F.round(F.greatest(cost(s), F.lit(0.0)), 12).alias("cost"), F.lit(k).alias("k"), *(e.alias(a) for a, e in zip("xyz", s))) for k, s in enumerate(spots)]
        priced_at[3] = F.when(near_by, priced_at[3])
        best = F.array_min(F.array(*priced_at))
        priced = placed.select("sample_id", "a", "b", best.alias("s")).select("sample_id", "a", "b", "s.cost", "s.x", "s.y", "s.z")
        if max_error is not None:
            priced = priced.filter(F.col("cost") <= max_error)
        priced = materialize(priced, "collapses")
        near = materialize(vertex_neighbours(faces), "neighbours")
        rank = F.struct("cost", F.xxhash64("a", "b").alias("h"), "a", "b")
        least = lambda df: df.groupBy("sample_id", "vertex_id").agg(F.min("r").alias("r"))
        own = least(priced.select("sample_id", F.explode(F.array("a", "b")).alias("vertex_id"), rank.alias("r")))
        ring = own
        for _ in range(2):
            seen = near.join(ring.withColumnRenamed("vertex_id", "neighbour"), ["sample_id", "neighbour"]).select("sample_id", "vertex_id", "r")
            ring = least(seen.unionByName(ring.select("sample_id", "vertex_id", "r")))
        chosen = priced.withColumn("r", rank)
        for e in ("a", "b"):
            chosen = chosen.join(ring.select("sample_id", F.col("vertex_id").alias(e), F.col("r").alias(f"r_{e}")), ["sample_id", e])
        chosen = chosen.filter("r = r_a and r = r_b").drop("r", "r_a", "r_b")
        # the link condition: the ends share exactly the two vertices of their two faces
        shared = chosen.select("sample_id", "a", "b").join(near.select("sample_id", F.col("vertex_id").alias("a"), "neighbour"), ["sample_id", "a"]).join(
            near.select("sample_id", F.col("vertex_id").alias("b"), "neighbour"), ["sample_id", "b", "neighbour"]).groupBy("sample_id", "a", "b").count().filter("count = 2")
        chosen = chosen.join(shared.select("sample_id", "a", "b"), ["sample_id", "a", "b"], "left_semi")
        moved = chosen.select("sample_id", F.explode(F.array("a", "b")).alias("vertex_id"), "a", "b", F.struct("x", "y", "z").alias("to"))
        touched = faces
        for k, c in enumerate(CORNERS):
            touched = touched.join(moved.select("sample_id", F.col("vertex_id").alias(f"v{k + 1}"), F.col("a").alias(f"m{c}"), F.col("b").alias(f"mb{c}"), F.col("to").alias(f"to{c}")), ["sample_id", f"v{k + 1}"], "left")
        before = to_soup(vertices, faces)
        after = touched.join(before.withColumnRenamed("tri_id", "face_id"), ["sample_id", "face_id"])
        at = {c: tuple(F.coalesce(F.col(f"to{c}.{a}"), F.col(f"{c}{a}")) for a in "xyz") for c in CORNERS}
        turned = g.cross(g.sub(at["b"], at["a"]), g.sub(at["c"], at["a"]))
        gone = (F.col("ma") == F.col("mb")) & F.col("ma").isNotNull() | (F.col("mb") == F.col("mc")) & F.col("mb").isNotNull() | (F.col("mc") == F.col("ma")) & F.col("mc").isNotNull()
        any_moved = F.coalesce("ma", "mb", "mc")
        bad = after.filter(any_moved.isNotNull() & ~F.coalesce(gone, F.lit(False)) & (g.dot(turned, g.vec("n")) <= g.norm(turned) * 0.2)).select(
            "sample_id", any_moved.alias("a")).distinct()
        chosen = chosen.join(bad, ["sample_id", "a"], "left_anti")
        over = faces.groupBy("sample_id").agg(F.count("*").alias("_n")).join(target.drop("faces_before"), "sample_id").filter("_n > _target")
        room = over.select("sample_id", F.ceil((F.col("_n") - F.col("_target")) / 2).alias("_room"))
        order = Window.partitionBy("sample_id").orderBy("cost", "a", "b")
        chosen = materialize(chosen.join(room, "sample_id").withColumn("_k", F.row_number().over(order)).filter("_k <= _room").drop("_k", "_room"), "chosen")
        if not chosen.limit(1).count():
            status = "stuck"
            break
        errors.append(chosen.groupBy("sample_id").agg(F.max("cost").alias("_cost")))
        into = chosen.select("sample_id", F.col("b").alias("vertex_id"), F.col("a").alias("_to"))
        place = chosen.select("sample_id", F.col("a").alias("vertex_id"), *(F.col(a).alias(f"_{a}") for a in "xyz"))
        vertices = materialize(vertices.join(into, ["sample_id", "vertex_id"], "left_anti").join(place, ["sample_id", "vertex_id"], "left").select(
            "sample_id", "vertex_id", *(F.coalesce(f"_{a}", a).alias(a) for a in "xyz")), "vertices")
        renamed = faces
        for k in range(3):
            renamed = renamed.join(into.withColumnRenamed("vertex_id", f"v{k + 1}"), ["sample_id", f"v{k + 1}"], "left").withColumn(f"v{k + 1}", F.coalesce("_to", f"v{k + 1}")).drop("_to")
        faces = materialize(renamed.filter("v1 <> v2 and v2 <> v3 and v3 <> v1").select("sample_id", "face_id", "v1", "v2", "v3"), "faces")
    worst = reduce(DataFrame.unionByName, errors).groupBy("sample_id").agg(F.max("_cost").alias("error")) if errors else target.select("sample_id", F.lit(0.0).alias("error"))
    left = faces.groupBy("sample_id").agg(F.count("*").alias("faces_after"))
    report = target.join(left, "sample_id", "left").join(worst, "sample_id", "left").select(
        "sample_id", "faces_before", F.coalesce("faces_after", F.lit(0)).alias("faces_after"), F.ceil("_target").alias("target"),
        F.when(F.coalesce("faces_after", F.lit(0)) <= F.col("_target") + 1, "ok").otherwise(status).alias("status"), F.coalesce("error", F.lit(0.0)).alias("error"))
    return vertices, faces, report
