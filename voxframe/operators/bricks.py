"""Voxels by bricks: components and shortest paths whose rounds cross bricks, not voxels.

A brick is a cube of SIDE voxels, one row with the places of its voxels as an array, so no
row outgrows SIDE^3 numbers. What lies within a brick is settled in one numpy step by the
task that holds it; only brick faces are exchanged between bricks, by joins. A way through
a thousand voxels in one brick costs one round, and a round writes face rows, not the
volume.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize
from .graph import connected_components, joined

CELL = ["i", "j", "k"]
BRICK = ["bi", "bj", "bk"]
#: Voxels along a brick's edge, and the span of an index in a voxel's id.
SIDE, SPAN = 32, 1 << 20
FAR = np.int64(1) << np.int64(60)
#: Costs are whole numbers of this many to the unit, so that equal ways cost the same in any order of steps.
UNIT = 10**9


def brick_of(side: int = SIDE) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("int").alias(b) for c, b in zip(CELL, BRICK)]


def place_in(side: int = SIDE) -> Column:
    """Number of a voxel within its brick, i slowest."""
    at = [F.pmod(F.col(c), F.lit(side)) for c in CELL]
    return ((at[0] * side + at[1]) * side + at[2]).cast("int")


def pack(voxels: DataFrame, side: int = SIDE, carry: dict[str, Column] | None = None) -> DataFrame:
    """sample_id, bi, bj, bk, cells: one row a brick; ``carry`` adds an array per name, in the order of the cells."""
    carry = carry or {}
    rows = voxels.select("sample_id", *brick_of(side), F.struct(place_in(side).alias("cell"), *(e.alias(n) for n, e in carry.items())).alias("v"))
    listed = rows.groupBy("sample_id", *BRICK).agg(F.collect_list("v").alias("v"))
    return listed.select("sample_id", *BRICK, F.col("v.cell").alias("cells"), *(F.col(f"v.{n}").alias(n) for n in carry))


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch[name]
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _axes(cells: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return cells // (side * side), cells // side % side, cells % side


def _ids(brick: tuple[int, int, int], x: np.ndarray, y: np.ndarray, z: np.ndarray, side: int) -> np.ndarray:
    return ((brick[0] * side + x.astype(np.int64)) * SPAN + brick[1] * side + y) * SPAN + brick[2] * side + z


def local_parts(cells: np.ndarray, side: int, moves: list[tuple[int, int, int]]) -> np.ndarray:
    """For each cell of a brick the least cell of its part, by the given half of all neighbour steps."""
    cells = np.asarray(cells, np.int64)
    order = np.argsort(cells)
    x, y, z = _axes(cells[order], side)
    grid = np.full((side + 2,) * 3, -1, np.int64)
    grid[x + 1, y + 1, z + 1] = np.arange(len(cells))
    pairs = [(np.flatnonzero(near >= 0), near[near >= 0]) for dx, dy, dz in moves for near in [grid[x + 1 + dx, y + 1 + dy, z + 1 + dz]]]
    root = joined(len(cells), *(np.concatenate(p) for p in zip(*pairs)))
    out = np.empty(len(cells), np.int64)
    out[order] = cells[order][root]
    return out


FACES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def brick_parts(solid: DataFrame, side: int = SIDE) -> DataFrame:
    """sample_id, bi, bj, bk, cells, parts: bricks with the id of each voxel's part within its brick (its first voxel's id)."""
    schema = "sample_id long, bi int, bj int, bk int, cells array<int>, parts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bricks, parts = list(zip(*(batch[b].to_pylist() for b in BRICK))), []
            for brick, cells in zip(bricks, _lists(batch, "cells")):
                least = local_parts(cells, side, FACES)
                parts.append(_ids(brick, *_axes(least, side), side))
            column = pa.ListArray.from_arrays(pa.array(batch["cells"].offsets.to_numpy() - batch["cells"].offsets[0].as_py()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("sample_id", *BRICK, "cells")), column], names=["sample_id", *BRICK, "cells", "parts"])

    return pack(solid.select("sample_id", *CELL), side).mapInArrow(run, schema)


def _face_rows(bricks: DataFrame, side: int) -> DataFrame:
    """sample_id, axis, high, voxel, part: voxels on the faces of bricks; those on a high face carry the id of the voxel beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, brick, cells, parts in zip(batch["sample_id"].to_pylist(), zip(*(batch[b].to_pylist() for b in BRICK)), _lists(batch, "cells"), _lists(batch, "parts")):
                at = _axes(cells, side)
                for axis in range(3):
                    for high in (False, True):
                        on = at[axis] == (side - 1 if high else 0)
                        if not on.any():
                            continue
                        here = [c[on] + (high and n == axis) for n, c in enumerate(at)]
                        n = int(on.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, sample, np.int64)), pa.array(np.full(n, axis, np.int32)), pa.array(np.full(n, high)), pa.array(_ids(brick, *here, side)), pa.array(parts[on])],
                            names=["sample_id", "axis", "high", "voxel", "part"])

    return bricks.mapInArrow(run, "sample_id long, axis int, high boolean, voxel long, part long")


def part_components(bricks: DataFrame, side: int = SIDE) -> DataFrame:
    """sample_id, part, component, size of every brick part: parts that touch across a face are one component."""
    faces = materialize(_face_rows(bricks, side), "brick-faces")
    low = faces.filter("not high").select("sample_id", "axis", "voxel", F.col("part").alias("b"))
    links = faces.filter("high").select("sample_id", "axis", "voxel", F.col("part").alias("a")).join(low, ["sample_id", "axis", "voxel"]).select("sample_id", "a", "b").distinct()
    found = connected_components(links, keys=["sample_id"]).withColumnRenamed("node", "part")
    sizes = bricks.select("sample_id", F.explode("parts").alias("part")).groupBy("sample_id", "part").agg(F.count("*").alias("size"))
    out = materialize(sizes.join(found, ["sample_id", "part"], "left").select("sample_id", "part", F.coalesce("component", "part").alias("component"), "size"), "brick-parts")
    discard(faces)
    return out


def voxel_rows(bricks: DataFrame, named: DataFrame, side: int = SIDE) -> DataFrame:
    """sample_id, i, j, k, component of all voxels; a brick meets the names of its own parts, not each voxel its component."""
    own = bricks.select("sample_id", *BRICK, F.explode(F.array_distinct("parts")).alias("part")).join(named.select("sample_id", "part", "component"), ["sample_id", "part"])
    names = own.groupBy("sample_id", *BRICK).agg(F.map_from_entries(F.collect_list(F.struct("part", "component"))).alias("names"))
    rows = bricks.join(names, ["sample_id", *BRICK]).select("sample_id", *BRICK, "names", F.explode(F.arrays_zip("cells", "parts")).alias("v"))
    cell = F.col("v.cells")
    at = [F.floor(cell / (side * side)), F.floor(cell / side) % side, cell % side]
    return rows.select("sample_id", *((F.col(b) * side + e).cast("int").alias(c) for b, e, c in zip(BRICK, at, CELL)), F.element_at("names", F.col("v.parts")).alias("component"))


def voxel_components(solid: DataFrame, side: int = SIDE) -> DataFrame:
    """sample_id, i, j, k, component (its first voxel's id) over face neighbours: parts within bricks, then rounds over parts only."""
    bricks = materialize(brick_parts(solid, side), "bricks")
    return voxel_rows(bricks, part_components(bricks, side), side)


def component_table(solid: DataFrame, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(sample_id, i, j, k, component; sample_id, component, size), the sizes summed over parts, not over voxels."""
    bricks = materialize(brick_parts(solid, side), "bricks")
    parts = part_components(bricks, side)
    return voxel_rows(bricks, parts, side), parts.groupBy("sample_id", "component").agg(F.sum("size").alias("size"))


def _largest(sizes: DataFrame) -> DataFrame:
    """The largest component of each sample; of equal sizes the first in i, j, k order."""
    return sizes.groupBy("sample_id").agg(F.max(F.struct(F.col("size"), (-F.col("component")).alias("c"))).alias("m"), F.count("*").alias("components"), F.sum("size").alias("solid")).select(
        "sample_id", (-F.col("m.c")).alias("component"), "components", (F.col("solid") - F.col("m.size")).alias("removed"))


def largest_component(solid: DataFrame) -> DataFrame:
    """The voxels of each sample's largest face-connected part; of equal sizes the first in i, j, k order."""
    labelled, sizes = component_table(solid)
    return labelled.join(_largest(sizes), ["sample_id", "component"], "left_semi").select("sample_id", *CELL)


def remove_islands(field: DataFrame, iso: float, air: float) -> tuple[DataFrame, DataFrame]:
    """(field with all but the largest solid part turned to air, counts per sample: components and voxels removed)."""
    labelled, sizes = component_table(field.filter(F.col("value") < iso))
    best = _largest(sizes)
    lost = labelled.join(best, ["sample_id", "component"], "left_anti").select("sample_id", *CELL, F.lit(air).alias("_air"))
    cleaned = field.join(lost, ["sample_id", *CELL], "left").withColumn("value", F.coalesce("_air", "value")).drop("_air")
    return cleaned, best.select("sample_id", F.col("components").alias("n_components"), F.col("removed").alias("removed_voxels"))


# shortest paths

def whole_cost(weight: float) -> int:
    return round(weight * UNIT)


def settle(cost: np.ndarray, open_: np.ndarray, moves: list[tuple[int, int, int, int]]) -> None:
    """Lowers the costs of a padded block in place until no move along open voxels lowers any more."""
    core = tuple(slice(1, s - 1) for s in cost.shape)
    way = open_[core]
    steps = [(tuple(slice(1 - d, s - 1 - d) for d, s in zip(m[:3], cost.shape)), m[3]) for m in moves]
    while True:
        before = cost[core].copy()
        for source, w in steps:
            np.minimum(cost[core], cost[source] + w, out=cost[core], where=way)
        if (before == cost[core]).all():
            return
        steps.reverse()


OPEN, SOURCE, TARGET = 0, 1, 2


def _settled(batch: pa.RecordBatch, side: int, moves: list[tuple[int, int, int, int]]):
    """Per brick of a batch: sample, brick, cells, flags, their costs, the padded block and its low corner."""
    bricks = list(zip(*(batch[b].to_pylist() for b in BRICK)))
    for sample, brick, cells, flags, at, price in zip(batch["sample_id"].to_pylist(), bricks, *(_lists(batch, n) for n in ("cells", "flags", "in_cells", "in_costs"))):
        where = _axes(cells, side)
        low, high = [int(c.min()) for c in where], [int(c.max()) for c in where]
        cost = np.full([b - a + 3 for a, b in zip(low, high)], FAR, np.int64)
        open_ = np.zeros(cost.shape, bool)
        here = tuple(c - a + 1 for c, a in zip(where, low))
        open_[here] = True
        first = np.full(side**3, FAR, np.int64)
        np.minimum.at(first, at, price)
        cost[here] = np.where(flags & SOURCE, 0, first[cells])
        settle(cost, open_, moves)
        yield sample, brick, cells, flags, cost[here], cost, here


MESSAGE = "sample_id long, bi int, bj int, bk int, cell int, cost long, origin long"


def _messages(side: int, moves: list[tuple[int, int, int, int]]):
    """Settles bricks; emits what they offer to voxels of other bricks, and with cell -1 the cost of their cheapest target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, brick, cells, flags, cost, _, _ in _settled(batch, side, moves):
                rows = []
                done = (flags & TARGET > 0) & (cost < FAR)
                if done.any():
                    rows.append((np.array([brick]), np.array([-1]), cost[done].min(keepdims=True), np.array([0])))
                where = np.stack(_axes(cells, side), axis=1)
                rim = np.flatnonzero(((where == 0) | (where == side - 1)).any(axis=1) & (cost < FAR))
                for dx, dy, dz, w in moves:
                    to = where[rim] + (dx, dy, dz)
                    out = ((to < 0) | (to >= side)).any(axis=1)
                    if out.any():
                        to, own = to[out], rim[out]
                        local = to % side
                        rows.append((np.array(brick) + to // side, (local[:, 0] * side + local[:, 1]) * side + local[:, 2], cost[own] + w, _ids(brick, *where[own].T, side)))
                if rows:
                    to, cell, price, origin = (np.concatenate(c) for c in zip(*rows))
                    # the cheapest offer to each voxel, of equal ones the first origin
                    order = np.lexsort((origin, price, cell, *to.T))
                    names = np.column_stack([to, cell])[order]
                    best = order[np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), sample, np.int64)), *(pa.array(to[best, n].astype(np.int32)) for n in range(3)), pa.array(cell[best].astype(np.int32)),
                         pa.array(price[best]), pa.array(origin[best])], names=["sample_id", *BRICK, "cell", "cost", "origin"])

    return run


PATHS = "sample_id long, i int, j int, k int, cost long, pi int, pj int, pk int"


def _final(side: int, moves: list[tuple[int, int, int, int]]):
    """All settled voxels with their origin: of the neighbours that explain the cost the first in i, j, k order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offers = zip(_lists(batch, "in_cells"), _lists(batch, "in_costs"), _lists(batch, "in_origins"))
            for (at, price, sender), (sample, brick, cells, flags, cost, block, here) in zip(offers, _settled(batch, side, moves)):
                where = _axes(cells, side)
                origin = np.full(len(cells), np.iinfo(np.int64).max)
                for dx, dy, dz, w in moves:
                    near = block[tuple(c - d for c, d in zip(here, (dx, dy, dz)))]
                    ok = (near < FAR) & (near + w == cost)
                    origin[ok] = np.minimum(origin[ok], _ids(brick, where[0][ok] - dx, where[1][ok] - dy, where[2][ok] - dz, side))
                row = np.full(side**3, -1)
                row[cells] = np.arange(len(cells))
                known = row[at] >= 0
                at, price, sender = row[at[known]], price[known], sender[known]
                ok = cost[at] == price
                origin[at[ok]] = np.minimum(origin[at[ok]], sender[ok])
                own = cost < FAR
                none = (flags[own] & SOURCE > 0) | (origin[own] == np.iinfo(np.int64).max)
                parent = (origin[own] // (SPAN * SPAN), origin[own] // SPAN % SPAN, origin[own] % SPAN)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(own.sum()), sample, np.int64)), *(pa.array((brick[n] * side + where[n][own]).astype(np.int32)) for n in range(3)), pa.array(cost[own]),
                     *(pa.array(p.astype(np.int32), mask=none) for p in parent)], names=[f.split()[0] for f in PATHS.split(", ")])

    return run


def shortest_paths(nodes: DataFrame, moves: list[tuple[int, int, int, float]], sources: DataFrame, targets: DataFrame, parents: bool = False, side: int = SIDE) -> DataFrame:
    """Least cost from any source to every node that is no dearer than its sample's best target (to all nodes reached, without one).

    ``nodes``, ``sources``, ``targets``: sample_id, i, j, k (from 0). Bricks that hold sources settle first; what a brick
    offers to voxels beyond its faces goes to their bricks, and bricks with a better offer than before settle anew.
    Rounds are about the number of bricks that the dearest way crosses, plus those that it enters again; a round stores the
    improved offers only. Costs are exact to nine decimals. Returns sample_id, i, j, k, cost and, if asked for, the move's
    origin (pi, pj, pk; of equal costs the first in order). All samples share the rounds.
    """
    key, offer = ["sample_id", *BRICK], ["sample_id", *BRICK, "cell"]
    steps = [(*m[:3], whole_cost(m[3])) for m in moves]
    mark = lambda df, flag: df.select("sample_id", *CELL).distinct().withColumn(f"_{flag}", F.lit(flag))
    flagged = nodes.select("sample_id", *CELL).distinct().join(mark(sources, SOURCE), ["sample_id", *CELL], "left").join(mark(targets, TARGET), ["sample_id", *CELL], "left")
    bricks = materialize(pack(flagged, side, {"flags": F.coalesce(f"_{SOURCE}", F.lit(0)) + F.coalesce(f"_{TARGET}", F.lit(0))}), "path-bricks")
    touched = bricks.filter(F.exists("flags", lambda f: f.bitwiseAND(SOURCE) > 0)).select(*key)
    inbox: DataFrame | None = None
    rounds: list[DataFrame] = []
    limit: DataFrame | None = None

    def with_offers(chosen: DataFrame) -> DataFrame:
        """The bricks chosen, with all offers made to them so far."""
        at = chosen.join(bricks, key)
        if inbox is None:
            none = F.array().cast("array<long>")
            return at.select(*key, "cells", "flags", F.array().cast("array<int>").alias("in_cells"), none.alias("in_costs"), none.alias("in_origins"))
        lists = inbox.join(chosen, key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("cell", "cost", "origin")).alias("o"))
        empty = lambda c, kind: F.coalesce(F.col(f"o.{c}"), F.array().cast(f"array<{kind}>"))
        return at.join(lists, key, "left").select(*key, "cells", "flags", empty("cell", "int").alias("in_cells"), empty("cost", "long").alias("in_costs"), empty("origin", "long").alias("in_origins"))

    while True:
        made = materialize(with_offers(touched).mapInArrow(_messages(side, steps), MESSAGE), "offers")
        hit = made.filter("cell < 0").select("sample_id", "cost")
        limit = materialize((hit if limit is None else hit.unionByName(limit.withColumnRenamed("limit", "cost"))).groupBy("sample_id").agg(F.min("cost").alias("limit")), "limits")
        best = made.filter("cell >= 0").groupBy(*offer).agg(F.min(F.struct("cost", "origin")).alias("b")).select(*offer, "b.*")
        best = best.join(bricks.select(*key), key, "left_semi").join(limit, "sample_id", "left").filter("limit is null or cost <= limit").drop("limit")
        if inbox is not None:
            old = inbox.select(*offer, F.col("cost").alias("_cost"), F.col("origin").alias("_origin"))
            best = best.join(old, offer, "left").filter("_cost is null or cost < _cost or (cost = _cost and origin < _origin)")
            best = best.select(*offer, "cost", "origin", F.expr("_cost is null or cost < _cost").alias("cheaper"))
        else:
            best = best.withColumn("cheaper", F.lit(True))
        better = materialize(best, "better")
        discard(made)
        if not better.limit(1).count():
            break
        rounds.append(better.drop("cheaper"))
        if len(rounds) > 7:
            # the last round still says which bricks are touched
            old, rounds = rounds[:-1], [materialize(_least(rounds[:-1], offer), "inbox"), rounds[-1]]
            discard(*old)
        inbox = _least(rounds, offer)
        touched = better.filter("cheaper").select(*key).distinct()
    reached = bricks.filter(F.exists("flags", lambda f: f.bitwiseAND(SOURCE) > 0)).select(*key)
    if inbox is not None:
        reached = reached.unionByName(inbox.select(*key)).distinct()
    rows = with_offers(reached).mapInArrow(_final(side, steps), PATHS).join(limit, "sample_id", "left").filter("limit is null or cost <= limit")
    out = rows.select("sample_id", *CELL, (F.col("cost") / float(UNIT)).alias("cost"), *(["pi", "pj", "pk"] if parents else []))
    return materialize(out, "paths")


def _least(parts: list[DataFrame], offer: list[str]) -> DataFrame:
    """The best offer to each voxel over the stored rounds."""
    return reduce(DataFrame.unionByName, parts).groupBy(*offer).agg(F.min(F.struct("cost", "origin")).alias("b")).select(*offer, "b.*")


def trace_back(paths: DataFrame, ends: DataFrame, side: int = SIDE) -> DataFrame:
    """Rows sample_id, step (0 at the end), i, j, k along the recorded origins of ``shortest_paths``; a round follows a way through one brick."""
    key = ["sample_id", *BRICK]
    bricks = materialize(pack(paths, side, {"up": F.when(F.col("pi").isNotNull(), (F.col("pi").cast("long") * SPAN + F.col("pj")) * SPAN + F.col("pk"))}), "traced-bricks")
    schema = "sample_id long, step int, i int, j int, k int, more boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                up, (bi, bj, bk) = dict(zip(r["cells"], r["up"])), (r["bi"], r["bj"], r["bk"])
                i, j, k, step = r["i"], r["j"], r["k"], r["step"]
                while True:
                    inside = (i // side, j // side, k // side) == (bi, bj, bk)
                    rows.append((r["sample_id"], step, i, j, k, not inside))
                    parent = up.get(((i % side) * side + j % side) * side + k % side) if inside else None
                    if parent is None:
                        break
                    i, j, k, step = parent // (SPAN * SPAN), parent // SPAN % SPAN, parent % SPAN, step + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.int32()] * 4, pa.bool_()))], names=["sample_id", "step", *CELL, "more"])

    heads, parts = ends.select("sample_id", F.lit(0).alias("step"), *CELL), []
    while True:
        walked = materialize(heads.select("*", *brick_of(side)).join(bricks, key).mapInArrow(run, schema), "walked")
        parts.append(walked.filter("not more").drop("more"))
        heads = walked.filter("more").drop("more")
        if not heads.limit(1).count():
            return reduce(DataFrame.unionByName, parts)
