"""Components and shortest paths by bricks against union-find and Dijkstra, over many bricks."""

import heapq
import itertools
import math

import numpy as np
import pytest

from voxframe.operators import bricks, graph, measure

ALL = [m for m in itertools.product((-1, 0, 1), repeat=3) if any(m)]


def table(spark, cells, sample=0):
    return spark.createDataFrame([(sample, *map(int, c)) for c in cells], "sample_id long, i int, j int, k int")


def snake(n):
    """One way that fills a plane in turns, so that it enters every brick several times."""
    return [(i, j, 1) for i in range(0, n, 2) for j in range(n)] + [(i, n - 1 if i % 4 == 1 else 0, 1) for i in range(1, n - 1, 2)]


def porous(seed, n, share):
    solid = np.random.default_rng(seed).random((n, n, n)) < share
    return [tuple(map(int, c)) for c in np.argwhere(solid)]


def slow_parts(cells):
    left, out = set(cells), {}
    while left:
        first = min(left)
        stack, part = [first], []
        left.discard(first)
        while stack:
            c = stack.pop()
            part.append(c)
            for d in bricks.FACES:
                for s in (1, -1):
                    n = tuple(a + s * b for a, b in zip(c, d))
                    if n in left:
                        left.discard(n)
                        stack.append(n)
        out |= {c: min(part) for c in part}
    return out


@pytest.mark.parametrize("cells", [snake(14), porous(1, 11, 0.3), porous(2, 9, 0.5), [(0, 0, 0)], []], ids=["snake", "sparse", "dense", "one", "none"])
def test_components_over_bricks(spark, cells):
    got = {(r["i"], r["j"], r["k"]): r["component"] for r in bricks.voxel_components(table(spark, cells), side=4).collect()}
    want = {c: (f[0] * bricks.SPAN + f[1]) * bricks.SPAN + f[2] for c, f in slow_parts(cells).items()}
    assert got == want


def test_part_rows_not_voxels_enter_the_rounds(spark):
    """A block of 4^3 bricks is 64 parts, whatever its voxels."""
    cells = list(itertools.product(range(16), repeat=3))
    parts = bricks.part_components(bricks.brick_parts(table(spark, cells), side=4), side=4)
    assert parts.count() == 64 and {r["component"] for r in parts.collect()} == {0}


def dijkstra(cells, sources, targets):
    cells, best = set(cells), {}
    heap = [(0, c) for c in sources if c in cells]
    while heap:
        cost, c = heapq.heappop(heap)
        if c in best:
            continue
        best[c] = cost
        for m in ALL:
            n = tuple(a + b for a, b in zip(c, m))
            if n in cells and n not in best:
                heapq.heappush(heap, (cost + bricks.whole_cost(math.sqrt(sum(x * x for x in m))), n))
    reached = [best[t] for t in targets if t in best]
    return {c: v for c, v in best.items() if not reached or v <= min(reached)}


@pytest.mark.parametrize("seed, share, side", [(3, 0.35, 4), (4, 0.25, 3), (5, 0.9, 5), (6, 0.12, 4), (7, 0.3, 32)])
def test_paths_over_bricks(spark, seed, share, side):
    cells = porous(seed, 9, share)
    sources, targets = [c for c in cells if c[2] == 0], [c for c in cells if c[2] == 8]
    got = bricks.shortest_paths(table(spark, cells), measure.MOVES, table(spark, sources), table(spark, targets), parents=True, side=side).collect()
    want = dijkstra(cells, sources, targets)
    assert {(r["i"], r["j"], r["k"]): round(r["cost"] * bricks.UNIT) for r in got} == want
    for r in got:
        here = (r["i"], r["j"], r["k"])
        near = [n for m in ALL for n in [tuple(a - b for a, b in zip(here, m))] if n in want and want[n] + bricks.whole_cost(math.sqrt(sum(x * x for x in m))) == want[here]]
        assert (r["pi"], r["pj"], r["pk"]) == (min(near) if near and want[here] else (None, None, None))


def test_rounds_follow_bricks(spark):
    """A snake through 4^3 bricks is traced to its end; its length is that of the plain walk."""
    cells = snake(9)
    start, end = table(spark, [(0, 0, 1)]), table(spark, [(8, 8, 1)])
    paths = bricks.shortest_paths(table(spark, cells), [(*d, 1.0) for s in (1, -1) for d in [tuple(s * x for x in f) for f in bricks.FACES]], start, end, parents=True, side=4)
    rows = bricks.trace_back(paths, end, side=4).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(len(cells))) and (rows[-1]["i"], rows[-1]["j"]) == (0, 0)
    assert max(r["cost"] for r in paths.collect()) == len(cells) - 1


def test_samples_share_rounds_and_blocked_ones_end(spark):
    open_ = [(0, 0, k) for k in range(9)]
    nodes = table(spark, open_, 1).unionByName(table(spark, [c for c in open_ if c[2] != 4], 2))
    ends = [table(spark, [(0, 0, k)], s) for k in (0, 8) for s in (1, 2)]
    got = bricks.shortest_paths(nodes, measure.MOVES, ends[0].unionByName(ends[1]), ends[2].unionByName(ends[3]), side=2).collect()
    assert max(r["cost"] for r in got if r["sample_id"] == 1) == 8 and max(r["cost"] for r in got if r["sample_id"] == 2) == 3


def test_contracted_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 7)
    rng = np.random.default_rng(4)
    edges = [(k, int(a), int(b)) for k in (1, 2) for a, b in rng.integers(0, 80, (55, 2))] + [(3, i, i + 1) for i in range(70)] + [(4, 5, 5)]
    df = spark.createDataFrame(edges, "g long, a long, b long").repartition(3)
    key = lambda d: sorted((r["g"], r["node"], r["component"]) for r in d.collect())
    assert key(graph.contracted_components(df, keys=["g"])) == key(graph.connected_components(df, keys=["g"]))
    assert graph.contracted_components(df.limit(0), keys=["g"]).count() == 0
