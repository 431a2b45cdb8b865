"""Graph tables: components, edits and look-ups of weighted graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """Links every node's neighbours (the larger ones, or the others) to the least node nearby.

    Only a minimum per node is aggregated: a node with many neighbours is never one list.
    """
    if large:
        both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*keys, "b", "a"))
    else:
        both = edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, [*keys, "u"])
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(*keys, F.col("u"), F.col("m")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component): the least node of its component, for every node with an edge to another.

    ``keys`` separate graphs in one table. Loops and repeated edges are harmless; an empty table
    gives an empty result. Large-star and small-star rounds, about the logarithm of the longest
    chain; each round is stored, so lineage and lost executors do not accumulate.
    """
    keys = keys or []
    state = materialize(edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        state = materialize(_star(_star(state, keys, True), keys, False), "stars")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return state.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        state.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def component_sizes(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """keys, component, size over all nodes; a node without edges is its own component."""
    labelled = nodes.join(contracted_components(edges, keys=keys).withColumnRenamed("node", node), [*keys, node], "left")
    return labelled.withColumn("component", F.coalesce("component", node)).groupBy(*keys, "component").agg(F.count("*").alias("size"))


#: Edges that a task contracts at a time.
CHUNK_EDGES = 1 << 20


def contracted_components(edges: DataFrame, a: str = "a", b: str = "b", keys: list[str] | None = None) -> DataFrame:
    """As ``connected_components`` for whole-number keys and nodes, contracted where the edges lie before any round.

    Edges are sorted by ranges of (keys, node), so that near ids fall into one task, which replaces up to CHUNK_EDGES
    of them by one edge from each node to the least of its part. Nodes of one chunk only then wait outside; the rounds
    hold the least nodes and those that several chunks share.
    """
    keys = keys or []
    names = [*keys, "node", "root"]
    schema = ", ".join(f"{n} long" for n in [*names, "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunks, held, n = TaskContext.get().partitionId(), 0, [], 0

        def contract() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            by = [table[k].to_numpy() for k in keys]
            both = np.column_stack([*(np.concatenate([c, c]) for c in by), np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])])
            order = np.lexsort(both.T[::-1])
            new = np.concatenate([[True], (both[order][1:] != both[order][:-1]).any(axis=1)])
            number = np.empty(len(both), np.int64)
            number[order] = np.cumsum(new) - 1
            things = both[order][new]
            root = joined(len(things), number[:len(both) // 2], number[len(both) // 2:])
            columns = [*things.T, things[root, -1], np.full(len(things), task * (1 << 32) + chunks)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[*names, "chunk"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield contract()
                chunks, held, n = chunks + 1, [], 0
        if n:
            yield contract()

    rows = edges.select(*keys, F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).filter("a <> b")
    stars = materialize(rows.repartitionByRange(*keys, "a", "b").mapInArrow(run, schema), "contracted")
    shared = stars.groupBy(*keys, "node").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = connected_components(stars.filter("node <> root").join(shared, [*keys, "node"], "left_semi"), "node", "root", keys).withColumnRenamed("node", "root")
    return stars.join(found, [*keys, "root"], "left").groupBy(*keys, "node").agg(F.min(F.coalesce("component", "root")).alias("component"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n`` things under the links (a, b): hook the larger root, then halve all ways."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


# edits and look-ups: edges are (graph_id, a, b, ratio), read in both directions

def add_edges(edges: DataFrame, new: DataFrame, vertices: DataFrame, order: str = "seq") -> DataFrame:
    """Old and new edges between known vertices; of the same pair the one added first stays."""
    known = vertices.select("graph_id", "vertex")
    both = edges.withColumn(order, F.lit(-1).cast("long")).unionByName(new.select(*edges.columns, F.col(order).cast("long").alias(order)))
    ok = both
    for end in ("a", "b"):
        ok = ok.join(known.withColumnRenamed("vertex", end), ["graph_id", end], "left_semi")
    pair = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    rest = [c for c in edges.columns if c != "graph_id"]
    return ok.groupBy("graph_id", *pair).agg(F.min_by(F.struct(*rest), F.struct(order, "a", "b")).alias("e")).select("graph_id", "e.*").select(*edges.columns)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    either = gone.select("graph_id", "a", "b").unionByName(gone.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(either, ["graph_id", "a", "b"], "left_anti")


def remove_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(gone.select("graph_id", F.col("vertex").alias(end)), ["graph_id", end], "left_anti")
    return edges


def edges_by_ratio(edges: DataFrame, at_least: float | None = None, at_most: float | None = None) -> DataFrame:
    if at_least is not None:
        edges = edges.filter(F.col("ratio") >= at_least)
    return edges if at_most is None else edges.filter(F.col("ratio") <= at_most)


def network_sizes(edges: DataFrame) -> DataFrame:
    """graph_id, networks, size of the largest, from edges."""
    found = contracted_components(edges, keys=["graph_id"])
    sizes = found.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("graph_id").agg(F.count("*").alias("networks"), F.max("n").alias("largest"))


def vertex_counts(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("a", "b")).alias("v")).groupBy("graph_id").agg(F.countDistinct("v").alias("vertices"))


def edge_lookup(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ratio of each asked pair in either direction, -1 where there is no edge."""
    pair = lambda df: df.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    known = pair(edges).groupBy("graph_id", "lo", "hi").agg(F.max("ratio").alias("ratio"))
    return pair(asked).join(known, ["graph_id", "lo", "hi"], "left").select("graph_id", "a", "b", F.coalesce("ratio", F.lit(-1.0)).alias("ratio"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbours of every vertex; only for graphs whose degrees fit into a row."""
    both = edges.select("graph_id", "a", "b").unionByName(edges.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy("graph_id", F.col("a").alias("vertex")).agg(F.sort_array(F.collect_list("b")).alias("neighbours"))
