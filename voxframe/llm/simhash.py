"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is set when it is set in more than half of a text's shingle
hashes. Equal fingerprints are one class. Distinct fingerprints are split into
blocks so that any two within the bit budget agree on some choice of blocks;
each choice is a key, and under one key the fingerprints form a binary trie.
The self-join walks pairs of trie nodes together, adds up the bits in which
their paths differ and drops a pair of nodes once the budget is exceeded. Links
found under a key are reduced to a spanning forest before they leave the task:
no connection is lost, and a dense group of g fingerprints yields fewer than g
links. Components of the links are found by star rounds.

Null and empty texts have fingerprint zero, linked like any other. Rows with a
null id are fingerprinted but their class id is the least id that is not null.
Repeated rows each get their result. Extra columns play no part in the search, and
``keep_one`` keeps them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import free_name, map_lists, materialize

BITS = 64
#: Fingerprints that share a key by chance, about; sets how many blocks are used.
CHANCE_GROUP = 48
#: Node pairs that one step of the walk holds.
FRONTIER = 1 << 18
#: Fingerprints handed to one walk together (whole keys; a larger key goes alone).
BATCH = 1 << 17


def fingerprint(text: str | None, words: int) -> int:
    """64-bit fingerprint of the whole text; lower-cases A-Z, splits at ASCII white space."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[min(words, len(parts)) - 1:] - 1).tolist()
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, n, step):
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[k:k + step], stops[k:k + step])], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
        for j in range(0, len(bits), 255):  # sums of 255 rows fit into bytes, which numpy adds fast
            counts += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def step(part: dict[str, list]) -> dict[str, list]:
        prints = np.array([fingerprint(t, words) for t in part["text"]], np.uint64)
        return {"doc_id": part["doc_id"], "fp": prints.view(np.int64)}

    return map_lists(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), lambda: step, "doc_id long, fp long")


def block_masks(n: int, budget: int, bits: int = BITS) -> list[int]:
    """Masks of bits; any two values within the budget agree on all bits of at least one of them.

    With budget + r blocks some r of them are free of differing bits; r is the least
    for which ``n`` random values make small groups.
    """
    masks: list[int] = []
    for r in range(1, 8):
        blocks = budget + r
        edges = [bits * k // blocks for k in range(blocks + 1)]
        parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, r)]
        if n >> min(m.bit_count() for m in masks) <= CHANCE_GROUP:
            break
    return masks


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins pairs in ``parent`` (labels, least member first); returns the pairs that joined something."""
    kept_a, kept_b = [], []
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        # one pair per larger label in a round: the one with the least partner
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        kept_a.append(a[first])
        kept_b.append(b[first])
        parent[hi[first]] = lo[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (a, b)


def trie_links(keys: np.ndarray, rest: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index pairs) between values of one key that differ in at most ``budget`` bits.

    ``keys`` is sorted, ``rest`` (uint64) ascending under each key: a trie node is a range
    of rows with a common prefix. The walk takes node pairs (A, B, depth, differing bits),
    splits both at the next bit and keeps the pairs of children within the budget. Pairs of
    small nodes are compared row by row; nodes that already hang together are left.
    """
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    stops = np.append(starts[1:], n)
    big = stops - starts > 1
    parent = np.arange(n)
    link_a, link_b = [], []
    stack = [(starts[big], stops[big], starts[big], stops[big], np.zeros(big.sum(), np.int64), np.zeros(big.sum(), np.int64))]

    def split(lo, hi, bit):
        """First row of [lo, hi) in which ``bit`` is set; the rows above it agree on all higher bits."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            one = (rest[mid] >> bit[open_]) & np.uint64(1) == 1
            hi[open_] = np.where(one, mid, hi[open_])
            lo[open_] = np.where(one, lo[open_], mid + 1)

    while stack:
        a0, a1, b0, b1, depth, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append(tuple(x[:half] for x in (a0, a1, b0, b1, depth, diff)))
            stack.append(tuple(x[half:] for x in (a0, a1, b0, b1, depth, diff)))
            continue
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= 16) | (depth >= BITS)
        if leaf.any():
            la0, lb0, wa, wb = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf]
            count = wa * wb
            which = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            i, j = la0[which] + at // wb[which], lb0[which] + at % wb[which]
            near = (i < j) & (np.bitwise_count(rest[i] ^ rest[j]) <= budget)
            ka, kb = _union(parent, i[near], j[near])
            link_a.append(ka)
            link_b.append(kb)
        a0, a1, b0, b1, depth, diff = (x[~leaf] for x in (a0, a1, b0, b1, depth, diff))
        if not len(a0):
            continue
        # pairs of nodes that are one component already have nothing to add
        least = lambda lo, hi: (parent[lo] == parent[hi - 1]) & (hi - lo == 1)
        done = least(a0, a1) & least(b0, b1) & (parent[a0] == parent[b0])
        a0, a1, b0, b1, depth, diff = (x[~done] for x in (a0, a1, b0, b1, depth, diff))
        bit = (BITS - 1 - depth).astype(np.uint64)
        am, bm = split(a0, a1, bit), split(b0, b1, bit)
        same = a0 == b0
        kids = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am, a1, b0, bm, diff + 1)]
        made = []
        for k, (p0, p1, q0, q1, d) in enumerate(kids):
            keep = (p0 < p1) & (q0 < q1) & (d <= budget)
            if k == 3:
                keep &= ~same  # of a node with itself, the mixed pair counts once
            if k < 2:
                keep &= ~(same & (p1 - p0 < 2))
            made.append(tuple(x[keep] for x in (p0, p1, q0, q1, depth + 1, d)))
        stack.append(tuple(np.concatenate(x) for x in zip(*made)))
    if not link_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(link_a), np.concatenate(link_b)


def near_links(distinct: DataFrame, budget: int, n: int) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that keep their components."""
    masks = block_masks(n, budget)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in signed))).alias("choice", "mask")).select(
        F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "choice", "fp")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            keys = pdf.groupby(["choice", "part"], sort=False).ngroup().to_numpy()
            order = np.lexsort((fps, keys))
            a, b = trie_links(keys[order], fps[order], budget)
            mine = pdf["fp"].to_numpy()[order]
            return pd.DataFrame({"a": mine[a], "b": mine[b]})

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < BATCH:
                continue
            last = held.iloc[-1]
            cut = int(((held["choice"] != last["choice"]) | (held["part"] != last["part"])).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if cut:
                yield links(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return keyed.repartition("choice", "part").sortWithinPartitions("choice", "part").mapInPandas(walk, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row."""
    prints = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(classes, budget, classes.count())
    member = connected_components(links)
    joined = classes.join(member, classes["fp"] == member["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rows_kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` of the ids ``found``, one per id (that of least hash over all columns), and those without an id."""
    kept = docs.join(found, "doc_id", "left_semi").select(*docs.columns)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").limit(1).count():
        rank = free_name(docs, "rank")
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
        kept = kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
    return kept.unionByName(docs.filter("doc_id is null"))


def keep_one(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; of rows that share that id, one.

    Rows without an id have no place in that order and stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), words, budget).filter("doc_id = component_id").select("doc_id").distinct()
    return rows_kept(docs, found)
