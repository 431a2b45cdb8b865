"""Hard negatives by exact integer products of anchor and candidate tiles.

Vectors become integers, floor(256 x), and a score is an inner product of integers, so
every result is exact. Anchors are dealt into blocks; a block meets all candidates in one
or more streams. A stream holds its anchors, takes the candidates tile by tile, multiplies
each tile by Strassen's recursion over int64 (odd sides padded with zeros, seven products
and additions only, which are exact), and keeps heaps of bounded size per anchor, which the
streams of a block merge at the end. Two passes: the first keeps each anchor's best rows of
its own label, the second, for each of these, the best rows of other labels within a window
of scores below it. Neither makes a row per pair, nor does any memory grow with the table.

Work is anchors x rows by contract. Candidates are copied once per anchor block; where there
are fewer blocks than tasks, blocks meet the candidates in several streams.

Defined cases: rows whose label, vector, component or id is null, or with a component that
is not finite, take no part. Vectors of different lengths are padded with zeros, empty ones
score 0. Ties go to the smaller id; repeated rows are rows of their own, so a candidate may
appear twice; rows of the anchor's own id are the anchor and never its positives or
negatives. An anchor without positives, and a positive without a negative in its window,
give no rows. Integers of more than 2^20 in size (components of 4096 and more), or vectors
of more than 2^16 components, end in an error, since a long might not hold their scores.
Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Anchors of a block, candidates of a tile, and the side from which a product is split no further.
BLOCK_ANCHORS, TILE_ROWS, LEAF = 2048, 1024, 128
#: Candidates that a stream takes at least, before a block is given a further one.
STREAM_ROWS = 4096
LARGEST = 1 << 20
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two matrices by Strassen's recursion; sides up to ``leaf`` are multiplied outright.

    Zero rows and columns make odd sides even. All steps are sums and products modulo 2^64, so the result is
    exact whenever it fits into a long, whatever lies between.
    """
    (m, k), n = a.shape, b.shape[1]
    if max(m, n) <= leaf or min(m, k, n) <= 16:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1, m2, m3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    m4, m5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    m6, m7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * p, 2 * r), np.int64)
    c[:p, :r], c[:p, r:] = m1 + m4 - m5 + m7, m3 + m5
    c[p:, :r], c[p:, r:] = m2 + m4, m1 - m2 + m3 + m6
    return c[:m, :n]


def best_of(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``count`` largest of each row, NONE where there are fewer; columns ascend by id, so ties go to the smaller."""
    top, who = np.full((len(scores), count), NONE), np.full((len(scores), count), NONE)
    rows = np.arange(len(scores))
    for k in range(min(count, scores.shape[1])):
        at = scores.argmax(axis=1)
        top[:, k], who[:, k] = scores[rows, at], np.where(scores[rows, at] == NONE, NONE, ids[at])
        scores[rows, at] = NONE
    return top, who


class Heaps:
    """The ``count`` best (score, id) of each of ``n`` owners; tiles are merged in as they come."""

    def __init__(self, n: int, count: int) -> None:
        self.score, self.who = np.full((n, count), NONE), np.full((n, count), NONE)

    def merge(self, score: np.ndarray, who: np.ndarray) -> None:
        both, names = np.concatenate([self.score, score], axis=1), np.concatenate([self.who, who], axis=1)
        # largest score first, then smallest id: NONE scores sort last as the others' negations are larger than none of theirs
        order = np.lexsort((names, np.where(both == NONE, np.iinfo(np.int64).max, -both)), axis=1)[:, :self.score.shape[1]]
        self.score, self.who = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows that take part."""
    x = F.col("_v")
    usable = F.forall("_v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(e * 256.0))
    safe = F.when(F.forall("_v", lambda e: F.abs(e) < LARGEST / 256.0) & (F.size("_v") <= 1 << 16), whole).otherwise(
        F.raise_error(F.lit("a component or a vector is too large for scores in a long")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("_v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(usable).select("vec_id", "label", safe.alias("q"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of an int64 matrix, padded with zeros to ``width``."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0]:offsets[-1]]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], tile_rows: int) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Runs of rows of one (block, stream) and one side, at most ``tile_rows``."""
    for batch in batches:
        block, stream, side = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "stream", "side"))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(stream) != 0) | (np.diff(side) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(block)]):
            for at in range(low, high, tile_rows):
                yield (int(block[at]), int(stream[at])), int(side[at]), batch.slice(at, min(tile_rows, high - at))


SCHEMA = "anchor long, slot int, who long, score long"


def _run(keep: int, windows: tuple[int, int] | None, tile_rows: int):
    """The streams' work: best ``keep`` of the same label, or, by ``windows`` (of each positive), of other labels."""

    def flush(anchors: dict, heaps: list[Heaps]) -> pa.RecordBatch | None:
        parts = []
        for slot, heap in enumerate(heaps):
            row, col = np.nonzero(heap.score != NONE)
            parts.append((anchors["no"][row], np.full(len(row), slot, np.int32), heap.who[row, col], heap.score[row, col]))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "who", "score"]) if len(columns[0]) else None

    def meet(anchors: dict, heaps: list[Heaps], tile: pa.RecordBatch) -> None:
        q = matrix(tile["q"], anchors["q"].shape[1])
        if q.shape[1] > anchors["q"].shape[1]:
            anchors["q"] = np.pad(anchors["q"], ((0, 0), (0, q.shape[1] - anchors["q"].shape[1])))
        ids, labels = tile["id"].to_numpy(), tile["label"].to_numpy()
        order = np.argsort(ids, kind="stable")
        q, ids, labels = q[order], ids[order], labels[order]
        scores = strassen(anchors["q"], np.ascontiguousarray(q.T))
        own = anchors["id"][:, None] == ids[None, :]
        same = anchors["label"][:, None] == labels[None, :]
        if windows is None:
            scores[~same | own] = NONE
            heaps[0].merge(*best_of(scores, ids, keep))
            return
        scores[same | own] = NONE
        low, high = windows
        for slot, heap in enumerate(heaps):
            p = anchors["positive"][:, slot]
            # low * p <= 100 * score <= high * p; the fences of a missing positive let nothing through
            least = np.where(p == NONE, np.iinfo(np.int64).max, -(-low * np.where(p == NONE, 0, p) // 100))
            most = np.where(p == NONE, NONE, high * np.where(p == NONE, 0, p) // 100)
            fits = (scores >= least[:, None]) & (scores <= most[:, None])
            rows = np.flatnonzero(fits.any(axis=1))
            if len(rows):
                top, who = np.full((len(p), keep), NONE), np.full((len(p), keep), NONE)
                top[rows], who[rows] = best_of(np.where(fits[rows], scores[rows], NONE), ids, keep)
                heap.merge(top, who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, heaps, waiting = None, {}, [], []
        for now, side, tile in _tiles(batches, tile_rows):
            if now != key or (side == 0 and not waiting):
                if anchors and (out := flush(anchors, heaps)):
                    yield out
                key, anchors, heaps, waiting = now, {}, [], []
            if side == 0:
                waiting.append(tile)
                continue
            if waiting:
                table = pa.Table.from_batches(waiting).combine_chunks()
                anchors = {"no": table["no"].to_numpy(), "id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "q": matrix(table["q"].combine_chunks(), 0)}
                slots = 1
                if windows is not None:
                    lists = table["positives"].to_pylist()
                    slots = max(1, max(map(len, lists)))
                    anchors["positive"] = np.array([[*x, *[NONE] * (slots - len(x))] for x in lists], np.int64)
                heaps, waiting = [Heaps(len(anchors["no"]), keep) for _ in range(slots)], []
            if anchors:
                meet(anchors, heaps, tile)
        if anchors and (out := flush(anchors, heaps)):
            yield out

    return run


def _pass(anchors: DataFrame, rows: DataFrame, blocks: int, streams: int, keep: int, windows: tuple[int, int] | None, tile_rows: int) -> DataFrame:
    """anchor, slot, rank, who, score: the merged heaps of all streams."""
    left = anchors.withColumn("stream", F.explode(F.sequence(F.lit(0), F.lit(streams - 1)))).select(
        "block", "stream", F.lit(0).alias("side"), "no", F.col("vec_id").alias("id"), "label", "q", "positives")
    right = rows.withColumn("stream", F.pmod(F.monotonically_increasing_id(), F.lit(streams)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "block", "stream", F.lit(1).alias("side"), F.lit(None).cast("long").alias("no"), F.col("vec_id").alias("id"), "label", "q", F.lit(None).cast("array<long>").alias("positives"))
    met = left.unionByName(right).repartition("block", "stream").sortWithinPartitions("block", "stream", "side").mapInArrow(_run(keep, windows, tile_rows), SCHEMA)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "who")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
         block_anchors: int = BLOCK_ANCHORS, stream_rows: int = STREAM_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, q (``quantised``). A negative's score lies between the two hundredths of ``window`` of
    the positive's, so that ``low x positive <= 100 x negative <= high x positive``.
    """
    kept = materialize(rows, "vectors")
    n, n_anchors = kept.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(1, -(-n_anchors // block_anchors))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = max(1, min(-(-tasks // blocks), -(-n // stream_rows)))
    chosen = materialize(kept.filter(is_anchor).withColumn("no", F.monotonically_increasing_id()).withColumn("block", F.pmod("no", F.lit(blocks)).cast("int")), "anchors")
    nothing = F.lit(None).cast("array<long>")
    best = materialize(_pass(chosen.withColumn("positives", nothing), kept, blocks, streams, positives, None, tile_rows).select(
        F.col("anchor").alias("no"), F.col("rank").alias("positive_rank"), F.col("who").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = best.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    found = _pass(chosen.join(lists, "no"), kept, blocks, streams, negatives, window, tile_rows).select(
        F.col("anchor").alias("no"), (F.col("slot") + 1).alias("positive_rank"), "rank", F.col("who").alias("negative_id"), F.col("score").alias("negative_score"))
    out = materialize(found.join(best, ["no", "positive_rank"]).join(chosen.select("no", F.col("vec_id").alias("anchor_id")), "no").select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(kept, chosen, best)
    return out
