"""Packing token pieces into fixed windows by minimum bin slack.

Every document becomes its ids followed by ``separator``; ids beyond whole
windows form one remainder piece. Only the histogram of piece lengths (at most
``capacity`` rows) decides the plan: a bitset subset-sum picks, for the longest
length left, the multiset of other lengths that fills the window best, and the
pattern is repeated as long as the counts allow. Rows then find their place by
rank within their length, so no group or partition holds a whole length.

A length of more than RANKED_ROWS rows is ranked in parts; up to that one task ranks it.

Null or empty texts are the separator alone. Null or repeated ids are packed
like any row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_lists, materialize
from .tokens import bpe, default_vocabulary

CAPACITY = 1024
#: Rows of one length that one window task ranks, about.
RANKED_ROWS = 100_000


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None,
               with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids
    (little-endian unsigned 32-bit, binary)."""
    vocabulary = vocabulary or default_vocabulary()
    end = int(separator).to_bytes(4, "little")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def make():
        encoder = bpe(vocabulary)

        def step(part: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for doc, ids in zip(part["doc_id"], encoder.encode_batch([t or "" for t in part["text"]])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece)):
                        out[column].append(value)
            return out

        return step

    return map_lists(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths with the largest sum not over ``room``, by a bitset of reachable sums.

    Each length enters as bundles of 1, 2, 4, ... pieces, so a bundle is one shift
    of the bitset; the bitsets before each bundle give the counts on the way back.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces a window, first window, offset of the first)."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    rank, windows, rows = dict.fromkeys(counts, 0), 0, []
    while counts:
        longest = max(counts)
        pattern = best_fill({**counts, longest: counts[longest] - 1}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        offset = 0
        for x in sorted(pattern, reverse=True):
            n = pattern[x]
            rows.append((x, rank[x], rank[x] + n * times, n, windows, offset))
            rank[x] += n * times
            offset += n * x
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        windows += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, start, length, ... as ``cut_pieces`` gives).

    ``pieces`` is read twice (histogram, placement); pass a stored table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_windows(histogram, capacity), "length long, lo long, hi long, per long, first_window long, first_offset long")
    salts = spark.createDataFrame(
        [(k, max(1, -(-n // RANKED_ROWS))) for k, n in histogram.items()], "length long, n_salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("n_salts"))).drop("n_salts")
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n"))
    ranked = (
        salted.withColumn("rank", F.row_number().over(
            Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base"))
    place = (F.col("rank") - F.col("lo"))
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1))
        .withColumn("sequence_id", F.col("first_window") + F.floor(place / F.col("per")).cast("long"))
        .withColumn("offset", F.col("first_offset") + F.pmod(place, F.col("per")) * ranked["length"])
        .select(*[ranked[c] for c in pieces.columns], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **kw) -> DataFrame:
    """Pieces of all documents with their place; see the module for the rules."""
    return pack(materialize(cut_pieces(docs, capacity, **kw), "pieces"), capacity)
