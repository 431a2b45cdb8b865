"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters rows over buckets by a seeded hash; the bucket count follows
the bytes of the table, so a bucket fits into a task's memory. Pass two shuffles
each bucket by Fisher-Yates, seeded by (seed, bucket) from the order of (id,
text, other columns). Buckets one after another form a global permutation, which is cut into
shards of rows at most one apart. Their first places come from a prefix sum in two
levels, over groups of buckets and within a group.

Null texts have no bytes. Null and repeated ids are rows like any other; rows that
agree in all columns share a bucket. Fewer rows than shards leave shards empty, and an
empty table gives an empty result. Extra columns travel with their row; columns named
shard or slot are replaced.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 48
#: Buckets whose first places are summed together.
GROUP = 4096


def fisher_yates(n: int, seed: str) -> list[int]:
    """A permutation of 0..n-1, the same for the same seed on any machine."""
    draw, order = random.Random(seed).random, list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with shard (int) and slot (long, gapless from 0 in each shard)."""
    rows = docs.drop("shard", "slot")
    bucket, start, group, mark = (free_name(rows, n) for n in ("bucket", "start", "group", "mark"))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long")).alias("b"), F.count("*").alias("n")).first()
    buckets = max(LEAST_BUCKETS, -(-(total["b"] or 0) // bucket_bytes))
    n = total["n"]
    scattered = rows.withColumn(mark, F.xxhash64(F.lit(seed), *rows.columns)).withColumn(bucket, F.pmod(mark, F.lit(buckets)))
    counts = scattered.groupBy(bucket).agg(F.count("*").alias("n")).withColumn(group, F.floor(F.col(bucket) / GROUP))
    before = counts.groupBy(group).agg(F.sum("n").alias("m")).withColumn("m", F.sum("m").over(Window.orderBy(group)) - F.col("m"))
    within = counts.withColumn("k", F.sum("n").over(Window.partitionBy(group).orderBy(bucket)) - F.col("n"))
    offsets = within.join(before, group).select(bucket, (F.col("k") + F.col("m")).alias(start))

    def shuffle(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(id_col, "ascending"), (text_col, "ascending"), (mark, "ascending")], null_placement="at_end").to_numpy()
        turn = order[fisher_yates(len(table), f"{seed}/{table[bucket][0].as_py()}")]
        at = table[start][0].as_py() + np.arange(len(table))
        shard = at * shards // n
        return table.take(pa.array(turn)).drop_columns([bucket, start, mark]).append_column("shard", pa.array(shard, pa.int32())).append_column(
            "slot", pa.array(at - (shard * n + shards - 1) // shards, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", shard int, slot long"
    # as many tasks as buckets, so that a task's share does not grow with the table
    return scattered.repartition(buckets, bucket).join(offsets, bucket).groupBy(bucket).applyInArrow(shuffle, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; files of a shard follow one another in slot order, however large it is."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
