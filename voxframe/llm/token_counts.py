"""Document boundaries and token counts of flat token files without an index.

A flat file is ids one after another, each document followed by a separator id.
It is stored as blocks of a fixed number of bytes that know nothing of documents:
``write_flat`` makes such a table, ``read_flat`` gives one for raw files. The scan
compares each block with the separator at once (numpy) and reads it once. What a block
leaves unfinished is stitched by a prefix scan over one row of three numbers per
block: separators before it give the ordinals, tokens since the last separator the
carry. The places found stay in the rows of their blocks.

Null and empty texts are documents of no tokens. Null and repeated ids are documents
like any other. Ids after the last separator of a file are reported as an unfinished
document (``ended`` false). An empty table gives no rows; extra columns play no part. Ids that equal the separator inside a text would split it, so the
writer refuses the separator's own string as special and encodes it as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import bpe, default_vocabulary, slices

SEPARATOR = 50256
BLOCK_BYTES = 1 << 18


def write_flat(docs: DataFrame, vocabulary: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (file string, block int, data binary) of the flat files, one file per task attempt,
    and for each document its name in order: rows (file, doc_ids array) with data null.

    Store the result before use: a recomputed task writes the same ids to a new file name.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([separator], dtype).tobytes()

    names = ("file", "block", "data", "first_ordinal", "doc_ids")
    schema = pa.schema(zip(names, (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block, rest, first = bpe(vocabulary), uuid.uuid4().hex, 0, b"", 0
        for batch in batches:
            for part in slices(list(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())), 256):
                ids = encoder.encode_batch([t or "" for _, t in part], special=False)
                stream = rest + b"".join([np.frombuffer(x, "<u4").astype(dtype).tobytes() + end for x in ids])
                full = len(stream) // block_bytes
                rows = [(file, block + k, stream[k * block_bytes:(k + 1) * block_bytes], None, None) for k in range(full)]
                rest, block = stream[full * block_bytes:], block + full
                rows.append((file, None, None, first, [d for d, _ in part]))
                first += len(part)
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema)
        if rest:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip((file, block, rest, None, None)))), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "file string, block int, data binary, first_ordinal long, doc_ids array<long>")


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of raw flat files, by Spark's binary reader, which refuses files of more than 2 GB; larger
    corpora come as several files."""
    raw = spark.read.format("binaryFile").load(path)
    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / block_bytes).cast("int") - 1))
    return raw.filter("length > 0").select(F.col("path").alias("file"), blocks.alias("block"), "content").select(
        "file", "block", F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("data"))


def scan_separators(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """One row per document of the files: file, ordinal, start (token index in the file), n_tokens, ended."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.frombuffer(x, dtype) for x in pdf["data"]]
            ends = [np.flatnonzero(x == separator) for x in ids]
            yield pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "n": [len(x) for x in ids], "ends": ends})

    found = materialize(blocks.select("file", "block", "data").mapInPandas(scan, "file string, block int, n int, ends array<int>"), "separators")
    summary = found.select("file", "block", F.col("n").cast("long").alias("n"), F.size("ends").cast("long").alias("many"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = summary.withColumn("first", F.coalesce(F.sum("n").over(earlier), zero)).select(
        "file", "block", "first", F.coalesce(F.sum("many").over(earlier), zero).alias("ordinal0"),
        F.coalesce(F.last(F.col("first") + F.col("last"), ignorenulls=True).over(earlier) + 1, zero).alias("open_from"),
        F.lead("block").over(order).isNull().alias("is_last"))
    # the end of a file closes what is open there, as one more place behind the separators
    places = F.when(F.col("is_last"), F.concat("ends", F.array("n"))).otherwise(F.col("ends"))
    each = found.join(carried, ["file", "block"]).select("file", "ordinal0", "first", "open_from", "ends", F.posexplode(places).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("first") + F.get("ends", F.col("k") - 1) + 1)
    return each.select(
        "file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), start.alias("start"),
        (F.col("first") + F.col("end") - start).alias("n_tokens"), (F.col("k") < F.size("ends")).alias("ended")).filter("ended or n_tokens > 0")


def document_names(flat: DataFrame) -> DataFrame:
    """file, ordinal, doc_id from the name rows of ``write_flat``."""
    return flat.filter("data is null").select("file", "first_ordinal", F.posexplode("doc_ids").alias("k", "doc_id")).select(
        "file", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), "doc_id")
