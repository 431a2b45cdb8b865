"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import discard, materialize, scratch_root

__all__ = ["discard", "documents", "free_name", "map_lists", "materialize", "scratch_root"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if ``df`` has a column of that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_lists(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 256) -> DataFrame:
    """Rows made from rows in Arrow batches of at most ``rows``: columns come and go as Python lists.

    ``make`` runs once a task and gives the function. Unlike pandas columns, lists keep a long
    beside a null exact.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_pydict(step({n: part[n].to_pylist() for n in part.schema.names}), target)

    return df.mapInArrow(run, schema)
