"""Stored intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Spark's setting by which the shuffle files of a query are deleted once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="voxframe-")
    return _LOCAL[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the scratch root and read it back.

    Cuts lineage with a durable copy that all executors can read: a lost executor costs
    only its own tasks, and a table used twice is computed once. Spark deletes the shuffle
    files behind the copy when it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/voxframe/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that Spark must not broadcast.

    For Spark a table that an explode has multiplied is as large as it was before, and a stored one as large as its packed
    files; such a side would pass through the driver.
    """
    return df.hint("merge")


def discard(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing will read them again."""
    for df in stored:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
