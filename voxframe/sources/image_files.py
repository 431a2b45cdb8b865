"""Binary images as NRRD and MetaImage files (u8, 255 solid, i fastest)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_bytes(image: DataFrame, voxel: float, kind: str = "nrrd") -> DataFrame:
    """sample_id, content (nrrd: header and data) or header and content (mhd).

    Images are packed by k-slab, a slab in one numpy step; the slabs of a file are joined once, in order. A file is a row.
    """
    slab = image.groupBy("sample_id", "k").agg(F.collect_list(F.struct("i", "j", "solid")).alias("v"))
    size = image.groupBy("sample_id").agg(*((F.max(c) + 1).alias(f"n{c}") for c in "ijk"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, solid, ni, nj in zip(*(batch[c] for c in ("i", "j", "solid")), batch["ni"].to_pylist(), batch["nj"].to_pylist()):
                plane = np.zeros((nj, ni), np.uint8)
                plane[j.values.to_numpy(), i.values.to_numpy()] = np.where(solid.values.to_numpy(zero_copy_only=False), 255, 0)
                out.append(plane.tobytes())
            yield pa.RecordBatch.from_arrays([batch["sample_id"], batch["k"], pa.array(out, pa.binary())], names=["sample_id", "k", "slab"])

    def join_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"".join(x.as_py() for x in slabs.values) for slabs in batch["slabs"]]
            yield pa.RecordBatch.from_arrays([batch["sample_id"], pa.array(data, pa.binary())], names=["sample_id", "data"])

    flat = slab.join(size, "sample_id").select(F.col("sample_id").cast("long"), F.col("k").cast("int"), *(F.col(f"v.{c}").alias(c) for c in ("i", "j", "solid")), "ni", "nj")
    slabs = flat.mapInArrow(pack, "sample_id long, k int, slab binary")
    whole = slabs.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("k", "slab"))).alias("s")).select("sample_id", F.col("s.slab").alias("slabs")).mapInArrow(
        join_slabs, "sample_id long, data binary")
    dims = F.concat_ws(" ", "ni", "nj", "nk")
    nrrd = F.concat(F.lit("NRRD0004\ntype: uint8\ndimension: 3\nsizes: "), dims, F.lit(f"\nspacings: {voxel:g} {voxel:g} {voxel:g}\nencoding: raw\n\n"))
    mhd = F.concat(F.lit("ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nOffset = 0 0 0\nElementSpacing = " + f"{voxel:g} {voxel:g} {voxel:g}\nDimSize = "), dims,
                   F.lit("\nElementType = MET_UCHAR\nElementDataFile = "), F.col("sample_id").cast("string"), F.lit(".raw\n"))
    joined = whole.join(size, "sample_id")
    if kind == "nrrd":
        return joined.select("sample_id", F.concat(F.encode(nrrd, "UTF-8"), "data").alias("content"))
    return joined.select("sample_id", F.encode(mhd, "UTF-8").alias("header"), F.col("data").alias("content"))
