"""Vectors as both searches take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id bigint, v array<double>): one row for each id, without null ids, null or empty
    vectors, vectors with null or non-finite components and, unless ``zero``, zero vectors.
    Of different vectors under one id the smallest counts."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    out = out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
    if not zero:
        out = out.where(F.exists("v", lambda x: x != 0.0))
    return out.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length) as a matrix."""
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
