"""What the operators on embeddings share: which rows take part, and equal vectors as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~odd & some, F.lit(False))


def digests(vector: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a vector in joins."""
    return [F.xxhash64(vector).alias("_h1"), F.xxhash64(F.lit(20), vector).alias("_h2")]


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of equally long, complete vectors as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
