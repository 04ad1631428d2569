"""Vectors as integers: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import named

#: Scaled components must stay within this, so that sums of squares and products fit 64 bits.
MOST = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def scaled(vector: Column, scale: int) -> Column:
    """Components floor(scale * x) as integers; one beyond ``MOST`` is an error, not a wrong result."""
    far = F.exists(vector, lambda x: F.abs(x * scale) > MOST)
    return F.when(far, F.raise_error(F.lit(f"a scaled component lies beyond {MOST}"))).otherwise(F.transform(vector, lambda x: F.floor(x * scale).cast("int")))


def integer_rows(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows with a usable vector; other columns are pruned from the scan."""
    found = rows.select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("v"))
    return found.where(usable(F.col("v"))).withColumn("v", scaled(F.col("v"), scale))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of one length as rows of 64-bit floats, exact for components within ``MOST``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def bytes_rows(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:]))
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def rows_bytes(column: pa.Array, dtype: type, *shape: int) -> np.ndarray:
    """The inverse of ``bytes_rows``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)
