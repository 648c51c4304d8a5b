"""Integer vectors in double precision: what mining and compression of vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles hold every integer below this one.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """True where a vector is there and each component a finite number; an empty vector is."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad


def float_vector(df: DataFrame, column: str) -> Column:
    """The column as an array of floats or doubles; Spark converts arrays of other numbers."""
    kind = "float" if "float" in dict(df.dtypes)[column] else "double"
    return F.col(f"`{column}`").cast(f"array<{kind}>")


def whole_parts(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * component) as doubles, a row for each vector; zeros follow a vector shorter than ``width``, and what lies beyond
    ``width`` is left out."""
    flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return np.floor(flat.reshape(len(lengths), width) * scale)
    out, ends = np.zeros((len(lengths), width)), np.cumsum(lengths)
    for i, (lo, hi) in enumerate(zip(ends - lengths, ends)):
        own = flat[lo : min(hi, lo + width)]
        out[i, : len(own)] = np.floor(own * scale)
    return out


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def check_exact(bound: float) -> None:
    """Sums of products that might pass 2**53 would be rounded: an error instead of a wrong rank."""
    if bound >= EXACT:
        raise ValueError(f"integer parts of these vectors give sums of up to {bound:.3g}; they are exact below 2**53 only")
