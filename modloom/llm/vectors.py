"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: Column) -> Column:
    """True for a vector of finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & some, F.lit(False))


def vector_key(vector: Column) -> Column:
    """128 bits that name a vector's components."""
    two = [F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.lit("second"), vector))]
    return F.concat(*(F.lpad(x, 16, "0") for x in two))


def component_type(df: DataFrame, column: str) -> str:
    """The numpy type that holds the components exactly."""
    return "<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8"


def matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the unit vector farthest from those before it; fewer if none is apart."""
    chosen, nearest, at = [], np.full(len(sample), np.inf), 0
    while len(chosen) < min(count, len(sample)) and nearest[at] > 1e-6:
        chosen.append(at)
        nearest = np.minimum(nearest, distances(sample, sample[at : at + 1])[:, 0])
        at = int(np.argmax(nearest))
    return sample[chosen]
