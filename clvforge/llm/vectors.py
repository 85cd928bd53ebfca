"""Vectors as packed integers, and their exact inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all rows of ``b``, exact, or an error beyond 62 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and not -(1 << 62) < min(exact.flat) <= max(exact.flat) < 1 << 62:
        raise OverflowError("an inner product is beyond 62 bits; use a smaller scale")
    return exact.astype(np.int64)


def pack_vectors(rows: DataFrame, scale: int, vec_col: str = "v") -> DataFrame:
    """``rows`` with their vector as dim and vec: floor(scale * x) as little-endian 64-bit integers.

    Rows with a null in any column, or a vector with a null or non-finite component, go; a component
    whose integer is beyond 62 bits is an error.
    """
    keep = [c for c in rows.columns if c != vec_col]
    whole = rows.dropna("any").filter(
        ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(*keep, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(len(keep))
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(scale))
            if (np.abs(x) >= 2.0 ** 62).any():
                raise OverflowError("a scaled component is beyond 62 bits; use a smaller scale")
            n = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(n, dtype=np.int64) * 8)).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [
                None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.astype("<i8").tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(n), packed.cast(pa.binary())],
                                             names=[*keep, "dim", "vec"])

    schema = T.StructType([*[whole.schema[c] for c in keep], T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType())])
    return whole.mapInArrow(run, schema)
