"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine similarity; null (or an error, if strict) for vectors of other lengths, empty, zero or not finite."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & value.isNotNull() & ~F.isnan(value)
    bad = F.raise_error(F.lit("vectors have no cosine")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(good, value).otherwise(bad)


def nearest_rank(values: Column, share: float | Column) -> Column:
    """Element at round(share * (n - 1)) of the sorted array, halves up."""
    at = F.round((F.lit(share) if not isinstance(share, Column) else share) * (F.size(values) - 1)).cast("int")
    return F.get(F.array_sort(values), at)


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of one length."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def packed(vector: Column) -> Column:
    """Little-endian single precision bytes, for stores that keep vectors so."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        v = v.cast(pa.large_list(pa.float32()))
        ends = np.asarray(v.offsets, np.int64) * 4
        valid = pa.array(np.asarray(v.is_valid()))
        raw = np.ascontiguousarray(v.values.fill_null(float("nan")).to_numpy(zero_copy_only=False), "<f4")
        whole = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(raw)])
        return pc.if_else(valid, whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return pack(vector)


def unpacked(data: Column) -> Column:
    """The reverse; a length that isn't a multiple of four is an error."""

    @F.arrow_udf("array<float>")
    def unpack(v: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.binary_length(v), 0), np.int64)
        if (size % 4).any():
            raise ValueError("bytes that are no single precision numbers")
        raw = b"".join(x.as_buffer().to_pybytes() for x in v if x.is_valid)
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size // 4)], pa.int64()), pa.array(np.frombuffer(raw, "<f4"), pa.float32()))
        return pc.if_else(v.is_valid(), lists, pa.scalar(None, lists.type)).cast(pa.list_(pa.float32()))

    return unpack(data)
