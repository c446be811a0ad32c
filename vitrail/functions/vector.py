"""Vectors as ``array<float>``; sums are taken in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1.1920929e-07  # fixed value: the smallest step of a 32-bit float above 1


def dot(a: Column, b: Column) -> Column:
    """Null if either is null; arrays of unequal length give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def literal(values: list[float]) -> Column:
    """A known vector as a constant array."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<float>")


def dot_literal(a: Column, query: list[float]) -> Column:
    """The dot product with a known vector.

    A flat sum of 64 products makes a method that is too long to be compiled: on 400,000 rows it took 6.3 s, the fold over both arrays 0.5 s.
    """
    return dot(a, F.array(*[F.lit(float(x)) for x in query]))


def unit_cosine(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors within [-1, 1], null if either is null; empty, unequal or not finite vectors raise an error when the row is read."""
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & all_finite(a) & all_finite(b)
    cosine = F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(fine, cosine).otherwise(F.raise_error("vectors must be finite, not empty and of equal length").cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalise(a: Column) -> Column:
    """Scaled to length 1; a vector of hardly any length stays as it is."""
    n = norm(a)
    return F.when(n <= EPSILON, a).otherwise(F.transform(a, lambda x: (x / n).cast("float")))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def strict_normalise(a: Column, dimension: int) -> Column:
    """struct(vector, error): scaled to length 1, or the reason why it can't be."""
    n = norm(a)
    error = (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != dimension, "dimension")
        .when(~all_finite(a), "not finite")
        .when(n <= EPSILON, "zero")
    )
    return F.struct(F.when(error.isNull(), F.transform(a, lambda x: (x / n).cast("float"))).alias("vector"), error.alias("error"))


def cosine_to_unit_query(query: Column, candidate: Column, candidate_is_unit: Column) -> Column:
    """Cosine to a unit query: -1 for another length or a zero candidate, null if either is null."""
    d, n = dot(query, candidate), norm(candidate)
    other_length = (F.size(query) != F.size(candidate)) | (F.size(query) == 0)
    cosine = F.when(other_length, F.lit(-1.0)).when(candidate_is_unit, d).when(n * n <= EPSILON, F.lit(-1.0)).otherwise(d / n)
    return F.when(query.isNotNull() & candidate.isNotNull(), cosine)


def is_unit(a: Column, tolerance: float = 1e-3) -> Column:
    """Present, not empty, finite and of length 1 within the tolerance."""
    return F.coalesce((F.size(a) > 0) & all_finite(a) & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def valid_dimension(n_bytes: Column, dimension: Column) -> Column:
    """No bytes go with dimension 0, n floats with 4n bytes."""
    return F.when(n_bytes.isNull(), dimension == 0).otherwise((dimension > 0) & (n_bytes == dimension.cast("bigint") * 4))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(data: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary column; null for null or a broken length."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_or_fail(data: Column, dimension: Column) -> Column:
    """Decoded floats of one stored vector, null for null; a number of bytes that doesn't fit ``dimension`` raises an error when the row is read."""
    broken = data.isNotNull() & ~F.coalesce(valid_dimension(F.octet_length(data), dimension), F.lit(False))
    return F.when(broken, F.raise_error("the stored vector is corrupt").cast("array<float>")).otherwise(decode_floats(data))


def decode_checked(data: Column, dimension: Column, strict: bool = False) -> Column:
    """Decoded floats, null if their number isn't ``dimension``; dimension 0 isn't checked unless ``strict``."""
    values = decode_floats(data)
    fits = F.size(values) == dimension
    return F.when(fits if strict else fits | (dimension == 0), values)
