"""Hypervector functions as column expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(a: Column, b: Column) -> Column:
    """Elementwise product."""
    return F.zip_with(a, b, lambda x, y: x * y)


def unbind(a: Column, b: Column, unit: bool = False) -> Column:
    """Inverse of ``bind`` for components other than 0; with ``unit``, of length 1."""
    found = F.zip_with(a, b, lambda x, y: F.try_divide(x, y))
    return normalize(found) if unit else found


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def permute(a: Column, n: int) -> Column:
    """Circular shift by ``n`` places to the right; ``permute(-n)`` undoes it."""
    size = F.size(a)
    shift = F.pmod(F.lit(n), F.greatest(size, F.lit(1)))
    return F.when(size == 0, a).otherwise(F.concat(F.slice(a, size - shift + 1, shift), F.slice(a, F.lit(1), size - shift)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    length = norm(a) + 1e-10
    return F.transform(a, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column, b: Column, bipolar: bool = False) -> Column:
    """Similarity in 0 to 1: the cosine's size, or for bipolar vectors (cosine + 1) / 2."""
    return (cosine(a, b) + 1) / 2 if bipolar else F.abs(cosine(a, b))


def random_bipolar(space: Column, name: Column, dimension: int) -> Column:
    """A symbol's vector of -1 and 1, from a hash of its space and name: the same in any order and place."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.when(F.xxhash64(space, name, i) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)),
    )
