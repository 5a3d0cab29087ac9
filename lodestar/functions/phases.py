"""Complex hypervectors: a symbol is an ``array<double>`` of angles, one unit complex number each.

Binding adds angles, unbinding subtracts them, so both are exact. A sum of vectors is no
longer of length 1 a component; it is ``struct<re: array<double>, im: array<double>>``.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(angle: Column) -> Column:
    """An angle in -pi (included) to pi."""
    return angle - 2 * pi * F.floor((angle + pi) / (2 * pi))


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: wrapped(x + y))


def unbind(a: Column, b: Column) -> Column:
    """Undoes ``bind`` by the same ``b``."""
    return F.zip_with(a, b, lambda x, y: wrapped(x - y))


def power(a: Column, n: int | Column) -> Column:
    """``a`` bound to itself: 0 gives the vector that binds to nothing, -1 the inverse."""
    return F.transform(a, lambda x: wrapped(x * n))


def random_phases(space: Column, name: Column, dimension: int) -> Column:
    """A symbol's angles from a hash of its space and name: the same in any order and place."""
    unit = lambda i: F.shiftrightunsigned(F.xxhash64(space, name, i), 11).cast("double") / float(1 << 53)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (unit(i) * 2 - 1) * pi)


def complex_of(a: Column) -> Column:
    """Angles as real and imaginary parts."""
    return F.struct(F.transform(a, F.cos).alias("re"), F.transform(a, F.sin).alias("im"))


def rotated(v: Column, a: Column, back: bool = False) -> Column:
    """A sum bound to angles, or with ``back`` unbound from them."""
    turn = -1 if back else 1
    pairs = F.zip_with(F.arrays_zip(v["re"].alias("re"), v["im"].alias("im")), a, lambda x, t: F.struct(
        (x["re"] * F.cos(t) - turn * x["im"] * F.sin(t)).alias("re"), (x["im"] * F.cos(t) + turn * x["re"] * F.sin(t)).alias("im")))
    return F.struct(F.transform(pairs, lambda p: p["re"]).alias("re"), F.transform(pairs, lambda p: p["im"]).alias("im"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(_dot(v["re"], v["re"]) + _dot(v["im"], v["im"]))


def similarity(a: Column, b: Column) -> Column:
    """The size of the complex cosine of two sums, in 0 to 1; null if one is zero."""
    real = _dot(a["re"], b["re"]) + _dot(a["im"], b["im"])
    imaginary = _dot(a["im"], b["re"]) - _dot(a["re"], b["im"])
    return F.try_divide(F.sqrt(real * real + imaginary * imaginary), length(a) * length(b))
