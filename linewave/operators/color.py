"""Change of the colour basis by two chosen colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewave.sources.images import CHANNELS

Vector = tuple[float, float, float]


def orthonormal_basis(first: Vector, second: Vector) -> tuple[Vector, Vector, Vector]:
    """Unit vector of ``first``, of what is left of ``second`` beside it, and of their cross product.

    Black or parallel colours span no plane and raise an error.
    """
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def unit(v: Vector, scale: float) -> Vector:
        size = math.sqrt(dot(v, v))
        if size <= 1e-9 * scale:
            raise ValueError("the two colours must be neither black nor parallel")
        return (v[0] / size, v[1] / size, v[2] / size)

    first, second = tuple(map(float, first)), tuple(map(float, second))
    a = unit(first, 1.0)
    along = dot(second, a)
    b = unit((second[0] - along * a[0], second[1] - along * a[1], second[2] - along * a[2]), max(1.0, math.sqrt(dot(second, second))))
    return a, b, unit((a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]), 1.0)


def basis_of(first: Column, second: Column) -> Column:
    """:func:`orthonormal_basis` of two colour columns (arrays of three): an array of three vectors; null where a colour is null."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    given = [[F.get(c, F.lit(i)).cast("double") for i in range(3)] for c in (first, second)]
    message = F.lit("the two colours must be neither black nor parallel")

    def with_unit(v: list[Column], scale: Column, then) -> Column:  # the unit vector as a bound value, worked out once
        size = F.sqrt(dot(v, v))
        unit = F.when(size > 1e-9 * scale, F.array(*(x / size for x in v))).when(size.isNull(), F.lit(None)).otherwise(F.raise_error(message).cast("array<double>"))
        return F.get(F.transform(F.array(unit), then), F.lit(0))

    def after_first(a: Column) -> Column:
        along = dot(given[1], a)
        rest = [given[1][i] - along * a[i] for i in range(3)]
        return with_unit(rest, F.greatest(F.lit(1.0), F.sqrt(dot(given[1], given[1]))), lambda b: after_second(a, b))

    def after_second(a: Column, b: Column) -> Column:
        return with_unit([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]], F.lit(1.0), lambda c: F.array(a, b, c))

    return F.when(first.isNotNull() & second.isNotNull(), with_unit(given[0], F.lit(1.0), after_first))


def basis_weights(basis: Column) -> Column:
    """The basis as rows (channel, axis, weight), to be exploded."""
    return F.array(*(F.struct(F.lit(i).alias("channel"), F.lit(j).alias("axis"), basis[j][i].alias("weight")) for i in range(3) for j in range(3)))


def in_basis(rows: DataFrame, basis: str) -> DataFrame:
    """``rows`` with each row's channels in the basis of its column ``basis``; rows of a null basis stay as they are."""
    b, old = F.col(basis), F.arrays_zip(*CHANNELS)
    new = lambda i: F.transform(old, lambda p: p["r"] * b[0][i] + p["g"] * b[1][i] + p["b"] * b[2][i])
    return rows.withColumns({c: F.when(b.isNull(), F.col(c)).otherwise(new(i)) for i, c in enumerate(CHANNELS)})


def change_basis(rows: DataFrame, first: Vector, second: Vector) -> DataFrame:
    """``rows`` whose channel i is sum_j P[i][j] * old channel j, the basis vectors being P's columns."""
    basis = orthonormal_basis(first, second)
    old = F.arrays_zip(*CHANNELS)
    new = lambda i: F.transform(old, lambda p: p["r"] * basis[0][i] + p["g"] * basis[1][i] + p["b"] * basis[2][i])
    return rows.select("image_id", "y", *(new(i).alias(c) for i, c in enumerate(CHANNELS)))


def basis_applied(rows: DataFrame, original: DataFrame) -> DataFrame:
    """(image_id, applied): whether any channel differs from the original image's."""
    other = original.select("image_id", "y", *(F.col(c).alias(f"{c}0") for c in CHANNELS))
    differs = ~(F.col("r").eqNullSafe(F.col("r0")) & F.col("g").eqNullSafe(F.col("g0")) & F.col("b").eqNullSafe(F.col("b0")))
    return rows.join(other, ["image_id", "y"], "full").groupBy("image_id").agg(F.max(differs).alias("applied"))
