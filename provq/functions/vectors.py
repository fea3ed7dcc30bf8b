"""Column expressions over vectors and key points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def is_vector(v: Column, dim: int) -> Column:
    """True for arrays of ``dim`` finite elements that are not all zero."""
    return F.coalesce((F.size(v) == dim) & all_finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def unit(v: Column) -> Column:
    """An array of doubles scaled to length 1."""
    # the length stands in an array of one, or it would be computed anew for each element
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n))[0]


def l1_root(v: Column) -> Column:
    """Square roots of the elements after scaling them to sum 1 (root-transformed histogram descriptors)."""
    total = F.aggregate(v, F.lit(0.0), lambda t, x: t + F.abs(x))
    return F.transform(v, lambda x: F.sqrt(F.abs(x) / total))


def unit_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of unit vectors, to nine places, so that every engine orders it alike."""
    return F.greatest(F.lit(0.0), F.round(2 - 2 * dot(a, b), 9))


def bin_size(width: Column, height: Column, divisor: float, power: float) -> Column:
    """Side of a voting bin for an image: (longest side / divisor) ^ power, cut to a whole number from 5 to 250."""
    return F.least(F.greatest(F.pow(F.greatest(width, height) / divisor, F.lit(power)).cast("int"), F.lit(5)), F.lit(250))


def grid_bin(v: Column, size: Column) -> Column:
    """The bin that truncation gives, one lower for negative values (so -size falls into bin -2)."""
    return (v / size).cast("bigint") - F.when(v < 0, 1).otherwise(0)
