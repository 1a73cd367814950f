"""Axis-aligned boxes as two arrays (lo, hi): predicates and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrove.functions.vector import _c, _sum, distance


def side_lengths(lo, hi) -> Column:
    return F.zip_with(_c(hi), _c(lo), lambda h, l: h - l)


def diagonal(lo, hi) -> Column:
    return distance(hi, lo)


def longest_side(lo, hi) -> Column:
    return F.array_max(side_lengths(lo, hi))


def widest_dimension(lo, hi) -> Column:
    """0-based; the first of equally wide dimensions."""
    return (F.array_position(side_lengths(lo, hi), longest_side(lo, hi)) - 1).cast("int")


def contains(lo, hi, c) -> Column:
    inside = F.zip_with(F.arrays_zip(_c(lo).alias("l"), _c(hi).alias("h")), _c(c), lambda b, x: (x >= b["l"]) & (x <= b["h"]))
    return F.forall(inside, lambda x: x)


def relation(lo1, hi1, lo2, hi2) -> Column:
    """How box 1 meets box 2: 'exclude' (disjoint), 'include' (box 1 holds box 2) or 'overlap'."""
    apart = F.exists(F.zip_with(_c(lo1), _c(hi2), lambda x, y: x > y), lambda x: x) | F.exists(
        F.zip_with(_c(hi1), _c(lo2), lambda x, y: x < y), lambda x: x
    )
    holds = F.forall(F.zip_with(_c(lo1), _c(lo2), lambda x, y: x <= y), lambda x: x) & F.forall(
        F.zip_with(_c(hi1), _c(hi2), lambda x, y: x >= y), lambda x: x
    )
    return F.when(apart, "exclude").when(holds, "include").otherwise("overlap")


def min_distance(lo1, hi1, lo2, hi2) -> Column:
    gap = F.zip_with(
        F.zip_with(_c(lo1), _c(hi2), lambda x, y: x - y), F.zip_with(_c(lo2), _c(hi1), lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0))
    )
    return F.sqrt(_sum(F.transform(gap, lambda g: g * g)))


def far_distance(lo1, hi1, lo2, hi2) -> Column:
    """Diagonal of the box around both: an upper bound of any distance between them."""
    hi = F.zip_with(_c(hi1), _c(hi2), lambda x, y: F.greatest(x, y))
    lo = F.zip_with(_c(lo1), _c(lo2), lambda x, y: F.least(x, y))
    return distance(hi, lo)


def centre(lo, hi) -> Column:
    return F.zip_with(_c(lo), _c(hi), lambda x, y: (x + y) / 2.0)


def sphere_gap(lo1, hi1, lo2, hi2) -> Column:
    """Between the spheres around both boxes, each with its box's diagonal as diameter; negative if they meet."""
    return distance(centre(lo1, hi1), centre(lo2, hi2)) - diagonal(lo1, hi1) / 2.0 - diagonal(lo2, hi2) / 2.0


def well_separated(lo1, hi1, lo2, hi2, s: float = 2.0) -> Column:
    """The gap between the spheres around both boxes is at least s times the larger radius."""
    return sphere_gap(lo1, hi1, lo2, hi2) >= s * (F.greatest(diagonal(lo1, hi1), diagonal(lo2, hi2)) / 2.0)


def unreachable(lo1, hi1, cd_min1, cd_max1, lo2, hi2, cd_min2, cd_max2) -> Column:
    """Well separated, or separated in mutual reachability: the sphere gap or a least core distance is at least
    as large as both diagonals and both largest core distances."""
    gap = F.greatest(sphere_gap(lo1, hi1, lo2, hi2), _c(cd_min1), _c(cd_min2))
    inner = F.greatest(diagonal(lo1, hi1), diagonal(lo2, hi2), _c(cd_max1), _c(cd_max2))
    return well_separated(lo1, hi1, lo2, hi2) | (gap >= inner)
