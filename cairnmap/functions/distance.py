"""Distances between vectors, as column expressions over arrays of doubles.

For wide scans use ``operators.knn``, which computes l1 and l2 in blocks; these are for row-wise use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)


def angular(x: Column, y: Column) -> Column:
    """Angle between two directions in degrees, in [0, 180]."""
    d = F.pmod(F.abs(x - y), F.lit(360.0))
    return F.when(d <= 180, d).otherwise(360 - d)


def l1(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: F.abs(x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_each(a, b, lambda x, y: (x - y) * (x - y)))


def angular_l1(a: Column, b: Column) -> Column:
    """Sum of angles between components (geodesic distance on the torus)."""
    return _each(a, b, angular)


def complex_chord(a: Column, b: Column) -> Column:
    """Sum of chords between the components on the unit circle."""
    return _each(a, b, lambda x, y: F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.cos(F.radians(x - y))))))


def circular_mean(a: Column, b: Column) -> Column:
    """Mean of 1 - cos of the component angles."""
    return _each(a, b, lambda x, y: 1 - F.cos(F.radians(x - y))) / F.size(a)


def bessel_i0(x: float) -> float:
    """Modified Bessel function of order 0, by its power series."""
    term, total, k = 1.0, 1.0, 0
    while term > total * 1e-17:
        k += 1
        term *= (x / 2 / k) ** 2
        total += term
    return total


def von_mises(a: Column, b: Column, kappa: float = 4.0) -> Column:
    """Negative log-likelihood of the component angles under a von Mises density."""
    if kappa <= 0:
        raise ValueError("kappa must be positive")
    level = math.log(2 * math.pi * bessel_i0(kappa))
    return _each(a, b, lambda x, y: level - kappa * F.cos(F.radians(x - y)))


METRICS = {"l1": l1, "l2": l2, "angular_l1": angular_l1, "geodesic": angular_l1, "complex_chord": complex_chord, "circular_mean": circular_mean, "von_mises": von_mises}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name]
