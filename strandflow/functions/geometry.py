"""Column expressions of lineage geometry, in micrometres unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres per voxel in z, y, x, and the model grid's downsampling.
SCALE = (1.625, 0.40625, 0.40625)
GRID = (1.0, 4.0, 4.0)
AXES = ("uz", "uy", "ux")


def point(alias: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{alias}.{a}") for a in AXES)


def sub(a, b):
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a, b):
    return tuple(p + q for p, q in zip(a, b, strict=True))


def times(a, k: float):
    return tuple(p * F.lit(k) for p in a)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def angle(a, b) -> Column:
    """Degrees between two vectors; NaN if one has no length."""
    length = norm(a) * norm(b)
    cos = F.least(F.greatest(dot(a, b) / length, F.lit(-1.0)), F.lit(1.0))
    return F.when(length > 0, F.degrees(F.acos(cos))).otherwise(F.lit(float("nan")))


def finite_at_least(x: Column, least: float) -> Column:
    """x >= least, false for NaN (which Spark holds to be the greatest)."""
    return ~F.isnan(x) & (x >= least)


def division_balance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a + b, F.lit(1e-12))


def step_balance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1e-12))
