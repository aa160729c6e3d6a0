"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(_c(v), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def relevance(cosine) -> Column:
    """A score from 1 (same direction) down: one minus the squared distance of unit vectors over the root of two."""
    return 1 - 2 * (1 - _c(cosine)) / F.sqrt(F.lit(2.0))
