"""Final projections: fixed digits, so that results do not depend on the order of additions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(*names, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def f32(*names) -> list[Column]:
    """Single precision: decimals such as prices have no rounding ties there."""
    return [F.col(n).cast("float").cast("double").alias(n) for n in names]
