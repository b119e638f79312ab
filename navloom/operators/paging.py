"""Sorting and paging of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def order_columns(order: list[tuple[str, str]], allowed: set[str], key: str = "code") -> list[Column]:
    """Sort columns from (field, direction); unknown fields are ignored, the key breaks ties."""
    out = [F.col(f).desc() if d == "desc" else F.col(f).asc() for f, d in order if f in allowed]
    return out + [F.col(key).asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """One page of a sorted list; the size is kept within limits."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)
