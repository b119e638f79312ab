"""Order-dependent work on groups of any size.

A plain window puts one group into one task. These helpers split a group by a coarse
bucket of its order (a day, a month), work inside the buckets in parallel, and relate the
buckets of a group by their totals only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column], to: str = "n",
             descending: bool = False) -> DataFrame:
    """Row number from 1 within the keys, in the given order, without one task per key.

    `bucket` is a column that is monotone in the order; a key's rows are numbered bucket by
    bucket and shifted by the sizes of the buckets before.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_size"))
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(sizes, [*keys, bucket])
        .withColumn(to, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before")
    )


def neighbour(df: DataFrame, keys: list[str], number: str, step: int, columns: dict[str, str]) -> DataFrame:
    """Columns of the row `step` places on, by an equi-join on the row number."""
    other = df.select(
        *keys, (F.col(number) - step).alias(number), *[F.col(c).alias(a) for c, a in columns.items()])
    return df.join(other, [*keys, number], "left")


def chunked(df: DataFrame, keys: list[str], granule: list[str], rows_per_chunk: int = 50_000) -> DataFrame:
    """Adds `chunk`: runs of whole granules of at most about rows_per_chunk rows, in order.

    The granules of a key (for example trade days) are counted first, so a key with a third
    of all rows becomes many chunks and a small key stays one.
    """
    counts = df.groupBy(*keys, *granule).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*granule).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, *granule,
        F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows_per_chunk).cast("bigint").alias("chunk"))
    return df.join(counts, [*keys, *granule])


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median per group as (by, median, n).

    Mergeable quantile sketches bound the middle of each group; only the distinct values
    between the bounds (about two per cent) are ordered.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))  # by is not empty
    bounds = v.groupBy(*by).agg(
        F.percentile_approx("_v", [0.49, 0.51], 10_000).alias("_b"), F.count("*").alias("n"))
    marked = v.join(bounds, by)
    lo, hi = F.col("_b")[0], F.col("_b")[1]
    groups = (
        marked.where(F.col("_v") <= hi)
        .groupBy(*by, "n", F.when(F.col("_v") >= lo, F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("_upto", F.sum("_c").over(upto))
    first, second = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return ranked.groupBy(*by, "n").agg(
        ((F.min(F.when(F.col("_upto") >= first, F.col("_v")))
          + F.min(F.when(F.col("_upto") >= second, F.col("_v")))) / 2).alias("median"))
