"""Merges and writes of the fund tables.

Merges return the new table; `write_*` functions store it. A table that is read by its own
merge is written next to the old one first and then put in place by the caller's catalog, or
through dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navloom.session import cut_lineage


def replace_all(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Only the partitions present in the rows are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row upsert: the new row of a key wins."""
    columns = old.columns
    rest = [c for c in columns if c not in keys]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.select(*columns).withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_v")).alias("_r")).select(*keys, "_r.*").select(*columns)


def upsert_partitions(spark, new: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Whole-row upsert into a stored table that reads and writes only the partitions the increment touches.

    The merged partitions are written beside the table first, since a table can't be overwritten while it is read.
    """
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # partitions of one increment
    old = spark.read.schema(new.schema).parquet(path).where(F.col(partition).isin(touched))
    replace_partitions(cut_lineage(upsert(old, new, [*keys, partition])), path, [partition])


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Groups present in the increment are replaced whole; the others stay."""
    kept = old.join(new.select(*group).distinct(), group, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], protect: str | None = None) -> DataFrame:
    """Field-wise upsert: given fields change, others stay; rows with the protect flag are left alone."""
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("_o"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns]).alias("_n"))
    joined = o.join(n, keys, "full_outer")
    frozen = F.coalesce(F.col(f"_o.{protect}") == 1, F.lit(False)) if protect else F.lit(False)
    return joined.select(*keys, *[
        F.when(frozen, F.col(f"_o.{c}")).otherwise(F.coalesce(f"_n.{c}", f"_o.{c}")).alias(c) for c in columns])


def manual_corrections(old: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections set their fields, the manual mark and the source."""
    marked = fixes.withColumn("manual", F.lit(1)).withColumn("source", F.lit("manual"))
    return merge_fields(old, marked, keys)


def above_high_water(stored: DataFrame, increment: DataFrame, key: str = "fund_code", date: str = "trade_date") -> DataFrame:
    """Increment rows newer than the newest stored row of their fund."""
    marks = stored.groupBy(key).agg(F.max(date).alias("_mark"))
    return increment.join(marks, key, "left").where(F.col("_mark").isNull() | (F.col(date) > F.col("_mark"))).drop("_mark")


def backfill(old: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Missing values of one column filled by key; `_changed` marks the filled rows."""
    joined = old.join(values.select(*keys, F.col(column).alias("_new")), keys, "left")
    return joined.withColumn("_changed", F.col(column).isNull() & F.col("_new").isNotNull()) \
        .withColumn(column, F.coalesce(column, "_new")).drop("_new")


def build_snapshots(members: DataFrame, top: DataFrame) -> DataFrame:
    """Snapshot rows (preset_id, code, holdings), to be written partitioned by preset_id.

    A member carries at most its top rows; a preset is a partition of the table and never one value.
    """
    holdings = top.groupBy("fund_code").agg(F.array_sort(F.collect_list(F.struct(
        "holding_type", "rank", "asset_code", "asset_name", "hold_ratio"))).alias("holdings"))
    empty = F.array().cast(holdings.schema["holdings"].dataType)
    return members.join(holdings, members["code"] == holdings["fund_code"], "left").select(
        "preset_id", "code", F.coalesce("holdings", empty).alias("holdings"))


def clean_positions(rows: DataFrame) -> DataFrame:
    """Bulk-loaded positions: text to numbers, rows without a code dropped, last row per code kept."""
    from navloom.functions import scalars as X
    from navloom.sources.landed import last_row_wins

    value = F.when(F.coalesce(F.trim("market_value"), F.lit("")) == "", F.lit(0.0)).otherwise(
        F.col("market_value").try_cast("double"))
    cleaned = rows.withColumn("market_value", value).withColumn("cost", F.col("cost").try_cast("double"))
    cleaned = cleaned.where(F.col("market_value").isNotNull() & (F.coalesce("resolved_code", F.lit("")) != ""))
    kept = cleaned.select("portfolio_id", F.col("resolved_code").alias("fund_code"), X.clean_text("fund_name").alias("fund_name"),
                          "market_value", "cost", "ord")
    return last_row_wins(kept, ["portfolio_id", "fund_code"])


def latest_result(results: DataFrame, by: str = "user_id", order: str = "created_at") -> DataFrame:
    """Newest saved portfolio per user."""
    rest = [c for c in results.columns if c != by]
    return results.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(by, "_r.*")
