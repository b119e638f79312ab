"""Streams: value increments, late and repeated rows, live positions, sync health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navloom.sources.landed import last_row_wins


def read_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def drain(query) -> None:
    """Waits for an availableNow run and raises its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append_versions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch adds its rows with the batch number, once per batch number.

    The version log is append-only and partitioned by batch, so a batch that is run again
    overwrites its own partition; `current_rows` reads the newest version of a key.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    drain(stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_rows(spark: SparkSession, path: str, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Newest version per key: by batch, then by the given columns."""
    rows = spark.read.parquet(path)
    return last_row_wins(rows.withColumn("ord", F.struct("batch", *order)).drop("batch"), keys)


def first_values(stream: DataFrame, keys: list[str], event_time: str, late: str = "7 days") -> DataFrame:
    """Repeated rows of a key inside the watermark are dropped; state is forgotten after it."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def first_or_late(stream: DataFrame, keys: list[str], event_time: str, path: str, checkpoint: str, late_days: int = 7) -> None:
    """First row of every key to `path`/first, rows that come too late to `path`/late, repeats nowhere.

    A row is late when its event time lies more than `late_days` before the newest one of all batches before its own;
    nothing is dropped unseen, and the rule doesn't depend on how rows are ordered inside a batch. Each batch writes its
    newest event time to `path`/mark. A row of an older batch wins over the rows after it, the earliest event time
    inside a batch. A repeat lies in the days that are still open, so only these are read back. A batch that is run again
    overwrites its own part of all three tables.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write = lambda df, name: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        rows = batch.withColumn("_day", F.to_date(event_time))
        write(rows.agg(F.max(event_time).alias("newest")), "mark")
        newest = spark.read.parquet(f"{path}/mark").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(
            F.col(event_time) < F.lit(newest) - F.make_dt_interval(days=F.lit(late_days)), F.lit(False))
        write(rows.where(late).drop("_day"), "late")
        fresh = rows.where(~late)
        order = F.struct(F.col(event_time), *[c for c in batch.columns if c not in (event_time, *keys)])
        rest = F.struct(*[c for c in rows.columns if c not in keys])
        fresh = fresh.groupBy(*keys).agg(F.min_by(rest, order).alias("_r")).select(*keys, "_r.*")
        if newest is not None:
            seen = spark.read.parquet(f"{path}/first").where((F.col("batch") < number) & (
                F.col("_day") >= F.date_sub(F.to_date(F.lit(newest)), late_days)))
            fresh = fresh.join(seen.select(*keys).distinct(), keys, "left_anti")
        write(fresh, "first")

    drain(stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def sync_health(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes", fail_limit: int = 50) -> DataFrame:
    """Counts per status and time window, with the unhealthy mark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "skip").alias("skip"),
        F.count_if(F.col("status") == "fail").alias("fail")
    ).select(F.col("w.start").alias("window_start"), "success", "skip", "fail", (F.col("fail") >= fail_limit).alias("unhealthy"))


def live_positions(trades: DataFrame, log: str, rows: str, checkpoint: str, buckets: int = 64) -> None:
    """Running position per (portfolio, fund) from booked trades that arrive in any order.

    A trade that arrives late changes the average cost of everything after it, so positions are folded from all
    trades of the keys a batch touches, in the order of date and id. The trades are kept in a log by key bucket and
    batch; a batch that is run again overwrites its own part, and a trade that is delivered twice counts once. Only
    the touched buckets are read. The result goes to the version log `rows` and is the same however the trades fall
    into batches.
    """
    keys = ["portfolio_id", "fund_code"]

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch.withColumn("bucket", bucket).withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(log)
        part = spark.read.parquet(log).where(F.col("batch") == number)
        touched = part.select("bucket", *keys).distinct()
        all_trades = spark.read.parquet(log).join(touched, ["bucket", *keys], "left_semi").drop("batch", "bucket")
        folded = settled(all_trades.dropDuplicates([*keys, "id"]))
        folded.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rows)

    drain(trades.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def settled(trades: DataFrame) -> DataFrame:
    """(portfolio_id, fund_code, shares, cost, realised, invested) of share-counted trades, by the batch ledger."""
    from navloom.operators import ledger

    snaps = trades.sparkSession.createDataFrame(
        [], "portfolio_id bigint, fund_code string, base_shares double, cost double, market_value double")
    # at a value of one the market value is the share count
    unit = trades.select("fund_code", F.lit(1.0).alias("nav"), F.lit("1970-01-01").cast("date").alias("trade_date")).distinct()
    held = ledger.positions(snaps, trades, unit)
    return held.select("portfolio_id", "fund_code", "shares", "cost",
                       (F.col("pnl") - F.col("market_value") + F.col("cost")).alias("realised"),
                       F.col("total_invested").alias("invested"))
