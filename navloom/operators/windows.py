"""Point-in-time factors of value series.

All series have one row per (fund, day): a window holds at most a fund's trading days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.window import Window

from navloom import constants as K
from navloom.functions import scalars as X
from navloom.operators.timeline import date_list, day_at, days_upto, series_index


def latest(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Columns of the newest row per key: an aggregate, reduced before the shuffle."""
    picked = F.max_by(F.struct(*columns), F.col(order))
    return df.groupBy(*by).agg(picked.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in columns])


def recent_points(nav: DataFrame, limit: int, by: list[str] = ("fund_code",)) -> DataFrame:
    """The last N rows per fund, cumulative value else unit value, rows without either dropped after counting."""
    w = Window.partitionBy(*by).orderBy(F.desc("trade_date"))
    kept = nav.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
    return kept.withColumn("value", F.coalesce("acc_nav", "nav")).where(F.col("value").isNotNull())


def first_rows(nav: DataFrame, limit: int | None = None) -> DataFrame:
    """The first N rows per fund from the oldest, all without a limit; missing unit values are dropped after counting."""
    if limit is None:
        return nav.where(F.col("nav").isNotNull())
    w = Window.partitionBy("fund_code").orderBy("trade_date")
    return (
        nav.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
        .where(F.col("nav").isNotNull())
    )


def top_holdings(holdings: DataFrame, limit: int = 10, newest_only: bool = True,
                 by: list[str] = ("fund_code", "holding_type")) -> DataFrame:
    """Largest positions of the newest quarter (or of every quarter) with their rank."""
    by = list(by)
    rows = holdings
    if newest_only:
        newest = holdings.groupBy(*by).agg(F.max("quarter").alias("quarter"))
        rows = holdings.join(newest, [*by, "quarter"], "left_semi")
    w = Window.partitionBy(*by, "quarter").orderBy(F.desc("hold_ratio"), "asset_code")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def drawdown(df: DataFrame, by: list[str], date: str = "trade_date", value: str = "nav") -> DataFrame:
    """Running peak and the distance below it as a negative fraction."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def rebase(df: DataFrame, by: list[str], date: str = "trade_date", value: str = "nav", to: str = "rel") -> DataFrame:
    base = df.groupBy(*by).agg(F.min_by(value, date).alias("_base"))
    return df.join(base, by).withColumn(
        to, F.when(F.coalesce(F.col("_base"), F.lit(0.0)) != 0, F.col(value) / F.col("_base"))).drop("_base")


def trailing_stats(values: np.ndarray, known: np.ndarray, rows: int, spread: bool = True) -> dict[str, np.ndarray]:
    """n, mean and population deviation (sigma, with `spread`) of the known values among the last `rows` up to each place.

    The stretches of all places take up their values together, oldest first, as a window's aggregates do.
    """
    n, total, mean, m2 = (np.zeros(len(values)) for _ in range(4))
    values = np.where(known, values, 0.0)
    with np.errstate(all="ignore"):
        for k in range(min(rows, len(values)) - 1, -1, -1):
            x, here = values[:len(values) - k], known[:len(values) - k]
            n[k:] += here
            total[k:] += x
            if spread:
                delta = x - mean[k:]
                step = delta / n[k:]
                mean[k:] += np.where(here, step, 0.0)
                m2[k:] += np.where(here, delta * (delta - step), 0.0)
        return {"n": n, "mean": total / n, **({"sigma": np.sqrt(m2 / n)} if spread else {})}


def with_trailing(df: DataFrame, by: list[str], order: str, stats: dict[str, tuple[str, int, bool]]) -> DataFrame:
    """Adds `trailing_stats` of (column, rows, spread) as <name>_n, <name>_mean, <name>_sigma; of no known value the
    latter are null.

    A sliding frame takes up all its rows again at every row; here a key's rows, which are one series, go through once
    as arrays.
    """
    schema = StructType([*df.schema.fields])
    for name, (_, _, spread) in stats.items():
        for part in ("n", "mean", *(["sigma"] if spread else [])):
            schema = schema.add(f"{name}_{part}", DoubleType())

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        for name, (column, last, spread) in stats.items():
            values = rows[column].combine_chunks().cast(pa.float64())
            known = values.is_valid().to_numpy(zero_copy_only=False)
            found = trailing_stats(values.to_numpy(zero_copy_only=False), known, last, spread)
            for part, x in found.items():
                rows = rows.append_column(f"{name}_{part}", pa.array(x, mask=None if part == "n" else found["n"] == 0))
        return rows

    return df.groupBy(*by).applyInArrow(run, schema)


def factors(series: DataFrame, by: list[str] = ("fund_code",), date: str = "trade_date", value: str = "value") -> DataFrame:
    """Momentum, short risk-adjusted return, breadth, streak and deviation at every row.

    Each column at a row uses that row and earlier rows only, so any set of cut-off dates is
    answered by picking rows.
    """
    by = list(by)
    v = F.col(value)
    w = Window.partitionBy(*by).orderBy(date)

    def back(n):
        return F.lag(value, n).over(w)

    df = series.withColumn("i", F.row_number().over(w))
    # weighted returns over the horizons that exist, weights renormalised
    num, den = F.lit(0.0), F.lit(0.0)
    for days, weight in K.MOMENTUM_HORIZONS.items():
        ok = back(days) > 0
        num = num + F.when(ok, weight * (v / back(days) - 1)).otherwise(0.0)
        den = den + F.when(ok, weight).otherwise(0.0)
    df = df.withColumn("_num", num).withColumn("_den", den)
    df = df.withColumn("momentum_raw", F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")
    df = df.withColumn("_r", v / back(1) - 1)
    # rows 20 apart form one chain of months; the streak is the distance to its last month that did not rise
    df = df.withColumn("_up", v > back(20)).withColumn("_chain", F.col("i") % 20)
    chain = Window.partitionBy(*by, "_chain").orderBy("i")
    upto = chain.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_place", F.row_number().over(chain))
    broke = F.max(F.when(~F.coalesce(F.col("_up"), F.lit(False)), F.col("_place"))).over(upto)
    months = F.floor(F.col("i") / 20)
    df = df.withColumn("_run", F.col("_place") - broke)
    df = df.withColumn("consistency", F.when(months < 2, 50.0).otherwise(
        F.least(F.col("_run"), months - 1) / (months - 1) * 100.0))
    stats = {"_ret": ("_r", 60, True), "_v20": (value, 20, False), "_v60": (value, 60, False)}
    df = with_trailing(df.drop("_up", "_chain", "_place", "_run"), by, "i", stats)
    sigma, mean = F.col("_ret_sigma"), F.col("_ret_mean")
    df = df.withColumn("risk_adj_raw", F.when(
        (F.col("_ret_n") >= 20) & (sigma > 0), mean / sigma * F.sqrt(F.lit(252.0))))
    df = df.withColumn("_ma20", F.when(F.col("i") >= 20, F.col("_v20_mean")))
    df = df.withColumn("_ma60", F.when(F.col("i") >= 60, F.col("_v60_mean")).otherwise(F.col("_ma20")))
    score = F.when(v > F.col("_ma20"), 60.0).otherwise(0.0) + F.when(v > F.col("_ma60"), 40.0).otherwise(0.0)
    d20 = F.when(F.col("_ma20") > 0, (v / F.col("_ma20") - 1) * 100.0).otherwise(0.0)
    d60 = F.when(F.col("_ma60") > 0, (v / F.col("_ma60") - 1) * 100.0).otherwise(0.0)
    bonus = F.least(F.greatest(d20, F.lit(-10.0)), F.lit(10.0))
    df = df.withColumn("breadth", F.when(F.col("i") < 20, 50.0).otherwise(
        F.least(F.greatest(score + bonus, F.lit(0.0)), F.lit(100.0))))
    df = df.withColumn("d20", F.when(F.col("i") < 20, 0.0).otherwise(d20))
    df = df.withColumn("d60", F.when(F.col("i") < 20, 0.0).otherwise(d60))
    df = df.withColumn("deviation", F.when(F.col("i") < 20, 0.0).otherwise(0.6 * d20 + 0.4 * d60))
    return df.drop("_r", "_ma20", "_ma60", *[c for c in df.columns if c.startswith(("_ret_", "_v20_", "_v60_"))])


def momentum_to_first(prices: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """0.5/0.3/0.2 of the 21/63/126-row returns at the last row; short series use their first value."""
    w = Window.partitionBy(*by).orderBy(F.desc("trade_date"))
    rows = prices.withColumn("_rn", F.row_number().over(w))
    at = lambda n: F.max(F.when(F.col("_rn") == n, F.col(price)))
    first = F.max_by(price, "_rn")
    ret = lambda n: at(1) / F.coalesce(at(n + 1), first) - 1
    return rows.groupBy(*by).agg(
        F.when(F.count("*") < 2, 0.0).otherwise(0.5 * ret(21) + 0.3 * ret(63) + 0.2 * ret(126)).alias("momentum"))


def ytd_return(nav: DataFrame, dates: DataFrame, value: str = "value") -> DataFrame:
    """Percent from the last point of the year before to the last point of the year, per (as_of, fund).

    Read from the months' index of each fund; dates are not joined with values.
    """
    found = series_index(nav.where(F.col(value).isNotNull()), ["fund_code"], value)

    def read(x):
        start = F.trunc(x["as_of"], "year")
        base, here = day_at(x["old"]), x["hi"] > x["old"]
        return F.struct(
            x["as_of"].alias("as_of"), F.when(base["d"] >= F.add_months(start, -12), base["p"]).alias("base"),
            F.when(here, day_at(x["old"] + 1)["p"]).alias("first"), F.when(here, day_at(x["hi"])["p"]).alias("last"))

    places = F.transform("_dates", lambda d: F.struct(
        d.alias("as_of"), days_upto(d).alias("hi"), days_upto(F.date_sub(F.trunc(d, "year"), 1)).alias("old")))
    rows = found.withColumn("_dates", date_list(dates)).withColumn("_x", places).select("fund_code", F.inline(F.transform("_x", read)))
    base, first, last = F.col("base"), F.col("first"), F.col("last")
    return rows.where(base.isNotNull() | last.isNotNull()).select(
        "as_of", "fund_code", F.when(base > 0, (last / base - 1) * 100).alias("ytd_from_year_end"),
        F.when(first > 0, (last / first - 1) * 100).alias("ytd_from_first_point"))


def tenure_at(tenure_days, run_date, as_of):
    """Column: current tenure taken back to a date, never below zero; missing tenure counts as none."""
    gap = F.datediff(run_date, as_of)
    return F.greatest(F.lit(0), F.coalesce(tenure_days, F.lit(0)) - gap)


def interval_windows(curves: DataFrame, by: list[str], date: str = "trade_date") -> DataFrame:
    """Curve rows repeated for each reporting window that covers them: 3m, 6m, 1y, YTD, all."""
    ends = curves.groupBy(*by).agg(F.max(date).alias("_last"), F.min(date).alias("_first"))
    last = F.col("_last")
    starts = F.array(
        F.struct(F.lit("近三月").alias("window"), X.minus_months(last, 3).alias("start")),
        F.struct(F.lit("近六月").alias("window"), X.minus_months(last, 6).alias("start")),
        F.struct(F.lit("近一年").alias("window"), X.minus_months(last, 12).alias("start")),
        F.struct(F.lit("今年以来").alias("window"), F.trunc(last, "year").alias("start")),
        F.struct(F.lit("全部").alias("window"), F.col("_first").alias("start")),
    )
    return (
        curves.join(ends, by)
        .withColumn("_w", F.explode(F.filter(starts, lambda s: s["start"] <= F.col(date))))
        .withColumn("window", F.col("_w.window")).drop("_w", "_last", "_first")
    )


def sliced(curves: DataFrame, by: list[str], days: int, date: str = "trade_date") -> DataFrame:
    """The last N days of each curve; the whole curve when fewer than two points are left."""
    ends = curves.groupBy(*by).agg(F.max(date).alias("_last"))
    rows = curves.join(ends, by).withColumn("_in", F.col(date) >= F.date_sub("_last", days))
    counts = rows.groupBy(*by).agg(F.count_if("_in").alias("_n"))
    return rows.join(counts, by).where(F.col("_in") | (F.col("_n") < 2)).drop("_last", "_in", "_n")
