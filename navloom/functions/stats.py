"""Statistics of return series and of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.operators.scale import exact_median


def simple_returns(df: DataFrame, by: list[str], date: str = "trade_date", value: str = "nav", to: str = "ret") -> DataFrame:
    """Return against the row before; the first row of a series has none."""
    w = Window.partitionBy(*by).orderBy(date)
    return df.withColumn(to, F.col(value) / F.lag(value).over(w) - 1)


def return_stats(curve: DataFrame, by: list[str], convention: str, date: str = "trade_date",
                 value: str = "nav") -> DataFrame:
    """Annual return, volatility, Sharpe and drawdown (negative fraction) of each curve.

    conventions
      observed_sample      CAGR over calendar days, sample deviation, observed points per year
      observed_population  the same with the population deviation
      mean_over_sigma      mean/sigma at observed frequency, sample deviation
      days252              mean/sigma x sqrt(252), population deviation
      days244              mean x 244 over sample sigma x sqrt(244)
    """
    w = Window.partitionBy(*by).orderBy(date)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = simple_returns(curve, by, date, value).withColumn("_dd", F.col(value) / peak - 1)
    sigma = F.stddev_pop("ret") if convention in ("observed_population", "days252") else F.stddev_samp("ret")
    agg = rows.groupBy(*by).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("_mean"), sigma.alias("_sigma"),
        F.min_by(value, date).alias("_first"), F.max_by(value, date).alias("_last"),
        F.min(date).alias("start"), F.max(date).alias("end"), F.min("_dd").alias("max_drawdown"))
    span = F.greatest(F.datediff("end", "start"), F.lit(1))
    per_year = F.col("n") * 365.25 / span
    sigma0 = F.coalesce(F.col("_sigma"), F.lit(0.0))
    cagr = F.pow(F.col("_last") / F.col("_first"), 365.25 / span) - 1
    if convention.startswith("observed"):
        annual, vol = cagr, sigma0 * F.sqrt(per_year)
    elif convention == "mean_over_sigma":
        annual, vol = cagr, sigma0 * F.sqrt(per_year)
    elif convention == "days252":
        annual, vol = F.col("_mean") * 252, sigma0 * F.sqrt(F.lit(252.0))
    elif convention == "days244":
        annual, vol = F.col("_mean") * 244, sigma0 * F.sqrt(F.lit(244.0))
    else:
        raise ValueError(convention)
    if convention == "mean_over_sigma":
        ratio = F.when(sigma0 > 0, F.col("_mean") / sigma0 * F.sqrt(per_year)).otherwise(0.0)
    else:
        ratio = F.when(vol > (1e-9 if convention == "days244" else 0.0), annual / vol).otherwise(0.0)
    return agg.select(
        *by, "start", "end", (F.col("n") + 1).alias("points"), (F.col("_last") / F.col("_first") - 1).alias("total_return"),
        annual.alias("annual_return"), vol.alias("annual_vol"), ratio.alias("sharpe"), "max_drawdown")


def sortino(df: DataFrame, by: list[str], date: str = "trade_date", value: str = "nav") -> DataFrame:
    """Mean return over downside root mean square; null with fewer than five losses."""
    rets = simple_returns(df, by, date, value)
    r, loss = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    down = F.sqrt(F.avg(loss * loss))
    return rets.groupBy(*by).agg(
        F.when((F.count(loss) >= 5) & (down > 0), F.avg(r) / down * F.sqrt(F.lit(252.0))).alias("sortino"))


def rolling_sharpe(df: DataFrame, by: list[str], roll: int = 252, date: str = "trade_date", value: str = "nav") -> DataFrame:
    """Median and deviation over time of the rolling Sharpe; null with a short history.

    A series has at most one row per day, so its windows stay small.
    """
    w = Window.partitionBy(*by).orderBy(date)
    frame = w.rowsBetween(-(roll - 1), 0)
    rows = (
        simple_returns(df, by, date, value)
        .withColumn("_n", F.count("ret").over(frame))
        .withColumn("_m", F.avg("ret").over(frame)).withColumn("_s", F.stddev_pop("ret").over(frame))
        .withColumn("_sharpe", F.when((F.col("_n") == roll) & (F.col("_s") > 0),
                                      F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0))))
    )
    enough = (F.count("*") >= roll + 20) & (F.count("_sharpe") >= 10)
    return rows.groupBy(*by).agg(
        F.when(enough, F.median("_sharpe")).alias("sharpe_med"),
        F.when(enough, F.stddev_pop("_sharpe")).alias("sharpe_std"))


def robust_z(df: DataFrame, by: list[str], columns: list[str], floor: float = 0.0) -> DataFrame:
    """Adds z_<column>: distance from the pool median in pool deviations, clipped to +-2.

    Missing values, and pools without spread, give 0. `floor` is the deviation taken as none.
    """
    keys = by or ["_pool"]
    pool = df if by else df.withColumn("_pool", F.lit(0))
    # all columns in one pass: (pool, column, value)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = pool.select(*keys, cells.alias("_x")).select(*keys, F.col("_x.c").alias("_column"), F.col("_x.v").alias("_value"))
    spread = long.groupBy(*keys, "_column").agg(F.stddev_pop("_value").alias("s"))
    middle = exact_median(long, [*keys, "_column"], "_value").drop("n").withColumnRenamed("median", "m")
    both = spread.join(middle, [*keys, "_column"], "left").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_column", F.struct("m", "s")))).alias("_stats"))
    out = pool.join(both, keys, "left")
    for c in columns:
        m, s = F.col("_stats")[c]["m"], F.col("_stats")[c]["s"]
        clipped = F.least(F.greatest((F.col(c) - m) / s, F.lit(-2.0)), F.lit(2.0))
        out = out.withColumn(f"z_{c}", F.when(F.col(c).isNotNull() & (s > floor), clipped).otherwise(0.0))
    out = out.drop("_stats")
    return out if by else out.drop("_pool")


def weighted_z(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.col(f"z_{c}")
    return total


def minmax_100(df: DataFrame, by: list[str], column: str, to: str) -> DataFrame:
    """0-100 between the group's extremes; flat groups and missing values give 50."""
    lims = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    value = F.when(F.col(column).isNull() | (spread <= 1e-12), 50.0).otherwise(
        (F.col(column) - F.col("_lo")) / spread * 100.0)
    return df.join(lims, by).withColumn(to, value).drop("_lo", "_hi")


def rank_100(df: DataFrame, by: list[str], column: str, tie: str, to: str) -> DataFrame:
    """0-100 by rank among present values; missing values and single rows give 50.

    The groups ranked are the picked funds of a portfolio: at most one per theme.
    """
    present = F.col(column).isNotNull()
    w = Window.partitionBy(*by, present).orderBy(column, tie)
    n = F.count(column).over(Window.partitionBy(*by, present))
    value = F.when(present & (n > 1), (F.row_number().over(w) - 1) / (n - 1) * 100.0).otherwise(50.0)
    return df.withColumn(to, value)
