"""As-of, calendar, common-date and match joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.functions import scalars as X
from navloom.operators.timeline import date_list, visible_from


# ---- as-of -----------------------------------------------------------------------------

def asof(events: DataFrame, series: DataFrame, values: list[str], by: list[str] = ("fund_code",),
         on: str = "trade_date", series_date: str = "trade_date", suffix_date: str = "hit_date",
         prefix: str = "") -> DataFrame:
    """Last series row at or before each event date, per key; its values may be null.

    Events are first reduced to their distinct (key, date) pairs, so a key's window holds at
    most one row per calendar day from each side, however many events the key has.
    """
    by = list(by)
    points = events.select(*by, F.col(on).alias("_d")).distinct()
    hit = F.struct(F.col(series_date).alias("d"), *[F.col(v) for v in values])
    rows = series.select(*by, F.col(series_date).alias("_d"), hit.alias("_hit"), F.lit(0).alias("_k"))
    both = rows.unionByName(points.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy("_d", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(upto))
        .where(F.col("_k") == 1)
        .select(*by, F.col("_d").alias(on), F.col("_hit.d").alias(suffix_date),
                *[F.col(f"_hit.{v}").alias(prefix + v) for v in values])
    )
    return events.join(found, [*by, on], "left")


def forward_first(start: str, date: str, value: str):
    """Aggregate: value at the first date not before the start."""
    ok = F.col(date) >= F.col(start)
    return F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(date)))


def positive_price(nav: DataFrame, acc: str = "acc_nav", unit: str = "nav") -> DataFrame:
    """Cumulative value, or unit value where the cumulative one is missing or zero; bad rows dropped."""
    price = F.when(F.coalesce(F.col(acc), F.lit(0.0)) != 0, F.col(acc)).otherwise(F.col(unit))
    return nav.withColumn("price", price).where(F.col("price") > 0)


# ---- trading calendar --------------------------------------------------------------------

def base_days(moments: DataFrame, calendar: DataFrame, ts: str, publish_hour: int = 20) -> DataFrame:
    """Per moment: latest trading day, the one strictly before the day, and the day whose data must exist.

    The latest trading day counts as published only after the publish hour.
    """
    day = F.to_date(ts)
    days = moments.select(day.alias("_d")).distinct()
    cal = calendar.select(F.col("trade_date").alias("_d"), F.lit(True).alias("_open"))
    # one row per calendar day: bounded by the length of history
    spine = days.join(cal, "_d", "full_outer").withColumn("_trade", F.when(F.col("_open"), F.col("_d")))
    order = Window.partitionBy(F.lit(0)).orderBy("_d")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spine = spine.select(
        "_d", F.last("_trade", True).over(upto).alias("latest_day"), F.last("_trade", True).over(before).alias("prev_day"))
    hit = moments.withColumn("_d", day).join(spine, "_d", "left").drop("_d")
    early = (F.col("latest_day") == F.to_date(ts)) & (F.hour(ts) < publish_hour)
    return hit.withColumn("base_day", F.when(early, F.col("prev_day")).otherwise(F.col("latest_day")))


# ---- common dates ---------------------------------------------------------------------------

def common_dates(members: DataFrame, series: DataFrame, by: list[str], member: str = "fund_code",
                 date: str = "trade_date") -> DataFrame:
    """Series rows on the dates that all members of a set share."""
    joined = members.join(series, member)
    sizes = members.groupBy(*by).agg(F.count_distinct(member).alias("_members"))
    full = (
        joined.groupBy(*by, date).agg(F.count("*").alias("_have"))
        .join(sizes, by).where(F.col("_have") == F.col("_members")).select(*by, date)
    )
    return joined.join(full, [*by, date])


# ---- names and codes -------------------------------------------------------------------------

def resolve_codes(rows: DataFrame, funds: DataFrame, code: str = "fund_code", name: str = "fund_name") -> DataFrame:
    """Fill a missing code from the exact name, else from the base name, else the name itself."""
    exact = funds.groupBy(F.col("name").alias("_name")).agg(F.min("code").alias("_exact"))
    based = (
        funds.select("code", X.base_name("name").alias("_base")).where(F.col("_base") != "")
        .groupBy("_base").agg(F.min("code").alias("_based"))
    )
    own = F.nullif(F.trim(F.coalesce(F.col(code), F.lit(""))), F.lit(""))
    text = F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    return (
        rows.withColumn("_name", text).withColumn("_base", X.base_name("_name"))
        .join(exact, "_name", "left").join(based, "_base", "left")
        .withColumn("resolved_code", F.coalesce(own, "_exact", "_based", "_name"))
        .withColumn("resolved_by", F.when(own.isNotNull(), "code").when(F.col("_exact").isNotNull(), "name")
                    .when(F.col("_based").isNotNull(), "base").otherwise("none"))
        .drop("_name", "_base", "_exact", "_based")
    )


# ---- holdings quarters -----------------------------------------------------------------------

def resolve_quarter(dates: DataFrame, quarters: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Quarter to use at each date: the disclosed one, else the latest earlier, else the earliest.

    One sorted pass over the few distinct quarters: an as-of lookup on quarter text.
    """
    wanted = dates.withColumn("ideal", X.disclosed_quarter_month(as_of))
    known = quarters.select(F.lit(0).alias("_g"), "quarter").distinct()
    earliest = known.groupBy("_g").agg(F.min("quarter").alias("_first"))
    hit = asof(wanted.withColumn("_g", F.lit(0)), known.withColumn("q", F.col("quarter")), ["q"],
               by=["_g"], on="ideal", series_date="quarter", suffix_date="_qd")
    return (
        hit.join(earliest, "_g", "left")
        .withColumn("quarter", F.coalesce("q", "_first", "ideal"))
        .withColumn("is_fallback", (F.col("quarter") != F.col("ideal")))
        .drop("_g", "q", "_qd", "_first")
    )


def disclosed_cut(holdings: DataFrame, dates: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Holdings visible at each decision date, row by row: quarter not after the last disclosed one.

    The quarters that the holdings have meet the dates first, so all of them are found, however old. What only needs
    sums over visible quarters takes `timeline.visible_totals`, whose rows don't grow with the dates.
    """
    quarters = holdings.select("quarter").distinct().withColumn("_dates", date_list(dates, as_of))
    seen = quarters.withColumn("_from", visible_from("quarter")).select(
        "quarter", F.explode(F.filter("_dates", lambda d: d >= F.col("_from"))).alias(as_of))
    return holdings.join(seen, "quarter")
