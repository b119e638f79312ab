"""The fund tables, derived from the test tables.

Each function takes (spark, sf_dir). Sums are taken before rows are related to each
other, so a supplier that holds a large part of all rows is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navloom.functions import scalars as X
from navloom.operators.scale import neighbour, numbered
from navloom.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def code6(c):
    """The number as text of six digits at least; longer numbers keep all of theirs."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.lpad(text, F.greatest(F.char_length(text), F.lit(6)), "0")


def funds(spark, d) -> DataFrame:
    share = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("C")
    kind = (
        F.when(F.col("s_nationkey") % 4 == 0, "股票型")
        .when(F.col("s_nationkey") % 4 == 1, "混合型-偏股")
        .when(F.col("s_nationkey") % 4 == 2, "混合型-灵活")
        .otherwise("债券型-长债")
    )
    base = table(spark, d, "supplier").select(
        code6("s_suppkey").alias("code"),
        F.concat(F.lit("Fund "), F.expr("cast(s_suppkey div 2 as string)"), share).alias("name"),
        kind.alias("type"),
    )
    return base.withColumn("fund_type", X.equity_class("name", "type"))


def lines_of(spark, d, funds: DataFrame | None = None) -> DataFrame:
    """The line items, or those of some funds (fund_code): these meet the lines before anything is shuffled."""
    lines = table(spark, d, "lineitem")
    return lines if funds is None else lines.join(funds, code6("l_suppkey") == F.col("fund_code"), "left_semi")


def fund_details(spark, d, funds: DataFrame | None = None) -> DataFrame:
    """One row per fund, of all or some `funds`; the line items are aggregated before they meet the suppliers."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = (
        lines_of(spark, d, funds)
        .join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_suppkey")
        .agg(
            F.min("l_shipdate").cast("date").alias("establish_date"),
            (100 * F.avg(F.when(F.col("p_type") != "PROMO", 1).otherwise(0))).alias("position_stock"),
            (F.avg(price) / F.nullif(F.stddev_samp(price), F.lit(0.0))).alias("sharpe_3y"),
            (F.avg("l_tax") / F.nullif(F.stddev_samp("l_tax"), F.lit(0.0))).alias("risk_return_ratio_3y"),
            (100 * F.max("l_discount")).alias("max_drawdown_3y"),
        )
    )
    suppliers = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if funds is not None:
        suppliers = suppliers.join(funds, code6("s_suppkey") == F.col("fund_code"), "left_semi")
    return suppliers.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        code6("s_suppkey").alias("fund_code"),
        F.concat(F.lit("Fund "), F.expr("cast(s_suppkey div 2 as string)"),
                 F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("C")).alias("fund_name"),
        F.col("n_name").alias("fund_company"),
        F.round(F.abs("s_acctbal") / 20, 2).alias("scale"),
        "establish_date", "position_stock", "sharpe_3y", "risk_return_ratio_3y", "max_drawdown_3y",
    )


def fund_ai(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").where(F.col("s_nationkey") % 3 != 0).select(
        code6("s_suppkey").alias("fund_code"),
        F.when(k % 3 == 0, "solid").when(k % 3 == 1, "mixed").otherwise("luck").alias("luck_verdict"),
        F.when(k % 2 == 0, "focused").otherwise("diversified").alias("concentration"),
        (k % 2).cast("int").alias("recommend"),
        (F.col("s_nationkey") * 4).cast("int").alias("skill_score"),
        (k % 4).cast("int").alias("rating"),
    )


def nav_daily(spark, d, funds: DataFrame | None = None) -> DataFrame:
    """Daily values of all or some `funds` (fund_code)."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.col("l_shipdate").cast("date")
    return (
        lines_of(spark, d, funds)
        .groupBy("l_suppkey", day.alias("trade_date"))
        .agg(
            (F.avg(price) / 1000).alias("nav"),
            (F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")) / 1000).alias("acc"),
        )
        .select(
            code6("l_suppkey").alias("fund_code"), "trade_date", "nav",
            F.when(F.dayofmonth("trade_date") % 5 != 0, F.col("acc")).alias("acc_nav"),
        )
    )


def nav_weekly(spark, d) -> DataFrame:
    """Weekly values of the brand funds, which share their dates."""
    week = F.date_trunc("week", F.col("l_shipdate")).cast("date")
    return (
        table(spark, d, "lineitem")
        .join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("fund_code"), week.alias("trade_date"))
        .agg((F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 1000).alias("nav"))
    )


def with_ratio(rows: DataFrame, by: list[str], value="hold_market_value", to="hold_ratio") -> DataFrame:
    """Percent of the group total, by aggregate and join so that no group is one task's work."""
    totals = rows.groupBy(*by).agg(F.sum(value).alias("_total"))
    return rows.join(totals, by).withColumn(to, 100 * F.col(value) / F.col("_total")).drop("_total")


def _quarter_number(c: str):
    return F.year(c) * 10 + F.quarter(c)


def _quarter_name(c: str):
    return F.concat(F.expr(f"cast({c} div 10 as string)"), F.lit("Q"), (F.col(c) % 10).cast("string"))


def fund_holdings(spark, d) -> DataFrame:
    """Quarterly holdings; sums are taken on the numeric keys, ratios by the names that later steps group by."""
    rows = (
        table(spark, d, "lineitem")
        .groupBy("l_suppkey", _quarter_number("l_shipdate").alias("q"), "l_partkey")
        .agg(F.sum("l_extendedprice").alias("hold_market_value"))
    )
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        code6("l_suppkey").alias("fund_code"), _quarter_name("q").alias("quarter"),
        F.when(F.col("p_type") == "PROMO", "bond").otherwise("stock").alias("holding_type"),
        code6("l_partkey").alias("asset_code"), F.col("p_name").alias("asset_name"), "hold_market_value")
    return with_ratio(rows, ["fund_code", "quarter"])


def holdings_overlap(spark, d, wanted: DataFrame | None = None) -> DataFrame:
    """Yearly holdings on a small set of assets, so that funds overlap; with `wanted` (fund_code, quarter) those only."""
    lines = table(spark, d, "lineitem")
    if wanted is not None:
        years = wanted.select("fund_code", F.substring_index("quarter", "Q", 1).cast("int").alias("_y"))
        lines = lines.join(
            years, (code6("l_suppkey") == F.col("fund_code")) & (F.year("l_shipdate") == F.col("_y")), "left_semi")
    rows = (
        lines
        .groupBy("l_suppkey", F.year("l_shipdate").alias("y"), (F.col("l_partkey") % 97).alias("a"))
        .agg(F.sum("l_extendedprice").alias("hold_market_value"))
    )
    rows = cut_lineage(rows)  # the ratios read them twice
    return with_ratio(rows, ["l_suppkey", "y"]).select(
        code6("l_suppkey").alias("fund_code"), F.concat(F.col("y").cast("string"), F.lit("Q4")).alias("quarter"),
        F.lit("stock").alias("holding_type"), code6("a").alias("asset_code"),
        F.concat(F.lit("stock "), code6("a")).alias("asset_name"), "hold_market_value", "hold_ratio")


def overlap_quarters(spark, d) -> DataFrame:
    """The distinct quarters of holdings_overlap, without its sums."""
    return table(spark, d, "lineitem").where(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()).select(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("Q4")).alias("quarter")).distinct()


def brand_holdings(spark, d) -> DataFrame:
    """Quarterly holdings of the brand funds on 50 assets."""
    rows = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", _quarter_number("l_shipdate").alias("q"), (F.col("l_suppkey") % 50).alias("a"))
        .agg(F.sum("l_extendedprice").alias("hold_market_value"))
    )
    return with_ratio(rows, ["p_brand", "q"]).select(
        F.col("p_brand").alias("fund_code"), _quarter_name("q").alias("quarter"), F.lit("stock").alias("holding_type"),
        code6("a").alias("asset_code"), F.concat(F.lit("stock "), code6("a")).alias("asset_name"), "hold_market_value", "hold_ratio")


def brand_funds(spark, d) -> DataFrame:
    """The brand funds with a company, a type, a size and a first and last value date."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    dates = nav_weekly(spark, d).groupBy("fund_code").agg(
        F.min("trade_date").alias("establish_date"), F.max("trade_date").alias("last_date"))
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    return brands.join(dates, F.col("p_brand") == F.col("fund_code")).select(
        F.col("fund_code").alias("code"), F.col("fund_code").alias("name"), F.lit("股票型").alias("type"),
        F.concat(F.lit("Company "), (number % 8).cast("string")).alias("company"),
        (F.col("price") / 20).alias("scale"), "establish_date", "last_date",
    )


L1_OF_TYPE = {"MEDIUM": "电子", "STANDARD": "通信", "SMALL": "医药生物", "LARGE": "银行", "ECONOMY": "新行业"}


def stock_industry(spark, d) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    l1 = F.coalesce(F.create_map(*[F.lit(x) for kv in L1_OF_TYPE.items() for x in kv])[kind], F.lit(""))
    return table(spark, d, "part").select(
        code6("p_partkey").alias("stock_code"),
        l1.alias("sw_l1"), F.col("p_brand").alias("sw_l2"),
        F.when(size % 3 == 0, "").otherwise(F.concat("p_brand", F.lit("-"), (size % 7).cast("string"))).alias("sw_l3"),
        F.when(size % 5 == 0, "").when(l1 == "", "软件服务").otherwise(l1).alias("em_industry"),
        F.when(size == 50, 1).otherwise(0).alias("manual"),
    )


def trade_dates(spark, d) -> DataFrame:
    return (
        table(spark, d, "orders")
        .where(F.dayofweek("o_orderdate").between(2, 6))
        .select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct()
    )


def holding_txns(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("portfolio_id"),
        code6(F.col("o_custkey") % 100).alias("fund_code"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("txn_type"),
        F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_totalprice").alias("amount"),
    )


def user_holdings(spark, d) -> DataFrame:
    """First positions: every third portfolio has none, every fourth has no cost."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").where(k % 3 != 0).select(
        k.alias("portfolio_id"), code6(k % 100).alias("fund_code"),
        F.abs("c_acctbal").alias("market_value"),
        F.when(k % 4 != 0, F.abs("c_acctbal") * 0.8734567).alias("cost"),
        F.lit(None).cast("double").alias("base_shares"),
    )


def portfolio_positions(spark, d) -> DataFrame:
    """Held amounts: customers of one nation form a portfolio, spread over the supplier funds."""
    n_funds = 100
    return (
        table(spark, d, "customer")
        .groupBy(F.col("c_nationkey").alias("portfolio_id"), code6(F.col("c_custkey") % n_funds).alias("fund_code"))
        .agg(F.sum(F.abs("c_acctbal")).alias("market_value"), F.sum(F.abs("c_acctbal") * 0.8734567).alias("cost"))
        .withColumn("cost", F.when(F.col("portfolio_id") % 5 != 0, F.col("cost")))
    )


def fund_manager_tenure(spark, d) -> DataFrame:
    rows = numbered(
        table(spark, d, "orders"), ["o_custkey"], "o_orderdate",
        [F.desc("o_orderdate"), F.desc("o_orderkey")], "n", descending=True)
    rows = rows.select(
        "o_custkey", "n", F.col("o_orderpriority").alias("managers"), F.col("o_orderdate").cast("date").alias("start_date"))
    return neighbour(rows, ["o_custkey"], "n", -1, {"start_date": "end_date"}).select(
        code6("o_custkey").alias("fund_code"), (F.col("n") - 1).cast("int").alias("seq"), "managers", "start_date", "end_date")


def signals(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").where(kind.isin("purchase", "signup", "error")).select(
        "event_id", "ts", "user_id",
        F.when(kind == "error", "SELL").otherwise("BUY").alias("action"), "value",
    )


def timing_signals(spark, d) -> DataFrame:
    """One market call a month: the events of day n of the log speak for month n after January 1998."""
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    worth = F.sum(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))
                  .when(F.col("event_type") == "error", -2 * F.col("value")).otherwise(F.lit(0.0)))
    return (
        table(spark, d, "events").groupBy(day.alias("n")).agg(worth.alias("worth"))
        .select(
            F.add_months(F.lit("1998-01-05").cast("date"), F.col("n").cast("int")).alias("trade_date"),
            F.when(F.col("worth") > 0, "BUY").otherwise("SELL").alias("action"),
        )
    )


def sync_status(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", "ts",
        F.when(kind.isin("view", "click", "purchase"), "success").when(kind == "signup", "skip").otherwise("fail").alias("status"),
    )


def snapshots(spark, d) -> DataFrame:
    """Saved screens: the funds of one nation as a JSON list."""
    item = F.struct(code6("s_suppkey").alias("code"),
                    F.concat(F.lit("Fund "), F.expr("cast(s_suppkey div 2 as string)"),
                             F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("C")).alias("name"),
                    (F.col("s_acctbal") / 20).alias("scale"))
    # lists of at most 500 members each
    return (
        table(spark, d, "supplier")
        .groupBy(F.col("s_nationkey").alias("preset_id"), F.expr("s_suppkey div 500").alias("part"))
        .agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items_json"))
    )
