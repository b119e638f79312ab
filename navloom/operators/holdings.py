"""Holdings: industry pages, profiles, concentration, drift, look-through."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.functions import scalars as X
from navloom.operators.windows import top_holdings
from navloom.operators.timeline import visible_totals
from navloom.session import cut_lineage


# ---- held stocks and their industries -----------------------------------------------------

def held_stocks(holdings: DataFrame) -> DataFrame:
    """Distinct held stocks with one of their names."""
    return holdings.where((F.col("holding_type") == "stock") & (F.coalesce("asset_code", F.lit("")) != "")).groupBy(
        F.col("asset_code").alias("stock_code")).agg(F.min("asset_name").alias("held_name"))


def industry_page(holdings: DataFrame, industry: DataFrame) -> DataFrame:
    """Held stocks with market, coverage and label; a missing market is read from the code's shape."""
    m = held_stocks(holdings).join(industry, "stock_code", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    stored = X.blank_to_null("market") if "market" in industry.columns else F.lit(None).cast("string")
    covered = (text("sw_l3") != "") | (text("em_industry") != "")
    return m.select(
        "stock_code", F.col("held_name").alias("stock_name"),
        F.coalesce(stored, X.market_by_shape("stock_code")).alias("market"),
        text("sw_l1").alias("sw_l1"), text("sw_l2").alias("sw_l2"), text("sw_l3").alias("sw_l3"),
        text("em_industry").alias("em_industry"), F.coalesce("manual", F.lit(0)).alias("manual"), covered.alias("covered"),
        F.when(covered, F.coalesce(X.blank_to_null("sw_l3"), X.blank_to_null("sw_l2"), X.blank_to_null("em_industry")))
        .otherwise("").alias("label"))


def marked_markets(held: DataFrame, industry: DataFrame) -> DataFrame:
    stored = F.col("market") if "market" in industry.columns else F.lit(None).cast("string")
    return held.join(industry, "stock_code", "left").withColumn("market_of", X.market_of("stock_code", stored))


def coverage(held: DataFrame, industry: DataFrame) -> DataFrame:
    """One row: held, by market, covered by which source."""
    m = marked_markets(held, industry)
    sw = F.coalesce("sw_l3", F.lit("")) != ""
    em = F.coalesce("em_industry", F.lit("")) != ""
    a, hk = F.col("market_of").isin("A", "BJ"), F.col("market_of") == "HK"
    listed = F.col("market_of") != "OTHER"
    n = lambda c: F.count_if(c)
    one = m.agg(
        n(listed).alias("held_total"), n(a).alias("a_total"), n(hk).alias("hk_total"), n(~listed).alias("other_total"),
        n(a & sw).alias("a_sw_covered"), n(a & ~sw & em).alias("a_em_covered"), n(a & ~sw & ~em).alias("a_uncovered"),
        n(hk & (sw | em)).alias("hk_covered"), n(hk & ~(sw | em)).alias("hk_uncovered"), n(listed & (sw | em)).alias("covered_total"))
    pct = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y) * 100).otherwise(0.0)
    l3 = industry.agg(F.count_distinct(X.blank_to_null("sw_l3"))).scalar()
    return one.withColumn("coverage_pct", pct("covered_total", "held_total")).withColumn(
        "a_sw_pct", pct("a_sw_covered", "a_total")).withColumn("sw_l3_count", l3)


def label_breakdown(held: DataFrame, industry: DataFrame) -> DataFrame:
    joined = held.join(industry.withColumn("_known", F.lit(1)), "stock_code", "left")
    label = F.when(F.col("_known").isNull(), "未覆盖").otherwise(X.industry_label())
    return joined.groupBy(label.alias("label")).agg(F.count("*").alias("count"))


def uncovered(held: DataFrame, industry: DataFrame, markets: list[str]) -> DataFrame:
    """Held stocks without any label on the wanted markets."""
    m = marked_markets(held, industry)
    wanted = X.any_of([F.col("market_of").isin("A", "BJ") if k == "A" else F.col("market_of") == k for k in markets])
    none = (F.coalesce("sw_l3", F.lit("")) == "") & (F.coalesce("em_industry", F.lit("")) == "")
    return m.where(none & wanted).select("stock_code", "market_of")


def overseas_lookalikes(held: DataFrame, master: DataFrame) -> DataFrame:
    """Codes shaped like mainland stocks that the master list does not know."""
    return held.where(X.classify_market("stock_code") == "A").join(master, "stock_code", "left_anti").select(
        "stock_code", F.lit("OTHER").alias("market"))


def with_industry(holdings: DataFrame, industry: DataFrame) -> DataFrame:
    i = industry.select(F.col("stock_code").alias("asset_code"), "sw_l1", "sw_l2", "sw_l3", "em_industry")
    return holdings.join(i, "asset_code", "left").withColumn("label", X.industry_label())


# ---- profiles --------------------------------------------------------------------------------

def profiles(items: DataFrame, industry: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fund x stock, fund x industry, dropped funds) of sets of funds, in long form.

    items: by + fund_code, holding_type, asset_code, hold_ratio.
    """
    ok = (F.col("holding_type") == "stock") & (F.coalesce("asset_code", F.lit("")) != "") & (F.coalesce("hold_ratio", F.lit(0.0)) != 0)
    key = [*by, "fund_code"]
    held = items.where(ok).groupBy(*key, "asset_code").agg(F.sum("hold_ratio").alias("ratio"))
    rows = cut_lineage(with_industry(held, industry).select(*key, "asset_code", "label", "ratio"))
    stocks = rows.select(*key, F.col("asset_code").alias("key"), "ratio")
    industries = rows.groupBy(*key, F.col("label").alias("key")).agg(F.sum("ratio").alias("ratio"))
    dropped = items.select(*key).distinct().join(stocks.select(*key).distinct(), key, "left_anti")
    return stocks, industries, dropped


def industry_vectors(holdings: DataFrame, industry: DataFrame, limit: int = 10) -> DataFrame:
    """Industry shares of the newest top stocks per fund."""
    top = top_holdings(holdings.where(F.col("holding_type") == "stock"), limit)
    return with_industry(top, industry).groupBy("fund_code", "label").agg(F.sum("hold_ratio").alias("ratio"))


# ---- quarters ----------------------------------------------------------------------------------

def available_quarters(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("fund_code", "holding_type").agg(
        F.reverse(F.array_sort(F.collect_set("quarter"))).alias("quarters"))


def quarter_distances(holdings: DataFrame, by: list[str] = ("fund_code",)) -> DataFrame:
    """Distance of every quarter to the one before: sum|a-b| / sum(a+b), from shared assets and totals.

    One row (by, quarter, distance) for each quarter that has an earlier one.
    """
    by = list(by)
    now = cut_lineage(holdings.groupBy(*by, "quarter", "asset_code").agg(F.sum("hold_ratio").alias("a")))
    totals = now.groupBy(*by, "quarter").agg(F.sum("a").alias("total"))
    seq = Window.partitionBy(*by).orderBy("quarter")  # quarters of a fund
    totals = totals.withColumn("next", F.lead("quarter").over(seq)).withColumn("next_total", F.lead("total").over(seq))
    later = now.select(*by, F.col("quarter").alias("next"), "asset_code", F.col("a").alias("b"))
    shared = (
        now.join(totals.select(*by, "quarter", "next"), [*by, "quarter"]).join(later, [*by, "next", "asset_code"])
        .groupBy(*by, "quarter").agg(F.sum(F.least("a", "b")).alias("common"))
    )
    den = F.col("total") + F.col("next_total")
    pairs = totals.where(den > 0).join(shared, [*by, "quarter"], "left")
    return pairs.select(*by, F.col("next").alias("quarter"),
                        ((den - 2 * F.coalesce("common", F.lit(0.0))) / den).alias("distance"))


def style_drift(holdings: DataFrame, by: list[str] = ("fund_code",)) -> DataFrame:
    """Mean distance of adjacent quarters."""
    return quarter_distances(holdings, by).groupBy(*by).agg(F.avg("distance").alias("drift"))


def drift_at(holdings: DataFrame, dates: DataFrame) -> DataFrame:
    """Mean distance of the adjacent quarters visible at each date: (as_of, fund_code, drift).

    Two quarters are compared once, whatever the dates; a date takes the running mean at the last quarter it sees.
    """
    pairs = quarter_distances(holdings).select("fund_code", "quarter", "distance", F.lit(1).alias("n"))
    seen = visible_totals(pairs, dates, ["fund_code"], ["distance", "n"])
    return seen.select("as_of", "fund_code", (F.col("distance") / F.col("n")).alias("drift"))


def quarter_tops(holdings: DataFrame, industry: DataFrame) -> DataFrame:
    """The ten largest stocks of every fund and quarter with industry and theme, and how many stocks there are."""
    stocks = holdings.where((F.col("holding_type") == "stock") & F.col("hold_ratio").isNotNull())
    counted = stocks.withColumn("num_stock", F.count("*").over(Window.partitionBy("fund_code", "quarter")))
    top = with_industry(top_holdings(counted, 10, newest_only=False, by=["fund_code"]), industry)
    l1 = X.effective_l1()
    return cut_lineage(top.withColumn("own_l1", F.nullif(l1, F.lit(""))).withColumn(
        "l1", F.when(l1 == "", "未知").otherwise(l1)).withColumn("theme", X.theme_of(l1)))


def quarter_profile(holdings: DataFrame, industry: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Concentration and industry structure of every fund and quarter; `top` has its quarter_tops, if there already."""
    key = ["fund_code", "quarter"]
    top = quarter_tops(holdings, industry) if top is None else top  # ten rows per fund and quarter, used three times below
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hold_ratio")))
    shape = top.groupBy(*key).agg(
        F.max("num_stock").alias("num_stock"), upto(1).alias("top1_ratio"), upto(3).alias("top3_ratio"), upto(5).alias("top5_ratio"), upto(10).alias("top10_ratio"),
        F.sum(F.pow(F.col("hold_ratio") / 100, 2)).alias("hhi_top10"), F.count_if(F.col("l1") != "未知").alias("l1_mapped"),
        F.max(F.when(F.col("rank") == 1, F.col("asset_name"))).alias("top1_name"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_code"))), lambda s: s["asset_code"]).alias("codes_top10"))

    def mix(name):
        sums = top.groupBy(*key, F.col(name).alias("k")).agg(F.sum("hold_ratio").alias("v"))
        known = ~F.col("k").isin("未知", "其他")
        return sums.groupBy(*key).agg(
            F.max_by(F.struct("k", "v"), F.struct(known.alias("known"), F.col("v"))).alias("t"),
            F.sum("v").alias("all"), F.count_if(known).alias(f"distinct_{name}"),
        ).select(*key, F.col("t.k").alias(f"top_{name}"), (F.col("t.v") / F.col("all") * 100).alias(f"top_{name}_share"), f"distinct_{name}")

    return (
        shape.join(mix("l1"), key).join(mix("theme"), key)
        .withColumn("is_full_report", F.col("num_stock") > 15)
    )


def quarter_overlaps(profile: DataFrame) -> DataFrame:
    """Shared top stocks of adjacent quarters."""
    seq = Window.partitionBy("fund_code").orderBy("quarter")
    nxt = F.lead("codes_top10").over(seq)
    return profile.select(
        "fund_code", F.col("quarter").alias("from_quarter"), F.lead("quarter").over(seq).alias("to_quarter"),
        F.size(F.array_intersect("codes_top10", nxt)).alias("overlap"),
        F.least(F.size("codes_top10"), F.size(nxt)).alias("of")).where(F.col("to_quarter").isNotNull())


def holdings_summary(profile: DataFrame) -> DataFrame:
    """Trends over the quarters and the sector-focus class of each fund."""
    first, last = (lambda c: F.min_by(c, "quarter")), (lambda c: F.max_by(c, "quarter"))
    known = ~F.col("top_theme").isin("未知", "其他")
    agg = profile.groupBy("fund_code").agg(
        F.count("*").alias("quarters"), first("top10_ratio").alias("_t0"), last("top10_ratio").alias("_t1"),
        first("top_theme_share").alias("_s0"), last("top_theme_share").alias("_s1"), last("distinct_l1").alias("latest_l1"),
        F.count_if(known).alias("_doms"), F.count_distinct(F.when(known, F.col("top_theme"))).alias("distinct_dominant_theme"),
        F.avg("top_theme_share").alias("_avg_share"), F.avg("distinct_l1").alias("_avg_l1"),
        last("top_theme").alias("latest_top_theme"), last("top10_ratio").alias("latest_top10_ratio"))
    delta, drift, many = F.col("_t1") - F.col("_t0"), F.col("_s1") - F.col("_s0"), F.col("quarters") >= 2
    stable = (F.col("distinct_dominant_theme") == 1) & (F.col("_doms") >= F.col("quarters") - 1)
    share = F.col("_s1")
    focus = (
        F.when(F.col("_doms") == 0, "未知")
        .when((F.col("latest_l1") >= 7) & (share < 50), "多行业分散(选股型)")
        .when(stable & (share >= 55), "单一主题高度集中(赛道特征)")
        .when(stable & (share >= 42), "单一主题主导(赛道倾向)")
        .when((F.col("distinct_dominant_theme") >= 2) & (F.col("_avg_share") >= 45), "主题轮动(主导主题跨季切换)")
        .when((share < 42) | (F.col("_avg_l1") >= 5), "多行业分散(选股型)")
        .otherwise("较分散/混合")
    )
    return agg.select(
        "fund_code", "quarters",
        F.when(many, F.when(delta > 5, "上升").when(delta < -5, "下降").otherwise("平稳")).alias("concentration_trend"),
        F.when(many & (F.col("_s0") > 0) & (F.col("_s1") > 0),
               F.when(drift > 8, "收敛(更集中)").when(drift < -8, "发散(更分散)").otherwise("稳定")).alias("theme_trend"),
        "distinct_dominant_theme", focus.alias("sector_focus"), "latest_top_theme", share.alias("latest_top_theme_share"),
        "latest_l1", "latest_top10_ratio")


# ---- look-through ---------------------------------------------------------------------------------

def look_through(weights: DataFrame, holdings: DataFrame, industry: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stocks, industries, summary) under weighted funds.

    weights: by + fund_code, weight; holdings: the top stocks per fund. Industry rows add the
    exact stock exposures.
    """
    live = weights.where(F.col("weight") > 0)
    rows = with_industry(live.join(holdings, "fund_code"), industry)
    stocks = cut_lineage(rows.groupBy(*by, "asset_code", "label").agg(
        F.min("asset_name").alias("asset_name"), F.sum(F.col("weight") * F.coalesce("hold_ratio", F.lit(0.0))).alias("exposure"),
        F.count_distinct("fund_code").alias("fund_count")))
    industries = stocks.groupBy(*by, "label").agg(F.sum("exposure").alias("exposure"), F.count("*").alias("stock_count"))
    covered = rows.groupBy(*by).agg(F.count_distinct("fund_code").alias("funds_covered"))
    summary = stocks.groupBy(*by).agg(
        F.count("*").alias("total_stocks"), F.count_if(F.col("fund_count") >= 2).alias("overlap_stocks"),
        F.sum("exposure").alias("visible_position")).join(covered, by)
    return stocks, industries, summary


def max_industry_share(exposures: DataFrame, by: list[str]) -> DataFrame:
    """Largest industry exposure over all exposure."""
    return exposures.groupBy(*by).agg((F.max("exposure") / F.sum("exposure")).alias("max_share"))
