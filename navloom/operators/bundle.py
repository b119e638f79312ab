"""Manager attribution, regime returns and the feature record of a fund."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navloom.functions import scalars as X
from navloom.operators import holdings as O
from navloom.operators.joins import forward_first
from navloom.session import cut_lineage


def manager_attribution(tenure: DataFrame, as_of: str) -> DataFrame:
    """Current team and lead: since when, covering which years, after how many teams.

    tenure: fund_code, seq (0 = newest), managers, start_date. A run from the newest segment
    ends before the first segment that differs; its start is looked up by sequence number.
    """
    day = F.lit(as_of).cast("date")
    rows = cut_lineage(tenure.select("fund_code", "seq", "start_date", F.trim("managers").alias("team")))
    current = rows.where(F.col("seq") == 0).select(
        "fund_code", F.col("team").alias("cur_team"), F.split("team", r"\s+")[0].alias("lead"))
    marked = rows.join(current, "fund_code")
    breaks = marked.groupBy("fund_code", "cur_team", "lead").agg(
        F.count("*").alias("segment_count"),
        F.min(F.when(F.col("team") != F.col("cur_team"), F.col("seq"))).alias("_team_break"),
        F.min(F.when(~F.array_contains(F.split("team", r"\s+"), F.col("lead")), F.col("seq"))).alias("_lead_break"))
    starts = rows.select("fund_code", "seq", "start_date")

    def since(break_col, name):
        last = F.coalesce(F.col(break_col), F.col("segment_count")) - 1
        at = breaks.select("fund_code", last.alias("seq"))
        return at.join(starts, ["fund_code", "seq"], "left").select("fund_code", F.col("start_date").alias(name))

    older = rows.select("fund_code", (F.col("seq") - 1).alias("seq"), F.col("team").alias("_older"))
    changes = rows.join(older, ["fund_code", "seq"]).groupBy("fund_code").agg(
        F.count_if(F.col("team") != F.col("_older")).alias("_changes"))
    out = (
        breaks.join(since("_team_break", "exact_team_since"), "fund_code")
        .join(since("_lead_break", "lead_since"), "fund_code").join(changes, "fund_code", "left"))
    cover = [
        (F.col(f"{who}_since") <= X.years_ago(day, y)).alias(f"{who}_covers_{y}y")
        for who in ("exact_team", "lead") for y in (1, 3, 5)]
    return out.select(
        "fund_code", "cur_team", "lead", (F.size(F.split("cur_team", r"\s+")) > 1).alias("is_comanaged"),
        "exact_team_since", "lead_since", X.years_in_post("exact_team_since", day).alias("exact_team_years"),
        X.years_in_post("lead_since", day).alias("lead_years"), "segment_count",
        (F.coalesce("_changes", F.lit(0)) + 1).alias("distinct_team_count"), *cover)


def regime_returns(cum: DataFrame, starts: DataFrame, as_of: str) -> DataFrame:
    """Percent return over the last year, the last three and since the current team.

    cum: fund_code, trade_date, cum_return (percent since inception); starts: fund_code, exact_team_since.
    """
    day = F.lit(as_of).cast("date")
    rows = cum.where(F.col("cum_return").isNotNull()).join(starts.select("fund_code", "exact_team_since"), "fund_code", "left")
    rows = rows.withColumn("_1y", X.years_ago(day, 1)).withColumn("_3y", X.years_ago(day, 3))
    last = F.max_by("cum_return", "trade_date")

    def between(start):
        base = forward_first(start, "trade_date", "cum_return")
        return ((1 + last / 100) / (1 + base / 100) - 1) * 100

    return rows.groupBy("fund_code").agg(
        F.count("*").alias("points"), between("_1y").alias("return_last_1y"), between("_3y").alias("return_last_3y"),
        between("exact_team_since").alias("return_since_current_team")).where(F.col("points") >= 2)


def holdings_record(holdings: DataFrame, industry: DataFrame) -> DataFrame:
    """What a fund's record says of its holdings, one row per fund with quarters in order.

    quarters: report type, concentration, the five largest industries and four largest themes of the top ten with
    their shares, and the leading ones; overlaps: shared top stocks of adjacent quarters; latest: the newest top ten;
    besides the trends and the sector focus. A fund has a few quarters of ten rows each, so its lists are bounded.
    """
    key = ["fund_code", "quarter"]
    top = O.quarter_tops(holdings, industry)
    profile = cut_lineage(O.quarter_profile(holdings, industry, top))

    def mix(name: str, most: int) -> DataFrame:
        sums = top.groupBy(*key, name).agg(F.sum("hold_ratio").alias("ratio"))
        listed = sums.groupBy(*key).agg(
            F.sum("ratio").alias("_all"), F.sort_array(F.collect_list(F.struct((-F.col("ratio")).alias("r"), F.col(name).alias("k")))).alias("_m"))
        return listed.select(*key, F.transform(F.slice("_m", 1, most), lambda m: F.struct(
            m["k"].alias(name), (-m["r"]).alias("ratio"), F.try_divide(-m["r"], F.col("_all") / 100).alias("share"))).alias(f"{name}_mix"))

    first = top.where(F.col("rank") == 1).select(*key, F.struct(
        F.col("asset_name").alias("name"), F.col("hold_ratio").alias("ratio"), F.col("own_l1").alias("l1")).alias("top1"))
    whole = profile.join(mix("l1", 5), key).join(mix("theme", 4), key).join(first, key)
    shown = ["quarter", F.when(F.col("is_full_report"), "全量(半年/年报)").otherwise("前十大(季报)").alias("report_type"), "num_stock", "top1",
             "top3_ratio", "top5_ratio", "top10_ratio", "hhi_top10", "l1_mix", "top_l1", "top_l1_share", "distinct_l1", "theme_mix",
             "top_theme", "top_theme_share", "l1_mapped"]
    quarters = whole.groupBy("fund_code").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("quarters_detail"))
    overlaps = O.quarter_overlaps(profile).groupBy("fund_code").agg(
        F.sort_array(F.collect_list(F.struct("from_quarter", "to_quarter", "overlap", "of"))).alias("overlaps"))
    newest = top.groupBy("fund_code").agg(F.max("quarter").alias("quarter"))
    latest = top.join(newest, key, "left_semi").groupBy("fund_code").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("asset_name").alias("name"), "l1", "theme", F.nullif(F.col("sw_l3"), F.lit("")).alias("l3"),
        F.col("hold_ratio").alias("ratio")))).alias("latest_top10"))
    out = O.holdings_summary(profile).join(quarters, "fund_code").join(overlaps, "fund_code", "left").join(latest, "fund_code")
    seq = lambda c: F.transform("quarters_detail", lambda q: q[c])
    edge = lambda i: F.element_at("quarters_detail", i)["quarter"]
    return out.withColumn("coverage", F.concat(edge(1), F.lit("~"), edge(-1))).withColumn(
        "dominant_l1_by_quarter", seq("top_l1")).withColumn("dominant_theme_by_quarter", seq("top_theme"))


def fund_bundle(details: DataFrame, managers: DataFrame, summary: DataFrame, regimes: DataFrame) -> DataFrame:
    """One nested record per fund, as JSON, with the caveats on its data."""
    part = lambda df, name: df.select("fund_code", F.struct(*[c for c in df.columns if c != "fund_code"]).alias(name))
    rows = details.select("fund_code", F.struct(*[c for c in details.columns if c != "fund_code"]).alias("meta"))
    for df, name in ((managers, "manager"), (summary, "holdings"), (regimes, "nav_regime")):
        rows = rows.join(part(df, name), "fund_code", "left")
    caveats = F.array_compact(F.array(
        F.when(F.col("manager.distinct_team_count") > 1, F.concat(
            F.lit("历史换过 "), F.col("manager.distinct_team_count").cast("string"), F.lit(" 个不同团队；长周期指标未必归当前团队"))),
        F.when(F.col("holdings").isNull(), F.lit("无持仓数据"))))
    rows = rows.withColumn("data_caveats", caveats)
    record = F.to_json(F.struct("fund_code", "meta", "manager", "holdings", "nav_regime", "data_caveats"))
    return rows.withColumn("bundle", record)
