"""Whole records: funds with holdings and analysis, excluded members, holdings by theme, and tables that are written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from navloom.operators import windows as W
from navloom.plans.columns import f32, r6
from navloom.plans.registry import query
from navloom.plans.screen import presets
from navloom.plans.views import f32 as sql32
from navloom.session import ensure_checkpoint_dir
from navloom.sources import adapters as A
from navloom.sources import sinks as K


def analysis(spark, d):
    return A.fund_ai(spark, d).select("fund_code", "luck_verdict", "rating", "skill_score")


def new_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stores/{name}-{uuid.uuid4().hex}"


# ---- one record per fund -------------------------------------------------------------------------

TOP_SQL = """
newest as (select fund_code, holding_type, max(quarter) as quarter from fund_holdings group by 1,2),
top as (select * from (select h.*, row_number() over (partition by fund_code, holding_type order by hold_ratio desc, asset_code) rk
  from fund_holdings h join newest using (fund_code, holding_type, quarter)) where rk<=10),
tops as (select fund_code, string_agg(holding_type||':'||rk||':'||asset_code, ',' order by holding_type, rk) top_holdings,
  max(quarter) newest_quarter from top group by 1)"""


@query("fund_record", "J26", "nav_daily funds fund_details fund_ai fund_holdings", f"""
with {TOP_SQL}, n as (select fund_code, max(trade_date) trade_date, arg_max(nav, trade_date) nav from nav_daily group by 1)
select f.code, f.name, f.type, d.fund_company, round(d.sharpe_3y,6) sharpe_3y, n.trade_date, {sql32('n.nav')} nav,
 t.newest_quarter, t.top_holdings, a.luck_verdict, a.rating, a.skill_score
from funds f left join fund_details d on d.fund_code=f.code left join n on n.fund_code=f.code left join tops t on t.fund_code=f.code
 left join fund_ai a on a.fund_code=f.code""")
def fund_record(spark, d):
    """Detail, newest value, newest top ten per holding type and analysis of every fund."""
    top = W.top_holdings(A.fund_holdings(spark, d), 10)
    entry = F.struct("holding_type", "rank", "asset_code")
    tops = top.groupBy("fund_code").agg(
        F.array_sort(F.collect_list(entry)).alias("h"), F.max("quarter").alias("newest_quarter")).select(
        "fund_code", "newest_quarter", F.array_join(F.transform("h", lambda x: F.concat_ws(
            ":", x["holding_type"], x["rank"].cast("string"), x["asset_code"])), ",").alias("top_holdings"))
    last = W.latest(A.nav_daily(spark, d), ["fund_code"], "trade_date", ["trade_date", "nav"])
    out = A.funds(spark, d).withColumnRenamed("code", "fund_code").select("fund_code", "name", "type")
    for part in (A.fund_details(spark, d).select("fund_code", "fund_company", "sharpe_3y"), last, tops, analysis(spark, d)):
        out = out.join(part, "fund_code", "left")
    return out.select(F.col("fund_code").alias("code"), "name", "type", "fund_company", *r6("sharpe_3y"),
                      "trade_date", *f32("nav"), "newest_quarter", "top_holdings", "luck_verdict", "rating", "skill_score")


@query("nav_recent_with_analysis", "J8", "nav_daily fund_ai", f"""
select fund_code, trade_date, {sql32('coalesce(acc_nav,nav)')} as value, luck_verdict, rating, skill_score
from (select *, row_number() over (partition by fund_code order by trade_date desc) rn from nav_daily) left join fund_ai using (fund_code)
where rn<=60 and coalesce(acc_nav,nav) is not null""")
def nav_recent_with_analysis(spark, d):
    rows = W.recent_points(A.nav_daily(spark, d), 60).join(analysis(spark, d), "fund_code", "left")
    return rows.select("fund_code", "trade_date", *f32("value"), "luck_verdict", "rating", "skill_score")


# ---- members of saved screens --------------------------------------------------------------------

@query("preset_excluded_rows", "J30", "funds fund_details", """
select n_nationkey preset_id, printf('%06d', n_nationkey) code, f.name, f.type, d.fund_company, f.code is not null known
from nation left join funds f on f.code=printf('%06d', n_nationkey) left join fund_details d on d.fund_code=f.code""")
def preset_excluded_rows(spark, d):
    """The excluded codes of every saved screen as full rows; codes without a fund stay, marked."""
    codes = presets(spark, d).select("preset_id", F.explode("filters.exclude_codes").alias("code"))
    funds = A.funds(spark, d).select("code", "name", "type", F.lit(True).alias("known"))
    details = A.fund_details(spark, d).select(F.col("fund_code").alias("code"), "fund_company")
    return codes.join(funds, "code", "left").join(details, "code", "left").select(
        "preset_id", "code", "name", "type", "fund_company", F.coalesce("known", F.lit(False)).alias("known"))


@query("snapshot_members_filtered", "J31", "snapshot_items fund_ai", """
select preset_id, code, name, luck_verdict from snapshot_items left join fund_ai on fund_code=code
where code in (select printf('%06d', c_nationkey) from customer) or name ilike '%fund 2%'""")
def snapshot_members_filtered(spark, d):
    """Members of saved screens that are in a code set or whose name has a keyword."""
    from navloom.sources.landed import snapshot_items

    wanted = A.table(spark, d, "customer").select(A.code6("c_nationkey").alias("code"), F.lit(True).alias("_in")).distinct()
    rows = snapshot_items(A.snapshots(spark, d)).join(wanted, "code", "left").where(
        F.col("_in").isNotNull() | F.col("name").ilike("%fund 2%"))
    return rows.join(analysis(spark, d).withColumnRenamed("fund_code", "code"), "code", "left").select(
        "preset_id", "code", "name", "luck_verdict")


# ---- a portfolio by theme --------------------------------------------------------------------------

@query("held_by_theme", "C24", "funds portfolio_positions", """
with th as (select printf('%06d', s_suppkey) fund_code, case when s_suppkey%6<>0 then s_nationkey%8+1 end cluster_id from supplier),
h as (select p.*, cluster_id from portfolio_positions p left join th using (fund_code)),
t as (select portfolio_id, sum(market_value) total from h group by 1)
select portfolio_id, cluster_id, cluster_id is null outside, count(*) funds, round(sum(market_value),4) market_value,
 round(sum(cost),4) as cost, round(sum(market_value)/any_value(total),8) share, string_agg(fund_code, ',' order by market_value desc, fund_code) fund_codes
from h join t using (portfolio_id) group by 1,2,3""")
def held_by_theme(spark, d):
    """Every portfolio's holdings by theme, with one outside group for funds of no theme."""
    k = F.col("s_suppkey")
    themes = A.table(spark, d, "supplier").select(
        A.code6("s_suppkey").alias("fund_code"), F.when(k % 6 != 0, F.col("s_nationkey") % 8 + 1).alias("cluster_id"))
    held = A.portfolio_positions(spark, d).join(themes, "fund_code", "left")
    totals = held.groupBy("portfolio_id").agg(F.sum("market_value").alias("total"))
    order = F.struct((-F.col("market_value")).alias("v"), "fund_code")
    groups = held.groupBy("portfolio_id", "cluster_id").agg(
        F.count("*").alias("funds"), F.sum("market_value").alias("market_value"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(order)).alias("_f"))
    return groups.join(totals, "portfolio_id").select(
        "portfolio_id", "cluster_id", F.col("cluster_id").isNull().alias("outside"), "funds", *r6("market_value", "cost", digits=4),
        F.round(F.col("market_value") / F.col("total"), 8).alias("share"),
        F.array_join(F.transform("_f", lambda x: x["fund_code"]), ",").alias("fund_codes"))


# ---- tables that are written and read again ---------------------------------------------------------

@query("replace_all", "K1", "funds", "select code, name, type from funds where cast(code as bigint)%2=0")
def replace_all(spark, d):
    """The fund list replaced as a whole: what the second load doesn't have is gone."""
    path, funds = new_path(spark, "funds"), A.funds(spark, d).select("code", "name", "type")
    K.replace_all(funds, path)
    K.replace_all(funds.where(F.col("code").cast("bigint") % 2 == 0), path)
    return spark.read.schema(funds.schema).parquet(path)


@query("nav_partitions_upsert", "K2 K7", "nav_daily", f"""
select fund_code, trade_date, {sql32("case when year(trade_date)=2000 then nav*2 else nav end")} nav, year(trade_date)=2000 touched from nav_daily""")
def nav_partitions_upsert(spark, d):
    """An increment of one year is merged into a table by year: only that partition is read and written again."""
    path = new_path(spark, "nav")
    rows = A.nav_daily(spark, d).select("fund_code", "trade_date", "nav", F.lit(False).alias("touched"), F.year("trade_date").alias("y"))
    K.replace_all(rows, path, ["y"])
    new = rows.where("y = 2000").withColumn("nav", F.col("nav") * 2).withColumn("touched", F.lit(True))
    K.upsert_partitions(spark, new, path, ["fund_code", "trade_date"], "y")
    return spark.read.schema(rows.schema).parquet(path).select("fund_code", "trade_date", *f32("nav"), "touched")


@query("saved_results", "K10", "", """
select user_id, event_id, round(value,4) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn=1""")
def saved_results(spark, d):
    """Results are appended by two runs and the newest of every user is read back."""
    path = new_path(spark, "results")
    rows = A.table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("created_at"), "value")
    for half in (0, 1):
        K.append(rows.where(F.col("event_id") % 2 == half), path)
    return K.latest_result(spark.read.schema(rows.schema).parquet(path)).select("user_id", "event_id", *r6("value", digits=4))


@query("bulk_positions", "K12", "", """
with r as (select c_nationkey portfolio_id, case when c_custkey%9=0 then null else printf('%06d', c_custkey%100) end fund_code, ' Fund '||c_custkey%100||' ' n,
  case c_custkey%7 when 0 then '' when 1 then 'n/a' else cast(c_custkey*10 as varchar) end mv, case when c_custkey%5=0 then '-' else cast(c_custkey as varchar) end as c, c_custkey ord from customer),
k as (select *, case when mv='' then 0.0::double else try_cast(mv as double) end market_value from r)
select portfolio_id, fund_code, trim(arg_max(n,ord)) fund_name, arg_max(market_value,ord) market_value, arg_max(struct_pack(v:=try_cast(c as double)),ord).v as cost
from k where market_value is not null and fund_code is not null group by 1,2""")
def bulk_positions(spark, d):
    """Positions loaded from text: numbers parsed, rows without a code dropped, the last row of a code kept, then stored."""
    k = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("portfolio_id"), F.when(k % 9 != 0, A.code6(k % 100)).alias("resolved_code"),
        F.concat(F.lit(" Fund "), (k % 100).cast("string"), F.lit(" ")).alias("fund_name"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "n/a").otherwise((k * 10).cast("string")).alias("market_value"),
        F.when(k % 5 == 0, "-").otherwise(k.cast("string")).alias("cost"), k.alias("ord"))
    path, clean = new_path(spark, "positions"), K.clean_positions(rows)
    K.replace_all(clean, path, ["portfolio_id"])
    stored = spark.read.schema(clean.schema).parquet(path)
    return stored.select(F.col("portfolio_id").cast("bigint").alias("portfolio_id"), "fund_code", "fund_name", "market_value", "cost")
