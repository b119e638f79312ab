"""Fund screens, saved filters, snapshots, fund lists and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.functions import scalars as X
from navloom.operators import filters as P
from navloom.operators import joins as J
from navloom.operators import windows as W
from navloom.operators.paging import order_columns, page
from navloom.plans.registry import query
from navloom.session import cut_lineage
from navloom.sources import adapters as A

SCREEN = {
    "keyword": "fund",
    "fund_types": ["股票型", "混合型-偏股", "混合型-灵活"],
    "exclude_codes": ["000003"],
    "name_excludes": ["Fund 1C"],
    "scale_min": 5,
    "conditions": [
        {"field": "sharpe_3y", "op": "gt", "value": 0},
        {"field": "no_such_field", "op": "gt", "value": 1},
        {"field": "position_stock", "op": "lte", "value": 100},
    ],
}
SCREEN_SQL = """f.type in ('股票型','混合型-偏股','混合型-灵活') and (f.code ilike '%fund%' or f.name ilike '%fund%')
    and f.code not in ('000003') and f.name not ilike '%Fund 1C%' and d.scale>=5 and d.sharpe_3y>0 and d.position_stock<=100"""


def joined_funds(spark, d):
    """Funds with their details and analysis, fund columns first."""
    return (
        A.funds(spark, d)
        .join(A.fund_details(spark, d).withColumnRenamed("fund_code", "code").drop("fund_name"), "code", "left")
        .join(A.fund_ai(spark, d).withColumnRenamed("fund_code", "code"), "code", "left")
    )


def latest_top(spark, d, limit=10, codes=None):
    """Newest top holdings per fund and type as one text, of all funds or of the given codes."""
    holdings = A.fund_holdings(spark, d)
    if codes is not None:
        holdings = holdings.join(codes.select(F.col("code").alias("fund_code")).distinct(), "fund_code", "left_semi")
    top = W.top_holdings(holdings, limit)
    return top.groupBy("fund_code", "holding_type").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_code"))),
                                     lambda s: s["asset_code"])).alias("codes"))


@query("fund_screen", "S1 J1 F5 F9 F21 O1 O2 A1 A2 W3 J7", "funds fund_details fund_holdings", f"""
with hits as (select f.code, f.name, f.type, d.scale, d.sharpe_3y, d.position_stock from funds f
    left join fund_details d on f.code=d.fund_code where {SCREEN_SQL}),
 paged as (select *, (select count(*) from hits) total from hits order by sharpe_3y desc, code limit 20),
 newest as (select fund_code, holding_type, max(quarter) as quarter from fund_holdings group by 1,2),
 top as (select fund_code, asset_code, row_number() over (partition by fund_code order by hold_ratio desc, asset_code) rk
    from fund_holdings join newest using (fund_code, holding_type, quarter) where holding_type='stock'),
 agg as (select fund_code, string_agg(asset_code, ',' order by rk) top_stocks from top where rk<=10 group by 1)
select code, name, type, scale, round(sharpe_3y,6) sharpe_3y, round(position_stock,6) position_stock, total, top_stocks
from paged left join agg on code=fund_code""")
def fund_screen(spark, d):
    hits = joined_funds(spark, d).where(P.screen_predicate(SCREEN))
    hits = cut_lineage(hits.select("code", "name", "type", "scale", "sharpe_3y", "position_stock"))
    total = hits.agg(F.count("*").alias("n")).scalar()
    rows = page(hits, order_columns([("sharpe_3y", "desc"), ("bad", "asc")], {"sharpe_3y", "scale"}), 1, 20)
    stocks = latest_top(spark, d, codes=rows).where(F.col("holding_type") == "stock").select(
        F.col("fund_code").alias("code"), F.col("codes").alias("top_stocks"))
    return rows.join(stocks, "code", "left").select(
        "code", "name", "type", "scale", F.round("sharpe_3y", 6).alias("sharpe_3y"),
        F.round("position_stock", 6).alias("position_stock"), total.alias("total"), "top_stocks")


@query("filter_operators", "F1 F2 F3 F4 F5", "funds fund_details", """
select code, cast(type='股票型' as int) f_eq, cast(type<>'股票型' as int) f_neq, cast(scale>200 as int) f_gt,
  cast(scale>=200 as int) f_gte, cast(scale<200 as int) f_lt, cast(scale<=200 as int) f_lte,
  cast(code in ('000001','000002') as int) f_in, cast(code not in ('000001','000002') as int) f_not_in, 0 f_in_empty, 0 f_not_in_empty,
  cast(name ilike '%nd 1%' as int) f_like, cast(name not ilike '%ND 1%' as int) f_not_like,
  cast(code ilike '%7%' or name ilike '%a' as int) f_or, cast(scale>=100 and scale<=300 as int) f_and
from funds left join fund_details on code=fund_code""")
def filter_operators(spark, d):
    df = joined_funds(spark, d)
    flags = {
        "f_eq": P.compare("type", "eq", "股票型"), "f_neq": P.compare("type", "neq", "股票型"),
        "f_gt": P.compare("scale", "gt", "200", "double"), "f_gte": P.compare("scale", "gte", "200", "double"),
        "f_lt": P.compare("scale", "lt", "200", "double"), "f_lte": P.compare("scale", "lte", "200", "double"),
        "f_in": P.one_of("code", ["000001", "000002"]), "f_not_in": P.none_of("code", ["000001", "000002"]),
        "f_in_empty": P.one_of("code", []), "f_not_in_empty": P.none_of("code", []),
        "f_like": P.like("name", "*nd 1*"), "f_not_like": P.like("name", "*ND 1*", negate=True),
        "f_or": X.any_of([P.like("code", "*7*"), P.like("name", "*a")]),
        "f_and": X.all_of([P.compare("scale", "gte", 100.0), P.compare("scale", "lte", 300.0)]),
    }
    return df.select("code", *[c.cast("int").alias(n) for n, c in flags.items()])


@query("filter_ranges_ai", "F6 F7 F8 F22", "funds fund_details fund_ai", """
select f.code, luck_verdict, concentration, skill_score from funds f left join fund_details d on f.code=d.fund_code
  left join fund_ai a on f.code=a.fund_code
where scale>=10 and scale<=400 and max_drawdown_3y<=100 and position_stock<>50
  and luck_verdict in ('solid','mixed') and concentration in ('focused','diversified') and skill_score>=20""")
def filter_ranges_ai(spark, d):
    predicate = X.all_of([
        P.range_predicate({"scale_min": "10", "scale_max": "400", "max_drawdown_3y_max": 100, "sharpe_1y_min": ""}),
        P.condition_predicate([{"field": "position_stock", "op": "neq", "value": "50"}, {"field": "name", "op": "gt", "value": 1}]),
        P.ai_predicate(["solid", "mixed"], ["focused", "diversified"], False, 20),
    ])
    return joined_funds(spark, d).where(predicate).select(
        "code", X.clean_text("luck_verdict").alias("luck_verdict"), "concentration", "skill_score")


def presets(spark, d):
    """One saved filter per nation, using every part of the filter struct."""
    k = F.col("n_nationkey")
    empty = F.array().cast("array<string>")
    condition = lambda f, op, v: F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), v.cast("double").alias("value"))
    filters = F.struct(
        F.when(k % 7 == 1, "FUND").alias("keyword"),
        F.when(k % 4 == 0, "a").otherwise("").alias("name_contains"),
        F.when(k % 3 == 0, F.array(F.lit("股票型"), F.lit("混合型-偏股"))).when(k % 3 == 2, F.array(F.lit("债券型-长债")))
        .otherwise(empty).alias("fund_types"),
        F.array(A.code6("n_nationkey")).alias("exclude_codes"),
        F.when(k % 5 == 0, F.array(F.lit("fund 1"))).otherwise(empty).alias("name_excludes"),
        F.when(k % 2 == 0, F.array(condition("scale", "gte", k * 5), condition("sharpe_3y", "gt", F.lit(1.0))))
        .otherwise(F.array(condition("scale", "lt", k * 20))).alias("conditions"),
    )
    return A.table(spark, d, "nation").select(k.alias("preset_id"), filters.alias("filters"))


PRESET_MATCH_SQL = """
  (k%7<>1 or f.code ilike '%fund%' or f.name ilike '%fund%') and (k%4<>0 or f.name ilike '%a%')
  and (k%3=1 or (k%3=0 and f.type in ('股票型','混合型-偏股')) or (k%3=2 and f.type='债券型-长债'))
  and f.code<>printf('%06d', k) and (k%5<>0 or f.name not ilike '%fund 1%')
  and ((k%2=0 and d.scale>=k*5 and d.sharpe_3y>1.0) or (k%2=1 and d.scale<k*20))"""


def preset_members(spark, d):
    return P.screen_presets(joined_funds(spark, d), presets(spark, d), ["scale", "sharpe_3y", "position_stock"])


@query("preset_members", "F10", "funds fund_details", f"""
select k preset_id, f.code from (select n_nationkey k from nation), funds f left join fund_details d on f.code=d.fund_code
where {PRESET_MATCH_SQL}""")
def q_preset_members(spark, d):
    return preset_members(spark, d)


@query("preset_snapshot_build", "K9 A46", "funds fund_details fund_holdings", f"""
with m as (select k preset_id, f.code from (select n_nationkey k from nation), funds f left join fund_details d on f.code=d.fund_code
  where {PRESET_MATCH_SQL}),
 newest as (select fund_code, holding_type, max(quarter) as quarter from fund_holdings group by 1,2),
 top as (select fund_code, holding_type, hold_ratio, row_number() over (partition by fund_code, holding_type order by hold_ratio desc, asset_code) rk
    from fund_holdings join newest using (fund_code, holding_type, quarter)),
 h as (select fund_code, count(*) n, sum(hold_ratio) r from top where rk<=10 group by 1)
select p.n_nationkey preset_id, count(m.code) fund_count, cast(coalesce(sum(h.n),0) as bigint) holding_rows, round(coalesce(sum(h.r),0),6) ratio_sum,
  min(m.code) first_code
from nation p left join m on m.preset_id=p.n_nationkey left join h on h.fund_code=m.code group by 1""")
def preset_snapshot_build(spark, d):
    from navloom.sources.sinks import build_snapshots

    items = build_snapshots(preset_members(spark, d), W.top_holdings(A.fund_holdings(spark, d)))
    rows = items.groupBy("preset_id").agg(
        F.count("*").alias("n"), F.sum(F.size("holdings")).alias("h"),
        F.sum(F.aggregate("holdings", F.lit(0.0), lambda a, x: a + x["hold_ratio"])).alias("r"),
        F.min("code").alias("first_code"))
    return presets(spark, d).select("preset_id").join(rows, "preset_id", "left").select(
        "preset_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("fund_count"),
        F.coalesce("h", F.lit(0)).cast("bigint").alias("holding_rows"),
        F.round(F.coalesce("r", F.lit(0.0)), 6).alias("ratio_sum"), "first_code")


@query("fund_search", "F11 F12 S2", "funds", """
select * from (select 'keyword' kind, code, name from funds where code ilike '%1%' or name ilike '%1%' order by code limit 50)
union all select 'codes', code, name from funds where code in (select printf('%06d', c_nationkey) from customer)
union all select * from (select 'one', code, name from funds where type='股票型' order by code limit 1)""")
def fund_search(spark, d):
    funds = A.funds(spark, d).select("code", "name", "type")
    hit = X.any_of([P.like("code", "*1*"), P.like("name", "*1*")])
    wanted = A.table(spark, d, "customer").select(A.code6("c_nationkey").alias("code")).distinct()
    parts = {
        "keyword": funds.where(hit).orderBy("code").limit(50),
        "codes": funds.join(wanted, "code", "left_semi"),
        "one": funds.where(F.col("type") == "股票型").orderBy("code").limit(1),
    }
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), "code", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snapshot_members", "S12 J4 F13 F14 J28", "snapshot_items fund_ai fund_details", """
select i.preset_id, i.code, i.name, round(i.scale,4) scale, cast(i.code=printf('%06d', i.preset_id)
    or (i.preset_id%5=0 and i.name like '%Fund 1%') as int) is_excluded, luck_verdict, rating,
  cast(luck_verdict in ('solid','mixed') as int) facet_hit, round(sharpe_3y,6) sharpe_3y, establish_date
from snapshot_items i left join fund_ai a on a.fund_code=i.code left join fund_details d on d.fund_code=i.code""")
def snapshot_members(spark, d):
    from navloom.sources.landed import snapshot_items

    rules = presets(spark, d).select(
        "preset_id", "filters.exclude_codes",
        F.when(F.col("preset_id") % 5 == 0, F.array(F.lit("Fund 1"), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("name_excludes"))
    items = P.apply_exclusions(snapshot_items(A.snapshots(spark, d)), rules)
    ai = A.fund_ai(spark, d).withColumnRenamed("fund_code", "code").select("code", "luck_verdict", "rating")
    details = A.fund_details(spark, d).select(F.col("fund_code").alias("code"), "sharpe_3y", "establish_date")
    return items.join(ai, "code", "left").join(details, "code", "left").select(
        "preset_id", "code", "name", F.round("scale", 4).alias("scale"), F.col("is_excluded").cast("int").alias("is_excluded"),
        "luck_verdict", "rating", F.col("luck_verdict").isin("solid", "mixed").cast("int").alias("facet_hit"),
        F.round("sharpe_3y", 6).alias("sharpe_3y"), "establish_date")


@query("snapshot_vs_screen", "J24", "funds fund_details snapshot_items", f"""
with m as (select k preset_id, f.code from (select n_nationkey k from nation), funds f left join fund_details d on f.code=d.fund_code
  where {PRESET_MATCH_SQL}), s as (select preset_id, code from snapshot_items),
 n as (select preset_id, count(*) n from m where not exists (select 1 from s where s.preset_id=m.preset_id and s.code=m.code) group by 1),
 o as (select preset_id, count(*) n from s where not exists (select 1 from m where s.preset_id=m.preset_id and s.code=m.code) group by 1)
select n_nationkey preset_id, coalesce(n.n,0) new_count, coalesce(o.n,0) dropped_count
from nation left join n on n.preset_id=n_nationkey left join o on o.preset_id=n_nationkey""")
def snapshot_vs_screen(spark, d):
    from navloom.sources.landed import snapshot_items

    live = preset_members(spark, d).withColumn("live", F.lit(1))
    saved = snapshot_items(A.snapshots(spark, d)).select("preset_id", "code").withColumn("saved", F.lit(1))
    both = live.join(saved, ["preset_id", "code"], "full_outer").groupBy("preset_id").agg(
        F.count_if(F.col("saved").isNull()).alias("new_count"), F.count_if(F.col("live").isNull()).alias("dropped_count"))
    return presets(spark, d).select("preset_id").join(both, "preset_id", "left").select(
        "preset_id", F.coalesce("new_count", F.lit(0)).alias("new_count"), F.coalesce("dropped_count", F.lit(0)).alias("dropped_count"))


@query("fund_type_dimension", "K6 U3 S11", "funds", """
select type type_name, case when bool_or(fund_type='stock') then 'stock' else 'non_stock' end category, count(*) n from funds group by 1""")
def fund_type_dimension(spark, d):
    return A.funds(spark, d).groupBy(F.col("type").alias("type_name")).agg(
        F.when(F.bool_or(F.col("fund_type") == "stock"), "stock").otherwise("non_stock").alias("category"),
        F.count("*").alias("n"))


@query("candidate_universe", "F15", "funds fund_details", """
select code, name, scale from funds join fund_details on code=fund_code where scale between 2 and 400
 and name not like '%年%' and name not like '%月%' and name not like '%季%' and (type like '混合型-偏股%' or type like '混合型-灵活%'
 or type like '混合型-股债平衡%' or type like '股票型%') and code in (select printf('%06d', l_suppkey) from lineitem where l_discount>0.05)""")
def candidate_universe(spark, d):
    wanted = A.table(spark, d, "lineitem").where(F.col("l_discount") > 0.05).select(A.code6("l_suppkey").alias("code"))
    details = A.fund_details(spark, d).withColumnRenamed("fund_code", "code").drop("fund_name")
    return P.universe(A.funds(spark, d).join(details, "code"), wanted).select("code", "name", "scale")


@query("sync_groups", "F20", "", """
select p_partkey, case when t like '货币型%' or t like '债券型%' then 'P1'
  when t='股票型' or t like '股票型-%' or t like '混合型%' or upper(t||' '||nm) like '%REIT%' or
     ((upper(t) like '%QDII%') and (t||' '||nm) similar to '.*(港股|香港|恒生|港币).*') or t like 'QDII-港股%' then 'P2' else 'P3' end batch
from (select p_partkey, p_name nm, case p_type when 'PROMO' then '货币型-普通货币' when 'SMALL' then 'QDII-港股' when 'LARGE' then 'QDII-全球'
   when 'MEDIUM' then '混合型-偏股' when 'STANDARD' then '债券型-长债' else 'FOF-稳健' end t from part)""")
def sync_groups(spark, d):
    from navloom import constants as K

    t = F.col("p_type")
    typed = A.table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"),
        F.when(t == "PROMO", "货币型-普通货币").when(t == "SMALL", "QDII-港股").when(t == "LARGE", "QDII-全球")
        .when(t == "MEDIUM", "混合型-偏股").when(t == "STANDARD", "债券型-长债").otherwise("FOF-稳健").alias("type"))
    return typed.select("p_partkey", P.sync_group(K.SYNC_GROUPS, "P3").alias("batch"))


@query("stale_details", "F25 F26", "funds nav_daily fund_holdings trade_dates", """
with f as (select fund_code, max(trade_date) fetched from nav_daily where nav>0.5 group by 1),
 q as (select fund_code, max(quarter) as quarter from fund_holdings group by 1),
 b as (select max(trade_date) base from trade_dates where trade_date<=date '2001-06-30')
select code, fetched, q.quarter, cast(fetched is null or date_diff('day',fetched,date '2001-06-30')>7 or fetched<>base as int) details_expired,
  cast(coalesce(fetched>=base,false) as int) holdings_fresh, cast(coalesce(q.quarter>='2001Q1',false) as int) has_last_quarter
from funds left join f on code=f.fund_code left join q on code=q.fund_code cross join b""")
def stale_details(spark, d):
    today = F.lit("2001-06-30").cast("date")
    fetched = A.nav_daily(spark, d).where(F.col("nav") > 0.5).groupBy("fund_code").agg(F.max("trade_date").alias("fetched"))
    quarters = A.fund_holdings(spark, d).groupBy("fund_code").agg(F.max("quarter").alias("quarter"))
    base = A.trade_dates(spark, d).where(F.col("trade_date") <= today).agg(F.max("trade_date")).scalar()
    f = F.col("fetched")
    return (
        A.funds(spark, d).select("code", F.col("code").alias("fund_code"))
        .join(fetched, "fund_code", "left").join(quarters, "fund_code", "left").withColumn("base", base)
        .select(
            "code", "fetched", "quarter",
            (f.isNull() | (F.datediff(today, f) > 7) | (f != F.col("base"))).cast("int").alias("details_expired"),
            F.coalesce(f >= F.col("base"), F.lit(False)).cast("int").alias("holdings_fresh"),
            F.coalesce(F.col("quarter") >= X.previous_quarter(today), F.lit(False)).cast("int").alias("has_last_quarter"))
    )


@query("work_lists", "F23 F24 J16", "funds fund_details fund_ai fund_holdings", """
select * from (select 'detail' list, code from funds where type like '股票型%' or type like '混合型-偏股%' or type like '混合型-灵活%' order by code limit 120)
union all select 'analyse', code from funds join fund_details on code=fund_code where (type like '股票型%' or type like '混合型%')
  and scale>=10 and position_stock>=60 and code not in (select fund_code from fund_ai)
union all select 'holdings', code from funds where type not like '货币型%' and code not in
  (select fund_code from fund_holdings where quarter='2001Q3')""")
def work_lists(spark, d):
    funds = A.funds(spark, d)
    starts = lambda *ps: X.any_of(F.col("type").startswith(p) for p in ps)
    detail = funds.where(starts("股票型", "混合型-偏股", "混合型-灵活")).orderBy("code").limit(120)
    details = A.fund_details(spark, d).withColumnRenamed("fund_code", "code")
    analyse = (
        funds.join(details, "code").where(starts("股票型", "混合型") & (F.col("scale") >= 10) & (F.col("position_stock") >= 60))
        .join(A.fund_ai(spark, d).select(F.col("fund_code").alias("code")), "code", "left_anti"))
    have = A.fund_holdings(spark, d).where(
        F.col("quarter") == X.previous_quarter(F.lit("2001-12-15").cast("date"))).select(F.col("fund_code").alias("code"))
    missing = funds.where(~starts("货币型")).join(have, "code", "left_anti")
    label = lambda name, df: df.select(F.lit(name).alias("list"), "code")
    return label("detail", detail).unionByName(label("analyse", analyse)).unionByName(label("holdings", missing))


@query("trading_calendar", "F19 S13", "trade_dates", """
select * from (select year(trade_date) y, count(*) open_days, min(trade_date) first_day, max(trade_date) last_day from trade_dates group by 1)
left join (select year(s) y, count(*) ship_days_open from (select distinct cast(l_shipdate as date) s from lineitem)
  where s in (select trade_date from trade_dates) group by 1) using (y)""")
def trading_calendar(spark, d):
    cal = A.trade_dates(spark, d)
    days = A.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")).distinct()
    tested = days.join(cal, "trade_date", "left_semi").groupBy(F.year("trade_date").alias("y")).agg(F.count("*").alias("ship_days_open"))
    return cal.groupBy(F.year("trade_date").alias("y")).agg(
        F.count("*").alias("open_days"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")
    ).join(tested, "y", "left").select(
        F.col("y").cast("bigint").alias("y"), "open_days", "first_day", "last_day", F.coalesce("ship_days_open", F.lit(0)).alias("ship_days_open"))


@query("base_trade_days", "J9", "trade_dates", """
select l_orderkey, l_linenumber, ts, latest_day, prev_day,
  case when latest_day=cast(ts as date) and hour(ts)<20 then prev_day else latest_day end base_day
from (select l_orderkey, l_linenumber, l_shipdate + to_hours(cast(l_linenumber*3 as bigint)) ts,
  (select max(trade_date) from trade_dates where trade_date<=cast(l_shipdate as date)) latest_day,
  (select max(trade_date) from trade_dates where trade_date<cast(l_shipdate as date)) prev_day from lineitem)""")
def base_trade_days(spark, d):
    moments = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_shipdate") + F.make_interval(hours=F.col("l_linenumber") * 3)).alias("ts"))
    return J.base_days(moments, A.trade_dates(spark, d), "ts")
