"""Ledger positions, bookings, portfolio totals and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.functions import scalars as X, stats as S
from navloom.operators import holdings as O
from navloom.operators import joins as J
from navloom.operators import ledger as L
from navloom.operators import windows as W
from navloom.plans.columns import r6
from navloom.plans.registry import query
from navloom.sources import adapters as A


def booked(spark, d):
    return L.book_trades(A.holding_txns(spark, d), A.nav_daily(spark, d))


BOOKED_SQL = """
booked as (select t.*, n.nav, case when n.nav>0 then amount/n.nav end shares from holding_txns t
  asof left join nav_daily n on t.fund_code=n.fund_code and t.trade_date>=n.trade_date)"""


@query("book_trades", "C18", "nav_daily holding_txns", f"""
with {BOOKED_SQL} select id, fund_code, trade_date, round(shares,3) shares from booked""")
def book_trades(spark, d):
    return booked(spark, d).select("id", "fund_code", "trade_date", *r6("shares", digits=3))


POSITION_SQL = f"""with recursive {BOOKED_SQL},
lastnav as (select fund_code, arg_max(nav,trade_date) latest_nav, max(trade_date) nav_date from nav_daily where nav is not null group by 1),
snap as (select portfolio_id, u.fund_code, market_value base_mv, cost base_cost, case when market_value>0 and latest_nav>0 then market_value/latest_nav end base_shares
  from user_holdings u left join lastnav l on l.fund_code=u.fund_code),
tot as (select portfolio_id, fund_code, sum(case when txn_type='buy' then amount else 0 end) bought, sum(case when txn_type='sell' then amount else 0 end) sold,
  bool_and(shares is not null) all_shares from booked group by 1,2),
frame as (select coalesce(t.portfolio_id,s.portfolio_id) portfolio_id, coalesce(t.fund_code,s.fund_code) fund_code, coalesce(bought,0) bought, coalesce(sold,0) sold,
  s.fund_code is not null has_snap, base_shares, coalesce(base_mv,0) base_mv, coalesce(base_cost,base_mv,0) cost0,
  (s.fund_code is null or base_shares is not null) and coalesce(all_shares,true) share_mode from tot t full join snap s on s.portfolio_id=t.portfolio_id and s.fund_code=t.fund_code),
ord as (select *, row_number() over (partition by portfolio_id, fund_code order by trade_date, id) n from booked where shares is not null),
fold as (select portfolio_id, fund_code, 0::bigint n, coalesce(base_shares,0)::double held, cost0::double as cost, 0.0::double realised from frame where share_mode
  union all select f.portfolio_id, f.fund_code, o.n,
   case when txn_type='buy' then held+shares when held>0 then held-least(shares,held) else held end,
   case when txn_type='buy' then cost+amount when held>0 then cost-cost/held*least(shares,held) else cost end,
   case when txn_type='sell' and held>0 then realised+amount-cost/held*least(shares,held) else realised end
  from fold f join ord o on o.portfolio_id=f.portfolio_id and o.fund_code=f.fund_code and o.n=f.n+1),
ends as (select portfolio_id, fund_code, arg_max(held,n) held, arg_max(cost,n) as cost, arg_max(realised,n) realised from fold group by 1,2),
pos as (select f.portfolio_id, f.fund_code, share_mode and latest_nav is not null ok,
  case when share_mode and latest_nav is not null then held*latest_nav else base_mv+bought-sold end market_value,
  case when share_mode and latest_nav is not null then e.cost else cost0+bought-sold end as cost,
  case when share_mode and latest_nav is not null then held end shares,
  case when share_mode and latest_nav is not null then realised+held*latest_nav-e.cost else base_mv-cost0 end pnl, cost0+bought total_invested
  from frame f left join ends e on e.portfolio_id=f.portfolio_id and e.fund_code=f.fund_code left join lastnav l on l.fund_code=f.fund_code)"""


def held_positions(spark, d):
    return L.positions(A.user_holdings(spark, d), booked(spark, d), A.nav_daily(spark, d))


@query("ledger_positions", "C17", "nav_daily holding_txns user_holdings", f"""{POSITION_SQL}
select portfolio_id, fund_code, round(market_value,3) market_value, round(cost,3) as cost, round(shares,3) shares, round(pnl,3) pnl, round(total_invested,3) total_invested, ok valuation_ok from pos""")
def ledger_positions(spark, d):
    return held_positions(spark, d).select(
        "portfolio_id", "fund_code", *r6("market_value", "cost", "shares", "pnl", "total_invested", digits=3), "valuation_ok")


@query("account_totals", "A39 X22", "nav_daily holding_txns user_holdings", f"""{POSITION_SQL}
select portfolio_id%25 portfolio_id, fund_code, count(*) funds, round(sum(market_value),2) market_value, round(sum(cost),2) as cost, round(sum(pnl),2) pnl,
 round(sum(total_invested),2) total_invested, round(sum(market_value)-sum(cost),2) unrealised, cast(grouping(fund_code) as integer) is_total from pos group by grouping sets ((portfolio_id%25, fund_code),(portfolio_id%25))""")
def account_totals(spark, d):
    held = held_positions(spark, d).withColumn("portfolio_id", F.col("portfolio_id") % 25)
    out = L.account_totals(held, "fund_code").withColumn("unrealised", X.unrealised("market_value", "cost"))
    return out.select("portfolio_id", "fund_code", "funds", "is_total", *r6("market_value", "cost", "pnl", "total_invested", "unrealised", digits=2))


def transfer_requests(spark, d):
    """Booking requests: orders with an even key move money between two funds, others have one side."""
    k = F.col("o_orderkey")
    side = lambda ok, c: F.when(ok, A.code6(c)).otherwise("")
    return A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("portfolio_id"), k.alias("row_id"), F.col("o_orderdate").cast("date").alias("trade_date"),
        (F.col("o_totalprice") - 20000).alias("amount"),
        side(k % 3 != 0, F.col("o_custkey") % 100).alias("from_code"), side(k % 5 != 0, (F.col("o_custkey") + 7) % 100).alias("to_code"))


LEGS_SQL = """
req as (select o_custkey portfolio_id, o_orderkey row_id, cast(o_orderdate as date) trade_date, o_totalprice-20000 amount,
 case when o_orderkey%3<>0 then printf('%06d', o_custkey%100) else '' end from_code,
 case when o_orderkey%5<>0 then printf('%06d', (o_custkey+7)%100) else '' end to_code from orders),
legs as (select portfolio_id, row_id, trade_date, amount, 'sell' txn_type, from_code fund_code, from_code<>'' and to_code<>'' paired from req where amount>0 and from_code<>''
 union all select portfolio_id, row_id, trade_date, amount, 'buy', to_code, from_code<>'' and to_code<>'' from req where amount>0 and to_code<>'')"""


@query("transfer_legs", "C19 C20", "", f"""with {LEGS_SQL}
select portfolio_id, row_id, trade_date, round(amount,4) amount, txn_type, fund_code, paired from legs""")
def transfer_legs(spark, d):
    return L.transfer_legs(transfer_requests(spark, d)).select(
        "portfolio_id", "row_id", "trade_date", *r6("amount", digits=4), "txn_type", "fund_code", F.col("transfer_id").isNotNull().alias("paired"))


def numbered_legs(spark, d):
    legs = L.transfer_legs(transfer_requests(spark, d))
    return legs.withColumn("id", F.col("row_id") * 2 + F.when(F.col("txn_type") == "buy", 1).otherwise(0))


@query("transfer_rows", "J32", "", f"""with {LEGS_SQL}
select row_id, min(trade_date) trade_date, round(max(amount),4) amount, max(case when txn_type='sell' then fund_code end) from_code,
 max(case when txn_type='buy' then fund_code end) to_code, count(*) legs from legs group by 1""")
def transfer_rows(spark, d):
    txns = numbered_legs(spark, d)
    ids = txns.groupBy(F.coalesce("transfer_id", F.col("id").cast("string")).alias("row_key")).agg(F.min("row_id").alias("row_id"))
    return L.transfer_rows(txns).join(ids, "row_key").select("row_id", "trade_date", *r6("amount", digits=4), "from_code", "to_code", "legs")


@query("delete_transfer_legs", "C19", "", f"""with {LEGS_SQL}
select row_id, txn_type from legs where not (row_id%10=1 and txn_type='sell') and not (paired and row_id%10=1)""")
def delete_transfer_legs(spark, d):
    txns = numbered_legs(spark, d)
    ids = txns.where((F.col("row_id") % 10 == 1) & (F.col("txn_type") == "sell")).select("id")
    return L.delete_with_legs(txns, ids).select("row_id", "txn_type")


def stock_top(spark, d):
    return W.top_holdings(A.fund_holdings(spark, d).where(F.col("holding_type") == "stock"), 10)


PENETRATE_SQL = """
w as (select portfolio_id, fund_code, market_value/sum(market_value) over (partition by portfolio_id) weight from portfolio_positions where market_value>0),
q as (select fund_code, max(quarter) as quarter from fund_holdings where holding_type='stock' group by 1),
h as (select fund_code, asset_code, hold_ratio, row_number() over (partition by fund_code order by hold_ratio desc, asset_code) rk from fund_holdings join q using (fund_code, quarter) where holding_type='stock'),
st as (select portfolio_id, asset_code, coalesce(nullif(sw_l3,''),nullif(sw_l2,''),nullif(em_industry,''),'其他') as label, sum(weight*hold_ratio) exposure, count(distinct fund_code) fund_count
  from w join h using (fund_code) left join stock_industry on stock_code=asset_code where rk<=10 group by 1,2,3)"""


@query("portfolio_penetration", "A31 A30", "portfolio_positions fund_holdings stock_industry", f"""with {PENETRATE_SQL}
select 'stock' kind, portfolio_id, asset_code as item, round(exposure,6) exposure, fund_count as n from st
union all select 'industry', portfolio_id, label, round(sum(exposure),6), count(*) from st group by 2,3
union all select 'summary', portfolio_id, cast(count(*) as varchar), round(sum(exposure),6), count(*) filter (fund_count>=2) from st group by 2""")
def portfolio_penetration(spark, d):
    weights = L.portfolio_weights(A.portfolio_positions(spark, d))
    stocks, industries, summary = O.look_through(
        weights.select("portfolio_id", "fund_code", "weight"), stock_top(spark, d), A.stock_industry(spark, d), ["portfolio_id"])
    shape = lambda df, kind, item, v, n: df.select(
        F.lit(kind).alias("kind"), "portfolio_id", F.col(item).cast("string").alias("item"), F.round(v, 6).alias("exposure"), F.col(n).alias("n"))
    return shape(stocks, "stock", "asset_code", "exposure", "fund_count").unionByName(
        shape(industries, "industry", "label", "exposure", "stock_count")).unionByName(
        shape(summary, "summary", "total_stocks", "visible_position", "overlap_stocks"))


@query("max_industry_share", "A32", "portfolio_positions fund_holdings stock_industry", f"""with {PENETRATE_SQL},
i as (select portfolio_id, label, sum(exposure) e from st group by 1,2)
select portfolio_id, round(max(e)/sum(e),6) max_share from i group by 1""")
def max_industry_share(spark, d):
    weights = L.portfolio_weights(A.portfolio_positions(spark, d)).select("portfolio_id", "fund_code", "weight")
    _, industries, _ = O.look_through(weights, stock_top(spark, d), A.stock_industry(spark, d), ["portfolio_id"])
    return O.max_industry_share(industries, ["portfolio_id"]).select("portfolio_id", *r6("max_share"))


@query("holdings_display", "O4 J25", "portfolio_positions", """
with t as (select n_nationkey portfolio_id, printf('%06d', n_nationkey*3) fund_code, n_regionkey seq from nation),
r as (select p.portfolio_id, p.fund_code, seq, market_value, false is_phantom from portfolio_positions p left join t on t.portfolio_id=p.portfolio_id and t.fund_code=p.fund_code
 union all select portfolio_id, fund_code, seq, 0, true from t where not exists (select 1 from portfolio_positions p where p.portfolio_id=t.portfolio_id and p.fund_code=t.fund_code))
select portfolio_id, fund_code, seq, round(market_value,4) market_value, is_phantom, row_number() over (partition by portfolio_id order by case when market_value<=0.005 then 1 else 0 end,
 coalesce(seq,2147483647), -market_value, fund_code) pos from r""")
def holdings_display(spark, d):
    from navloom.operators.scale import numbered

    targets = A.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("portfolio_id"), A.code6(F.col("n_nationkey") * 3).alias("fund_code"), F.col("n_regionkey").alias("seq"))
    rows = L.display_list(A.portfolio_positions(spark, d), targets).withColumn("cleared", F.col("sort_key.cleared") * 1.0e12 + F.col("sort_key.seq"))
    return numbered(rows, ["portfolio_id"], "cleared", [F.col("sort_key")], "pos").select(
        "portfolio_id", "fund_code", "seq", *r6("market_value", digits=4), "is_phantom", "pos")


@query("resolve_names", "J19 X1 X11", "funds portfolio_positions", """
with r as (select c_custkey id, case when c_custkey%4=0 then printf('%06d', c_custkey%100) else '' end code,
  case when c_custkey%4=1 then 'Fund '||(c_custkey%60)||'A' when c_custkey%4=2 then ' Fund '||(c_custkey%60)||'E' when c_custkey%4=3 then 'Unknown '||c_custkey else '' end nm from customer),
b as (select min(code) code, trim(regexp_replace(name,'[A-Za-z]+$','')) bn from funds group by 2)
select id, coalesce(nullif(code,''), (select min(code) from funds where name=trim(nm)), (select code from b where bn=trim(regexp_replace(trim(nm),'[A-Za-z]+$','')) and bn<>''), trim(nm)) resolved_code,
 regexp_matches(code,'^[0-9]{6}$') is_code from r where not (code='' and trim(nm)='')""")
def resolve_names(spark, d):
    k = F.col("c_custkey")
    n = (k % 60).cast("string")
    rows = A.table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, A.code6(k % 100)).otherwise("").alias("fund_code"),
        F.when(k % 4 == 1, F.concat(F.lit("Fund "), n, F.lit("A"))).when(k % 4 == 2, F.concat(F.lit(" Fund "), n, F.lit("E")))
        .when(k % 4 == 3, F.concat(F.lit("Unknown "), k.cast("string"))).otherwise("").alias("fund_name"))
    return J.resolve_codes(rows, A.funds(spark, d)).where(F.col("resolved_code").isNotNull()).select(
        "id", "resolved_code", X.is_fund_code("fund_code").alias("is_code"))


def brand_weights(spark, d):
    """Held weights of the brand funds per region: a portfolio of five funds each."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return A.table(spark, d, "part").groupBy((number % 5).alias("portfolio_id"), F.col("p_brand").alias("fund_code")).agg(
        F.sum("p_retailprice").alias("weight"))


CURVE_SQL = """
w as (select cast(regexp_extract(p_brand,'(\\d+)',1) as integer)%5 portfolio_id, p_brand fund_code, sum(p_retailprice) weight from part group by 1,2),
j as (select portfolio_id, fund_code, weight, trade_date, nav from w join nav_weekly using (fund_code)),
c as (select portfolio_id, trade_date from j group by 1,2 having count(*)=(select count(*) from w where w.portfolio_id=j.portfolio_id)),
b as (select j.*, nav/first(nav) over (partition by portfolio_id, fund_code order by trade_date) rel from j join c using (portfolio_id, trade_date)),
curve as (select portfolio_id, trade_date, sum(rel*weight)/sum(weight) nav from b group by 1,2)"""


@query("portfolio_curve", "C6 J15", "nav_weekly", f"""with {CURVE_SQL}
select portfolio_id, trade_date, round(nav,6) nav, round(nav/max(nav) over (partition by portfolio_id order by trade_date)-1,6) drawdown from curve""")
def portfolio_curve(spark, d):
    return L.portfolio_curve(brand_weights(spark, d), A.nav_weekly(spark, d), ["portfolio_id"]).select(
        "portfolio_id", "trade_date", *r6("nav", "drawdown"))


@query("interval_performance", "C25 W16 X18", "nav_weekly", f"""with {CURVE_SQL},
e as (select portfolio_id, max(trade_date) z, min(trade_date) a from curve group by 1),
ws as (select portfolio_id, unnest([struct_pack(w:='近三月', s:=cast(z - interval 3 month as date)), struct_pack(w:='近六月', s:=cast(z - interval 6 month as date)),
 struct_pack(w:='近一年', s:=cast(z - interval 12 month as date)), struct_pack(w:='今年以来', s:=cast(date_trunc('year',z) as date)), struct_pack(w:='全部', s:=a)]) x from e),
r as (select portfolio_id, x.w win, trade_date, nav, nav/lag(nav) over k-1 ret, nav/max(nav) over k-1 dd from curve join ws using (portfolio_id) where trade_date>=x.s
  window k as (partition by portfolio_id, x.w order by trade_date)),
g as (select portfolio_id, win, count(ret) n, stddev_samp(ret) s, arg_min(nav,trade_date) f, arg_max(nav,trade_date) l, min(trade_date) a, max(trade_date) b, min(dd) mdd from r group by 1,2),
h as (select *, greatest(date_diff('day',a,b),1) span from g)
select portfolio_id, win as "window", a as start, b as "end", n+1 points, round(l/f-1,6) total_return, round(pow(l/f,365.25/span)-1,6) annual_return,
 round(case when s>0 then (pow(l/f,365.25/span)-1)/(s*sqrt(n*365.25/span)) else 0 end,6) sharpe, round(mdd,6) max_drawdown from h where n>=1""")
def interval_performance(spark, d):
    curve = L.portfolio_curve(brand_weights(spark, d), A.nav_weekly(spark, d), ["portfolio_id"]).select("portfolio_id", "trade_date", "nav")
    rows = W.interval_windows(curve, ["portfolio_id"])
    out = S.return_stats(rows, ["portfolio_id", "window"], "observed_sample").where(F.col("points") >= 2)
    return out.select("portfolio_id", "window", "start", "end", "points", *r6("total_return", "annual_return", "sharpe", "max_drawdown"))


@query("sliced_curves", "W17", "nav_daily", """
with e as (select fund_code, max(trade_date) z from nav_daily group by 1), n as (select fund_code, count(*) filter (trade_date>=z-12) c from nav_daily join e using (fund_code) group by 1)
select fund_code, trade_date from nav_daily join e using (fund_code) join n using (fund_code) where trade_date>=z-12 or c<2""")
def sliced_curves(spark, d):
    return W.sliced(A.nav_daily(spark, d), ["fund_code"], 12).select("fund_code", "trade_date")
