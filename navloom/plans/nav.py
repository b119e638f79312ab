"""Value series: latest, recent, returns, factors, statistics and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.functions import stats as S
from navloom.operators import history as H
from navloom.operators import joins as J
from navloom.operators import windows as W
from navloom.plans.columns import f32, r6
from navloom.plans.registry import query
from navloom.plans.views import f32 as sql32
from navloom.sources import adapters as A


def valued(nav):
    """Cumulative value where present, else unit value."""
    return nav.withColumn("value", F.coalesce("acc_nav", "nav"))


@query("nav_latest", "W1", "nav_daily funds fund_details", f"""
select code, name, fund_company, trade_date, {sql32('nav')} nav, {sql32('acc_nav')} acc_nav from funds
left join fund_details d on code=d.fund_code left join (select fund_code, max(trade_date) trade_date, arg_max(nav, trade_date) nav,
 arg_max(struct_pack(v:=acc_nav), trade_date).v acc_nav from nav_daily group by 1) n on n.fund_code=code""")
def nav_latest(spark, d):
    last = W.latest(A.nav_daily(spark, d), ["fund_code"], "trade_date", ["trade_date", "nav", "acc_nav"])
    details = A.fund_details(spark, d).select("fund_code", "fund_company")
    return A.funds(spark, d).withColumn("fund_code", F.col("code")).join(details, "fund_code", "left").join(
        last, "fund_code", "left").select("code", "name", "fund_company", "trade_date", *f32("nav", "acc_nav"))


@query("nav_recent", "W2", "nav_daily", f"""
select fund_code, trade_date, {sql32('coalesce(acc_nav,nav)')} as value from (select *, row_number() over (partition by fund_code order by trade_date desc) rn
from nav_daily) where rn<=260 and coalesce(acc_nav,nav) is not null""")
def nav_recent(spark, d):
    return W.recent_points(A.nav_daily(spark, d), 260).select("fund_code", "trade_date", *f32("value"))


@query("nav_first_rows", "W15", "nav_daily", f"""
select fund_code, trade_date, {sql32('acc_nav')} nav from (select *, row_number() over (partition by fund_code order by trade_date) rn
from nav_daily) where rn<=400 and acc_nav is not null""")
def nav_first_rows(spark, d):
    nav = A.nav_daily(spark, d).select("fund_code", "trade_date", F.col("acc_nav").alias("nav"))
    return W.first_rows(nav, 400).select("fund_code", "trade_date", *f32("nav"))


@query("nav_returns_drawdown", "W4 W5 W13", "nav_daily", f"""
select fund_code, trade_date, round(nav/lag(nav) over w - 1,6) ret, {sql32('max(nav) over w')} peak,
  round(nav/max(nav) over w - 1,6) drawdown, round(nav/first(nav) over w,6) rel
from nav_daily window w as (partition by fund_code order by trade_date rows between unbounded preceding and current row)""")
def nav_returns_drawdown(spark, d):
    nav = A.nav_daily(spark, d)
    df = W.rebase(W.drawdown(S.simple_returns(nav, ["fund_code"]), ["fund_code"]), ["fund_code"])
    return df.select("fund_code", "trade_date", *r6("ret", "drawdown", "rel"), *f32("peak"))


FACTOR_SQL = """
s as (select fund_code, trade_date, coalesce(acc_nav,nav) v from nav_daily),
p as (select *, row_number() over w i, lag(v) over w l1, lag(v,20) over w l20, lag(v,60) over w l60, lag(v,120) over w l120,
   avg(v) over (partition by fund_code order by trade_date rows 19 preceding) a20,
   avg(v) over (partition by fund_code order by trade_date rows 59 preceding) a60
   from s window w as (partition by fund_code order by trade_date)),
q as (select *, v/l1-1 r, case when i>=20 then a20 end ma20, case when i>=60 then a60 when i>=20 then a20 end ma60, i%20 chain, i//20 as months from p),
t as (select *, count(r) over f cn, avg(r) over f m, stddev_pop(r) over f sd,
   row_number() over (partition by fund_code, chain order by i) place from q
   window f as (partition by fund_code order by trade_date rows 59 preceding)),
u as (select *, place - max(case when not coalesce(v>l20,false) then place end) over (partition by fund_code, chain order by i) run,
   case when ma20>0 then (v/ma20-1)*100 else 0 end e20, case when ma60>0 then (v/ma60-1)*100 else 0 end e60 from t),
fac as (select fund_code, trade_date, i,
   case when l20>0 then ((v/l20-1)*0.5 + case when l60>0 then (v/l60-1)*0.3 else 0 end + case when l120>0 then (v/l120-1)*0.2 else 0 end)
     / (0.5 + case when l60>0 then 0.3 else 0 end + case when l120>0 then 0.2 else 0 end) end momentum_raw,
   case when cn>=20 and sd>0 then m/sd*sqrt(252) end risk_adj_raw,
   case when i<20 then 50.0 else least(greatest(case when v>ma20 then 60 else 0 end + case when v>ma60 then 40 else 0 end
     + least(greatest(e20,-10.0),10.0), 0.0), 100.0) end breadth,
   case when months<2 then 50.0 else least(run, months-1)*100.0/(months-1) end consistency,
   case when i<20 then 0.0 else e20 end d20, case when i<20 then 0.0 else e60 end d60, case when i<20 then 0.0 else 0.6*e20+0.4*e60 end deviation from u)"""


@query("nav_factors", "W6 W7 A18 W11 W12", "nav_daily", f"""
with {FACTOR_SQL}
select fund_code, trade_date, round(momentum_raw,6) momentum_raw, round(risk_adj_raw,6) risk_adj_raw, round(breadth,6) breadth,
  round(consistency,6) consistency, round(d20,6) d20, round(d60,6) d60, round(deviation,6) deviation from fac""")
def nav_factors(spark, d):
    df = W.factors(valued(A.nav_daily(spark, d)))
    return df.select("fund_code", "trade_date", *r6(
        "momentum_raw", "risk_adj_raw", "breadth", "consistency", "d20", "d60", "deviation"))


@query("momentum_to_first", "W8", "nav_daily", """
with p as (select fund_code, trade_date, case when coalesce(acc_nav,0)<>0 then acc_nav else nav end price,
  row_number() over (partition by fund_code order by trade_date desc) rn from nav_daily),
 g as (select fund_code, max(case when rn=1 then price end) p1, arg_max(price,rn) f, max(case when rn=22 then price end) a,
   max(case when rn=64 then price end) b, max(case when rn=127 then price end) c, count(*) n from p group by 1)
select fund_code, round(case when n<2 then 0 else 0.5*(p1/coalesce(a,f)-1)+0.3*(p1/coalesce(b,f)-1)+0.2*(p1/coalesce(c,f)-1) end,6) momentum from g""")
def momentum_to_first(spark, d):
    return W.momentum_to_first(J.positive_price(A.nav_daily(spark, d)), ["fund_code"]).select("fund_code", *r6("momentum"))


CONVENTIONS = ["observed_sample", "observed_population", "mean_over_sigma", "days252", "days244"]


@query("return_stats", "A15", "nav_daily", """
with r as (select fund_code, trade_date, nav, nav/lag(nav) over w - 1 ret, nav/max(nav) over w - 1 dd from nav_daily
   window w as (partition by fund_code order by trade_date)),
 g as (select fund_code, count(ret) n, avg(ret) m, stddev_samp(ret) ss, stddev_pop(ret) sp, arg_min(nav,trade_date) f, arg_max(nav,trade_date) l,
   min(trade_date) a, max(trade_date) b, min(dd) mdd from r group by 1),
 h as (select *, greatest(date_diff('day',a,b),1) span from g),
 k as (select *, n*365.25/span ppy, pow(l/f,365.25/span)-1 cagr from h),
 x as (select fund_code, a, b, n, l, f, mdd, unnest([struct_pack(c:='observed_sample', an:=cagr, vo:=ss*sqrt(ppy), sh:=cagr/(ss*sqrt(ppy))),
   struct_pack(c:='observed_population', an:=cagr, vo:=sp*sqrt(ppy), sh:=cagr/(sp*sqrt(ppy))),
   struct_pack(c:='mean_over_sigma', an:=cagr, vo:=ss*sqrt(ppy), sh:=m/ss*sqrt(ppy)),
   struct_pack(c:='days252', an:=m*252, vo:=sp*sqrt(252), sh:=m*252/(sp*sqrt(252))),
   struct_pack(c:='days244', an:=m*244, vo:=ss*sqrt(244), sh:=m*244/(ss*sqrt(244)))]) s from k)
select fund_code, s.c convention, a as start, b as "end", n+1 points, round(l/f-1,6) total_return, round(s.an,6) annual_return, round(s.vo,6) annual_vol,
  round(s.sh,6) sharpe, round(mdd,6) max_drawdown from x""")
def return_stats(spark, d):
    nav = A.nav_daily(spark, d)
    out = None
    for c in CONVENTIONS:
        one = S.return_stats(nav, ["fund_code"], c).withColumn("convention", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out.select("fund_code", "convention", "start", "end", "points",
                      *r6("total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown"))


@query("sortino", "A17", "nav_daily", """
with r as (select fund_code, nav/lag(nav) over (partition by fund_code order by trade_date) - 1 r from nav_daily)
select fund_code, round(case when count(*) filter (r<0)>=5 then avg(r)/sqrt(avg(r*r) filter (r<0))*sqrt(252) end,6) sortino from r group by 1""")
def sortino(spark, d):
    return S.sortino(A.nav_daily(spark, d), ["fund_code"]).select("fund_code", *r6("sortino"))


@query("rolling_sharpe", "W9", "nav_daily", """
with r as (select fund_code, trade_date, nav/lag(nav) over (partition by fund_code order by trade_date) - 1 r from nav_daily),
 w as (select fund_code, count(r) over f n, avg(r) over f m, stddev_pop(r) over f s from r
   window f as (partition by fund_code order by trade_date rows 251 preceding)),
 x as (select fund_code, case when n=252 and s>0 then m/s*sqrt(252) end sh from w)
select fund_code, round(case when count(*)>=272 and count(sh)>=10 then median(sh) end,6) sharpe_med,
  round(case when count(*)>=272 and count(sh)>=10 then stddev_pop(sh) end,6) sharpe_std from x group by 1""")
def rolling_sharpe(spark, d):
    return S.rolling_sharpe(A.nav_daily(spark, d), ["fund_code"]).select("fund_code", *r6("sharpe_med", "sharpe_std"))


def quarter_days(spark, d):
    """Decision dates: the 29th day after each quarter start of the order log."""
    return A.table(spark, d, "orders").select(
        F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 59).alias("as_of")).distinct()


QUARTER_DAYS_SQL = "select distinct cast(date_trunc('quarter', o_orderdate) as date)+59 as_of from orders"


@query("ytd_returns", "W14", "nav_daily", f"""
with d as ({QUARTER_DAYS_SQL}), v as (select fund_code, trade_date, coalesce(acc_nav,nav) v from nav_daily),
 x as (select as_of, fund_code, arg_max(v,trade_date) filter (year(trade_date)<year(as_of)) b, arg_max(v,trade_date) filter (year(trade_date)=year(as_of)) l,
  arg_min(v,trade_date) filter (year(trade_date)=year(as_of)) f from d join v on trade_date<=as_of and year(trade_date)>=year(as_of)-1 group by 1,2)
select as_of, fund_code, round((l/b-1)*100,6) ytd_from_year_end, round((l/f-1)*100,6) ytd_from_first_point from x""")
def ytd_returns(spark, d):
    out = W.ytd_return(valued(A.nav_daily(spark, d)), quarter_days(spark, d))
    return out.select("as_of", "fund_code", *r6("ytd_from_year_end", "ytd_from_first_point"))


@query("asof_trade_nav", "J10 J12", "nav_daily holding_txns", f"""
select t.id, t.fund_code, t.trade_date, n.trade_date hit_date, {sql32('n.acc_nav')} acc_nav, {sql32('e.nav')} nav_same_day
from holding_txns t asof left join nav_daily n on t.fund_code=n.fund_code and t.trade_date>=n.trade_date
left join nav_daily e on e.fund_code=t.fund_code and e.trade_date=t.trade_date""")
def asof_trade_nav(spark, d):
    nav = A.nav_daily(spark, d)
    hit = J.asof(A.holding_txns(spark, d), nav, ["acc_nav"])
    same = nav.select("fund_code", "trade_date", F.col("nav").alias("nav_same_day"))
    return hit.join(same, ["fund_code", "trade_date"], "left").select(
        "id", "fund_code", "trade_date", "hit_date", *f32("acc_nav", "nav_same_day"))


@query("asof_positive_price", "J11", "nav_daily holding_txns", f"""
with p as (select fund_code, trade_date, case when coalesce(acc_nav,0)<>0 then acc_nav else nav end price from nav_daily)
select t.id, t.trade_date, n.trade_date hit_date, {sql32('price')} price from holding_txns t
asof left join (select * from p where price>0) n on t.fund_code=n.fund_code and t.trade_date>=n.trade_date""")
def asof_positive_price(spark, d):
    hit = J.asof(A.holding_txns(spark, d), J.positive_price(A.nav_daily(spark, d)), ["price"])
    return hit.select("id", "trade_date", "hit_date", *f32("price"))


@query("forward_asof", "J13", "nav_daily fund_manager_tenure", f"""
with s as (select fund_code, start_date from fund_manager_tenure where seq=0)
select fund_code, start_date, {sql32('arg_min(nav,trade_date) filter (trade_date>=start_date)')} base, {sql32('arg_max(nav,trade_date)')} last_nav
from nav_daily join s using (fund_code) group by 1,2""")
def forward_asof(spark, d):
    starts = A.fund_manager_tenure(spark, d).where(F.col("seq") == 0).select("fund_code", "start_date")
    return A.nav_daily(spark, d).join(starts, "fund_code").groupBy("fund_code", "start_date").agg(
        J.forward_first("start_date", "trade_date", "nav").alias("base"), F.max_by("nav", "trade_date").alias("last_nav")
    ).select("fund_code", "start_date", *f32("base", "last_nav"))


def benchmark(spark, d):
    """Market series: mean unit value of all funds per day."""
    return A.nav_daily(spark, d).groupBy("trade_date").agg(F.avg("nav").alias("price"))


@query("benchmark_prices", "J14", "nav_daily signals", """
with b as (select trade_date, avg(nav) price from nav_daily group by 1),
 s as (select event_id, cast(date_trunc('day',ts) as date) - 9000 as day from signals)
select event_id, day, b.trade_date hit_date, round(price,6) price from s asof left join b on s.day>=b.trade_date""")
def benchmark_prices(spark, d):
    days = A.signals(spark, d).select("event_id", F.date_sub(F.to_date("ts"), 9000).alias("day"), F.lit(0).alias("g"))
    hit = J.asof(days, benchmark(spark, d).withColumn("g", F.lit(0)), ["price"], by=["g"], on="day")
    return hit.select("event_id", "day", "hit_date", *r6("price"))


METRICS_SQL = f"""
d as ({QUARTER_DAYS_SQL}),
p as (select fund_code, trade_date, case when coalesce(acc_nav,0)<>0 then acc_nav else nav end price from nav_daily),
h as (select as_of, fund_code, trade_date, price from d join p on trade_date<=as_of and price>0 and
  strftime(trade_date,'%Y-%m-%d') >= (year(as_of)-3)||strftime(as_of,'-%m-%d')),
a as (select *, row_number() over (partition by as_of,fund_code order by trade_date desc) age, price/lag(price) over w-1 ret,
  price/max(price) over w-1 dd3 from h window w as (partition by as_of,fund_code order by trade_date)),
b as (select *, case when age<=244 then price/max(case when age<=244 then price end) over (partition by as_of,fund_code order by trade_date)-1 end dd1,
  case when age<244 then ret end ret1 from a),
g as (select as_of, fund_code, count(*) as days, count(ret1) n1, count(ret) n3, avg(ret1) m1, avg(ret) m3, stddev_samp(ret1) s1, stddev_samp(ret) s3,
  -min(dd1) mdd1, -min(dd3) mdd3, max(case when age=1 then price end) p1, arg_max(price,age) f, max(case when age=244 then price end) y,
  max(case when age=22 then price end) q1, max(case when age=64 then price end) q2, max(case when age=127 then price end) q3 from b group by 1,2),
metrics as (select as_of, fund_code, days, case when n1>=19 and s1*sqrt(244)>1e-9 then m1*244/(s1*sqrt(244)) else 0 end sharpe_1y,
  case when n3>=19 and s3*sqrt(244)>1e-9 then m3*244/(s3*sqrt(244)) else 0 end sharpe_3y, mdd1 max_drawdown_1y, mdd3 max_drawdown_3y,
  p1/coalesce(y,f)-1 return_1y, 0.5*(p1/coalesce(q1,f)-1)+0.3*(p1/coalesce(q2,f)-1)+0.2*(p1/coalesce(q3,f)-1) momentum, p1 nav_on_date from g where days>=60)"""


@query("metrics_at_dates", "A16", "nav_daily", f"""
with {METRICS_SQL}
select as_of, fund_code, days, round(sharpe_1y,6) sharpe_1y, round(sharpe_3y,6) sharpe_3y, round(max_drawdown_1y,6) max_drawdown_1y,
 round(max_drawdown_3y,6) max_drawdown_3y, round(return_1y,6) return_1y, round(momentum,6) momentum, {sql32('nav_on_date')} nav_on_date from metrics""")
def metrics_at_dates(spark, d):
    out = H.metrics_at(A.nav_daily(spark, d), quarter_days(spark, d))
    return out.select("as_of", "fund_code", "days", *r6(
        "sharpe_1y", "sharpe_3y", "max_drawdown_1y", "max_drawdown_3y", "return_1y", "momentum"), *f32("nav_on_date"))


@query("prescreen_at_dates", "F16 F17", "nav_daily funds fund_details", f"""
with {METRICS_SQL}
select as_of, m.fund_code, round(m.sharpe_1y,6) sharpe_1y from metrics m join funds on code=m.fund_code left join fund_details x on x.fund_code=m.fund_code
where days>=250 and m.sharpe_1y>0 and name like '%Fund%' and name not like '%Fund 1C%' and (type like '%股票型%' or type like '%混合型%')
  and m.sharpe_3y>0.1 and x.position_stock>50""")
def prescreen_at_dates(spark, d):
    from navloom.operators.filters import historical_filter

    metrics = H.metrics_at(A.nav_daily(spark, d), quarter_days(spark, d))
    details = A.fund_details(spark, d).select("fund_code", "position_stock")
    funds = A.funds(spark, d).select(F.col("code").alias("fund_code"), "name", "type")
    pool = metrics.where((F.col("days") >= 250) & (F.col("sharpe_1y") > 0)).join(funds, "fund_code").join(details, "fund_code", "left")
    rules = {"keyword": "Fund", "name_excludes": ["Fund 1C"], "fund_types": ["股票型", "混合型"],
             "conditions": [{"field": "sharpe_3y", "op": "gt", "value": 0.1}, {"field": "position_stock", "op": "gt", "value": 50},
                            {"field": "scale", "op": "gt", "value": 1e9}]}
    return historical_filter(pool, rules).select("as_of", "fund_code", *r6("sharpe_1y"))


@query("signal_pairs", "W18", "signals", """
with s as (select *, row_number() over (partition by user_id order by ts,event_id) seq, lead(action) over w na, lead(ts) over w nt, lead(value) over w nv
  from signals window w as (partition by user_id order by ts,event_id))
select user_id, seq, ts buy_ts, case when na='SELL' then nt end sell_ts, round(value,4) buy_value, round(case when na='SELL' then nv end,4) sell_value
from s where action='BUY'""")
def signal_pairs(spark, d):
    rows = A.signals(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    pairs = H.signal_pairs(rows, ["user_id"], "hour", [F.col("ts"), F.col("event_id")], ["ts", "value"])
    return pairs.select("user_id", "seq", "buy_ts", "sell_ts", *r6("buy_value", "sell_value", digits=4))
