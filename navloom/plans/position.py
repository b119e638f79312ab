"""Strength scores, position advice and walk-forward tests of the brand funds."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.functions import scalars as X
from navloom.operators import holdings as O
from navloom.operators import ledger as L
from navloom.operators import position as P
from navloom.operators import similarity as M
from navloom.operators import themes as T
from navloom.operators import windows as W
from navloom.plans.columns import r6
from navloom.plans.registry import query
from navloom.functions import stats as S
from navloom.session import cut_lineage
from navloom.sources import adapters as A

SETS_SQL = "w as (select distinct cast(regexp_extract(p_brand,'(\\d+)',1) as integer)%5 portfolio_id, p_brand fund_code from part)"
PROS_SQL = """
s as (select fund_code, trade_date, nav v from nav_weekly),
p as (select *, row_number() over w2 i, lag(v) over w2 l1, lag(v,20) over w2 l20, lag(v,60) over w2 l60, lag(v,120) over w2 l120,
   avg(v) over (partition by fund_code order by trade_date rows 19 preceding) ma20, avg(v) over (partition by fund_code order by trade_date rows 59 preceding) ma60
   from s window w2 as (partition by fund_code order by trade_date)),
t as (select *, v/l1-1 r, i%20 chain, i//20 as months, row_number() over (partition by fund_code, i%20 order by i) place from p),
u as (select *, place - max(case when not coalesce(v>l20,false) then place end) over (partition by fund_code, chain order by i) run,
   avg(r) over f m, stddev_pop(r) over f sd from t window f as (partition by fund_code order by trade_date rows 59 preceding)),
z as (select *, row_number() over (partition by fund_code order by trade_date desc) rn from u),
fac as (select fund_code, trade_date, 0.5*(v/l20-1)+0.3*(v/l60-1)+0.2*(v/l120-1) mom, m/sd*sqrt(252) ra,
  least(greatest(case when v>ma20 then 60 else 0 end + case when v>ma60 then 40 else 0 end + least(greatest((v/ma20-1)*100,-10.0),10.0),0.0),100.0) breadth,
  least(run, months-1)*100.0/(months-1) consistency, 0.6*(v/ma20-1)*100+0.4*(v/ma60-1)*100 deviation, rn from z)"""


def last_factors(spark, d):
    rows = W.factors(A.nav_weekly(spark, d).withColumnRenamed("nav", "value"))
    cols = ["trade_date", "momentum_raw", "risk_adj_raw", "breadth", "consistency", "d20", "d60", "deviation"]
    return W.latest(rows, ["fund_code"], "trade_date", cols)


def brand_sets(spark, d):
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return A.table(spark, d, "part").select((number % 5).alias("portfolio_id"), F.col("p_brand").alias("fund_code")).distinct()


@query("prosperity", "C5 A13 A14", "nav_weekly", f"""with {SETS_SQL}, {PROS_SQL},
g as (select w.portfolio_id, fac.*, min(mom) over (partition by portfolio_id) lo, max(mom) over (partition by portfolio_id) hi,
  (row_number() over (partition by portfolio_id order by ra, fund_code)-1)*100.0/(count(*) over (partition by portfolio_id)-1) risk_adj from fac join w using (fund_code) where rn=1)
select portfolio_id, fund_code, round((mom-lo)/(hi-lo)*100,6) momentum, round(risk_adj,6) risk_adj, round(breadth,6) breadth, round(consistency,6) consistency,
 round(0.35*(mom-lo)/(hi-lo)*100+0.25*risk_adj+0.25*breadth+0.15*consistency,6) total from g""")
def prosperity(spark, d):
    out = P.prosperity(brand_sets(spark, d).join(last_factors(spark, d), "fund_code"), ["portfolio_id"])
    return out.select("portfolio_id", "fund_code", *r6("momentum", "risk_adj", "breadth", "consistency", "total"))


@query("tilted_weights", "C4 X20", "nav_weekly", f"""with recursive {SETS_SQL}, {PROS_SQL},
g as (select w.portfolio_id, fac.*, min(mom) over (partition by portfolio_id) lo, max(mom) over (partition by portfolio_id) hi,
  (row_number() over (partition by portfolio_id order by ra, fund_code)-1)*100.0/(count(*) over (partition by portfolio_id)-1) risk_adj from fac join w using (fund_code) where rn=1),
sc as (select portfolio_id, fund_code, deviation, 0.35*(mom-lo)/(hi-lo)*100+0.25*risk_adj+0.25*breadth+0.15*consistency total from g),
st as (select *, avg(total) over q mu, stddev_pop(total) over q sd from sc window q as (partition by portfolio_id)),
raw as (select portfolio_id, fund_code, least(greatest(1+0.3*(total-mu)/sd,0.5),1.5)*case when abs(deviation)<=3 then 1.0 when total>=50 then 1+0.25*tanh(abs(deviation)/5)
  when deviation>3 then 1-0.25*tanh(deviation/5) else 1-0.125*tanh(abs(deviation)/5) end r from st),
it as (select portfolio_id, fund_code, r/sum(r) over (partition by portfolio_id) wt, false done, 0 n from raw
  union all select portfolio_id, fund_code, case when done then wt when abs(ex)<1e-6 or fs<=0 then c when c>0.03 and c<0.25 then c+ex*c/fs else c end, done or abs(ex)<1e-6 or fs<=0, n+1
  from (select *, sum(wt) over (partition by portfolio_id)-sum(c) over (partition by portfolio_id) ex, sum(case when c>0.03 and c<0.25 then c else 0 end) over (partition by portfolio_id) fs
    from (select *, least(greatest(wt,0.03),0.25) c from it where n<10)))
select portfolio_id, fund_code, round(wt/sum(wt) over (partition by portfolio_id),6) weight from it where n=10""")
def tilted_weights(spark, d):
    scored = P.prosperity(brand_sets(spark, d).join(last_factors(spark, d), "fund_code"), ["portfolio_id"])
    return P.tilted_weights(cut_lineage(scored), ["portfolio_id"]).select("portfolio_id", "fund_code", *r6("weight"))


@query("weight_factors", "X20 X21", "nav_weekly", f"""with {SETS_SQL}, {PROS_SQL},
g as (select fund_code, deviation, breadth score from fac where rn=1), m as (select avg(score) mu, stddev_pop(score) sd from g)
select fund_code, round(least(greatest(1+0.3*(score-mu)/sd,0.5),1.5),6) strength_factor, round(case when abs(deviation)<=3 then 1.0 when score>=50 then 1+0.25*tanh(abs(deviation)/5)
 when deviation>3 then 1-0.25*tanh(deviation/5) else 1-0.125*tanh(abs(deviation)/5) end,6) deviation_factor,
 case when score/1000-0.05>0.005 then '加码' when score/1000-0.05< -0.005 then '减码' else '标配' end tag from g, m""")
def weight_factors(spark, d):
    rows = last_factors(spark, d)
    stats = rows.agg(F.struct(F.avg("breadth").alias("m"), F.stddev_pop("breadth").alias("s"))).scalar()
    rows = rows.withColumn("_m", stats)
    return rows.select(
        "fund_code", F.round(X.prosperity_factor("breadth", F.col("_m.m"), F.col("_m.s")), 6).alias("strength_factor"),
        F.round(X.deviation_factor("breadth", "deviation"), 6).alias("deviation_factor"),
        X.advice_tag(F.col("breadth") / 1000, F.lit(0.05)).alias("tag"))


@query("balance_caps", "X29", "", """
select c_custkey, case when c_custkey%3=0 then least(greatest(c_custkey%50/100.0,0.10),0.30) else case c_custkey%7 when 0 then 0.22 when 1 then 0.18 when 2 then 0.14 when 3 then 0.22 else 0.14 end end cap from customer""")
def balance_caps(spark, d):
    k = F.col("c_custkey")
    words = F.when(k % 7 == 0, "松").when(k % 7 == 1, " Medium ").when(k % 7 == 2, "紧").when(k % 7 == 3, "LOOSE").when(k % 7 == 4, "other")
    return A.table(spark, d, "customer").select("c_custkey", X.balance_cap(words, F.when(k % 3 == 0, k % 50 / 100)).alias("cap"))


BY = ["set"]


def brand_scenario(spark, d):
    """Clusters of the brand funds by all their holdings of the newest quarter, with scores and vectors."""
    held = A.brand_holdings(spark, d).withColumn("set", F.lit("all"))
    newest = held.groupBy("set").agg(F.max("quarter").alias("quarter"))
    held = cut_lineage(held.join(newest, ["set", "quarter"], "left_semi"))
    industry = A.stock_industry(spark, d)
    stocks, industries, _ = O.profiles(held, industry, BY)
    clusters = cut_lineage(T.theme_clusters(M.fund_vectors(stocks, industries, BY), BY))
    funds = A.brand_funds(spark, d)
    stats = S.return_stats(A.nav_weekly(spark, d), ["fund_code"], "observed_sample")
    metrics = funds.withColumnRenamed("code", "fund_code").join(stats, "fund_code").select(
        F.lit("all").alias("set"), "fund_code", F.col("sharpe").alias("sharpe_3y"),
        (F.col("annual_return") / F.abs("max_drawdown")).alias("risk_return_ratio_3y"), "scale", "establish_date")
    scores = T.composite_scores(metrics, BY, "2001-11-05")
    members = cut_lineage(T.assemble(clusters, T.top_industries(industries, clusters, BY), scores, BY))
    vectors = O.with_industry(held, industry).groupBy("fund_code", "label").agg(F.sum("hold_ratio").alias("ratio"))
    return members, vectors, held, industry


def caps(spark, d):
    """One cap per region of the test data: 10 % to 26 %."""
    return A.table(spark, d, "region").select((0.10 + F.col("r_regionkey") * 0.04).alias("cap"))


def chosen_funds(spark, d):
    members, vectors, held, industry = brand_scenario(spark, d)
    cands = P.candidates(members, vectors, caps(spark, d), BY)
    return cut_lineage(P.choose_funds(cands, BY)), held, industry


@query("choose_funds", "C2 C3 G2")
def choose_funds(spark, d):
    return chosen_funds(spark, d)[0]


@query("position_advice", "C7 X21 A40")
def position_advice(spark, d):
    """Chosen funds with tags, the curve's figures and look-through totals, for every cap."""
    chosen, held, industry = chosen_funds(spark, d)
    key = [*BY, "cap"]
    series = A.nav_weekly(spark, d)
    items = P.advice(chosen, last_factors(spark, d), BY)
    curve = L.portfolio_curve(chosen.select(*key, "fund_code", "weight"), series, key)
    stats = S.return_stats(curve, key, "observed_sample").select(*key, "annual_return", "annual_vol", "sharpe", "max_drawdown")
    holdings = held.select("fund_code", "asset_code", "asset_name", "hold_ratio")
    _, industries, summary = O.look_through(chosen.select(*key, "fund_code", "weight"), holdings, industry, key)
    share = O.max_industry_share(industries, key)
    fresh = P.freshness(series, held, chosen.select(*key, "fund_code"), key)
    return items.select(*key, "cluster_id", "fund_code", "cluster_rank", "weight", "base_weight", "total", "deviation", "tag", "reason") \
        .join(stats, key, "left").join(summary, key, "left").join(share, key, "left").join(fresh, key, "left")


WF_SQL = f"""{SETS_SQL},
j as (select portfolio_id, fund_code, trade_date, nav from w join nav_weekly using (fund_code)),
c as (select portfolio_id, trade_date, row_number() over (partition by portfolio_id order by trade_date)-1 idx from (select portfolio_id, trade_date from j group by 1,2 having count(*)=(select count(*) from w where w.portfolio_id=j.portfolio_id))),
n as (select portfolio_id, count(*) len from c group by 1), r as (select j.*, idx, len from j join c using (portfolio_id, trade_date) join n using (portfolio_id) where len>=143),
d as (select *, cast(floor((idx-1-120)/21.0) as integer) seg from r where idx>120),
x as (select d.portfolio_id, d.trade_date, d.seg, avg(d.nav/b.nav) rel from d join r b on b.portfolio_id=d.portfolio_id and b.fund_code=d.fund_code and b.idx=120+d.seg*21 group by 1,2,3),
e as (select portfolio_id, seg, arg_max(rel,trade_date) z from x group by 1,2), ch as (select portfolio_id, seg, exp(coalesce(sum(ln(z)) over (partition by portfolio_id order by seg rows between unbounded preceding and 1 preceding),0)) k from e)"""


@query("walk_forward_equal", "C8", "nav_weekly", f"""with {WF_SQL}
select portfolio_id, trade_date, round(rel*k,6) equal from x join ch using (portfolio_id, seg) union all select distinct portfolio_id, trade_date, 1.0 from r where idx=120""")
def walk_forward_equal(spark, d):
    return P.walk_forward(brand_sets(spark, d), A.nav_weekly(spark, d), ["portfolio_id"]).select("portfolio_id", "trade_date", *r6("equal"))


@query("walk_forward", "C8 J33")
def walk_forward(spark, d):
    curve = P.walk_forward(brand_sets(spark, d), A.nav_weekly(spark, d), ["portfolio_id"])
    return P.compare_curves(curve, ["portfolio_id"])
