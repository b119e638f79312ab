"""Quality portfolios of the brand funds at many dates, replay and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.functions import scalars as X, stats as S
from navloom.operators import ledger as L
from navloom.operators import quality as Q
from navloom.plans.columns import r6
from navloom.plans.registry import query
from navloom.session import cut_lineage
from navloom.sources import adapters as A

RUN_DATE = "2001-11-05"
PARAMS = Q.QualityParams(
    min_tenure_days=200, min_nav_days=100, roll=52, align_start="1996-01-01", min_common_days=60, target=10, extra=4)


def brand_pool(spark, d):
    return A.brand_funds(spark, d).select(
        F.col("code").alias("fund_code"), "name", "company",
        F.datediff(F.lit(RUN_DATE).cast("date"), F.col("establish_date")).alias("tenure_days"))


def half_years(spark, d):
    """Decision dates: every half year of the order log from 1998 on."""
    last = A.table(spark, d, "orders").agg(F.max("o_orderdate").cast("date").alias("last"))
    return last.select(F.explode(X.anchor_dates(F.lit("1998-01-31").cast("date"), F.col("last"), 6)).alias("as_of"))


def space_of(spark, d):
    return Q.build_space(brand_pool(spark, d), A.nav_weekly(spark, d), A.brand_holdings(spark, d), half_years(spark, d), RUN_DATE, PARAMS)


#: the scored pool of every date, as `z`
SCORED_SQL = """dd as (select cast(d as date) as_of from (select unnest([date '1998-01-31']) d union all select unnest(range(date '1998-07-28', (select cast(max(o_orderdate) as date)+1 from orders), interval 6 month)))),
r as (select fund_code, trade_date, nav/lag(nav) over (partition by fund_code order by trade_date)-1 r from nav_weekly),
w as (select *, case when count(r) over f=52 and stddev_pop(r) over f>0 then avg(r) over f/stddev_pop(r) over f*sqrt(252) end sh from r window f as (partition by fund_code order by trade_date rows 51 preceding)),
g as (select as_of, fund_code, count(*) as days, median(sh) sm, stddev_pop(sh) ss, count(sh) ns, case when count(*) filter (r<0)>=5 then avg(r)/sqrt(avg(r*r) filter (r<0))*sqrt(252) end sortino from dd join w on trade_date<=as_of group by 1,2),
t as (select g.*, greatest(0, date_diff('day',establish_date,date '2001-11-05')-date_diff('day',as_of,date '2001-11-05')) tenure_days from g join brand_funds on code=fund_code where g.days>=100),
c as (select as_of, (select max(x) from (select year(e)||'Q'||quarter(e) x from (select cast(range as date)-1 e from range(date '1994-01-01', date '2003-01-01', interval 3 month)) where e+45<=as_of)) cutoff from dd),
h as (select as_of, fund_code, quarter, asset_code, hold_ratio v from c join brand_holdings on quarter<=cutoff),
q as (select as_of, fund_code, quarter, sum(v) t, lead(quarter) over (partition by as_of, fund_code order by quarter) nq, lead(sum(v)) over (partition by as_of, fund_code order by quarter) t2 from h group by 1,2,3),
x as (select q.as_of, q.fund_code, q.quarter, any_value(t) t, any_value(t2) t2, sum(case when b.v is not null then least(a.v,b.v) end) m from q left join h a on a.as_of=q.as_of and a.fund_code=q.fund_code and a.quarter=q.quarter
  left join h b on b.as_of=q.as_of and b.fund_code=q.fund_code and b.quarter=nq and b.asset_code=a.asset_code where nq is not null group by 1,2,3),
dr as (select as_of, fund_code, avg((t+t2-2*coalesce(m,0))/(t+t2)) drift from x group by 1,2),
p as (select t.as_of, t.fund_code, sm, ss, sortino, tenure_days, drift from t left join dr on dr.as_of=t.as_of and dr.fund_code=t.fund_code where tenure_days>=200 and ns>=10 and t.days>=72 and sm is not null),
s as (select *, median(sm) over k m1, stddev_pop(sm) over k s1, median(ss) over k m2, stddev_pop(ss) over k s2, median(sortino) over k m3, stddev_pop(sortino) over k s3, median(tenure_days) over k m4, stddev_pop(tenure_days) over k s4,
  median(drift) over k m5, stddev_pop(drift) over k s5, count(*) over k n from p window k as (partition by as_of)),
z as (select *, case when s1>1e-12 then least(greatest((sm-m1)/s1,-2),2) else 0 end z1, case when s2>1e-12 then least(greatest((ss-m2)/s2,-2),2) else 0 end z2,
  case when sortino is not null and s3>1e-12 then least(greatest((sortino-m3)/s3,-2),2) else 0 end z3, case when s4>1e-12 then least(greatest((tenure_days-m4)/s4,-2),2) else 0 end z4,
  case when drift is not null and s5>1e-12 then least(greatest((drift-m5)/s5,-2),2) else 0 end z5 from s)"""


@query("quality_scores", "A12 F18 W9 A17 A19", "nav_weekly brand_funds brand_holdings", f"""
with {SCORED_SQL}
select as_of, fund_code, round(sm,6) sharpe_med, round(ss,6) sharpe_std, round(sortino,6) sortino, round(drift,6) drift, round(0.35*z1-0.20*z2+0.25*z3+0.10*z4-0.10*z5,6) quality from z where n>=10""")
def quality_scores(spark, d):
    out = Q.score(brand_pool(spark, d), A.nav_weekly(spark, d), A.brand_holdings(spark, d), half_years(spark, d), RUN_DATE, PARAMS)
    return out.select("as_of", "fund_code", *r6("sharpe_med", "sharpe_std", "sortino", "drift", "quality"))


def weekly_vectors(spark, d):
    """Weekly returns of the brand funds on their shared weeks, as vectors."""
    nav = cut_lineage(A.nav_weekly(spark, d))
    group = F.floor(F.length("fund_code") / 100)  # one set
    members = nav.select(group.alias("set"), "fund_code").distinct()
    from navloom.operators.joins import common_dates
    from navloom.operators.scale import numbered

    rows = S.simple_returns(common_dates(members, nav, ["set"]), ["set", "fund_code"]).where(F.col("ret").isNotNull())
    vectors = rows.groupBy("set", "fund_code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "ret"))), lambda s: s["ret"]).alias("rets"))
    return numbered(vectors.withColumn("_b", F.substring("fund_code", 1, 7)), ["set"], "_b", [F.col("fund_code")], "pos").drop("_b")


@query("correlations", "A33", "nav_weekly", """
with c as (select trade_date from nav_weekly group by 1 having count(*)=(select count(distinct fund_code) from nav_weekly)),
r as (select fund_code, trade_date, nav/lag(nav) over (partition by fund_code order by trade_date)-1 r from nav_weekly where trade_date in (select trade_date from c))
select a.fund_code i, b.fund_code j, round(corr(a.r,b.r),6) corr from r a join r b on a.trade_date=b.trade_date and a.fund_code<b.fund_code where a.r is not null group by 1,2""")
def correlations(spark, d):
    return Q.correlation_edges(weekly_vectors(spark, d), ["set"]).select("i", "j", *r6("corr"))


@query("market_residuals", "A34 A35")
def market_residuals(spark, d):
    """Aligned pool at every date with style axes and the variance shares of the directions."""
    return space_of(spark, d)[1].select("as_of", "fund_code", "q01", "axes", "pc1_var_ratio", "axis_var", "common_days")


@query("quality_portfolio", "C12 C13 C14 A36")
def quality_portfolio(spark, d):
    _, space = space_of(spark, d)
    return Q.quality_portfolio(space, PARAMS).select(
        "as_of", "rank", "fund_code", "company", "quality", "q01", "weight", "orig_corr_mean", "resid_corr_mean", "enb", "pc1_var_ratio", "axes")


@query("quality_diagnosis", "C15")
def quality_diagnosis(spark, d):
    _, space = space_of(spark, d)
    picks = cut_lineage(Q.greedy_pick(space, PARAMS))
    codes = A.brand_funds(spark, d).select(F.col("code").alias("fund_code"))
    return Q.diagnose(space, picks, codes, PARAMS)


@query("quality_funnel", "A42 C12", "nav_weekly brand_funds brand_holdings", f"""
with {SCORED_SQL},
pool as (select as_of, fund_code from z where n>=10),
w2 as (select as_of, fund_code, trade_date from pool join nav_weekly using (fund_code) where trade_date>=date '1996-01-01' and trade_date<=as_of),
td as (select as_of, count(distinct trade_date) total from w2 group by 1),
al as (select as_of, fund_code from w2 join td using (as_of) group by as_of, fund_code, total having count(*)>=total*0.95),
an as (select as_of, count(*) m from al group by 1),
cd as (select as_of, trade_date from w2 join al using (as_of, fund_code) join an using (as_of) group by as_of, trade_date, m having count(*)=m),
cc as (select as_of, count(*) common from cd group by 1 having count(*)>=60),
sc as (select as_of, count(*) scored from pool group by 1)
select sc.as_of, scored, case when common is not null then m end aligned_pool, cast(common as integer) common_days, (select count(*) from brand_funds) universe, round(common/total,6) common_days_ratio
from sc left join cc using (as_of) left join an using (as_of) left join td using (as_of)""")
def quality_funnel(spark, d):
    scored, space = space_of(spark, d)
    return Q.funnel(brand_pool(spark, d), scored, space).withColumn("common_days_ratio", F.round("common_days_ratio", 6))


@query("quality_backtest", "C14 C26")
def quality_backtest(spark, d):
    """Curve figures of every date's portfolio; the saved portfolios are read back as targets."""
    from navloom.operators.reconcile import targets_from_portfolio

    _, space = space_of(spark, d)
    held = cut_lineage(Q.quality_portfolio(space, PARAMS).where(F.col("weight").isNotNull()))
    curve = L.portfolio_curve(
        held.select("as_of", "fund_code", "weight"), A.nav_weekly(spark, d).where(F.col("trade_date") >= PARAMS.align_start), ["as_of"])
    stats = S.return_stats(curve, ["as_of"], "observed_population")
    saved = held.groupBy("as_of").agg(F.collect_list(F.struct("fund_code", "weight", "rank")).alias("holdings")).withColumn("user_id", F.lit(1))
    targets = targets_from_portfolio(saved).groupBy("user_id").agg(F.count("*").alias("targets"), F.max("as_of").alias("latest"))
    return stats.withColumn("user_id", F.lit(1)).join(targets, "user_id").drop("user_id")


@query("replay", "C16 X19 A15")
def replay(spark, d):
    """Half-yearly re-selection with at most three replacements, against buying once."""
    nav = A.nav_weekly(spark, d)
    anchors = cut_lineage(half_years(spark, d))
    _, space = space_of(spark, d)
    picks = Q.greedy_pick(space, PARAMS)
    held = cut_lineage(Q.replay_holdings(picks, anchors, PARAMS))
    weights = cut_lineage(Q.trailing_weights(held, nav, PARAMS, least=60))
    start = weights.agg(F.min("as_of")).scalar()
    first = weights.where(F.col("as_of") == start)
    curve = Q.stitched_curve(weights, nav, anchors, RUN_DATE).select(F.lit("replay").alias("kind"), "trade_date", "nav")
    hold = Q.stitched_curve(first, nav, first.select("as_of").distinct(), RUN_DATE).select(F.lit("buyhold").alias("kind"), "trade_date", "nav")
    stats = S.return_stats(curve.unionByName(hold), ["kind"], "observed_population")
    turnover = held.agg(F.count_if("is_new")).scalar()
    return stats.withColumn("entries", turnover)
