"""Industry pages, holdings profiles, manager attribution and fund bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions import scalars as X
from navloom.operators import bundle as B
from navloom.operators import holdings as O
from navloom.operators import joins as J
from navloom.operators import windows as W
from navloom.operators.paging import page
from navloom.plans.columns import r6
from navloom.plans.registry import query
from navloom.session import cut_lineage
from navloom.sources import adapters as A

LABEL = "coalesce(nullif(sw_l3,''),nullif(sw_l2,''),nullif(em_industry,''),'其他')"
AS_OF = "2001-08-01"


def held(spark, d):
    return O.held_stocks(A.fund_holdings(spark, d))


HELD_SQL = "held as (select asset_code stock_code, min(asset_name) held_name from fund_holdings where holding_type='stock' group by 1)"


def known_industry(spark, d):
    """The industry map with all labels of every seventh stock missing, so that some held stocks have none."""
    known = F.col("stock_code").cast("int") % 7 != 0
    labels = ("sw_l1", "sw_l2", "sw_l3", "em_industry")
    return A.stock_industry(spark, d).withColumns({c: F.when(known, F.col(c)) for c in labels})


IND_SQL = "ind as (select * replace (" + ", ".join(
    f"case when cast(stock_code as int)%7<>0 then {c} end as {c}" for c in ("sw_l1", "sw_l2", "sw_l3", "em_industry")
) + ") from stock_industry)"


@query("industry_page", "J2 A2 O2 X9", "fund_holdings stock_industry", f"""
with {HELD_SQL}, {IND_SQL},
r as (select stock_code, held_name stock_name, 'A' market, coalesce(sw_l1,'') sw_l1, coalesce(sw_l2,'') sw_l2, coalesce(sw_l3,'') sw_l3,
  coalesce(em_industry,'') em_industry, coalesce(manual,0) manual, coalesce(sw_l3,'')<>'' or coalesce(em_industry,'')<>'' covered,
  case when coalesce(sw_l3,'')<>'' or coalesce(em_industry,'')<>'' then coalesce(nullif(sw_l3,''),nullif(sw_l2,''),nullif(em_industry,'')) else '' end as label
  from held left join ind using (stock_code))
select * from (select *, count(*) over () total from r where (sw_l3||sw_l2||sw_l1||em_industry) ilike '%brand%' and (stock_code ilike '%1%' or stock_name ilike '%ring%')
order by covered desc, stock_code limit 50 offset 50)""")
def industry_page(spark, d):
    rows = O.industry_page(A.fund_holdings(spark, d), known_industry(spark, d))
    text = F.concat("sw_l3", "sw_l2", "sw_l1", "em_industry")
    hits = rows.where(text.ilike("%brand%") & (F.col("stock_code").ilike("%1%") | F.col("stock_name").ilike("%ring%")))
    total = hits.agg(F.count("*")).scalar()
    return page(hits, [F.desc("covered"), F.asc("stock_code")], 2, 50).withColumn("total", total)


@query("industry_coverage", "A3 A7 X8", "fund_holdings stock_industry", f"""
with {HELD_SQL}, {IND_SQL},
m as (select h.stock_code, sw_l3, em_industry, case when h.stock_code in ('000660','005930','009150','042700','055550','105560') then 'OTHER'
  when substr(h.stock_code,1,3) in ('000','001','002','003','300','301','302') then 'A' else 'OTHER' end mk from held h left join ind using (stock_code)),
f as (select *, coalesce(sw_l3,'')<>'' sw, coalesce(em_industry,'')<>'' em from m)
select count(*) filter (mk<>'OTHER') held_total, count(*) filter (mk='A') a_total, 0::bigint hk_total, count(*) filter (mk='OTHER') other_total,
 count(*) filter (mk='A' and sw) a_sw_covered, count(*) filter (mk='A' and not sw and em) a_em_covered, count(*) filter (mk='A' and not sw and not em) a_uncovered,
 0::bigint hk_covered, 0::bigint hk_uncovered, count(*) filter (mk<>'OTHER' and (sw or em)) covered_total,
 round(count(*) filter (mk<>'OTHER' and (sw or em))*100.0/count(*) filter (mk<>'OTHER'),6) coverage_pct,
 round(count(*) filter (mk='A' and sw)*100.0/count(*) filter (mk='A'),6) a_sw_pct,
 (select count(distinct nullif(sw_l3,'')) from ind) sw_l3_count from f""")
def industry_coverage(spark, d):
    out = O.coverage(held(spark, d), known_industry(spark, d))
    return out.select(*[c for c in out.columns if not c.endswith("pct")], *r6("coverage_pct", "a_sw_pct"))


@query("label_breakdown", "A4 X10 X28", "fund_holdings stock_industry", f"""
with {HELD_SQL}, {IND_SQL}
select 'label' kind, case when ind.stock_code is null then '未覆盖' else {LABEL} end as label, count(*) as n from held left join ind using (stock_code) group by 1,2
union all select 'eff_l1', coalesce(nullif(sw_l1,''),nullif(em_industry,''),''), count(*) from ind group by 1,2
union all select 'sector', case when sw_l1<>'' then sw_l1 when em_industry<>'' then '港股' else '其他' end, count(*) from ind group by 1,2""")
def label_breakdown(spark, d):
    ind = known_industry(spark, d)
    one = O.label_breakdown(held(spark, d), ind).select(F.lit("label").alias("kind"), "label", F.col("count").alias("n"))
    two = ind.groupBy(X.effective_l1().alias("label")).agg(F.count("*").alias("n")).select(F.lit("eff_l1").alias("kind"), "label", "n")
    three = ind.groupBy(X.sector_group().alias("label")).agg(F.count("*").alias("n")).select(F.lit("sector").alias("kind"), "label", "n")
    return one.unionByName(two).unionByName(three)


@query("uncovered_stocks", "J17 J18", "fund_holdings stock_industry", f"""
with {HELD_SQL}, {IND_SQL}
select 'uncovered' kind, stock_code, 'A' market from held left join ind using (stock_code)
 where coalesce(sw_l3,'')='' and coalesce(em_industry,'')='' and stock_code not in ('000660','005930','009150','042700','055550','105560') and substr(stock_code,1,3) in ('000','001','002','003')
union all select 'overseas', stock_code, 'OTHER' from held where substr(stock_code,1,3) in ('000','001','002','003') and stock_code not in ('000660','005930','009150','042700','055550','105560')
 and stock_code not in (select printf('%06d', l_suppkey) from lineitem)""")
def uncovered_stocks(spark, d):
    gaps = O.uncovered(held(spark, d), known_industry(spark, d), ["A", "HK"])
    master = A.table(spark, d, "lineitem").select(A.code6("l_suppkey").alias("stock_code")).distinct()
    odd = O.overseas_lookalikes(held(spark, d), master)
    return gaps.select(F.lit("uncovered").alias("kind"), "stock_code", F.col("market_of").alias("market")).unionByName(
        odd.select(F.lit("overseas").alias("kind"), "stock_code", "market"))


@query("holdings_with_industry", "J6 W3 J29 U9", "fund_holdings stock_industry", f"""
with q as (select fund_code, holding_type, max(quarter) as newest, count(distinct quarter) n_quarters, max(case when quarter='1999Q3' then quarter end) as wanted
  from fund_holdings group by 1,2),
h as (select fund_code, holding_type, quarter, asset_code, hold_ratio, n_quarters, row_number() over (partition by fund_code, holding_type order by hold_ratio desc, asset_code) rk
  from fund_holdings join q using (fund_code, holding_type) where quarter=coalesce(wanted,newest))
select fund_code, holding_type, quarter, asset_code, round(hold_ratio,6) hold_ratio, rk as "rank", n_quarters, {LABEL} as label
from h left join stock_industry on stock_code=asset_code where rk<=10""")
def holdings_with_industry(spark, d):
    rows = A.fund_holdings(spark, d)
    quarters = O.available_quarters(rows).select(
        "fund_code", "holding_type", F.size("quarters").cast("bigint").alias("n_quarters"),
        F.when(F.array_contains("quarters", "1999Q3"), "1999Q3").otherwise(F.get("quarters", F.lit(0))).alias("quarter"))
    one = rows.join(quarters, ["fund_code", "holding_type", "quarter"])
    return O.with_industry(W.top_holdings(one, 10, newest_only=False), A.stock_industry(spark, d)).select(
        "fund_code", "holding_type", "quarter", "asset_code", *r6("hold_ratio"), F.col("rank").cast("bigint").alias("rank"), "n_quarters", "label")


@query("fund_profiles", "A8", "holdings_overlap stock_industry", f"""
select 'stock' kind, fund_code, quarter, asset_code as "key", round(sum(hold_ratio),6) ratio from holdings_overlap group by 1,2,3,4
union all select 'industry', fund_code, quarter, {LABEL}, round(sum(hold_ratio),6) from holdings_overlap left join stock_industry on stock_code=asset_code group by 1,2,3,4""")
def fund_profiles(spark, d):
    stocks, industries, _ = O.profiles(A.holdings_overlap(spark, d), A.stock_industry(spark, d), ["quarter"])
    return stocks.withColumn("kind", F.lit("stock")).unionByName(industries.withColumn("kind", F.lit("industry"))).select(
        "kind", "fund_code", "quarter", "key", *r6("ratio"))


@query("funds_without_stocks", "U1", "fund_holdings", """
select fund_code, quarter from fund_holdings group by 1,2 having count(*) filter (holding_type='stock' and hold_ratio<>0)=0""")
def funds_without_stocks(spark, d):
    return O.profiles(A.fund_holdings(spark, d), A.stock_industry(spark, d), ["quarter"])[2].select("fund_code", "quarter")


@query("industry_vectors", "A9", "fund_holdings stock_industry", f"""
with q as (select fund_code, max(quarter) as quarter from fund_holdings where holding_type='stock' group by 1),
h as (select fund_code, asset_code, hold_ratio, row_number() over (partition by fund_code order by hold_ratio desc, asset_code) rk
  from fund_holdings join q using (fund_code, quarter) where holding_type='stock')
select fund_code, {LABEL} as label, round(sum(hold_ratio),6) ratio from h left join stock_industry on stock_code=asset_code where rk<=10 group by 1,2""")
def industry_vectors(spark, d):
    return O.industry_vectors(A.fund_holdings(spark, d), A.stock_industry(spark, d)).select("fund_code", "label", *r6("ratio"))


@query("style_drift", "A19", "fund_holdings", """
with q as (select fund_code, quarter, sum(hold_ratio) t, lead(quarter) over (partition by fund_code order by quarter) nq from fund_holdings where holding_type='stock' group by 1,2),
 p as (select q.fund_code, q.quarter, nq, q.t, r.t t2 from q join (select fund_code, quarter, t from q) r on r.fund_code=q.fund_code and r.quarter=nq),
 s as (select fund_code, quarter, asset_code, sum(hold_ratio) v from fund_holdings where holding_type='stock' group by 1,2,3),
 x as (select p.fund_code, p.quarter, any_value(t) t, any_value(t2) t2, sum(case when b.v is not null then least(a.v,b.v) end) m from p left join s a on a.fund_code=p.fund_code and a.quarter=p.quarter
   left join s b on b.fund_code=p.fund_code and b.quarter=nq and b.asset_code=a.asset_code group by 1,2)
select fund_code, round(avg((t+t2-2*coalesce(m,0))/(t+t2)),6) drift from x group by 1""")
def style_drift(spark, d):
    return O.style_drift(A.fund_holdings(spark, d).where(F.col("holding_type") == "stock")).select("fund_code", *r6("drift"))


THEME_SQL = "case when l1='' then '未知' when l1 in ('电子','通信','软件服务') then '泛科技TMT' when l1='医药生物' then '医药' when l1='银行' then '金融地产' else '其他' end"
PROFILE_SQL = f"""
s as (select fund_code, quarter, asset_code, asset_name, hold_ratio, row_number() over (partition by fund_code, quarter order by hold_ratio desc, asset_code) rk
  from fund_holdings where holding_type='stock'),
n as (select fund_code, quarter, count(*) num_stock from s group by 1,2),
t0 as (select s.*, coalesce(nullif(sw_l1,''),nullif(em_industry,''),'') l1 from s left join stock_industry on stock_code=asset_code where rk<=10),
t as (select fund_code, quarter, asset_code, asset_name, hold_ratio, rk, case when l1='' then '未知' else l1 end l1, {THEME_SQL} theme from t0),
g as (select fund_code, quarter, sum(hold_ratio) filter (rk<=1) top1_ratio, sum(hold_ratio) filter (rk<=3) top3_ratio, sum(hold_ratio) filter (rk<=5) top5_ratio,
  sum(hold_ratio) top10_ratio, sum(hold_ratio*hold_ratio)/10000 hhi_top10, count(*) filter (l1<>'未知') l1_mapped, max(case when rk=1 then asset_name end) top1_name,
  list(asset_code order by rk) codes from t group by 1,2),
a1 as (select fund_code, quarter, l1 k, sum(hold_ratio) v from t group by 1,2,3), a2 as (select fund_code, quarter, theme k, sum(hold_ratio) v from t group by 1,2,3),
m1 as (select fund_code, quarter, sum(v) allv, count(*) filter (k not in ('未知','其他')) dn,
  coalesce(arg_max(k,v) filter (k not in ('未知','其他')), arg_max(k,v)) k, coalesce(max(v) filter (k not in ('未知','其他')), max(v)) v from a1 group by 1,2),
m2 as (select fund_code, quarter, sum(v) allv, count(*) filter (k not in ('未知','其他')) dn,
  coalesce(arg_max(k,v) filter (k not in ('未知','其他')), arg_max(k,v)) k, coalesce(max(v) filter (k not in ('未知','其他')), max(v)) v from a2 group by 1,2),
prof as (select g.*, num_stock, num_stock>15 is_full_report, m1.k top_l1, m1.v/m1.allv*100 top_l1_share, m1.dn distinct_l1, m2.k top_theme, m2.v/m2.allv*100 top_theme_share,
  m2.dn distinct_theme from g join n using (fund_code, quarter) join m1 using (fund_code, quarter) join m2 using (fund_code, quarter))"""


def profile(spark, d):
    return O.quarter_profile(A.fund_holdings(spark, d), A.stock_industry(spark, d))


@query("quarter_profile", "A20 A21", "fund_holdings stock_industry", f"""
with {PROFILE_SQL}
select fund_code, quarter, num_stock, is_full_report, top1_name, round(top1_ratio,6) top1_ratio, round(top3_ratio,6) top3_ratio, round(top5_ratio,6) top5_ratio,
 round(top10_ratio,6) top10_ratio, round(hhi_top10,8) hhi_top10, l1_mapped, top_l1, round(top_l1_share,6) top_l1_share, distinct_l1, top_theme,
 round(top_theme_share,6) top_theme_share, distinct_theme from prof""")
def quarter_profile(spark, d):
    return profile(spark, d).select(
        "fund_code", "quarter", "num_stock", "is_full_report", "top1_name", *r6("top1_ratio", "top3_ratio", "top5_ratio", "top10_ratio"),
        F.round("hhi_top10", 8).alias("hhi_top10"), "l1_mapped", "top_l1", *r6("top_l1_share"), "distinct_l1", "top_theme",
        *r6("top_theme_share"), "distinct_theme")


@query("quarter_overlaps", "A24", "fund_holdings stock_industry", f"""
with {PROFILE_SQL}, l as (select fund_code, quarter, codes, lead(quarter) over w nq, lead(codes) over w nc from prof window w as (partition by fund_code order by quarter))
select fund_code, quarter from_quarter, nq to_quarter, cast(len(list_intersect(codes,nc)) as integer) overlap, cast(least(len(codes),len(nc)) as integer) "of" from l where nq is not null""")
def quarter_overlaps(spark, d):
    return O.quarter_overlaps(profile(spark, d))


SUMMARY_SQL = f"""{PROFILE_SQL},
z as (select fund_code, count(*) as quarters, arg_min(top10_ratio,quarter) t0, arg_max(top10_ratio,quarter) t1, arg_min(top_theme_share,quarter) s0,
  arg_max(top_theme_share,quarter) s1, arg_max(distinct_l1,quarter) ll, count(*) filter (top_theme not in ('未知','其他')) doms,
  count(distinct top_theme) filter (top_theme not in ('未知','其他')) dd, avg(top_theme_share) av, avg(distinct_l1) al, arg_max(top_theme,quarter) lt from prof group by 1),
summ as (select fund_code, quarters, case when quarters>=2 then case when t1-t0>5 then '上升' when t1-t0<-5 then '下降' else '平稳' end end concentration_trend,
  case when quarters>=2 and s0>0 and s1>0 then case when s1-s0>8 then '收敛(更集中)' when s1-s0<-8 then '发散(更分散)' else '稳定' end end theme_trend,
  dd distinct_dominant_theme, case when doms=0 then '未知' when ll>=7 and s1<50 then '多行业分散(选股型)' when dd=1 and doms>=quarters-1 and s1>=55 then '单一主题高度集中(赛道特征)'
   when dd=1 and doms>=quarters-1 and s1>=42 then '单一主题主导(赛道倾向)' when dd>=2 and av>=45 then '主题轮动(主导主题跨季切换)'
   when s1<42 or al>=5 then '多行业分散(选股型)' else '较分散/混合' end sector_focus, lt latest_top_theme, s1 latest_top_theme_share, ll latest_l1, t1 latest_top10_ratio from z)"""


@query("holdings_trends", "A22 A23", "fund_holdings stock_industry", f"""
with {SUMMARY_SQL}
select fund_code, quarters, concentration_trend, theme_trend, distinct_dominant_theme, sector_focus, latest_top_theme,
 round(latest_top_theme_share,6) latest_top_theme_share, latest_l1, round(latest_top10_ratio,6) latest_top10_ratio from summ""")
def holdings_trends(spark, d):
    return O.holdings_summary(profile(spark, d)).select(
        "fund_code", "quarters", "concentration_trend", "theme_trend", "distinct_dominant_theme", "sector_focus", "latest_top_theme",
        *r6("latest_top_theme_share"), "latest_l1", *r6("latest_top10_ratio"))


@query("disclosed_holdings", "J22 X16", "fund_holdings", """
with d as (select distinct cast(date_trunc('quarter', o_orderdate) as date)+59 as_of from orders),
 c as (select as_of, (select max(x) from (select year(e)||'Q'||quarter(e) x from (select cast(range as date)-1 e from range(date '1994-01-01', date '2003-01-01', interval 3 month))
   where e+45<=as_of)) cutoff from d)
select as_of, count(*) as n, max(quarter) as newest, round(sum(hold_ratio),4) ratio from c join fund_holdings on quarter<=cutoff group by 1""")
def disclosed_holdings(spark, d):
    from navloom.operators.timeline import visible_totals
    from navloom.plans.nav import quarter_days

    totals = A.fund_holdings(spark, d).groupBy("quarter").agg(F.count("*").alias("n"), F.sum("hold_ratio").alias("ratio"))
    seen = visible_totals(totals, quarter_days(spark, d), [], ["n", "ratio"])
    return seen.select("as_of", "n", "newest", F.round("ratio", 4).alias("ratio"))


@query("resolve_quarter", "J23 X15", "holdings_overlap", """
with d as (select distinct cast(o_orderdate as date) as_of from orders), q as (select distinct quarter from holdings_overlap),
 i as (select as_of, case when month(as_of)>=11 then year(as_of)||'Q3' when month(as_of)>=9 then year(as_of)||'Q2' when month(as_of)>=5 then year(as_of)||'Q1'
   when month(as_of)>=4 then (year(as_of)-1)||'Q4' else (year(as_of)-1)||'Q3' end ideal from d),
 r as (select as_of, ideal, coalesce((select max(quarter) from q where quarter<=ideal),(select min(quarter) from q)) as quarter from i)
select as_of, ideal, quarter, quarter<>ideal is_fallback from r""")
def resolve_quarter(spark, d):
    dates = A.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return J.resolve_quarter(dates, A.holdings_overlap(spark, d)).select("as_of", "ideal", "quarter", "is_fallback")


@query("manager_attribution", "A43 W10 X17", "fund_manager_tenure", f"""
with t as (select *, string_split(managers,' ') names from fund_manager_tenure),
 c as (select fund_code, managers cur_team, names[1] lead_name from t where seq=0),
 b as (select fund_code, cur_team, lead_name, count(*) segment_count, min(seq) filter (managers<>cur_team) tb, min(seq) filter (not list_contains(names,lead_name)) lb
   from t join c using (fund_code) group by 1,2,3),
 x as (select b.*, (select start_date from t where t.fund_code=b.fund_code and seq=coalesce(tb,segment_count)-1) ts,
  (select start_date from t where t.fund_code=b.fund_code and seq=coalesce(lb,segment_count)-1) ls from b),
 ch as (select fund_code, count(*) filter (managers<>older) changes from (select fund_code, managers, lead(managers) over (partition by fund_code order by seq) older from t) group by 1)
select fund_code, cur_team, lead_name as "lead", len(string_split(cur_team,' '))>1 is_comanaged, ts exact_team_since, ls lead_since,
 round(date_diff('day',ts,date '{AS_OF}')/365.0,6) exact_team_years, round(date_diff('day',ls,date '{AS_OF}')/365.0,6) lead_years, segment_count, changes+1 distinct_team_count,
 ts<=date '{AS_OF}'-365 exact_team_covers_1y, ts<=date '{AS_OF}'-1095 exact_team_covers_3y, ts<=date '{AS_OF}'-1825 exact_team_covers_5y,
 ls<=date '{AS_OF}'-365 lead_covers_1y, ls<=date '{AS_OF}'-1095 lead_covers_3y, ls<=date '{AS_OF}'-1825 lead_covers_5y from x join ch using (fund_code)""")
def manager_attribution(spark, d):
    out = B.manager_attribution(A.fund_manager_tenure(spark, d), AS_OF)
    years = ["exact_team_years", "lead_years"]
    return out.select(*[F.round(c, 6).alias(c) if c in years else c for c in out.columns])


@query("manager_list", "J3 J5 A5", "funds fund_details fund_manager_tenure", """
with t as (select * from fund_manager_tenure where seq=0 and end_date is null),
 r as (select code, name, fund_company, scale, managers, start_date, t.fund_code is not null covered from funds f left join fund_details d on d.fund_code=f.code
  left join t on t.fund_code=f.code where (f.code ilike '%1%' or d.fund_name ilike '%1%' or t.managers ilike '%1%'))
select code, name, fund_company, scale, managers, start_date, covered, (select count(*) from r where covered) n_covered, (select count(*) from r where not covered) n_uncovered from r""")
def manager_list(spark, d):
    tenure = A.fund_manager_tenure(spark, d).where((F.col("seq") == 0) & F.col("end_date").isNull()).select(
        "fund_code", "managers", "start_date", F.lit(True).alias("covered"))
    rows = (
        A.funds(spark, d).withColumn("fund_code", F.col("code"))
        .join(A.fund_details(spark, d).select("fund_code", "fund_name", "fund_company", "scale"), "fund_code", "left")
        .join(tenure, "fund_code", "left").withColumn("covered", F.coalesce("covered", F.lit(False))))
    hits = rows.where(X.any_of(F.coalesce(F.col(c).ilike("%1%"), F.lit(False)) for c in ("code", "fund_name", "managers")))
    stats = lambda flag: hits.agg(F.count_if(flag)).scalar()
    return hits.select("code", "name", "fund_company", "scale", "managers", "start_date", "covered",
                       stats(F.col("covered")).alias("n_covered"), stats(~F.col("covered")).alias("n_uncovered"))


@query("tenure_at_dates", "W19", "fund_manager_tenure", """
select o.fund_code, as_of, cast(greatest(0, date_diff('day', start_date, date '2001-08-01') - date_diff('day', as_of, date '2001-08-01')) as integer) tenure_days from fund_manager_tenure o,
 (select distinct cast(date_trunc('year', o_orderdate) as date) as_of from orders) where seq=0""")
def tenure_at_dates(spark, d):
    run = F.lit(AS_OF).cast("date")
    years = A.table(spark, d, "orders").agg(
        F.sequence(F.trunc(F.min("o_orderdate").cast("date"), "year"), F.max("o_orderdate").cast("date"), F.expr("interval 1 year"))).scalar()
    rows = A.fund_manager_tenure(spark, d).where(F.col("seq") == 0).withColumn("as_of", F.explode(years))
    return rows.select("fund_code", "as_of", W.tenure_at(F.datediff(run, F.col("start_date")), run, F.col("as_of")).alias("tenure_days"))


def cum_returns(spark, d):
    return W.rebase(A.nav_daily(spark, d), ["fund_code"]).select(
        "fund_code", "trade_date", ((F.col("rel") - 1) * 100).alias("cum_return"))


REGIME_SQL = f"""
cum as (select fund_code, trade_date, (nav/first(nav) over (partition by fund_code order by trade_date)-1)*100 c from nav_daily),
tm as (select fund_code, min(start_date) exact_team_since from fund_manager_tenure where seq=0 group by 1),
rg as (select cum.fund_code, count(*) points, arg_max(c,trade_date) l, arg_min(c,trade_date) filter (trade_date>=date '{AS_OF}'-365) b1,
 arg_min(c,trade_date) filter (trade_date>=date '{AS_OF}'-1095) b3, arg_min(c,trade_date) filter (trade_date>=exact_team_since) bt from cum left join tm using (fund_code) group by 1)"""


@query("regime_returns", "A44", "nav_daily fund_manager_tenure", f"""
with {REGIME_SQL}
select fund_code, points, round(((1+l/100)/(1+b1/100)-1)*100,6) return_last_1y, round(((1+l/100)/(1+b3/100)-1)*100,6) return_last_3y,
 round(((1+l/100)/(1+bt/100)-1)*100,6) return_since_current_team from rg where points>=2""")
def regime_returns(spark, d):
    starts = A.fund_manager_tenure(spark, d).where(F.col("seq") == 0).select("fund_code", F.col("start_date").alias("exact_team_since"))
    return B.regime_returns(cum_returns(spark, d), starts, AS_OF).select(
        "fund_code", "points", *r6("return_last_1y", "return_last_3y", "return_since_current_team"))


def bundles(spark, d):
    """The whole record of every fund, with its JSON text as `bundle`."""
    tenure = A.fund_manager_tenure(spark, d)
    managers = cut_lineage(B.manager_attribution(tenure, AS_OF))
    regimes = B.regime_returns(cum_returns(spark, d), managers, AS_OF)
    held = B.holdings_record(A.fund_holdings(spark, d), A.stock_industry(spark, d))
    return B.fund_bundle(A.fund_details(spark, d), managers, held, regimes)


def from_bundle(spark, d, path, schema):
    """A list of the record, read back from its JSON text."""
    rows = bundles(spark, d).select("fund_code", F.from_json(F.get_json_object("bundle", path), f"array<struct<{schema}>>").alias("x"))
    return rows.select("fund_code", F.inline("x"))


MIX_SQL = f"""{PROFILE_SQL},
tot as (select fund_code, quarter, sum(hold_ratio) v from t group by 1,2),
x1 as (select a.fund_code, a.quarter, string_agg(k||':'||round(a.v/tot.v*100,4), ',' order by a.v desc, k) l1_mix from (select *, row_number() over (partition by fund_code, quarter order by v desc, k) r from a1) a join tot using (fund_code, quarter) where r<=5 group by 1,2),
x2 as (select a.fund_code, a.quarter, string_agg(k||':'||round(a.v/tot.v*100,4), ',' order by a.v desc, k) theme_mix from (select *, row_number() over (partition by fund_code, quarter order by v desc, k) r from a2) a join tot using (fund_code, quarter) where r<=4 group by 1,2)"""


@query("fund_bundle_quarters", "A45", "fund_details fund_holdings stock_industry", f"""
with {MIX_SQL}
select p.fund_code, p.quarter, case when is_full_report then '全量(半年/年报)' else '前十大(季报)' end report_type, num_stock, top1_name, f.l1 top1_l1, round(top1_ratio,6) top1_ratio,
 round(top3_ratio,6) top3_ratio, round(top5_ratio,6) top5_ratio, round(top10_ratio,6) top10_ratio, round(hhi_top10,8) hhi_top10, l1_mix, top_l1, round(top_l1_share,6) top_l1_share, distinct_l1,
 theme_mix, top_theme, round(top_theme_share,6) top_theme_share, l1_mapped
from prof p join x1 using (fund_code, quarter) join x2 using (fund_code, quarter) join (select fund_code, quarter, nullif(l1,'') l1 from t0 where rk=1) f using (fund_code, quarter)
where fund_code in (select fund_code from fund_details)""")
def fund_bundle_quarters(spark, d):
    mix = "array<struct<{}:string,ratio:double,share:double>>"
    rows = from_bundle(spark, d, "$.holdings.quarters_detail", (
        "quarter:string,report_type:string,num_stock:bigint,top1:struct<name:string,ratio:double,l1:string>,top3_ratio:double,top5_ratio:double,"
        f"top10_ratio:double,hhi_top10:double,l1_mix:{mix.format('l1')},top_l1:string,top_l1_share:double,distinct_l1:bigint,"
        f"theme_mix:{mix.format('theme')},top_theme:string,top_theme_share:double,l1_mapped:bigint"))
    said = lambda name: F.array_join(F.transform(f"{name}_mix", lambda m: F.concat(
        m[name], F.lit(":"), F.round(m["share"], 4).cast("string"))), ",").alias(f"{name}_mix")
    return rows.select(
        "fund_code", "quarter", "report_type", "num_stock", F.col("top1.name").alias("top1_name"), F.col("top1.l1").alias("top1_l1"),
        F.round("top1.ratio", 6).alias("top1_ratio"), *r6("top3_ratio", "top5_ratio", "top10_ratio"), F.round("hhi_top10", 8).alias("hhi_top10"),
        said("l1"), "top_l1", *r6("top_l1_share"), "distinct_l1", said("theme"), "top_theme", *r6("top_theme_share"), "l1_mapped")


@query("fund_bundle_overlaps", "A45 A24", "fund_details fund_holdings stock_industry", f"""
with {PROFILE_SQL}, l as (select fund_code, quarter, codes, lead(quarter) over w nq, lead(codes) over w nc from prof window w as (partition by fund_code order by quarter))
select fund_code, quarter from_quarter, nq to_quarter, cast(len(list_intersect(codes,nc)) as integer) overlap, cast(least(len(codes),len(nc)) as integer) "of" from l
where nq is not null and fund_code in (select fund_code from fund_details)""")
def fund_bundle_overlaps(spark, d):
    return from_bundle(spark, d, "$.holdings.overlaps", "from_quarter:string,to_quarter:string,overlap:int,of:int")


@query("fund_bundle_latest", "A45", "fund_details fund_holdings stock_industry", f"""
with {PROFILE_SQL}, m as (select fund_code, max(quarter) as quarter from t group by 1)
select t.fund_code, rk as rank, asset_name as name, l1, theme, nullif(sw_l3,'') l3, round(hold_ratio,6) ratio
from t join m using (fund_code, quarter) left join stock_industry on stock_code=asset_code where t.fund_code in (select fund_code from fund_details)""")
def fund_bundle_latest(spark, d):
    rows = from_bundle(spark, d, "$.holdings.latest_top10", "rank:bigint,name:string,l1:string,theme:string,l3:string,ratio:double")
    return rows.select("fund_code", "rank", "name", "l1", "theme", "l3", *r6("ratio"))


@query("fund_bundle", "A45 X6", "fund_details fund_holdings stock_industry nav_daily fund_manager_tenure", f"""
with {SUMMARY_SQL}, {REGIME_SQL},
ch as (select fund_code, count(*) filter (managers<>older)+1 teams from (select fund_code, managers, lead(managers) over (partition by fund_code order by seq) older from fund_manager_tenure) group by 1)
select d.fund_code, fund_company, sector_focus, teams distinct_team_count, points, cast((coalesce(teams,0)>1)::int + (summ.fund_code is null)::int as integer) n_caveats,
 case when length(fund_company||' '||fund_name)>12 then substr(fund_company||' '||fund_name,1,12)||'…' else fund_company||' '||fund_name end clipped
from fund_details d left join summ using (fund_code) left join rg on rg.fund_code=d.fund_code and rg.points>=2 left join ch on ch.fund_code=d.fund_code""")
def fund_bundle(spark, d):
    return bundles(spark, d).select(
        "fund_code", "meta.fund_company", F.get_json_object("bundle", "$.holdings.sector_focus").alias("sector_focus"),
        "manager.distinct_team_count", "nav_regime.points", F.size("data_caveats").alias("n_caveats"),
        X.clip_text(F.concat_ws("  ", "meta.fund_company", "meta.fund_name"), 12).alias("clipped"))


@query("holdings_by_type_counts", "A47 A6", "funds fund_holdings", """
with h as (select distinct fund_code, quarter from fund_holdings), a as (select fund_code from h where quarter<'2000Q1' group by 1), b as (select fund_code from h group by 1)
select type, count(*) funds, count(a.fund_code) before_batch, count(b.fund_code) after_batch, (select count(*) from lineitem) lineitem_rows, (select count(*) from orders) orders_rows
from funds left join a on a.fund_code=code left join b on b.fund_code=code group by 1""")
def holdings_by_type_counts(spark, d):
    have = A.fund_holdings(spark, d).groupBy(F.col("fund_code").alias("code")).agg(
        F.bool_or(F.col("quarter") < "2000Q1").alias("before"), F.lit(True).alias("after"))
    rows = lambda t: A.table(spark, d, t).agg(F.count("*")).scalar()
    return A.funds(spark, d).join(have, "code", "left").groupBy("type").agg(
        F.count("*").alias("funds"), F.count_if("before").alias("before_batch"), F.count_if("after").alias("after_batch")
    ).select("*", rows("lineitem").alias("lineitem_rows"), rows("orders").alias("orders_rows"))
