"""Reconciliation of held portfolios with target themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.operators import reconcile as R
from navloom.plans.columns import r6
from navloom.plans.registry import query
from navloom.session import cut_lineage
from navloom.sources import adapters as A


def held_and_targets(spark, d):
    """25 portfolios on eight themes; every sixth supplier fund belongs to none."""
    k = F.col("s_suppkey")
    themes = A.table(spark, d, "supplier").select(
        A.code6("s_suppkey").alias("fund_code"), F.when(k % 12 == 0, "no_data").otherwise("outside").alias("match"),
        (F.pmod(k, F.lit(30)) / 100.0).alias("sim"), F.when(k % 6 != 0, (F.col("s_nationkey") % 8 + 1)).cast("int").alias("cluster_id"))
    funds = A.funds(spark, d).select(F.col("code").alias("fund_code"), "name")
    named = themes.join(funds, "fund_code")
    held = A.portfolio_positions(spark, d).join(named, "fund_code")
    reps = named.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.min_by(F.struct("fund_code", "name"), F.col("fund_code")).alias("r"))
    weights = reps.agg(F.sum("cluster_id")).scalar()
    reps = reps.select("cluster_id", F.col("cluster_id").alias("seq"), (F.col("cluster_id") / weights).alias("weight"), "r.fund_code", "r.name")
    ids = held.agg(F.array_sort(F.collect_set("portfolio_id"))).scalar()
    return held, reps.withColumn("portfolio_id", F.explode(ids))


SIZE_SQL = """
th as (select printf('%06d', s_suppkey) fund_code, case when s_suppkey%6<>0 then s_nationkey%8+1 end cluster_id, name from supplier join funds on code=printf('%06d', s_suppkey)),
held as (select p.*, cluster_id, name from portfolio_positions p join th using (fund_code)),
rep as (select cluster_id, cluster_id*1.0/sum(cluster_id) over () weight, fund_code, name from (select cluster_id, min(fund_code) fund_code, arg_min(name,fund_code) as name from th where cluster_id is not null group by 1)),
tt as (select portfolio_id, sum(market_value) held_total, coalesce(sum(case when cluster_id is not null then market_value end),0) matched, coalesce(sum(case when cluster_id is null then market_value end),0) outv from held group by 1),
ac as (select portfolio_id, cluster_id, sum(market_value) actual, sum(cost) c, bool_and(cost is not null) fu from held where cluster_id is not null group by 1,2),
s0 as (select tt.portfolio_id, r.cluster_id, weight, coalesce(actual,0) actual, c, fu, held_total, matched, outv, r.fund_code, r.name from tt cross join rep r left join ac on ac.portfolio_id=tt.portfolio_id and ac.cluster_id=r.cluster_id)"""


def sized_sql(base: str, trim: str) -> str:
    return f"""{SIZE_SQL}, s1 as (select *, {base} base_asset from s0), s2 as (select *, weight*base_asset target, weight*base_asset-actual diff from s1),
sized as (select *, case when diff>0 and not (abs(diff)<=0.03*base_asset or abs(diff)<100) then diff else 0 end need,
  case when {trim} and diff<0 and not (abs(diff)<=0.03*base_asset or abs(diff)<100) then -diff else 0 end surplus from s2)"""


SIZED_COLS = """portfolio_id, cluster_id, round(base_asset,4) base_asset, round(target,4) target, round(actual,4) actual, round(need,4) need, round(surplus,4) surplus,
 round(actual/held_total,6) actual_ratio, round(case when fu then actual-c end,4) pnl"""


def sized_out(df):
    return df.select("portfolio_id", "cluster_id", *r6("base_asset", "target", "actual", "need", "surplus", "pnl", digits=4), *r6("actual_ratio"))


@query("reconcile_sizing", "C21", "funds portfolio_positions", f"with {sized_sql('matched+outv', 'true')} select {SIZED_COLS} from sized")
def reconcile_sizing(spark, d):
    held, targets = held_and_targets(spark, d)
    return sized_out(R.size_clusters(held, targets, sell_outside=True))


@query("reconcile_sizing_no_trim", "C21", "funds portfolio_positions",
       f"with {sized_sql('greatest(matched, max(actual/weight) over (partition by portfolio_id))', 'false')} select {SIZED_COLS} from sized")
def reconcile_sizing_no_trim(spark, d):
    held, targets = held_and_targets(spark, d)
    return sized_out(R.size_clusters(held, targets, trim_overflow=False))


def reconciled(spark, d):
    held, targets = held_and_targets(spark, d)
    held = cut_lineage(held)
    sized = cut_lineage(R.size_clusters(held, targets, sell_outside=True))
    sources, others = R.funding_sources(held, sized, sell_outside=True)
    return held, sized, cut_lineage(sources), cut_lineage(others)


RANGE_SQL = f"""{sized_sql('matched+outv', 'true')},
ro as (select h.portfolio_id, h.cluster_id, h.fund_code, market_value, s.fund_code rep, surplus, h.fund_code=s.fund_code or trim(regexp_replace(h.name,'[A-Za-z]+$',''))=trim(regexp_replace(s.name,'[A-Za-z]+$','')) tgt
  from held h join sized s on s.portfolio_id=h.portfolio_id and s.cluster_id=h.cluster_id),
lt as (select s.portfolio_id, s.cluster_id, s.surplus, coalesce((select fund_code from ro where tgt and ro.portfolio_id=s.portfolio_id and ro.cluster_id=s.cluster_id order by fund_code<>rep, market_value desc, fund_code limit 1), s.fund_code) to_code from sized s),
ot as (select *, greatest(least(market_value, surplus-coalesce(sum(market_value) over (partition by portfolio_id, cluster_id order by market_value desc, fund_code rows between unbounded preceding and 1 preceding),0)),0) avail from ro where not tgt and market_value>0),
src as (select portfolio_id, cluster_id, 'trim' from_type, fund_code from_code, avail, 0 a, -surplus b, 0 c, -market_value e from ot where surplus>0 and avail>=100
 union all select portfolio_id, cluster_id, 'trim', to_code, surplus-coalesce((select sum(market_value) from ot where ot.portfolio_id=lt.portfolio_id and ot.cluster_id=lt.cluster_id),0) av, 0, -surplus, 1, 0 from lt where surplus>0 and surplus-coalesce((select sum(market_value) from ot where ot.portfolio_id=lt.portfolio_id and ot.cluster_id=lt.cluster_id),0)>=100
 union all select portfolio_id, null, 'outside', fund_code, market_value, 1, 0, 0, market_value from held where cluster_id is null and market_value>=100),
g as (select *, sum(avail) over (partition by portfolio_id order by a, b, cluster_id, c, e, from_code rows unbounded preceding) s_hi from src),
n as (select portfolio_id, cluster_id to_cluster, need, sum(need) over (partition by portfolio_id order by need desc, cluster_id rows unbounded preceding) n_hi from sized where need>0)"""


@query("funding_ranges", "C22", "funds portfolio_positions", f"""with {RANGE_SQL}
select n.portfolio_id, from_type, g.cluster_id from_cluster, from_code, to_cluster, round(least(n_hi,s_hi)-greatest(n_hi-need,s_hi-avail),6) amount
from n join g on g.portfolio_id=n.portfolio_id where least(n_hi,s_hi)-greatest(n_hi-need,s_hi-avail)>0""")
def funding_ranges(spark, d):
    _, sized, sources, _ = reconciled(spark, d)
    return R.funding_by_ranges(sources, sized).select(
        "portfolio_id", "from_type", "from_cluster", "from_code", "to_cluster", *r6("amount"))


FUNDING_SQL = f"""{RANGE_SQL},
nl as (select portfolio_id, list(need order by need desc, to_cluster) nv, list(to_cluster order by need desc, to_cluster) nc from n group by 1),
sl as (select portfolio_id, list(struct_pack(t := from_type, c := cluster_id, f := from_code, v := avail) order by a, b, cluster_id, c, e, from_code) sv from src group by 1),
-- one step: the next need, or what the current source gives, passing over residues under 100
st as (select nl.portfolio_id, 1 k, 1 i, nv[1] r, sv[1].v a, 0 ek, 0 ei, cast(0 as double) amount, nv, coalesce(sv, []) sv from nl left join sl using (portfolio_id)
 union all select portfolio_id, case when r<100 then k+1 else k end, case when r>=100 and a-t<100 then i+1 else i end, case when r<100 then nv[k+1] else r-t end,
  case when r<100 then a when a-t<100 then sv[i+1].v else a-t end, k, i, case when r>=100 then t else 0 end, nv, sv
 from (select *, case when least(r,a)>=100 then least(r,a) else 0 end t from st) where (r<100 and k<len(nv)) or (r>=100 and i<=len(sv))),
moved as (select st.portfolio_id, sv[ei].t from_type, sv[ei].c from_cluster, sv[ei].f from_code, nc[ek] to_cluster, amount from st join nl using (portfolio_id) where amount>0),
lent as (select portfolio_id, from_code, sum(amount) lent from moved where from_type='trim' group by 1,2),
swaps as (select o.portfolio_id, 'replace' from_type, o.cluster_id from_cluster, o.fund_code from_code, o.cluster_id to_cluster, o.market_value-coalesce(lent,0) amount
  from ot o left join lent on lent.portfolio_id=o.portfolio_id and lent.from_code=o.fund_code join lt on lt.portfolio_id=o.portfolio_id and lt.cluster_id=o.cluster_id
  where o.market_value-coalesce(lent,0)>=100 and o.fund_code<>lt.to_code),
goal as (select lt.*, not exists (select 1 from ro where tgt and ro.portfolio_id=lt.portfolio_id and ro.cluster_id=lt.cluster_id) is_open from lt),
goals as (select g.*, coalesce((select h.name from held h where not g.is_open and h.portfolio_id=g.portfolio_id and h.fund_code=g.to_code), s.name) to_name, s.need, s.target, s.actual, s.base_asset, s.held_total, s.matched, s.outv
  from goal g join sized s on s.portfolio_id=g.portfolio_id and s.cluster_id=g.cluster_id),
flow as (select g.*, coalesce((select sum(amount) from moved m where m.portfolio_id=g.portfolio_id and m.to_cluster=g.cluster_id),0) got,
  coalesce((select sum(amount) from moved m where m.from_type='trim' and m.portfolio_id=g.portfolio_id and m.from_cluster=g.cluster_id),0) gave,
  exists (select 1 from swaps w where w.portfolio_id=g.portfolio_id and w.from_cluster=g.cluster_id) swapped from goals g),
acts as (select *, case when need>0 and got>=100 then case when is_open then 'open' else 'add' end when surplus>0 and gave>=100 then 'trim' else 'hold' end as action from flow),
outs as (select h.portfolio_id, h.fund_code, h.market_value, coalesce(m.sold,0) sold, case when coalesce(m.sold,0)<100 then 'keep' when m.sold>=h.market_value-1 then 'exit' else 'trim' end as action, cast(h.fund_code as integer) k
  from held h left join (select portfolio_id, from_code, sum(amount) sold from moved where from_type='outside' group by 1,2) m on m.portfolio_id=h.portfolio_id and m.from_code=h.fund_code where h.cluster_id is null)"""


def planned(spark, d):
    held, sized, sources, others = reconciled(spark, d)
    moved = cut_lineage(R.funding(sources, sized, cash=False))
    where_to = cut_lineage(R.landing(sized, R.fund_roles(held, sized)))
    return held, sized, moved, where_to, cut_lineage(R.replacements(others, moved))


@query("reconcile_transfers", "C22", "funds portfolio_positions nav_daily", f"""with recursive {FUNDING_SQL},
px as (select fund_code, arg_max(nav, trade_date) nav from nav_daily where nav>0 group by 1)
select m.portfolio_id, from_type, from_cluster, from_code, to_cluster, to_code, case when is_open then 'open' else 'add' end to_action, round(amount,4) amount,
 round(nav,4) from_nav, round(round(amount,2)/nav,2) from_shares
from (select * from moved union all select * from swaps) m join goal g on g.portfolio_id=m.portfolio_id and g.cluster_id=m.to_cluster left join px on px.fund_code=from_code""")
def reconcile_transfers(spark, d):
    _, _, moved, where_to, swaps = planned(spark, d)
    every = moved.drop("step").unionByName(swaps, allowMissingColumns=True)
    return R.with_shares(every, where_to, A.nav_daily(spark, d)).select(
        F.col("portfolio_id").cast("int").alias("portfolio_id"), "from_type", "from_cluster", "from_code", "to_cluster", "to_code", "to_action", *r6("amount", digits=4),
        "from_nav", "from_shares")


@query("reconcile_rows", "C23", "funds portfolio_positions", f"""with recursive {FUNDING_SQL}
select portfolio_id, cluster_id, to_code, action, round(case when action in ('open','add') then got when action='trim' then -gave else 0 end,4) amount, round(target,4) target, round(actual,4) actual,
 need>0 and need-got>1 underfilled, case when swapped and action='hold' then '簇内非目标基金已换成目标基金「'||to_name||'」，总仓位不变' else
  case when action in ('open','add') then '低配，建议'||case when is_open then '建仓' else '加仓' end||'「'||to_name||'」'||
    case when need-got>1 then '（资金有限，距目标还差约 '||format('{{:,}}', cast(round_even(round(need-got,2),0) as bigint))||' 元，未完全到位）' else '' end
   when need>0 then '低配，但本轮可动用资金已用尽，暂缓补仓' when action='trim' then '超配，减仓（先卖非目标基金）用于补低配赛道'
   when surplus>0 then '超配，但低配已被其它资金补足，本轮暂不减' else '已在目标 ± 缓冲带内，保持不动（抗噪）' end
  ||case when swapped then '；并把簇内剩余非目标基金换成「'||to_name||'」' else '' end end note from acts
union all select portfolio_id, null, fund_code, action, round(case when sold>=100 then -sold else 0 end,4), 0, round(market_value,4), false,
 case when k%12=0 then '库中无该基金持仓数据，无法归类' else '不属于本组合任一赛道（最高相似度 '||cast(k%30/100.0 as double)||'）' end
 ||case action when 'keep' then '，本轮无需动用，保留不动' when 'exit' then '，清仓用于补低配赛道' else '，部分卖出用于补低配赛道' end from outs""")
def reconcile_rows(spark, d):
    """Themes, then the funds outside of them under their own code."""
    held, sized, moved, where_to, swaps = planned(spark, d)
    rows = R.cluster_rows(sized, where_to, moved, swaps).select(
        "portfolio_id", "cluster_id", "action", "amount", "target", "actual", "to_code", "note", "underfilled")
    outside = R.outside_rows(held, moved).select(
        "portfolio_id", F.lit(None).cast("int").alias("cluster_id"), "action", "amount", F.lit(0.0).alias("target"),
        F.col("market_value").alias("actual"), F.col("fund_code").alias("to_code"), "note", F.lit(False).alias("underfilled"))
    return rows.unionByName(outside).select(
        "portfolio_id", "cluster_id", "action", *r6("amount", "target", "actual", digits=4), "to_code", "note", "underfilled")


@query("reconcile_totals", "A41", "funds portfolio_positions", f"""with recursive {FUNDING_SQL},
mo as (select portfolio_id, sum(amount) buy_total, coalesce(sum(amount) filter (from_type='trim'),0) from_trim, coalesce(sum(amount) filter (from_type='outside'),0) from_outside from moved group by 1),
sw as (select portfolio_id, sum(amount) replace_total from swaps group by 1),
ac2 as (select portfolio_id, action from acts union all select portfolio_id, action from outs),
cn as (select portfolio_id, count(*) filter (action='open') as open, count(*) filter (action='add') as add, count(*) filter (action='trim') as trim, count(*) filter (action='hold') as hold,
  count(*) filter (action='exit') as exit, count(*) filter (action='keep') as keep from ac2 group by 1),
pl as (select portfolio_id, bool_or(cost is not null) has_cost, coalesce(sum(market_value) filter (cost is not null),0) mv, coalesce(sum(cost),0) c from held group by 1),
b as (select portfolio_id, max(base_asset) base_asset, max(held_total) held_total, max(matched) matched_total, max(outv) outside_value, bool_or(need>0 and need-got>1) scaled from acts group by 1)
select b.portfolio_id, round(base_asset,4) base_asset, round(held_total,4) held_total, round(matched_total,4) matched_total, round(outside_value,4) outside_value, scaled, has_cost,
 round(mv,4) cost_covered_mv, round(case when has_cost then mv-c end,4) pnl_total, round(case when c>0 then round(mv-c,2)/c*100 end,4) return_pct, open, add, trim, hold, exit, keep,
 round(coalesce(buy_total,0),4) buy_total, round(coalesce(from_trim,0),4) from_trim, round(coalesce(from_outside,0),4) from_outside, cast(0 as double) cash_needed,
 round(coalesce(replace_total,0),4) replace_total, round(coalesce(from_trim,0)+coalesce(from_outside,0),4) sell_total, round(held_total,4) total_asset
from b join pl using (portfolio_id) join cn using (portfolio_id) left join mo using (portfolio_id) left join sw using (portfolio_id)""")
def reconcile_totals(spark, d):
    held, sized, moved, where_to, swaps = planned(spark, d)
    rows = R.cluster_rows(sized, where_to, moved, swaps)
    out = R.totals(rows, R.outside_rows(held, moved), moved, swaps, held)
    return out.select(
        "portfolio_id", *r6("base_asset", "held_total", "matched_total", "outside_value", digits=4), "scaled", "has_cost",
        *r6("cost_covered_mv", "pnl_total", "return_pct", digits=4), "open", "add", "trim", "hold", "exit", "keep",
        *r6("buy_total", "from_trim", "from_outside", "cash_needed", "replace_total", "sell_total", "total_asset", digits=4))
