"""The adapters once more, as DuckDB SQL for the twins."""

from __future__ import annotations

CODE6 = "printf('%06d', {})"


def c6(x: str) -> str:
    return CODE6.format(x)


FUND_NAME = "'Fund '||(s_suppkey//2)||case when s_suppkey%2=0 then 'A' else 'C' end"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "funds": ((), f"""
        select code, name, type,
          case when type in ('股票型','混合型-偏股','混合型-灵活') and name not like '%指数%' and name not like '%ETF%'
               and name like '%C%' and name not like '%A%' then 'stock' else 'non_stock' end fund_type
        from (select {c6('s_suppkey')} code, {FUND_NAME} as name,
          case s_nationkey%4 when 0 then '股票型' when 1 then '混合型-偏股' when 2 then '混合型-灵活' else '债券型-长债' end as type
          from supplier)"""),
    "fund_details": ((), f"""
        select {c6('s_suppkey')} fund_code, {FUND_NAME} fund_name, n_name fund_company, round(abs(s_acctbal)/20,2) scale,
          cast(min(l_shipdate) as date) establish_date,
          cast(100*avg(case when l_suppkey is null then null when p_type<>'PROMO' then 1 else 0 end) as double) position_stock,
          avg(l_extendedprice/l_quantity)/nullif(stddev_samp(l_extendedprice/l_quantity),0) sharpe_3y,
          avg(l_tax)/nullif(stddev_samp(l_tax),0) risk_return_ratio_3y, 100*max(l_discount) max_drawdown_3y
        from supplier join nation on s_nationkey=n_nationkey left join lineitem on l_suppkey=s_suppkey
          left join part on p_partkey=l_partkey group by s_suppkey, n_name, s_acctbal"""),
    "fund_ai": ((), f"""
        select {c6('s_suppkey')} fund_code,
          case s_suppkey%3 when 0 then 'solid' when 1 then 'mixed' else 'luck' end luck_verdict,
          case when s_suppkey%2=0 then 'focused' else 'diversified' end concentration,
          cast(s_suppkey%2 as integer) recommend, s_nationkey*4 skill_score, cast(s_suppkey%4 as integer) rating
        from supplier where s_nationkey%3<>0"""),
    "nav_daily": ((), f"""
        select {c6('l_suppkey')} fund_code, cast(l_shipdate as date) trade_date,
          avg(l_extendedprice/l_quantity)/1000 nav,
          case when day(l_shipdate)%5=0 then null else avg(l_extendedprice*(1-l_discount)/l_quantity)/1000 end acc_nav
        from lineitem group by l_suppkey,l_shipdate"""),
    "nav_weekly": ((), """
        select p_brand fund_code, cast(date_trunc('week',l_shipdate) as date) trade_date,
          avg(l_extendedprice/l_quantity)/1000 nav
        from lineitem join part on l_partkey=p_partkey group by 1,2"""),
    "fund_holdings": ((), f"""
        select *, 100*hold_market_value/sum(hold_market_value) over (partition by fund_code,quarter) hold_ratio from (
          select {c6('l_suppkey')} fund_code, year(l_shipdate)||'Q'||quarter(l_shipdate) as quarter,
            case when p_type='PROMO' then 'bond' else 'stock' end holding_type, {c6('l_partkey')} asset_code,
            p_name asset_name, sum(l_extendedprice) hold_market_value
          from lineitem join part on l_partkey=p_partkey group by 1,2,3,4,5)"""),
    "holdings_overlap": ((), f"""
        select *, 'stock' holding_type, 'stock '||asset_code asset_name,
          100*hold_market_value/sum(hold_market_value) over (partition by fund_code,quarter) hold_ratio from (
          select {c6('l_suppkey')} fund_code, year(l_shipdate)||'Q4' as quarter,
            {c6('l_partkey%97')} asset_code, sum(l_extendedprice) hold_market_value
          from lineitem group by 1,2,3)"""),
    "brand_holdings": ((), f"""
        select *, 'stock' holding_type, 'stock '||asset_code asset_name,
          100*hold_market_value/sum(hold_market_value) over (partition by fund_code,quarter) hold_ratio from (
          select p_brand fund_code, year(l_shipdate)||'Q'||quarter(l_shipdate) as quarter,
            {c6('l_suppkey%50')} asset_code, sum(l_extendedprice) hold_market_value
          from lineitem join part on l_partkey=p_partkey group by 1,2,3)"""),
    "brand_funds": (("nav_weekly",), """
        select p_brand code, p_brand as name, '股票型' as type,
          'Company '||(cast(regexp_extract(p_brand,'(\\d+)',1) as integer)%8) company, price/20 scale,
          establish_date, last_date
        from (select p_brand, avg(p_retailprice) price from part group by 1)
        join (select fund_code, min(trade_date) establish_date, max(trade_date) last_date from nav_weekly group by 1)
          on p_brand=fund_code"""),
    "stock_industry": ((), f"""
        select stock_code, l1 sw_l1, sw_l2, sw_l3, case when z%5=0 then '' when l1='' then '软件服务' else l1 end em_industry, manual from (
          select {c6('p_partkey')} stock_code, p_brand sw_l2, p_size z,
            case p_type when 'MEDIUM' then '电子' when 'STANDARD' then '通信' when 'SMALL' then '医药生物' when 'LARGE' then '银行'
              when 'ECONOMY' then '新行业' else '' end l1,
            case when p_size%3=0 then '' else p_brand||'-'||(p_size%7) end sw_l3, case when p_size=50 then 1 else 0 end manual
          from part)"""),
    "trade_dates": ((), """
        select distinct cast(o_orderdate as date) trade_date from orders where dayofweek(o_orderdate) between 1 and 5"""),
    "holding_txns": ((), f"""
        select o_orderkey id, o_custkey portfolio_id, {c6('o_custkey%100')} fund_code,
          case when o_orderstatus='F' then 'sell' else 'buy' end txn_type, cast(o_orderdate as date) trade_date,
          o_totalprice amount from orders"""),
    "user_holdings": ((), f"""
        select c_custkey portfolio_id, {c6('c_custkey%100')} fund_code, abs(c_acctbal) market_value,
          case when c_custkey%4<>0 then abs(c_acctbal)*0.8734567 end as cost, cast(null as double) base_shares
        from customer where c_custkey%3<>0"""),
    "portfolio_positions": ((), f"""
        select portfolio_id, fund_code, market_value, case when portfolio_id%5<>0 then c end as cost from (
          select c_nationkey portfolio_id, {c6('c_custkey%100')} fund_code, sum(abs(c_acctbal)) market_value,
            sum(abs(c_acctbal)*0.8734567) c from customer group by 1,2)"""),
    "fund_manager_tenure": ((), f"""
        select {c6('o_custkey')} fund_code,
          cast(row_number() over (partition by o_custkey order by o_orderdate desc,o_orderkey desc)-1 as integer) seq,
          o_orderpriority managers, cast(o_orderdate as date) start_date,
          cast(lead(o_orderdate) over (partition by o_custkey order by o_orderdate,o_orderkey) as date) end_date
        from orders"""),
    "signals": ((), """
        select event_id, ts, user_id, case when event_type='error' then 'SELL' else 'BUY' end as action, value
        from events where event_type in ('purchase','signup','error')"""),
    "timing_signals": ((), """
        select cast(date '1998-01-05' + to_months(cast(n as integer)) as date) trade_date,
          case when worth>0 then 'BUY' else 'SELL' end as action
        from (select date_diff('day', timestamp '2024-01-01', date_trunc('day',ts)) n,
          sum(case when event_type in ('purchase','signup') then value when event_type='error' then -2*value else 0.0 end) worth
          from events group by 1)"""),
    "sync_status": ((), """
        select event_id, ts, case when event_type in ('view','click','purchase') then 'success'
          when event_type='signup' then 'skip' else 'fail' end as status from events"""),
    "snapshot_items": ((), f"""
        select s_nationkey preset_id, {c6('s_suppkey')} code, {FUND_NAME} as name, s_acctbal/20 scale from supplier"""),
}


def with_views(names: list[str], body: str) -> str:
    """Body preceded by the views it needs, in order."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        needs, text = VIEWS[name]
        for need in needs:
            add(need)
        seen[name] = text

    for name in names:
        add(name)
    body = body.strip()
    if not seen:
        return body
    ctes = ",\n".join(f"{n} as ({t.strip()})" for n, t in seen.items())
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def f32(x: str) -> str:
    """Value at single precision: prices are decimals, and decimal rounding would hit ties."""
    return f"cast(cast({x} as float) as double)"
