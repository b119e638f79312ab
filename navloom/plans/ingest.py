"""Landed payloads, merges, scalar functions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from navloom.functions import scalars as X
from navloom.functions.ai_fields import check_fields
from navloom.operators import workers
from navloom.plans.columns import f32, r6
from navloom.plans.registry import query
from navloom.plans.screen import presets
from navloom.plans.views import f32 as sql32
from navloom.session import cut_lineage, ensure_checkpoint_dir
from navloom.sources import adapters as A
from navloom.sources import landed as P
from navloom.sources import sinks as K
from navloom.streaming import jobs as J

TEXT = lambda c: F.col(c).cast("string")
FILE_ROWS = 2_000_000  # of an increment's file, so that no task writes or reads a whole year


def nav_scripts(spark, d):
    """Page scripts made from the values; every fifth fund has the money-fund layout, every seventh lists as trend items."""
    ms = F.unix_date("trade_date").cast("bigint") * 86_400_000 - 8 * 3_600_000
    k = F.col("fund_code").cast("int")
    layout = F.when(k % 5 == 0, "money").when(k % 7 == 0, "own").otherwise("normal")
    nav = A.nav_daily(spark, d).withColumn("ms", ms.cast("string")).withColumn("layout", layout)
    point = F.concat(F.lit('{"x":'), "ms", F.lit(',"y":'), TEXT("nav"), F.lit(',"equityReturn":"'), TEXT("nav"), F.lit('%"}'))
    pair = lambda v: F.concat(F.lit("["), "ms", F.lit(","), TEXT(v), F.lit("]"))
    item = F.concat(F.lit("["), "ms", F.lit(","), TEXT("nav"), F.lit(',"'), TEXT("nav"), F.lit('%",'), F.coalesce(TEXT("acc_nav"), F.lit('"x"')), F.lit("]"))
    # a fund's lists are those of its layout
    listed = lambda of, text: F.concat_ws(",", F.collect_list(F.when(F.col("layout") == of, text)))
    lists = nav.groupBy("fund_code", "layout").agg(
        listed("normal", point).alias("trend"), listed("normal", pair("acc_nav")).alias("acc"),
        listed("money", pair("nav")).alias("income"), listed("own", item).alias("listed"))
    normal = F.concat(F.lit("/*a*/var Data_netWorthTrend = ["), "trend", F.lit("];var x=1;var Data_ACWorthTrend = ["), "acc", F.lit("];"))
    money = F.concat(F.lit("var Data_millionCopiesIncome=["), "income", F.lit("];"))
    own = F.concat(F.lit("var Data_netWorthTrend=["), "listed", F.lit("];"))
    payload = F.when(F.col("layout") == "money", money).when(F.col("layout") == "own", own).otherwise(normal)
    return lists.select("fund_code", payload.alias("payload"))


@query("parse_nav_scripts", "S3 X13 X7", "nav_daily", f"""
select fund_code, trade_date, {sql32('nav')} nav, case when cast(fund_code as int)%5<>0 then {sql32('acc_nav')} end acc_nav,
 case when cast(fund_code as int)%5<>0 then {sql32('nav')} end daily_return from nav_daily""")
def parse_nav_scripts(spark, d):
    return P.nav_scripts(nav_scripts(spark, d)).select("fund_code", "trade_date", *f32("nav", "acc_nav", "daily_return"))


@query("landed_nav_files", "S3 X13", "nav_daily", f"""
select fund_code, trade_date, {sql32('nav')} nav, case when cast(fund_code as int)%5<>0 then {sql32('acc_nav')} end acc_nav from nav_daily""")
def landed_nav_files(spark, d):
    """The scripts landed as one file per fund, read back as a stream of files and parsed batch by batch."""
    folder = f"{ensure_checkpoint_dir(spark)}/landed/{uuid.uuid4().hex}"
    nav_scripts(spark, d).write.partitionBy("fund_code").text(f"{folder}/in")
    stream = P.payload_files(spark, f"{folder}/in", streaming=True)
    P.nav_scripts(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(
        availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("fund_code", "trade_date", *f32("nav", "acc_nav"))


def nav_pages(spark, d):
    """JSON pages per fund and year; every seventh fund answers with an error, every eleventh with no data."""
    row = F.struct(TEXT("trade_date").alias("FSRQ"), TEXT("nav").alias("DWJZ"), TEXT("acc_nav").alias("LJJZ"), F.lit("--").alias("JZZZL"),
                   F.when(F.dayofmonth("trade_date") % 2 == 0, TEXT("nav")).alias("ACTUALSYI"))
    lists = A.nav_daily(spark, d).withColumn("nav", F.when(F.dayofmonth("trade_date") % 3 != 0, F.col("nav"))).groupBy(
        "fund_code", F.year("trade_date").alias("y")).agg(F.to_json(F.struct(
            F.struct(F.collect_list(row).alias("LSJZList"), F.count("*").alias("TotalCount")).alias("Data"), F.lit(0).alias("ErrCode"))).alias("ok"))
    code = F.col("fund_code").cast("int")
    payload = F.when(code % 7 == 0, '{"Data":{"LSJZList":[]},"ErrCode":500}').when(code % 11 == 0, '{"Data":null,"TotalCount":0,"ErrCode":"0"}') \
        .when(code % 13 == 0, "<html>").otherwise(F.col("ok"))
    return lists.select("fund_code", "y", payload.alias("payload"))


@query("parse_nav_pages", "S4 S5", "nav_daily", f"""
with n as (select fund_code, trade_date, cast(fund_code as int) c, case when day(trade_date)%3<>0 then nav end nav, acc_nav from nav_daily),
 ok as (select * from n where c%7<>0 and c%11<>0 and c%13<>0), pg as (select distinct fund_code, c, year(trade_date) y from n)
select 'nav' kind, fund_code, trade_date, {sql32('nav')} v, {sql32('acc_nav')} acc_nav from ok where nav is not null
union all select 'cum', fund_code, trade_date, {sql32('nav')}, null from ok where nav is not null and day(trade_date)%2=0
union all select case when c%7=0 then 'error 500' else 'not a JSON object' end, fund_code, null, null, null from pg where c%7=0 or (c%11<>0 and c%13=0)""")
def parse_nav_pages(spark, d):
    rows, bad = P.nav_pages(nav_pages(spark, d))
    nav, cum = P.split_increment(rows)
    shape = lambda df, kind, day, v, acc: df.select(
        kind.alias("kind"), "fund_code", day.alias("trade_date"), v.alias("v"), acc.alias("acc_nav"))
    none = F.lit(None)
    out = shape(nav, F.lit("nav"), F.col("trade_date"), F.col("nav"), F.col("acc_nav")).unionByName(
        shape(cum, F.lit("cum"), F.col("trade_date"), F.col("cum_return"), none.cast("double"))).unionByName(
        shape(bad, F.col("reason"), none.cast("date"), none.cast("double"), none.cast("double")))
    return out.select("kind", "fund_code", "trade_date", *f32("v", "acc_nav"))


def manager_html(spark, d):
    days = F.datediff(F.coalesce("end_date", F.lit("2002-12-31").cast("date")), "start_date")
    text = F.concat(F.floor(days / 365).cast("string"), F.lit("年又"), (days % 365).cast("string"), F.lit("天"))
    cells = [TEXT("start_date"), F.coalesce(TEXT("end_date"), F.lit("至今")), F.concat(F.lit(' <a href="/m">'), "managers", F.lit("</a> ")), text,
             F.concat((days % 100).cast("string"), F.lit(".50%"))]
    row = F.concat(F.lit('<tr class="r">'), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    rows = A.fund_manager_tenure(spark, d).select("fund_code", F.col("seq").cast("int").alias("seq"), row.alias("row"))
    # a page lists at most 500 segments
    key = F.struct("fund_code", F.floor(F.col("seq") / 500).cast("int").alias("page"))
    body = rows.groupBy(key.alias("key")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda s: s["row"])).alias("rows"))
    return body.select("key", F.concat(
        F.lit("<html><table><tr><td>1</td></tr></table><table><tr><th>起始期</th><th>截止期</th><th>基金经理</th><th>任职期间</th><th>任职回报</th></tr>"),
        "rows", F.lit("</table><table><tr><td>2001-01-01</td></tr></table></html>")).alias("html"))


@query("parse_manager_pages", "S6 X4 X5", "fund_manager_tenure", """
select fund_code, seq, start_date, end_date, end_date is null is_current, managers, dd//365||'年又'||dd%365||'天' tenure_text, cast(dd as integer) tenure_days, cast(dd%100+0.5 as double) tenure_return
from (select *, date_diff('day', start_date, coalesce(end_date, date '2002-12-31')) dd from fund_manager_tenure)""")
def parse_manager_pages(spark, d):
    rows = P.manager_pages(manager_html(spark, d), code="key")
    rest = [c for c in rows.columns if c not in ("key", "seq")]
    return rows.select("key.fund_code", (F.col("key.page") * 500 + F.col("seq")).alias("seq"), *rest)


@query("page_text", "X5", "", r"""
select page_id, length(t) n_chars, md5(t) digest from (select page_id, trim(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),'\s+',' ','g')) t from pages)""")
def page_text(spark, d):
    text = X.strip_tags("html")
    return A.table(spark, d, "pages").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


@query("parse_detail_frames", "S7 X3", "fund_details", """
select fund_code, fund_name, fund_company, case when cast(fund_code as int)%2=0 then scale else round(scale,2)/10000 end scale, position_stock, sharpe_3y, max_drawdown_3y,
 case when cast(fund_code as int)%3=0 then null else 12.5::double end return_1y, fund_code||'/999' rank_1y, 7.0::double drawdown_1y from
 (select fund_code, fund_name, fund_company, scale, round(position_stock,4) position_stock, round(sharpe_3y,4) sharpe_3y, round(max_drawdown_3y,4) max_drawdown_3y from fund_details)""")
def parse_detail_frames(spark, d):
    f = A.fund_details(spark, d)
    code = F.col("fund_code").cast("int")
    cell = lambda frame, label, column, value, pos: F.struct(
        F.lit(frame).alias("frame"), F.lit(label).alias("label"), F.lit(column).alias("column"), value.alias("value"), F.lit(pos).alias("position"))
    num = lambda c: F.format_string("%.4f%%", c) if c == "position_stock" else F.format_string("%.4f", c)
    cells = F.array(
        cell("basic", "", "基金简称", F.col("fund_name"), 0), cell("basic", "", "基金公司", F.col("fund_company"), 1),
        cell("basic", "", "最新规模", F.concat(F.format_string("%.2f", "scale"), F.when(code % 2 == 0, "亿元").otherwise("万元")), 2),
        cell("hold", "", "股票占比", num("position_stock"), 0),
        cell("analysis", "近3年", "年化夏普比率", num("sharpe_3y"), 0), cell("analysis", "近三年", "最大回撤", num("max_drawdown_3y"), 1),
        cell("achievement", "近1年", "区间收益", F.when(code % 3 == 0, "--").otherwise("12.5%"), 0),
        cell("achievement", "近一年", "同类排名", F.concat("fund_code", F.lit("/999")), 1), cell("achievement", "近1年", "最大回撤", F.lit("7.00"), 2),
        cell("achievement", "任意", "最大回撤", F.lit("8.00"), 3))
    wide = P.detail_frames(f.select("fund_code", F.inline(cells)))
    return wide.select("fund_code", "fund_name", "fund_company", "scale", "position_stock", "sharpe_3y", "max_drawdown_3y", "return_1y", "rank_1y", "drawdown_1y")


@query("parse_holding_rows", "S8 U2 U5 X2 X7", "fund_holdings", """
select fund_code, quarter, holding_type, asset_code, round(hold_ratio,2) hold_ratio, case when holding_type='stock' then 100.0::double end hold_amount from fund_holdings""")
def parse_holding_rows(spark, d):
    h = A.fund_holdings(spark, d)
    raw = h.select("fund_code", F.concat(F.substring("quarter", 1, 4), F.lit("年"), F.substring("quarter", 6, 1), F.lit(" 季度投资明细")).alias("quarter_text"),
                   "holding_type", F.concat(F.lit(" "), "asset_code").alias("asset_code"), "asset_name",
                   F.round("hold_ratio", 2).alias("r"), F.lit("100").alias("hold_amount"), TEXT("hold_market_value").alias("hold_market_value"))
    first = raw.withColumn("hold_ratio", F.lit("1%")).withColumn("ord", F.lit(0))
    last = raw.withColumn("hold_ratio", F.concat(TEXT("r"), F.lit("%"))).withColumn("ord", F.lit(1))
    both = first.unionByName(last)
    rows = P.holding_rows(both.where(F.col("holding_type") == "stock"), both.where(F.col("holding_type") == "bond"))
    return P.last_row_wins(rows, ["fund_code", "quarter", "holding_type", "asset_code"]).select(
        "fund_code", "quarter", "holding_type", "asset_code", "hold_ratio", "hold_amount")


@query("parse_industry_records", "S9 S10", "", """
with r as (select printf('%06d', l_partkey) stock_code, l_shipdate dt, l_orderkey*10+l_linenumber o, case when l_linenumber%2=0 then 'M'||l_linenumber else '--' end m, 'B'||l_returnflag b from lineitem),
 x as (select stock_code, max(dt) d1, max(case when m<>'--' then dt end) d2 from r group by 1)
select p.stock_code, coalesce((select max(m) from r where r.stock_code=x.stock_code and dt=d2 and m<>'--'), (select max(b) from r where r.stock_code=x.stock_code and dt=d1)) em_industry,
 coalesce(case when p_brand<>'Brand#3' then p_type end,'') sw_l1, p_brand sw_l2 from (select printf('%06d', p_partkey) stock_code, p_brand, p_type from part) p join x using (stock_code)""")
def parse_industry_records(spark, d):
    l = A.table(spark, d, "lineitem")
    dated = l.groupBy(A.code6("l_partkey").alias("stock_code"), F.col("l_shipdate").alias("change_date")).agg(
        F.max(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("M"), TEXT("l_linenumber")))).alias("m"),
        F.max(F.concat(F.lit("B"), "l_returnflag")).alias("big_class"))
    records = dated.select("stock_code", "change_date", F.coalesce("m", F.lit("--")).alias("mid_class"), "big_class",
                           F.lit(None).cast("string").alias("sub_class"), F.lit("nan").alias("gate_class"))
    part = A.table(spark, d, "part")
    rows = part.select(F.concat(A.code6("p_partkey"), F.lit(".SZ")).alias("raw_code"), F.col("p_name").alias("raw_name"),
                       F.concat_ws("|", "p_brand", "p_type").alias("sw_l2"), F.col("p_type").alias("sw_l3"))
    chain = part.where(F.col("p_brand") != "Brand#3").select(F.concat_ws("|", "p_brand", "p_type").alias("sw_l2"), F.col("p_type").alias("sw_l1")).distinct()
    return P.constituent_rows(rows, chain).join(P.industry_label_rows(records), "stock_code").select(
        "stock_code", "em_industry", "sw_l1", F.split("sw_l2", r"\|")[0].alias("sw_l2"))


# ---- merges -------------------------------------------------------------------------------------

@query("upsert_nav", "K2 K7 K8", "nav_daily", f"""
with o as (select fund_code, trade_date, nav from nav_daily where trade_date<date '2000-01-01'), n as (select fund_code, trade_date, nav*2 nav from nav_daily where trade_date>=date '1999-06-01'),
 hw as (select fund_code, max(trade_date) m from o group by 1)
select 'upsert' kind, fund_code, trade_date, {sql32('coalesce(n.nav,o.nav)')} nav from o full join n using (fund_code, trade_date)
union all select 'above', fund_code, trade_date, {sql32('n.nav')} from n left join hw using (fund_code) where m is null or trade_date>m
union all select 'backfill', fund_code, trade_date, {sql32('coalesce(acc_nav, nav)')} from nav_daily""")
def upsert_nav(spark, d):
    nav = A.nav_daily(spark, d)
    old = nav.where(F.col("trade_date") < "2000-01-01").select("fund_code", "trade_date", "nav")
    new = nav.where(F.col("trade_date") >= "1999-06-01").select("fund_code", "trade_date", (F.col("nav") * 2).alias("nav"))
    fill = K.backfill(nav.select("fund_code", "trade_date", "acc_nav"), nav.select("fund_code", "trade_date", F.col("nav").alias("acc_nav")),
                      ["fund_code", "trade_date"], "acc_nav")
    out = K.upsert(old, new, ["fund_code", "trade_date"]).withColumn("kind", F.lit("upsert")).unionByName(
        K.above_high_water(old, new).withColumn("kind", F.lit("above"))).unionByName(
        fill.select("fund_code", "trade_date", F.col("acc_nav").alias("nav"), F.lit("backfill").alias("kind")))
    return out.select("kind", "fund_code", "trade_date", *f32("nav"))


@query("replace_holding_groups", "K3", "holdings_overlap", """
with n as (select fund_code, quarter, holding_type, asset_code, -hold_ratio hold_ratio from holdings_overlap where quarter>='1999Q4' and cast(fund_code as int)%2=0 and hold_ratio>1)
select fund_code, quarter, asset_code, round(hold_ratio,6) hold_ratio from n union all
select fund_code, quarter, asset_code, round(hold_ratio,6) from holdings_overlap o where not exists (select 1 from n where n.fund_code=o.fund_code and n.quarter=o.quarter and n.holding_type=o.holding_type)""")
def replace_holding_groups(spark, d):
    cols = ["fund_code", "quarter", "holding_type", "asset_code", "hold_ratio"]
    old = A.holdings_overlap(spark, d).select(*cols)
    new = old.where((F.col("quarter") >= "1999Q4") & (F.col("fund_code").cast("int") % 2 == 0) & (F.col("hold_ratio") > 1)).withColumn("hold_ratio", -F.col("hold_ratio"))
    return K.replace_groups(old, new, ["fund_code", "quarter", "holding_type"]).select("fund_code", "quarter", "asset_code", *r6("hold_ratio"))


@query("merge_industry_fields", "K4 K5 K11", "stock_industry", """
with o as (select * from stock_industry where cast(stock_code as int)%4<>0), n as (select stock_code, 'new-'||sw_l3 sw_l3 from stock_industry where cast(stock_code as int)%3=0),
 m as (select stock_code, o.sw_l1, case when manual=1 then o.sw_l3 else coalesce(n.sw_l3,o.sw_l3) end sw_l3, manual from o full join n using (stock_code)),
 x as (select stock_code, 'fixed' sw_l1 from stock_industry where cast(stock_code as int)%50=0)
select stock_code, coalesce(x.sw_l1,m.sw_l1) sw_l1, m.sw_l3, case when x.stock_code is not null then 1 else m.manual end manual, case when x.stock_code is not null then 'manual' end source from m full join x using (stock_code)""")
def merge_industry_fields(spark, d):
    code = F.col("stock_code").cast("int")
    all_rows = A.stock_industry(spark, d).select("stock_code", "sw_l1", "sw_l3", "manual", F.lit(None).cast("string").alias("source"))
    new = all_rows.where(code % 3 == 0).select("stock_code", F.concat(F.lit("new-"), "sw_l3").alias("sw_l3"))
    merged = K.merge_fields(all_rows.where(code % 4 != 0), new, ["stock_code"], protect="manual")
    return K.manual_corrections(merged, all_rows.where(code % 50 == 0).select("stock_code", F.lit("fixed").alias("sw_l1")), ["stock_code"])


# ---- scalars -------------------------------------------------------------------------------------

@query("date_functions", "X14 X15 X16 X17 X18 X19", "", """
with d as (select distinct cast(o_orderdate as date) d from orders)
select d, year(d - interval 3 month)||'Q'||quarter(d - interval 3 month) prev_quarter,
 case when month(d)>=11 then year(d)||'Q3' when month(d)>=9 then year(d)||'Q2' when month(d)>=5 then year(d)||'Q1' when month(d)>=4 then (year(d)-1)||'Q4' else (year(d)-1)||'Q3' end by_month,
 (select max(x) from (select year(e)||'Q'||quarter(e) x from (select cast(range as date)-1 e from range(date '1993-01-01', date '2003-01-01', interval 3 month)) where e+45<=d)) by_lag,
 cast(d - interval 7 month as date) minus7, d-1095 three_years_ago, round(date_diff('day',d,date '2002-12-31')/365.25,8) age, round(date_diff('day',d,date '2002-12-31')/365.0,8) in_post,
 (year(d)-3)||strftime(d,'-%m-%d') same_day, cast((select count(*) from (select d x union all select cast(date_trunc('month',d) + to_months(cast(5*k as integer)) as date) + cast(least(day(d),28)-1 as integer) from range(1,40) t(k)) where x<=date '2002-12-31') as integer) anchors
from d""")
def date_functions(spark, d):
    end = F.lit("2002-12-31").cast("date")
    days = A.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select(
        "d", X.previous_quarter("d").alias("prev_quarter"), X.disclosed_quarter_month("d").alias("by_month"), X.disclosed_quarter_lag45("d").alias("by_lag"),
        X.minus_months("d", 7).alias("minus7"), X.years_ago("d", 3).alias("three_years_ago"), F.round(X.age_years("d", end), 8).alias("age"),
        F.round(X.years_in_post("d", end), 8).alias("in_post"), X.same_day_years_back("d", 3).alias("same_day"), F.size(X.anchor_dates("d", end, 5)).alias("anchors"))


@query("text_functions", "X1 X7 X8 X12 X25 F22", "", """
select doc_id, upper(lang) w1, trim(regexp_replace('基金'||source||'(后端)','\\(后端\\)$','')) plain, regexp_matches(printf('%06d', doc_id),'^\\d{6}$') is_code,
 case when doc_id%3=0 then null else cast(n_chars as double) end num, len(list_filter(list_transform(string_split(replace(text,chr(10),' '),','), lambda x: trim(x)), lambda x: x<>'')) n_items, '{"k": '||n_chars||'}' js from documents""")
def text_functions(spark, d):
    n = TEXT("n_chars")
    reply = F.concat(F.lit("Sure:\n```json\n{\"k\": "), n, F.lit("}\n```\nbye"))
    items = F.regexp_replace("text", "\n", " ")
    return A.table(spark, d, "documents").select(
        "doc_id", F.upper(X.clean_text("lang")).alias("w1"), F.trim(F.regexp_replace(F.concat(F.lit("基金"), "source", F.lit("(后端)")), r"\(后端\)$", "")).alias("plain"),
        X.is_fund_code(A.code6("doc_id")).alias("is_code"), X.safe_number(F.when(F.col("doc_id") % 3 == 0, "--").otherwise(F.concat(n, F.lit("%")))).alias("num"),
        F.size(X.csv_items(items)).cast("bigint").alias("n_items"), X.json_object_text(reply).alias("js"))


@query("ai_field_checks", "X24", "", """
with r as (select event_id, case event_id%5 when 0 then 'rating' when 1 then 'luck_verdict' when 2 then 'tenure_years' when 3 then 'verdict' else 'whatever' end field,
 case event_id%5 when 0 then cast(event_id%6 as varchar) when 1 then case when event_id%2=0 then 'solid' else event_type end when 2 then case when event_id%3=0 then 'x' else '1.5' end else event_type end v from events)
select event_id, field, case when field='rating' and try_cast(v as int)>3 then 'out of range' when field='luck_verdict' and v not in ('solid','mixed','luck') then 'value not allowed'
 when field='tenure_years' and v='x' then 'not a number' when field='whatever' then 'unknown field' end reason, case when field='rating' and try_cast(v as int)>3 or field='luck_verdict' and v not in ('solid','mixed','luck') or field='tenure_years' and v='x' or field='whatever' then null else v end clean from r""")
def ai_field_checks(spark, d):
    k = F.col("event_id")
    field = F.when(k % 5 == 0, "rating").when(k % 5 == 1, "luck_verdict").when(k % 5 == 2, "tenure_years").when(k % 5 == 3, "verdict").otherwise("whatever")
    value = F.when(k % 5 == 0, (k % 6).cast("string")).when(k % 5 == 1, F.when(k % 2 == 0, "solid").otherwise(F.col("event_type"))) \
        .when(k % 5 == 2, F.when(k % 3 == 0, "x").otherwise("1.5")).otherwise(F.col("event_type"))
    return check_fields(A.table(spark, d, "events").select("event_id", field.alias("field"), value.alias("value"))).select("event_id", "field", "reason", "clean")


@query("preset_texts", "X26 X27 U8", "", """
select n_nationkey preset_id, case when n_nationkey%7=1 then 'keyword=FUND&' else '' end || case when n_nationkey%4=0 then 'name_contains=a&' else '' end ||
 case n_nationkey%3 when 0 then 'fund_types=股票型,混合型-偏股&' when 2 then 'fund_types=债券型-长债&' else '' end || 'exclude_codes='||printf('%06d', n_nationkey) ||
 case when n_nationkey%5=0 then '&name_excludes=fund 1' else '' end || '&conds=' || case when n_nationkey%2=0 then 'scale:gte:'||n_nationkey*5||'.0,sharpe_3y:gt:1.0' else 'scale:lt:'||n_nationkey*20||'.0' end params,
 case when n_nationkey%2=0 then 3 else 1 end excluded_after, true canonical_equal from nation""")
def preset_texts(spark, d):
    p = presets(spark, d)
    flipped = F.col("filters").withField("fund_types", F.reverse("filters.fund_types")).withField("conditions", F.reverse("filters.conditions"))
    even = F.col("preset_id") % 2 == 0
    codes = F.when(even, F.array_union("filters.exclude_codes", F.array(F.lit("x"), F.lit("y")))).otherwise(
        F.array_except(F.array_union("filters.exclude_codes", F.array(F.lit("x"))), F.array(F.lit("x"))))
    return p.select("preset_id", X.filter_params("filters").alias("params"), F.size(codes).alias("excluded_after"),
                    (X.canonical_filters("filters") == X.canonical_filters(flipped)).alias("canonical_equal"))


@query("run_per_key", "G1", "fund_details", """
select case when cast(fund_code as int)%7=0 then 'fail' when scale<50 then 'skip' else 'success' end status, count(*) n from fund_details group by 1""")
def run_per_key(spark, d):
    def process(row):
        if int(row["fund_code"]) % 7 == 0:
            raise ValueError("no answer")
        return "skip" if row["scale"] < 50 else "success"

    return workers.status_counts(workers.run_per_key(A.fund_details(spark, d).select("fund_code", "scale"), "fund_code", process))


# ---- streams -----------------------------------------------------------------------------------------

def stream_paths(spark):
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/state"


def event_stream(spark, d):
    return J.read_files(spark, d, "events.parquet", A.table(spark, d, "events").schema)


@query("stream_sync_health", "T4", "sync_status", """
select time_bucket(interval 5 minutes, ts) window_start, count(*) filter (status='success') success, count(*) filter (status='skip') skip, count(*) filter (status='fail') fail,
 count(*) filter (status='fail')>=2 unhealthy from sync_status group by 1""")
def stream_sync_health(spark, d):
    rows, state = stream_paths(spark)
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click", "purchase"), "success").when(kind == "signup", "skip").otherwise("fail")
    health = J.sync_health(event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), status.alias("status")), fail_limit=2)
    drain_update(health, rows, state)
    return J.current_rows(spark, rows, ["window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def drain_update(stream, rows, state):
    """Update-mode aggregates into the version log."""
    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rows)

    J.drain(stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start())


@query("stream_nav_upsert", "T1 T2", "", f"""
select {"printf('%06d', l_suppkey)"} fund_code, cast(l_shipdate as date) trade_date, {sql32('arg_max(l_extendedprice/l_quantity, l_orderkey*10+l_linenumber)')} nav, count(*) over () keys
from lineitem group by 1,2""")
def stream_nav_upsert(spark, d):
    rows, state = stream_paths(spark)
    lines = J.read_files(spark, d, "lineitem.parquet", A.table(spark, d, "lineitem").schema)
    increments = lines.select(
        A.code6("l_suppkey").alias("fund_code"), F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("nav"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))
    J.append_versions(increments, rows, state)
    merged = cut_lineage(J.current_rows(spark, rows, ["fund_code", "trade_date"], ["version"]))
    return merged.select("fund_code", "trade_date", *f32("nav"), F.lit(merged.count()).cast("bigint").alias("keys"))


@query("stream_first_values", "T2", "", """
select printf('%06d', l_suppkey) fund_code, cast(l_shipdate as date) trade_date, count(*) n from lineitem group by 1,2""")
def stream_first_values(spark, d):
    """Increments that arrive in the order of their days, two years a batch: repeats are dropped, none is late."""
    rows, state = stream_paths(spark)
    lines = A.table(spark, d, "lineitem").select(
        A.code6("l_suppkey").alias("fund_code"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.year("l_shipdate").alias("y"))
    counted = cut_lineage(lines.groupBy("fund_code", "ts", "y").agg(F.count("*").alias("n")))
    years = {r["y"]: r["count"] // FILE_ROWS + 1 for r in counted.groupBy("y").count().orderBy("y").collect()}
    for y, files in years.items():
        part = counted.where(F.col("y") == y).drop("y")
        part.unionByName(part.where(F.dayofmonth("ts") == 1)).repartition(files).write.parquet(f"{rows}/in/{y}")
    stream = J.read_files(spark, f"{rows}/in/*", "*.parquet", counted.drop("y").schema,
                          files_per_batch=2 * max(years.values(), default=1))
    J.first_or_late(stream, ["fund_code", "ts"], "ts", f"{rows}/out", state, late_days=400)
    return spark.read.parquet(f"{rows}/out/first").select("fund_code", F.col("ts").cast("date").alias("trade_date"), "n")


@query("stream_positions", "T3", "", """
with recursive o as (select o_custkey portfolio_id, printf('%06d', o_custkey%100) fund_code, case when o_orderstatus='F' then 'sell' else 'buy' end txn_type, o_totalprice amount, o_totalprice/1.25 shares,
 row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) n from orders),
fold as (select distinct portfolio_id, fund_code, 0::bigint n, 0.0::double shares, 0.0::double as cost, 0.0::double realised, 0.0::double invested from o
 union all select f.portfolio_id, f.fund_code, o.n, case when txn_type='buy' then f.shares+o.shares when f.shares>0 then f.shares-least(o.shares,f.shares) else f.shares end,
  case when txn_type='buy' then cost+amount when f.shares>0 then cost-cost*least(o.shares,f.shares)/f.shares else cost end,
  case when txn_type='sell' and f.shares>0 then realised+amount-cost*least(o.shares,f.shares)/f.shares else realised end, case when txn_type='buy' then invested+amount else invested end
 from fold f join o on o.portfolio_id=f.portfolio_id and o.n=f.n+1)
select portfolio_id, fund_code, round(arg_max(shares,n),3) shares, round(arg_max(cost,n),3) as cost, round(arg_max(realised,n),3) realised, round(arg_max(invested,n),3) invested from fold group by 1,2""")
def stream_positions(spark, d):
    rows, state = stream_paths(spark)
    orders = J.read_files(spark, d, "orders.parquet", A.table(spark, d, "orders").schema)
    trades = orders.select(
        F.col("o_custkey").alias("portfolio_id"), A.code6(F.col("o_custkey") % 100).alias("fund_code"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("txn_type"), F.col("o_orderdate").cast("date").cast("string").alias("trade_date"),
        F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") / 1.25).alias("shares"))
    J.live_positions(trades, f"{rows}-log", rows, state)
    return J.current_rows(spark, rows, ["portfolio_id", "fund_code"]).select(
        "portfolio_id", "fund_code", *r6("shares", "cost", "realised", "invested", digits=3))
