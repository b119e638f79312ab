"""Parsers and loaders on worked examples."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from navloom.functions import scalars as X
from navloom.operators import joins as J
from navloom.operators import windows as W
from navloom.sources import landed as P

D = dt.date


def test_missing_values_are_dropped_after_the_row_limit(spark):
    nav = spark.createDataFrame(
        [("000001", D(2024, 1, 2), 1.02), ("000001", D(2024, 1, 3), None), ("000002", D(2024, 1, 2), 0.98)],
        "fund_code string, trade_date date, nav double")
    assert sorted(map(tuple, W.first_rows(nav).collect())) == [("000001", D(2024, 1, 2), 1.02), ("000002", D(2024, 1, 2), 0.98)]
    assert W.first_rows(nav.where("fund_code = '000001'"), 1).count() == 1


def test_tenure_goes_back_with_the_date_and_never_below_zero(spark):
    rows = spark.createDataFrame([("000001", 1000), ("000002", None)], "fund_code string, days int")
    run, as_of = F.lit("2026-08-11").cast("date"), F.lit("2026-08-01").cast("date")
    got = {r.fund_code: r.t for r in rows.select("fund_code", W.tenure_at(F.col("days"), run, as_of).alias("t")).collect()}
    assert got == {"000001": 990, "000002": 0}


def test_only_disclosed_quarters_are_visible(spark):
    held = spark.createDataFrame([("000001", "2025Q1", "A", 0.2), ("000001", "2025Q3", "B", 0.3)],
                                 "fund_code string, quarter string, asset_code string, hold_ratio double")
    dates = spark.createDataFrame([(D(2025, 8, 20),)], "as_of date")
    assert [(r.quarter, r.asset_code) for r in J.disclosed_cut(held, dates).collect()] == [("2025Q1", "A")]


def test_increment_is_split_by_what_is_present(spark):
    rows = spark.createDataFrame(
        [("1", D(2026, 7, 30), 1.01, 1.21, 0.1, None), ("1", D(2026, 7, 31), None, 1.22, None, 2.3)],
        "fund_code string, trade_date date, nav double, acc_nav double, daily_return double, cum_return double")
    nav, cum = P.split_increment(rows)
    assert [r.trade_date for r in nav.collect()] == [D(2026, 7, 30)]
    assert [(r.trade_date, r.cum_return) for r in cum.collect()] == [(D(2026, 7, 31), 2.3)]


def ms(day):
    return int((dt.datetime(*day) - dt.datetime(1970, 1, 1)).total_seconds() * 1000) - 8 * 3600 * 1000


def test_value_scripts_in_all_three_layouts(spark):
    a, b = ms((2024, 1, 1)), ms((2024, 1, 2))
    normal = (f'var Data_netWorthTrend = [{{"x":{a},"y":1.2,"equityReturn":null}},{{"x":{b},"y":"1.3","equityReturn":"0.5"}}];'
              f'var Data_ACWorthTrend = [[{a},1.4],[{b},"1.5"]];')
    money = f"var Data_millionCopiesIncome = [[{a},1.2],[{b},1.3]];"
    listed = (f'var Data_netWorthTrend = [[{a},"1.2",null,"1.7"],[{b},1.3,0.5,"none"],[{b}],7];'
              f'var Data_ACWorthTrend = [[{b},1.6],[{a}]];')
    scripts = spark.createDataFrame([("n", normal), ("m", money), ("e", "var x = 1;"), ("z", listed)], "fund_code string, payload string")
    got = sorted((r.fund_code, str(r.trade_date), r.nav, r.acc_nav, r.daily_return) for r in P.nav_scripts(scripts).collect())
    assert got == [("m", "2024-01-01", 1.2, None, None), ("m", "2024-01-02", 1.3, None, None),
                   ("n", "2024-01-01", 1.2, 1.4, None), ("n", "2024-01-02", 1.3, 1.5, 0.5),
                   ("z", "2024-01-01", 1.2, 1.7, None), ("z", "2024-01-02", 1.3, 1.6, 0.5)]


def test_a_trend_list_is_read_at_once_as_item_by_item(spark):
    """Odd items of a list give the same rows whether or not another item sends the list through item by item."""
    a, b, c = (ms((2024, 1, d)) for d in (1, 2, 3))
    odd = [f'{{"x":"{a}","y":1}}', f'{{"x":{a},"y":"1.2","equityReturn":"0.5%"}}', f'{{"x":{b},"y":1.30,"z":{{"x":1}}}}', f'{{"y":2}}',
           f'{{"x":{c},"y":"--","equityReturn":"5%%"}}', f'{{"x":{c},"y":"2.5%","equityReturn":null}}']
    rest = {"objects": "", "number": ",7", "null": ",null", "text": ',"t"', "list": f',[{c},3,"--"]', "broken": ',{"x":'}
    scripts = spark.createDataFrame([(k, f"var Data_netWorthTrend = [{','.join(odd)}{x}];") for k, x in rest.items()], "fund_code string, payload string")
    got = {k: sorted((str(r.trade_date), r.nav, r.daily_return) for r in P.nav_scripts(scripts.where(F.col("fund_code") == k)).collect()) for k in rest}
    assert got["objects"] == [("2024-01-01", 1.2, 0.5), ("2024-01-02", 1.3, None), ("2024-01-03", 2.5, None)]
    assert got["number"] == got["null"] == got["text"] == got["objects"] and got["broken"] == []
    assert got["list"] == [*got["objects"], ("2024-01-03", 3.0, None)]


def test_scripts_are_aligned_without_a_shuffle(spark):
    """Gaps, other orders and repeated dates in either list, against a plain lookup; no exchange in the plan."""
    days = [ms((2024, 1, d)) for d in range(1, 29)]
    trend = [(days[i], 1 + i / 100) for i in (5, 3, 3, 8, 20, 21, 0, 27)]
    acc = [(days[i], 2 + i / 100) for i in (3, 5, 9, 8, 27, 21, 26)]
    text = (f'var Data_netWorthTrend = [{",".join(f"[{a},{b},0]" for a, b in trend)}];'
            f'var Data_ACWorthTrend = [{",".join(f"[{a},{b}]" for a, b in acc)}];')
    scripts = spark.createDataFrame([("f", text)], "fund_code string, payload string")
    rows = P.nav_scripts(scripts)
    held = dict(acc)
    want = [(b, held.get(a)) for a, b in trend]
    assert sorted(((r.nav, r.acc_nav) for r in rows.collect()), key=str) == sorted(want, key=str)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_payload_files_read_in_batch_and_stream(spark, tmp_path):
    rows = [("000001", "one ä\n two"), ("000002", "x" * 5000), ("000003", "")]
    for code, text in rows:
        (tmp_path / "in" / f"fund_code={code}").mkdir(parents=True)
        (tmp_path / "in" / f"fund_code={code}" / "page.txt").write_text(text)
    folder = str(tmp_path / "in")
    got = lambda df: sorted((r.fund_code, r.payload) for r in df.collect())
    rows = rows[:2]  # an empty file is no row
    assert got(P.payload_files(spark, folder)) == rows
    out = str(tmp_path / "out")

    def run():
        P.payload_files(spark, folder, streaming=True).writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
        return got(spark.read.parquet(out))

    assert run() == rows
    (tmp_path / "in" / "fund_code=000004").mkdir()
    (tmp_path / "in" / "fund_code=000004" / "page.txt").write_text("late")
    assert run() == [*rows, ("000004", "late")]  # files that were read before are not read again


def test_pages_map_rows_and_keep_bad_pages_apart(spark):
    row = {"FSRQ": "2024-01-02", "DWJZ": "1.1", "LJJZ": "--", "JZZZL": "0.3", "ACTUALSYI": None}
    pages = [
        ("ok", json.dumps({"Data": {"LSJZList": [row], "TotalCount": 1}, "ErrCode": 0})),
        ("empty", json.dumps({"Data": None, "TotalCount": 0, "ErrCode": 0})),
        ("error", json.dumps({"Data": None, "TotalCount": 0, "ErrCode": 7})),
        ("nodata", json.dumps({"ErrCode": 0})),
        ("nodate", json.dumps({"Data": {"LSJZList": [{**row, "FSRQ": ""}], "TotalCount": 1}})),
    ]
    rows, bad = P.nav_pages(spark.createDataFrame(pages, "fund_code string, payload string"))
    assert [(r.fund_code, r.nav, r.acc_nav, r.daily_return, r.cum_return) for r in rows.collect()] == [("ok", 1.1, None, 0.3, None)]
    assert {r.fund_code: r.reason for r in bad.collect()} == {"error": "error 7", "nodata": "no data object", "nodate": "row without date"}


def test_text_functions(spark):
    one = spark.range(1)
    cases = [
        (X.base_name(F.lit(" 华夏成长(后端) ")), "华夏成长"), (X.base_name(F.lit("Alpha C")), "Alpha"), (X.share_key(F.lit("基金C")), "基金"),
        (X.quarter_text(F.lit("2024年1季度股票投资明细")), "2024Q1"), (X.quarter_text(F.lit(" x ")), "x"),
        (X.scale_text(F.lit("35.17亿")), 35.17), (X.scale_text(F.lit("5000万")), 0.5), (X.scale_text(F.lit("--")), None),
        (X.tenure_text_days(F.lit("4年又148天")), 1608), (X.tenure_text_days(F.lit("无")), None),
        (X.return_text(F.lit("1,234.5%")), 1234.5), (X.safe_number(F.lit("12.5%")), 12.5), (X.safe_number(F.lit("nan")), None),
        (X.classify_market(F.lit("005930")), "OTHER"), (X.classify_market(F.lit("430001")), "A"), (X.classify_market(F.lit("00700")), "HK"),
        (X.is_bj_stock(F.lit("830001")), True), (X.market_of(F.lit("830001"), F.lit("BJ")), "BJ"), (X.market_of(F.lit("600000"), F.lit("OTHER")), "OTHER"),
        (X.clip_text(F.lit("a  b\nc"), 3), "a b…"), (X.theme_of(F.lit("电子")), "泛科技TMT"), (X.theme_of(F.lit("")), "未知"),
        (X.json_object_text(F.lit('x {"a":{"b":1}} y')), '{"a":{"b":1}}'), (X.balance_cap(F.lit("松"), F.lit(None)), 0.22),
        (X.balance_cap(F.lit("松"), F.lit(0.5)), 0.30), (X.same_day_years_back(F.lit("2024-02-29").cast("date"), 3), "2021-02-29"),
    ]
    row = one.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert row[i] == want, (i, row[i], want)


def test_anchor_dates_clamp_after_the_first(spark):
    got = spark.range(1).select(X.anchor_dates(F.lit("2024-01-31").cast("date"), F.lit("2025-01-27").cast("date"), 6).alias("a")).first().a
    assert got == [D(2024, 1, 31), D(2024, 7, 28)]
