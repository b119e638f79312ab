"""What a screen at past dates reads, and the returns of its rounds, on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from navloom.operators import history as H
from navloom.operators import timeline as T
from navloom.sources import adapters as A

DAY = dt.date(1996, 10, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two lines a week of four funds, one of them with a long key and one unknown to the suppliers, and null keys."""
    d = str(tmp_path_factory.mktemp("tables"))
    draw = random.Random(7)
    lines = [(k, draw.randint(1, 9), 1.0 + draw.randint(0, 4), draw.uniform(100, 900), 0.05 * draw.randint(0, 2), 0.01 * draw.randint(0, 3),
              dt.datetime.combine(DAY, dt.time()) + dt.timedelta(days=3 * i)) for k in (1, 2, 3, 1234567) for i in range(150)]
    lines += [(None, 1, 1.0, 9.0, 0.0, 0.0, dt.datetime(1980, 1, 1)), (1, 1, 1.0, 9.0, 0.0, 0.0, None)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write(lines, "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
          "l_shipdate timestamp", "lineitem")
    write([(k, k % 2, 100.0 * k) for k in (1, 2, 1234567, 5)], "s_suppkey long, s_nationkey int, s_acctbal double", "supplier")
    write([(k, "PROMO" if k % 3 else "SMALL") for k in range(1, 9)], "p_partkey long, p_type string", "part")
    write([(0, "n0"), (1, "n1")], "n_nationkey int, n_name string", "nation")
    return d


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_some_funds_are_read_as_they_are_among_all(spark, tables):
    funds = spark.createDataFrame([("000002",), ("1234567",), ("000005",), ("000002",), (None,)], "fund_code string")
    one_of = F.col("fund_code").isin("000002", "1234567", "000005")
    for table, least in ((A.nav_daily, 200), (A.fund_details, 3)):
        want = rows_of(table(spark, tables).where(one_of))
        assert rows_of(table(spark, tables, funds)) == want and len(want) >= least
    plan = A.nav_daily(spark, tables, funds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the funds meet the lines, not the sums


def test_wanted_holdings_keep_their_ratios(spark, tables):
    asked = [("000001", "1996Q4"), ("1234567", "1997Q4"), ("000003", "1997Q3"), ("000002", "1950Q4")]
    wanted = spark.createDataFrame(asked, "fund_code string, quarter string")
    whole = A.holdings_overlap(spark, tables)
    same = ["fund_code", "quarter"]
    got = rows_of(A.holdings_overlap(spark, tables, wanted).join(wanted, same, "left_semi"))
    assert got == rows_of(whole.join(wanted, same, "left_semi")) and len(got) > 12
    assert rows_of(A.overlap_quarters(spark, tables)) == rows_of(whole.select("quarter").distinct()) == [("1996Q4",), ("1997Q4",)]


def test_rounds_match_a_loop(spark):
    """Open rounds, a fund without prices before the purchase, one without any, and prices of funds nobody holds."""
    draw = random.Random(3)
    prices = {f: [(DAY + dt.timedelta(days=9 * i + start), draw.uniform(1, 2)) for i in range(40)] for f, start in
              (("a", 0), ("b", 3), ("late", 120), ("other", 1))}
    rounds = [(DAY + dt.timedelta(days=60), DAY + dt.timedelta(days=150)), (DAY + dt.timedelta(days=150), DAY + dt.timedelta(days=200)),
              (DAY + dt.timedelta(days=300), None)]
    picks = [(buy, f, 0.25) for buy, _ in rounds for f in ("a", "b", "late", "none")]
    nav = spark.createDataFrame([(f, d, None, p) for f, x in prices.items() for d, p in x], "fund_code string, trade_date date, acc_nav double, nav double")
    funds, totals = H.round_returns(
        spark.createDataFrame(rounds, "buy_date date, sell_date date"),
        spark.createDataFrame(picks, "as_of date, fund_code string, weight double"), nav,
        nav.groupBy("trade_date").agg(F.avg("nav").alias("price")))
    at = lambda f, day: next((p for d, p in reversed(prices.get(f, [])) if d <= day), None)
    want = {}
    for buy, sell in rounds:
        for f in ("a", "b", "late", "none"):
            both = sell and at(f, buy) and at(f, sell)
            want[buy, f] = None if sell is None else at(f, sell) / at(f, buy) - 1 if both else 0.0
    got = {(r.buy_date, r.fund_code): r.ret for r in funds.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v)), k
    for r in totals.collect():
        assert r.n_funds == 4
        mine = [want[r.buy_date, f] for f in ("a", "b", "late", "none")]
        assert r.portfolio_return == (None if r.sell_date is None else pytest.approx(sum(mine) / 4))


def test_only_prices_of_held_funds_are_related_to_the_dates(spark, monkeypatch):
    """In one pass for both ends of the rounds."""
    seen = []
    plain = H.asof

    def watched(events, series, *args, **kw):
        seen.append((sorted(events.columns), series))
        return plain(events, series, *args, **kw)

    monkeypatch.setattr(H, "asof", watched)
    nav = spark.createDataFrame([(f"f{i}", DAY, None, 1.0) for i in range(50)], "fund_code string, trade_date date, acc_nav double, nav double")
    H.round_returns(spark.createDataFrame([(DAY, DAY)], "buy_date date, sell_date date"),
                    spark.createDataFrame([(DAY, "f7", 1.0)], "as_of date, fund_code string, weight double"), nav,
                    nav.groupBy("trade_date").agg(F.avg("nav").alias("price")))
    related = [series for columns, series in seen if "fund_code" in columns]
    assert len(related) == 1 and related[0].count() == 1


def test_stretches_of_places(spark):
    rows = spark.createDataFrame([(1, 3), (2, 2), (3, 2), (5, 1)], "a int, b int")
    got = [r[0] for r in rows.select(T.stretch(F.col("a"), F.col("b"))).collect()]
    assert got == [[1, 2, 3], [2], [], []]
