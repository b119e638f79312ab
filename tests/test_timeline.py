"""Point-in-time reads against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from navloom.operators import history as H
from navloom.operators import holdings as O
from navloom.operators import joins as J
from navloom.operators import timeline as T
from navloom.operators import windows as W

DAY = dt.date(1996, 2, 27)


def series(seed, n, gap):
    draw = random.Random(seed)
    day, price, out = DAY, 1.0, []
    for _ in range(n):
        day += dt.timedelta(days=draw.randint(1, gap))
        price *= 1 + draw.uniform(-0.06, 0.065)
        out.append((day, price))
    return out


FUNDS = {"a": series(1, 900, 2), "b": series(2, 70, 30), "c": series(3, 400, 3), "d": series(4, 3, 500), "e": series(5, 1400, 1)}
DATES = [DAY + dt.timedelta(days=k) for k in (0, 1, 40, 366, 700, 1097, 1098, 1400, 2200, 5000)] + [dt.date(2000, 2, 29)]


def start_text(day, years):
    return f"{day.year - years}-{day:%m-%d}"


def fold(prices):
    rets = [b / a - 1 for a, b in zip(prices, prices[1:])]
    peak, fall = prices[0], 0.0
    for p in prices:
        peak = max(peak, p)
        fall = min(fall, p / peak - 1)
    vol = statistics.stdev(rets) * math.sqrt(244) if len(rets) > 1 else 0
    return (statistics.mean(rets) * 244 / vol if len(rets) >= 19 and vol > 1e-9 else 0.0), -fall


def expected(least):
    out = {}
    for fund, rows in FUNDS.items():
        for as_of in DATES:
            seen = [p for d, p in rows if d <= as_of and f"{d}" >= start_text(as_of, 3)]
            if len(seen) < least:
                continue
            past = lambda n: seen[-1] / (seen[-1 - n] if len(seen) > n else seen[0]) - 1  # noqa: B023,E731
            year = fold(seen[-244:])
            all_ = fold(seen)
            out[as_of, fund] = (len(seen), year[0], all_[0], year[1], all_[1], past(243),
                                0.5 * past(21) + 0.3 * past(63) + 0.2 * past(126), seen[-1])
    return out


@pytest.fixture(scope="module")
def nav(spark):
    rows = [(f, d, None if i % 7 == 0 else p, p) for f, x in FUNDS.items() for i, (d, p) in enumerate(x)]
    rows += [("a", DAY - dt.timedelta(days=9), 0.0, None), ("z", DAY, -1.0, 0.0)]
    return spark.createDataFrame(rows, "fund_code string, trade_date date, acc_nav double, nav double")


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(d,) for d in DATES + DATES[:2]], "as_of date")


@pytest.mark.parametrize("least", [2, 60])
def test_metrics_match_a_loop_over_dates(nav, dates, least):
    want = expected(least)
    got = {(r.as_of, r.fund_code): (r.days, r.sharpe_1y, r.sharpe_3y, r.max_drawdown_1y, r.max_drawdown_3y, r.return_1y,
                                    r.momentum, r.nav_on_date) for r in H.metrics_at(nav, dates, least=least).collect()}
    assert got.keys() == want.keys() and len(want) > 15
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_every_stretch_is_folded(spark):
    rows = FUNDS["b"][:40]
    df = spark.createDataFrame([("b", d, p) for d, p in rows], "fund_code string, trade_date date, price double")
    index = T.series_index(df, ["fund_code"], "price")
    pairs = spark.createDataFrame([(i, j) for i in range(1, 41) for j in range(i, 41)], "lo int, hi int")
    read = index.join(F.broadcast(pairs)).select("lo", "hi", T.folded(F.col("lo"), F.col("hi")).alias("x")).collect()
    for r in read:
        prices = [p for _, p in rows[r.lo - 1:r.hi]]
        rets = [b / a - 1 for a, b in zip(prices, prices[1:])]
        assert r.x.n == len(rets) and r.x.s == pytest.approx(sum(rets)) and r.x.q == pytest.approx(sum(x * x for x in rets))
        assert r.x.peak == max(prices) and r.x.fall == pytest.approx(-fold(prices)[1] if len(prices) > 1 else 0.0)


def test_rows_that_move_do_not_grow_with_the_dates(spark, nav, dates):
    """Dates are read inside a fund's row: no join, and no row is made for a date before the result."""
    plan = H.metrics_at(nav, dates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" not in plan and plan.count("Generate inline") == 1


def test_no_dates_and_no_prices(nav, dates):
    assert H.metrics_at(nav, dates.limit(0)).count() == 0
    assert H.metrics_at(nav.limit(0), dates).count() == 0
    assert W.ytd_return(nav.withColumn("value", F.col("nav")), dates.limit(0)).count() == 0


def test_ytd_returns_match_a_loop(nav, dates):
    got = {(r.as_of, r.fund_code): (r.ytd_from_year_end, r.ytd_from_first_point)
           for r in W.ytd_return(nav.withColumn("value", F.col("nav")), dates).collect()}
    want = {}
    for fund, rows in FUNDS.items():
        for as_of in DATES:
            before = [p for d, p in rows if d.year == as_of.year - 1]
            here = [p for d, p in rows if d.year == as_of.year and d <= as_of]
            if before or here:
                want[as_of, fund] = ((here[-1] / before[-1] - 1) * 100 if before and here else None,
                                     (here[-1] / here[0] - 1) * 100 if here else None)
    got = {k: v for k, v in got.items() if k[1] != "z"}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


HELD = [("f", "1968Q4", "x", 60.0), ("f", "1968Q4", "y", 40.0), ("f", "1969Q2", "x", 30.0), ("f", "1999Q1", "y", 50.0),
        ("f", "1999Q2", "y", 20.0), ("f", "1999Q2", "z", 20.0), ("g", "1999Q2", "z", 9.0), ("g", "1999Q3", "z", 9.0)]
SEEN = [dt.date(1969, 2, 13), dt.date(1969, 2, 14), dt.date(1969, 9, 1), dt.date(1999, 8, 13), dt.date(1999, 8, 14), dt.date(2005, 1, 1)]


def disclosed(quarter):
    end = dt.date(int(quarter[:4]), int(quarter[5]) * 3, 28) + dt.timedelta(days=4)
    return end.replace(day=1) - dt.timedelta(days=1) + dt.timedelta(days=45)


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame(HELD, "fund_code string, quarter string, asset_code string, hold_ratio double")


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame([(d,) for d in SEEN], "as_of date")


def test_visible_rows_and_totals(held, seen):
    """Quarters before 1970 are seen too."""
    want = sorted((d, *h) for d in SEEN for h in HELD if disclosed(h[1]) <= d)
    got = J.disclosed_cut(held, seen).select("as_of", "fund_code", "quarter", "asset_code", "hold_ratio").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 24
    totals = held.groupBy("fund_code", "quarter").agg(F.count("*").alias("n"), F.sum("hold_ratio").alias("ratio"))
    for by in (["fund_code"], []):
        sums = totals.groupBy(*by, "quarter").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio"))
        found = {tuple(r[c] for c in ["as_of", *by]): (r.newest, r.n, r.ratio)
                 for r in T.visible_totals(sums, seen, by, ["n", "ratio"]).collect()}
        plain = {}
        for d, fund, quarter, _, ratio in want:
            key = (d, fund) if by else (d,)
            newest, n, total = plain.get(key, ("", 0, 0.0))
            plain[key] = (max(newest, quarter), n + 1, total + ratio)
        assert found == plain


def test_drift_at_dates_equals_the_drift_of_what_is_visible(held, seen):
    got = {(r.as_of, r.fund_code): r.drift for r in O.drift_at(held, seen).collect()}
    cut = O.style_drift(J.disclosed_cut(held, seen), ["as_of", "fund_code"])
    want = {(r.as_of, r.fund_code): r.drift for r in cut.collect() if r.drift is not None}
    assert got == pytest.approx(want) and len(want) > 3
