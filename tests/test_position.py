"""Candidate choice and walk-forward curves against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from navloom.operators import position as P
from tests.test_scale import cap_twin


def test_no_single_change_improves_the_choice():
    rng = np.random.default_rng(4)
    exposure, score = rng.uniform(0, 5, (20, 6)), rng.uniform(0, 1, 20)
    exposure[3] = 0.0
    groups = [np.arange(i, i + 5) for i in range(0, 20, 5)]
    pick = P.pick_per_cluster(groups, score, exposure, 0.2)
    quality = (score - score.min()) / (score.max() - score.min())

    def value(rows):
        e = exposure[rows].sum(axis=0)
        return quality[rows].mean() - 12 * max(0.0, e.max() / e.sum() - 0.2)

    best = value(pick)
    for c, rows in enumerate(groups):
        for row in rows:
            if exposure[row].any():
                assert value([*pick[:c], row, *pick[c + 1:]]) <= best + 1e-9
    assert all(p in g for p, g in zip(pick, groups))


def strength(series):
    """Strength totals and deviations of a set of value lists, by the written rules."""
    def back(s, n):
        return s[-1] / s[-1 - n] - 1

    momentum = np.array([0.5 * back(s, 20) + 0.3 * back(s, 60) + 0.2 * back(s, 120) if len(s) > 120
                         else (0.5 * back(s, 20) + 0.3 * back(s, 60)) / 0.8 for s in series])
    rets = [np.diff(s)[-60:] / np.array(s[:-1])[-60:] for s in series]
    risk = np.array([r.mean() / r.std() * 252 ** 0.5 for r in rets])
    rank = np.argsort(np.argsort(risk)) / (len(series) - 1) * 100
    total, deviation = [], []
    scaled = (momentum - momentum.min()) / (momentum.max() - momentum.min()) * 100
    for i, s in enumerate(series):
        a20, a60 = np.mean(s[-20:]), np.mean(s[-60:])
        breadth = np.clip(60 * (s[-1] > a20) + 40 * (s[-1] > a60) + np.clip((s[-1] / a20 - 1) * 100, -10, 10), 0, 100)
        points = s[::-1][::20][: len(s) // 20]
        streak = 0
        while streak < len(points) - 1 and points[streak] > points[streak + 1]:
            streak += 1
        total.append(0.35 * scaled[i] + 0.25 * rank[i] + 0.25 * breadth + 0.15 * streak / (len(points) - 1) * 100)
        deviation.append(0.6 * (s[-1] / a20 - 1) * 100 + 0.4 * (s[-1] / a60 - 1) * 100)
    return np.array(total), np.array(deviation)


def tilt(total, deviation):
    z = (total - total.mean()) / total.std()
    raw = np.clip(1 + 0.3 * z, 0.5, 1.5) / len(total)
    for i, d in enumerate(deviation):
        if abs(d) > 3:
            pull = np.tanh(abs(d) / 5)
            raw[i] *= 1 + 0.25 * pull if total[i] >= 50 else 1 - (0.25 if d > 3 else 0.125) * pull
    return cap_twin(raw)


def test_walk_forward_equals_the_loop(spark):
    rng = np.random.default_rng(8)
    n, days = 5, 190
    navs = np.cumprod(1 + rng.normal(0.0005, 0.02, (n, days)), axis=1)
    start = dt.date(2024, 1, 1)
    rows = [(f"f{i}", start + dt.timedelta(days=t), float(navs[i, t])) for i in range(n) for t in range(days) if not (i == 0 and t % 19 == 7)]
    series = spark.createDataFrame(rows, "fund_code string, trade_date date, nav double")
    members = spark.createDataFrame([("s", f"f{i}") for i in range(n)], "set string, fund_code string")
    got = {r.trade_date: (r.strategy, r.equal) for r in P.walk_forward(members, series, ["set"]).collect()}
    common = [t for t in range(days) if t % 19 != 7]
    points = list(range(120, len(common) - 1, 21)) + [len(common) - 1]
    want = {start + dt.timedelta(days=common[120]): (1.0, 1.0)}
    last = (1.0, 1.0)
    for s, e in zip(points, points[1:]):
        cut = common[s]
        lists = [[navs[i, t] for t in range(cut + 1) if not (i == 0 and t % 19 == 7)] for i in range(n)]
        w = tilt(*strength(lists))
        for k in range(s + 1, e + 1):
            rel = navs[:, common[k]] / navs[:, cut]
            want[start + dt.timedelta(days=common[k])] = (last[0] * float(w @ rel), last[1] * float(rel.mean()))
        last = want[start + dt.timedelta(days=common[e])]
    assert got.keys() == want.keys()
    for day, pair in want.items():
        assert got[day] == pytest.approx(pair, rel=1e-9)


def test_choice_is_made_on_all_holdings_of_the_newest_quarter(spark):
    from navloom.plans import position
    from navloom.sources import adapters

    sf_dir = "/root/testdata/sf0.01"
    rows = adapters.brand_holdings(spark, sf_dir).collect()
    quarter = max(r.quarter for r in rows)
    want = {(r.fund_code, r.asset_code) for r in rows if r.quarter == quarter}
    _, vectors, held, _ = position.brand_scenario(spark, sf_dir)
    assert {(r.fund_code, r.asset_code) for r in held.collect()} == want
    shares = {}
    for r in rows:
        if r.quarter == quarter:
            shares[r.fund_code] = shares.get(r.fund_code, 0.0) + r.hold_ratio
    got = {r.fund_code: r.s for r in vectors.groupBy("fund_code").agg({"ratio": "sum"}).toDF("fund_code", "s").collect()}
    assert got == pytest.approx(shares)
    per_fund = [sum(f == fund for f, _ in want) for fund in {f for f, _ in want}]
    assert max(per_fund) > 20
