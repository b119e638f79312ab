"""Diversification against direct linear algebra, and no look-ahead."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.operators import quality as Q

P = Q.QualityParams(min_tenure_days=10, min_nav_days=30, roll=20, align_start="2024-01-01", min_common_days=30, target=4, extra=2, per_company=2)


def market(spark, n=14, days=90, seed=3):
    rng = np.random.default_rng(seed)
    common = rng.normal(0.0005, 0.01, days)
    navs = np.cumprod(1 + common * rng.uniform(0.5, 1.5, (n, 1)) + rng.normal(0, 0.008, (n, days)), axis=1)
    start = dt.date(2024, 1, 1)
    rows = [(f"{i:06d}", start + dt.timedelta(days=t), float(navs[i, t])) for i in range(n) for t in range(days)]
    nav = spark.createDataFrame(rows, "fund_code string, trade_date date, nav double")
    funds = spark.createDataFrame([(f"{i:06d}", f"基金{i}", f"c{i % 5}", 4000 + 13 * i) for i in range(n)],
                                  "fund_code string, name string, company string, tenure_days int")
    held = spark.createDataFrame([(f"{i:06d}", q, f"s{(i + k) % 6}", float(1 + k + i % 3)) for i in range(n) for q in ("2023Q2", "2023Q3") for k in range(3)],
                                 "fund_code string, quarter string, asset_code string, hold_ratio double")
    return navs, nav, funds, held


def pieces(spark, dates):
    navs, nav, funds, held = market(spark)
    d = spark.createDataFrame([(x,) for x in dates], "as_of date")
    scored, space = Q.build_space(funds, nav, held, d, "2024-04-01", P)
    return navs, nav, funds, held, scored, space


def naive_pick(q01, rcorr, axes, companies, quality, k):
    order = sorted(range(len(q01)), key=lambda i: (-quality[i], i))
    chosen = [max(order, key=lambda i: q01[i])]
    while len(chosen) < k:
        best, best_value = None, -np.inf
        for i in order:
            if i in chosen or sum(companies[c] == companies[i] for c in chosen) >= P.per_company:
                continue
            lo, hi = axes[chosen].min(axis=0), axes[chosen].max(axis=0)
            value = q01[i] - P.lam * rcorr[i, chosen].mean() + P.mu * (np.clip(axes[i] - hi, 0, None) + np.clip(lo - axes[i], 0, None)).sum()
            if value > best_value:
                best, best_value = i, value
        if best is None:
            break
        chosen.append(best)
    return chosen


def test_picks_and_weights_match_direct_algebra(spark):
    day = dt.date(2024, 3, 20)
    navs, nav, funds, held, scored, space = pieces(spark, [day])
    rows = sorted(space.collect(), key=lambda r: r.fund_code)
    idx = [int(r.fund_code) for r in rows]
    assert len(idx) == 14
    cut = navs[idx, :80]
    rets = np.diff(cut, axis=1) / cut[:, :-1]
    z = (rets - rets.mean(axis=1, keepdims=True)) / rets.std(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    resid = z - np.outer(z @ vt[0], vt[0])
    rcorr = np.corrcoef(resid)
    units = np.vstack([r.unit for r in rows])
    assert np.allclose(units @ units.T, rcorr, atol=1e-9)
    assert rows[0].pc1_var_ratio == pytest.approx(s[0] ** 2 / (s ** 2).sum())
    load = u[:, 1:5]
    load = (load - load.mean(axis=0)) / load.std(axis=0)
    axes = np.vstack([r.axes for r in rows])
    assert np.allclose(np.abs(axes), np.abs(load), atol=1e-6)
    picks = [r.fund_code for r in Q.greedy_pick(space, P).orderBy("rank").collect()]
    want = naive_pick(np.array([r.q01 for r in rows]), rcorr, axes, [r.company for r in rows], [r.quality for r in rows], P.target + P.extra)
    assert picks == [rows[i].fund_code for i in want]
    held_rows = Q.quality_portfolio(space, P).where(F.col("weight").isNotNull()).orderBy("rank").collect()
    w = np.array([r.weight for r in held_rows])
    assert w.sum() == pytest.approx(1.0) and len(w) == P.target
    sel = [int(r.fund_code) for r in held_rows]
    cov = np.cov(rets[[idx.index(i) for i in sel]])
    assert np.allclose(w, Q.parity_weights(cov, P.cap), atol=1e-12)
    assert held_rows[0].enb <= P.target + 1e-9


def test_later_values_do_not_change_earlier_dates(spark):
    day = dt.date(2024, 3, 10)
    _, nav, funds, held, _, _ = pieces(spark, [day])
    bent = nav.withColumn("nav", F.when(F.col("trade_date") > F.lit(day), F.col("nav") * 3).otherwise(F.col("nav")))
    d = spark.createDataFrame([(day,)], "as_of date")
    shape = lambda n: sorted((r.fund_code, round(r.quality, 9)) for r in Q.score(funds, n, held, d, "2024-04-01", P).collect())
    assert shape(nav) == shape(bent)


def test_replay_replaces_at_most_three_and_keeps_places(spark):
    picks = [("2024-01-01", ["a", "b", "c", "d", "e", "f"]), ("2024-07-01", ["x", "y", "b", "z", "w", "v"])]
    rows = [(dt.date.fromisoformat(day), n, c) for day, codes in picks for n, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "as_of date, rank int, fund_code string")
    anchors = df.select("as_of").distinct()
    got = {}
    for r in Q.replay_holdings(df, anchors, P, max_replace=3).orderBy("as_of", "slot").collect():
        got.setdefault(str(r.as_of), []).append(r.fund_code)
    assert got == {"2024-01-01": ["a", "b", "c", "d"], "2024-07-01": ["x", "b", "y", "z"]}
