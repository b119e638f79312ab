"""Quality portfolio: gate, score, diversify, weigh - for all decision dates at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from navloom import constants as K
from navloom.functions import stats as S
from navloom.operators import holdings as O
from navloom.operators.ledger import portfolio_curve
from navloom.operators.similarity import tiled
from navloom.operators.themes import best_share
from navloom.operators.timeline import date_list, day_at, days_upto, series_index
from navloom.operators.windows import tenure_at
from navloom.session import cut_lineage

FUNDS_PER_GRAM = 1000
GRAM_FANIN = 32


@dataclass(frozen=True)
class QualityParams:
    min_tenure_days: int = K.MIN_TENURE_DAYS
    min_nav_days: int = K.MIN_NAV_DAYS
    roll: int = K.ROLL_DAYS
    align_start: str = K.ALIGN_START
    min_common_days: int = K.MIN_COMMON_DAYS
    target: int = K.TARGET_HOLDINGS
    extra: int = 0
    lam: float = K.LAMBDA_DIV
    mu: float = K.MU_STYLE
    cap: float = K.WEIGHT_CAP
    per_company: int = K.MAX_PER_COMPANY
    axes: int = K.N_STYLE_AXES


def _at_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows repeated for every decision date they are known at; the dates are one short array."""
    all_dates = dates.agg(F.array_sort(F.collect_set("as_of"))).scalar()
    return rows.withColumn("as_of", F.explode(all_dates)).where(F.col("as_of") >= F.col("trade_date"))


def _vectors(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])


@F.pandas_udf(T.DoubleType())
def _dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Product of two vectors, row by row."""
    return pd.Series([float(np.dot(x, y)) if x is not None and y is not None else None for x, y in zip(a, b)])


@F.pandas_udf(_vectors("rets", "z"))
def _return_vectors(navs: pd.Series) -> pd.DataFrame:
    """Simple returns and the same standardised with the population deviation."""
    rets = [np.diff(v) / v[:-1] for v in navs]
    z = [(r - r.mean()) / (r.std() or 1.0) if len(r) else r for r in rets]
    return pd.DataFrame({"rets": rets, "z": z})


@F.pandas_udf(_vectors("unit", "loads"))
def _residual_vectors(z: pd.Series, dirs: pd.Series, scale: pd.Series) -> pd.DataFrame:
    """Unit residual after the first direction, and the loadings on the others."""
    units, loads = [], []
    for vector, axes, sizes in zip(z, dirs, scale):
        axes = np.vstack(axes)
        along = axes @ vector
        rest = vector - along[0] * axes[0]
        norm = np.linalg.norm(rest)
        units.append(rest / norm if norm > 0 else np.zeros_like(rest))
        loads.append(np.where(sizes[1:] > 1e-9, along[1:] / np.where(sizes[1:] > 1e-9, sizes[1:], 1.0), 0.0))
    return pd.DataFrame({"unit": units, "loads": loads})


# ---- score ---------------------------------------------------------------------------------------

def score(funds: DataFrame, nav: DataFrame, holdings: DataFrame, dates: DataFrame, run_date: str, p: QualityParams) -> DataFrame:
    """Scored pool per decision date, share classes reduced to one.

    funds: fund_code, name, company, tenure_days (on the run date). The rolling Sharpe of a day and the sums up to it
    don't depend on the decision date, nor does the distance of two quarters: they are computed once, and a date reads
    them from a fund's index.
    """
    w = Window.partitionBy("fund_code").orderBy("trade_date")
    frame, upto = w.rowsBetween(-(p.roll - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = S.simple_returns(nav, ["fund_code"]).withColumn("_s", F.stddev_pop("ret").over(frame))
    rows = rows.withColumn("sh", F.when(
        (F.count("ret").over(frame) == p.roll) & (F.col("_s") > 0),
        F.avg("ret").over(frame) / F.col("_s") * F.sqrt(F.lit(252.0))))
    r, loss = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    # sums up to each day, so that a date needs one day's row
    rows = rows.select(
        "fund_code", "trade_date", "nav", "sh", F.stddev_pop("sh").over(upto).alias("sd"), F.avg(r).over(upto).alias("mean"),
        F.count(loss).over(upto).alias("losses"), F.sqrt(F.avg(loss * loss).over(upto)).alias("down"))
    index = series_index(rows, ["fund_code"], "nav", carry=("sh", "sd", "mean", "losses", "down"))

    def read(x):
        day, n = day_at(x["n"]), x["n"]
        ordered = F.array_sort(F.filter(F.transform(F.slice("days", 1, n), lambda y: y["sh"]), lambda y: y.isNotNull()))
        return F.struct(x["as_of"].alias("as_of"), n.cast("bigint").alias("days"), ordered.alias("ordered"), day.alias("day"))

    places = F.transform("_dates", lambda d: F.struct(d.alias("as_of"), days_upto(d).alias("n")))
    found = index.withColumn("_dates", date_list(dates)).withColumn("_x", F.filter(places, lambda x: x["n"] >= p.min_nav_days))
    found = found.select("fund_code", F.inline(F.transform("_x", read)))
    count = F.size("ordered")
    middle = 0.5 * F.get("ordered", F.floor((count - 1) / 2).cast("int")) + 0.5 * F.get("ordered", F.floor(count / 2).cast("int"))
    enough = (F.col("days") >= p.roll + 20) & (count >= 10)
    per_date = found.select(
        "as_of", "fund_code", "days", F.when(enough, middle).alias("sharpe_med"), F.when(enough, F.col("day.sd")).alias("sharpe_std"),
        F.when((F.col("day.losses") >= 5) & (F.col("day.down") > 0),
               F.col("day.mean") / F.col("day.down") * F.sqrt(F.lit(252.0))).alias("sortino"))
    gated = per_date.join(funds, "fund_code").withColumn(
        "tenure_days", tenure_at(F.col("tenure_days"), F.lit(run_date).cast("date"), F.col("as_of"))
    ).where(F.col("tenure_days") >= p.min_tenure_days)
    drift = O.drift_at(holdings, dates)
    scorable = cut_lineage(gated.where(F.col("sharpe_med").isNotNull()).join(drift, ["as_of", "fund_code"], "left"))
    z = S.robust_z(scorable, ["as_of"], list(K.QUALITY_WEIGHTS), floor=1e-12)
    z = z.withColumn("quality", S.weighted_z(K.QUALITY_WEIGHTS)).drop(*[f"z_{c}" for c in K.QUALITY_WEIGHTS])
    counts = z.groupBy("as_of").agg(F.count("*").alias("scored"))
    return z.join(counts.where(F.col("scored") >= p.target), "as_of")


# ---- aligned windows and return vectors ------------------------------------------------------------

def aligned_vectors(pool: DataFrame, nav: DataFrame, dates: DataFrame, p: QualityParams) -> DataFrame:
    """Return vectors of the funds that cover 95 % of the window, on the days all of those share.

    Adds rets, z, total_days and common_days. A vector is as long as the window.
    """
    rows = cut_lineage(_at_dates(nav.where(F.col("trade_date") >= p.align_start), dates).join(
        pool.select("as_of", "fund_code"), ["as_of", "fund_code"]))
    totals = rows.groupBy("as_of", "trade_date").agg(F.count("*").alias("_c")).groupBy("as_of").agg(F.count("*").alias("total_days"))
    have = rows.groupBy("as_of", "fund_code").agg(F.count("*").alias("_have")).join(totals, "as_of")
    aligned = have.where(F.col("_have") >= F.col("total_days") * K.ALIGN_COVERAGE).select("as_of", "fund_code", "total_days")
    sizes = aligned.groupBy("as_of").agg(F.count("*").alias("_n"))
    kept = rows.join(aligned, ["as_of", "fund_code"])
    common = kept.groupBy("as_of", "trade_date").agg(F.count("*").alias("_c")).join(sizes, "as_of").where(F.col("_c") == F.col("_n"))
    series = kept.join(common.select("as_of", "trade_date"), ["as_of", "trade_date"]).groupBy("as_of", "fund_code", "total_days").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "nav"))), lambda s: s["nav"]).alias("navs"))
    out = series.withColumn("common_days", F.size("navs")).where(F.col("common_days") >= p.min_common_days)
    out = out.withColumn("_v", _return_vectors("navs")).select("*", "_v.rets", "_v.z").drop("_v", "navs")
    return pool.join(out, ["as_of", "fund_code"])


def principal_axes(vectors: DataFrame, n: int) -> DataFrame:
    """Leading time directions per date: (as_of, dirs, scale, var_ratio).

    The day x day products of a thousand funds make one table; the tables are added up in two
    levels, so no task's work grows with the number of funds.
    """
    def partial(key, pdf):
        z = np.vstack(pdf["z"].to_numpy())
        return pd.DataFrame({"as_of": [key[0]], "_part": [key[1]], "gram": [(z.T @ z).ravel()]})

    def solve(key, pdf):
        total = np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0)
        t = int(round(len(total) ** 0.5))
        values, dirs = np.linalg.eigh(total.reshape(t, t))
        order = np.argsort(values)[::-1][:n]
        top = np.maximum(values[order], 0.0)
        return pd.DataFrame({"as_of": [key[0]], "dirs": [[dirs[:, i].tolist() for i in order]],
                             "scale": [np.sqrt(top)], "var_ratio": [top / max(np.trace(total.reshape(t, t)), 1e-300)]})

    def add(key, pdf):
        return pd.DataFrame({"as_of": [key[0]], "gram": [np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0)]})

    counts = vectors.groupBy("as_of").agg(F.ceil(F.count("*") / FUNDS_PER_GRAM).alias("_parts"))
    parts = vectors.join(counts, "as_of").withColumn("_part", F.pmod(F.hash("fund_code"), F.col("_parts"))).select("as_of", "_part", "z")
    grams = parts.groupBy("as_of", "_part").applyInPandas(partial, "as_of date, _part bigint, gram array<double>")
    sums = grams.groupBy("as_of", (F.col("_part") % GRAM_FANIN).alias("_part")).applyInPandas(add, "as_of date, gram array<double>")
    return sums.groupBy("as_of").applyInPandas(
        solve, "as_of date, dirs array<array<double>>, scale array<double>, var_ratio array<double>")


def diversified_space(vectors: DataFrame, p: QualityParams) -> DataFrame:
    """Adds unit (residual after the market direction, length 1), axes (standardised loadings) and q01."""
    pcs = principal_axes(vectors, 1 + p.axes)
    df = vectors.join(pcs, "as_of")
    df = df.withColumn("_r", _residual_vectors("z", "dirs", "scale")).withColumn("unit", F.col("_r.unit"))
    for k in range(1, 1 + p.axes):
        df = df.withColumn(f"_u{k}", F.coalesce(F.get("_r.loads", F.lit(k - 1)), F.lit(0.0)))
    aggs = [F.min("quality").alias("_qlo"), F.max("quality").alias("_qhi")]
    for k in range(1, 1 + p.axes):
        u = F.col(f"_u{k}")
        aggs += [F.avg(u).alias(f"_mean{k}"), F.stddev_pop(u).alias(f"_std{k}"), F.max_by(u, F.abs(u)).alias(f"_big{k}")]
    stats = df.groupBy("as_of").agg(*aggs)
    df = df.join(stats, "as_of")
    axes = [
        F.when(F.col(f"_std{k}") > 0, (F.col(f"_u{k}") - F.col(f"_mean{k}")) / F.col(f"_std{k}") * F.signum(f"_big{k}")).otherwise(0.0)
        for k in range(1, 1 + p.axes)]
    df = df.withColumn("axes", F.array(*axes)).withColumn("q01", (F.col("quality") - F.col("_qlo")) / (F.col("_qhi") - F.col("_qlo") + 1e-9))
    return df.select(*[c for c in vectors.columns if c != "z"], "unit", "axes", "q01", F.col("var_ratio")[0].alias("pc1_var_ratio"),
                     F.slice("var_ratio", 2, p.axes).alias("axis_var"))


def greedy_pick(space: DataFrame, p: QualityParams) -> DataFrame:
    """Picks target + extra funds per date, one per round, all dates side by side.

    The mean correlation with the picked funds is the product with the mean of their unit
    vectors, so a date's picks are one vector, the extremes of their axes and a few codes; no
    pair of pool funds is ever formed.
    """
    k = p.target + p.extra
    pool = space.select("as_of", "fund_code", "company", "quality", "q01", "unit", "axes")
    picked = None
    state = None
    for rank in range(k):
        if state is None:
            scored = pool.withColumn("_score", F.col("q01"))
        else:
            cand = pool.join(state, "as_of")
            used = F.size(F.filter("companies", lambda c: c == F.col("company")))
            cand = cand.where(~F.array_contains("codes", F.col("fund_code")) & (used < p.per_company))
            reach = F.zip_with(
                F.col("axes"), F.arrays_zip(F.col("lo").alias("lo"), F.col("hi").alias("hi")),
                lambda a, b: F.greatest(a - b["hi"], F.lit(0.0)) + F.greatest(b["lo"] - a, F.lit(0.0)))
            scored = cand.withColumn("_score", F.col("q01") - p.lam * _dot("unit", "mass") / F.size("codes")
                                     + p.mu * F.aggregate(reach, F.lit(0.0), lambda s, x: s + x))
        order = F.struct((-F.col("_score")).alias("s"), (-F.col("quality")).alias("q"), F.col("fund_code").alias("c"))
        best = scored.groupBy("as_of").agg(F.min_by(F.struct("fund_code", "company", "unit", "axes", "q01"), order).alias("b"))
        if state is None:
            grown = best.select(
                "as_of", F.array("b.fund_code").alias("codes"), F.array("b.company").alias("companies"),
                F.col("b.unit").alias("mass"), F.col("b.axes").alias("lo"), F.col("b.axes").alias("hi"))
        else:
            old = state.join(best, "as_of", "left")
            add = F.col("b").isNotNull()
            both = lambda c, new, fn: F.when(add, F.zip_with(c, new, fn)).otherwise(F.col(c))
            grown = old.select(
                "as_of", F.when(add, F.array_append("codes", F.col("b.fund_code"))).otherwise(F.col("codes")).alias("codes"),
                F.when(add, F.array_append("companies", F.col("b.company"))).otherwise(F.col("companies")).alias("companies"),
                both("mass", "b.unit", lambda x, y: x + y).alias("mass"),
                both("lo", "b.axes", lambda x, y: F.least(x, y)).alias("lo"), both("hi", "b.axes", lambda x, y: F.greatest(x, y)).alias("hi"))
        state = cut_lineage(grown)
    return state.select("as_of", F.posexplode("codes").alias("rank", "fund_code"))


# ---- weights -------------------------------------------------------------------------------------------

def parity_weights(cov: np.ndarray, cap: float, rounds: int = 200) -> np.ndarray:
    """Equal risk shares, each weight capped.

    Equal shares are the minimum of x'Cx / 2 - mean(log x), scaled to one: each coordinate has its minimum in closed
    form with the others fixed. Weights over the cap are set to it and the others solved again with what is left.
    """
    n = len(cov)
    w, free, left = np.zeros(n), np.ones(n, bool), 1.0
    while free.any():
        c = cov[np.ix_(free, free)]
        d = np.maximum(np.diag(c), 1e-18)
        x = 1 / np.sqrt(d * len(c))
        for _ in range(rounds):
            before = x.copy()
            for i in range(len(c)):
                rest = c[i] @ x - c[i, i] * x[i]
                x[i] = (np.sqrt(rest * rest + 4 * d[i] / len(c)) - rest) / (2 * d[i])
            if np.abs(x - before).max() <= 1e-12 * x.max():
                break
        w[free] = left * x / x.sum()
        over = free & (w > cap)
        if not over.any() or cap * n < 1:
            break
        w[over] = cap
        free &= ~over
        left = 1 - w[~free].sum()
    return w


def weigh(selected: DataFrame, by: list[str], p: QualityParams) -> DataFrame:
    """Risk-parity weights and the diversification figures of each picked set.

    selected: by + fund_code, rank, rets, unit. A set holds the picked funds only.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in selected.select(*by).schema)

    def solve(key, pdf):
        pdf = pdf.sort_values("rank")
        rets, units = np.vstack(pdf["rets"].to_numpy()), np.vstack(pdf["unit"].to_numpy())
        n = len(rets)
        corr = np.corrcoef(rets) if n > 1 else np.ones((1, 1))
        off = ~np.eye(n, dtype=bool)
        values = np.linalg.eigvalsh(np.atleast_2d(corr))
        share = values[values > 1e-10] / values[values > 1e-10].sum()
        out = pdf[[*by, "fund_code", "rank"]].copy()
        out["weight"] = parity_weights(np.atleast_2d(np.cov(rets)), p.cap)
        out["orig_corr_mean"] = float(np.atleast_2d(corr)[off].mean()) if n > 1 else None
        out["resid_corr_mean"] = float((units @ units.T)[off].mean()) if n > 1 else None
        out["enb"] = float(np.exp(-(share * np.log(share)).sum()))
        return out

    return selected.groupBy(*by).applyInPandas(
        solve, f"{fields}, fund_code string, rank int, weight double, orig_corr_mean double, resid_corr_mean double, enb double")


def correlation_edges(vectors: DataFrame, by: list[str], tile: int = 512) -> DataFrame:
    """(by, i, j, corr) of the return vectors (pos, fund_code, rets), computed tile by tile."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*by).schema)

    def compare(key, pdf):
        def side(t):
            part = pdf[pdf["_own"] == t].sort_values("pos")
            x = np.vstack(part["rets"].to_numpy())
            x = x - x.mean(axis=1, keepdims=True)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return part["pos"].to_numpy(), part["fund_code"].to_numpy(), x / np.where(norm == 0, 1.0, norm)

        (pi, ci, xi), (pj, cj, xj) = side(key[-2]), side(key[-1])
        a, b = np.nonzero(pi[:, None] < pj[None, :])
        out = pd.DataFrame({name: [key[n]] * len(a) for n, name in enumerate(by)})
        out["i"], out["j"], out["corr"] = ci[a], cj[b], (xi @ xj.T)[a, b]
        return out

    return tiled(vectors, by, tile).groupBy(*by, "ti", "tj").applyInPandas(compare, f"{fields}, i string, j string, corr double")


# ---- the whole portfolio ------------------------------------------------------------------------------------

def build_space(funds, nav, holdings, dates, run_date, p: QualityParams) -> tuple[DataFrame, DataFrame]:
    """(scored pool, aligned pool with residual directions)."""
    scored = cut_lineage(score(funds, nav, holdings, dates, run_date, p))
    pool = best_share(scored, ["as_of"])
    vectors = cut_lineage(aligned_vectors(pool, nav, dates, p))
    return scored, cut_lineage(diversified_space(vectors, p))


def quality_portfolio(space: DataFrame, p: QualityParams) -> DataFrame:
    """Picks with rank, weight (first `target` ranks) and the figures of the set."""
    picks = cut_lineage(greedy_pick(space, p))
    full = picks.join(space, ["as_of", "fund_code"])
    weights = weigh(full.where(F.col("rank") < p.target), ["as_of"], p)
    return full.drop("rets", "unit").join(weights.drop("rank"), ["as_of", "fund_code"], "left")


def diagnose(space: DataFrame, picks: DataFrame, codes: DataFrame, p: QualityParams) -> DataFrame:
    """Why a fund was not picked: its standing, mean correlation to the picks, the weakest pick."""
    chosen = picks.where(F.col("rank") < p.target).select("as_of", "fund_code")
    inside = space.join(chosen.withColumn("selected", F.lit(True)), ["as_of", "fund_code"], "left").withColumn(
        "selected", F.coalesce("selected", F.lit(False)))
    picked = inside.where("selected")
    weakest = picked.groupBy("as_of").agg(F.min_by("fund_code", F.struct("q01", "fund_code")).alias("weakest"), F.min("q01").alias("weakest_q01"))
    units = picked.select("as_of", F.posexplode("unit").alias("_t", "_v")).groupBy("as_of", "_t").agg(F.avg("_v").alias("_v"))
    mean = units.groupBy("as_of").agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda s: s["_v"]).alias("_mean"))
    dates = space.select("as_of").distinct()
    wanted = codes.select("fund_code").distinct().withColumn("as_of", F.explode(dates.agg(F.array_sort(F.collect_set("as_of"))).scalar()))
    rows = wanted.join(inside, ["as_of", "fund_code"], "left").join(weakest, "as_of", "left").join(mean, "as_of", "left")
    in_pool, sel = F.col("q01").isNotNull(), F.coalesce("selected", F.lit(False))
    corr = F.when(in_pool & ~sel, _dot("unit", "_mean"))
    return rows.select(
        "as_of", "fund_code", in_pool.alias("in_pool"), sel.alias("selected"), "q01", "axes", corr.alias("avg_corr_to_selected"),
        (F.col("q01") - p.lam * corr).alias("greedy_score"), F.when(in_pool & ~sel, F.col("weakest")).alias("weakest"))


def funnel(universe: DataFrame, scored: DataFrame, space: DataFrame) -> DataFrame:
    """Counts of the stages per date."""
    n = universe.agg(F.count("*")).scalar()
    a = scored.groupBy("as_of").agg(F.count("*").alias("scored"))
    b = space.groupBy("as_of").agg(
        F.count("*").alias("aligned_pool"), F.max("common_days").alias("common_days"), F.max("total_days").alias("total_days"))
    return a.join(b, "as_of", "left").withColumn("universe", n).withColumn(
        "common_days_ratio", F.col("common_days") / F.col("total_days")).drop("total_days")


# ---- replay ---------------------------------------------------------------------------------------------------

def replay_holdings(picks: DataFrame, anchors: DataFrame, p: QualityParams, max_replace: int = 3) -> DataFrame:
    """(anchor, fund_code, slot, is_new): holdings after each anchor under limited replacement.

    A held fund stays while it is among the picks or the shortlist. Of the dropped ones at most
    max_replace leave, in their order, and take the places of new picks in rank order. The
    chain runs over one row per anchor.
    """
    lists = picks.groupBy("as_of").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "fund_code"))), lambda s: s["fund_code"]).alias("ranked"))
    rows = anchors.select(F.col("as_of")).join(lists, "as_of", "left")
    chain = rows.agg(F.array_sort(F.collect_list(F.struct("as_of", F.coalesce("ranked", F.array().cast("array<string>")).alias("ranked")))).alias("c"))
    none = F.array().cast("array<string>")
    first = F.lit(True)

    def step(state, a):
        held, ranked = state["held"], a["ranked"]
        dropped = F.slice(F.filter(held, lambda c: ~F.array_contains(ranked, c)), 1, max_replace)
        fresh = F.filter(ranked, lambda c: ~F.array_contains(held, c))
        swapped = F.filter(F.transform(held, lambda c: F.when(
            F.array_contains(dropped, c), F.get(fresh, (F.array_position(dropped, c) - 1).cast("int"))).otherwise(c)), lambda c: c.isNotNull())
        start = F.slice(ranked, 1, p.target)
        now = F.when(F.size(ranked) == 0, held).when(state["first"], start).otherwise(swapped)
        entry = F.struct(a["as_of"].alias("as_of"), now.alias("held"), F.array_except(now, held).alias("new"),
                         (F.size(ranked) > 0).alias("valid"))
        return F.struct(now.alias("held"), F.array_append(state["out"], entry).alias("out"),
                        (state["first"] & (F.size(ranked) == 0)).alias("first"))

    start = F.struct(none.alias("held"), F.array().cast("array<struct<as_of:date,held:array<string>,new:array<string>,valid:boolean>>").alias("out"), first.alias("first"))
    out = chain.select(F.explode(F.aggregate("c", start, step)["out"]).alias("o")).where("o.valid")
    return out.select(F.col("o.as_of").alias("as_of"), F.posexplode("o.held").alias("slot", "fund_code"), F.col("o.new").alias("_new")).withColumn(
        "is_new", F.array_contains("_new", F.col("fund_code"))).drop("_new")


def trailing_weights(held: DataFrame, nav: DataFrame, p: QualityParams, days: int = 3 * 365, least: int = 100) -> DataFrame:
    """Risk-parity weights at each anchor from the trailing three years; equal weights when too little is shared."""
    span = held.join(nav, "fund_code").where(F.col("trade_date").between(F.date_sub("as_of", days), F.col("as_of")))
    counts = span.groupBy("as_of", "fund_code").agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    valid = held.join(counts, ["as_of", "fund_code"])
    sizes = valid.groupBy("as_of").agg(F.count("*").alias("_k"))
    rows = span.join(counts.select("as_of", "fund_code"), ["as_of", "fund_code"])
    common = rows.groupBy("as_of", "trade_date").agg(F.count("*").alias("_c")).join(sizes, "as_of").where(F.col("_c") == F.col("_k"))
    series = rows.join(common.select("as_of", "trade_date"), ["as_of", "trade_date"]).groupBy("as_of", "fund_code", "slot").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "nav"))), lambda s: s["nav"]).alias("navs"))

    def solve(key, pdf):
        pdf = pdf.sort_values("slot")
        navs = np.vstack(pdf["navs"].to_numpy())
        out = pdf[["as_of", "fund_code"]].copy()
        if len(navs) < 2 or navs.shape[1] < least:
            return out.iloc[:0].assign(weight=pd.Series(dtype=float))
        out["weight"] = parity_weights(np.cov(np.diff(navs, axis=1) / navs[:, :-1]), p.cap)
        return out

    solved = series.groupBy("as_of").applyInPandas(solve, "as_of date, fund_code string, weight double")
    any_solved = solved.groupBy("as_of").agg(F.lit(True).alias("_ok"))
    equal = held.groupBy("as_of").agg((1.0 / F.count("*")).alias("_eq"))
    return held.join(solved, ["as_of", "fund_code"], "left").join(any_solved, "as_of", "left").join(equal, "as_of").withColumn(
        "weight", F.when(F.col("_ok"), F.coalesce("weight", F.lit(0.0))).otherwise(F.col("_eq"))).drop("_ok", "_eq")


def stitched_curve(weights: DataFrame, nav: DataFrame, anchors: DataFrame, end: str) -> DataFrame:
    """Segments [anchor, next anchor), each from 1 at its first shared day, chained by products."""
    order = Window.partitionBy(F.lit(0)).orderBy("as_of")  # the anchors
    spans = anchors.select("as_of", F.coalesce(F.lead("as_of").over(order), F.date_add(F.lit(end).cast("date"), 1)).alias("_next"))
    live = weights.where(F.col("weight") > 0).join(spans, "as_of")
    rows = live.join(nav, "fund_code").where((F.col("trade_date") >= F.col("as_of")) & (F.col("trade_date") < F.col("_next")))
    pos = rows.select("as_of", F.concat_ws("|", F.col("as_of").cast("string"), "fund_code").alias("fund_code"), "trade_date", "nav", "weight")
    curve = portfolio_curve(pos.select("as_of", "fund_code", "weight").distinct(), pos.select("fund_code", "trade_date", "nav"), ["as_of"])
    sizes = curve.groupBy("as_of").agg(F.count("*").alias("_n"), F.max_by("nav", "trade_date").alias("_last"))
    good = sizes.where(F.col("_n") >= 2)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chain = good.select("as_of", F.exp(F.coalesce(F.sum(F.log("_last")).over(before), F.lit(0.0))).alias("_k"))
    return curve.join(chain, "as_of").select("as_of", "trade_date", (F.col("nav") * F.col("_k")).alias("nav"))
