"""Positions from a ledger, booking of trades, performance of held portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from navloom.functions import scalars as X
from navloom.operators.joins import asof
from navloom.operators.scale import chunked
from navloom.operators.windows import latest
from navloom.session import cut_lineage

KEY = ["portfolio_id", "fund_code"]
ID_BAND = 50_000


def book_trades(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """Locks the unit value on or before the trade date and turns amounts into shares.

    Without a positive value, or with the value of that row missing, both stay null.
    """
    hit = asof(trades, nav.select("fund_code", "trade_date", "nav"), ["nav"], suffix_date="nav_date")
    return hit.withColumn("shares", F.when(F.col("nav") > 0, F.col("amount") / F.col("nav")))


def transfer_legs(transfers: DataFrame) -> DataFrame:
    """Each transfer as a sell and a buy that share an id derived from the row; one-sided rows stay single."""
    tid = F.sha2(F.concat_ws("|", "portfolio_id", "row_id", "from_code", "to_code", "trade_date"), 256)
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    both = has("from_code") & has("to_code")
    leg = lambda kind, code: F.struct(F.lit(kind).alias("txn_type"), F.trim(code).alias("fund_code"))
    legs = F.array_compact(F.array(
        F.when(has("from_code"), leg("sell", "from_code")), F.when(has("to_code"), leg("buy", "to_code"))))
    return (
        transfers.where(F.coalesce("amount", F.lit(0.0)) > 0)
        .withColumn("transfer_id", F.when(both, F.substring(tid, 1, 32)))
        .withColumn("_leg", F.explode(legs))
        .select("portfolio_id", "row_id", "trade_date", "amount", "transfer_id", "_leg.txn_type", "_leg.fund_code")
    )


def delete_with_legs(txns: DataFrame, ids: DataFrame) -> DataFrame:
    """Deletes trades; a leg of a transfer takes the other leg with it."""
    doomed = txns.join(ids, "id", "left_semi")
    transfers = doomed.where(F.col("transfer_id").isNotNull()).select("transfer_id").distinct()
    return txns.join(ids, "id", "left_anti").join(transfers, "transfer_id", "left_anti")


def transfer_rows(txns: DataFrame) -> DataFrame:
    """The two legs of a transfer as one row, other trades as they are."""
    group = F.coalesce("transfer_id", F.col("id").cast("string"))
    pick = lambda kind, c: F.max(F.when(F.col("txn_type") == kind, F.col(c)))
    return txns.groupBy(group.alias("row_key")).agg(
        F.min("trade_date").alias("trade_date"), F.max("amount").alias("amount"),
        pick("sell", "fund_code").alias("from_code"), pick("buy", "fund_code").alias("to_code"), F.count("*").alias("legs"))


def freeze_base_shares(snaps: DataFrame, nav: DataFrame) -> DataFrame:
    """First positions without shares get them from the newest unit value."""
    last = latest(nav.where(F.col("nav").isNotNull()), ["fund_code"], "trade_date", ["nav", "trade_date"])
    last = last.select("fund_code", F.col("nav").alias("_nav"))
    derived = F.when((F.col("market_value") > 0) & (F.col("_nav") > 0), F.col("market_value") / F.col("_nav"))
    return snaps.join(last, "fund_code", "left").withColumn("base_shares", F.coalesce("base_shares", derived)).drop("_nav")


def _events():
    """Trades of one chunk in order, as an array of bounded length."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct("trade_date", "id", "buy", "shares", "amount"))),
        lambda e: F.struct(e["buy"].alias("buy"), e["shares"].alias("shares"), e["amount"].alias("amount")))


def positions(snaps: DataFrame, txns: DataFrame, nav: DataFrame, rows_per_chunk: int = 50_000) -> DataFrame:
    """Held shares, cost and profit per (portfolio, fund) at moving-average cost.

    Selling caps at the shares held, so the running share count is max(0, held + change): chunks
    of a ledger combine by (sum of changes, floor). With the opening shares of every chunk
    known, its effect on cost is affine (cost -> keep * cost + added). Both combine over the
    few chunks of a ledger, so a ledger of any length is folded in parallel.

    A ledger is in share mode when its first position (if any) has shares and all its trades
    do; otherwise, or without a newest value, amounts are added up.
    """
    snaps = freeze_base_shares(snaps, nav).select(
        *KEY, F.lit(True).alias("has_snap"), "base_shares", F.col("cost").alias("base_cost"),
        F.coalesce("market_value", F.lit(0.0)).alias("base_mv"))
    buy = F.col("txn_type") == "buy"
    trades = cut_lineage(txns.select(*KEY, "id", "trade_date", "amount", "shares", buy.alias("buy")))
    buy = F.col("buy")
    totals = trades.groupBy(*KEY).agg(
        F.sum(F.when(buy, F.col("amount")).otherwise(0.0)).alias("bought"),
        F.sum(F.when(~buy, F.col("amount")).otherwise(0.0)).alias("sold"),
        F.bool_and(F.col("shares").isNotNull()).alias("all_shares"))
    frame = totals.join(snaps, KEY, "full_outer")
    for c in ("bought", "sold", "base_mv"):
        frame = frame.withColumn(c, F.coalesce(c, F.lit(0.0)))
    frame = (
        frame.withColumn("has_snap", F.coalesce("has_snap", F.lit(False)))
        .withColumn("share_mode", (~F.col("has_snap") | F.col("base_shares").isNotNull()) & F.coalesce("all_shares", F.lit(True)))
        .withColumn("cost0", F.coalesce("base_cost", "base_mv"))
    )

    # a granule is a day and a band of ids, so even one day of one ledger is split
    banded = trades.withColumn("_band", F.floor(F.col("id") / ID_BAND))
    ordered = chunked(banded, KEY, ["trade_date", "_band"], rows_per_chunk).groupBy(*KEY, "chunk").agg(_events().alias("events"))
    floor0 = F.lit(float("-inf"))

    def share_step(a, e):
        d = F.when(e["buy"], e["shares"]).otherwise(-e["shares"])
        floor = F.when(e["buy"], a["floor"] + d).otherwise(F.greatest(a["floor"] + d, F.lit(0.0)))
        return F.struct((a["move"] + d).alias("move"), floor.alias("floor"))

    summary = ordered.select(*KEY, "chunk", F.aggregate(
        "events", F.struct(F.lit(0.0).alias("move"), floor0.alias("floor")), share_step).alias("s"))
    # the chunks of a ledger: rows / rows_per_chunk of them
    earlier = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_moved", F.sum("s.move").over(upto)).withColumn("_lift", F.col("s.floor") - F.col("_moved"))
    opening = summary.select(
        *KEY, "chunk", F.coalesce(F.sum("s.move").over(earlier), F.lit(0.0)).alias("_before"),
        F.coalesce(F.max("_lift").over(earlier), floor0).alias("_floor")
    ).join(frame.select(*KEY, F.coalesce("base_shares", F.lit(0.0)).alias("_x0")), KEY).select(
        *KEY, "chunk", (F.col("_before") + F.greatest(F.col("_x0"), F.col("_floor"))).alias("open_shares"))

    def cost_step(a, e):
        left = F.greatest(a["held"] - e["shares"], F.lit(0.0))
        live = ~e["buy"] & (a["held"] > 0)
        ratio = F.when(live, left / a["held"]).otherwise(F.lit(1.0))
        return F.struct(
            F.when(e["buy"], a["held"] + e["shares"]).when(live, left).otherwise(a["held"]).alias("held"),
            (a["keep"] * ratio).alias("keep"),
            F.when(e["buy"], a["added"] + e["amount"]).otherwise(a["added"] * ratio).alias("added"),
            (a["proceeds"] + F.when(live, e["amount"]).otherwise(F.lit(0.0))).alias("proceeds"))

    zero = F.lit(0.0)
    folded = ordered.join(opening, [*KEY, "chunk"]).select(*KEY, "chunk", F.aggregate(
        "events", F.struct(F.col("open_shares").alias("held"), F.lit(1.0).alias("keep"), zero.alias("added"), zero.alias("proceeds")),
        cost_step).alias("s"))
    chain = folded.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("chain"))
    ends = chain.join(frame.select(*KEY, "cost0"), KEY).select(*KEY, F.aggregate(
        "chain", F.struct(F.col("cost0").alias("cost"), zero.alias("proceeds"), zero.alias("held")),
        lambda a, c: F.struct(
            (a["cost"] * c["s"]["keep"] + c["s"]["added"]).alias("cost"),
            (a["proceeds"] + c["s"]["proceeds"]).alias("proceeds"), c["s"]["held"].alias("held"))).alias("e"))

    last = latest(nav.where(F.col("nav").isNotNull()), ["fund_code"], "trade_date", ["nav", "trade_date"]).select(
        "fund_code", F.col("nav").alias("latest_nav"), F.col("trade_date").alias("nav_date"))
    out = frame.join(ends, KEY, "left").join(last, "fund_code", "left")
    ok = F.col("share_mode") & F.col("latest_nav").isNotNull()
    held = F.coalesce("e.held", "base_shares", zero)
    cost = F.coalesce("e.cost", "cost0")
    realised = F.coalesce("e.proceeds", zero) + cost - F.col("cost0") - F.col("bought")
    mv = F.when(ok, held * F.col("latest_nav")).otherwise(F.col("base_mv") + F.col("bought") - F.col("sold"))
    final_cost = F.when(ok, cost).otherwise(F.col("cost0") + F.col("bought") - F.col("sold"))
    return out.select(
        *KEY, mv.alias("market_value"), final_cost.alias("cost"), F.when(ok, held).alias("shares"),
        F.when(ok, F.col("latest_nav")).alias("latest_nav"), F.when(ok, F.col("nav_date")).alias("nav_date"),
        F.when(ok, realised + mv - cost).otherwise(mv - final_cost).alias("pnl"),
        (F.col("cost0") + F.col("bought")).alias("total_invested"), ok.alias("valuation_ok"))


def portfolio_weights(held: DataFrame) -> DataFrame:
    """Weight of every fund with value in its portfolio."""
    live = held.where(F.col("market_value") > 0)
    totals = live.groupBy("portfolio_id").agg(F.sum("market_value").alias("_total"))
    return live.join(totals, "portfolio_id").withColumn("weight", F.col("market_value") / F.col("_total")).drop("_total")


def account_totals(held: DataFrame, group: str) -> DataFrame:
    """Value, cost, profit and invested money per group and per portfolio (group null)."""
    return held.groupingSets([["portfolio_id", group], ["portfolio_id"]], "portfolio_id", group).agg(
        F.count("*").alias("funds"), F.sum("market_value").alias("market_value"), F.sum("cost").alias("cost"),
        F.sum("pnl").alias("pnl"), F.sum("total_invested").alias("total_invested"), F.grouping(group).cast("int").alias("is_total"))


def display_list(held: DataFrame, targets: DataFrame) -> DataFrame:
    """Held funds and missing target funds (as zero rows), with the sort rank of the list.

    Live rows first, then by theme sequence, then by value.
    """
    with_seq = held.join(targets.select("portfolio_id", "fund_code", "seq"), KEY, "left").withColumn("is_phantom", F.lit(False))
    missing = targets.join(held.select(*KEY), KEY, "left_anti").select(
        *KEY, "seq", F.lit(0.0).alias("market_value"), F.lit(True).alias("is_phantom"))
    rows = with_seq.select(*KEY, "seq", "market_value", "is_phantom").unionByName(missing)
    order = F.struct(
        F.when(F.col("market_value") <= 0.005, 1).otherwise(0).alias("cleared"),
        F.coalesce("seq", F.lit(2**31 - 1)).alias("seq"), (-F.col("market_value")).alias("value"), "fund_code")
    return rows.withColumn("sort_key", order)


def portfolio_curve(weights: DataFrame, series: DataFrame, by: list[str], value: str = "nav") -> DataFrame:
    """Weighted curve from 1.0 on the dates all members share, with its drawdown.

    weights: by + fund_code, weight (positive); series: fund_code, trade_date, value.
    """
    from navloom.operators.joins import common_dates
    from navloom.operators.windows import drawdown, rebase

    live = weights.where(F.col("weight") > 0)
    rows = common_dates(live.select(*by, "fund_code", "weight"), series.select("fund_code", "trade_date", value), by)
    rows = rebase(rows, [*by, "fund_code"], value=value)
    curve = rows.groupBy(*by, "trade_date").agg(
        (F.sum(F.col("rel") * F.col("weight")) / F.sum("weight")).alias("nav"))
    return drawdown(curve, by)
