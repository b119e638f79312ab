"""StructTypes of the fund tables, and typed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

TEXT, REAL, DAY, INT, LONG, FLAG = (
    T.StringType(), T.DoubleType(), T.DateType(), T.IntegerType(), T.LongType(), T.BooleanType())
WORDS = T.ArrayType(TEXT)


def _row(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CONDITION = _row(field=TEXT, op=TEXT, value=REAL)
FILTERS = _row(keyword=TEXT, name_contains=TEXT, fund_types=WORDS, exclude_codes=WORDS, name_excludes=WORDS,
               conditions=T.ArrayType(CONDITION))

SCHEMAS = {
    "funds": _row(code=TEXT, name=TEXT, type=TEXT, fund_type=TEXT),
    "fund_types": _row(type_name=TEXT, category=TEXT),
    "fund_details": _row(
        fund_code=TEXT, fund_name=TEXT, fund_company=TEXT, scale=REAL, establish_date=DAY, position_stock=REAL,
        sharpe_3y=REAL, risk_return_ratio_3y=REAL, max_drawdown_3y=REAL),
    "fund_holdings": _row(
        fund_code=TEXT, quarter=TEXT, holding_type=TEXT, asset_code=TEXT, asset_name=TEXT, hold_ratio=REAL,
        hold_amount=REAL, hold_market_value=REAL),
    "fund_nav": _row(fund_code=TEXT, trade_date=DAY, nav=REAL, acc_nav=REAL, daily_return=REAL),
    "fund_cum_return": _row(fund_code=TEXT, trade_date=DAY, cum_return=REAL),
    "fund_manager_tenure": _row(
        fund_code=TEXT, seq=INT, start_date=DAY, end_date=DAY, is_current=FLAG, managers=TEXT, tenure_text=TEXT,
        tenure_days=INT, tenure_return=REAL),
    "stock_industry": _row(
        stock_code=TEXT, stock_name=TEXT, market=TEXT, sw_l1=TEXT, sw_l2=TEXT, sw_l3=TEXT, em_industry=TEXT,
        source=TEXT, manual=INT),
    "trade_dates": _row(trade_date=DAY),
    "query_presets": _row(preset_id=INT, filters=FILTERS),
    "fund_snapshots": _row(preset_id=INT, items_json=TEXT),
    "user_holdings": _row(
        portfolio_id=LONG, fund_code=TEXT, fund_name=TEXT, market_value=REAL, cost=REAL, base_shares=REAL, base_date=DAY),
    "holding_txns": _row(
        id=LONG, portfolio_id=LONG, fund_code=TEXT, fund_name=TEXT, txn_type=TEXT, trade_date=DAY, amount=REAL,
        nav=REAL, shares=REAL, transfer_id=TEXT),
    "fund_ai_analysis": _row(
        fund_code=TEXT, luck_verdict=TEXT, concentration=TEXT, fund_kind=TEXT, recommend=INT, skill_score=INT,
        rating=INT, tags=WORDS),
}

NAV_PAGE = _row(
    Data=_row(
        LSJZList=T.ArrayType(_row(FSRQ=TEXT, DWJZ=TEXT, LJJZ=TEXT, JZZZL=TEXT, ACTUALSYI=TEXT)), TotalCount=INT),
    ErrCode=TEXT, TotalCount=INT)
