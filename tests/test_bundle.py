"""The holdings of a fund's record."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.operators import bundle as B
from navloom.operators import holdings as O

HELD = "fund_code string, quarter string, holding_type string, asset_code string, asset_name string, hold_ratio double"


def sources(spark):
    rows = [(f"00000{f}", f"2001Q{q}", "stock" if a % 9 else "bond", f"{a:06d}", f"stock {a}", float(1 + (a * 7 + q + f) % 23))
            for f in range(3) for q in (1, 2, 3) for a in range(20 if q == 2 else 6)]
    industry = [(f"{a:06d}", ("电子", "银行", "")[a % 3], "", "", "") for a in range(15)]
    return rows, spark.createDataFrame(rows, HELD), spark.createDataFrame(
        industry, "stock_code string, sw_l1 string, sw_l2 string, sw_l3 string, em_industry string")


def test_stocks_are_counted_beside_the_ten_largest(spark):
    rows, held, industry = sources(spark)
    got = {(r.fund_code, r.quarter): (r.num_stock, r.is_full_report, len(r.codes_top10))
           for r in O.quarter_profile(held, industry).collect()}
    counts = {}
    for f, q, kind, *_ in rows:
        counts[f, q] = counts.get((f, q), 0) + (kind == "stock")
    assert got == {k: (n, n > 15, min(n, 10)) for k, n in counts.items()}


def test_the_record_makes_the_holdings_once(spark):
    rows, held, industry = sources(spark)
    made = spark.sparkContext.accumulator(0)

    def count(ratio):
        made.add(1)
        return ratio

    seen = held.withColumn("hold_ratio", F.udf(count, "double").asNondeterministic()("hold_ratio"))
    got = B.holdings_record(seen, industry).select("fund_code", F.size("quarters_detail").alias("n")).collect()
    assert sorted((r.fund_code, r.n) for r in got) == [(f"00000{f}", 3) for f in range(3)]
    assert made.value <= len(rows)
