"""Trailing statistics of value series against Spark's sliding frames."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navloom.operators import windows as W

DAY = dt.date(2024, 1, 1)


def points():
    draw = random.Random(14)
    rows = [("a", DAY + dt.timedelta(days=k), 1.1 if 90 < k < 160 else draw.uniform(0.9, 1.2)) for k in range(200)]
    rows += [("b", DAY + dt.timedelta(days=k), None if k % 3 == 0 else 1.0 + k / 7) for k in range(130)]
    rows += [("c", DAY + dt.timedelta(days=k), None) for k in range(25)] + [("d", DAY, 2.0)]
    rows += [(None, DAY + dt.timedelta(days=k), draw.uniform(0.9, 1.2)) for k in range(70)]
    draw.shuffle(rows)
    return rows


def test_trailing_statistics_equal_sliding_frames(spark):
    order = Window.partitionBy("fund_code").orderBy("trade_date")
    rows = spark.createDataFrame(points(), "fund_code string, trade_date date, value double").withColumn("i", F.row_number().over(order))
    got = W.with_trailing(rows, ["fund_code"], "i", {"x": ("value", 60, True), "y": ("value", 20, False)})
    last = lambda n: order.rowsBetween(1 - n, 0)
    want = rows.select("*", F.count("value").over(last(60)).cast("double"), F.avg("value").over(last(60)), F.stddev_pop("value").over(last(60)),
                       F.count("value").over(last(20)).cast("double"), F.avg("value").over(last(20)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_factors_take_up_a_row_once(spark):
    """No frame that slides over the rows before: it takes up sixty rows at every row."""
    rows = W.factors(spark.createDataFrame(points(), "fund_code string, trade_date date, value double"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "-59" not in plan and "-19)" not in plan
    assert rows.count() == len(points())
    risk = {r.i: r.risk_adj_raw for r in rows.where("fund_code = 'a'").collect()}
    assert risk[20] is None and risk[21] is not None and risk[157] is None  # constant returns have no deviation
