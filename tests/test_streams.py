"""Streams over several files, and keys beyond six digits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from navloom.plans import ingest
from navloom.sources.adapters import code6
from navloom.streaming import jobs as J

SCHEMA = ("portfolio_id bigint, fund_code string, id bigint, txn_type string, trade_date string, amount double,"
          " shares double")


def folded(trades):
    """Moving-average cost by one plain loop in the order of date and id."""
    out = {}
    for p, c, _, kind, _, amount, n in sorted(trades, key=lambda t: (t[4], t[2])):
        shares, cost, realised, invested = out.get((p, c), (0.0, 0.0, 0.0, 0.0))
        if kind == "buy":
            shares, cost, invested = shares + n, cost + amount, invested + amount
        elif shares > 0:
            part = cost * min(n, shares) / shares
            shares, cost, realised = shares - min(n, shares), cost - part, realised + amount - part
        out[p, c] = (shares, cost, realised, invested)
    return out


def test_positions_are_the_same_however_trades_arrive(spark, tmp_path):
    draw = random.Random(3)
    trades = [(1 + i % 2, f"00000{i % 3}", i, draw.choice(("buy", "buy", "sell")), f"2024-01-{1 + draw.randrange(28):02d}",
               float(draw.randint(50, 500)), float(draw.randint(1, 40))) for i in range(60)]
    draw.shuffle(trades)
    folder = tmp_path / "in"
    parts = [trades[i::6] for i in range(6)]
    parts[5] += parts[0][:3]  # delivered twice
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"f{n}"))
    stream = J.read_files(spark, f"{folder}/*", "*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    rows = str(tmp_path / "rows")
    J.live_positions(stream, str(tmp_path / "log"), rows, str(tmp_path / "state"))
    got = {(r.portfolio_id, r.fund_code): (r.shares, r.cost, r.realised, r.invested)
           for r in J.current_rows(spark, rows, ["portfolio_id", "fund_code"]).collect()}
    want = folded(trades)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    assert spark.read.parquet(rows).select("batch").distinct().count() == 6


def test_two_buys_newest_first(spark, tmp_path):
    for n, day in enumerate(("2024-01-02", "2024-01-01")):
        spark.createDataFrame([(1, "a", 5 - n, "buy", day, 100.0, 10.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = J.read_files(spark, f"{tmp_path}/in/*", "*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    J.live_positions(stream, str(tmp_path / "log"), str(tmp_path / "rows"), str(tmp_path / "state"))
    assert J.current_rows(spark, str(tmp_path / "rows"), ["portfolio_id", "fund_code"]).first().shares == 20.0


def test_keys_beyond_six_digits_stay_apart(spark):
    df = spark.createDataFrame([(7,), (123456,), (1000000,), (1000009,)], "k long")
    assert [r.c for r in df.select(code6("k").alias("c")).collect()] == ["000007", "123456", "1000000", "1000009"]
    assert df.select(code6(F.col("k") % 1000).alias("c")).first().c == "000007"


def test_late_rows_are_named_and_repeats_are_dropped(spark, tmp_path):
    """Four files in this order; each batch's limit is the newest day of the batches before it, less seven days."""
    files = [[("a", 10, 1), ("b", 2, 2), ("a", 10, 3)],  # nothing is late in the first batch
             [("a", 10, 4), ("c", 3, 5), ("d", 2, 6), ("b", 2, 7)],  # limit 3: c is not late, d and the repeat of b are
             [("e", 30, 8), ("f", 4, 9), ("f", 4, 10)],  # limit still 3: f waits beside the newest of its own batch
             [("g", 22, 11), ("h", 23, 12), ("f", 4, 13), ("e", 30, 14)]]  # limit 23
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    schema = "k string, ts timestamp, n int"
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(k, day(d), n) for k, d, n in rows], "k string, t string, n int")
        df.select("k", F.to_timestamp("t").alias("ts"), "n").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = J.read_files(spark, f"{tmp_path}/in/*", "*.parquet", spark.createDataFrame([], schema).schema, files_per_batch=1)
    J.first_or_late(stream, ["k", "ts"], "ts", str(tmp_path / "out"), str(tmp_path / "state"))
    got = lambda name: sorted((r.k, r.n, r.batch) for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect())
    assert got("late") == [("b", 7, 1), ("d", 6, 1), ("f", 13, 3), ("g", 11, 3)]
    assert got("first") == [("a", 1, 0), ("b", 2, 0), ("c", 5, 1), ("e", 8, 2), ("f", 9, 2), ("h", 12, 3)]


def test_a_year_of_increments_lands_in_several_files(spark, tmp_path, monkeypatch):
    days = "explode(sequence(date'1995-01-01', date'1997-12-31', interval 1 day))"
    lines = spark.range(2).selectExpr("id + 1 as l_suppkey", f"{days} as l_shipdate")
    lines.unionByName(lines.limit(50)).write.parquet(f"{tmp_path}/lineitem.parquet")
    landed, plain = {}, J.read_files

    def read(session, folder, *rest, **more):
        for year in (1995, 1996, 1997):
            landed[year] = session.read.parquet(f"{folder[:-2]}/{year}").select(F.input_file_name()).distinct().count()
        return plain(session, folder, *rest, **more)

    monkeypatch.setattr(J, "read_files", read)
    monkeypatch.setattr(ingest, "FILE_ROWS", 300, raising=False)
    got = ingest.stream_first_values(spark, str(tmp_path)).collect()
    assert landed == {1995: 3, 1996: 3, 1997: 3}
    assert len({(r.fund_code, r.trade_date) for r in got}) == len(got) == 2 * 1096 and sum(r.n for r in got) == 2 * 1096 + 50
