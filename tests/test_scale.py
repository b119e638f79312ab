"""Helpers for groups of any size, weights and stores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.functions import stats as S
from navloom.operators import position as P
from navloom.operators import scale
from navloom.operators.filters import none_of, one_of
from navloom.sources import sinks as K


@pytest.mark.parametrize("n", [1, 2, 9, 500])
def test_median_is_exact_with_ties_and_nulls(spark, n):
    rng = np.random.default_rng(n)
    values = [float(v) for v in rng.integers(0, 7, n)]
    rows = [("a", v) for v in values] + [("b", v * 1.5 + 0.1) for v in rng.uniform(0, 1, n).tolist()] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in scale.exact_median(df, ["g"], "v").collect()}
    assert got["a"] == np.median(values)
    assert got["b"] == pytest.approx(np.median([v for g, v in rows if g == "b"]))


def test_numbers_run_through_the_buckets(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), F.col("id"), F.floor(F.col("id") / 7).alias("b"))
    got = {r.id: r.n for r in scale.numbered(df, ["k"], "b", [F.col("id")]).collect()}
    assert got == {i: i + 1 for i in range(50)}
    back = {r.id: r.n for r in scale.numbered(df, ["k"], "b", [F.desc("id")], descending=True).collect()}
    assert back == {i: 50 - i for i in range(50)}


def test_empty_lists_match_nothing(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert df.where(one_of("c", [])).count() == 0 and df.where(none_of("c", [])).count() == 0


def test_z_scores_of_flat_and_missing_values_are_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, None, 5.0), (1, 9.0, 5.0)], "g int, a double, b double")
    rows = S.robust_z(df, ["g"], ["a", "b"]).collect()
    a = np.array([1.0, 2.0, 9.0])
    want = np.clip((a - np.median(a)) / a.std(), -2, 2)
    assert sorted(r.z_a for r in rows) == pytest.approx(sorted([*want, 0.0]))
    assert all(r.z_b == 0 for r in rows)


def cap_twin(raw):
    w = np.array(raw) / np.sum(raw)
    for _ in range(10):
        c = np.clip(w, 0.03, 0.25)
        excess, free = w.sum() - c.sum(), (c > 0.03) & (c < 0.25)
        if abs(excess) < 1e-6 or c[free].sum() <= 0:
            w = c
            break
        w = c.copy()
        w[free] += excess * c[free] / c[free].sum()
    return w / w.sum()


def test_capped_weights_follow_the_rule(spark):
    rng = np.random.default_rng(1)
    cases = [rng.uniform(0.01, 1, n).tolist() for n in (5, 8, 12, 30)] + [[10.0] + [0.1] * 9]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw array<double>")
    for r in df.select("i", P.capped_weights(F.col("raw")).alias("w")).collect():
        assert np.allclose(r.w, cap_twin(cases[r.i]), atol=1e-12)


def test_weights_come_down_to_the_cap_and_stay_whole():
    exposure = np.array([[9.0, 1, 0, 0], [8, 0, 2, 0], [1, 5, 2, 2], [0, 3, 3, 4], [0, 1, 4, 5], [1, 2, 3, 4]])
    w = P.nearest_weights(exposure, 0.30)
    share = lambda x: (x @ exposure).max() / (x @ exposure).sum()
    assert w.sum() == pytest.approx(1.0) and w.min() >= 0.03 - 1e-9 and w.max() <= 0.25 + 1e-9
    assert share(w) < share(np.full(6, 1 / 6))


def test_stores_replace_only_what_arrives(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame([("2024Q1", "a", 1), ("2024Q2", "b", 2)], "quarter string, fund string, v int")
    K.replace_all(df, path, ["quarter"])
    K.replace_partitions(df.where("quarter = '2024Q2'").withColumn("v", F.lit(9)), path, ["quarter"])
    assert sorted((r.quarter, r.v) for r in spark.read.parquet(path).collect()) == [("2024Q1", 1), ("2024Q2", 9)]
    K.append(df, path, ["quarter"])
    assert spark.read.parquet(path).count() == 4


def test_new_fields_win_but_marked_rows_stay(spark):
    old = spark.createDataFrame([("1", "a", "x", 0), ("2", "b", "y", 1)], "k string, l1 string, em string, manual int")
    new = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "k string, l1 string")
    got = {r.k: (r.l1, r.em) for r in K.merge_fields(old, new, ["k"], protect="manual").collect()}
    assert got == {"1": ("A", "x"), "2": ("b", "y"), "3": ("C", None)}


def test_an_increment_touches_its_partitions_only(spark, tmp_path):
    path = tmp_path / "nav"
    df = spark.createDataFrame([("a", 2023, 1.0), ("a", 2024, 2.0), ("b", 2024, 3.0)], "k string, y int, v double")
    K.replace_all(df, str(path), ["y"])
    before = {f.name: f.stat().st_mtime_ns for f in (path / "y=2023").iterdir()}
    K.upsert_partitions(spark, spark.createDataFrame([("a", 2024, 9.0), ("c", 2024, 4.0)], df.schema), str(path), ["k"], "y")
    got = sorted((r.k, r.y, r.v) for r in spark.read.schema(df.schema).parquet(str(path)).collect())
    assert got == [("a", 2023, 1.0), ("a", 2024, 9.0), ("b", 2024, 3.0), ("c", 2024, 4.0)]
    assert before == {f.name: f.stat().st_mtime_ns for f in (path / "y=2023").iterdir()}
