"""Ranks, quarters and buckets of the validation reports against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.operators import validation as V

c = F.col


def test_ranks_with_ties_nulls_and_one_value(spark):
    values = [3.0, 1.0, 1.0, -7.5, 3.0, 3.0, 1e6, 2.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    held = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    found = {r.v: r["rank"] for r in V.ranks_of_values(held, "v", bins=4).collect()}
    assert found == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    one = spark.createDataFrame([(5.0, 3)], "v double, k long")
    assert V.ranks_of_values(one, "v").first()["rank"] == 2.0


def test_rank_sum_by_pairs(spark):
    rows = [(1.0, True), (2.0, False), (2.0, True), (3.0, True), (0.5, False), (None, True), (4.0, None)]
    row = V.rank_sum(spark.createDataFrame(rows, "x double, hit boolean"), "x", c("hit")).first()
    yes, no = [x for x, h in rows if h and x is not None], [x for x, h in rows if not h]
    u = sum((a > b) + 0.5 * (a == b) for a in yes for b in no)
    assert (row.n_true, row.n_false, row.u) == (len(yes), len(no), u)
    assert row.auc == pytest.approx(u / (len(yes) * len(no)), abs=1e-6)


def test_best_quarter_is_that_of_the_interpolated_percentile(spark):
    rng = np.random.default_rng(3)
    n = 61
    parts = {k: rng.integers(0, m + 1, n).astype(float) for k, m in (("base", 20), ("trend", 14), ("rs", 30), ("volume", 30))}
    y, y20 = rng.normal(0, 0.1, n), rng.uniform(-0.1, 0.2, n)
    rows = [(*(float(parts[k][i]) for k in parts), float(y20[i]), float(y20[i] / 2), float(y[i]), 0.05, None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "base_score double, trend_score double, rs_score double, volume_score double, max_gain_20d double, max_gain_10d double, realized double, stop_distance_pct double, days_to_breakout long, days_to_stop long")
    sub_max = {"base": 20.0, "trend": 14.0, "rs": 30.0, "volume": 30.0}
    for row in V.weight_objectives(df, sub_max, [(10, 20, 30, 40), (50, 10, 10, 30)]).collect():
        w = (row.w_base, row.w_trend, row.w_rs, row.w_volume)
        x = np.floor(sum(v * parts[k] / sub_max[k] for k, v in zip(parts, w, strict=True)) * 100 + 0.5)
        top = x >= np.percentile(x, 75)
        assert row.n_top == top.sum()
        assert row.win_rate == pytest.approx((y[top] > 0).mean(), abs=1e-4)
        assert row.peak_rate == pytest.approx((y20[top] >= V.PEAK_GAIN).mean(), abs=1e-4)
        assert row.corr_20d == pytest.approx(np.corrcoef(x, y20)[0, 1], abs=1e-4)
        assert row.sim_pf == pytest.approx(y[top][y[top] > 0].sum() / -y[top][y[top] < 0].sum(), abs=1e-3)


def test_buckets_closed_left_or_right(spark):
    df = spark.createDataFrame([(0.0,), (0.07,), (0.1,), (1.0,), (2.0,), (None,)], "v double")
    left, right, above = (df.select(f.alias("b")) for f in (V.bucket_from(c("v"), (0.0, 0.07, 0.1)), V.bucket_from(c("v"), (0.0, 0.07, 0.1), right=True), V.bucket_from(c("v"), (0.0, 0.1, 1.0), open_above=True)))
    assert [r.b for r in left.collect()] == [0.0, 0.07, None, None, None, None]
    assert [r.b for r in right.collect()] == [None, 0.0, 0.07, None, None, None]
    assert [r.b for r in above.collect()] == [0.0, 0.0, 0.1, 1.0, 1.0, None]
