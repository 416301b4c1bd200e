"""Window helpers against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarryloom.functions.rolling import by_symbol, percent_rank, with_ema
from quarryloom.operators import regime as R


def test_ema_over_several_blocks(spark):
    random.seed(1)
    prices = [10 + random.random() for _ in range(2600)]
    rows = [("A", dt.date(2000, 1, 1) + dt.timedelta(days=i), p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, close double").withColumn("i", F.row_number().over(by_symbol()).cast("long"))
    got = [r.e for r in with_ema(df, {"e": ("close", 2 / 21)}).orderBy("bar_date").collect()]
    mean, expected = prices[0], []
    for k, p in enumerate(prices):
        mean = p if k == 0 else mean + 2 / 21 * (p - mean)
        expected.append(mean)
    assert max(abs(a - b) for a, b in zip(got, expected, strict=True)) < 1e-9


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "d int, x double")
    assert sorted((r.x or 99, r.p) for r in df.withColumn("p", percent_rank("x", "d")).collect()) == [(1.0, 25.0), (2.0, 62.5), (2.0, 62.5), (5.0, 100.0), (99, None)]


def fold(bars):
    state, low, rally, down, found, found_low = "up", float("inf"), 0, 0, -1, 0.0
    for i in range(1, len(bars)):
        pct = bars[i][0] / bars[i - 1][0] - 1
        if state == "up":
            if pct < -0.03:
                state, low, down = "fall", bars[i][1], 1
            elif pct < 0:
                down += 1
                if down >= 3:
                    state, low = "fall", min(b[1] for b in bars[max(0, i - 4) : i + 1])
            else:
                down = 0
        elif state == "fall":
            low = min(low, bars[i][1])
            if pct > 0:
                state, rally = "rally", i
        elif bars[i][1] < low:
            state, low = "fall", bars[i][1]
        elif i - rally >= 3 and pct >= 0.0125 and bars[i][2] > bars[i - 1][2]:
            state, down, found, found_low = "up", 0, i, low
    if found < 0:
        return (False, None, False)
    later = [b[1] for b in bars[found + 1 :]]
    return (True, len(bars) - 1 - found, not later or min(later) >= found_low)


def test_follow_through_matches_a_loop(spark):
    random.seed(5)
    close, rows = 100.0, []
    for i in range(400):
        close *= 1 + random.gauss(0, 0.015)
        rows.append(("MAIN", dt.date(2001, 1, 1) + dt.timedelta(days=i), close, close * (1 + random.random() / 90), close * (1 - random.random() / 90), random.randint(1, 10**6)))
    df = spark.createDataFrame(rows, "symbol string, bar_date date, close double, high double, low double, volume long")
    got = [(r.ftd_found, r.ftd_days_ago, r.ftd_valid) for r in R.follow_through(df).orderBy("bar_date").collect()]
    for i, found in enumerate(got):
        window = [(r[2], r[4], r[5]) for r in rows[max(0, i - 79) : i + 1]]
        assert found == (fold(window) if len(window) >= 10 else (False, None, False)), i


@pytest.mark.parametrize("score, name", [(70, "BULL"), (69.9, "UPTREND"), (54, "MIXED"), (25, "CAUTION"), (24.9, "DOWNTREND")])
def test_regime_bounds(spark, score, name):
    assert spark.range(1).select(R.regime_of(F.lit(float(score))).alias("r")).first().r == name
