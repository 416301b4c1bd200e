"""Hits over all later bars, exact slopes, Hurst exponents and days to earnings against loops."""

import datetime
import random

import numpy as np
import pytest

from quarryloom.functions.rolling import whole_slope
from quarryloom.operators import outcomes as O, regime as R, scoring as S

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def test_live_outcomes_see_every_later_bar(spark):
    rng, bars = random.Random(3), []
    for symbol, n in (("A", 300), ("B", 64), ("C", 65), ("D", 1)):
        close = 50.0
        for i in range(n):
            close *= 1 + rng.uniform(-0.03, 0.03)
            bars.append((symbol, day(i), close, close * 1.02, close * 0.98, close))
    signals = [(s, d, x, x * 1.15, x * 0.9, None if i % 5 == 0 else x * 1.3) for i, (s, d, _, _, _, x) in enumerate(bars) if i % 7 == 0]
    frame = spark.createDataFrame(bars, "symbol string, bar_date date, open double, high double, low double, close double")
    got = {(r.symbol, r.scan_date): r for r in O.live_outcomes(spark.createDataFrame(signals, "symbol string, scan_date date, price double, breakout_level double, stop_level double, target_level double"), frame).collect()}
    late = 0
    for symbol, scan, price, breakout, stop, target in signals:
        later = [b for b in bars if b[0] == symbol and b[1] > scan]
        if not later:
            assert (symbol, scan) not in got
            continue
        hit = lambda test: next((n for n, b in enumerate(later, 1) if test(b)), None)  # noqa: B023, E731
        expected = (hit(lambda b: b[5] >= breakout), hit(lambda b: b[4] <= stop), hit(lambda b: target is not None and b[3] >= target), len(later))  # noqa: B023
        r = got[symbol, scan]
        assert (r.days_to_breakout, r.days_to_stop, r.days_to_target, r.days_elapsed) == expected
        assert r.pct_change == pytest.approx(later[-1][5] / price - 1)
        late += any(n is not None and n > 60 for n in expected[:3])
    assert late > 3


def test_a_true_zero_slope_is_zero(spark):
    rng = random.Random(1)
    half = [rng.randrange(10**9) for _ in range(5)]
    values = half + half[::-1] + [rng.randrange(10**9) for _ in range(30)]
    rows = spark.createDataFrame([("A", day(i), i + 1, v) for i, v in enumerate(values)], "symbol string, bar_date date, i long, volume long")
    got = [r.s for r in rows.withColumn("s", whole_slope("volume", 10)).orderBy("i").select("s").collect()]
    assert got[0] is None and got[9] == 0.0
    for i in range(1, 40):
        part = values[max(0, i - 9) : i + 1]
        assert got[i] == pytest.approx(np.polyfit(np.arange(len(part)), part, 1)[0], rel=1e-9, abs=1e-5)


def test_hurst_of_few_and_many_closes(spark):
    close = (50 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 200)))).tolist()
    rows = spark.createDataFrame([("MAIN", day(i), x, i + 1) for i, x in enumerate(close)], "symbol string, bar_date date, close double, i long")
    got = [r.hurst for r in R.with_hurst(rows).orderBy("i").select("hurst").collect()]
    assert got[0] == got[28] == 0.5
    for n in (30, 44, 100, 149, 150, 200):
        logs = np.log(close[max(0, n - 150) : n])
        lags = np.unique(np.logspace(np.log10(2), np.log10(len(logs) // 3), 25).astype(int))
        slope = np.polyfit(np.log(lags), [np.log(np.var(logs[k:] - logs[:-k])) for k in lags], 1)[0]
        assert got[n - 1] == pytest.approx(min(max(slope / 2, 0), 1), abs=1e-9)


def test_days_to_the_next_earnings(spark):
    bars = spark.createDataFrame([(s, day(i)) for s in "AB" for i in range(0, 30, 3)], "symbol string, bar_date date")
    dates = spark.createDataFrame([("A", day(7)), ("A", day(7)), ("A", day(21)), ("C", day(2))], "symbol string, earnings_date date")
    got = {(r.symbol, (r.bar_date - DAY).days): r.days_to_earnings for r in S.days_to_earnings(bars, dates).collect()}
    assert len(got) == 20 and got["A", 0] == 7 and got["A", 9] == 12 and got["A", 21] == 0 and got["A", 24] is None and got["B", 0] is None
