"""Trades entered on a symbol's last bar stay in every exit."""

import datetime as dt

from quarryloom.operators import outcomes as O, reports as P, research as R


def test_a_trade_without_later_bars_is_kept(spark):
    day = lambda k: dt.date(2024, 1, k)
    bars = spark.createDataFrame([("A", day(k), 10.0, 10.3, 9.9, 10.2, 100) for k in range(1, 6)], "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    signals = spark.createDataFrame([("A", day(2), 0.3), ("A", day(4), 0.3)], "symbol string, scan_date date, atr double")
    trades = O.entries(signals, bars)
    for exits in (O.exit_fixed_r(trades, bars, 2.0), O.exit_time(trades, bars), O.exit_atr_trail(trades, bars)):
        got = {r.scan_date: r for r in exits.collect()}
        assert set(got) == {day(2), day(4)} and got[day(2)].bars_held == 2
        last = got[day(4)]
        assert (last.bars_held, last.exit_reason, last.exit_date, last.r_multiple) == (0, "no_data", day(5), 0.0)
        assert abs(last.exit_price - 10.01) < 1e-9
    path = {r.scan_date: r for r in P.trade_paths(trades, bars).collect()}[day(4)]
    assert (path.bars_held, path.exit_reason, path.exit_date) == (0, "eod", day(5))
    assert abs(path.r_multiple - (10.2 * 0.999 - 10.01) / (10.01 - 10.01 * 0.98)) < 1e-9
    assert {r.n for r in R.exit_sweep(trades, bars).collect()} == {2}
