"""Paper trades through all their days against a loop over days, and examples as of the business day before."""

import datetime as dt

import numpy as np
import pytest

from quarryloom.operators import research as Q, trading as T

DAY = dt.date(2024, 1, 1)  # a Monday


def walked(bars, at, level):
    """One trade, a run after each day's close."""
    state = {"status": "submitted", "entry": None, "reason": None, "exit": None}
    placed = False
    for k in range(at + 1, len(bars)):
        o, low, close = bars[k]
        if state["status"] == "submitted":
            state |= {"status": "open", "entry": o}
        elif state["status"] == "exiting":
            return state | {"status": "closed", "exit": o}
        elif placed and low <= level:
            return state | {"status": "closed", "exit": min(o, level), "reason": "stop_order"}
        placed = state["entry"] > level
        mean = np.mean([b[2] for b in bars[k - 9 : k + 1]]) if k >= 9 else None
        if close <= level:
            state |= {"status": "exiting", "reason": "stop_cross"}
        elif mean is not None and close < mean:
            state |= {"status": "exiting", "reason": "ma_cross"}
    return state


def test_trades_through_all_their_days(spark):
    rng, bars, trades = np.random.default_rng(6), {}, []
    for s in "ABCDEFGH":
        price, rows = 100.0, []
        for _ in range(40):
            o = price * (1 + rng.normal(0, 0.01))
            price = o * (1 + rng.normal(0.002, 0.02))
            rows.append((round(o, 2), round(min(o, price) * (1 - abs(rng.normal(0, 0.01))), 2), round(price, 2)))
        bars[s] = rows
        trades += [(s, k, round(rows[k][2] * m, 2)) for k in (0, 3, 12, 25, 37, 38, 39) for m in (0.9, 0.97, 1.05)][:: 2 if s > "D" else 1]
    bars["R"] = [(100.0 + k, 99.5 + k, 100.5 + k) for k in range(40)]  # rises to the end
    trades.append(("R", 30, 90.0))
    day = lambda k: DAY + dt.timedelta(days=int(k))
    frame = spark.createDataFrame([(s, day(k), *b) for s, rows in bars.items() for k, b in enumerate(rows)], "symbol string, bar_date date, open double, low double, close double")
    trades = {(s, k): level for s, k, level in trades}  # one for each symbol and day
    found = T.lifecycle(spark.createDataFrame([(s, day(k), level, 10) for (s, k), level in trades.items()], "symbol string, scan_date date, stop_level double, shares int"), frame).collect()
    assert len(found) == len(trades)
    for r in found:
        k = (r["scan_date"] - DAY).days
        want = walked(bars[r["symbol"]], k, trades[r["symbol"], k])
        assert (r["status"], r["entry_price"], r["exit_reason"], r["exit_price"]) == (want["status"], want["entry"], want["reason"], want["exit"])
        if want["status"] == "closed":
            assert r["pnl_dollars"] == pytest.approx(10 * (want["exit"] - want["entry"])) and r["pnl_pct"] == pytest.approx(want["exit"] / want["entry"] - 1)
        else:
            assert r["pnl_pct"] is None
    assert {r["status"] for r in found} == {"submitted", "open", "exiting", "closed"} and {r["exit_reason"] for r in found} == {None, "stop_order", "stop_cross", "ma_cross"}


def test_examples_are_scored_on_the_business_day_before(spark):
    day = lambda k: DAY + dt.timedelta(days=k)
    scored = spark.createDataFrame([("A", day(k), float(k)) for k in (3, 4, 8, 9)] + [("B", day(20), 1.0)], "symbol string, bar_date date, raw_score double")
    # Breakouts on Monday 8 (Friday 4), Saturday 6 and Sunday 7 (Friday 4), Friday 5 (Thursday 3), Thursday 11 (Wednesday 10: as of 9), 3 (none before).
    examples = [("A", day(k)) for k in (7, 5, 6, 4, 10, 3)] + [("B", day(10)), ("B", day(30)), ("B", day(30)), ("C", day(9))]
    found = Q.training_examples(spark.createDataFrame(examples, "symbol string, breakout_date date"), scored, ("raw_score",)).collect()
    got = sorted((r["symbol"], (r["breakout_date"] - DAY).days, (r["score_day"] - DAY).days, r["raw_score"]) for r in found)
    assert got == [("A", 4, 3, 3.0), ("A", 5, 4, 4.0), ("A", 6, 4, 4.0), ("A", 7, 4, 4.0), ("A", 10, 9, 9.0), ("B", 30, 29, 1.0), ("B", 30, 29, 1.0)]
    assert Q.training_examples(spark.createDataFrame([], "symbol string, breakout_date date"), scored, ("raw_score",)).collect() == []
