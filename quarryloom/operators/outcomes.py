"""Forward labels of scans, and exits of trades: joins of signals to the bars after them, bounded in number, and first hits by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import by_symbol, ratio

c = F.col


def forward(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """signals: symbol, scan_date and more; every bar after the scan, up to horizon of them, numbered n from 1.

    Bars are numbered once per symbol, and a signal joins a range of numbers cut into steps of the horizon, so the join
    is an equality on symbol and step (two steps for each signal) and its output is bounded by horizon rows a signal.
    """
    numbered = bars.withColumn("i", F.row_number().over(by_symbol()))
    at = numbered.select("symbol", c("bar_date").alias("scan_date"), c("i").alias("scan_i"))
    step = lambda x: F.floor(x / horizon)
    placed = signals.join(at, ["symbol", "scan_date"]).withColumn("_step", F.explode(F.array_distinct(F.array(step(c("scan_i") + 1), step(c("scan_i") + horizon)))))
    own = numbered.withColumn("_step", step(c("i")))
    joined = placed.join(own, ["symbol", "_step"]).where((c("i") > c("scan_i")) & (c("i") <= c("scan_i") + horizon))
    return joined.withColumn("n", (c("i") - c("scan_i")).cast("long")).drop("_step", "scan_i", "i")


KEY = ["symbol", "scan_date"]


def first(condition: Column) -> Column:
    return F.min(F.when(condition, c("n")))


#: Bars of a block of which the extremes are looked at before its bars are.
BLOCK = 64


def open_hits(signals: DataFrame, bars: DataFrame, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each signal and name: after how many bars its condition first holds, over all bars that follow; null if never.

    conditions: on a bar, and on a block of bars (max_close, min_low, max_high), which has to hold wherever it does on one of its
    bars. A signal meets one row for each later block of its symbol, then the bars of its own block and of the first that qualifies.
    """
    numbered = bars.withColumn("i", F.row_number().over(by_symbol())).withColumn("_block", F.floor((c("i") - 1) / BLOCK))
    blocks = numbered.groupBy("symbol", "_block").agg(F.max("close").alias("max_close"), F.min("low").alias("min_low"), F.max("high").alias("max_high"))
    at = numbered.select("symbol", c("bar_date").alias("scan_date"), c("i").alias("scan_i"), c("_block").alias("own_block"))
    placed = signals.join(at, KEY)
    later = placed.join(blocks, "symbol").where("_block > own_block")
    qualified = later.groupBy(*KEY).agg(*(F.min(F.when(on_block, c("_block"))).alias(f"_{name}") for name, (_, on_block) in conditions.items()))
    wanted = placed.join(qualified, KEY, "left").withColumn("_block", F.explode(F.array_compact(F.array_distinct(F.array("own_block", *(f"_{name}" for name in conditions))))))
    rows = wanted.join(numbered, ["symbol", "_block"]).where("i > scan_i").withColumn("n", (c("i") - c("scan_i")).cast("long"))
    return rows.groupBy(*KEY).agg(*(first(on_bar).alias(name) for name, (on_bar, _) in conditions.items()))


def live_outcomes(signals: DataFrame, bars: DataFrame, horizon: int = 60) -> DataFrame:
    """Against the scan's price: breakout by the close, stop by the low, target by the high, and the change, over all bars that
    follow; gains and the drawdown over the first horizon of them at most."""
    rows = forward(signals, bars, horizon)
    gain = lambda n: ratio(F.max(F.when(c("n") <= n, c("high"))), F.first("price")) - 1
    out = rows.groupBy(*KEY).agg(
        F.first("price").alias("entry_price"), *(gain(n).alias(f"max_gain_{n}d") for n in (10, 20, 60)), (ratio(F.min(F.when(c("n") <= 20, c("low"))), F.first("price")) - 1).alias("max_drawdown_20d"),
    )
    level = lambda name: c(name) != 0
    hits = open_hits(
        signals,
        bars,
        {
            "days_to_breakout": (level("breakout_level") & (c("close") >= c("breakout_level")), level("breakout_level") & (c("max_close") >= c("breakout_level"))),
            "days_to_stop": (level("stop_level") & (c("low") <= c("stop_level")), level("stop_level") & (c("min_low") <= c("stop_level"))),
            "days_to_target": (level("target_level") & (c("high") >= c("target_level")), level("target_level") & (c("max_high") >= c("target_level"))),
        },
    )
    numbered = bars.withColumn("i", F.row_number().over(by_symbol()))
    last = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = numbered.select("symbol", c("bar_date").alias("scan_date"), (F.max("i").over(last) - c("i")).cast("long").alias("days_elapsed"), F.last("close").over(last).alias("_close"))
    out = out.join(ends, KEY).join(hits, KEY, "left").withColumn("pct_change", ratio(c("_close"), c("entry_price")) - 1).drop("_close")
    return out.withColumns({"breakout_triggered": c("days_to_breakout").isNotNull(), "stop_triggered": c("days_to_stop").isNotNull(), "target_reached": c("days_to_target").isNotNull()})


def historical_outcomes(signals: DataFrame, bars: DataFrame, horizon: int = 60) -> DataFrame:
    """Against the next open, over the first 60 bars: strict breakouts and targets by the high, stops by the close."""
    rows = forward(signals, bars, horizon)
    entry = F.min_by("open", "n")
    out = rows.groupBy(*KEY).agg(
        entry.alias("entry_price"), F.max("n").alias("days_elapsed"), F.max_by("bar_date", "n").alias("outcome_date"), first(c("high") > c("breakout_level")).alias("days_to_breakout"), first(c("close") < c("stop_level")).alias("days_to_stop"), first(c("high") > c("target_level")).alias("days_to_target"),
        *(F.max(F.when(c("n") <= n, c("high"))).alias(f"_h{n}") for n in (10, 20, 60)), F.min(F.when(c("n") <= 20, c("low"))).alias("_l20"),
    )
    return out.withColumns({f"max_gain_{n}d": ratio(c(f"_h{n}"), c("entry_price")) - 1 for n in (10, 20, 60)} | {"max_drawdown_20d": ratio(c("_l20"), c("entry_price")) - 1}).drop("_h10", "_h20", "_h60", "_l20")


def forward_returns(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Entry at the next open; the close that many rows after the entry row, null past the end."""
    lead = lambda col, n: F.lead(col, n).over(by_symbol())
    ahead = bars.withColumns({"entry": lead("open", 1)} | {f"fwd_{h}": ratio(lead("close", 1 + h), lead("open", 1)) - 1 for h in horizons})
    return signals.join(ahead.select("symbol", c("bar_date").alias("scan_date"), "entry", *(f"fwd_{h}" for h in horizons)), KEY)


def true_range() -> Column:
    """From the close before; a symbol's first bar has none."""
    before = F.lag("close").over(by_symbol())
    return F.when(before.isNotNull(), F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)))


def entries(signals: DataFrame, bars: DataFrame, slippage_bps: float = 10.0, atr_period: int = 14) -> DataFrame:
    """Next open with slippage; the stop is that day's low, two percent away at least. atr: the plain mean of the last true ranges, the entry
    bar's included, of as many as there are; the trade's risk where that is nothing."""
    own = by_symbol()
    ranged = bars.withColumn("_range", true_range())
    after = ranged.withColumn("_atr", F.avg("_range").over(own.rowsBetween(1 - atr_period, 0)))
    after = after.withColumns({"entry_date": F.lead("bar_date").over(own), "_open": F.lead("open").over(own), "_low": F.lead("low").over(own), "_atr": F.lead("_atr").over(own)})
    kept = after.select("symbol", c("bar_date").alias("scan_date"), "entry_date", "_open", "_low", "_atr")
    df = signals.drop("atr").join(kept, KEY).where("entry_date is not null")
    df = df.withColumn("entry", c("_open") * (1 + slippage_bps / 10_000)).withColumn("stop", F.least(c("_low"), c("entry") * 0.98))
    return df.withColumn("atr", F.when(c("_atr") > 0, c("_atr")).otherwise(c("entry") - c("stop"))).drop("_open", "_low", "_atr")


def breakout_entries(signals: DataFrame, bars: DataFrame, window: int = 15, slippage_bps: float = 10.0) -> DataFrame:
    """The open after the first close at the level within the window (that close itself on a symbol's last bar)."""
    nexts = bars.withColumns({"next_date": F.lead("bar_date").over(by_symbol()), "next_open": F.lead("open").over(by_symbol()), "next_low": F.lead("low").over(by_symbol())})
    rows = forward(signals.where("breakout_level > 0"), nexts, window).where("close >= breakout_level")
    hit = rows.groupBy(*KEY).agg(F.min_by(F.struct("bar_date", "close", "low", "next_date", "next_open", "next_low"), "n").alias("h")).select(*KEY, "h.*")
    last = c("next_date").isNull()
    df = hit.select(*KEY, F.coalesce("next_date", "bar_date").alias("entry_date"), (F.when(last, c("close")).otherwise(c("next_open")) * (1 + slippage_bps / 10_000)).alias("entry"), last.alias("_last"), "low", "next_low")
    return df.withColumn("stop", F.when(c("_last"), c("low")).otherwise(F.least(c("next_low"), c("entry") * 0.98))).drop("_last", "low", "next_low")


def _after_entry(trades: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """Bars after the entry day, numbered; a trade that has none is kept by the callers' left joins (no_bars)."""
    moved = trades.withColumnsRenamed({"scan_date": "signal_date", "entry_date": "scan_date"})
    return forward(moved, bars, hold).withColumnsRenamed({"scan_date": "entry_date", "signal_date": "scan_date"})


def no_bars(trades: DataFrame, exits: DataFrame) -> DataFrame:
    """exits, and the trades that have no bar after their entry: out at the entry after 0 bars, R 0, 'no_data'."""
    own = trades.where("entry > stop").select(*KEY, "entry", "entry_date")
    filled = {"bars_held": F.lit(0).cast("long"), "exit_price": c("entry"), "exit_reason": F.lit("no_data"), "exit_date": c("entry_date"), "r_multiple": F.lit(0.0)}
    return own.join(exits, KEY, "left").select(*KEY, *(F.coalesce(c(k), v).alias(k) for k, v in filled.items()))


def exit_fixed_r(trades: DataFrame, bars: DataFrame, target_r: float, hold: int = 30) -> DataFrame:
    """Stop first, then the target at target_r times the risk, then time; the last close if bars run out."""
    rows = _after_entry(trades, bars, hold).withColumns({"risk": c("entry") - c("stop"), "target": c("entry") + target_r * (c("entry") - c("stop"))})
    stopped, hit = c("low") <= c("stop"), c("high") >= c("target")
    fill = F.when(stopped, F.least(c("open"), c("stop"))).when(hit, F.greatest(c("open"), c("target"))).otherwise(c("close"))
    reason = F.when(stopped, "stop").when(hit, "target").when(c("n") >= hold, "time").otherwise("eod")
    return no_bars(trades, _first_exit(rows, stopped | hit | (c("n") >= hold), fill, reason))


def exit_time(trades: DataFrame, bars: DataFrame, hold: int = 15) -> DataFrame:
    rows = _after_entry(trades, bars, hold).withColumn("risk", c("entry") - c("stop"))
    stopped = c("low") <= c("stop")
    return no_bars(trades, _first_exit(rows, stopped | (c("n") >= hold), F.when(stopped, F.least(c("open"), c("stop"))).otherwise(c("close")), F.when(stopped, "stop").when(c("n") >= hold, "time").otherwise("eod")))


def exit_atr_trail(trades: DataFrame, bars: DataFrame, hold: int = 30, multiple: float = 2.0, activate: float = 1.0) -> DataFrame:
    """After a gain of one risk, the stop follows the highest high (today's included) at two ATRs; it never falls."""
    rows = _after_entry(trades, bars, hold).withColumn("risk", c("entry") - c("stop"))
    so_far = Window.partitionBy("symbol", "scan_date").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_water": F.greatest(c("entry"), F.max("high").over(so_far)), "_active": F.max((c("high") >= c("entry") + activate * c("risk")).cast("int")).over(so_far) == 1})
    level = F.when(c("_active"), F.greatest(c("stop"), c("_water") - multiple * c("atr"))).otherwise(c("stop"))
    rows = rows.withColumn("_level", level)
    hit = c("low") <= c("_level")
    reason = F.when(hit & c("_active"), "trail_stop").when(hit, "stop").when(c("n") >= hold, "time").otherwise("eod")
    return no_bars(trades, _first_exit(rows, hit | (c("n") >= hold), F.when(hit, F.least(c("open"), c("_level"))).otherwise(c("close")), reason))


def _first_exit(rows: DataFrame, ends: Column, fill: Column, reason: Column) -> DataFrame:
    """The first bar that ends the trade, or its last one."""
    shown = F.struct(c("n").alias("bars_held"), fill.alias("exit_price"), reason.alias("exit_reason"), c("bar_date").alias("exit_date"), ((fill - c("entry")) / c("risk")).alias("r_multiple"))
    chosen = F.coalesce(F.min_by(F.when(ends, shown), F.when(ends, c("n"))), F.max_by(shown, "n"))
    return rows.where("risk > 0").groupBy(*KEY).agg(chosen.alias("x")).select(*KEY, "x.*")
