"""Signal quality, position sizes, entry gates and the lifecycle of paper trades: expressions over one row, joins for what needs a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import by_symbol, clipped, is_true, ratio

c = F.col


def quality_score() -> Column:
    """0 to 100 from the components, the prior move and the base's length; one decimal."""
    moved = clipped((c("prior_move_pct") - 0.75) / 2.25, 0.0, 1.0)
    base = clipped((c("consol_days") - 5) / 30.0, 0.0, 1.0)
    parts = 0.35 * c("volume_score") / 30 + 0.25 * c("rs_score") / 30 + 0.25 * F.coalesce(moved, F.lit(0.0)) + 0.10 * c("base_score") / 20 + 0.05 * F.coalesce(base, F.lit(0.0))
    return F.floor(parts * 1000 + 0.5) / 10


def position_size(equity: Column, entry: Column, stop: Column, *, risk: float = 0.005, cap: float = 0.20) -> Column:
    """Whole shares: what risks this share of the equity, at least one, and no more than the cap's worth. Null without a risk."""
    per_share = entry - stop
    by_risk = F.greatest(F.floor(ratio(equity * risk, per_share)), F.lit(1))
    return F.when(per_share > 0, F.least(by_risk, F.floor(ratio(equity * cap, entry))))


def index_gate(index: DataFrame, period: int = 50) -> DataFrame:
    """(bar_date, gate_open): the main index closes above its mean of at most period bars."""
    frame = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(-(period - 1), 0)
    return index.where("symbol = 'MAIN'").select("bar_date", (c("close") > F.avg("close").over(frame)).alias("gate_open"))


def gated(signals: DataFrame, gate: DataFrame) -> DataFrame:
    """gate_open as of each signal's date (open before the gate's first day).

    The gate is carried to the signals' distinct dates once, so the ordered part has a row for each date, not for each signal.
    """
    days = signals.select(c("scan_date").alias("bar_date")).distinct().select("bar_date", F.lit(None).cast("boolean").alias("gate_open"), F.lit(1).alias("_asked"))
    both = gate.select("bar_date", "gate_open", F.lit(0).alias("_asked")).unionByName(days)
    carried = both.withColumn("gate_open", F.last("gate_open", ignorenulls=True).over(Window.orderBy("bar_date", "_asked")))  # a row for each date
    as_of = carried.where("_asked = 1").select(c("bar_date").alias("scan_date"), F.coalesce("gate_open", F.lit(True)).alias("gate_open"))
    return signals.join(as_of, "scan_date", "left")


def entry_allowed(regime: Column, macro: Column, momentum: Column, *, blocked: tuple[str, ...] = ("DOWNTREND",), macro_blocked: tuple[str, ...] = ("BEARISH_TREND",)) -> Column:
    """No entry in a blocked daily or macro regime or with falling 21-day momentum; what is unknown blocks nothing."""
    checks = (regime.isin(*blocked), macro.isin(*macro_blocked), momentum < 0)
    return ~reduce(Column.__or__, (is_true(x) for x in checks))


def advanced(trades: DataFrame, orders: DataFrame, today: DataFrame) -> DataFrame:
    """One step of every paper trade: submitted -> open or cancelled, open -> exiting (stop or mean crossed), exiting -> closed.

    orders: order_id, state (filled, cancelled, rejected, expired or another), fill_price, fill_date. today: symbol, close, sma_10, bar_date.
    """
    entry = orders.select(c("order_id"), c("state").alias("_in"), c("fill_price").alias("_in_price"), c("fill_date").alias("_in_date"))
    out = orders.select(c("order_id").alias("exit_order_id"), c("state").alias("_out"), c("fill_price").alias("_out_price"), c("fill_date").alias("_out_date"))
    df = trades.join(entry, "order_id", "left").join(out, "exit_order_id", "left").join(today.select("symbol", c("close").alias("_close"), c("sma_10").alias("_mean")), "symbol", "left")
    dead = c("_in").isin("cancelled", "rejected", "expired")
    stopped, crossed = c("_close") <= c("scan_stop_level"), c("_close") < c("_mean")
    was = c("status")
    df = df.withColumns({
        "status": F.when((was == "submitted") & (c("_in") == "filled"), "open").when((was == "submitted") & dead, "cancelled").when((was == "open") & (stopped | crossed), "exiting").when((was == "exiting") & (c("_out") == "filled"), "closed").otherwise(was),
        "entry_price": F.when((was == "submitted") & (c("_in") == "filled"), c("_in_price")).otherwise(c("entry_price")),
        "entry_date": F.when((was == "submitted") & (c("_in") == "filled"), c("_in_date")).otherwise(c("entry_date")),
        "exit_reason": F.when((was == "open") & stopped, "stop_cross").when((was == "open") & crossed, "ma_cross").otherwise(c("exit_reason")),
        "exit_price": F.when((was == "exiting") & (c("_out") == "filled"), c("_out_price")).otherwise(c("exit_price")),
        "exit_date": F.when((was == "exiting") & (c("_out") == "filled"), c("_out_date")).otherwise(c("exit_date")),
    })
    gain = c("exit_price") - c("entry_price")
    done = c("status") == "closed"
    df = df.withColumns({"pnl_pct": F.when(done, ratio(gain, c("entry_price"))), "pnl_dollars": F.when(done, gain * c("shares"))})
    return df.drop("_in", "_in_price", "_in_date", "_out", "_out_price", "_out_date", "_close", "_mean")


def lifecycle(trades: DataFrame, bars: DataFrame, mean_days: int = 10) -> DataFrame:
    """trades (symbol, scan_date, stop_level, shares) carried through all days that follow: submitted, open, exiting, closed.

    A buy fills at the next open; the stop order then stands from the day after, if the fill is above it, and fills at the stop or at a lower open
    ('stop_order'). Closes are looked at from the day of the fill on: at or below the stop ('stop_cross') or else below the mean of the last closes
    ('ma_cross') the trade is exiting, and sold at the next open. Within a day a stop order comes before the close.

    Where a symbol's closes next fall below their mean is read off one window for each symbol, so a trade meets only the bars
    on which it is held."""
    own = by_symbol()
    frame = own.rowsBetween(1 - mean_days, 0)
    mean = F.when(F.count("close").over(frame) == mean_days, F.avg("close").over(frame))
    ahead = own.rowsBetween(0, Window.unboundedFollowing)
    numbered = bars.select("symbol", "bar_date", "open", "low", "close", F.row_number().over(own).alias("i"), mean.alias("_mean"))
    numbered = numbered.withColumns({"_below": is_true(c("close") < c("_mean")), "_next_open": F.lead("open").over(own), "_next_date": F.lead("bar_date").over(own)})
    numbered = numbered.withColumn("_until", F.coalesce(F.min(F.when(c("_below"), c("i"))).over(ahead), F.max("i").over(ahead)))
    scanned = numbered.select("symbol", c("bar_date").alias("scan_date"), (c("i") + 1).alias("i"))
    filled = numbered.select("symbol", "i", c("bar_date").alias("entry_date"), c("open").alias("entry_price"), "_until")
    placed = trades.join(scanned, ["symbol", "scan_date"]).join(filled, ["symbol", "i"], "left").withColumnRenamed("i", "_entry")
    days = placed.where("entry_price is not null").withColumn("i", F.explode(F.sequence("_entry", "_until")))
    days = days.join(numbered.drop("_until", "bar_date").join(numbered.select("symbol", "i", "bar_date"), ["symbol", "i"]), ["symbol", "i"])
    stop, level = c("i") > c("_entry"), c("stop_level")
    ordered = is_true(stop & (c("entry_price") > level) & (c("low") <= level))
    reason = F.when(ordered, "stop_order").when(is_true(c("close") <= level), "stop_cross").when(c("_below"), "ma_cross")
    shown = F.struct("i", reason.alias("exit_reason"), F.when(ordered, F.least("open", level)).otherwise(c("_next_open")).alias("exit_price"), F.when(ordered, c("bar_date")).otherwise(c("_next_date")).alias("exit_date"))
    ends = days.groupBy("symbol", "scan_date").agg(F.min(F.when(reason.isNotNull(), shown)).alias("x")).select("symbol", "scan_date", "x.exit_reason", "x.exit_price", "x.exit_date")
    df = placed.drop("_until", "_entry").join(ends, ["symbol", "scan_date"], "left")
    status = F.when(c("entry_price").isNull(), "submitted").when(c("exit_reason").isNull(), "open").when(c("exit_price").isNull(), "exiting").otherwise("closed")
    gain = c("exit_price") - c("entry_price")
    return df.withColumns({"status": status, "pnl_pct": ratio(gain, c("entry_price")), "pnl_dollars": gain * c("shares")})
