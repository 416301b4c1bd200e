"""Time-series features of every symbol and day. Look-ahead is only in the pivots and in the weekly flag, as documented there.

Every window is partitioned by symbol and ordered by date, so the whole chain plans to one exchange. Null means missing:
comparisons with a missing value count as false, and rolling values are null until their frame has enough rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, ScanConfig
from ..functions.rolling import by_symbol, clipped, is_true, lag, last_rows, percent_rank, ratio, rolling, safe_max, whole_slope, with_ema

def all_before():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def change(value: Column | str, n: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return ratio(value, lag(value, n)) - 1


def moving_averages(df: DataFrame) -> DataFrame:
    """sma_50, sma_150, sma_200 are simple; sma_10 and sma_20 are exponential means of those spans."""
    df = df.withColumn("i", F.row_number().over(by_symbol()).cast("long"))
    df = with_ema(df, {"sma_10": ("close", 2 / 11), "sma_20": ("close", 2 / 21)})
    return df.withColumns({f"sma_{n}": rolling(F.avg, "close", n) for n in (50, 150, 200)})


def ma_relations(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({f"distance_from_sma{n}": ratio(c("close") - c(f"sma_{n}"), c(f"sma_{n}")) for n in (10, 20, 50, 150, 200)})
    df = df.withColumns({f"ma_slope_{n}": change(f"sma_{n}", 5) for n in (10, 20, 50)} | {"sma_200_change": change("sma_200", 20)})
    return df.withColumns(
        {
            "ma_alignment": is_true((c("sma_10") > c("sma_20")) & (c("sma_20") > c("sma_50"))),
            "mas_rising": is_true((c("ma_slope_10") > 0) & (c("ma_slope_20") > 0) & (c("ma_slope_50") > 0)),
            "stage2": is_true((c("close") > c("sma_50")) & (c("close") > c("sma_150")) & (c("sma_50") > c("sma_150")) & (c("sma_150") > c("sma_200")) & (c("sma_200_change") > 0)),
        }
    ).drop("sma_200_change")


def ranges(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    """True range and its mean, daily ranges, and where the close is in the day's range."""
    c = F.col
    before = lag("close")
    df = df.withColumn("true_range", F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)))
    df = df.withColumns({"daily_range": c("high") - c("low"), "daily_range_pct": ratio(c("high") - c("low"), c("close"))})
    return df.withColumns(
        {
            "atr_20": rolling(F.avg, "true_range", cfg.atr_period), "adr_pct": rolling(F.avg, "daily_range_pct", cfg.adr_period),
            "close_range_position": clipped((c("close") - c("low")) / F.greatest(c("daily_range"), F.lit(0.001)), 0.0, 1.0),
        }
    )


def volumes(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    c = F.col
    slope = whole_slope("volume", 10)
    df = df.withColumns({"volume_sma_20": rolling(F.avg, "volume", cfg.volume_period), "dollar_volume": c("close") * c("volume"), "volume_trend": F.when(c("i") >= 10, F.coalesce(slope, F.lit(0.0)))})
    df = df.withColumns({"relative_volume": ratio(c("volume"), c("volume_sma_20")), "_recent": rolling(F.avg, "volume", cfg.dryup_window), "_history": rolling(F.avg, "volume", cfg.volume_history, 126)})
    df = df.withColumns({"volume_dryup_ratio": ratio(c("_recent"), lag("volume_sma_20", cfg.dryup_window)), "volume_vs_6m_avg": ratio(c("_recent"), c("_history"))})
    return df.withColumn("volume_declining", is_true((c("volume_dryup_ratio") < 1) & (c("volume_trend") < 0))).drop("_recent", "_history")


def contractions(df: DataFrame) -> DataFrame:
    """Ranges of the last 10, 20 and 40 days, and how many of the successive windows before got narrower."""
    c = F.col
    df = df.withColumns({f"_{k}{w}": rolling(f, x, w) for w in (10, 20, 40) for k, f, x in (("hi", F.max, "high"), ("lo", F.min, "low"))})
    df = df.withColumns({f"range_{w}": ratio(c(f"_hi{w}") - c(f"_lo{w}"), c("close")) for w in (10, 20, 40)})
    df = df.withColumns({f"_w{n}": ratio(lag("_hi10", 10 * n) - lag("_lo10", 10 * n), c("close")) for n in (1, 2, 3)})
    one = is_true(c("range_10") < c("_w1"))
    two, three = one & is_true(c("_w1") < c("_w2")), one & is_true(c("_w1") < c("_w2")) & is_true(c("_w2") < c("_w3"))
    df = df.withColumn("vcp_contraction_count", one.cast("int") + two.cast("int") + three.cast("int"))
    df = df.withColumns({"vcp_contracting": c("vcp_contraction_count") >= 2, "vcp_contraction_ratio": ratio(c("range_10"), safe_max(c("range_40"), 0.001))})
    return df.drop(*(f"_{k}{w}" for w in (10, 20, 40) for k in ("hi", "lo")), "_w1", "_w2", "_w3")


def consolidation(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    """Tight days in a row, the level to break out of, and the base's depth and age."""
    c = F.col
    n = cfg.base_length_max
    df = df.withColumns({"_hi60": rolling(F.max, "high", n), "_lo60": rolling(F.min, "low", n)})
    df = df.withColumn("consol_range_60", ratio(c("_hi60") - c("_lo60"), c("close")))
    df = df.withColumn("is_tight_consolidation", is_true(ratio(c("range_10"), safe_max(c("adr_pct"), 0.01)) <= 3.5))
    df = df.withColumn("_island", F.sum(F.when(c("is_tight_consolidation"), 0).otherwise(1)).over(all_before()))
    island = Window.partitionBy("symbol", "_island").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("consol_days", F.sum(F.when(c("is_tight_consolidation"), 1).otherwise(0)).over(island))
    width = F.least(c("consol_days"), F.lit(n)).cast("int")
    df = df.withColumn("_highs", F.collect_list("high").over(last_rows(n)))
    df = df.withColumn("breakout_level", F.when(c("consol_days") >= 5, F.array_max(F.slice("_highs", -width, width))).otherwise(F.array_max("_highs")))
    first_max = F.max_by("i", F.struct("high", (-c("i")).alias("minus"))).over(last_rows(20))
    high = rolling(F.max, "high", 20)
    return df.withColumns({"base_depth": ratio(high - c("close"), high), "days_from_high": F.when(c("i") >= 20, c("i") - first_max)}).drop("_island", "_highs", "_hi60", "_lo60")


def prior_moves(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    c = F.col
    low = rolling(F.min, "low", cfg.prior_move_window)
    df = df.withColumn("prior_move_pct", ratio(c("close") - low, low))
    df = df.withColumn("is_power_move", is_true(c("prior_move_pct") >= 0.20))
    last = F.max(F.when(c("is_power_move"), c("i"))).over(last_rows(cfg.prior_move_window))
    return df.withColumn("days_since_power_move", F.when(c("i") >= cfg.prior_move_window, F.coalesce(c("i") - last, F.lit(cfg.prior_move_window))))


def pivots(df: DataFrame) -> DataFrame:
    """Strict five-bar pivots (they look two bars ahead) against the pivot before, and how many of the last 60 rose or fell."""
    c = F.col
    out = {}
    for name, value, sign in (("low", c("low"), 1), ("high", c("high"), -1)):
        others = [lag(value, n) for n in (1, 2)] + [F.lead(value, n).over(by_symbol()) for n in (1, 2)]
        out[f"_{name}"] = is_true(F.reduce(F.array(*(sign * (o - value) > 0 for o in others)), F.lit(True), lambda a, b: a & b))
    df = df.withColumns(out)
    before = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_p{name}": F.last(F.when(c(f"_{name}"), c(name)), ignorenulls=True).over(before) for name in ("low", "high")})
    df = df.withColumns({"higher_lows": is_true(c("_low") & (c("low") > c("_plow"))), "lower_highs": is_true(c("_high") & (c("high") < c("_phigh")))})
    counts = {name: F.sum(c(flag).cast("int")).over(last_rows(60)) for name, flag in (("swing_low_count", "higher_lows"), ("swing_high_count", "lower_highs"))}
    return df.withColumns(counts).drop("_low", "_high", "_plow", "_phigh")


def surf(df: DataFrame) -> DataFrame:
    """Share of the last 20 days near or above a rising short mean."""
    c = F.col
    near = is_true((c("distance_from_sma10") >= -0.03) & (c("distance_from_sma10") <= 0.10) & (c("sma_10") > lag("sma_10")))
    return df.withColumn("_near", near.cast("double")).withColumn("ema10_surf_ratio", rolling(F.avg, "_near", 20, 5)).drop("_near")


def on_balance(df: DataFrame) -> DataFrame:
    """On-balance volume and whether it rises faster than the price, both by their slope over 20 days."""
    c = F.col
    df = df.withColumn("obv", F.sum(F.coalesce(F.signum(c("close") - lag("close")).cast("long") * c("volume"), F.lit(0).cast("long"))).over(all_before()))

    def since(at_least: int, slope: Column) -> Column:
        return F.when(c("i") >= at_least, F.coalesce(slope, F.lit(0.0)))

    price = F.regr_slope(c("close"), c("i").cast("double")).over(last_rows(20))
    df = df.withColumns({"obv_slope": since(10, whole_slope("obv", 60)), "_obv20": since(5, whole_slope("obv", 20)), "_price20": since(5, price), "_volume20": safe_max(F.when(c("i") >= 5, F.avg("volume").over(last_rows(20))), 1.0)})
    df = df.withColumn("obv", c("obv").cast("double"))
    up = c("_obv20") / c("_volume20")
    return df.withColumn("obv_trend", is_true((up > 0) & (up > F.greatest(c("_price20") / F.greatest(c("close"), F.lit(0.01)), F.lit(0.0))))).drop("_obv20", "_price20", "_volume20")


def trigger_bars(df: DataFrame) -> DataFrame:
    """A day of range and volume both below the 20th percentile of the last 20."""
    c = F.col
    fifth = lambda x: rolling(lambda v: F.percentile(v, F.lit(0.2)), c(x).cast("double"), 20, 5)
    return df.withColumns({"_r": fifth("daily_range_pct"), "_v": fifth("volume")}).withColumn("is_trigger_bar", is_true((c("daily_range_pct") < c("_r")) & (c("volume") < c("_v")))).drop("_r", "_v")


def weekly_alignment(df: DataFrame, point_in_time: bool = False) -> DataFrame:
    """Last weekly close above both weekly means in order, on every row of the symbol (a look-ahead in history); true with fewer
    than ten weeks. point_in_time: each row gets its own week's state instead."""
    week = F.next_day(F.date_sub("bar_date", 1), "Fri")
    weeks = df.groupBy("symbol", week.alias("bar_date")).agg(F.max_by("close", "bar_date").alias("close"))
    weeks = with_ema(weeks.withColumn("i", F.row_number().over(by_symbol()).cast("long")), {"e10": ("close", 2 / 11), "e20": ("close", 2 / 21)})
    state = is_true((F.col("close") > F.col("e10")) & (F.col("e10") > F.col("e20")))
    if point_in_time:
        own = weeks.select("symbol", F.col("bar_date").alias("_week"), (state | (F.col("i") < 10)).alias("weekly_aligned"))
        return df.withColumn("_week", week).join(own, ["symbol", "_week"], "left").drop("_week")
    last = weeks.groupBy("symbol").agg(F.max_by(state, "bar_date").alias("s"), F.count("*").alias("n")).select("symbol", (F.col("s") | (F.col("n") < 10)).alias("weekly_aligned"))
    return df.join(last, "symbol")


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumns({"abs_return_63d": change("close", 63), "abs_return_126d": change("close", 126)})


def proximity(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({"_year": rolling(F.max, "high", 252, 100), "_quarter": rolling(F.max, "high", 90, 30)})
    df = df.withColumns({"pct_from_52wk_high": ratio(c("close") - c("_year"), c("_year")), "pct_from_90d_high": ratio(c("close") - c("_quarter"), c("_quarter"))}).drop("_year", "_quarter")
    return df.withColumn("approaching_annual_high", is_true((c("pct_from_52wk_high") > -0.15) & (c("pct_from_52wk_high") < -0.03)))


def stops(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({"stop_level": F.min("low").over(last_rows(60)), "_low20": rolling(F.min, "low", 20, 5)})
    df = df.withColumns({"stop_distance_pct": clipped(ratio(c("close") - c("stop_level"), c("close")), 0.001, 0.25), "stop_distance_20d_pct": clipped(ratio(c("close") - c("_low20"), c("close")), 0.001, 0.50)})
    return df.withColumn("trailing_stop_triggered", is_true(c("close") < c("sma_10"))).drop("_low20")


def risk_reward(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    c = F.col
    high = rolling(F.max, "high", cfg.base_length_max)
    df = df.withColumn("target_level", F.least(F.greatest(c("close") * (1 + c("consol_range_60")), high), c("close") * 1.4))
    df = df.withColumn("potential_gain_pct", safe_max(ratio(c("target_level") - c("close"), c("close")), 0.0))
    r = ratio(c("potential_gain_pct"), c("stop_distance_pct"))
    return df.withColumn("potential_r", F.when(r.isNotNull(), F.least(r, F.lit(10.0))))


def asof_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bench_close: the benchmark's last close on or before each bar's date. Joined once on the distinct calendar, which is small, then by date."""
    calendar = df.select("bar_date").distinct().withColumn("_close", F.lit(None).cast("double")).withColumn("_own", F.lit(1))
    points = benchmark.select("bar_date", F.col("close").alias("_close"), F.lit(0).alias("_own"))
    order = Window.orderBy("bar_date", "_own").rowsBetween(Window.unboundedPreceding, 0)
    filled = calendar.unionByName(points).withColumn("bench_close", F.last("_close", ignorenulls=True).over(order)).where("_own = 1").select("bar_date", "bench_close")
    return df.join(filled, "bar_date", "left")


def relative_strength(df: DataFrame, benchmark: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    """Excess return over the benchmark, both skipping the last days."""
    df, skip = asof_benchmark(df, benchmark), cfg.rs_skip_days
    excess = lambda n: ratio(lag("close", skip), lag("close", skip + n)) - ratio(lag("bench_close", skip), lag("bench_close", skip + n))
    return df.withColumns({f"rs_comp_{n}": excess(n) for n in cfg.rs_periods})


def rs_rank(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    """Percentile (0-100, ties averaged) of the return over 60 days of the union calendar, per date; null if a symbol did not trade on either day."""
    days = df.select("bar_date").distinct().withColumn("day", F.row_number().over(Window.orderBy("bar_date")))
    numbered = df.select("symbol", "bar_date", "close").join(days, "bar_date")
    past = numbered.select("symbol", (F.col("day") + cfg.rs_rank_window).alias("day"), F.col("close").alias("past"))
    moved = numbered.join(past, ["symbol", "day"], "left").withColumn("ret", ratio(F.col("close"), F.col("past")) - 1)
    return moved.withColumn("rs_rank", percent_rank("ret", "bar_date")).select("symbol", "bar_date", "ret", "rs_rank")


def all_features(bars: DataFrame, benchmark: DataFrame | None = None, cfg: ScanConfig = DEFAULT) -> DataFrame:
    df = moving_averages(bars)
    for step in (ma_relations, ranges, volumes, contractions, consolidation, prior_moves, pivots, surf, on_balance, trigger_bars, momentum, proximity, stops, risk_reward):
        df = step(df)
    if benchmark is not None:
        df = relative_strength(df, benchmark, cfg)
    return weekly_alignment(df)
