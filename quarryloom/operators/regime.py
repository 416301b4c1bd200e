"""Market condition and macro regime: one row for each index date, for all dates at once."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import by_symbol, clipped, is_true, lag, last_rows, ratio, rolling, with_ema
from .scoring import ladder

c = F.col

#: The lowest daily score of each regime, and its multiplier.
REGIMES = ((70, "BULL", 1.00), (55, "UPTREND", 0.95), (40, "MIXED", 0.85), (25, "CAUTION", 0.70), (0, "DOWNTREND", 0.50))


def index_averages(index: DataFrame) -> DataFrame:
    df = index.withColumn("i", F.row_number().over(by_symbol()).cast("long"))
    return df.withColumns({f"sma_{n}": rolling(F.avg, "close", n) for n in (10, 20, 50, 150, 200)})


def index_trend(index: DataFrame) -> DataFrame:
    """Up to 15 for the main index above its means, 4 for the slope of the 50-day mean, 6 for the two other indexes above their 200-day means.
    The slope and rise compare with the row 9 and 19 rows before, as the rules being rebuilt do."""
    df = index_averages(index)
    rising = is_true(c("sma_200") > lag("sma_200", 19))
    above = [is_true(c("close") > c(f"sma_{n}")).cast("int") for n in (10, 20, 50, 150, 200)]
    df = df.withColumns({"hits": sum(above, rising.cast("int")), "above_200": is_true(c("close") > c("sma_200")), "slope": F.coalesce(ratio(c("sma_50"), lag("sma_50", 9)) - 1, F.lit(0.0))})
    others = df.where("symbol <> 'MAIN'").groupBy("bar_date").agg(*(F.max(F.when(c("symbol") == s, F.when(c("i") < 200, 1.5).when(c("above_200"), 3.0).otherwise(0.0))).alias(s) for s in ("WIDE", "SMALL")))
    main = df.where("symbol = 'MAIN'").join(others, "bar_date", "left")
    aligned = c("hits") * 2.5
    score = F.when(c("above_200"), aligned).otherwise(F.least(aligned, F.lit(5.0))) + F.when(c("slope") > 0.015, 4.0).when(c("slope") > 0.005, 2.5).when(c("slope") > 0, 1.0).otherwise(0.0) + F.coalesce(c("WIDE"), F.lit(1.5)) + F.coalesce(c("SMALL"), F.lit(1.5))
    return main.select("bar_date", c("hits").cast("long").alias("hits"), "slope", F.least(score, F.lit(25.0)).alias("index_trend_score"))


def distribution_days(index: DataFrame) -> DataFrame:
    df = index.where("symbol = 'MAIN'").withColumns({"i": F.row_number().over(by_symbol()), "pct": ratio(c("close"), lag("close")) - 1, "_v": lag("volume")})
    dist = is_true((c("pct") <= -0.002) & (c("volume") > c("_v")))
    stall = is_true((c("pct") > 0) & (c("pct") < 0.002) & (c("volume") > c("_v") * 1.05))
    df = df.withColumns({"distribution_days": F.sum(dist.cast("long")).over(last_rows(25)), "stalling_days": F.sum(stall.cast("long")).over(last_rows(25))})
    raw = F.greatest(20.0 - 4.0 * c("distribution_days") - 2.0 * c("stalling_days"), F.lit(0.0))
    return df.select("bar_date", "distribution_days", "stalling_days", F.when(c("i") < 26, 15.0).when(c("distribution_days") >= 5, 0.0).otherwise(raw).alias("distribution_score"))


def follow_through(index: DataFrame, lookback: int = 80) -> DataFrame:
    """The latest follow-through day within the last bars: a state machine (uptrend 0, correction 1, rally 2) folded over each day's bars.
    A candidate holds while no later low undercuts the correction's."""
    df = index.where("symbol = 'MAIN'").withColumns({"i": F.row_number().over(by_symbol()), "high252": rolling(F.max, "high", 252, 50)})
    df = df.withColumn("_bars", F.collect_list(F.struct("close", "low", "volume")).over(last_rows(lookback)))
    state = "named_struct('st', {0}, 'cl', {1}, 'ra', {2}, 'dn', {3}, 'fi', {4}, 'fl', {5})".format
    pct, now, before = "(_bars[k].close / _bars[k-1].close - 1)", "_bars[k]", "_bars[k-1]"
    keep = dict(st="s.st", cl="s.cl", ra="s.ra", dn="s.dn", fi="s.fi", fl="s.fl")
    to = lambda **new: state(*(keep | new).values())
    low5 = "array_min(transform(slice(_bars, greatest(k - 3, 1), least(k + 1, 5)), x -> x.low))"
    fold = f"""aggregate(sequence(1, size(_bars) - 1), {state("0", "double('infinity')", "0", "0", "-1", "0D")}, (s, k) -> CASE
      WHEN s.st = 0 THEN CASE WHEN {pct} < -0.03D THEN {to(st="1", cl=f"{now}.low", dn="1")}
        WHEN {pct} < 0 AND s.dn + 1 >= 3 THEN {to(st="1", cl=low5, dn="s.dn + 1")} WHEN {pct} < 0 THEN {to(dn="s.dn + 1")} ELSE {to(dn="0")} END
      WHEN s.st = 1 THEN CASE WHEN {pct} > 0 THEN {to(st="2", cl=f"least(s.cl, {now}.low)", ra="k")} ELSE {to(cl=f"least(s.cl, {now}.low)")} END
      WHEN {now}.low < s.cl THEN {to(st="1", cl=f"{now}.low", ra="0")}
      WHEN k - s.ra >= 3 AND {pct} >= 0.0125D AND {now}.volume > {before}.volume THEN {to(st="0", dn="0", fi="k", fl="s.cl")}
      ELSE s END)"""
    df = df.withColumn("_s", F.when(F.size("_bars") >= 10, F.expr(fold)))
    later = F.expr("array_min(transform(slice(_bars, _s.fi + 2, size(_bars)), x -> x.low))")
    found = F.coalesce(c("_s.fi") >= 0, F.lit(False))
    df = df.withColumns({"ftd_found": found, "ftd_days_ago": F.when(found, F.size("_bars") - 1 - c("_s.fi")).cast("long"), "ftd_valid": F.when(found, F.coalesce(later >= c("_s.fl"), F.lit(True))).otherwise(False)})
    ago, near = c("ftd_days_ago").cast("double"), ratio(c("close"), c("high252"))
    none = F.when(near >= 0.95, 12.0).when(near >= 0.90, 8.0).otherwise(2.0)
    score = F.when(~c("ftd_found"), none).when(~c("ftd_valid"), 0.0).when(ago <= 10, 20.0).when(ago <= 25, 20.0 - (ago - 10) / 15 * 10).when(ago <= 40, 10.0 - (ago - 25) / 15 * 5).otherwise(5.0)
    return df.select("bar_date", "ftd_found", "ftd_days_ago", "ftd_valid", score.alias("follow_through_score"))


def breadth(features: DataFrame) -> DataFrame:
    """Per date, over the symbols' last rows up to it within the day's bars: shares above their means, in stage 2, near their highs."""
    share = lambda cond: F.avg(is_true(cond).cast("double"))
    df = features.groupBy("bar_date").agg(F.count("*").alias("n_symbols"), share(c("close") > c("sma_50")).alias("pct_above_50"), share(c("close") > c("sma_200")).alias("pct_above_200"), share(c("stage2")).alias("pct_stage2"), share(c("pct_from_52wk_high") >= -0.15).alias("pct_near_high"))
    score = ladder(c("pct_above_50"), [(0.70, 7.0), (0.55, 5.5), (0.40, 3.5), (0.25, 1.5)]) + ladder(c("pct_stage2"), [(0.60, 7.0), (0.45, 5.0), (0.30, 3.0), (0.15, 1.0)]) + ladder(c("pct_near_high"), [(0.50, 6.0), (0.35, 4.0), (0.20, 2.0), (0.10, 1.0)])
    return df.withColumn("breadth_score", F.when(c("n_symbols") < 5, 10.0).otherwise(score))


def momentum_volatility(index: DataFrame) -> DataFrame:
    """Change over 20 bars (rows -20 to 0) and realised volatility of the last 20 log returns."""
    df = index.where("symbol = 'MAIN'").withColumns({"roc_21": ratio(c("close"), lag("close", 20)) - 1, "_r": F.ln(ratio(c("close"), lag("close")))})
    df = df.withColumn("realized_vol", F.coalesce(rolling(F.stddev_samp, "_r", 20) * F.sqrt(F.lit(252.0)), F.lit(0.20)))
    vol = F.when(c("realized_vol") < 0.12, 7.0).when(c("realized_vol") < 0.15, 6.0).when(c("realized_vol") < 0.20, 4.5).when(c("realized_vol") < 0.25, 2.5).when(c("realized_vol") < 0.35, 1.0).otherwise(0.0)
    points = F.when(c("roc_21").isNull(), 2.0).otherwise(ladder(c("roc_21"), [(0.08, 8.0), (0.04, 6.0), (0.01, 4.0), (-0.01, 2.0), (-0.05, 1.0)]))
    return df.select("bar_date", "roc_21", "realized_vol", (points + vol).alias("momentum_score"))


def universe_volatility(bars: DataFrame) -> DataFrame:
    """-5 where the mean daily return's 21-day deviation is over 1.5 times its 63-day mean. Returns are over the union calendar."""
    days = bars.select("bar_date").distinct().withColumn("day", F.row_number().over(Window.orderBy("bar_date")))
    rows = bars.select("symbol", "bar_date", "close").join(days, "bar_date")
    before = rows.select("symbol", (c("day") + 1).alias("day"), c("close").alias("_before"))
    daily = rows.join(before, ["symbol", "day"], "left").groupBy("bar_date", "day").agg(F.avg(ratio(c("close"), c("_before")) - 1).alias("mean_return"))
    order = Window.orderBy("day")  # a row for each date
    std = F.when(F.count("mean_return").over(order.rowsBetween(-20, 0)) >= 15, F.stddev_samp("mean_return").over(order.rowsBetween(-20, 0)))
    df = daily.withColumn("vol_21", std)
    df = df.withColumn("vol_mean_63", F.when(F.count("vol_21").over(order.rowsBetween(-62, 0)) >= 40, F.avg("vol_21").over(order.rowsBetween(-62, 0))))
    return df.select("bar_date", "vol_21", "vol_mean_63", F.when((c("day") >= 84) & (c("vol_21") > 1.5 * c("vol_mean_63")), -5.0).otherwise(0.0).alias("volatility_penalty"))


def regime_of(score: Column) -> Column:
    out = None
    for low, name, _ in REGIMES:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise("DOWNTREND")


def multiplier_of(regime: Column) -> Column:
    return F.create_map(*(F.lit(x) for _, name, m in REGIMES for x in (name, m)))[regime]


def market_condition(index: DataFrame, features: DataFrame, bars: DataFrame) -> DataFrame:
    """All components joined by index date, the total, the regime and its multiplier."""
    df = index_trend(index).join(distribution_days(index), "bar_date").join(follow_through(index), "bar_date").join(momentum_volatility(index), "bar_date")
    df = df.join(breadth(features), "bar_date", "left").join(universe_volatility(bars), "bar_date", "left")
    total = c("index_trend_score") + c("distribution_score") + c("follow_through_score") + F.coalesce(c("breadth_score"), F.lit(10.0)) + c("momentum_score") + F.coalesce(c("volatility_penalty"), F.lit(0.0))
    df = df.withColumn("score", F.greatest(total, F.lit(0.0))).withColumn("regime", regime_of(c("score")))
    return df.withColumn("multiplier", multiplier_of(c("regime")))


# Macro regime


def choppiness(df: DataFrame, n: int) -> Column:
    spread = rolling(F.max, "high", n) - rolling(F.min, "low", n)
    return F.coalesce(F.when(spread > 0, 100 * F.log10(rolling(F.sum, "true_range", n) / spread) / F.log10(F.lit(float(n)))), F.lit(61.8))


def directional(df: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX by Wilder's means; warm-up counts as zero in the second smoothing."""
    up, down = c("high") - lag("high"), lag("low") - c("low")
    df = df.withColumns({"_up": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)), "_down": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0))})
    df = with_ema(df, {"_atr": ("true_range", 1 / n), "_pdm": ("_up", 1 / n), "_mdm": ("_down", 1 / n)})
    warm = c("i") >= n
    df = df.withColumns({"_p": F.when(warm, 100 * ratio(c("_pdm"), c("_atr"))), "_m": F.when(warm, 100 * ratio(c("_mdm"), c("_atr")))})
    df = df.withColumn("_dx", F.coalesce(100 * ratio(F.abs(c("_p") - c("_m")), c("_p") + c("_m")), F.lit(0.0)))
    df = with_ema(df, {"_adx": ("_dx", 1 / n)})
    return df.withColumns({"plus_di": F.coalesce(c("_p"), F.lit(20.0)), "minus_di": F.coalesce(c("_m"), F.lit(20.0)), "adx": F.when(warm, c("_adx")).otherwise(20.0)}).drop("_up", "_down", "_atr", "_pdm", "_mdm", "_p", "_m", "_dx", "_adx")


def log_regression(n: int) -> tuple[Column, Column]:
    """Annualised slope and R2 of the log price over n bars; zero for a constant price."""
    y, x, frame = F.ln("close"), c("i").cast("double"), last_rows(n)
    enough = F.count("close").over(frame) >= 10
    flat = F.var_pop(y).over(frame) == 0
    return F.when(enough, F.regr_slope(y, x).over(frame) * 252).otherwise(0.0), F.when(enough & ~flat, F.regr_r2(y, x).over(frame)).otherwise(0.0)


def hurst_lags(longest: int) -> list[int]:
    """Whole numbers of 25 steps, even in the logarithm, from 2 to longest; longest itself may round down to the number below."""
    return sorted({int(x) for x in np.logspace(np.log10(2), np.log10(longest), 25)})


def with_hurst(df: DataFrame, n: int = 150, least: int = 30) -> DataFrame:
    """hurst: half the slope of the log variance of lagged differences on the log lag, in [0, 1], over the last n closes, or all
    that there are; lags go up to a third of their number. 0.5 before there are least closes."""
    logs = df.withColumn("_log", F.ln("close"))
    longest = F.least(c("i"), F.lit(n)).cast("long")
    users: dict[int, list[int]] = {}
    for number in range(least, n + 1):
        for k in hurst_lags(number // 3):
            users.setdefault(k, []).append(number)
    logs = logs.withColumns({f"_d{k}": c("_log") - lag("_log", k) for k in users})
    # The last m closes have m - k differences of lag k; the first k rows of a symbol have none.
    logs = logs.withColumns({f"_v{k}": F.when(longest.between(min(m), n) if m == list(range(min(m), n + 1)) else longest.isin(m), F.var_pop(f"_d{k}").over(last_rows(n - k))) for k, m in users.items()})
    points = [(math.log(k), F.ln(F.when(c(f"_v{k}") > 0, c(f"_v{k}")))) for k in users]
    count = sum((y.isNotNull().cast("int") for _, y in points), F.lit(0))
    sx, sy = sum((F.when(y.isNotNull(), x).otherwise(0.0) for x, y in points), F.lit(0.0)), sum((F.coalesce(y, F.lit(0.0)) for _, y in points), F.lit(0.0))
    sxy, sxx = sum((F.coalesce(x * y, F.lit(0.0)) for x, y in points), F.lit(0.0)), sum((F.when(y.isNotNull(), x * x).otherwise(0.0) for x, y in points), F.lit(0.0))
    logs = logs.withColumns({"_n": count, "_sx": sx, "_sy": sy, "_sxy": sxy, "_sxx": sxx})
    slope = (c("_n") * c("_sxy") - c("_sx") * c("_sy")) / (c("_n") * c("_sxx") - c("_sx") * c("_sx"))
    made = ["_log", "_n", "_sx", "_sy", "_sxy", "_sxx", *(f"_{x}{k}" for k in users for x in "dv")]
    return logs.withColumn("hurst", F.when(c("_n") >= 4, clipped(slope / 2, 0.0, 1.0)).otherwise(0.5)).drop(*made)


def macro_signals(index: DataFrame) -> DataFrame:
    df = index.where("symbol = 'MAIN'").withColumn("i", F.row_number().over(by_symbol()).cast("long"))
    before = lag("close")
    df = df.withColumn("true_range", F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)))
    df = with_hurst(directional(df))
    slope21, r21 = log_regression(21)
    slope63, r63 = log_regression(63)
    df = df.withColumns({"ci_14": choppiness(df, 14), "ci_50": choppiness(df, 50), "slope_21": slope21, "r2_21": r21, "slope_63": slope63, "r2_63": r63, "_r": F.ln(ratio(c("close"), before))})
    df = df.withColumns({f"mom_{n}": ratio(c("close"), lag("close", n)) - 1 for n in (21, 63, 126, 252)} | {f"vol_{n}": rolling(F.stddev_samp, "_r", n) * F.sqrt(F.lit(252.0)) for n in (10, 60)})
    signs = sum((F.coalesce(F.signum(f"mom_{n}"), F.lit(0.0)) for n in (21, 63, 126, 252)), F.lit(0.0))
    known = sum((c(f"mom_{n}").isNotNull().cast("int") for n in (21, 63, 126, 252)), F.lit(0))
    df = df.withColumn("_up", is_true(c("close") > before).cast("double"))
    df = df.withColumns(
        {
            "confluence": F.coalesce(ratio(signs, known), F.lit(0.0)), "vol_ratio": ratio(c("vol_10"), c("vol_60")), "vol_rising": is_true((c("vol_10") > 1.1 * lag("vol_10", 20)) & (c("i") >= 32)),
            "trend_consistency": F.avg("_up").over(last_rows(62)), "above_200": rolling(F.avg, "close", 200, 150), "high_63": F.max("high").over(last_rows(63)), "low_63": F.min("low").over(last_rows(63)),
            "drawdown_24m": F.when(c("i") >= 253, ratio(c("close"), F.coalesce(lag("close", 504), F.first("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))) - 1).otherwise(0.0),
        }
    )
    return df.withColumn("above_200", c("close") > c("above_200")).drop("_r", "_up")


#: The regime by direction and quality, and each regime's multiplier.
MATRIX = {
    ("BULLISH", "TRENDING"): "BULL_RUN", ("BULLISH", "TRANSITIONING"): "BULL_TRANSITION", ("BULLISH", "CHOPPY"): "BULL_CHOP", ("NEUTRAL", "TRENDING"): "INFLECTION", ("NEUTRAL", "TRANSITIONING"): "INFLECTION",
    ("NEUTRAL", "CHOPPY"): "CONSOLIDATION", ("BEARISH", "TRANSITIONING"): "BEAR_TRANSITION", ("BEARISH", "TRENDING"): "DOWNTREND", ("BEARISH", "CHOPPY"): "BEAR_CHOP",
}
MULTIPLIERS = {"BULL_RUN": 1.00, "BULL_TRANSITION": 0.92, "BULL_CHOP": 0.82, "INFLECTION": 0.78, "CONSOLIDATION": 0.72, "BEAR_TRANSITION": 0.68, "DOWNTREND": 0.62, "BEAR_CHOP": 0.60}


def ramp(x: Column, low: float, high: float) -> Column:
    return clipped((x - low) / (high - low), 0.0, 1.0)


def macro_regime(signals: DataFrame, panic_floor: float = 0.40) -> DataFrame:
    """Direction (-1 to 1), quality (0 to 1), their classes, the regime and its multiplier after the penalty for volatility."""
    di = F.coalesce(ratio(c("plus_di") - c("minus_di"), F.nullif(c("plus_di") + c("minus_di"), F.lit(0.0))), F.lit(0.0))
    flag = F.when(c("above_200"), 0.5).when(~c("above_200"), -0.5).otherwise(0.0)
    direction = 0.35 * c("confluence") + 0.20 * di + 0.25 * clipped(c("slope_63") / 0.30, -1.0, 1.0) + 0.15 * flag + 0.05 * clipped((c("trend_consistency") - 0.5) * 2, -1.0, 1.0)
    adx = F.when(c("adx") >= 25, 0.5 + 0.5 * ramp(c("adx"), 25, 40)).otherwise(0.5 * ramp(c("adx"), 20, 25))
    quality = 0.30 * adx + 0.30 * (1 - ramp(c("ci_14"), 38.2, 61.8)) + 0.25 * c("r2_63") + 0.10 * ramp(c("hurst"), 0.45, 0.55) + 0.05 * F.abs(c("confluence"))
    df = signals.withColumns({"direction_score": clipped(direction, -1.0, 1.0), "quality_score": clipped(quality, 0.0, 1.0)})
    df = df.withColumns(
        {
            "direction": F.when(c("direction_score") >= 0.20, "BULLISH").when(c("direction_score") <= -0.20, "BEARISH").otherwise("NEUTRAL"),
            "quality": F.when(c("quality_score") >= 0.60, "TRENDING").when(c("quality_score") >= 0.35, "TRANSITIONING").otherwise("CHOPPY"),
            "volatility": F.when(c("vol_60") < 0.12, "CALM").when(c("vol_60") < 0.18, "NORMAL").when(c("vol_60") < 0.28, "ELEVATED").otherwise("EXTREME"),
        }
    )
    names = F.create_map(*(F.lit(x) for (d, q), name in MATRIX.items() for x in (f"{d}/{q}", name)))
    enough = c("i") >= 60
    df = df.withColumn("macro_regime", F.when(enough, names[F.concat_ws("/", "direction", "quality")]).otherwise("CONSOLIDATION"))
    base = F.create_map(*(F.lit(x) for name, m in MULTIPLIERS.items() for x in (name, m)))[c("macro_regime")]
    rough = c("volatility").isin("ELEVATED", "EXTREME")
    penalty = F.when(c("volatility") == "ELEVATED", 0.04).when(c("volatility") == "EXTREME", 0.10).otherwise(0.0) + F.when(rough & c("vol_rising"), 0.03).otherwise(0.0)
    floor = F.when((c("drawdown_24m") < -0.20) & rough, panic_floor).otherwise(0.60)
    return df.withColumn("macro_multiplier", F.when(enough, F.greatest(base - penalty, floor)).otherwise(0.85))


def blended(daily: Column, macro: Column) -> Column:
    return F.greatest(F.lit(0.5), F.floor((0.55 * daily + 0.45 * macro) * 1000 + 0.5) / 1000)
