"""Score ladders, hard filters, grades and the watchlist: expressions over one feature row. In a ladder the first match wins and a
missing value matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, ScanConfig
from ..functions.rolling import is_true, percent_rank, ratio, safe_max

c = F.col


def ladder(value: Column, steps: list[tuple[float, float]], otherwise: float = 0.0, below: bool = False) -> Column:
    """Points of the first step whose bound the value reaches (or stays within)."""
    out = None
    for bound, points in steps:
        hit = value <= F.lit(bound) if below else value >= F.lit(bound)
        out = F.when(hit, F.lit(points)) if out is None else out.when(hit, F.lit(points))
    return out.otherwise(F.lit(otherwise))


def base_parts(cfg: ScanConfig = DEFAULT) -> dict[str, Column]:
    days, lows, highs = c("consol_days"), c("swing_low_count"), c("swing_high_count")
    count = c("vcp_contraction_count")
    return {
        "tightness": ladder(ratio(c("range_10"), safe_max(c("adr_pct"), 0.01)), [(0.75, 6.0), (1.25, 5.0), (2.0, 4.0), (3.5, 2.0)], below=True),
        "length": F.when(days > 60, 1.0).otherwise(ladder(days, [(35, 4.0), (20, 3.5), (10, 3.0), (5, 2.5)])),
        "vcp": F.when(count.isNotNull(), ladder(count, [(3, 4.0), (2, 3.0), (1, 2.0)])).when(c("vcp_contracting"), 2.0).when(c("vcp_contraction_ratio") <= 0.6, 0.5).otherwise(0.0),
        "wedge": F.when((lows >= 2) & (highs >= 2), 6.0).when((lows >= 1) & (highs >= 1) & (lows + highs >= 3), 4.5).when((lows >= 1) & (highs >= 1), 3.0).when(lows >= 2, 2.0).when(lows >= 1, 1.0).otherwise(0.0),
        "trigger": F.when(c("is_trigger_bar"), 1.5).otherwise(0.0),
    }


def base_score(cfg: ScanConfig = DEFAULT) -> Column:
    return F.least(sum(base_parts(cfg).values(), F.lit(0.0)), F.lit(20.0))


def trend_score(cfg: ScanConfig = DEFAULT, coverage: str | None = None) -> Column:
    """Steps in order: means, prior move, near the annual high, weekly penalty, absolute momentum (if on), coverage, cap."""
    aligned, rising, surfed, moved, days = c("ma_alignment"), c("mas_rising"), c("ema10_surf_ratio"), c("prior_move_pct"), c("days_since_power_move")
    score = F.when(aligned & rising, ladder(surfed, [(0.75, 4.0), (0.5, 3.5)], 3.0)).when(aligned, ladder(surfed, [(0.65, 2.0)], 1.0)).when(c("sma_10") > c("sma_20"), 0.5).otherwise(0.0)
    score += F.when((moved >= 2.0) & (days <= 60), 8.0).when((moved >= 1.0) & (days <= 60), 7.0).when((moved >= 0.75) & (days <= 60), 5.5).when((moved >= 0.75) & (days <= 90), 4.0).otherwise(0.0)
    score += F.when(c("approaching_annual_high") & (c("consol_days") >= 10), 2.0).otherwise(0.0)
    score = F.when(~c("weekly_aligned"), F.greatest(score - 5.0, F.lit(0.0))).otherwise(score)
    if cfg.use_tsmom:
        score = F.when(c("abs_return_63d") < 0, F.greatest(score - 3.0, F.lit(0.0))).otherwise(score)
    if cfg.use_coverage and coverage:
        n = c(coverage)
        score = F.greatest(score + F.when(n.isNull(), 0.0).when(n == 0, 2.0).when(n <= 2, 1.0).when(n <= 5, 0.0).otherwise(-1.0), F.lit(0.0))
    return F.least(score, F.lit(14.0))


def rank_points(rank: Column) -> Column:
    return ladder(rank, [(95.0, 8.0), (85.0, 10.0), (75.0, 7.0), (65.0, 4.0)])


def rs_score(rank: str | None = "rs_rank") -> Column:
    score = ladder(c("rs_comp_60"), [(0.50, 12.0), (0.25, 9.0), (0.12, 6.0), (0.0, 2.0)]) + ladder(c("rs_comp_120"), [(0.20, 8.0), (0.10, 6.0), (0.04, 3.0), (0.0, 1.0)])
    return score + rank_points(c(rank)) if rank else score


def dryup_score() -> Column:
    """Only within a base of five days; later steps adjust earlier ones, in order."""
    r, days = c("volume_dryup_ratio"), c("consol_days") >= 5
    s = F.when(c("volume_declining") & (r < 0.6), 14.0).when(c("volume_declining") & (r < 0.75), 10.5).when(c("volume_declining") & (r < 0.9), 7.0).when(r < 1.0, 3.5).otherwise(0.0)
    s = F.when((c("relative_volume") < 0.70) & (s < 14), F.least(s + F.when(c("relative_volume") < 0.5, 2.0).otherwise(1.0), F.lit(14.0))).otherwise(s)
    s = F.when((c("close_range_position") >= 0.7) & (s >= 7), F.least(s + 0.5, F.lit(14.0))).otherwise(s)
    s = F.when(c("obv_trend"), F.least(s + F.when(s >= 7, 2.0).otherwise(1.0), F.lit(14.0))).otherwise(s)
    s = F.when(c("volume_vs_6m_avg") > 0.90, F.greatest(s - 2.0, F.lit(0.0))).otherwise(s)
    return F.when(days, s).otherwise(0.0)


def adr_points() -> Column:
    a = c("adr_pct")
    return F.when((a >= 0.12) & (a < 0.15), 10.0).when((a >= 0.15) & (a <= 0.20), 9.0).when((a > 0.20) & (a < 0.25), 5.5).otherwise(ladder(a, [(0.25, 2.0), (0.10, 7.5), (0.08, 5.0), (0.07, 2.5)]))


def volume_score(cfg: ScanConfig = DEFAULT) -> Column:
    m = cfg.dollar_volume_min
    return ladder(c("dollar_volume"), [(10 * m, 6.0), (5 * m, 5.0), (2 * m, 4.0), (m, 2.5)]) + dryup_score() + adr_points()


def rr_score() -> Column:
    """For display; no part of the total."""
    x = ratio(c("stop_distance_pct"), safe_max(c("adr_pct"), 0.01))
    stop = F.when((x >= 0.5) & (x <= 1), 10.0).when(x < 0.5, 3.0).otherwise(ladder(x, [(1.5, 8.0), (2.0, 5.0), (2.5, 3.0)], below=True))
    return stop + ladder(c("potential_r"), [(5.0, 5.0), (4.0, 4.0), (3.0, 3.0), (2.0, 1.5)])


def filter_checks(cfg: ScanConfig = DEFAULT) -> dict[str, Column]:
    """Conditions of failure by name; a missing value fails nothing."""
    adr, stop = safe_max(c("adr_pct"), 0.01), c("stop_distance_20d_pct")
    high = F.greatest(F.coalesce(c("pct_from_52wk_high"), F.lit(-1.0)), F.coalesce(c("pct_from_90d_high"), F.lit(-1.0)))
    moved = c("prior_move_pct") < cfg.min_prior_move
    return {
        "price": c("close") < cfg.min_price, "dollar_volume": c("dollar_volume") < cfg.dollar_volume_min, "below_sma50": c("close") < c("sma_50"), "adr": c("adr_pct") < cfg.min_adr,
        "stop_distance": (stop > cfg.stop_adr_multiple * adr) | (stop < 0.001), "from_high": high < -cfg.max_from_high, "prior_move": (c("prior_move_pct").isNull() | moved) if cfg.missing_prior_move_fails else moved,
        "consolidation": c("consol_days") < cfg.min_consol_days, "relative_strength": c("rs_comp_252") < 0,
    }


def filtered(df: DataFrame, cfg: ScanConfig = DEFAULT) -> DataFrame:
    """filter_reasons (all that fail, in order) and passes_filters."""
    reasons = F.filter(F.array(*(F.when(is_true(check), F.lit(name)) for name, check in filter_checks(cfg).items())), lambda x: x.isNotNull())
    return df.withColumn("filter_reasons", reasons).withColumn("passes_filters", F.size("filter_reasons") == 0)


def grade(raw: Column) -> Column:
    out = None
    for bound, name in ((90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "C+"), (60, "C")):
        out = F.when(raw >= bound, name) if out is None else out.when(raw >= bound, name)
    return out.otherwise("D")


def signal(total: Column, cfg: ScanConfig = DEFAULT) -> Column:
    return F.when(total >= cfg.strong_buy, "STRONG BUY - Alert").when(total >= cfg.buy, "BUY - Watch Closely").when(total >= cfg.watch, "HOLD - Monitor").otherwise("PASS")


def scored(df: DataFrame, cfg: ScanConfig = DEFAULT, *, rank: str | None = "rs_rank", coverage: str | None = None, days_to_earnings: str | None = None, multiplier: Column | float = 1.0, failed: str = "zero") -> DataFrame:
    """Components, raw and total score, grade and signal. multiplier: a regime's, one for all
    rows or a column. failed: what rows that fail a filter show, "zero", "null" or "keep"."""
    parts = {"base": base_score(cfg), "trend": trend_score(cfg, coverage), "rs": rs_score(rank), "volume": volume_score(cfg)}
    df = filtered(df, cfg).withColumns({f"{k}_score": v for k, v in parts.items()} | {"rr_score": rr_score()})
    raw = sum((c(f"{k}_score") / cfg.sub_max[k] * cfg.weights[k] for k in parts), F.lit(0.0))
    if days_to_earnings:
        d = c(days_to_earnings)
        raw = F.greatest(raw - F.when((d >= 0) & (d <= 5), 10.0).when((d >= 0) & (d <= 10), 5.0).otherwise(0.0), F.lit(0.0))
    df = df.withColumn("raw_score", raw).withColumn("total_score", c("raw_score") * multiplier)
    df = df.withColumns({"grade": grade(c("raw_score")), "signal": signal(c("total_score"), cfg)})
    if failed == "keep":
        return df
    numbers = [*(f"{k}_score" for k in parts), "rr_score", "raw_score", "total_score"]
    empty = (lambda text: F.lit(None)) if failed == "null" else (lambda text: F.lit("") if text else F.lit(0.0))
    return df.withColumns({n: F.when(c("passes_filters"), c(n)).otherwise(empty(False)) for n in numbers} | {n: F.when(c("passes_filters"), c(n)).otherwise(empty(True)) for n in ("grade", "signal")})


def days_to_earnings(df: DataFrame, earnings: DataFrame) -> DataFrame:
    """days_to_earnings: calendar days to the symbol's next date in earnings (symbol, earnings_date), 0 on the day itself; null after the last."""
    points = earnings.select("symbol", c("earnings_date").alias("bar_date"), F.lit(False).alias("_own")).distinct()
    own = df.select("symbol", "bar_date", F.lit(True).alias("_own"))
    day = F.datediff("bar_date", F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy("symbol").orderBy(day).rangeBetween(0, Window.unboundedFollowing)
    both = own.unionByName(points).withColumn("days_to_earnings", (F.min(F.when(~c("_own"), day)).over(ahead) - day).cast("long"))
    return df.join(both.where("_own").select("symbol", "bar_date", "days_to_earnings"), ["symbol", "bar_date"])


def watchlist(scores: DataFrame) -> DataFrame:
    """Each symbol's last row, if it passes, ranked by score."""
    last = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    rows = scores.withColumn("_n", F.row_number().over(last)).where("_n = 1 and passes_filters")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_score"), "symbol"))).drop("_n")


def calibrated(scores: DataFrame) -> DataFrame:
    """Points for the percentile of rs_comp_60 among a date's rows, where one passes and two have a value; added to rs and raw score."""
    day = Window.partitionBy("bar_date")
    df = scores.withColumn("rs_pct", percent_rank("rs_comp_60", "bar_date"))
    usable = (F.max(c("passes_filters").cast("int")).over(day) == 1) & (F.count("rs_comp_60").over(day) >= 2)
    df = df.withColumn("_points", F.when(usable, F.coalesce(rank_points(c("rs_pct")), F.lit(0.0))).otherwise(0.0))
    df = df.withColumns({"rs_score": c("rs_score") + c("_points"), "raw_score": c("raw_score") + c("_points")})
    return df.withColumn("grade", grade(c("raw_score"))).drop("_points")
