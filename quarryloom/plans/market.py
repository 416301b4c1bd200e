"""Registered queries of the market scan: features, cross-section, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rolling import rounded
from ..operators import features as X, regime as R, scoring as S, validation as V
from ..sources.bars import BAR_COLUMNS, bars, coverage, earnings, index_bars
from ..sources.scratch import written
from . import condition_sql, sql

Query = Callable[[SparkSession, str], DataFrame]

#: Feature queries: the columns to show (those with digits are rounded) and the steps that make them.
FEATURE_QUERIES: dict[str, dict[str, int | None]] = {
    "sma": {"sma_50": 7, "sma_150": 7, "sma_200": 7},
    "ema": {"sma_10": 6, "sma_20": 6},
    "ma_relationships": {"distance_from_sma10": 6, "distance_from_sma20": 6, "distance_from_sma50": 6, "distance_from_sma150": 6, "distance_from_sma200": 6, "ma_slope_10": 6, "ma_slope_20": 6, "ma_slope_50": 6, "ma_alignment": None, "mas_rising": None},
    "stage2": {"stage2": None},
    "atr": {"true_range": 6, "atr_20": 6},
    "range_metrics": {"daily_range": 6, "daily_range_pct": 6, "adr_pct": 6, "close_range_position": 6},
    "volume_metrics": {"volume_sma_20": 4, "relative_volume": 6, "dollar_volume": 2},
    "volume_trend": {"volume_trend": 2},
    "volume_dryup": {"volume_dryup_ratio": 6, "volume_declining": None, "volume_vs_6m_avg": 6},
    "consolidation": {"consol_range_60": 6, "is_tight_consolidation": None, "consol_days": None},
    "breakout_level": {"breakout_level": 6},
    "base_depth": {"base_depth": 6, "days_from_high": None},
    "prior_move": {"prior_move_pct": 6, "is_power_move": None, "days_since_power_move": None},
    "higher_lows": {"higher_lows": None, "swing_low_count": None},
    "lower_highs": {"lower_highs": None, "swing_high_count": None},
    "ema_surf": {"ema10_surf_ratio": 6},
    "obv": {"obv": 1, "obv_slope": 1, "obv_trend": None},
    "trigger_bar": {"is_trigger_bar": None},
    "weekly_alignment": {"weekly_aligned": None},
    "tsmom": {"abs_return_63d": 6, "abs_return_126d": 6},
    "proximity_52wk": {"pct_from_52wk_high": 6, "pct_from_90d_high": 6, "approaching_annual_high": None},
    "vcp_contractions": {"range_10": 6, "range_20": 6, "range_40": 6, "vcp_contraction_count": None, "vcp_contracting": None, "vcp_contraction_ratio": 6},
    "stops": {"stop_level": 6, "stop_distance_pct": 6, "stop_distance_20d_pct": 6, "trailing_stop_triggered": None},
    "risk_reward": {"target_level": 6, "potential_gain_pct": 6, "potential_r": 6},
    "relative_strength": {"rs_comp_20": 6, "rs_comp_60": 6, "rs_comp_120": 6, "rs_comp_252": 6},
    "asof_benchmark": {"bench_close": 6},
}
WHOLE = {"consol_days", "days_from_high", "days_since_power_move", "swing_low_count", "swing_high_count", "vcp_contraction_count"}


def main_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(spark, sf_dir).where("symbol = 'MAIN'")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.all_features(bars(spark, sf_dir), main_index(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, failed: str = "keep") -> DataFrame:
    rows = bars(spark, sf_dir)
    ranks = X.rs_rank(rows).select("symbol", "bar_date", "rs_rank")
    return S.scored(X.all_features(rows, main_index(spark, sf_dir)).join(ranks, ["symbol", "bar_date"]), failed=failed)


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with all that a live scan adds: analysts, the earnings penalty, the multiplier of the market's regime as of the date (1 before
    there is one); rows that fail a filter show zeros. The features are written, as the market's breadth and the scores read them."""
    rows, index = bars(spark, sf_dir), index_bars(spark, sf_dir)
    plain = written(X.all_features(rows, index.where("symbol = 'MAIN'")), "features")
    condition = written(R.market_condition(index, plain, rows).select("bar_date", "multiplier"), "condition")
    ranks = X.rs_rank(rows).select("symbol", "bar_date", "rs_rank")
    dated = V.carried(plain.join(ranks, ["symbol", "bar_date"]), "bar_date", condition, "multiplier")
    whole = S.days_to_earnings(dated, earnings(spark, sf_dir)).join(coverage(spark, sf_dir), "symbol", "left")
    multiplier = F.coalesce("multiplier", F.lit(1.0))
    return S.scored(whole, coverage="n_analysts", days_to_earnings="days_to_earnings", multiplier=multiplier, failed="zero")


def _show(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    shown = [F.col(k).cast("long").alias(k) if k in WHOLE else F.col(k) if d is None else rounded(k, d).alias(k) for k, d in columns.items()]
    return df.select("symbol", "bar_date", *shown)


def _sql(columns: dict[str, int | None]) -> str:
    return ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in WHOLE else k if d is None else sql.r6(k, digits=d) for k, d in columns.items())


SCORES: dict[str, dict[str, int | None]] = {
    "score_base": {"base_score": 6}, "score_trend": {"trend_score": 6}, "score_rs": {"rs_score": 6, "rs_rank": 6}, "score_volume": {"volume_score": 6}, "score_rr": {"rr_score": 6},
    "total_score": {"raw_score": 6, "total_score": 6, "grade": None, "signal": None, "passes_filters": None},
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "bars": lambda s, d: bars.__wrapped__(s, d).select(*BAR_COLUMNS),  # read once, so not written first
        "index_bars": lambda s, d: index_bars.__wrapped__(s, d).select(*BAR_COLUMNS),
        "rs_rank": lambda s, d: X.rs_rank(bars(s, d)).select("symbol", "bar_date", rounded("ret").alias("ret"), rounded("rs_rank").alias("rs_rank")),
        "hard_filters": lambda s, d: S.filtered(featured(s, d)).select("symbol", "bar_date", "passes_filters", F.array_join("filter_reasons", ",").alias("reasons")),
        "filter_failures": lambda s, d: S.filtered(featured(s, d)).select(F.explode("filter_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
        "watchlist": lambda s, d: S.watchlist(scored(s, d)).select(F.col("rank").cast("long").alias("rank"), "symbol", "bar_date", rounded("total_score").alias("total_score"), "grade"),
        "live_scan": live_scan,
        "adjusted_score": lambda s, d: adjusted(s, d).select("symbol", "bar_date", "days_to_earnings", *(rounded(x).alias(x) for x in ("trend_score", "raw_score", "total_score")), "grade", "signal"),
        "rs_calibration": lambda s, d: S.calibrated(scored(s, d)).select("symbol", "bar_date", rounded("rs_pct").alias("rs_pct"), rounded("rs_score").alias("rs_score"), rounded("raw_score").alias("raw_score"), "grade"),
    }
    for name, columns in FEATURE_QUERIES.items():
        found[name] = lambda s, d, columns=columns: _show(featured(s, d), columns)
    for name, columns in SCORES.items():
        found[name] = lambda s, d, columns=columns: _show(scored(s, d), columns)
    return found


def live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row per symbol as it is saved: scores are null when a filter fails."""
    rows = scored(spark, sf_dir, failed="null")
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("bar_date", "close", "raw_score", "grade", "passes_filters"), "bar_date").alias("x")).select("symbol", "x.*")
    return last.select("symbol", "bar_date", rounded("close").alias("price"), rounded("raw_score").alias("raw_score"), "grade", "passes_filters")


def oracle_sql() -> dict[str, str]:
    found = {
        "bars": sql.select(sql.BARS, "SELECT * FROM bars"),
        "index_bars": sql.select(sql.INDEX, "SELECT * FROM index_bars"),
        "rs_rank": sql.select(sql.FEATURES, f"SELECT symbol, bar_date, {sql.r6('ret')}, {sql.r6('rs_rank')} FROM ranks"),
        "hard_filters": sql.select(sql.SCORED, "SELECT symbol, bar_date, passes_filters, array_to_string(reasons, ',') AS reasons FROM scored"),
        "filter_failures": sql.select(sql.SCORED, "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM scored) GROUP BY reason"),
        "watchlist": sql.select(sql.SCORED, f"SELECT row_number() OVER (ORDER BY total_score DESC, symbol) AS rank, symbol, bar_date, {sql.r6('total_score')}, grade FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1) WHERE passes_filters"),
        "live_scan": sql.select(sql.SCORED, f"SELECT symbol, bar_date, {sql.r6('close', 'price')}, {sql.r6('CASE WHEN passes_filters THEN raw_score END', 'raw_score')}, CASE WHEN passes_filters THEN grade END AS grade, passes_filters FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1"),
        "adjusted_score": sql.select(
            f"""{sql.SCORED}, {condition_sql.CONDITION},
ek AS (SELECT p_partkey % 25 AS k, min(p_brand) AS symbol FROM part GROUP BY 1),
ed AS (SELECT symbol, min(CAST(o_orderdate AS DATE)) AS d FROM orders JOIN ek ON o_orderkey % 25 = k GROUP BY symbol, date_trunc('quarter', CAST(o_orderdate AS DATE))),
cv AS (SELECT symbol, n FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS nk FROM (SELECT DISTINCT p_brand AS symbol FROM part)) LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON nk = s_nationkey),
a0 AS (SELECT s.*, CAST(ed.d - s.bar_date AS BIGINT) AS dte FROM scored s ASOF LEFT JOIN ed ON s.symbol = ed.symbol AND s.bar_date <= ed.d),
a1 AS (SELECT a0.*, least(greatest(t1 + CASE WHEN n IS NULL THEN 0 WHEN n = 0 THEN 2 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 0 ELSE -1 END, 0), 14) AS tr FROM a0 LEFT JOIN cv USING (symbol)),
a2 AS (SELECT *, greatest(base_score/20e0*10e0 + tr/14e0*15e0 + rs_score/30e0*25e0 + volume_score/30e0*50e0 - CASE WHEN dte BETWEEN 0 AND 5 THEN 10e0 WHEN dte BETWEEN 0 AND 10 THEN 5e0 ELSE 0e0 END, 0) AS ra FROM a1),
a3 AS (SELECT symbol, a2.bar_date, dte, passes_filters AS ok, coalesce(multiplier, 1) AS mult, CASE WHEN passes_filters THEN tr ELSE 0e0 END AS tr, CASE WHEN passes_filters THEN ra ELSE 0e0 END AS raw_score FROM a2 ASOF LEFT JOIN mc ON a2.bar_date >= mc.bar_date)""",
            f"SELECT symbol, bar_date, dte AS days_to_earnings, {sql.r6('tr', 'trend_score')}, {sql.r6('raw_score')}, {sql.r6('raw_score*mult', 'total_score')}, CASE WHEN ok THEN {sql.GRADE} ELSE '' END AS grade, CASE WHEN ok THEN {sql.steps('raw_score*mult', [('80', chr(39) + 'STRONG BUY - Alert' + chr(39)), ('70', chr(39) + 'BUY - Watch Closely' + chr(39)), ('60', chr(39) + 'HOLD - Monitor' + chr(39))], chr(39) + 'PASS' + chr(39))} ELSE '' END AS signal FROM a3",
        ),
        "rs_calibration": sql.select(
            f"""{sql.SCORED},
k0 AS (SELECT symbol, bar_date, rs_score, raw_score, rs_comp_60, passes_filters, CASE WHEN rs_comp_60 IS NOT NULL THEN (rank() OVER (PARTITION BY bar_date, rs_comp_60 IS NULL ORDER BY rs_comp_60) + (count(*) OVER (PARTITION BY bar_date, rs_comp_60) - 1) / 2e0) / count(rs_comp_60) OVER (PARTITION BY bar_date) * 100 END AS rs_pct FROM scored),
k1 AS (SELECT *, CASE WHEN max(CAST(passes_filters AS INT)) OVER (PARTITION BY bar_date) = 1 AND count(rs_comp_60) OVER (PARTITION BY bar_date) >= 2 THEN {sql.RANK.replace('rs_rank', 'rs_pct')} ELSE 0e0 END AS pts FROM k0),
k2 AS (SELECT symbol, bar_date, rs_pct, rs_score + pts AS rs_score, raw_score + pts AS raw_score FROM k1)""",
            f"SELECT symbol, bar_date, {sql.r6('rs_pct')}, {sql.r6('rs_score')}, {sql.r6('raw_score')}, {sql.GRADE} AS grade FROM k2",
        ),
    }
    for name, columns in FEATURE_QUERIES.items():
        found[name] = sql.select(sql.FEATURES, f"SELECT symbol, bar_date, {_sql(columns)} FROM features")
    for name, columns in SCORES.items():
        found[name] = sql.select(sql.SCORED, f"SELECT symbol, bar_date, {_sql(columns)} FROM scored")
    return found
