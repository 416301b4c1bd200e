"""Registered queries of stored scans, research reports and trading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT
from ..functions.rolling import rounded
from ..operators import outcomes as O, research as Q, trading as T
from ..sources import store
from ..sources.bars import bars, index_bars
from ..sources.scratch import shared
from . import labels, market, sql
from .market import Query

c = F.col


@shared
def scans(s: SparkSession, d: str) -> DataFrame:
    """Every scored row as a row of the scans table."""
    rows = market.scored(s, d)
    return rows.select(c("bar_date").alias("scan_date"), "symbol", "passes_filters", c("total_score").alias("score"), "raw_score", "stop_distance_20d_pct", "adr_pct")


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return O.historical_outcomes(labels.signals(s, d), bars(s, d))


def _quality(s: SparkSession, d: str) -> DataFrame:
    return market.scored(s, d).select("symbol", "bar_date", T.quality_score().alias("quality"))


def _filtered_returns(s: SparkSession, d: str) -> DataFrame:
    rows = market.scored(s, d).select("symbol", c("bar_date").alias("scan_date"), "filter_reasons")
    return O.forward_returns(rows, bars(s, d), (20,))


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """Scans of which every symbol's last rows come again with another score; the later ones win."""
    old = scans(s, d).select("scan_date", "symbol", "raw_score")
    new = old.where(F.month("scan_date") == 12).withColumn("raw_score", c("raw_score") + 1)
    return store.merged(old, new, store.KEYS["scans"]).select("scan_date", "symbol", rounded("raw_score").alias("raw_score"))


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    rows = scans(s, d).select("scan_date", "symbol", "adr_pct")
    staged = rows.where(F.month("scan_date") == 6).withColumn("adr_pct", F.lit(None).cast("double"))
    return store.backfilled(rows, staged, ("scan_date", "symbol"), ("adr_pct",)).select("scan_date", "symbol", rounded("adr_pct").alias("adr_pct"))


def _sized(s: SparkSession, d: str) -> DataFrame:
    trades = O.entries(labels.signals(s, d), bars(s, d))
    return trades.select("symbol", "scan_date", T.position_size(F.lit(100_000.0), c("entry"), c("stop")).cast("long").alias("shares"))


def queries() -> dict[str, Query]:
    labelled = labels._labelled
    return {
        "scan_summary": lambda s, d: store.summary(scans(s, d)),
        "load_scans": lambda s, d: store.load(scans(s, d), passed_only=True, min_raw_score=50.0).select("scan_date", "symbol", rounded("raw_score").alias("raw_score")),
        "upsert_latest": _upserted,
        "backfill_columns": _backfilled,
        "recompute_features": lambda s, d: market.featured(s, d).select("symbol", "bar_date", rounded("rs_comp_252").alias("rs_comp_252"), rounded("stop_distance_20d_pct").alias("stop_distance_20d_pct"), rounded("adr_pct").alias("adr_pct")),
        "score_brackets": lambda s, d: Q.score_brackets(labelled(s, d), _outcomes(s, d)),
        "filter_effectiveness": lambda s, d: Q.filter_effectiveness(_filtered_returns(s, d)),
        "weight_suggestions": lambda s, d: Q.weight_suggestions(labelled(s, d)),
        "signal_validity": lambda s, d: Q.signal_validity(labelled(s, d)),
        "weight_grid": lambda s, d: Q.weight_grid(labelled(s, d), DEFAULT.sub_max),
        "time_split": lambda s, d: Q.time_split(labelled(s, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("scan_date").alias("first_date"), F.max("scan_date").alias("last_date")),
        "holdout_split": lambda s, d: Q.holdout(labelled(s, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("scan_date").alias("first_date"), F.max("scan_date").alias("last_date")),
        "standard_differences": lambda s, d: Q.standard_differences(labelled(s, d), c("raw_score") >= 50, ("base_score", "trend_score", "rs_score", "volume_score")),
        "quintiles": lambda s, d: Q.quintiles(labelled(s, d), "raw_score"),
        "trailing_outcomes": lambda s, d: labels._rounded(Q.trailing_outcomes(labels.signals(s, d), bars(s, d)), "entry", "trailing_return", "max_gain", "max_drawdown"),
        "exit_sweep": lambda s, d: Q.exit_sweep(O.entries(labels.signals(s, d), bars(s, d)), bars(s, d)),
        "quality_score": _quality,
        "position_size": _sized,
        "index_gate": lambda s, d: T.gated(labels.signals(s, d).select("symbol", "scan_date"), T.index_gate(index_bars(s, d))),
    }


def oracle_sql() -> dict[str, str]:
    labelled = labels.LABELLED
    quality = "floor((35e-2*volume_score/30 + 25e-2*rs_score/30 + 25e-2*coalesce(least(greatest((prior_move_pct-75e-2)/225e-2, 0), 1), 0) + 1e-1*base_score/20 + 5e-2*coalesce(least(greatest((consol_days-5)/3e1, 0), 1), 0))*1000+5e-1)/10"
    rates = ", ".join(
        [f"count(*) AS n, {sql.r6('avg(CAST(days_to_breakout IS NOT NULL AS DOUBLE))', 'breakout_rate')}", sql.r6("avg(CAST(days_to_stop IS NOT NULL AS DOUBLE))", "stop_rate"), sql.r6("avg(CAST(days_to_target IS NOT NULL AS DOUBLE))", "target_rate"), sql.r6("avg(max_gain_20d)", "mean_gain_20d"), sql.r6("avg(max_drawdown_20d)", "mean_drawdown_20d")]
    )
    hit = lambda cond: f"min(CASE WHEN {cond} THEN n END)"
    after = f"fs AS (SELECT s.symbol, s.bar_date AS scan_date, raw_score, b.bar_date, b.open, b.high, b.low, b.close, b.k - a.k AS n, s.breakout_level, s.stop_level, s.target_level FROM labelled s JOIN nb a ON a.symbol = s.symbol AND a.bar_date = s.bar_date JOIN nb b ON b.symbol = s.symbol AND b.k > a.k AND b.k <= a.k + 60)"
    grouped = f"ho AS (SELECT symbol, scan_date, any_value(raw_score) AS raw_score, {hit('high > breakout_level')} AS days_to_breakout, {hit('close < stop_level')} AS days_to_stop, {hit('high > target_level')} AS days_to_target, max(CASE WHEN n <= 20 THEN high END)/min_by(open, n)-1 AS max_gain_20d, min(CASE WHEN n <= 20 THEN low END)/min_by(open, n)-1 AS max_drawdown_20d FROM fs GROUP BY 1, 2)"
    numbered = f"nb AS (SELECT *, row_number() OVER {sql.w()} AS k FROM bars)"
    fwd = "fx AS (SELECT symbol, bar_date, " + ", ".join(f"lead(close, {h + 1}) OVER {sql.w()}/lead(open, 1) OVER {sql.w()}-1 AS fwd_{h}" for h in (5, 10, 20, 60)) + " FROM bars)"
    return {
        "scan_summary": sql.select(sql.SCORED, "SELECT count(*) AS n_scans, count(CASE WHEN passes_filters THEN 1 END) AS n_passed, count(DISTINCT bar_date) AS n_dates, count(DISTINCT symbol) AS n_symbols, min(bar_date) AS first_date, max(bar_date) AS last_date FROM scored"),
        "load_scans": sql.select(sql.SCORED, f"SELECT bar_date AS scan_date, symbol, {sql.r6('raw_score')} FROM scored WHERE passes_filters AND raw_score >= 50"),
        "upsert_latest": sql.select(sql.SCORED, f"SELECT bar_date AS scan_date, symbol, {sql.r6('CASE WHEN month(bar_date) = 12 THEN raw_score + 1 ELSE raw_score END', 'raw_score')} FROM scored"),
        "backfill_columns": sql.select(sql.SCORED, f"SELECT bar_date AS scan_date, symbol, {sql.r6('CASE WHEN month(bar_date) <> 6 THEN adr_pct END', 'adr_pct')} FROM scored"),
        "recompute_features": sql.select(sql.FEATURES, f"SELECT symbol, bar_date, {sql.r6('rs_comp_252')}, {sql.r6('stop_distance_20d_pct')}, {sql.r6('adr_pct')} FROM features"),
        "score_brackets": sql.select(f"{labelled}, {numbered}, {after}, {grouped}", f"SELECT CAST(CASE WHEN raw_score >= 90 THEN 90 WHEN raw_score >= 80 THEN 80 WHEN raw_score >= 70 THEN 70 WHEN raw_score >= 60 THEN 60 ELSE 0 END AS BIGINT) AS bracket, {rates} FROM ho GROUP BY 1"),
        "filter_effectiveness": sql.select(
            f"{sql.SCORED}, {fwd}, m AS (SELECT coalesce(reasons[1], 'none') AS reason, count(fwd_20) AS n, avg(fwd_20) AS m FROM scored JOIN fx USING (symbol, bar_date) GROUP BY 1)",
            f"SELECT reason, n, {sql.r6('m', 'mean_return')}, m < 8e-1*(SELECT m FROM m WHERE reason = 'none') AS effective FROM m",
        ),
        "weight_suggestions": sql.select(
            f"{labelled}, k AS (" + " UNION ALL ".join(f"SELECT '{x}' AS component, coalesce(abs(corr({x}, fwd_20)), 0) AS v FROM labelled" for x in ("base_score", "trend_score", "rs_score", "volume_score")) + ")",
            f"SELECT component, {sql.r6('100*v/nullif((SELECT sum(v) FROM k), 0)', 'weight', 4)} FROM k",
        ),
        "signal_validity": sql.select(
            f"{sql.SCORED}, {fwd}, l AS (SELECT raw_score, fx.* FROM scored JOIN fx USING (symbol, bar_date) WHERE consol_days >= 5 AND close > sma_50), u AS (" + " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, raw_score, fwd_{h} AS r FROM l WHERE fwd_{h} IS NOT NULL" for h in (5, 10, 20, 60)) + ")",
            f"SELECT horizon, count(*) AS n, {sql.r6('avg(CAST(r > 0 AS DOUBLE))', 'hit_rate')}, {sql.r6('avg(r)', 'mean_return')}, {sql.r6('quantile_cont(r, 5e-1)', 'median_return')}, {sql.r6('avg(CASE WHEN r > 0 THEN r END)', 'mean_win')}, {sql.r6('avg(CASE WHEN r <= 0 THEN r END)', 'mean_loss')}, {sql.r6('corr(raw_score, r)', 'correlation')}, CASE WHEN avg(CAST(r > 0 AS DOUBLE)) >= 55e-2 THEN 'strong' WHEN avg(CAST(r > 0 AS DOUBLE)) >= 5e-1 THEN 'weak' ELSE 'none' END AS edge FROM u GROUP BY 1",
        ),
        "standard_differences": sql.select(labelled, " UNION ALL ".join(f"SELECT '{x}' AS feature, " + sql.r6(f"(avg({x}) FILTER (raw_score >= 50) - avg({x}) FILTER (raw_score < 50))/nullif(sqrt((var_samp({x}) FILTER (raw_score >= 50) + var_samp({x}) FILTER (raw_score < 50))/2), 0)", "smd") + " FROM labelled" for x in ("base_score", "trend_score", "rs_score", "volume_score"))),
        "quality_score": sql.select(sql.SCORED, f"SELECT symbol, bar_date, {quality} AS quality FROM scored"),
        "position_size": sql.select(labels.TRADES, "SELECT symbol, scan_date, CASE WHEN entry - stop > 0 THEN CAST(least(greatest(floor(500e0/(entry-stop)), 1), floor(20000e0/entry)) AS BIGINT) END AS shares FROM trades"),
        "index_gate": sql.select(
            f"{labels.SIGNALS}, g AS (SELECT bar_date, close > avg(close) OVER (ORDER BY bar_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gate_open FROM index_bars WHERE symbol = 'MAIN')",
            "SELECT s.symbol, s.scan_date, coalesce(g.gate_open, true) AS gate_open FROM signals s ASOF LEFT JOIN g ON s.scan_date >= g.bar_date",
        ),
    }
