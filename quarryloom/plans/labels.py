"""Registered queries of regimes, forward labels, exits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rolling import rounded
from ..operators import outcomes as O, regime as R, reports as P
from ..sources.bars import bars, index_bars, sectors
from ..sources.scratch import shared
from . import condition_sql, market, sql
from .market import Query

c = F.col


@shared
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the base test: a tight base of five days above its 50-day mean."""
    rows = market.featured(spark, sf_dir).where("consol_days >= 5 and close > sma_50")
    return rows.select("symbol", F.col("bar_date").alias("scan_date"), F.col("close").alias("price"), "breakout_level", "stop_level", "target_level")


SIGNALS = f"{sql.FEATURES}, signals AS (SELECT symbol, bar_date AS scan_date, close AS price, breakout_level, stop_level, target_level FROM features WHERE consol_days >= 5 AND close > sma_50)"
#: Bars with their numbers, what the next one has, and the mean true range of 14 bars up to it.
NUMBERED = f"""nb0 AS (SELECT *, CASE WHEN {sql.lag('close')} IS NOT NULL THEN greatest(high-low, abs(high-{sql.lag('close')}), abs(low-{sql.lag('close')})) END AS tr FROM bars),
nb1 AS (SELECT *, avg(tr) OVER {sql.w(14)} AS a14 FROM nb0),
nb AS (SELECT *, row_number() OVER {sql.w()} AS k, lead(bar_date) OVER {sql.w()} AS nd, lead(open) OVER {sql.w()} AS no, lead(low) OVER {sql.w()} AS nl,
  lead(a14) OVER {sql.w()} AS na FROM nb1)"""
FWD = f"""{SIGNALS}, {NUMBERED},
fw AS (SELECT s.*, b.bar_date, b.open, b.high, b.low, b.close, b.k - a.k AS n FROM signals s
  JOIN nb a ON a.symbol = s.symbol AND a.bar_date = s.scan_date JOIN nb b ON b.symbol = s.symbol AND b.k > a.k AND b.k <= a.k + 60)"""
TRADES = f"""{FWD},
tr0 AS (SELECT s.symbol, s.scan_date, na, nd AS entry_date, no*1001e-3 AS entry, least(nl, no*1001e-3*98e-2) AS stop FROM signals s
  JOIN nb ON nb.symbol = s.symbol AND nb.bar_date = s.scan_date WHERE nd IS NOT NULL),
trades AS (SELECT *, CASE WHEN na > 0 THEN na ELSE entry - stop END AS atr FROM tr0),
tb AS (SELECT t.*, entry - stop AS risk, b.bar_date, b.open, b.high, b.low, b.close, b.k - a.k AS n FROM trades t
  JOIN nb a ON a.symbol = t.symbol AND a.bar_date = t.entry_date LEFT JOIN nb b ON b.symbol = t.symbol AND b.k > a.k AND b.k <= a.k + 30
  WHERE entry > stop)"""


def exit_ctes(extra: str, ends: str, fill: str, reason: str, hold: int, window: str = "") -> str:
    """Common table expressions up to tq: each trade's first bar that ends it, or its last one."""
    return f"{TRADES}, tx AS (SELECT *{extra} FROM tb WHERE n <= {hold} OR n IS NULL{window}), tz AS (SELECT symbol, scan_date, n, coalesce({ends}, false) AS ends, CASE WHEN n IS NULL THEN entry ELSE {fill} END AS fill, CASE WHEN n IS NULL THEN 'no_data' ELSE {reason} END AS reason, entry, risk FROM tx), tq AS (SELECT * FROM tz QUALIFY row_number() OVER (PARTITION BY symbol, scan_date ORDER BY CASE WHEN ends THEN 0 ELSE 1 END, CASE WHEN ends THEN n ELSE -n END) = 1)"


def _exit_sql(extra: str, ends: str, fill: str, reason: str, hold: int, window: str = "") -> str:
    return sql.select(exit_ctes(extra, ends, fill, reason, hold, window), f"SELECT symbol, scan_date, coalesce(n, 0) AS bars_held, reason AS exit_reason, {sql.r6('fill', 'exit_price')}, {sql.r6('(fill-entry)/risk', 'r_multiple')} FROM tq")


def fixed_exit(target: str) -> tuple:
    return (f", entry+{target}*risk AS target", "low <= stop OR high >= target OR n >= 30", "CASE WHEN low <= stop THEN least(open, stop) WHEN high >= target THEN greatest(open, target) ELSE close END", "CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' WHEN n >= 30 THEN 'time' ELSE 'eod' END", 30)


ATR_EXIT = (
    ", greatest(entry, max(high) OVER so_far) AS water, max(CAST(high >= entry + risk AS INT)) OVER so_far = 1 AS active, CASE WHEN max(CAST(high >= entry + risk AS INT)) OVER so_far = 1 THEN greatest(stop, greatest(entry, max(high) OVER so_far) - 2*atr) ELSE stop END AS trail",
    "low <= trail OR n >= 30", "CASE WHEN low <= trail THEN least(open, trail) ELSE close END", "CASE WHEN low <= trail AND active THEN 'trail_stop' WHEN low <= trail THEN 'stop' WHEN n >= 30 THEN 'time' ELSE 'eod' END", 30,
    " WINDOW so_far AS (PARTITION BY symbol, scan_date ORDER BY n ROWS UNBOUNDED PRECEDING)",
)
TIME_EXIT = ("", "low <= stop OR n >= 15", "CASE WHEN low <= stop THEN least(open, stop) ELSE close END", "CASE WHEN low <= stop THEN 'stop' WHEN n >= 15 THEN 'time' ELSE 'eod' END", 15)


def _exits(df: DataFrame) -> DataFrame:
    return df.select("symbol", "scan_date", "bars_held", "exit_reason", rounded("exit_price").alias("exit_price"), rounded("r_multiple").alias("r_multiple"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


def condition(s: SparkSession, d: str) -> DataFrame:
    return R.market_condition(index_bars(s, d), market.featured(s, d), bars(s, d))


def queries() -> dict[str, Query]:
    trades = lambda s, d: O.entries(signals(s, d), bars(s, d))
    return {
        "index_trend": lambda s, d: _rounded(R.index_trend(index_bars(s, d)), "slope", "index_trend_score"),
        "distribution_days": lambda s, d: R.distribution_days(index_bars(s, d)),
        "follow_through": lambda s, d: _rounded(R.follow_through(index_bars(s, d)), "follow_through_score"),
        "breadth": lambda s, d: _rounded(R.breadth(market.featured(s, d)), "pct_above_50", "pct_above_200", "pct_stage2", "pct_near_high"),
        "momentum_volatility": lambda s, d: _rounded(R.momentum_volatility(index_bars(s, d)), "roc_21", "realized_vol"),
        "universe_volatility": lambda s, d: _rounded(R.universe_volatility(bars(s, d)), "vol_21", "vol_mean_63"),
        "market_condition": lambda s, d: _rounded(condition(s, d).select("bar_date", "score", "regime", "multiplier"), "score"),
        "macro_regime": lambda s, d: _rounded(R.macro_regime(R.macro_signals(index_bars(s, d))).select("bar_date", "adx", "ci_14", "r2_63", "hurst", "direction_score", "quality_score", "macro_regime", "macro_multiplier"), "adx", "ci_14", "r2_63", "hurst", "direction_score", "quality_score"),
        "choppiness_adx": lambda s, d: _rounded(R.macro_signals(index_bars(s, d)).select("bar_date", "ci_14", "ci_50", "adx", "plus_di", "minus_di"), "ci_14", "ci_50", "adx", "plus_di", "minus_di"),
        "blend_multiplier": lambda s, d: condition(s, d).join(R.macro_regime(R.macro_signals(index_bars(s, d))), "bar_date").select("bar_date", R.blended(c("multiplier"), c("macro_multiplier")).alias("multiplier")),
        "outcomes_live": lambda s, d: _rounded(O.live_outcomes(signals(s, d), bars(s, d)), "entry_price", "pct_change", "max_gain_10d", "max_gain_20d", "max_gain_60d", "max_drawdown_20d"),
        "outcomes_historical": lambda s, d: _rounded(O.historical_outcomes(signals(s, d), bars(s, d)), "entry_price", "max_gain_10d", "max_gain_20d", "max_gain_60d", "max_drawdown_20d"),
        "forward_returns": lambda s, d: _rounded(O.forward_returns(signals(s, d).select("symbol", "scan_date"), bars(s, d)), "entry", "fwd_5", "fwd_10", "fwd_20", "fwd_60"),
        "entry_next_open": lambda s, d: _rounded(trades(s, d).select("symbol", "scan_date", "entry_date", "entry", "stop"), "entry", "stop"),
        "entry_breakout": lambda s, d: _rounded(O.breakout_entries(signals(s, d), bars(s, d)), "entry", "stop"),
        "exit_fixed_r": lambda s, d: _exits(O.exit_fixed_r(trades(s, d), bars(s, d), 2.0)),
        "exit_atr_trail": lambda s, d: _exits(O.exit_atr_trail(trades(s, d), bars(s, d))),
        "exit_time": lambda s, d: _exits(O.exit_time(trades(s, d), bars(s, d))),
        "score_buckets": lambda s, d: P.score_buckets(_labelled(s, d)),
        "signal_thresholds": lambda s, d: P.signal_thresholds(_labelled(s, d)),
        "score_correlation": lambda s, d: P.correlations(_labelled(s, d), ["base_score", "trend_score", "rs_score", "volume_score"], "fwd_20"),
        "monthly_returns": lambda s, d: P.monthly_returns(index_bars(s, d).where("symbol = 'MAIN'")),
        "pending_outcomes": lambda s, d: P.pending(signals(s, d).select("symbol", "scan_date"), O.historical_outcomes(signals(s, d), bars(s, d)).where("days_elapsed >= 60"), 10),
        "backtest_trades": lambda s, d: P.portfolio(s, _labelled(s, d), bars(s, d)),
        "walk_forward_folds": lambda s, d: P.walk_forward(bars(s, d)),
        "trade_paths": lambda s, d: P.trade_paths(trades(s, d), bars(s, d)).select("symbol", "scan_date", "bars_held", "exit_date", "exit_reason", rounded("r_multiple").alias("r_multiple")),
        "block_bootstrap": lambda s, d: P.block_bootstrap(_labelled(s, d)),
        "sector_concentration": lambda s, d: P.sector_concentration(_labelled(s, d), sectors(s, d)),
        "pairwise_corr": lambda s, d: P.pair_correlations(bars(s, d)),
        "rank_correlation": lambda s, d: P.rank_correlation(_labelled(s, d).withColumn("year", F.year("scan_date").cast("long")), "year", "raw_score", "fwd_20"),
    }


@shared
def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Scored rows of tight bases with their forward returns."""
    rows = market.scored(s, d).where("consol_days >= 5 and close > sma_50").withColumn("scan_date", c("bar_date"))
    rows = rows.select("symbol", "scan_date", "base_score", "trend_score", "rs_score", "volume_score", "raw_score")
    return O.forward_returns(rows, bars(s, d))


LABELLED = f"{sql.SCORED}, fx AS (SELECT symbol, bar_date, lead(close, 21) OVER {sql.w()}/lead(open, 1) OVER {sql.w()}-1 AS fwd_20 FROM bars), labelled AS (SELECT scored.*, fwd_20 FROM scored JOIN fx USING (symbol, bar_date) WHERE consol_days >= 5 AND close > sma_50)"


def oracle_sql() -> dict[str, str]:
    idx = f"{sql.INDEX}, m0 AS (SELECT *, row_number() OVER {sql.w()} AS i, {sql.lag('close')} AS pc, {sql.lag('volume')} AS pv, " + ", ".join(f"{sql.rn('avg', 'close', n)} AS sma_{n}" for n in (10, 20, 50, 150, 200)) + " FROM index_bars)"
    gain = lambda base: ", ".join(sql.r6(f"max(CASE WHEN n <= {n} THEN high END)/{base}-1", f"max_gain_{n}d") for n in (10, 20, 60)) + ", " + sql.r6(f"min(CASE WHEN n <= 20 THEN low END)/{base}-1", "max_drawdown_20d")
    hit = lambda cond: f"min(CASE WHEN {cond} THEN n END)"
    share = lambda cond: f"avg(CAST(coalesce({cond}, false) AS DOUBLE))"
    return {
        "index_trend": sql.select(
            f"""{idx}, m1 AS (SELECT *, {" + ".join(f"CAST(coalesce(close > sma_{n}, false) AS INT)" for n in (10, 20, 50, 150, 200))} + CAST(coalesce(sma_200 > {sql.lag('sma_200', 19)}, false) AS INT) AS hits, coalesce(close > sma_200, false) AS a200, coalesce(sma_50/{sql.lag('sma_50', 9)}-1, 0) AS slope FROM m0),
o AS (SELECT bar_date, max(CASE WHEN symbol = 'WIDE' THEN CASE WHEN i < 200 THEN 15e-1 WHEN a200 THEN 3e0 ELSE 0e0 END END) AS w, max(CASE WHEN symbol = 'SMALL' THEN CASE WHEN i < 200 THEN 15e-1 WHEN a200 THEN 3e0 ELSE 0e0 END END) AS s FROM m1 WHERE symbol <> 'MAIN' GROUP BY 1)""",
            f"SELECT m1.bar_date, CAST(hits AS BIGINT) AS hits, {sql.r6('slope')}, {sql.r6('least(CASE WHEN a200 THEN hits*25e-1 ELSE least(hits*25e-1, 5) END + CASE WHEN slope > 15e-3 THEN 4 WHEN slope > 5e-3 THEN 25e-1 WHEN slope > 0 THEN 1 ELSE 0 END + coalesce(w, 15e-1) + coalesce(s, 15e-1), 25)', 'index_trend_score')} FROM m1 LEFT JOIN o USING (bar_date) WHERE symbol = 'MAIN'",
        ),
        "distribution_days": sql.select(
            f"{idx}, m1 AS (SELECT bar_date, i, CAST(sum(CAST(coalesce(close/pc-1 <= -2e-3 AND volume > pv, false) AS INT)) OVER {sql.w(25)} AS BIGINT) AS distribution_days, CAST(sum(CAST(coalesce(close/pc-1 > 0 AND close/pc-1 < 2e-3 AND volume > pv*105e-2, false) AS INT)) OVER {sql.w(25)} AS BIGINT) AS stalling_days FROM m0 WHERE symbol = 'MAIN')",
            "SELECT bar_date, distribution_days, stalling_days, CASE WHEN i < 26 THEN 15e0 WHEN distribution_days >= 5 THEN 0e0 ELSE greatest(20e0-4*distribution_days-2*stalling_days, 0) END AS distribution_score FROM m1",
        ),
        "breadth": sql.select(
            f"{sql.FEATURES}, b AS (SELECT bar_date, count(*) AS n_symbols, {share('close > sma_50')} AS p50, {share('close > sma_200')} AS p200, {share('stage2')} AS ps, {share('pct_from_52wk_high >= -15e-2')} AS ph FROM features GROUP BY 1)",
            f"SELECT bar_date, n_symbols, {sql.r6('p50', 'pct_above_50')}, {sql.r6('p200', 'pct_above_200')}, {sql.r6('ps', 'pct_stage2')}, {sql.r6('ph', 'pct_near_high')}, CASE WHEN n_symbols < 5 THEN 10e0 ELSE {sql.steps('p50', [('7e-1', '7e0'), ('55e-2', '55e-1'), ('4e-1', '35e-1'), ('25e-2', '15e-1')])} + {sql.steps('ps', [('6e-1', '7e0'), ('45e-2', '5e0'), ('3e-1', '3e0'), ('15e-2', '1e0')])} + {sql.steps('ph', [('5e-1', '6e0'), ('35e-2', '4e0'), ('2e-1', '2e0'), ('1e-1', '1e0')])} END AS breadth_score FROM b",
        ),
        "follow_through": sql.select(f"{sql.INDEX}, {condition_sql.INDEX}, {condition_sql.FOLLOW}", f"SELECT bar_date, found AS ftd_found, CAST(ago AS BIGINT) AS ftd_days_ago, valid AS ftd_valid, {sql.r6('score', 'follow_through_score')} FROM follow"),
        "market_condition": sql.select(f"{sql.FEATURES}, {condition_sql.CONDITION}", f"SELECT bar_date, {sql.r6('score')}, regime, multiplier FROM mc"),
        "momentum_volatility": sql.select(
            f"{idx}, m1 AS (SELECT *, ln(close/pc) AS r, close/{sql.lag('close', 20)}-1 AS roc_21 FROM m0 WHERE symbol = 'MAIN'), m2 AS (SELECT *, coalesce({sql.rn('stddev_samp', 'r', 20)}*sqrt(252e0), 2e-1) AS rv FROM m1)",
            f"SELECT bar_date, {sql.r6('roc_21')}, {sql.r6('rv', 'realized_vol')}, CASE WHEN roc_21 IS NULL THEN 2e0 ELSE {sql.steps('roc_21', [('8e-2', '8e0'), ('4e-2', '6e0'), ('1e-2', '4e0'), ('-1e-2', '2e0'), ('-5e-2', '1e0')])} END + CASE WHEN rv < 12e-2 THEN 7e0 WHEN rv < 15e-2 THEN 6e0 WHEN rv < 2e-1 THEN 45e-1 WHEN rv < 25e-2 THEN 25e-1 WHEN rv < 35e-2 THEN 1e0 ELSE 0e0 END AS momentum_score FROM m2",
        ),
        "universe_volatility": sql.select(
            f"{sql.BARS}, cal AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS day FROM (SELECT DISTINCT bar_date FROM bars)), x AS (SELECT * FROM bars JOIN cal USING (bar_date)), y AS (SELECT a.bar_date, a.day, avg(a.close/b.close-1) AS mr FROM x a LEFT JOIN x b ON a.symbol = b.symbol AND a.day = b.day + 1 GROUP BY 1, 2), z AS (SELECT *, CASE WHEN count(mr) OVER q >= 15 THEN stddev_samp(mr) OVER q END AS v21 FROM y WINDOW q AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), zz AS (SELECT *, CASE WHEN count(v21) OVER q >= 40 THEN avg(v21) OVER q END AS m63 FROM z WINDOW q AS (ORDER BY day ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))",
            f"SELECT bar_date, {sql.r6('v21', 'vol_21')}, {sql.r6('m63', 'vol_mean_63')}, CASE WHEN day >= 84 AND v21 > 15e-1*m63 THEN -5e0 ELSE 0e0 END AS volatility_penalty FROM zz",
        ),
        "outcomes_live": sql.select(
            FWD.replace(" AND b.k <= a.k + 60", ""),
            f"SELECT symbol, scan_date, {sql.r6('first(price)', 'entry_price')}, max(n) AS days_elapsed, {sql.r6('max_by(close, n)/first(price)-1', 'pct_change')}, {hit('close >= breakout_level')} AS days_to_breakout, {hit('low <= stop_level')} AS days_to_stop, {hit('high >= target_level')} AS days_to_target, {gain('first(price)')}, {hit('close >= breakout_level')} IS NOT NULL AS breakout_triggered, {hit('low <= stop_level')} IS NOT NULL AS stop_triggered, {hit('high >= target_level')} IS NOT NULL AS target_reached FROM fw GROUP BY 1, 2",
        ),
        "outcomes_historical": sql.select(
            FWD,
            f"SELECT symbol, scan_date, {sql.r6('min_by(open, n)', 'entry_price')}, max(n) AS days_elapsed, max_by(bar_date, n) AS outcome_date, {hit('high > breakout_level')} AS days_to_breakout, {hit('close < stop_level')} AS days_to_stop, {hit('high > target_level')} AS days_to_target, {gain('min_by(open, n)')} FROM fw GROUP BY 1, 2",
        ),
        "forward_returns": sql.select(
            f"{SIGNALS}, fx AS (SELECT symbol, bar_date, lead(open) OVER {sql.w()} AS entry, " + ", ".join(f"lead(close, {h + 1}) OVER {sql.w()}/lead(open) OVER {sql.w()}-1 AS fwd_{h}" for h in (5, 10, 20, 60)) + " FROM bars)",
            f"SELECT s.symbol, s.scan_date, {sql.r6('entry')}, " + ", ".join(sql.r6(f"fwd_{h}") for h in (5, 10, 20, 60)) + " FROM signals s JOIN fx ON fx.symbol = s.symbol AND fx.bar_date = s.scan_date",
        ),
        "entry_next_open": sql.select(TRADES, f"SELECT symbol, scan_date, entry_date, {sql.r6('entry')}, {sql.r6('stop')} FROM trades"),
        "entry_breakout": sql.select(
            f"{FWD}, h AS (SELECT fw.*, nd, no, nl FROM fw JOIN nb ON nb.symbol = fw.symbol AND nb.bar_date = fw.bar_date WHERE n <= 15 AND fw.close >= breakout_level QUALIFY row_number() OVER (PARTITION BY fw.symbol, scan_date ORDER BY n) = 1), e AS (SELECT symbol, scan_date, coalesce(nd, bar_date) AS entry_date, coalesce(no, close)*1001e-3 AS entry, nd, low, nl FROM h)",
            f"SELECT symbol, scan_date, entry_date, {sql.r6('entry')}, {sql.r6('CASE WHEN nd IS NULL THEN low ELSE least(nl, entry*98e-2) END', 'stop')} FROM e",
        ),
        "exit_fixed_r": _exit_sql(*fixed_exit("2")),
        "exit_atr_trail": _exit_sql(*ATR_EXIT),
        "exit_time": _exit_sql(*TIME_EXIT),
        "score_buckets": sql.select(LABELLED, f"SELECT CAST(floor(raw_score/5)*5 AS BIGINT) AS bucket, count(fwd_20) AS n, {sql.r6('avg(fwd_20)', 'mean_return')}, {sql.r6('avg(CAST(fwd_20 > 0 AS DOUBLE))', 'win_rate')} FROM labelled GROUP BY 1"),
        "signal_thresholds": sql.select(LABELLED, "SELECT CAST(t AS BIGINT) AS threshold, count(*) AS n, count(DISTINCT bar_date) AS n_dates, count(DISTINCT symbol) AS n_symbols FROM labelled, (SELECT unnest(range(40, 85, 5)) AS t) WHERE raw_score >= t GROUP BY 1"),
        "score_correlation": sql.select(LABELLED, " UNION ALL ".join(f"SELECT '{x}' AS feature, count(fwd_20) AS n, {sql.r6(f'corr({x}, fwd_20)', 'correlation')} FROM labelled" for x in ("base_score", "trend_score", "rs_score", "volume_score"))),
        "monthly_returns": sql.select(
            f"{sql.INDEX}, m AS (SELECT date_trunc('month', bar_date) AS month, max_by(close, bar_date) AS close FROM index_bars WHERE symbol = 'MAIN' GROUP BY 1), r AS (SELECT month, close/lag(close) OVER (ORDER BY month)-1 AS r FROM m)",
            "SELECT CAST(year(month) AS BIGINT) AS year, " + ", ".join(sql.r6(f"max(CASE WHEN month(month) = {k} THEN r END)", f"m{k}") for k in range(1, 13)) + ", " + sql.r6("product(1+r)-1", "total") + " FROM r GROUP BY 1",
        ),
        "sector_concentration": sql.select(
            f"{LABELLED}, st AS (SELECT symbol, p_type AS sector FROM (SELECT p_brand AS symbol, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, p_type DESC) = 1), top AS (SELECT bar_date, symbol FROM labelled QUALIFY row_number() OVER (PARTITION BY bar_date ORDER BY raw_score DESC, symbol) <= 10), k AS (SELECT bar_date, sector, count(*) AS k FROM top LEFT JOIN st USING (symbol) GROUP BY 1, 2)",
            f"SELECT bar_date AS scan_date, CAST(sum(k) AS BIGINT) AS n, {sql.r6('max(k)/CAST(sum(k) AS DOUBLE)', 'max_share')}, {sql.r6('sum(k*k)/(CAST(sum(k) AS DOUBLE)*sum(k))', 'hhi')} FROM k GROUP BY 1 HAVING sum(k) >= 3",
        ),
        "pairwise_corr": sql.select(
            f"{sql.BARS}, r AS (SELECT symbol, bar_date, close/{sql.lag('close')}-1 AS r FROM bars)",
            f"SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {sql.r6('corr(x.r, y.r)', 'correlation')} FROM r x JOIN r y ON x.bar_date = y.bar_date AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60",
        ),
        "pending_outcomes": sql.select(
            f"{FWD}, done AS (SELECT symbol, scan_date FROM fw GROUP BY 1, 2 HAVING max(n) >= 60), last AS (SELECT max(scan_date) AS d FROM signals)",
            "SELECT symbol, scan_date FROM signals s ANTI JOIN done USING (symbol, scan_date), last WHERE d - scan_date >= 10",
        ),
    }
