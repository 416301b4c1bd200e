"""Registered queries of validation reports, weight objectives and conditions as of an entry, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT
from ..functions.rolling import rounded
from ..operators import outcomes as O, research as Q, validation as V, weights as W
from ..sources.bars import bars
from ..sources.scratch import shared, written
from . import condition_sql, labels, market, sql
from .market import Query

c = F.col

#: Scores from here on are taken as selected.
SELECTED = 50
FEATURES = ("raw_score", "base_score", "trend_score", "rs_score", "volume_score", "adr_pct", "prior_move_pct")
DEEP = 0.25


@shared
def _signals(s: SparkSession, d: str) -> DataFrame:
    return market.scored(s, d).where("consol_days >= 5 and close > sma_50").withColumnRenamed("bar_date", "scan_date")


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return V.evaluated(_signals(s, d), bars(s, d))


def _regime(s: SparkSession, d: str) -> DataFrame:
    """(bar_date, regime) of the market condition."""
    return written(labels.condition(s, d).select("bar_date", "regime"), "regime")


def _exits(s: SparkSession, d: str) -> DataFrame:
    """All five strategies over the same trades, which are made once."""
    own = bars(s, d)
    trades = written(O.entries(labels.signals(s, d), own), "trades")
    found = {"fixed_1_5r": O.exit_fixed_r(trades, own, 1.5), "fixed_2r": O.exit_fixed_r(trades, own, 2.0), "fixed_3r": O.exit_fixed_r(trades, own, 3.0), "atr_trail": O.exit_atr_trail(trades, own), "time_15": O.exit_time(trades, own)}
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("strategy"), "scan_date", "r_multiple", "bars_held") for k, df in found.items()))


def _activation(rows: DataFrame) -> DataFrame:
    counts = {f"vcp_{k}": c("vcp_contraction_count") == k for k in range(4)}
    return V.activation(rows, {"obv_trend": c("obv_trend").cast("boolean"), "is_trigger_bar": c("is_trigger_bar"), "weekly_aligned": c("weekly_aligned"), "deep_base": c("base_depth") > DEEP, **counts})


def _by_regime(s: SparkSession, d: str) -> DataFrame:
    own = bars(s, d)
    trades = written(O.entries(labels.signals(s, d), own), "trades")
    rows = O.exit_fixed_r(trades, own, 2.0).join(trades.select("symbol", "scan_date", "entry_date"), ["symbol", "scan_date"])
    return V.by_condition(V.carried(rows, "entry_date", _regime(s, d), "regime"), "regime")


def _objectives(s: SparkSession, d: str) -> DataFrame:
    return W.weight_objectives(_evaluated(s, d), DEFAULT.sub_max)


def queries() -> dict[str, Query]:
    chosen = lambda: c("raw_score") >= SELECTED  # noqa: E731  # made on demand, as columns need a session
    return {
        "breakout_volume": lambda s, d: V.breakout_volume(labels.signals(s, d), bars(s, d)).withColumn("relative_volume", rounded("relative_volume")),
        "precision_recall": lambda s, d: V.precision_recall(_evaluated(s, d), chosen()),
        "score_calibration": lambda s, d: V.calibration(_evaluated(s, d)),
        "rank_sum": lambda s, d: V.rank_sum(_evaluated(s, d), "raw_score", c("confirmed")),
        "predictor_spearman": lambda s, d: V.spearman(_evaluated(s, d), FEATURES, "max_gain_20d"),
        "predictor_buckets": lambda s, d: V.predictor_buckets(_evaluated(s, d)),
        "feature_activation": lambda s, d: _activation(_evaluated(s, d)),
        "prior_move_impact": lambda s, d: V.prior_move_impact(_evaluated(s, d)),
        "validation_summary": lambda s, d: V.validation_summary(_evaluated(s, d)),
        "failure_tally": lambda s, d: V.failure_tally(_evaluated(s, d)),
        "signal_clustering": lambda s, d: V.clustering(_signals(s, d), chosen()),
        "filter_isolation": lambda s, d: V.filter_isolation(V.evaluated(market.scored(s, d).withColumnRenamed("bar_date", "scan_date"), bars(s, d))),
        "weight_objectives": _objectives,
        "best_weights": lambda s, d: W.best_weights(_objectives(s, d), "corr_20d").select("w_base", "w_trend", "w_rs", "w_volume", "value"),
        "entry_conditions": _by_regime,
        "regime_outcomes": lambda s, d: Q.regime_outcomes(O.historical_outcomes(labels.signals(s, d), bars(s, d)), _regime(s, d)),
        "exit_metrics": lambda s, d: V.equity_metrics(_exits(s, d)),
    }


def _base(kept: str = "WHERE consol_days >= 5 AND close > sma_50") -> str:
    """Evaluated signals as ev."""
    return f"""{sql.SCORED}, nb AS (SELECT *, row_number() OVER {sql.w()} AS k FROM bars), sg AS (SELECT *, bar_date AS scan_date FROM scored {kept}),
fo AS (SELECT s.symbol, s.scan_date, b.k - a.k AS n, b.open, b.high, b.low, b.close, s.breakout_level AS bl, s.stop_level AS sl FROM sg s JOIN nb a ON a.symbol = s.symbol AND a.bar_date = s.scan_date JOIN nb b ON b.symbol = s.symbol AND b.k > a.k AND b.k <= a.k + 60),
ou AS (SELECT symbol, scan_date, min(CASE WHEN high > bl THEN n END) AS dbo, min(CASE WHEN close < sl THEN n END) AS dst, max(CASE WHEN n <= 10 THEN high END)/min_by(open, n)-1 AS g10, max(CASE WHEN n <= 20 THEN high END)/min_by(open, n)-1 AS g20, max_by(close, n)/min_by(open, n)-1 AS chg FROM fo GROUP BY 1, 2),
ev AS (SELECT sg.*, dbo, dst, g10, g20, chg, dbo IS NOT NULL AS hit FROM sg JOIN ou ON ou.symbol = sg.symbol AND ou.scan_date = sg.scan_date)"""


def _bucket(x: str, edges: tuple[float, ...], right: bool = False, above: bool = False) -> str:
    low, high = (">", "<=") if right else (">=", "<")
    uppers = [*edges[1:], None] if above else list(edges[1:])
    whens = " ".join(f"WHEN {x} {low} {a!r}e0" + (f" AND {x} {high} {b!r}e0" if b is not None else "") + f" THEN {a!r}e0" for a, b in zip(edges, uppers, strict=False))
    return f"CASE {whens} END"


def _ranks(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0"


def oracle_sql() -> dict[str, str]:
    base, r6 = _base(), sql.r6
    ratio = lambda a, b: f"({a})/nullif(CAST({b} AS DOUBLE), 0)"
    count = lambda cond: f"count(CASE WHEN {cond} THEN 1 END)"
    on = f"raw_score >= {SELECTED}"
    sides = ", ".join(r6(f"{f}(CASE WHEN {side} THEN raw_score END)", f"{name}_{tag}") for tag, side in (("confirmed", "hit"), ("other", "NOT hit")) for name, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop")))
    fires = {"obv_trend": "CAST(obv_trend AS BOOLEAN)", "is_trigger_bar": "is_trigger_bar", "weekly_aligned": "weekly_aligned", "deep_base": "base_depth > 25e-2", **{f"vcp_{k}": f"vcp_contraction_count = {k}" for k in range(4)}}
    spans = ", ".join(r6(f"{f}({x})", f"{name}_{y}") for x, y in (("raw_score", "raw_score"), ("chg", "realized"), ("g20", "max_gain_20d")) for name, f in (("mean", "avg"), ("least", "min"), ("most", "max")))
    parts = ", ".join(r6(f"avg({x})", f"mean_{x}") for x in ("base_score", "trend_score", "rs_score", "volume_score", "prior_move_pct", "adr_pct"))
    shown = lambda v: f"{r6(f'avg({v})', 'mean')}, {r6(f'median({v})', 'median')}, {r6(f'avg(CAST({v} > 0 AS DOUBLE))', 'positive')}"
    masks = {"price": "close >= 5", "dollar_volume": "dollar_volume >= 10000000", "adr": "adr_pct >= 7e-2", "stop": "stop_distance_pct <= 5*greatest(adr_pct, 1e-2)", "high": "pct_from_52wk_high >= -3e-1", "prior_move": "prior_move_pct >= 75e-2", "consol_days": "consol_days >= 5"}
    own = {"adr": "adr_pct", "prior_move": "prior_move_pct", "consol_days": "consol_days", "stop": "stop_distance_20d_pct/greatest(adr_pct, 1e-2)"}
    isolated = " UNION ALL ".join(f"SELECT '{k}' AS filter, {_bucket('(' + x + ')', V.ISOLATED[k][1], above=True)} AS bucket, g20, hit FROM ev WHERE " + " AND ".join(m for n, m in masks.items() if n != k) for k, x in own.items())
    sets = "ws AS (SELECT a, b, r, 100-a-b-r AS v FROM (SELECT unnest(range(10, 51, 10)) AS a), (SELECT unnest(range(10, 51, 10)) AS b), (SELECT unnest(range(10, 51, 10)) AS r) WHERE 100-a-b-r BETWEEN 10 AND 50)"
    clip = lambda k: f"least(greatest({k}_score/{DEFAULT.sub_max[k]}e0, 0), 1)"
    risk = "greatest(coalesce(stop_distance_pct, 5e-2), 1e-3)"
    weighed = f"""{base}, {sets}, kn AS (SELECT {clip('base')} AS cb, {clip('trend')} AS ct, {clip('rs')} AS cr, {clip('volume')} AS cv, g20, g10, chg, CASE WHEN dbo IS NOT NULL AND (dst IS NULL OR dbo <= dst) THEN least(g20, {risk}*10) WHEN dst IS NOT NULL THEN -{risk} ELSE chg END AS sim FROM ev WHERE g20 IS NOT NULL AND g10 IS NOT NULL AND chg IS NOT NULL),
kr AS (SELECT *, {_ranks('g20')} AS r20, {_ranks('g10')} AS r10 FROM kn),
xs AS (SELECT ws.*, floor((a*cb + b*ct + r*cr + v*cv)*100+5e-1) AS x, g20, g10, chg, sim, r20, r10 FROM kr, ws), qs AS (SELECT a, b, r, quantile_cont(x, 75e-2) AS cut FROM xs GROUP BY 1, 2, 3), xt AS (SELECT xs.*, x >= cut AS top, rank() OVER (PARTITION BY a, b, r ORDER BY x) + (count(*) OVER (PARTITION BY a, b, r, x) - 1) / 2e0 AS rx FROM xs JOIN qs USING (a, b, r))"""
    rate4 = lambda x: f"floor(({x})*1e4+5e-1)/1e4"
    composite = r6(f"5e-1*{rate4('corr(x, g20)')} + 5e-1*{rate4(ratio(count('top AND g20 >= 5e-2'), count('top')))}", "composite", 4)
    top = lambda cond: ratio(count(f"top AND {cond}"), count("top"))
    pf = lambda y: ratio(f"sum(CASE WHEN top AND {y} > 0 THEN {y} ELSE 0 END)", f"sum(CASE WHEN top AND {y} < 0 THEN -{y} ELSE 0 END)")
    kinds = {"fixed_1_5r": labels.fixed_exit("15e-1"), "fixed_2r": labels.fixed_exit("2"), "fixed_3r": labels.fixed_exit("3"), "atr_trail": labels.ATR_EXIT, "time_15": labels.TIME_EXIT}
    exits = " UNION ALL ".join(f"(WITH {labels.exit_ctes(*v)} SELECT '{k}' AS strategy, scan_date, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE (fill-entry)/risk END AS r FROM tq)" for k, v in kinds.items())
    won, rate = "CASE WHEN r > 0 THEN r END", "avg(CAST(r > 0 AS DOUBLE))"
    lost = "coalesce(avg(CASE WHEN r <= 0 THEN r END), 0)"
    rates = ", ".join(["count(*) AS n", *(r6(f"avg(CAST({x} IS NOT NULL AS DOUBLE))", y) for x, y in (("dbo", "breakout_rate"), ("dst", "stop_rate"), ("dta", "target_rate"))), r6("avg(g20)", "mean_gain_20d"), r6("avg(d20)", "mean_drawdown_20d")])
    return {
        "breakout_volume": sql.select(
            f"{labels.SIGNALS}, nb AS (SELECT *, row_number() OVER {sql.w()} AS k, avg(volume) OVER {sql.w(20)} AS m FROM bars), h AS (SELECT s.symbol, s.scan_date, b.k - a.k AS n, b.volume, b.m FROM signals s JOIN nb a ON a.symbol = s.symbol AND a.bar_date = s.scan_date JOIN nb b ON b.symbol = s.symbol AND b.k > a.k AND b.close >= s.breakout_level WHERE s.breakout_level > 0 QUALIFY row_number() OVER (PARTITION BY s.symbol, s.scan_date ORDER BY b.k) = 1)",
            f"SELECT symbol, scan_date, n AS days_to_breakout, {r6('CASE WHEN n >= 20 THEN volume/m END', 'relative_volume')} FROM h",
        ),
        "precision_recall": sql.select(base, f"SELECT {count('hit')} AS n_confirmed, {count('NOT hit')} AS n_other, {count('hit AND ' + on)} AS selected_confirmed, {count('NOT hit AND ' + on)} AS selected_other, {r6(ratio(count('hit AND ' + on), count('hit')), 'recall')}, {r6(ratio(count('NOT hit AND ' + on), count('NOT hit')), 'fp_rate')}, {r6(ratio(count('hit AND ' + on), count(on)), 'precision')}, {sides} FROM ev"),
        "score_calibration": sql.select(f"{base}, b AS (SELECT *, {_bucket('raw_score', V.CALIBRATION_EDGES)} AS bucket FROM ev)", f"SELECT bucket, count(*) AS n, {count('hit')} AS n_confirmed, {r6('avg(CAST(hit AS DOUBLE))', 'precision')}, {r6('avg(chg) FILTER (hit)', 'mean_return')}, {r6('median(chg) FILTER (hit)', 'median_return')}, {r6('avg(CAST(chg > 0 AS DOUBLE)) FILTER (hit)', 'win_rate')} FROM b WHERE bucket IS NOT NULL GROUP BY 1"),
        "rank_sum": sql.select(
            f"{base}, k AS (SELECT hit, {_ranks('raw_score')} AS rk FROM ev WHERE raw_score IS NOT NULL), t AS (SELECT sum(CAST(n AS DOUBLE)*n*n - n) AS t FROM (SELECT count(*) AS n FROM ev WHERE raw_score IS NOT NULL GROUP BY raw_score)), u AS (SELECT {count('hit')} AS p, {count('NOT hit')} AS q, sum(CASE WHEN hit THEN rk ELSE 0 END) AS s FROM k), v AS (SELECT p, q, s - p*(p+1)/2e0 AS u, CAST(p AS DOUBLE)*q AS pq, CAST(p+q AS DOUBLE) AS n, t FROM u, t)",
            f"SELECT p AS n_true, q AS n_false, {r6('u', digits=1)}, {r6('u/nullif(pq, 0)', 'auc')}, {r6('(u-pq/2)/nullif(sqrt(pq/12e0*(n+1-t/(n*(n-1)))), 0)', 'z', 4)} FROM v",
        ),
        "predictor_spearman": sql.select(base, " UNION ALL ".join(f"SELECT '{x}' AS feature, count(*) AS n, {r6('corr(a, b)', 'spearman')} FROM (SELECT {_ranks(x)} AS a, {_ranks('g20')} AS b FROM ev WHERE {x} IS NOT NULL AND g20 IS NOT NULL)" for x in FEATURES)),
        "predictor_buckets": sql.select(
            f"{base}, b AS (SELECT 'raw_score' AS feature, floor(raw_score/5)*5 AS bucket, g20 FROM ev UNION ALL SELECT 'adr_pct', {_bucket('adr_pct', V.ADR_EDGES, right=True)}, g20 FROM ev UNION ALL SELECT 'prior_move_pct', {_bucket('prior_move_pct', V.PRIOR_EDGES, right=True)}, g20 FROM ev)",
            f"SELECT feature, bucket, count(g20) AS n, {shown('g20')} FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2",
        ),
        "feature_activation": sql.select(f"{base}, f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, hit, CAST(coalesce({x}, false) AS DOUBLE) AS x FROM ev" for k, x in fires.items()) + ")", f"SELECT feature, count(*) AS n, {r6('avg(x) FILTER (hit)', 'confirmed_rate')}, {r6('avg(x) FILTER (NOT hit)', 'other_rate')}, {r6('avg(x) FILTER (hit) - avg(x) FILTER (NOT hit)', 'lift')} FROM f GROUP BY 1"),
        "prior_move_impact": sql.select(base, f"SELECT hit AS confirmed, count(*) AS n, {count('prior_move_pct < 25e-2')} AS n_blocked, {r6('avg(CASE WHEN prior_move_pct < 25e-2 THEN chg END)', 'blocked_return')}, {r6('max(CASE WHEN prior_move_pct < 25e-2 THEN g20 END)', 'blocked_best')} FROM ev GROUP BY 1"),
        "validation_summary": sql.select(base, f"SELECT hit AS confirmed, count(*) AS n, {count('passes_filters')} AS n_passing, " + ", ".join(f"{count(f'raw_score >= {t}')} AS n_{t}" for t in (50, 60, 70)) + f", {spans}, {parts} FROM ev GROUP BY 1"),
        "failure_tally": sql.select(base, f"SELECT reason, count(*) AS n, {r6('avg(chg)', 'mean_return')}, {r6('avg(g20)', 'mean_gain')} FROM (SELECT unnest(reasons) AS reason, chg, g20 FROM ev WHERE hit) GROUP BY 1"),
        "signal_clustering": sql.select(f"{sql.SCORED}, d AS (SELECT bar_date, count(*) AS n FROM scored WHERE consol_days >= 5 AND close > sma_50 AND {on} GROUP BY 1)", f"SELECT count(*) AS n_dates, {r6('avg(n)', 'mean')}, {r6('stddev_samp(n)', 'std')}, min(n) AS least, " + ", ".join(r6(f"quantile_cont(n, {q})", k) for k, q in (("p50", "5e-1"), ("p75", "75e-2"), ("p90", "9e-1"), ("p95", "95e-2"), ("p99", "99e-2"))) + ", max(n) AS most FROM d"),
        "filter_isolation": sql.select(f"{_base('')}, i AS ({isolated})", f"SELECT filter, bucket, count(*) AS n, {r6('avg(g20)', 'mean_gain')}, {r6('avg(CAST(g20 > 0 AS DOUBLE))', 'win_rate')}, {r6('avg(CAST(hit AS DOUBLE))', 'breakout_rate')} FROM i WHERE bucket IS NOT NULL GROUP BY 1, 2"),
        "weight_objectives": sql.select(
            weighed,
            f"SELECT CAST(a AS DOUBLE) AS w_base, CAST(b AS DOUBLE) AS w_trend, CAST(r AS DOUBLE) AS w_rs, CAST(any_value(v) AS DOUBLE) AS w_volume, count(*) AS n, {r6('corr(x, g20)', 'corr_20d', 4)}, {r6('corr(x, g10)', 'corr_10d', 4)}, {r6('corr(x, chg)', 'corr_realized', 4)}, {r6('corr(rx, r20)', 'spearman_20d', 4)}, {r6('corr(rx, r10)', 'spearman_10d', 4)}, {count('top')} AS n_top, {r6(top('chg > 0'), 'win_rate', 4)}, {r6(pf('chg'), 'profit_factor', 4)}, {r6('avg(chg) FILTER (top)', 'mean_realized', 4)}, {r6(top('g20 >= 5e-2'), 'peak_rate', 4)}, {r6('avg(g20) FILTER (top)', 'mean_peak', 4)}, {r6(pf('sim'), 'sim_pf', 4)}, {r6(top('sim > 0'), 'sim_win_rate', 4)}, {composite} FROM xt GROUP BY 1, 2, 3",
        ),
        "best_weights": sql.select(weighed, f"SELECT CAST(a AS DOUBLE) AS w_base, CAST(b AS DOUBLE) AS w_trend, CAST(r AS DOUBLE) AS w_rs, CAST(v AS DOUBLE) AS w_volume, value FROM (SELECT a, b, r, any_value(v) AS v, {r6('corr(x, g20)', 'value', 4)} FROM xt GROUP BY 1, 2, 3) WHERE value IS NOT NULL ORDER BY value DESC, a, b, r LIMIT 1"),
        "entry_conditions": sql.select(
            f"{labels.exit_ctes(*labels.fixed_exit('2'))}, {condition_sql.CONDITION}, e AS (SELECT coalesce(tq.n, 0) AS n, CASE WHEN tq.n IS NULL THEN 0 ELSE (fill-tq.entry)/risk END AS r, t.entry_date FROM tq JOIN trades t USING (symbol, scan_date))",
            f"SELECT regime, count(*) AS n, {r6(rate, 'win_rate', 3)}, {r6('avg(r)', 'mean_r', 3)}, {r6('avg(e.n)', 'mean_bars', 3)} FROM e ASOF LEFT JOIN mc ON e.entry_date >= mc.bar_date GROUP BY 1",
        ),
        "regime_outcomes": sql.select(
            f"{labels.FWD}, {condition_sql.CONDITION}, o AS (SELECT symbol, scan_date, min(CASE WHEN high > breakout_level THEN n END) AS dbo, min(CASE WHEN close < stop_level THEN n END) AS dst, min(CASE WHEN high > target_level THEN n END) AS dta, max(CASE WHEN n <= 20 THEN high END)/min_by(open, n)-1 AS g20, min(CASE WHEN n <= 20 THEN low END)/min_by(open, n)-1 AS d20 FROM fw GROUP BY 1, 2)",
            f"SELECT coalesce(mc.regime, 'UNKNOWN') AS regime, {rates} FROM o LEFT JOIN mc ON o.scan_date = mc.bar_date GROUP BY 1",
        ),
        "exit_metrics": sql.select(
            f"x AS ({exits}), d AS (SELECT strategy, scan_date, sum(ln(greatest(1+r*5e-3, 1e-9))) AS g FROM x GROUP BY 1, 2), e AS (SELECT *, sum(g) OVER (PARTITION BY strategy ORDER BY scan_date ROWS UNBOUNDED PRECEDING) AS e FROM d), f AS (SELECT *, greatest(max(e) OVER (PARTITION BY strategy ORDER BY scan_date ROWS UNBOUNDED PRECEDING), 0) AS p FROM e), h AS (SELECT strategy, sum(g) AS log_equity, exp(min(e - p))-1 AS dd FROM f GROUP BY 1), s AS (SELECT strategy, count(*) AS n, {rate} AS a, coalesce(avg({won}), 0) AS b, {lost} AS c, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS down, avg(r) AS m, avg(n) AS bars FROM x GROUP BY 1)",
            f"SELECT strategy, n, {r6('a', 'win_rate', 4)}, {r6('b', 'mean_win', 4)}, {r6('c', 'mean_loss', 4)}, {r6('a*b+(1-a)*c', 'expectancy', 4)}, {r6('up/nullif(down, 0)', 'profit_factor', 4)}, {r6('m', 'mean_r', 4)}, {r6('up-down', 'total_r', 4)}, {r6('bars', 'mean_bars', 4)}, {r6('log_equity', digits=4)}, {r6('dd', 'max_drawdown', 4)}, floor(exp(log_equity)/pow(1e1, floor(log10(exp(log_equity)))-5)+5e-1)*pow(1e1, floor(log10(exp(log_equity)))-5) AS equity FROM s JOIN h USING (strategy)",
        ),
    }
