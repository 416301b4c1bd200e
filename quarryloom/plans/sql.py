"""The same definitions as SQL for DuckDB, written apart from the operators: common table expressions that queries select from."""

from __future__ import annotations


def bars_from(source: str, name: str) -> str:
    """Bars of the rows (symbol, bar_date, l_discount, l_tax, l_quantity) of a source."""
    return f"""
{name}_d AS (SELECT symbol, bar_date, SUM(CAST(round(l_discount*100) AS BIGINT)) AS sd, SUM(CAST(round(l_tax*100) AS BIGINT)) AS st,
  SUM(CAST(l_quantity AS BIGINT)) AS q, COUNT(*) AS n FROM ({source}) GROUP BY 1, 2),
{name}_r AS (SELECT *, CAST(round(((sd-5*n)/sqrt(CAST(n AS DOUBLE)))*16e1) AS BIGINT) AS ret FROM {name}_d),
{name}_c AS (SELECT *, SUM(ret) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_r),
{name}_p AS (SELECT symbol, bar_date, floor((5e1*exp(cum/1e4))*1e4+5e-1)/1e4 AS close, floor((5e1*exp((cum-ret)/1e4))*1e4+5e-1)/1e4 AS open,
  CAST(st AS DOUBLE)/n AS tx, q*20000 AS volume FROM {name}_c),
{name} AS (SELECT symbol, bar_date, open, floor((greatest(open,close)*(1+tx/2e2))*1e4+5e-1)/1e4 AS high,
  floor((least(open,close)*(1-tx/2e2))*1e4+5e-1)/1e4 AS low, close, CAST(volume AS BIGINT) AS volume FROM {name}_p)"""


BARS = bars_from("SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS bar_date, l_discount, l_tax, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey", "bars")
INDEX = bars_from(
    """SELECT 'MAIN' AS symbol, CAST(l_shipdate AS DATE) AS bar_date, l_discount, l_tax, l_quantity FROM lineitem
  UNION ALL SELECT CASE l_returnflag WHEN 'N' THEN 'WIDE' ELSE 'SMALL' END, CAST(l_shipdate AS DATE), l_discount, l_tax, l_quantity FROM lineitem WHERE l_returnflag IN ('N', 'R')""",
    "index_bars",
)


def w(n: int | None = None, to: str = "CURRENT ROW") -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND {to}"
    return f"(PARTITION BY symbol ORDER BY bar_date{frame})"


def rn(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {w()}"


def ema(x: str, alpha: str) -> str:
    """Closed form; histories are short enough here."""
    run = "(PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING)"
    return f"pow(1e0-{alpha}, i-1) * sum(CASE WHEN i = 1 THEN 1e0 ELSE {alpha} END * {x} * pow(1e0-{alpha}, 1-i)) OVER {run}"


def ok(x: str) -> str:
    return f"coalesce({x}, false)"


def pos(x: str, low: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest({x}, {low}) END"


def slope(x: str, n: int) -> str:
    """Least squares over the last n rows of whole numbers, by exact sums."""
    k = f"least(i, {n})"
    return f"12e0 * CAST({k} * sum(i * CAST({x} AS HUGEINT)) OVER {w(n)} - ({k} * i - {k} * ({k} - 1) // 2) * sum(CAST({x} AS HUGEINT)) OVER {w(n)} AS DOUBLE) / ({k} * {k} * ({k} * {k} - 1))"


UNB = "(PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING)"

FEATURES = f"""{BARS}, {INDEX},
f0 AS (SELECT *, row_number() OVER {w()} AS i, {lag("close")} AS pc FROM bars),
f1 AS (SELECT *, {ema("close", "(2e0/11e0)")} AS sma_10, {ema("close", "(2e0/21e0)")} AS sma_20, {", ".join(f"{rn('avg', 'close', n)} AS sma_{n}" for n in (50, 150, 200))},
  greatest(high-low, abs(high-pc), abs(low-pc)) AS true_range, high-low AS daily_range, (high-low)/close AS daily_range_pct,
  least(greatest((close-low)/greatest(high-low, 1e-3), 0e0), 1e0) AS close_range_position,
  {rn("avg", "volume", 20)} AS volume_sma_20, close*volume AS dollar_volume, {rn("avg", "volume", 10)} AS v10, {rn("avg", "volume", 252, 126)} AS v252,
  CASE WHEN i >= 10 THEN coalesce({slope('volume', 10)}, 0) END AS volume_trend,
  {", ".join(f"{rn('max', 'high', n)} AS hi{n}, {rn('min', 'low', n)} AS lo{n}" for n in (10, 20, 40, 60))},
  {rn("max", "high", 252, 100)} AS hi252, {rn("max", "high", 90, 30)} AS hi90, min(low) OVER {w(60)} AS stop_level, {rn("min", "low", 20, 5)} AS low20,
  sum(coalesce(sign(close-pc)*volume, 0e0)) OVER {UNB} AS obv0,
  close/{lag("close", 63)}-1 AS abs_return_63d, close/{lag("close", 126)}-1 AS abs_return_126d,
  CASE WHEN i >= 20 THEN i - max_by(i, {{'a': high, 'b': -i}}) OVER {w(20)} END AS days_from_high,
  {ok(f"low < {lag('low')} AND low < {lag('low', 2)} AND low < lead(low, 1) OVER {w()} AND low < lead(low, 2) OVER {w()}")} AS pl,
  {ok(f"high > {lag('high')} AND high > {lag('high', 2)} AND high > lead(high, 1) OVER {w()} AND high > lead(high, 2) OVER {w()}")} AS ph
  FROM f0),
f2 AS (SELECT *, {", ".join(f"(close-sma_{n})/sma_{n} AS distance_from_sma{n}" for n in (10, 20, 50, 150, 200))}, {", ".join(f"sma_{n}/{lag(f'sma_{n}', 5)}-1 AS ma_slope_{n}" for n in (10, 20, 50))},
  sma_200/{lag("sma_200", 20)}-1 AS s200, {rn("avg", "true_range", 20)} AS atr_20, {rn("avg", "daily_range_pct", 20)} AS adr_pct,
  volume/volume_sma_20 AS relative_volume, v10/{lag("volume_sma_20", 10)} AS volume_dryup_ratio, v10/v252 AS volume_vs_6m_avg,
  {", ".join(f"(hi{n}-lo{n})/close AS range_{n}" for n in (10, 20, 40))}, {", ".join(f"({lag('hi10', 10 * k)}-{lag('lo10', 10 * k)})/close AS w{k}" for k in (1, 2, 3))},
  (hi60-lo60)/close AS consol_range_60, (hi20-close)/hi20 AS base_depth, (close-lo60)/lo60 AS prior_move_pct,
  (close-hi252)/hi252 AS pct_from_52wk_high, (close-hi90)/hi90 AS pct_from_90d_high, obv0 AS obv,
  least(greatest((close-stop_level)/close, 1e-3), 25e-2) AS stop_distance_pct, CASE WHEN low20 IS NOT NULL THEN least(greatest((close-low20)/close, 1e-3), 5e-1) END AS stop_distance_20d_pct,
  {ok("close < sma_10")} AS trailing_stop_triggered,
  CASE WHEN i >= 10 THEN coalesce({slope('obv0', 60)}, 0) END AS obv_slope, CASE WHEN i >= 5 THEN coalesce({slope('obv0', 20)}, 0) END AS o20,
  CASE WHEN i >= 5 THEN coalesce(regr_slope(close, i) OVER {w(20)}, 0) END AS p20, CASE WHEN i >= 5 THEN greatest(avg(volume) OVER {w(20)}, 1) END AS va20,
  CASE WHEN count(*) OVER {w(20)} >= 5 THEN quantile_cont(daily_range_pct, 2e-1) OVER {w(20)} END AS q1, CASE WHEN count(*) OVER {w(20)} >= 5 THEN quantile_cont(CAST(volume AS DOUBLE), 2e-1) OVER {w(20)} END AS q2,
  last_value(CASE WHEN pl THEN low END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ppl,
  last_value(CASE WHEN ph THEN high END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pph,
  {lag("sma_10")} AS s10p FROM f1),
f3 AS (SELECT *, {ok("sma_10 > sma_20 AND sma_20 > sma_50")} AS ma_alignment, {ok("ma_slope_10 > 0 AND ma_slope_20 > 0 AND ma_slope_50 > 0")} AS mas_rising,
  {ok("close > sma_50 AND close > sma_150 AND sma_50 > sma_150 AND sma_150 > sma_200 AND s200 > 0")} AS stage2, {ok("volume_dryup_ratio < 1 AND volume_trend < 0")} AS volume_declining,
  CAST({ok("range_10 < w1")} AS INT) + CAST({ok("range_10 < w1 AND w1 < w2")} AS INT) + CAST({ok("range_10 < w1 AND w1 < w2 AND w2 < w3")} AS INT) AS vcp_contraction_count,
  range_10/{pos("range_40", "1e-3")} AS vcp_contraction_ratio, {ok(f"range_10/{pos('adr_pct', '1e-2')} <= 3.5e0")} AS is_tight_consolidation,
  {ok("prior_move_pct >= 2e-1")} AS is_power_move, CAST({ok("distance_from_sma10 >= -3e-2 AND distance_from_sma10 <= 1e-1 AND sma_10 > s10p")} AS DOUBLE) AS near,
  {ok("o20/va20 > 0 AND o20/va20 > greatest(p20/greatest(close, 1e-2), 0)")} AS obv_trend, {ok("daily_range_pct < q1 AND volume < q2")} AS is_trigger_bar,
  {ok("pl AND low > ppl")} AS higher_lows, {ok("ph AND high < pph")} AS lower_highs, {ok("pct_from_52wk_high > -15e-2 AND pct_from_52wk_high < -3e-2")} AS approaching_annual_high,
  least(greatest(close*(1+consol_range_60), hi60), close*1.4e0) AS target_level FROM f2),
f4 AS (SELECT *, vcp_contraction_count >= 2 AS vcp_contracting, sum(CASE WHEN is_tight_consolidation THEN 0 ELSE 1 END) OVER {UNB} AS grp,
  CASE WHEN i >= 60 THEN coalesce(i - max(CASE WHEN is_power_move THEN i END) OVER {w(60)}, 60) END AS days_since_power_move,
  {rn("avg", "near", 20, 5)} AS ema10_surf_ratio, CAST(sum(CAST(higher_lows AS INT)) OVER {w(60)} AS BIGINT) AS swing_low_count, CAST(sum(CAST(lower_highs AS INT)) OVER {w(60)} AS BIGINT) AS swing_high_count,
  CASE WHEN target_level IS NOT NULL THEN greatest((target_level-close)/close, 0) END AS potential_gain_pct FROM f3),
f5 AS (SELECT *, CAST(sum(CASE WHEN is_tight_consolidation THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, grp ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consol_days,
  list(high) OVER {w(60)} AS highs, CASE WHEN potential_gain_pct IS NOT NULL THEN least(potential_gain_pct/stop_distance_pct, 10) END AS potential_r FROM f4),
wk AS (SELECT symbol, bar_date + ((12 - isodow(bar_date)) % 7)::INT AS wk, bar_date AS d, close FROM bars),
wk1 AS (SELECT symbol, wk AS bar_date, max_by(close, d) AS close FROM wk GROUP BY 1, 2),
wk2 AS (SELECT *, row_number() OVER {w()} AS i FROM wk1),
wk3 AS (SELECT *, {ema("close", "(2e0/11e0)")} AS e10, {ema("close", "(2e0/21e0)")} AS e20 FROM wk2),
wk4 AS (SELECT symbol, max_by({ok("close > e10 AND e10 > e20")}, bar_date) OR count(*) < 10 AS weekly_aligned FROM wk3 GROUP BY symbol),
bm AS (SELECT bar_date, close AS bench_close FROM index_bars WHERE symbol = 'MAIN'),
fb AS (SELECT f5.*, bench_close, CASE WHEN consol_days >= 5 THEN list_max(list_slice(highs, greatest(len(highs) - least(consol_days, 60) + 1, 1), len(highs))) ELSE list_max(highs) END AS breakout_level
  FROM f5 ASOF LEFT JOIN bm ON f5.bar_date >= bm.bar_date),
features AS (SELECT fb.* EXCLUDE (highs), {", ".join(f"{lag('close', 5)}/{lag('close', 5 + n)} - {lag('bench_close', 5)}/{lag('bench_close', 5 + n)} AS rs_comp_{n}" for n in (20, 60, 120, 252))}, weekly_aligned
  FROM fb JOIN wk4 USING (symbol)),
cal AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS day FROM (SELECT DISTINCT bar_date FROM bars)),
moved AS (SELECT a.symbol, a.bar_date, a.close/b.close-1 AS ret FROM (SELECT * FROM bars JOIN cal USING (bar_date)) a LEFT JOIN (SELECT symbol, day + 60 AS day, close FROM bars JOIN cal USING (bar_date)) b ON a.symbol = b.symbol AND a.day = b.day),
ranks AS (SELECT symbol, bar_date, ret, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY bar_date, ret IS NULL ORDER BY ret) + (count(*) OVER (PARTITION BY bar_date, ret) - 1) / 2e0) / count(ret) OVER (PARTITION BY bar_date) * 100 END AS rs_rank FROM moved)"""


def steps(x: str, pairs: list[tuple[str, str]], otherwise: str = "0e0", below: bool = False) -> str:
    op = "<=" if below else ">="
    return "CASE " + " ".join(f"WHEN {x} {op} {bound} THEN {points}" for bound, points in pairs) + f" ELSE {otherwise} END"


GRADE = steps("raw_score", [("90", "'A+'"), ("85", "'A'"), ("80", "'A-'"), ("75", "'B+'"), ("70", "'B'"), ("65", "'C+'"), ("60", "'C'")], "'D'")
RANK = steps("rs_rank", [("95", "8e0"), ("85", "10e0"), ("75", "7e0"), ("65", "4e0")])

SCORED = f"""{FEATURES},
s0 AS (SELECT f.*, r.rs_rank, {pos("adr_pct", "1e-2")} AS adr1 FROM features f JOIN ranks r USING (symbol, bar_date)),
s1 AS (SELECT *, {steps("range_10/adr1", [("75e-2", "6e0"), ("125e-2", "5e0"), ("2e0", "4e0"), ("35e-1", "2e0")], below=True)} AS p_tightness,
  CASE WHEN consol_days > 60 THEN 1e0 ELSE {steps("consol_days", [("35", "4e0"), ("20", "35e-1"), ("10", "3e0"), ("5", "25e-1")])} END AS p_length,
  {steps("vcp_contraction_count", [("3", "4e0"), ("2", "3e0"), ("1", "2e0")])} AS p_vcp,
  CASE WHEN swing_low_count >= 2 AND swing_high_count >= 2 THEN 6e0 WHEN swing_low_count >= 1 AND swing_high_count >= 1 AND swing_low_count + swing_high_count >= 3 THEN 45e-1
    WHEN swing_low_count >= 1 AND swing_high_count >= 1 THEN 3e0 WHEN swing_low_count >= 2 THEN 2e0 WHEN swing_low_count >= 1 THEN 1e0 ELSE 0e0 END AS p_wedge,
  CASE WHEN is_trigger_bar THEN 15e-1 ELSE 0e0 END AS p_trigger,
  CASE WHEN ma_alignment AND mas_rising THEN {steps("ema10_surf_ratio", [("75e-2", "4e0"), ("5e-1", "35e-1")], "3e0")} WHEN ma_alignment THEN {steps("ema10_surf_ratio", [("65e-2", "2e0")], "1e0")}
    WHEN sma_10 > sma_20 THEN 5e-1 ELSE 0e0 END
  + CASE WHEN days_since_power_move <= 60 THEN {steps("prior_move_pct", [("2e0", "8e0"), ("1e0", "7e0"), ("75e-2", "55e-1")])} WHEN days_since_power_move <= 90 AND prior_move_pct >= 75e-2 THEN 4e0 ELSE 0e0 END
  + CASE WHEN approaching_annual_high AND consol_days >= 10 THEN 2e0 ELSE 0e0 END AS t0,
  {steps("rs_comp_60", [("5e-1", "12e0"), ("25e-2", "9e0"), ("12e-2", "6e0"), ("0e0", "2e0")])} + {steps("rs_comp_120", [("2e-1", "8e0"), ("1e-1", "6e0"), ("4e-2", "3e0"), ("0e0", "1e0")])} + {RANK} AS rs_score,
  CASE WHEN volume_declining AND volume_dryup_ratio < 6e-1 THEN 14e0 WHEN volume_declining AND volume_dryup_ratio < 75e-2 THEN 105e-1 WHEN volume_declining AND volume_dryup_ratio < 9e-1 THEN 7e0
    WHEN volume_dryup_ratio < 1 THEN 35e-1 ELSE 0e0 END AS d0,
  {steps("dollar_volume", [("1e8", "6e0"), ("5e7", "5e0"), ("2e7", "4e0"), ("1e7", "25e-1")])} AS p_dollars,
  CASE WHEN adr_pct >= 12e-2 AND adr_pct < 15e-2 THEN 10e0 WHEN adr_pct >= 15e-2 AND adr_pct <= 2e-1 THEN 9e0 WHEN adr_pct > 2e-1 AND adr_pct < 25e-2 THEN 55e-1
    ELSE {steps("adr_pct", [("25e-2", "2e0"), ("1e-1", "75e-1"), ("8e-2", "5e0"), ("7e-2", "25e-1")])} END AS p_adr,
  CASE WHEN stop_distance_pct/adr1 BETWEEN 5e-1 AND 1e0 THEN 10e0 WHEN stop_distance_pct/adr1 < 5e-1 THEN 3e0 ELSE {steps("stop_distance_pct/adr1", [("15e-1", "8e0"), ("2e0", "5e0"), ("25e-1", "3e0")], below=True)} END
  + {steps("potential_r", [("5", "5e0"), ("4", "4e0"), ("3", "3e0"), ("2", "15e-1")])} AS rr_score,
  list_filter([CASE WHEN close < 5 THEN 'price' END, CASE WHEN dollar_volume < 1e7 THEN 'dollar_volume' END, CASE WHEN close < sma_50 THEN 'below_sma50' END, CASE WHEN adr_pct < 8e-2 THEN 'adr' END,
    CASE WHEN stop_distance_20d_pct > 5*adr1 OR stop_distance_20d_pct < 1e-3 THEN 'stop_distance' END, CASE WHEN greatest(coalesce(pct_from_52wk_high, -1), coalesce(pct_from_90d_high, -1)) < -3e-1 THEN 'from_high' END,
    CASE WHEN prior_move_pct < 75e-2 THEN 'prior_move' END, CASE WHEN consol_days < 5 THEN 'consolidation' END, CASE WHEN rs_comp_252 < 0 THEN 'relative_strength' END], lambda x: x IS NOT NULL) AS reasons FROM s0),
s2 AS (SELECT *, CASE WHEN NOT weekly_aligned THEN greatest(t0-5, 0) ELSE t0 END AS t1, least(p_tightness+p_length+p_vcp+p_wedge+p_trigger, 20) AS base_score,
  CASE WHEN relative_volume < 7e-1 AND d0 < 14 THEN least(d0 + CASE WHEN relative_volume < 5e-1 THEN 2 ELSE 1 END, 14) ELSE d0 END AS d1, len(reasons) = 0 AS passes_filters FROM s1),
s3 AS (SELECT *, least(t1, 14) AS trend_score, CASE WHEN close_range_position >= 7e-1 AND d1 >= 7 THEN least(d1+5e-1, 14) ELSE d1 END AS d2 FROM s2),
s4 AS (SELECT *, CASE WHEN obv_trend THEN least(d2 + CASE WHEN d2 >= 7 THEN 2 ELSE 1 END, 14) ELSE d2 END AS d3 FROM s3),
s5 AS (SELECT *, p_dollars + p_adr + CASE WHEN consol_days >= 5 THEN CASE WHEN volume_vs_6m_avg > 9e-1 THEN greatest(d3-2, 0) ELSE d3 END ELSE 0 END AS volume_score FROM s4),
s6 AS (SELECT *, base_score/20e0*10e0 + trend_score/14e0*15e0 + rs_score/30e0*25e0 + volume_score/30e0*50e0 AS raw_score FROM s5),
scored AS (SELECT *, raw_score AS total_score, {GRADE} AS grade, {steps("raw_score", [("80", "'STRONG BUY - Alert'"), ("70", "'BUY - Watch Closely'"), ("60", "'HOLD - Monitor'")], "'PASS'")} AS signal FROM s6)"""


def r6(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"floor(({x})*1e{digits}+5e-1)/1e{digits} AS {name or x}"


def select(ctes: str, body: str) -> str:
    return f"WITH {'RECURSIVE ' if 'ft(i, k' in ctes else ''}{ctes}\n{body}"
