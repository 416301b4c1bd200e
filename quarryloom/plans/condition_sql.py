"""The market condition as SQL for DuckDB, written apart from the operators: common table expressions up to mc (bar_date, score, regime, multiplier)."""

from __future__ import annotations

from ..operators.regime import REGIMES
from . import sql

_SPANS = (10, 20, 50, 150, 200)

INDEX = f"mc_i AS (SELECT *, row_number() OVER {sql.w()} AS i, {sql.lag('close')} AS pc, {sql.lag('volume')} AS pv, " + ", ".join(f"{sql.rn('avg', 'close', n)} AS sma_{n}" for n in _SPANS) + " FROM index_bars)"

#: Each index date's follow-through by a walk over its last 80 bars, all dates a step at a time.
FOLLOW = f"""ff AS (SELECT bar_date, i, close, low, volume, CASE WHEN count(high) OVER {sql.w(252)} >= 50 THEN max(high) OVER {sql.w(252)} END AS high252,
  close/pc-1 AS pct, coalesce(volume > pv, false) AS more, {", ".join(f"min(low) OVER {sql.w(n)} AS l{n}" for n in range(1, 6))} FROM mc_i WHERE symbol = 'MAIN'),
ft(i, k, st, cl, ra, dn, fi, fl) AS (
  SELECT i, CAST(0 AS BIGINT), 0, CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), 0, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) FROM ff
  UNION ALL
  SELECT f.i, f.k + 1,
    CASE WHEN st = 0 AND (pct < -3e-2 OR (pct < 0 AND dn + 1 >= 3)) THEN 1 WHEN st = 1 AND pct > 0 THEN 2 WHEN st = 2 AND low < cl THEN 1
      WHEN st = 2 AND f.k + 1 - ra >= 3 AND pct >= 125e-4 AND more THEN 0 ELSE st END,
    CASE WHEN st = 0 AND pct < -3e-2 THEN low WHEN st = 0 AND pct < 0 AND dn + 1 >= 3 THEN CASE least(f.k + 2, 5) WHEN 2 THEN l2 WHEN 3 THEN l3 WHEN 4 THEN l4 ELSE l5 END
      WHEN st = 1 THEN least(cl, low) WHEN st = 2 AND low < cl THEN low ELSE cl END,
    CASE WHEN st = 1 AND pct > 0 THEN f.k + 1 WHEN st = 2 AND low < cl THEN 0 ELSE ra END,
    CASE WHEN st = 0 AND pct < -3e-2 THEN 1 WHEN st = 0 AND pct < 0 THEN dn + 1 WHEN st = 0 THEN 0
      WHEN st = 2 AND NOT low < cl AND f.k + 1 - ra >= 3 AND pct >= 125e-4 AND more THEN 0 ELSE dn END,
    CASE WHEN st = 2 AND NOT low < cl AND f.k + 1 - ra >= 3 AND pct >= 125e-4 AND more THEN f.k + 1 ELSE fi END,
    CASE WHEN st = 2 AND NOT low < cl AND f.k + 1 - ra >= 3 AND pct >= 125e-4 AND more THEN cl ELSE fl END
  FROM ft f JOIN ff b ON b.i = f.i - least(f.i, 80) + 2 + f.k WHERE f.k + 1 < least(f.i, 80)),
fe AS (SELECT ft.*, least(ft.i, 80) AS size FROM ft WHERE k = least(ft.i, 80) - 1),
fg AS (SELECT fe.i, any_value(size) AS size, any_value(fi) AS fi, any_value(fl) AS fl, min(b.low) AS later FROM fe LEFT JOIN ff b ON b.i > fe.i - size + 1 + fi AND b.i <= fe.i GROUP BY 1),
fh AS (SELECT bar_date, close/high252 AS near, size >= 10 AND fi >= 0 AS found, CASE WHEN size >= 10 AND fi >= 0 THEN size - 1 - fi END AS ago,
  CASE WHEN size >= 10 AND fi >= 0 THEN coalesce(later >= fl, true) ELSE false END AS valid FROM ff JOIN fg USING (i)),
follow AS (SELECT bar_date, found, ago, valid, CASE WHEN NOT found THEN CASE WHEN near >= 95e-2 THEN 12e0 WHEN near >= 9e-1 THEN 8e0 ELSE 2e0 END WHEN NOT valid THEN 0e0 WHEN ago <= 10 THEN 20e0
  WHEN ago <= 25 THEN 20e0-(ago-10)/15e0*10 WHEN ago <= 40 THEN 10e0-(ago-25)/15e0*5 ELSE 5e0 END AS score FROM fh)"""

_HITS = " + ".join(f"CAST(coalesce(close > sma_{n}, false) AS INT)" for n in _SPANS) + f" + CAST(coalesce(sma_200 > {sql.lag('sma_200', 19)}, false) AS INT)"
_SHARE = "avg(CAST(coalesce({}, false) AS DOUBLE))"
_OTHER = "max(CASE WHEN symbol = '{}' THEN CASE WHEN i < 200 THEN 15e-1 WHEN a200 THEN 3e0 ELSE 0e0 END END)"

_RETURNS = """mc_cal AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS day FROM (SELECT DISTINCT bar_date FROM bars)),
mc_x AS (SELECT bars.symbol, bars.bar_date, bars.close, mc_cal.day FROM bars JOIN mc_cal ON mc_cal.bar_date = bars.bar_date),
mc_y AS (SELECT a.bar_date, a.day, avg(a.close/b.close-1) AS mr FROM mc_x a LEFT JOIN mc_x b ON a.symbol = b.symbol AND a.day = b.day + 1 GROUP BY 1, 2),
mc_z AS (SELECT *, CASE WHEN count(mr) OVER q >= 15 THEN stddev_samp(mr) OVER q END AS v21 FROM mc_y WINDOW q AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
mc_u AS (SELECT *, CASE WHEN count(v21) OVER q >= 40 THEN avg(v21) OVER q END AS m63 FROM mc_z WINDOW q AS (ORDER BY day ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""

#: Needs bars, index_bars and features before it.
CONDITION = f"""{INDEX}, {FOLLOW},
mc_t AS (SELECT *, {_HITS} AS hits, coalesce(close > sma_200, false) AS a200, coalesce(sma_50/{sql.lag('sma_50', 9)}-1, 0) AS slope, ln(close/pc) AS r, close/{sql.lag('close', 20)}-1 AS roc,
  sum(CAST(coalesce(close/pc-1 <= -2e-3 AND volume > pv, false) AS INT)) OVER {sql.w(25)} AS dist, sum(CAST(coalesce(close/pc-1 > 0 AND close/pc-1 < 2e-3 AND volume > pv*105e-2, false) AS INT)) OVER {sql.w(25)} AS stall FROM mc_i),
mc_o AS (SELECT bar_date, {_OTHER.format('WIDE')} AS wide, {_OTHER.format('SMALL')} AS small FROM mc_t WHERE symbol <> 'MAIN' GROUP BY 1),
mc_m AS (SELECT *, coalesce({sql.rn('stddev_samp', 'r', 20)}*sqrt(252e0), 2e-1) AS rv FROM mc_t WHERE symbol = 'MAIN'),
mc_b AS (SELECT bar_date, count(*) AS n, {_SHARE.format('close > sma_50')} AS p50, {_SHARE.format('stage2')} AS ps, {_SHARE.format('pct_from_52wk_high >= -15e-2')} AS ph FROM features GROUP BY 1),
{_RETURNS},
mc_s AS (SELECT m.bar_date,
  least(CASE WHEN a200 THEN hits*25e-1 ELSE least(hits*25e-1, 5) END + CASE WHEN slope > 15e-3 THEN 4 WHEN slope > 5e-3 THEN 25e-1 WHEN slope > 0 THEN 1 ELSE 0 END + coalesce(wide, 15e-1) + coalesce(small, 15e-1), 25)
  + CASE WHEN m.i < 26 THEN 15e0 WHEN dist >= 5 THEN 0e0 ELSE greatest(20e0-4*dist-2*stall, 0) END + f.score
  + coalesce(CASE WHEN n < 5 THEN 10e0 ELSE {sql.steps('p50', [('7e-1', '7e0'), ('55e-2', '55e-1'), ('4e-1', '35e-1'), ('25e-2', '15e-1')])} + {sql.steps('ps', [('6e-1', '7e0'), ('45e-2', '5e0'), ('3e-1', '3e0'), ('15e-2', '1e0')])} + {sql.steps('ph', [('5e-1', '6e0'), ('35e-2', '4e0'), ('2e-1', '2e0'), ('1e-1', '1e0')])} END, 10e0)
  + CASE WHEN roc IS NULL THEN 2e0 ELSE {sql.steps('roc', [('8e-2', '8e0'), ('4e-2', '6e0'), ('1e-2', '4e0'), ('-1e-2', '2e0'), ('-5e-2', '1e0')])} END + CASE WHEN rv < 12e-2 THEN 7e0 WHEN rv < 15e-2 THEN 6e0 WHEN rv < 2e-1 THEN 45e-1 WHEN rv < 25e-2 THEN 25e-1 WHEN rv < 35e-2 THEN 1e0 ELSE 0e0 END
  + coalesce(CASE WHEN day >= 84 AND v21 > 15e-1*m63 THEN -5e0 ELSE 0e0 END, 0e0) AS total
  FROM mc_m m JOIN follow f ON f.bar_date = m.bar_date LEFT JOIN mc_o o ON o.bar_date = m.bar_date LEFT JOIN mc_b b ON b.bar_date = m.bar_date LEFT JOIN mc_u u ON u.bar_date = m.bar_date),
mc_r AS (SELECT bar_date, greatest(total, 0) AS score, {sql.steps('greatest(total, 0)', [(str(low), f"'{name}'") for low, name, _ in REGIMES[:-1]], f"'{REGIMES[-1][1]}'")} AS regime FROM mc_s),
mc AS (SELECT *, CASE regime {" ".join(f"WHEN '{name}' THEN CAST({m} AS DOUBLE)" for _, name, m in REGIMES)} END AS multiplier FROM mc_r)"""
