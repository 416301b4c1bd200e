"""Registered queries of searches and resampling: solved weights, walk-forward choices, ablation, paired bootstraps, controlled effects,
filter combinations and positions held together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT
from ..operators import outcomes as O, positions as H, reports as P, resampling as B, research as Q, scoring as S, trading as T, validation as V, weights as W
from ..sources.bars import bars, earnings, index_bars
from ..functions.rolling import rounded
from ..sources import store
from ..sources.scratch import place, written
from . import labels, market, sql, validation
from .market import Query

c = F.col


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return validation._evaluated(s, d)


def _solved(s: SparkSession, d: str, objective: str, restarts: int, current: tuple[float, ...] | None = None) -> DataFrame:
    held = written(W.profiles(_evaluated(s, d), DEFAULT.sub_max), "profiles")
    return W.solved(held, objective, restarts=restarts, current=current)


#: What may account for the effect of the stage, and the bounds of the score's buckets.
CONFOUNDERS = ("adr_pct", "prior_move_pct", "pct_from_52wk_high", "consol_days", "dollar_volume")
SLOTS = 2


def _all_evaluated(s: SparkSession, d: str) -> DataFrame:
    return V.evaluated(market.scored(s, d).withColumnRenamed("bar_date", "scan_date"), bars(s, d))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    rows = market.scored(s, d).select("symbol", c("bar_date").alias("scan_date"), "filter_reasons")
    return Q.filter_sweep(O.forward_returns(rows, bars(s, d), (20,)), tuple(S.filter_checks()))


def _positions(s: SparkSession, d: str) -> DataFrame:
    """The best signals of each day, from their entry to their exit."""
    best = Window.partitionBy("scan_date").orderBy(F.desc("raw_score"), "symbol")
    chosen = labels._labelled(s, d).withColumn("_slot", F.row_number().over(best)).where(c("_slot") <= SLOTS).select("symbol", "scan_date")
    own = bars(s, d)
    trades = written(O.entries(chosen, own), "positions")
    paths = P.trade_paths(trades, own).select("symbol", "scan_date", "exit_date")
    return trades.join(paths, ["symbol", "scan_date"]).select("symbol", "entry_date", "exit_date", H.sized(trades).alias("weight"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Every date's scan, stored in three batches: all rows with a score taken away, then two batches that bring them again as they are."""
    rows = written(store.scan_rows(market.scored(s, d), ("symbol", "bar_date")), "scans")
    table = store.Stored(s, place(s, "stored-scans"), store.KEYS["scans"], "date_format(scan_date, 'yyyy-MM')")
    table.upsert(rows.withColumn("score", c("score") - 1).drop("consol_range_pct"))
    for half in (0, 1):
        table.upsert(rows.where(F.pmod(F.unix_date("scan_date"), F.lit(2)) == half))
    table.vacuum()
    shown = table.read()
    return shown.select("scan_date", "symbol", "passes_filters", "grade", "consol_days", *(rounded(k).alias(k) for k in ("score", "raw_score", "price", "consol_range_pct", "rs_comp_252")))


def _lifecycle(s: SparkSession, d: str) -> DataFrame:
    rows = labels.signals(s, d).where("stop_level is not null").select("symbol", "scan_date", "stop_level", F.greatest(F.floor(10_000 / c("price")), F.lit(1)).alias("shares"))
    done = T.lifecycle(rows, bars(s, d))
    return done.select("symbol", "scan_date", "shares", "status", "entry_date", "exit_reason", "exit_date", *(rounded(k).alias(k) for k in ("entry_price", "exit_price", "pnl_pct", "pnl_dollars")))


def _examples(s: SparkSession, d: str) -> DataFrame:
    """Earnings dates stand for breakouts that were labelled by hand."""
    examples = earnings(s, d).select("symbol", c("earnings_date").alias("breakout_date"))
    found = Q.training_examples(examples, market.scored(s, d), ("raw_score", "passes_filters", "grade"))
    return found.withColumn("raw_score", rounded("raw_score"))


def queries() -> dict[str, Query]:
    current = tuple(DEFAULT.weights[k] for k in W.COMPONENTS)
    return {
        "weight_solver": lambda s, d: _solved(s, d, "sim_pf", 20, current),
        "spearman_weights": lambda s, d: _solved(s, d, "spearman_20d", 10),
        "walk_forward_weights": lambda s, d: W.walk_forward_weights(written(_evaluated(s, d), "evaluated"), DEFAULT.sub_max),
        "component_ablation": lambda s, d: B.ablation(_evaluated(s, d)),
        "paired_bootstrap": lambda s, d: B.paired_bootstrap(_evaluated(s, d), "raw_score", "volume_score"),
        "controlled_effect": lambda s, d: B.controlled_effect(_all_evaluated(s, d), c("stage2"), CONFOUNDERS),
        "controlled_bootstrap": lambda s, d: B.controlled_bootstrap(_all_evaluated(s, d), c("stage2"), CONFOUNDERS),
        "bucket_bootstrap": lambda s, d: B.bucket_bootstrap(_evaluated(s, d), V.bucket_from(c("adr_pct"), V.ISOLATED["adr"][1], open_above=True), "max_gain_20d"),
        "filter_sweep": _sweep,
        "paper_lifecycle": _lifecycle,
        "training_examples": _examples,
        "stored_scans": _stored,
        "held_correlation": lambda s, d: H.held_correlation(_positions(s, d), bars(s, d), index_bars(s, d).where("symbol = 'MAIN'")),
    }


FOLDS = """span AS (SELECT min(scan_date) AS a, max(scan_date) AS z FROM ev),
folds AS (SELECT k AS fold, CAST(a + to_months(CAST(3*k AS INT)) AS DATE) AS train_from, CAST(a + to_months(CAST(12+3*k AS INT)) AS DATE) - 70 AS train_to,
  CAST(a + to_months(CAST(12+3*k AS INT)) AS DATE) AS test_from, CAST(CAST(a + to_months(CAST(12+3*k AS INT)) AS DATE) + to_months(3) AS DATE) AS test_to
  FROM span, (SELECT unnest(range(0, 400)) AS k) WHERE CAST(a + to_months(CAST(12+3*k AS INT)) AS DATE) < z)"""


FILTERS = ("price", "dollar_volume", "below_sma50", "adr", "stop_distance", "from_high", "prior_move", "consolidation", "relative_strength")
_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0"


def _draws(rows: str) -> str:
    """How often each date is drawn in each replicate."""
    chance = f"CAST('0x' || substr(md5(strftime(scan_date, '%Y-%m-%d') || ':' || r), 1, 8) AS BIGINT)/CAST({1 << 32} AS DOUBLE)"
    weight = " + ".join(f"CAST(u >= {float(b)!r} AS INT)" for b in B.POISSON)
    return f"draws AS (SELECT scan_date, r, {weight} AS w FROM (SELECT scan_date, r, {chance} AS u FROM (SELECT DISTINCT scan_date FROM {rows}), (SELECT unnest(range(0, {B.REPLICATES})) AS r)))"


def _ablation_sql() -> str:
    parts = B.PARTS
    stats = ", ".join(f"avg({p}) AS m_{p}, stddev_samp({p}) AS s_{p}" for p in parts)
    z = lambda p: f"({p}-m_{p})/nullif(s_{p}, 0)"
    tried = [("full", "raw_score")] + [(B.subset_name(x), f"({' + '.join(map(z, x))})/{len(x)}") for x in B.SUBSETS]
    each = " UNION ALL ".join(f"SELECT fold, '{name}' AS candidate, floor(({x})*1e9+5e-1) AS x, y FROM pieces, st" for name, x in tried)
    return sql.select(
        f"""{validation._base()}, al AS (SELECT scan_date, {", ".join(parts)}, raw_score, g20 AS y FROM ev WHERE g20 IS NOT NULL),
ho AS (SELECT CAST(max(scan_date) - to_months(6) AS DATE) AS h FROM al), dv AS (SELECT al.* FROM al, ho WHERE scan_date < h - 70), st AS (SELECT {stats} FROM dv),
{FOLDS.replace("FROM ev)", "FROM dv)")},
sides AS (SELECT fold, scan_date <= train_to AS train, dv.* FROM dv JOIN folds ON scan_date >= train_from AND scan_date < test_to AND (scan_date <= train_to OR scan_date >= test_from)),
fine AS (SELECT fold FROM sides GROUP BY 1 HAVING count(*) FILTER (train) >= 20 AND count(*) FILTER (NOT train) >= 5),
pieces AS (SELECT fold, {", ".join(parts)}, raw_score, y FROM sides SEMI JOIN fine USING (fold) WHERE NOT train UNION ALL SELECT -1, {", ".join(parts)}, raw_score, y FROM al, ho WHERE scan_date >= h),
tried AS ({each}), rk AS (SELECT fold, candidate, {_RANK.format(by="fold, candidate", x="x")} AS rx, {_RANK.format(by="fold, candidate", x="y")} AS ry FROM tried),
cr AS (SELECT fold, candidate, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS s0 FROM rk GROUP BY 1, 2), cs AS (SELECT * EXCLUDE (s0), CASE WHEN isnan(s0) THEN NULL ELSE s0 END AS s FROM cr),
mn AS (SELECT candidate, {sql.r6('avg(s)', 'mean_dev')} FROM cs WHERE fold >= 0 GROUP BY 1), cm AS (SELECT cs.*, mean_dev FROM cs LEFT JOIN mn USING (candidate))""",
        f"SELECT CAST(fold AS BIGINT) AS fold, candidate, n, {sql.r6('s', 'spearman')}, mean_dev, dense_rank() OVER (PARTITION BY fold ORDER BY mean_dev DESC NULLS LAST, candidate) AS dev_rank FROM cm",
    )


def _held_sql() -> str:
    """Positions by the same rule as trade_paths: stop, a third at three risks, then the entry or the short mean, else time."""
    pc = lambda k: f"{k}/{sql.lag(k)}-1"
    return sql.select(
        f"""{labels.LABELLED}, chosen AS (SELECT symbol, bar_date AS scan_date FROM labelled QUALIFY row_number() OVER (PARTITION BY bar_date ORDER BY raw_score DESC, symbol) <= {SLOTS}),
hb AS (SELECT *, row_number() OVER {sql.w()} AS k, {pc('close')} AS ret, {sql.rn('avg', 'close', 10)} AS m10 FROM bars),
he AS (SELECT s.symbol, s.scan_date, e.k AS ek, e.bar_date AS entry_date, e.open*1001e-3 AS entry, least(e.low, e.open*1001e-3*98e-2) AS stop FROM chosen s JOIN hb a ON a.symbol = s.symbol AND a.bar_date = s.scan_date JOIN hb e ON e.symbol = s.symbol AND e.k = a.k + 1),
hp AS (SELECT he.*, b.k, b.k - ek AS n, b.open, b.high, b.low, b.close, b.m10, min(CASE WHEN b.low <= stop THEN b.k - ek END) OVER t AS sn, min(CASE WHEN b.high >= entry + 3*(entry-stop) THEN b.k - ek END) OVER t AS hn
  FROM he JOIN hb b ON b.symbol = he.symbol AND b.k > ek AND b.k <= ek + 59 WHERE entry > stop WINDOW t AS (PARTITION BY he.symbol, he.scan_date)),
ht AS (SELECT *, CASE WHEN sn IS NULL OR hn < sn THEN hn END AS tn FROM hp),
hz AS (SELECT symbol, scan_date, k, n, coalesce((tn IS NULL AND n = sn) OR (n > tn AND low <= entry) OR (n >= tn AND close < m10), false) OR n >= 59 AS ends FROM ht),
hx AS (SELECT symbol, scan_date, coalesce(min(CASE WHEN ends THEN k END), max(k)) AS xk FROM hz GROUP BY 1, 2),
ps AS (SELECT he.symbol, ek, coalesce(xk, ek) AS xk, least(5e-3/greatest((entry-stop)/entry, 5e-3), 2e-1) AS weight FROM he LEFT JOIN hx USING (symbol, scan_date) WHERE entry > stop),
hd AS (SELECT b.symbol, b.bar_date, b.ret, max(weight) AS weight FROM ps JOIN hb b ON b.symbol = ps.symbol AND b.k BETWEEN ek AND xk GROUP BY 1, 2, 3),
hc AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.ret, y.ret) AS v FROM hd x JOIN hd y ON x.bar_date = y.bar_date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
hg AS (SELECT * FROM hc WHERE v IS NOT NULL AND NOT isnan(v)),
bl AS (SELECT g.a, g.b, corr(x.ret, y.ret) AS v FROM hg g JOIN hb x ON x.symbol = g.a JOIN hb y ON y.symbol = g.b AND y.bar_date = x.bar_date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60),
im AS (SELECT bar_date, {pc('close')} AS m FROM index_bars WHERE symbol = 'MAIN'),
bt AS (SELECT symbol, corr(ret, m) AS v FROM hd JOIN im USING (bar_date) WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY 1 HAVING count(*) >= 15),
dk AS (SELECT bar_date, count(*) AS k FROM hd WHERE ret IS NOT NULL GROUP BY 1),
sv AS (SELECT symbol, var_samp(ret) AS s FROM hd GROUP BY 1), nv AS (SELECT bar_date, coalesce(sum(weight*weight*s), 0) AS v FROM hd JOIN sv USING (symbol) GROUP BY 1),
al AS (SELECT (SELECT count(*) FROM hg) AS n1, (SELECT avg(v) FROM hg) AS v1, (SELECT count(*) FROM bl WHERE NOT isnan(v)) AS n2, (SELECT avg(v) FROM bl WHERE NOT isnan(v)) AS v2, (SELECT count(*) FROM bt WHERE NOT isnan(v)) AS n3, (SELECT avg(v) FROM bt WHERE NOT isnan(v)) AS v3,
  (SELECT avg(k) FROM dk) AS ak, (SELECT max(k) FROM dk) AS mk, (SELECT sqrt(avg(v)) FROM nv) AS nvol),
am AS (SELECT *, ak/(1+(ak-1)*greatest(coalesce(v1, 0), 0)) AS en FROM al)""",
        f"SELECT n1 AS n_held_corr, n2 AS n_baseline_corr, n3 AS n_index_corr, mk AS max_held, {sql.r6('v1', 'held_corr')}, {sql.r6('v2', 'baseline_corr')}, {sql.r6('v3', 'index_corr')}, {sql.r6('ak', 'avg_held')}, {sql.r6('nvol', 'naive_vol')}, {sql.r6('v1-v2', 'excess_corr')}, {sql.r6('en', 'effective_n')}, {sql.r6('en/ak', 'diversification')} FROM am",
    )


def _paired_sql() -> str:
    kinds = {"a": "floor(raw_score*1e2+5e-1)", "b": "floor(volume_score*1e2+5e-1)", "y": "floor(g20*1e3+5e-1)"}
    ranks = ", ".join(f"t{k} AS (SELECT r, {k}, sum(wn) AS t FROM wc GROUP BY 1, 2), r{k} AS (SELECT r, {k}, sum(t) OVER (PARTITION BY r ORDER BY {k} ROWS UNBOUNDED PRECEDING) - (t-1)/2e0 AS rank_{k} FROM t{k})" for k in kinds)
    square = lambda k: f"(sum(wn*rank_{k}*rank_{k}) - sum(wn)*pow((sum(wn)+1)/2e0, 2))"
    corr = lambda k: f"CASE WHEN sum(wn) >= 10 AND {square(k)} > 0 AND {square('y')} > 0 THEN (sum(wn*rank_{k}*rank_y) - sum(wn)*pow((sum(wn)+1)/2e0, 2))/sqrt({square(k)}*{square('y')}) END"
    return sql.select(
        f"""{validation._base()}, cl AS (SELECT scan_date, {", ".join(f"{x} AS {k}" for k, x in kinds.items())}, count(*) AS n FROM ev WHERE g20 IS NOT NULL GROUP BY ALL), {_draws('cl')},
wc AS (SELECT r, a, b, y, CAST(sum(w*n) AS DOUBLE) AS wn FROM cl JOIN draws USING (scan_date) WHERE w > 0 GROUP BY ALL), {ranks},
df AS (SELECT r, {corr('a')} - {corr('b')} AS d FROM wc JOIN ra USING (r, a) JOIN rb USING (r, b) JOIN ry USING (r, y) GROUP BY r)""",
        f"SELECT count(d) AS n_replicates, {sql.r6('avg(d)', 'mean_diff')}, {sql.r6('quantile_cont(d, 25e-3)', 'ci_low')}, {sql.r6('quantile_cont(d, 975e-3)', 'ci_high')}, {sql.r6('avg(CAST(d > 0 AS DOUBLE))', 'p_above_0')} FROM df WHERE d IS NOT NULL",
    )


def _controlled_sql() -> str:
    """Each coefficient from what its column leaves once the others are taken out of it, one after another."""
    low, high = B.TAILS
    known = f"ck AS (SELECT CAST(coalesce(stage2, false) AS DOUBLE) AS flag, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in CONFOUNDERS)}, g20 AS y FROM ev WHERE g20 IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in CONFOUNDERS)})"
    cut = "cq AS (SELECT " + ", ".join(f"quantile_cont({x}, {q}) AS {x}_{k}" for x in (*CONFOUNDERS, "y") for k, q in (("lo", low), ("hi", high))) + " FROM ck)"
    clipped = "cc AS (SELECT flag, " + ", ".join(f"least(greatest({x}, {x}_lo), {x}_hi) AS {x}" for x in (*CONFOUNDERS, "y")) + " FROM ck, cq)"
    scaled = "cz AS (SELECT flag, y, " + ", ".join(f"({x} - avg({x}) OVER ())/stddev_samp({x}) OVER () AS {x}" for x in CONFOUNDERS) + " FROM cc)"
    steps, found = [], []
    for k, term in enumerate(("flag", *CONFOUNDERS)):
        left, at = [x for x in ("flag", *CONFOUNDERS) if x != term], "cz"
        while left:
            head, *left = left
            out = f"c{k}_{len(left)}"
            steps.append(f"{out} AS (SELECT y, " + ", ".join(f"{x} - regr_slope({x}, {head}) OVER ()*({head} - avg({head}) OVER ()) AS {x}" for x in (*left, term)) + f" FROM {at})")
            at = out
        found.append(f"SELECT '{term}' AS term, regr_slope(y, {term}) AS v FROM {at}")
    slopes = "cs AS (" + " UNION ALL ".join(found) + ")"
    flat = f"SELECT term, v FROM cs UNION ALL SELECT 'intercept', (SELECT avg(y) FROM cz) - (SELECT v FROM cs WHERE term = 'flag')*(SELECT avg(flag) FROM cz)"
    return sql.select(f"{validation._base('')}, {known}, {cut}, {clipped}, {scaled}, {', '.join(steps)}, {slopes}, ca AS ({flat})", f"SELECT term, {sql.r6('v', 'coefficient')} FROM ca")


def oracle_sql() -> dict[str, str]:
    r6 = sql.r6
    sets = "ws AS (SELECT a, b, r, 100-a-b-r AS v FROM (SELECT unnest(range(10, 51, 10)) AS a), (SELECT unnest(range(10, 51, 10)) AS b), (SELECT unnest(range(10, 51, 10)) AS r) WHERE 100-a-b-r BETWEEN 10 AND 50)"
    clip = lambda k: f"least(greatest({k}_score/{DEFAULT.sub_max[k]}e0, 0), 1)"
    return {
        "walk_forward_weights": sql.select(
            f"""{validation._base()}, {FOLDS}, {sets},
kn AS (SELECT scan_date, {clip('base')} AS cb, {clip('trend')} AS ct, {clip('rs')} AS cr, {clip('volume')} AS cv, g20 FROM ev WHERE g20 IS NOT NULL AND g10 IS NOT NULL AND chg IS NOT NULL),
kf AS (SELECT fold, CASE WHEN scan_date <= train_to THEN 'train' ELSE 'test' END AS side, kn.* FROM kn JOIN folds ON scan_date >= train_from AND scan_date < test_to AND (scan_date <= train_to OR scan_date >= test_from)),
xs AS (SELECT fold, side, a, b, r, any_value(v) AS v, count(*) AS n, {r6('corr(floor((a*cb + b*ct + r*cr + v*cv)*100+5e-1), g20)', 'y', 4)} FROM kf, ws GROUP BY 1, 2, 3, 4, 5),
tr AS (SELECT * FROM xs WHERE side = 'train' AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY y DESC, a, b, r) = 1),
tt AS (SELECT tr.*, te.n AS nt, te.y AS yt FROM tr JOIN xs te ON te.side = 'test' AND te.fold = tr.fold AND te.a = tr.a AND te.b = tr.b AND te.r = tr.r WHERE tr.n >= 20 AND te.n >= 5),
tm AS (SELECT *, avg(y - yt) OVER () AS m FROM tt)""",
            f"""SELECT CAST(fold AS BIGINT) AS fold, train_from, train_to, test_from, test_to, n AS n_train, nt AS n_test, CAST(a AS DOUBLE) AS w_base, CAST(b AS DOUBLE) AS w_trend, CAST(r AS DOUBLE) AS w_rs, CAST(v AS DOUBLE) AS w_volume,
  y AS train_value, yt AS test_value, {r6('y - yt', 'gap', 4)}, {r6('m', 'mean_gap', 4)}, CASE WHEN m > 5e-2 THEN 'overfitted' WHEN m > 2e-2 THEN 'mild' ELSE 'ok' END AS verdict FROM tm JOIN folds USING (fold)""",
        ),
        "stored_scans": sql.select(sql.SCORED, f"SELECT bar_date AS scan_date, symbol, passes_filters, CASE WHEN passes_filters THEN grade END AS grade, consol_days, {r6('CASE WHEN passes_filters THEN total_score END', 'score')}, {r6('CASE WHEN passes_filters THEN raw_score END', 'raw_score')}, {r6('close', 'price')}, {r6('consol_range_60', 'consol_range_pct')}, {r6('rs_comp_252')} FROM scored"),
        "training_examples": sql.select(
            f"""{sql.SCORED}, ek AS (SELECT p_partkey % 25 AS k, min(p_brand) AS symbol FROM part GROUP BY 1),
ed AS (SELECT symbol, min(CAST(o_orderdate AS DATE)) AS d FROM orders JOIN ek ON o_orderkey % 25 = k GROUP BY symbol, date_trunc('quarter', CAST(o_orderdate AS DATE))),
ex AS (SELECT symbol, d AS breakout_date, CAST(d - CAST(CASE dayofweek(d) WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INT) AS DATE) AS score_day FROM ed)""",
            f"SELECT ex.symbol, breakout_date, score_day, bar_date, {r6('raw_score')}, passes_filters, grade FROM ex ASOF JOIN scored ON ex.symbol = scored.symbol AND ex.score_day >= scored.bar_date",
        ),
        "paper_lifecycle": sql.select(
            f"""{labels.SIGNALS}, lb AS (SELECT *, row_number() OVER {sql.w()} AS k, {sql.rn('avg', 'close', 10)} AS m, lead(open) OVER {sql.w()} AS no, lead(bar_date) OVER {sql.w()} AS nd FROM bars),
lt AS (SELECT s.symbol, s.scan_date, s.stop_level AS lv, CAST(greatest(floor(10000/s.price), 1) AS BIGINT) AS shares, a.k + 1 AS ek, a.nd AS ed, a.no AS ep FROM signals s JOIN lb a ON a.symbol = s.symbol AND a.bar_date = s.scan_date WHERE s.stop_level IS NOT NULL),
lx AS (SELECT t.symbol, t.scan_date, b.k, CASE WHEN b.k > ek AND ep > lv AND b.low <= lv THEN 'stop_order' WHEN b.close <= lv THEN 'stop_cross' ELSE 'ma_cross' END AS reason,
  CASE WHEN b.k > ek AND ep > lv AND b.low <= lv THEN least(b.open, lv) ELSE b.no END AS px, CASE WHEN b.k > ek AND ep > lv AND b.low <= lv THEN b.bar_date ELSE b.nd END AS xd
  FROM lt t JOIN lb b ON b.symbol = t.symbol AND b.k >= ek WHERE (b.k > ek AND ep > lv AND b.low <= lv) OR b.close <= lv OR b.close < b.m
  QUALIFY row_number() OVER (PARTITION BY t.symbol, t.scan_date ORDER BY b.k) = 1)""",
            f"""SELECT t.symbol, t.scan_date, shares, CASE WHEN ep IS NULL THEN 'submitted' WHEN reason IS NULL THEN 'open' WHEN px IS NULL THEN 'exiting' ELSE 'closed' END AS status, ed AS entry_date, reason AS exit_reason, xd AS exit_date,
  {r6('ep', 'entry_price')}, {r6('px', 'exit_price')}, {r6('(px-ep)/ep', 'pnl_pct')}, {r6('(px-ep)*shares', 'pnl_dollars')} FROM lt t LEFT JOIN lx ON lx.symbol = t.symbol AND lx.scan_date = t.scan_date""",
        ),
        "held_correlation": _held_sql(),
        "component_ablation": _ablation_sql(),
        "paired_bootstrap": _paired_sql(),
        "controlled_effect": _controlled_sql(),
        "bucket_bootstrap": sql.select(
            f"""{validation._base()}, db AS (SELECT {validation._bucket('adr_pct', V.ISOLATED['adr'][1], above=True)} AS bucket, scan_date, sum(g20) AS s, count(*) AS n FROM ev WHERE g20 IS NOT NULL GROUP BY 1, 2), {_draws('db')},
mm AS (SELECT bucket, r, sum(w*s)/nullif(sum(w*n), 0) AS m FROM db JOIN draws USING (scan_date) WHERE bucket IS NOT NULL GROUP BY 1, 2),
ci AS (SELECT bucket, {r6('quantile_cont(m, 25e-3)', 'ci_low')}, {r6('quantile_cont(m, 975e-3)', 'ci_high')} FROM mm GROUP BY 1)""",
            f"SELECT bucket, CAST(sum(n) AS BIGINT) AS n, {r6('sum(s)/sum(n)', 'mean')}, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM db JOIN ci USING (bucket) GROUP BY 1",
        ),
        "filter_sweep": sql.select(
            f"""{sql.SCORED}, fx AS (SELECT symbol, bar_date, lead(close, 21) OVER {sql.w()}/lead(open, 1) OVER {sql.w()}-1 AS y FROM bars),
fm AS (SELECT reasons, count(*) AS n, count(y) AS k, sum(y) AS s, count(CASE WHEN y > 0 THEN 1 END) AS won FROM scored JOIN fx USING (symbol, bar_date) GROUP BY 1),
cb AS (SELECT combo, list_filter([{", ".join(f"CASE WHEN (combo >> {k}) & 1 = 1 THEN '{name}' END" for k, name in enumerate(FILTERS))}], lambda x: x IS NOT NULL) AS names FROM (SELECT unnest(range(0, {1 << len(FILTERS)})) AS combo)),
st AS (SELECT combo, array_to_string(any_value(names), ',') AS filters, sum(n) AS n, sum(k) AS k, sum(s) AS s, sum(won) AS won FROM cb, fm WHERE NOT list_has_any(names, reasons) GROUP BY 1)""",
            f"SELECT combo, filters, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS n_returns, {r6('s/nullif(CAST(k AS DOUBLE), 0)', 'mean_return')}, {r6('won/nullif(CAST(k AS DOUBLE), 0)', 'win_rate')} FROM st",
        ),
    }
