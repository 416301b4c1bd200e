"""Research reports over labelled signals: buckets, thresholds, correlations, calendars, folds, bootstraps, and a cohort backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rolling import by_symbol, average_rank, ratio, rounded
from .outcomes import KEY, _after_entry, entries

c = F.col


def score_buckets(labelled: DataFrame, score: str = "raw_score", value: str = "fwd_20", width: int = 5) -> DataFrame:
    """Mean return and share of winners by bucket of the score."""
    bucket = (F.floor(c(score) / width) * width).cast("long")
    return labelled.groupBy(bucket.alias("bucket")).agg(F.count(value).alias("n"), rounded(F.avg(value)).alias("mean_return"), rounded(F.avg((c(value) > 0).cast("double"))).alias("win_rate"))


def bins(value: Column, edges: list[float], right: bool = True) -> Column:
    """Label of the bin, closed on the right or on the left; null outside."""
    out = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        label = f"({low}, {high}]" if right else f"[{low}, {high})"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def signal_thresholds(labelled: DataFrame, thresholds: tuple[int, ...] = tuple(range(40, 85, 5))) -> DataFrame:
    """For each threshold of the score: rows, dates and symbols that reach it."""
    reached = labelled.select("symbol", "scan_date", F.explode(F.filter(F.array(*(F.lit(t).cast("long") for t in thresholds)), lambda t: c("raw_score") >= t)).alias("threshold"))
    return reached.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct("scan_date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"))


def correlations(df: DataFrame, features: list[str], value: str) -> DataFrame:
    """Pearson correlation of each feature with the value, in one pass."""
    row = df.agg(F.count(value).alias("n"), *(F.corr(f, value).alias(f) for f in features))
    return row.select("n", F.explode(F.map_from_arrays(F.array(*(F.lit(f) for f in features)), F.array(*(c(f) for f in features)))).alias("feature", "correlation")).select("feature", "n", rounded("correlation").alias("correlation"))


def rank_correlation(df: DataFrame, by: str, feature: str, value: str) -> DataFrame:
    """Spearman's correlation within each group of by, ranks with ties averaged."""
    known = df.where(c(feature).isNotNull() & c(value).isNotNull())
    ranked = known.withColumns({"_a": average_rank(feature, by), "_b": average_rank(value, by)})
    return ranked.groupBy(by).agg(F.count("*").alias("n"), rounded(F.corr("_a", "_b")).alias("spearman"))


def monthly_returns(index: DataFrame) -> DataFrame:
    """Change of each month's last close, a column for each month, and the year's product."""
    months = index.groupBy(F.trunc("bar_date", "month").alias("month")).agg(F.max_by("close", "bar_date").alias("close"))
    changes = months.withColumn("r", ratio(c("close"), F.lag("close").over(Window.orderBy("month"))) - 1)  # a row for each month
    grouped = changes.groupBy(F.year("month").cast("long").alias("year"))
    wide = grouped.agg(*(F.max(F.when(F.month("month") == k, c("r"))).alias(f"m{k}") for k in range(1, 13)), (F.product(1 + c("r")) - 1).alias("total"))
    return wide.select("year", *(rounded(f"m{k}").alias(f"m{k}") for k in range(1, 13)), rounded("total").alias("total"))


def pending(signals: DataFrame, outcomes: DataFrame, days: int) -> DataFrame:
    """Signals that are old enough and have no outcome."""
    last = signals.agg(F.max("scan_date").alias("_last"))
    return signals.join(outcomes.select(*KEY), KEY, "left_anti").crossJoin(F.broadcast(last)).where(F.datediff("_last", "scan_date") >= days).drop("_last")  # the aggregate is one row


def trade_paths(trades: DataFrame, bars: DataFrame, *, trim_r: float = 3.0, hold: int = 60, max_loss_r: float = 5.0, slippage_bps: float = 10.0) -> DataFrame:
    """Result per trade, in R, of this rule: the stop comes first (a gap fills at the open, at most max_loss_r); at trim_r a third is
    sold and the stop moves to the entry; after that a close below the short mean ends the rest; else time. The entry day never exits,
    but a trade that has no later bar ends at that day's close ('eod')."""
    slip = 1 - slippage_bps / 10_000
    means = bars.withColumn("sma10", F.when(F.count("close").over(by_symbol().rowsBetween(-9, 0)) == 10, F.avg("close").over(by_symbol().rowsBetween(-9, 0))))
    rows = _after_entry(trades, means, hold - 1).withColumns({"risk": c("entry") - c("stop"), "target": c("entry") + trim_r * (c("entry") - c("stop"))}).where("risk > 0")
    trade = Window.partitionBy("symbol", "scan_date")
    rows = rows.withColumns({"_stop": F.min(F.when(c("low") <= c("stop"), c("n"))).over(trade), "_hit": F.min(F.when(c("high") >= c("target"), c("n"))).over(trade)})
    rows = rows.withColumn("_trim", F.when(c("_stop").isNull() | (c("_hit") < c("_stop")), c("_hit")))
    even, trail = (c("n") > c("_trim")) & (c("low") <= c("entry")), (c("n") >= c("_trim")) & (c("close") < c("sma10"))
    stopped = c("_trim").isNull() & (c("n") == c("_stop"))
    timed = c("n") >= hold - 1
    ends = F.coalesce(stopped | even | trail | timed, F.lit(False)) | timed
    worst = c("entry") - max_loss_r * c("risk")
    fill = F.when(stopped, F.greatest(F.least(c("open"), c("stop")) * slip, worst)).when(even, F.greatest(F.least(c("open"), c("entry")) * slip, worst)).otherwise(c("close") * slip)
    reason = F.when(stopped, "stop").when(even, "breakeven_stop").when(trail, "trail_sma10").when(timed, "time").otherwise("eod")
    trimmed = F.when(c("_trim") <= c("n"), (c("target") * slip - c("entry")) / c("risk") / 3)
    rest = (fill - c("entry")) / c("risk")
    shown = F.struct(c("n").alias("bars_held"), c("bar_date").alias("exit_date"), reason.alias("exit_reason"), F.when(trimmed.isNotNull(), trimmed + rest * 2 / 3).otherwise(rest).alias("r_multiple"))
    exits = rows.groupBy(*KEY).agg(F.coalesce(F.min_by(F.when(ends, shown), F.when(ends, c("n"))), F.max_by(shown, "n")).alias("x")).select(*KEY, "x.*")
    own = trades.where("entry > stop").join(bars.select("symbol", c("bar_date").alias("entry_date"), "close"), ["symbol", "entry_date"])
    filled = {"bars_held": F.lit(0).cast("long"), "exit_date": c("entry_date"), "exit_reason": F.lit("eod"), "r_multiple": (c("close") * slip - c("entry")) / (c("entry") - c("stop"))}
    return own.join(exits, KEY, "left").select(*KEY, *(F.coalesce(c(k), v).alias(k) for k, v in filled.items()))


def portfolio(spark: SparkSession, scored: DataFrame, bars: DataFrame, *, slots: int = 10, risk: float = 0.005) -> DataFrame:
    """A cohort backtest: each day's best signals fill the slots, each trade risks the same share, and the equity curve adds up results
    by exit date. Trades do not compete for cash across days, so every step is a shuffle by trade or by date."""
    best = Window.partitionBy("scan_date").orderBy(F.desc("raw_score"), "symbol")
    chosen = scored.withColumn("_slot", F.row_number().over(best)).where(c("_slot") <= slots).select("symbol", "scan_date", "raw_score")
    results = trade_paths(entries(chosen, bars), bars)
    daily = results.groupBy("exit_date").agg(F.count("*").alias("n_trades"), F.sum("r_multiple").alias("r"))
    order = Window.orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each date
    curve = daily.withColumn("equity", 1 + F.sum(c("r") * risk).over(order))
    return curve.withColumn("drawdown", c("equity") / F.max("equity").over(order) - 1).select("exit_date", "n_trades", rounded("r", 4).alias("r"), rounded("equity").alias("equity"), rounded("drawdown").alias("drawdown"))


def folds(first_day: str, last_day: str, *, train_months: int = 12, test_months: int = 3, label_days: int = 60, embargo_days: int = 10) -> list[tuple]:
    """Purged walk-forward folds: (fold, train from, train to, test from, test to); training ends label and embargo days before the test."""
    import datetime as dt

    def add(day: dt.date, months: int) -> dt.date:
        month = day.month - 1 + months
        year, month = day.year + month // 12, month % 12 + 1
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(year, month, min(day.day, last))

    start, end, out = dt.date.fromisoformat(first_day), dt.date.fromisoformat(last_day), []
    while (test := add(start, train_months + len(out) * test_months)) < end:
        out.append((len(out), add(start, len(out) * test_months), test - dt.timedelta(days=label_days + embargo_days), test, add(test, test_months)))
    return out


def walk_forward(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Per fold: rows and mean forward return in training and test."""
    span = bars.agg(F.min("bar_date"), F.max("bar_date")).first()
    if span[0] is None:
        table = []
    else:
        table = folds(span[0].isoformat(), span[1].isoformat())
    fold = bars.sparkSession.createDataFrame(table, "fold int, train_from date, train_to date, test_from date, test_to date")
    rows = bars.select("bar_date", (ratio(F.lead("close", horizon).over(by_symbol()), c("close")) - 1).alias("fwd")).where("fwd is not null")
    joined = rows.join(F.broadcast(fold), (c("bar_date") >= c("train_from")) & (c("bar_date") < c("test_to")))  # a row for each quarter
    train, test = c("bar_date") <= c("train_to"), c("bar_date") >= c("test_from")
    out = joined.groupBy("fold", "train_from", "train_to", "test_from", "test_to").agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"), rounded(F.avg(F.when(train, c("fwd")))).alias("train_mean"), rounded(F.avg(F.when(test, c("fwd")))).alias("test_mean"))
    return out.where("n_train >= 20 and n_test >= 5").withColumn("fold", c("fold").cast("long"))


def block_bootstrap(labelled: DataFrame, value: str = "fwd_20", replicates: int = 200) -> DataFrame:
    """Mean of the value with a 95 % interval; whole dates are resampled with Poisson weights from a hash, so it is one pass."""
    daily = labelled.where(c(value).isNotNull()).groupBy("scan_date").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = daily.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64("scan_date", "replicate"), F.lit(1 << 40)) / float(1 << 40)
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum(((u >= b).cast("int") for b in bounds), F.lit(0))
    means = each.withColumn("w", weight).groupBy("replicate").agg(ratio(F.sum(c("w") * c("s")), F.nullif(F.sum(c("w") * c("n")), F.lit(0))).alias("m"))
    return means.agg(rounded(F.avg("m")).alias("mean"), rounded(F.percentile("m", F.lit(0.025))).alias("low"), rounded(F.percentile("m", F.lit(0.975))).alias("high"))


def sector_concentration(scored: DataFrame, sectors: DataFrame, top: int = 10) -> DataFrame:
    """Per date, over the best rows: how many, the largest sector's share, and the Herfindahl index; dates with under 3 are left out."""
    best = Window.partitionBy("scan_date").orderBy(F.desc("raw_score"), "symbol")
    rows = scored.withColumn("_n", F.row_number().over(best)).where(c("_n") <= top).join(sectors, "symbol", "left")
    counted = rows.groupBy("scan_date", "sector").agg(F.count("*").alias("k"))
    out = counted.groupBy("scan_date").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.sum(c("k") * c("k")).alias("squares")).where("n >= 3")
    return out.select("scan_date", "n", rounded(c("most") / c("n")).alias("max_share"), rounded(c("squares") / (c("n") * c("n"))).alias("hhi"))


def pair_correlations(bars: DataFrame, least: int = 60) -> DataFrame:
    """Correlation of daily returns of each two symbols over their common dates. Symbols meet by date, so a pair's rows are its common days."""
    returns = bars.select("symbol", "bar_date", (ratio(c("close"), F.lag("close").over(by_symbol())) - 1).alias("r")).where("r is not null")
    a, b = returns.withColumnsRenamed({"symbol": "a", "r": "ra"}), returns.withColumnsRenamed({"symbol": "b", "r": "rb"})
    pairs = a.join(b, "bar_date").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("correlation"))
    return pairs.where(c("n") >= least).select("a", "b", "n", rounded("correlation").alias("correlation"))
