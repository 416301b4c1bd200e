"""Research over labelled signals: brackets, regimes, filters, weights, objectives, sweeps and models. All are aggregations or
projections; parameters that are tried are a column, so trying more of them is more parallel work and no more jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import average_rank, by_symbol, ratio, rounded

c = F.col

#: Lower bounds of the score brackets.
BRACKETS = (90, 80, 70, 60)


def _mean(condition: Column) -> Column:
    return rounded(F.avg(condition.cast("double")))


def outcome_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, shares that broke out, were stopped or reached the target, and mean gain and drawdown."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), _mean(c("days_to_breakout").isNotNull()).alias("breakout_rate"), _mean(c("days_to_stop").isNotNull()).alias("stop_rate"), _mean(c("days_to_target").isNotNull()).alias("target_rate"),
        rounded(F.avg("max_gain_20d")).alias("mean_gain_20d"), rounded(F.avg("max_drawdown_20d")).alias("mean_drawdown_20d"),
    )


def bracket(score: Column) -> Column:
    """Half-open brackets of the score by their lower bound, 0 below the last."""
    out = None
    for low in BRACKETS:
        out = F.when(score >= low, F.lit(low).cast("long")) if out is None else out.when(score >= low, F.lit(low).cast("long"))
    return out.otherwise(F.lit(0).cast("long"))


def score_brackets(scored: DataFrame, outcomes: DataFrame) -> DataFrame:
    rows = scored.select("symbol", "scan_date", bracket(c("raw_score")).alias("bracket")).join(outcomes, ["symbol", "scan_date"])
    return outcome_rates(rows, "bracket")


def regime_outcomes(outcomes: DataFrame, regimes: DataFrame) -> DataFrame:
    """Rates by the regime of the scan's date; dates without one are UNKNOWN. Both sides meet by date."""
    known = regimes.select(c("bar_date").alias("scan_date"), "regime")
    return outcome_rates(outcomes.join(known, "scan_date", "left").withColumn("regime", F.coalesce("regime", F.lit("UNKNOWN"))), "regime")


def filter_effectiveness(rows: DataFrame, value: str = "fwd_20") -> DataFrame:
    """Mean return by the first filter that fails ('none' for rows that pass), and whether it is under 0.8 times that of those that pass."""
    first = F.coalesce(F.get("filter_reasons", F.lit(0)), F.lit("none"))
    means = rows.groupBy(first.alias("reason")).agg(F.count(value).alias("n"), F.avg(value).alias("_m"))
    passing = means.where("reason = 'none'").select(c("_m").alias("_base"))
    found = means.join(F.broadcast(passing), F.lit(True), "left")  # one row
    return found.select("reason", "n", rounded("_m").alias("mean_return"), (c("_m") < 0.8 * c("_base")).alias("effective"))


def filter_sweep(rows: DataFrame, names: tuple[str, ...], value: str = "fwd_20") -> DataFrame:
    """Every combination of the filters (combo has a bit for each, in the order of names): rows that pass all of its filters, how many have a
    return, its mean and the share of gains.

    Rows are counted once by the mask of the filters that they fail; a mask's counts then go to the combinations that share no filter with it, so
    the work after one aggregation depends on the number of filters alone."""
    mask = sum((F.when(F.array_contains("filter_reasons", name), 1 << k).otherwise(0) for k, name in enumerate(names)), F.lit(0))
    counted = rows.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"), F.count(value).alias("k"), F.sum(value).alias("s"), F.count(F.when(c(value) > 0, 1)).alias("won"))
    combos = F.filter(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), lambda x: x.bitwiseAND(c("mask")) == 0)
    each = counted.withColumn("combo", F.explode(combos)).groupBy("combo").agg(F.sum("n").alias("n"), F.sum("k").alias("n_returns"), F.sum("s").alias("_s"), F.sum("won").alias("_won"))
    held = [F.when(c("combo").bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(names)]
    listed = F.concat_ws(",", *held)
    return each.select(c("combo").cast("long").alias("combo"), listed.alias("filters"), "n", "n_returns", rounded(ratio(c("_s"), c("n_returns"))).alias("mean_return"), rounded(ratio(c("_won"), c("n_returns"))).alias("win_rate"))


def business_day_before(day: Column) -> Column:
    """The last day from Monday to Friday before it."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 2, 3).otherwise(1))


def training_examples(examples: DataFrame, scored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """examples (symbol, breakout_date) with the columns of their symbol's last scored row up to the business day before the breakout, and its
    date. Examples without such a row are left out. Which date that is comes from a symbol's dates alone, rows are then joined by it, so none is copied for
    each date that is asked for."""
    asked = examples.select("symbol", "breakout_date", business_day_before(c("breakout_date")).alias("score_day"))
    marks = asked.select("symbol", c("score_day").alias("_at"), F.lit(None).cast("date").alias("bar_date")).distinct()
    both = marks.unionByName(scored.select("symbol", c("bar_date").alias("_at"), "bar_date"))
    # A day's own row comes before the question about it: nulls are last.
    upto = Window.partitionBy("symbol").orderBy("_at", F.col("bar_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_last", F.last("bar_date", ignorenulls=True).over(upto)).where("bar_date is null and _last is not null")
    dated = asked.join(known.select("symbol", c("_at").alias("score_day"), c("_last").alias("bar_date")), ["symbol", "score_day"])
    return dated.join(scored.select("symbol", "bar_date", *columns), ["symbol", "bar_date"]).select("symbol", "breakout_date", "score_day", "bar_date", *columns)


def weight_suggestions(labelled: DataFrame, parts: tuple[str, ...] = ("base_score", "trend_score", "rs_score", "volume_score"), value: str = "fwd_20") -> DataFrame:
    """Each component's share of the absolute correlations with the return, in percent."""
    row = labelled.agg(*(F.coalesce(F.abs(F.corr(p, value)), F.lit(0.0)).alias(p) for p in parts))
    total = sum((c(p) for p in parts), F.lit(0.0))
    listed = F.array(*(F.struct(F.lit(p).alias("component"), rounded(ratio(100 * c(p), total), 4).alias("weight")) for p in parts))
    return row.select(F.inline(listed))


def signal_validity(labelled: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Per horizon: hit rate, mean, median, mean win and loss, correlation with the score, and a label of the edge."""
    listed = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), c(f"fwd_{h}").alias("r")) for h in horizons))
    rows = labelled.select("raw_score", F.inline(listed)).where("r is not null")
    hit = F.avg((c("r") > 0).cast("double"))
    return rows.groupBy("horizon").agg(
        F.count("*").alias("n"), rounded(hit).alias("hit_rate"), rounded(F.avg("r")).alias("mean_return"), rounded(F.percentile("r", F.lit(0.5))).alias("median_return"), rounded(F.avg(F.when(c("r") > 0, c("r")))).alias("mean_win"), rounded(F.avg(F.when(c("r") <= 0, c("r")))).alias("mean_loss"),
        rounded(F.corr("raw_score", "r")).alias("correlation"), F.when(hit >= 0.55, "strong").when(hit >= 0.50, "weak").otherwise("none").alias("edge"),
    )


def matched_selectivity(scored: DataFrame, candidate: str, bound: float = 70.0, score: str = "raw_score") -> DataFrame:
    """The bound on a candidate score that admits the same share of rows as the bound on the score."""
    share = scored.agg(F.avg((c(score) >= bound).cast("double")).alias("share"))
    ranked = scored.where(c(candidate).isNotNull()).agg(F.array_sort(F.collect_set(F.floor(c(candidate) * 100) / 100)).alias("_cuts"))  # scores of 0 to 100 by hundredths: bounded
    cuts = ranked.select(F.explode("_cuts").alias("cut"))
    reached = scored.groupBy((F.floor(c(candidate) * 100) / 100).alias("cut")).agg(F.count("*").alias("k")).where("cut is not null")
    above = Window.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each hundredth
    admitted = reached.join(cuts, "cut").withColumn("_n", F.sum("k").over(above))
    total = scored.agg(F.count("*").alias("_total"))
    best = admitted.join(F.broadcast(total), F.lit(True)).join(F.broadcast(share), F.lit(True)).where(c("_n") <= c("share") * c("_total"))
    return best.agg(F.min("cut").alias("threshold"), F.max("_n").alias("n_admitted"), rounded(F.max("share")).alias("share"))


def reweighted(dryup: Column, others: Column) -> Column:
    """The volume component with a dry-up that counts 3 or nothing, on the same scale of 30."""
    return (others + F.when(dryup >= 10.5, 3.0).otherwise(0.0)) * 30 / 19


def composite(weights: dict[str, Column], sub_max: dict[str, float]) -> Column:
    """Weighted sum of components, each as a share of its maximum, clipped to 0 to 1."""
    return sum((w * F.least(F.greatest(c(f"{k}_score") / sub_max[k], F.lit(0.0)), F.lit(1.0)) for k, w in weights.items()), F.lit(0.0))


def weight_grid(labelled: DataFrame, sub_max: dict[str, float], value: str = "fwd_20", step: int = 10, low: int = 10, high: int = 50) -> DataFrame:
    """Every set of component weights on a grid (each from low to high, together 100), with the correlation of its composite and the
    return, the mean return of its best quarter, and its rank. The sets (at most a few hundred) are an array beside each row.

    One aggregation per set would be one job each; here the array is exploded, sums are made before the shuffle, and the
    correlation comes from the sums, so a row costs as many additions as there are sets and none of it is shuffled.
    """
    steps = range(low, high + 1, step)
    sets = [(a, b, r, 100 - a - b - r) for a in steps for b in steps for r in steps if low <= 100 - a - b - r <= high]
    listed = F.array(*(F.struct(*(F.lit(float(w)).alias(n) for n, w in zip(("base", "trend", "rs", "volume"), s, strict=True))) for s in sets))
    rows = labelled.where(c(value).isNotNull()).select("base_score", "trend_score", "rs_score", "volume_score", c(value).alias("_y"), F.explode(listed).alias("w"))
    rows = rows.withColumn("_x", composite({k: c(f"w.{k}") for k in ("base", "trend", "rs", "volume")}, sub_max))
    out = rows.groupBy("w").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("correlation"))
    order = Window.orderBy(F.desc_nulls_last("correlation"), "base", "trend", "rs")  # a row for each set
    return out.select("w.*", "n", "correlation").withColumn("rank", F.row_number().over(order).cast("long")).withColumn("correlation", rounded("correlation"))


def time_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """part: 'train' for the dates that hold the first share of the rows, 'test' for later ones. Whole dates, so no date is in both;
    what is ordered has a row for each date."""
    daily = rows.groupBy("scan_date").agg(F.count("*").alias("_k"))
    upto = Window.orderBy("scan_date").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.agg(F.count("*").alias("_all"))
    days = daily.withColumn("_n", F.sum("_k").over(upto)).join(F.broadcast(total), F.lit(True))
    return rows.join(days.select("scan_date", F.when(c("_n") <= F.floor(c("_all") * share), "train").otherwise("test").alias("part")), "scan_date")


def holdout(rows: DataFrame, months: int = 6, gap_days: int = 70) -> DataFrame:
    """part: 'holdout' for the last months, 'dev' for what is more than gap_days before them, null between."""
    last = rows.agg(F.add_months(F.max("scan_date"), -months).alias("_from"))
    df = rows.join(F.broadcast(last), F.lit(True))  # one row
    part = F.when(c("scan_date") >= c("_from"), "holdout").when(c("scan_date") < F.date_sub("_from", gap_days), "dev")
    return df.withColumn("part", part).drop("_from")


def standard_differences(labelled: DataFrame, flag: Column, features: tuple[str, ...]) -> DataFrame:
    """Standardised mean difference of each feature between rows with and without the flag."""
    on = lambda f, agg: agg(F.when(flag, c(f)))
    off = lambda f, agg: agg(F.when(~flag, c(f)))
    row = labelled.agg(*(ratio(on(f, F.avg) - off(f, F.avg), F.sqrt((on(f, F.var_samp) + off(f, F.var_samp)) / 2)).alias(f) for f in features))
    return row.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), rounded(f).alias("smd")) for f in features))))


def quintiles(labelled: DataFrame, feature: str, value: str = "fwd_20") -> DataFrame:
    """Mean return by fifth of a feature; bounds by its percentiles, ties together."""
    cuts = labelled.agg(F.percentile(feature, F.array(*(F.lit(q / 5) for q in range(1, 5)))).alias("_cuts"))
    rows = labelled.where(c(feature).isNotNull()).join(F.broadcast(cuts), F.lit(True))  # one row
    place = 1 + F.size(F.filter("_cuts", lambda x: x < c(feature)))
    return rows.groupBy(place.cast("long").alias("fifth")).agg(F.count(value).alias("n"), rounded(F.avg(value)).alias("mean_return"))


def trailing_outcomes(signals: DataFrame, bars: DataFrame, horizon: int = 60) -> DataFrame:
    """Entry at the first close at the breakout level; exit at the first later close under the 10-day mean, else at the last bar."""
    from .outcomes import KEY, forward

    means = bars.withColumn("_mean", F.when(F.count("close").over(by_symbol().rowsBetween(-9, 0)) == 10, F.avg("close").over(by_symbol().rowsBetween(-9, 0))))
    rows = forward(signals.where("breakout_level > 0"), means, horizon)
    trade = Window.partitionBy(*KEY)
    rows = rows.withColumn("_in", F.min(F.when(c("close") >= c("breakout_level"), c("n"))).over(trade)).where(c("n") >= c("_in"))
    rows = rows.withColumn("_out", F.coalesce(F.min(F.when((c("n") > c("_in")) & (c("close") < c("_mean")), c("n"))).over(trade), F.max("n").over(trade))).where(c("n") <= c("_out"))
    entry = F.min_by("close", "n")
    out = rows.groupBy(*KEY).agg(entry.alias("entry"), F.max_by("close", "n").alias("_exit"), (F.max("n") - F.min("n")).alias("bars_held"), F.max("close").alias("_high"), F.min("close").alias("_low"))
    return out.select(*KEY, "entry", "bars_held", (ratio(c("_exit"), c("entry")) - 1).alias("trailing_return"), (ratio(c("_high"), c("entry")) - 1).alias("max_gain"), (ratio(c("_low"), c("entry")) - 1).alias("max_drawdown"))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """One row from an equity curve (exit_date, equity, n_trades, drawdown): totals, yearly growth, Sharpe ratio, worst drawdown."""
    order = Window.orderBy("exit_date")  # a row for each date
    daily = curve.withColumn("_r", ratio(c("equity"), F.lag("equity").over(order)) - 1)
    years = F.datediff(F.max("exit_date"), F.min("exit_date")) / 365.25
    return daily.agg(
        F.sum("n_trades").alias("n_trades"), rounded(F.max_by("equity", "exit_date") - 1).alias("total_return"), rounded(F.pow(F.max_by("equity", "exit_date"), ratio(F.lit(1.0), years)) - 1).alias("cagr"),
        rounded(ratio(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(252.0)), 4).alias("sharpe"), rounded(F.min("drawdown")).alias("max_drawdown"),
    )


def exit_sweep(trades: DataFrame, bars: DataFrame, targets: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0), hold: int = 30) -> DataFrame:
    """Trades and mean R for each target in R. The bars after an entry are joined once; the targets are a column of what they give."""
    from .outcomes import _after_entry

    rows = _after_entry(trades, bars, hold).withColumn("risk", c("entry") - c("stop")).where("risk > 0")
    rows = rows.select("symbol", "scan_date", "entry", "risk", "stop", "n", "open", "low", "high", "close", F.explode(F.array(*map(F.lit, targets))).alias("target_r"))
    stopped, hit = c("low") <= c("stop"), c("high") >= c("entry") + c("target_r") * c("risk")
    fill = F.when(stopped, F.least("open", "stop")).when(hit, F.greatest(c("open"), c("entry") + c("target_r") * c("risk"))).otherwise(c("close"))
    r, ends = (fill - c("entry")) / c("risk"), stopped | hit | (c("n") >= hold)
    each = rows.groupBy("target_r", "symbol", "scan_date").agg(F.coalesce(F.min_by(F.when(ends, r), F.when(ends, c("n"))), F.max_by(r, "n")).alias("r"))
    every = trades.where("entry > stop").select("symbol", "scan_date", F.explode(F.array(*map(F.lit, targets))).alias("target_r"))
    each = every.join(each, ["target_r", "symbol", "scan_date"], "left").fillna(0.0, "r")  # no bar after the entry: R 0
    return each.groupBy("target_r").agg(F.count("*").alias("n"), rounded(F.avg("r"), 4).alias("mean_r"), _mean(c("r") > 0).alias("win_rate"))


def models(labelled: DataFrame, features: tuple[str, ...] = ("base_score", "trend_score", "rs_score", "volume_score"), value: str = "fwd_20") -> DataFrame:
    """Elastic net and boosted trees trained on the earlier dates; their rank correlation with the return on the later ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = time_split(labelled.where(c(value).isNotNull()).select("symbol", "scan_date", *(c(f).cast("double").alias(f) for f in features), c(value).alias("label")))
    filled = [f"{f}_filled" for f in features]
    steps = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), RobustScaler(inputCol="raw", outputCol="features")]
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    out = None
    for name, learner in (("elastic_net", LinearRegression(elasticNetParam=0.5, regParam=0.001)), ("boosted_trees", GBTRegressor(maxDepth=3, maxIter=20, seed=42))):
        found = Pipeline(stages=[*steps, learner]).fit(train).transform(test).withColumn("_one", F.lit(1))
        ranked = found.withColumns({"_a": average_rank("prediction", "_one"), "_b": average_rank("label", "_one")})
        row = ranked.agg(F.lit(name).alias("model"), F.count("*").alias("n_test"), rounded(F.corr("_a", "_b"), 4).alias("spearman"))
        out = row if out is None else out.unionByName(row)
    return out
