"""Validation reports over evaluated signals (features, scores and what followed): precision and recall, calibration, lifts, isolated
filters, bucket reports and ranks over whole tables. Everything is one aggregation or a few; what is
ordered afterwards has a row for each date, bucket or step of the score, never one for each signal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import ranks_of_values
from ..functions.rolling import by_symbol, is_true, ratio, rounded, significant
from ..sources.scratch import written
from .outcomes import KEY, historical_outcomes, open_hits
from .weights import PEAK_GAIN, weight_objectives  # noqa: F401  (reports of this module's rows, asked for by its name)

c = F.col

#: Bounds of the reports' buckets.
ADR_EDGES = (0.0, 0.07, 0.10, 0.15, 0.20, 0.30, 1.0)
PRIOR_EDGES = (0.0, 0.25, 0.50, 1.0, 2.0, 10.0)
CALIBRATION_EDGES = (0.0, 50.0, 60.0, 70.0, 80.0, 101.0)
#: The filters that are isolated, with the left-closed bounds of their buckets; the last is open above.
ISOLATED = {
    "adr": ("adr_pct", (0.0, 0.05, 0.07, 0.10, 0.12, 0.15, 0.20, 0.25)),
    "prior_move": ("prior_move_pct", (0.0, 0.25, 0.50, 0.75, 1.0, 2.0)),
    "consol_days": ("consol_days", (0.0, 1.0, 5.0, 10.0, 20.0, 35.0, 60.0)),
    "stop": ("stop_adr_ratio", (0.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0)),
}


def evaluated(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals (all their columns) with their outcomes over 60 bars and realized, the change from the next open to the last of these bars."""
    found = historical_outcomes(signals.select(*KEY, "breakout_level", "stop_level", "target_level"), bars)
    last = F.last("close").over(by_symbol().rowsBetween(1, 60))
    ends = bars.select("symbol", c("bar_date").alias("scan_date"), (ratio(last, F.lead("open").over(by_symbol())) - 1).alias("realized"))
    kept = found.select(*KEY, "days_to_breakout", "days_to_stop", "days_to_target", "max_gain_10d", "max_gain_20d", "max_drawdown_20d")
    return signals.join(kept, KEY).join(ends, KEY).withColumn("confirmed", c("days_to_breakout").isNotNull())


def breakout_volume(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Volume of the first later close at the breakout level over the mean of the last 20 volumes after the scan; null before 20 of them."""
    on_bar, on_block = c("close") >= c("breakout_level"), c("max_close") >= c("breakout_level")
    hits = open_hits(signals.where("breakout_level > 0"), bars, {"days_to_breakout": (on_bar, on_block)}).where("days_to_breakout is not null")
    numbered = bars.withColumns({"i": F.row_number().over(by_symbol()), "_mean": F.avg("volume").over(by_symbol().rowsBetween(-19, 0))})
    at = numbered.select("symbol", c("bar_date").alias("scan_date"), c("i").alias("_scan"))
    placed = hits.join(at, KEY).withColumn("i", c("_scan") + c("days_to_breakout"))
    rows = placed.join(numbered.select("symbol", "i", "volume", "_mean"), ["symbol", "i"])
    return rows.select(*KEY, "days_to_breakout", F.when(c("days_to_breakout") >= 20, ratio(c("volume"), c("_mean"))).alias("relative_volume"))


def bucket_from(value: Column, edges: tuple[float, ...], right: bool = False, open_above: bool = False) -> Column:
    """The lower bound of the bucket that holds the value; left-closed, or right-closed; null outside."""
    uppers = (*edges[1:], None) if open_above else edges[1:]
    out = F.lit(None).cast("double")
    for low, high in reversed(list(zip(edges, uppers, strict=False))):
        inside = value > low if right else value >= low
        if high is not None:
            inside &= value <= high if right else value < high
        out = F.when(inside, F.lit(float(low))).otherwise(out)
    return out


def percentiles(rows: DataFrame, features: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """(feature, share, value): exact percentiles, interpolated between the two rows that hold the place. Values are counted, ranked by
    ranks_of_values and picked, so no task or buffer holds a column."""
    listed = F.array(*(F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("x")) for f in features))
    held = written(rows.select(F.inline(listed)).where("x is not null").groupBy("feature", "x").agg(F.count("*").alias("k")), "percentiles")
    ranked = ranks_of_values(held, "x", ("feature",)).withColumn("_last", c("rank") + (c("k") - 1) / 2)  # its last row's place, from 1
    size = held.groupBy("feature").agg(F.sum("k").alias("_n"))
    wanted = size.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_at", c("share") * (c("_n") - 1))
    asked = wanted.select("feature", "share", "_at", F.floor("_at").alias("_low"), F.ceil("_at").alias("_high"))
    near = ranked.join(F.broadcast(asked), "feature").where("_last > _low and _last - k <= _high")  # a row for each feature and share
    holds = lambda place: F.max(F.when((c("_last") > c(place)) & (c("_last") - c("k") <= c(place)), c("x")))
    found = near.groupBy("feature", "share", "_at", "_low").agg(holds("_low").alias("_a"), holds("_high").alias("_b"))
    return found.select("feature", "share", (c("_a") + (c("_b") - c("_a")) * (c("_at") - c("_low"))).alias("value"))


def rank_sum(rows: DataFrame, feature: str, label: Column) -> DataFrame:
    """Mann-Whitney U of a feature between rows with the label and without, the probability it stands for, and its z value with ties
    corrected. Rows are counted by value once; the counts are written, as they are used several times."""
    held = rows.where(c(feature).isNotNull()).groupBy(feature).agg(F.count("*").alias("k"), F.sum(is_true(label).cast("long")).alias("_y"))
    held = written(held, "rank-sum")
    ranked = ranks_of_values(held, feature)
    sums = ranked.agg(F.sum("_y").alias("n_true"), F.sum(c("k") - c("_y")).alias("n_false"), F.sum(c("rank") * c("_y")).alias("_r"), F.sum(c("k").cast("double") * (c("k") * c("k") - 1)).alias("_ties"))
    n = c("n_true") + c("n_false")
    u, both = c("_r") - c("n_true") * (c("n_true") + 1) / 2, c("n_true") * c("n_false")
    spread = F.sqrt(both / 12.0 * (n + 1 - ratio(c("_ties"), n * (n - 1))))
    return sums.select("n_true", "n_false", rounded(u, 1).alias("u"), rounded(ratio(u, both)).alias("auc"), rounded(ratio(u - both / 2, spread), 4).alias("z"))


def spearman(rows: DataFrame, features: tuple[str, ...], value: str) -> DataFrame:
    """(feature, n, spearman) over the whole table. Rows are counted by feature and pair of values once; the counts are written, as
    they are used several times."""
    listed = F.array(*(F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("x")) for f in features))
    known = rows.select(c(value).cast("double").alias("y"), F.inline(listed)).where("x is not null and y is not null")
    pairs = written(known.groupBy("feature", "x", "y").agg(F.count("*").alias("w")), "spearman")

    def ranks(side: str, name: str) -> DataFrame:
        return ranks_of_values(pairs.groupBy("feature", side).agg(F.sum("w").alias("k")), side, ("feature",)).select("feature", side, c("rank").alias(name))

    ranked = pairs.join(ranks("x", "a"), ["feature", "x"]).join(ranks("y", "b"), ["feature", "y"])
    n, total = F.sum("w"), lambda x: F.sum(c("w") * x)
    middle = (n + 1) / 2
    over = total(c("a") * c("b")) - n * middle * middle
    under = F.sqrt((total(c("a") * c("a")) - n * middle * middle) * (total(c("b") * c("b")) - n * middle * middle))
    return ranked.groupBy("feature").agg(n.alias("n"), rounded(ratio(over, under)).alias("spearman"))


def precision_recall(rows: DataFrame, selected: Column, score: str = "raw_score") -> DataFrame:
    """One row: confirmed and other signals, how many of each are selected, recall, false-positive rate, precision, and the scores' means,
    medians and deviations on both sides."""
    df = rows.withColumn("_in", is_true(selected))
    count = lambda cond: F.count(F.when(cond, 1))
    yes, no = c("confirmed"), ~c("confirmed")
    shown = df.agg(
        count(yes).alias("n_confirmed"), count(no).alias("n_other"), count(yes & c("_in")).alias("selected_confirmed"), count(no & c("_in")).alias("selected_other"),
        *(f(F.when(side, c(score))).alias(f"{name}_{tag}") for tag, side in (("confirmed", yes), ("other", no)) for name, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))),
    )
    rates = {"recall": ratio(c("selected_confirmed"), c("n_confirmed")), "fp_rate": ratio(c("selected_other"), c("n_other")), "precision": ratio(c("selected_confirmed"), c("selected_confirmed") + c("selected_other"))}
    measured = [f"{name}_{tag}" for tag in ("confirmed", "other") for name in ("mean", "median", "std")]
    return shown.select("n_confirmed", "n_other", "selected_confirmed", "selected_other", *(rounded(v).alias(k) for k, v in rates.items()), *(rounded(m).alias(m) for m in measured))


def calibration(rows: DataFrame, score: str = "raw_score", value: str = "realized") -> DataFrame:
    """Per bucket of the score (its lower bound): signals, confirmed ones, precision, and the confirmed ones' mean, median and share of gains."""
    own = F.when(c("confirmed"), c(value))
    grouped = rows.withColumn("bucket", bucket_from(c(score), CALIBRATION_EDGES)).where("bucket is not null").groupBy("bucket")
    return grouped.agg(
        F.count("*").alias("n"), F.count(F.when(c("confirmed"), 1)).alias("n_confirmed"), rounded(F.avg(c("confirmed").cast("double"))).alias("precision"),
        rounded(F.avg(own)).alias("mean_return"), rounded(F.median(own)).alias("median_return"), rounded(F.avg((own > 0).cast("double"))).alias("win_rate"),
    )


def activation(rows: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Per feature (a condition; null is false): the share of confirmed and of other signals it fires on, and the difference."""
    listed = F.array(*(F.struct(F.lit(name).alias("feature"), is_true(cond).cast("double").alias("_on")) for name, cond in features.items()))
    each = rows.select("confirmed", F.inline(listed))
    yes, no = F.avg(F.when(c("confirmed"), c("_on"))), F.avg(F.when(~c("confirmed"), c("_on")))
    return each.groupBy("feature").agg(F.count("*").alias("n"), rounded(yes).alias("confirmed_rate"), rounded(no).alias("other_rate"), rounded(yes - no).alias("lift"))


def prior_move_impact(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """Per side: signals, how many have moved by less before their base, and the mean return and best gain of these."""
    low = c("prior_move_pct") < least
    return rows.groupBy("confirmed").agg(F.count("*").alias("n"), F.count(F.when(low, 1)).alias("n_blocked"), rounded(F.avg(F.when(low, c("realized")))).alias("blocked_return"), rounded(F.max(F.when(low, c("max_gain_20d")))).alias("blocked_best"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """Per side: scores, how many reach 50, 60 and 70 or pass the filters, components, returns and gains."""
    at_least = [F.count(F.when(c("raw_score") >= t, 1)).alias(f"n_{t}") for t in (50, 60, 70)]
    spans = [rounded(f(x)).alias(f"{name}_{x}") for x in ("raw_score", "realized", "max_gain_20d") for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    parts = [rounded(F.avg(x)).alias(f"mean_{x}") for x in ("base_score", "trend_score", "rs_score", "volume_score", "prior_move_pct", "adr_pct")]
    return rows.groupBy("confirmed").agg(F.count("*").alias("n"), F.count(F.when(c("passes_filters"), 1)).alias("n_passing"), *at_least, *spans, *parts)


def failure_tally(rows: DataFrame) -> DataFrame:
    """Per filter: how many confirmed signals it blocks and what they returned."""
    each = rows.where("confirmed").select("realized", "max_gain_20d", F.explode("filter_reasons").alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"), rounded(F.avg("realized")).alias("mean_return"), rounded(F.avg("max_gain_20d")).alias("mean_gain"))


def clustering(rows: DataFrame, selected: Column) -> DataFrame:
    """How many signals fall on one date: one row of counts, mean, deviation and percentiles over the dates that have any."""
    daily = rows.where(selected).groupBy("scan_date").agg(F.count("*").alias("n"))
    at = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return daily.agg(F.count("*").alias("n_dates"), rounded(F.avg("n")).alias("mean"), rounded(F.stddev_samp("n")).alias("std"), F.min("n").alias("least"), *(rounded(F.percentile("n", F.lit(q))).alias(k) for k, q in at.items()), F.max("n").alias("most"))


def predictor_buckets(rows: DataFrame, value: str = "max_gain_20d") -> DataFrame:
    """Count, mean, median and share of gains of the value by bucket of the score (by fives), of the range and of the prior move (right-closed)."""
    listed = F.array(
        F.struct(F.lit("raw_score").alias("feature"), (F.floor(c("raw_score") / 5) * 5).cast("double").alias("bucket")),
        F.struct(F.lit("adr_pct").alias("feature"), bucket_from(c("adr_pct"), ADR_EDGES, right=True).alias("bucket")),
        F.struct(F.lit("prior_move_pct").alias("feature"), bucket_from(c("prior_move_pct"), PRIOR_EDGES, right=True).alias("bucket")),
    )
    each = rows.select(c(value).alias("_v"), F.inline(listed)).where("bucket is not null")
    return each.groupBy("feature", "bucket").agg(F.count("_v").alias("n"), rounded(F.avg("_v")).alias("mean"), rounded(F.median("_v")).alias("median"), rounded(F.avg((c("_v") > 0).cast("double"))).alias("positive"))


def filter_isolation(rows: DataFrame) -> DataFrame:
    """Per filter and bucket of what it measures, over the signals that pass all the other filters: mean gain, winners, breakouts."""
    df = rows.withColumn("stop_adr_ratio", ratio(c("stop_distance_20d_pct"), F.greatest(c("adr_pct"), F.lit(0.01))))
    passes = {
        "price": c("close") >= 5.0, "dollar_volume": c("dollar_volume") >= 10_000_000, "adr": c("adr_pct") >= 0.07, "stop": c("stop_distance_pct") <= 5.0 * F.greatest(c("adr_pct"), F.lit(0.01)),
        "pct_from_high": c("pct_from_52wk_high") >= -0.30, "prior_move": c("prior_move_pct") >= 0.75, "consol_days": c("consol_days") >= 5,
    }
    others = lambda name: reduce(Column.__and__, (is_true(x) for k, x in passes.items() if k != name))
    listed = F.array(*(F.struct(F.lit(name).alias("filter"), F.when(others(name), bucket_from(c(feature).cast("double"), edges, open_above=True)).alias("bucket")) for name, (feature, edges) in ISOLATED.items()))
    each = df.select("max_gain_20d", "confirmed", F.inline(listed)).where("bucket is not null")
    return each.groupBy("filter", "bucket").agg(F.count("*").alias("n"), rounded(F.avg("max_gain_20d")).alias("mean_gain"), rounded(F.avg((c("max_gain_20d") > 0).cast("double"))).alias("win_rate"), rounded(F.avg(c("confirmed").cast("double"))).alias("breakout_rate"))


def carried(rows: DataFrame, date: str, table: DataFrame, value: str) -> DataFrame:
    """rows with the table's value as of their date (its last bar_date up to it). The value is carried to the distinct dates, so what is
    ordered has a row for each date."""
    kind = table.schema[value].dataType
    days = rows.select(c(date).alias("bar_date")).distinct().select("bar_date", F.lit(None).cast(kind).alias(value), F.lit(1).alias("_asked"))
    both = table.select("bar_date", value, F.lit(0).alias("_asked")).unionByName(days)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(Window.orderBy("bar_date", "_asked").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each date
    return rows.join(filled.where("_asked = 1").select(c("bar_date").alias(date), value), date, "left")


def by_condition(trades: DataFrame, condition: str) -> DataFrame:
    """Trades by a market condition as of their entry: how many, winners, mean R and bars."""
    return trades.groupBy(condition).agg(F.count("*").alias("n"), rounded(F.avg((c("r_multiple") > 0).cast("double")), 3).alias("win_rate"), rounded(F.avg("r_multiple"), 3).alias("mean_r"), rounded(F.avg("bars_held"), 3).alias("mean_bars"))


def equity_metrics(exits: DataFrame, risk: float = 0.005) -> DataFrame:
    """Per strategy: trades, winners, mean win and loss, expectancy, profit factor, and the compounded equity (to six digits) with its log and worst drawdown.
    Trades compound in the order of their scan dates; the curve has a point for each date."""
    won = c("r_multiple") > 0
    stats = exits.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg(won.cast("double")).alias("_rate"), F.coalesce(F.avg(F.when(won, c("r_multiple"))), F.lit(0.0)).alias("_win"), F.coalesce(F.avg(F.when(~won, c("r_multiple"))), F.lit(0.0)).alias("_loss"),
        F.sum(F.when(won, c("r_multiple")).otherwise(0.0)).alias("_up"), F.sum(F.when(c("r_multiple") < 0, -c("r_multiple")).otherwise(0.0)).alias("_down"), F.avg("r_multiple").alias("_mean"), F.avg("bars_held").alias("_bars"),
    )
    daily = exits.groupBy("strategy", "scan_date").agg(F.sum(F.log(F.greatest(1 + c("r_multiple") * risk, F.lit(1e-9)))).alias("_g"))
    upto = Window.partitionBy("strategy").orderBy("scan_date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each date
    curve = daily.withColumn("_e", F.sum("_g").over(upto)).withColumn("_peak", F.greatest(F.max("_e").over(upto), F.lit(0.0)))
    ends = curve.groupBy("strategy").agg(F.sum("_g").alias("_log"), (F.exp(F.min(c("_e") - c("_peak"))) - 1).alias("_drawdown"))
    expectancy = c("_rate") * c("_win") + (1 - c("_rate")) * c("_loss")
    shown = {"win_rate": c("_rate"), "mean_win": c("_win"), "mean_loss": c("_loss"), "expectancy": expectancy, "profit_factor": ratio(c("_up"), c("_down")), "mean_r": c("_mean"), "total_r": c("_up") - c("_down"), "mean_bars": c("_bars"), "log_equity": c("_log"), "max_drawdown": c("_drawdown")}
    equity = significant(F.exp("_log")).alias("equity")
    return stats.join(ends, "strategy").select("strategy", "n", *(rounded(v, 4).alias(k) for k, v in shown.items()), equity)
