"""Positions that are held at the same time: how alike they move, and how many independent ones they amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import by_symbol, ratio, rounded
from ..sources.scratch import written

c = F.col

#: Common days that a correlation needs while held, over all days and against the index; share of equity risked and held at
#: most in a position, and the least stop distance that sizes one.
HELD_DAYS, ALL_DAYS, INDEX_DAYS = 10, 60, 15
RISK, MOST, LEAST_STOP = 0.005, 0.2, 0.005


def correlation(x: str, y: str) -> Column:
    """Null where either does not vary."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def held_days(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """positions: symbol, entry_date, exit_date, weight. The days on which each symbol is held, once for each, with the day's return and the largest
    weight. A position finds its days by its bars' numbers, so the join is an equality and gives as many rows as it has days."""
    numbered = bars.select("symbol", "bar_date", F.row_number().over(by_symbol()).alias("i"), (ratio(c("close"), F.lag("close").over(by_symbol())) - 1).alias("r"))
    at = lambda date, name: numbered.select("symbol", c("bar_date").alias(date), c("i").alias(name))
    spans = positions.join(at("entry_date", "_from"), ["symbol", "entry_date"]).join(at("exit_date", "_to"), ["symbol", "exit_date"])
    days = spans.select("symbol", "weight", F.explode(F.sequence("_from", "_to")).alias("i")).groupBy("symbol", "i").agg(F.max("weight").alias("weight"))
    return days.join(numbered, ["symbol", "i"]).select("symbol", "bar_date", "r", "weight")


def held_pairs(held: DataFrame) -> DataFrame:
    """(a, b, n, correlation) of symbols that are held together on HELD_DAYS days or more. Only positions of one day meet, so a day gives as many rows as it
    holds pairs; symbols that are never held together give none."""
    own = held.where("r is not null").select("symbol", "bar_date", "r")
    a, b = own.withColumnsRenamed({"symbol": "a", "r": "ra"}), own.withColumnsRenamed({"symbol": "b", "r": "rb"})
    pairs = a.join(b, "bar_date").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("ra", "rb").alias("correlation"))
    return pairs.where(c("n") >= HELD_DAYS).where("correlation is not null")


def baseline(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """The same pairs over all their common days: each pair's first symbol brings its days, which meet the second's."""
    returns = bars.select("symbol", "bar_date", (ratio(c("close"), F.lag("close").over(by_symbol())) - 1).alias("r")).where("r is not null")
    left = pairs.select("a", "b").join(returns.withColumnsRenamed({"symbol": "a", "r": "ra"}), "a")
    both = left.join(returns.withColumnsRenamed({"symbol": "b", "r": "rb"}), ["b", "bar_date"])
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("ra", "rb").alias("correlation")).where(c("n") >= ALL_DAYS).where("correlation is not null")


def _mean(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(f"n_{name}"), F.avg(value).alias(name))


def held_correlation(positions: DataFrame, bars: DataFrame, index: DataFrame) -> DataFrame:
    """One row: mean correlation of pairs while held together, of the same pairs over all days, of a held symbol with the index; how many
    positions a day holds, how many independent ones they amount to at that correlation, and the daily deviation of a book of independent positions."""
    held = written(held_days(positions, bars), "held")
    pairs = written(held_pairs(held), "held-pairs")
    market = index.select("bar_date", (ratio(c("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_date"))) - 1).alias("m"))
    with_index = held.join(market, "bar_date").where("r is not null and m is not null").groupBy("symbol").agg(F.count("*").alias("n"), correlation("r", "m").alias("v"))
    beta = with_index.where(c("n") >= INDEX_DAYS).where("v is not null")
    daily = held.where("r is not null").groupBy("bar_date").agg(F.count("*").alias("k"))
    counts = daily.agg(F.avg("k").alias("avg_held"), F.max("k").alias("max_held"))
    spread = held.groupBy("symbol").agg(F.var_samp("r").alias("_var"))
    weighed = held.join(spread, "symbol").groupBy("bar_date").agg(F.sum(c("weight") * c("weight") * c("_var")).alias("v"))
    naive = weighed.agg(F.sqrt(F.avg(F.coalesce("v", F.lit(0.0)))).alias("naive_vol"))
    row = _mean(pairs, "correlation", "held_corr")
    for other in (_mean(baseline(pairs, bars), "correlation", "baseline_corr"), _mean(beta, "v", "index_corr"), counts, naive):
        row = row.join(F.broadcast(other), F.lit(True))  # one row each
    rho = F.greatest(F.coalesce("held_corr", F.lit(0.0)), F.lit(0.0))
    effective = c("avg_held") / (1 + (c("avg_held") - 1) * rho)
    shown: dict[str, Column] = {k: c(k) for k in ("held_corr", "baseline_corr", "index_corr", "avg_held", "naive_vol")}
    shown |= {"excess_corr": c("held_corr") - c("baseline_corr"), "effective_n": effective, "diversification": effective / c("avg_held")}
    return row.select("n_held_corr", "n_baseline_corr", "n_index_corr", "max_held", *(rounded(v).alias(k) for k, v in shown.items()))


def sized(trades: DataFrame) -> Column:
    """The share of equity that a position takes: what RISK buys at its stop distance, at most MOST."""
    return F.least(RISK / F.greatest(ratio(c("entry") - c("stop"), c("entry")), F.lit(LEAST_STOP)), F.lit(MOST))
