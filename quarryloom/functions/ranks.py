"""Ranks of whole columns, ties averaged, without a task that sees the whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

c = F.col

#: Bins of a column's values; their bounds are quantiles to one in QUANTILE_ACCURACY.
BINS, QUANTILE_ACCURACY = 256, 10_000


def ranks_of_values(held: DataFrame, value: str, by: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """held (a row for each distinct value, of each group of by, with k, how many rows have it) with the rank of these rows, ties averaged.
    The values are ordered within bins whose bounds are sketched quantiles, so that a long tail is no large bin (each is a task's window),
    and the bins' totals (at most so many rows a group) are added up: no task sees the whole column."""
    cuts = held.groupBy(*by).agg(F.approx_percentile(value, [i / bins for i in range(1, bins)], QUANTILE_ACCURACY).alias("_cuts"))
    placed = held.join(F.broadcast(cuts), list(by) or F.lit(True))  # a row for each group
    placed = placed.withColumn("_bin", F.size(F.filter("_cuts", lambda cut: cut < c(value)))).drop("_cuts")
    totals = placed.groupBy(*by, "_bin").agg(F.sum("k").alias("_held"))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_bin", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("k").over(upto)).join(F.broadcast(before), [*by, "_bin"])  # a row for each bin
    return ranked.withColumn("rank", c("_before") + c("_upto") - (c("k") - 1) / 2).drop("_bin", "_before", "_upto")
