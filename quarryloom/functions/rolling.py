"""Window expressions that features share. All use one partitioning and ordering, so a chain of them needs one shuffle and sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

def by_symbol():
    """The one window that features share; made on demand, as windows need a session."""
    return Window.partitionBy("symbol").orderBy("bar_date")


def last_rows(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], value: Column | str, n: int, at_least: int | None = None) -> Column:
    """An aggregate over the last n rows; null until at_least (n, if not given) of them have a value."""
    value = F.col(value) if isinstance(value, str) else value
    frame = last_rows(n)
    return F.when(F.count(value).over(frame) >= (n if at_least is None else at_least), agg(value).over(frame))


def lag(value: Column | str, n: int = 1) -> Column:
    return F.lag(value, n).over(by_symbol())


def is_true(condition: Column) -> Column:
    """A null comparison counts as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def whole_slope(value: Column | str, n: int) -> Column:
    """Slope over the last n rows of whole numbers by the row number i, from exact sums, so a true zero is zero and its sign can be
    trusted; over fewer rows at a symbol's beginning. Null where a row has no value."""
    value = (F.col(value) if isinstance(value, str) else value).cast("long")
    frame = last_rows(n)
    rows, held, total = F.count(F.lit(1)).over(frame), F.count(value).over(frame), F.sum(value).over(frame)
    # Places run from 1 to the number of rows; 12 times the covariance, over the places' own.
    weighted = F.sum(F.col("i") * value).over(frame) - (F.col("i") - rows) * total
    above = 2 * weighted - (rows + 1) * total
    return F.when((held == rows) & (rows > 1), 6 * above.cast("double") / (rows * (rows * rows - 1)).cast("double"))


def safe_max(value: Column, floor: float) -> Column:
    """At least floor; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


#: From here on doubles are whole numbers.
WHOLE_DOUBLES = float(1 << 53)


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Half up, in a way that engines agree on. Values that have no such digit, as their steps are whole numbers of it, stay as they are."""
    value = F.col(value) if isinstance(value, str) else value
    scaled = value * F.lit(10.0**digits) + F.lit(0.5)
    return F.when(F.abs(scaled) < WHOLE_DOUBLES, F.floor(scaled)).otherwise(scaled) / F.lit(10.0**digits)


def significant(value: Column | str, digits: int = 6) -> Column:
    """A positive value to so many digits from its first one on."""
    value = F.col(value) if isinstance(value, str) else value
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)) - F.lit(digits - 1.0))
    return F.floor(value / unit + F.lit(0.5)) * unit


BLOCK = 1024


def with_ema(df: DataFrame, columns: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """Exponential means (name: value, alpha) seeded with the first value; df has i, the row number from 1 on.

    The recursion is summed in closed form within blocks of BLOCK rows, so powers stay small at any length of history;
    of what came before a block its predecessor's last mean is enough (older rows weigh less than 1e-30 for the alphas in use).
    """
    at = F.col("i") - 1
    place = F.pmod(at, F.lit(BLOCK))
    block = Window.partitionBy("symbol", "_block").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    before = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_block", F.floor(at / BLOCK)).withColumn("_place", place)
    local = {}
    for name, (value, alpha) in columns.items():
        value = F.col(value) if isinstance(value, str) else value
        b = F.lit(1.0 - alpha)
        weight = F.when(F.col("i") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
        local[f"_{name}"] = F.pow(b, F.col("_place")) * F.sum(weight * value * F.pow(b, -F.col("_place"))).over(block)
    df = df.withColumns(local)
    means = {name: F.col(f"_{name}") + F.pow(F.lit(1.0 - alpha), F.col("_place") + 1) * F.coalesce(F.last(F.when(F.col("_place") == BLOCK - 1, F.col(f"_{name}")), ignorenulls=True).over(before), F.lit(0.0)) for name, (_, alpha) in columns.items()}
    return df.withColumns(means).drop("_block", "_place", *local)


def average_rank(value: str, *partition: str) -> Column:
    """Rank from 1 with ties averaged; null values have none."""
    window = Window.partitionBy(*partition, F.col(value).isNull()).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(window) + (ties - 1) / 2)


def percent_rank(value: str, *partition: str) -> Column:
    """Average rank as a share of the partition's values, times 100."""
    return average_rank(value, *partition) / F.count(value).over(Window.partitionBy(*partition)) * 100
