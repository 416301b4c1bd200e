"""Searches for the weights of the four components: objectives of many weight sets at once, a solver, and walk-forward choices.

Component scores come off ladders, so rows share few profiles (what the four scores are). Rows are summed by profile once; every weight set is
then tried on the profiles, whose number the ladders bound whatever the rows. The composite of a set is kept to hundredths, so
a set has at most 10,001 steps; quartiles, ranks and correlations are read from the steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import ranks_of_values
from ..functions.rolling import ratio, rounded
from ..sources.scratch import written

c = F.col

COMPONENTS = ("base", "trend", "rs", "volume")
NAMES = tuple(f"w_{k}" for k in COMPONENTS)
#: A gain that counts as a peak, the cap on a gain in risks, bounds of a weight, strength of the pull to given weights.
PEAK_GAIN = 0.05
RISK_CAP = 10.0
LOWEST, HIGHEST = 10.0, 50.0
STRENGTH = 0.005
#: Gaps between training and test from which a choice is called overfitted.
OVERFIT, MILD = 0.05, 0.02

WeightSet = tuple[float, float, float, float]


def weight_sets(step: int = 10, low: int = 10, high: int = 50) -> list[tuple[int, int, int, int]]:
    """Weights of base, trend, rs and volume, each from low to high, together 100."""
    steps = range(low, high + 1, step)
    return [(a, b, r, 100 - a - b - r) for a in steps for b in steps for r in steps if low <= 100 - a - b - r <= high]


def simulated() -> Column:
    """What a trade gives: a breakout before the stop, the best gain of 20 days up to RISK_CAP risks; a stop before, the loss; else the realized change."""
    risk = F.greatest(F.coalesce(c("stop_distance_pct"), F.lit(0.05)), F.lit(0.001))
    broke, stopped = c("days_to_breakout"), c("days_to_stop")
    first = broke.isNotNull() & (stopped.isNull() | (broke <= stopped))
    return F.when(first, F.least(c("max_gain_20d"), risk * RISK_CAP)).when(stopped.isNotNull(), -risk).otherwise(c("realized"))


def _with_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    held = written(rows.groupBy(value).agg(F.count("*").alias("k")), "values")
    return rows.join(ranks_of_values(held, value).select(value, c("rank").alias(name)), value)


def profiles(rows: DataFrame, sub_max: dict[str, float], by: tuple[str, ...] = (), ranks: bool = True) -> DataFrame:
    """Per profile (each component as a share of its maximum): rows, winners, gains and losses, and sums for correlations. ranks: also sums of
    the gains' ranks over all rows, for rank correlations."""
    kept = rows.where("max_gain_20d is not null and max_gain_10d is not null and realized is not null").withColumn("_sim", simulated())
    shares = (F.least(F.greatest(c(f"{k}_score") / sub_max[k], F.lit(0.0)), F.lit(1.0)).alias(f"_{k}") for k in COMPONENTS)
    known = kept.select(*by, *shares, c("max_gain_20d").alias("y20"), c("max_gain_10d").alias("y10"), c("realized").alias("y"), "_sim")
    if ranks:  # the rows are read once for each rank and its bins
        known = written(known, "profiles")
        known = _with_rank(_with_rank(known, "y20", "_r20"), "y10", "_r10")
    up, down = (lambda v: F.sum(F.when(c(v) > 0, c(v)).otherwise(0.0))), (lambda v: F.sum(F.when(c(v) < 0, -c(v)).otherwise(0.0)))
    count = lambda cond: F.count(F.when(cond, 1))
    sums = {"n": F.count("*"), "won": count(c("y") > 0), "peaks": count(c("y20") >= PEAK_GAIN), "sim_won": count(c("_sim") > 0)}
    sums |= {"up": up("y"), "down": down("y"), "sim_up": up("_sim"), "sim_down": down("_sim"), "s": F.sum("y"), "s20": F.sum("y20"), "s10": F.sum("y10")}
    sums |= {"ss": F.sum(c("y") * c("y")), "ss20": F.sum(c("y20") * c("y20")), "ss10": F.sum(c("y10") * c("y10"))}
    if ranks:
        sums |= {"r20": F.sum("_r20"), "r10": F.sum("_r10"), "rr20": F.sum(c("_r20") * c("_r20")), "rr10": F.sum(c("_r10") * c("_r10"))}
    return known.groupBy(*by, *(f"_{k}" for k in COMPONENTS)).agg(*(v.alias(k) for k, v in sums.items()))


def objectives(held: DataFrame, sets: list[WeightSet], by: tuple[str, ...] = ()) -> DataFrame:
    """held: profiles. Every objective for every set of weights (and group of by): correlations and rank correlations of the composite, and
    the best quarter's winners, peaks and profit factors."""
    own = [f"_{k}" for k in COMPONENTS]
    sums = [k for k in held.columns if k not in (*by, *own)]
    listed = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(NAMES, s, strict=True))) for s in sets))
    composite = sum((c(f"w.{w}") * c(k) for w, k in zip(NAMES[1:], own[1:], strict=True)), c(f"w.{NAMES[0]}") * c(own[0]))
    each = held.withColumn("w", F.explode(listed)).withColumn("x", F.floor(composite * 100 + 0.5))
    steps = each.groupBy(*by, "w", "x").agg(*(F.sum(k).alias(k) for k in sums))
    group = Window.partitionBy(*by, "w")
    upto = group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # at most 10,001 steps
    steps = steps.withColumns({"_all": F.sum("n").over(group), "_upto": F.sum("n").over(upto)})
    # The upper quartile, interpolated between the rows on both sides, is reached by the steps whose last row has at least this place.
    top = c("_upto") - 1 >= F.ceil(0.75 * (c("_all") - 1))
    best = lambda k: F.sum(F.when(top, c(k)))
    n, rank = F.sum("n"), c("_upto") - (c("n") - 1) / 2

    def corr(x: Column, s: str, ss: str) -> Column:
        sx, sxx = F.sum(x * c("n")), F.sum(x * x * c("n"))
        return ratio(n * F.sum(x * c(s)) - sx * F.sum(s), F.sqrt((n * sxx - sx * sx) * (n * F.sum(ss) - F.sum(s) * F.sum(s))))

    x = c("x").cast("double")
    shown = {"corr_20d": corr(x, "s20", "ss20"), "corr_10d": corr(x, "s10", "ss10"), "corr_realized": corr(x, "s", "ss")}
    if "r20" in sums:
        shown |= {"spearman_20d": corr(rank, "r20", "rr20"), "spearman_10d": corr(rank, "r10", "rr10")}
    shown |= {"win_rate": ratio(best("won"), best("n")), "profit_factor": ratio(best("up"), best("down")), "mean_realized": ratio(best("s"), best("n"))}
    shown |= {"peak_rate": ratio(best("peaks"), best("n")), "mean_peak": ratio(best("s20"), best("n"))}
    shown |= {"sim_pf": ratio(best("sim_up"), best("sim_down")), "sim_win_rate": ratio(best("sim_won"), best("n"))}
    out = steps.groupBy(*by, "w").agg(n.alias("n"), best("n").alias("n_top"), *(rounded(v, 4).alias(k) for k, v in shown.items()))
    out = out.withColumn("composite", rounded(0.5 * c("corr_20d") + 0.5 * c("peak_rate"), 4))
    return out.select(*by, *(c(f"w.{k}").alias(k) for k in NAMES), *(k for k in out.columns if k not in (*by, "w")))


def weight_objectives(rows: DataFrame, sub_max: dict[str, float], sets: list[WeightSet] | None = None) -> DataFrame:
    """Objectives of the grid's sets over all rows."""
    return objectives(profiles(rows, sub_max), sets or weight_sets())


def penalised(value: Column, current: WeightSet | None, strength: float = STRENGTH) -> Column:
    """Less strength times the squared shares by which a set departs from the current one."""
    if current is None:
        return value
    return value - strength * sum((F.pow((c(k) - v) / 100, F.lit(2.0)) for k, v in zip(NAMES, current, strict=True)), F.lit(0.0))


def best_weights(found: DataFrame, objective: str = "sim_pf", current: WeightSet | None = None, strength: float = STRENGTH) -> DataFrame:
    """The set with the best objective, with current weights less the penalty. Ties: the smaller weights of base, trend and rs."""
    valued = found.withColumn("value", rounded(penalised(c(objective), current, strength))).where("value is not null")
    return valued.orderBy(F.desc("value"), *NAMES[:3]).limit(1)  # the best of a few sets: the feature


#: Steps of the solver: first and last.
FIRST_STEP, LAST_STEP = 8.0, 0.25


def starts(restarts: int, seed: int) -> list[WeightSet]:
    """Seeded points of the simplex within the bounds, on the lattice of the last step."""
    draws = np.random.default_rng(seed).dirichlet(np.ones(len(COMPONENTS)), restarts) * 100
    return [_within(x) for x in draws]


def _within(x: np.ndarray) -> WeightSet:
    """The nearest way into the bounds at a total of 100, in steps of LAST_STEP: what is over or short is spread over weights that have room."""
    units = np.round(np.clip(x, LOWEST, HIGHEST) / LAST_STEP).astype(int)
    low, high, total = (round(v / LAST_STEP) for v in (LOWEST, HIGHEST, 100.0))
    while (over := int(units.sum()) - total) != 0:
        room = units - low if over > 0 else high - units
        k = int(np.argmax(room))
        units[k] -= int(np.sign(over)) * min(abs(over), max(1, int(room[k]) // 2))
    return tuple(float(u) * LAST_STEP for u in units)  # type: ignore[return-value]


def _moves(x: WeightSet, step: float) -> list[WeightSet]:
    """Weight sets a step away: some weight goes from one component to another."""
    out = []
    for i in range(len(x)):
        for j in range(len(x)):
            y = list(x)
            y[i], y[j] = y[i] - step, y[j] + step
            if i != j and y[i] >= LOWEST and y[j] <= HIGHEST:
                out.append(tuple(y))
    return out


def solved(
    held: DataFrame, objective: str = "sim_pf", *, restarts: int = 20, seed: int = 42, current: WeightSet | None = None, strength: float = STRENGTH
) -> DataFrame:
    """held: profiles, written or cached, as they are read again and again. A row for each restart with the weights it ends at, their value, and whether they are best.

    A pattern search on the simplex: each restart moves to the best of the sets a step away while one is better, then halves the step.
    All restarts go on together, so a generation is one aggregation over the profiles. Restart 0 begins at the grid's
    best, so the result is never below it. Values are compared to four digits, as objectives shows them, less the penalty; ties stay where they are.
    """
    known: dict[WeightSet, float] = {}

    def value_all(sets: list[WeightSet]) -> None:
        new = list(dict.fromkeys(s for s in sets if s not in known))
        if new:
            scored = objectives(held, new).select(*NAMES, penalised(c(objective), current, strength).alias("value"))
            known.update(dict.fromkeys(new, float("-inf")))
            known.update({tuple(r[:4]): r["value"] for r in scored.collect() if r["value"] is not None})  # a row for each set of a generation

    grid = [tuple(map(float, s)) for s in weight_sets()]
    value_all(grid)
    at = [max(grid, key=lambda s: (known[s], [-v for v in s])), *starts(restarts, seed)]
    step = [FIRST_STEP] * len(at)
    value_all(at)
    while live := [k for k in range(len(at)) if step[k] >= LAST_STEP]:
        moves = {k: _moves(at[k], step[k]) for k in live}
        value_all([m for k in live for m in moves[k]])
        for k in live:
            best = max(moves[k], key=lambda s: (known[s], [-v for v in s]), default=at[k])
            if known[best] > known[at[k]] + 1e-12:
                at[k] = best
            else:
                step[k] /= 2
    top = max(range(len(at)), key=lambda k: (known[at[k]], [-v for v in at[k]], -k))
    rows = [(k, *x, known[x] if known[x] > float("-inf") else None, k == top) for k, x in enumerate(at)]
    return held.sparkSession.createDataFrame(rows, "restart long, " + ", ".join(f"{k} double" for k in NAMES) + ", value double, is_best boolean")


def fold_table(spark, first_day, last_day, **spans) -> DataFrame:
    """Purged walk-forward folds between two days as a table; none where a day is missing."""
    from .reports import folds

    listed = folds(first_day.isoformat(), last_day.isoformat(), **spans) if first_day else []
    return spark.createDataFrame(listed, "fold int, train_from date, train_to date, test_from date, test_to date")


def in_folds(rows: DataFrame, fold: DataFrame, date: str = "scan_date") -> DataFrame:
    """rows once for each fold and side (train, test) that holds their date; what falls into the gap between is on neither."""
    joined = rows.join(F.broadcast(fold), (c(date) >= c("train_from")) & (c(date) < c("test_to")))  # a row for each quarter of history
    side = F.when(c(date) <= c("train_to"), "train").when(c(date) >= c("test_from"), "test")
    return joined.withColumn("side", side).where("side is not null").drop("train_from", "train_to", "test_from", "test_to")


def walk_forward_weights(rows: DataFrame, sub_max: dict[str, float], objective: str = "corr_20d", *, sets: list[WeightSet] | None = None, least_train: int = 20, least_test: int = 5, **spans) -> DataFrame:
    """Per fold: the set that is best in training, its value there and in the test, their gap, and over all folds the mean gap with a verdict.

    All folds and sets are one aggregation: rows are summed by date and profile, dates go to their folds, and each fold's best set meets its own
    test. Ties: the smaller weights. Folds with too few rows on a side are left out."""
    daily = profiles(rows, sub_max, ("scan_date",), ranks=False)
    span = rows.agg(F.min("scan_date"), F.max("scan_date")).first()
    fold = fold_table(rows.sparkSession, span[0], span[1], **spans)
    keys = ("fold", "side", *(f"_{k}" for k in COMPONENTS))
    placed = in_folds(daily, fold)
    parts = placed.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in placed.columns if k not in (*keys, "scan_date")))
    found = objectives(parts, sets or weight_sets(), ("fold", "side"))
    order = F.struct(c(objective), *(-c(k) for k in NAMES[:3]), -c(NAMES[3]))
    train = found.where("side = 'train'").groupBy("fold").agg(F.max_by(F.struct(*NAMES, c("n").alias("n_train"), c(objective).alias("train_value")), F.when(c(objective).isNotNull(), order)).alias("b")).select("fold", "b.*")
    test = found.where("side = 'test'").select("fold", *NAMES, c("n").alias("n_test"), c(objective).alias("test_value"))
    both = train.join(test, ["fold", *NAMES]).where((c("n_train") >= least_train) & (c("n_test") >= least_test)).withColumn("gap", c("train_value") - c("test_value"))
    mean = F.avg("gap").over(Window.partitionBy())  # a row for each fold
    verdict = F.when(c("_mean") > OVERFIT, "overfitted").when(c("_mean") > MILD, "mild").otherwise("ok")
    dated = both.withColumn("_mean", mean).join(F.broadcast(fold), "fold")
    return dated.select(c("fold").cast("long").alias("fold"), "train_from", "train_to", "test_from", "test_to", "n_train", "n_test", *NAMES, "train_value", "test_value", rounded("gap", 4).alias("gap"), rounded("_mean", 4).alias("mean_gap"), verdict.alias("verdict"))
