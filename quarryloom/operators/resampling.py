"""Ablation of the score's components, paired bootstraps of rank correlations, and effects controlled for confounders.

Bootstraps resample whole dates: a date's weight in a replicate is a Poisson draw of mean 1 from a hash of both, so that a replicate is the same
in any task, on any retry and in SQL. Rows are summed by date first; only sums meet the replicates.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import ranks_of_values
from ..functions.rolling import ratio, rounded
from ..sources.scratch import written
from .research import holdout
from .validation import percentiles
from .weights import fold_table, in_folds

c = F.col

PARTS = ("base_score", "trend_score", "rs_score", "volume_score")
SUBSETS = [s for size in range(1, len(PARTS) + 1) for s in combinations(PARTS, size)]
FULL = "full"
#: Rank correlations of fewer rows are not shown.
LEAST = 10
#: Of Poisson draws of mean 1: the chance of at most 0, 1, 2, ...
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(6)])
REPLICATES = 2000
#: Replicates whose ranks are in memory at a time.
BLOCK = 250

Batches = Iterator[pa.RecordBatch]


def subset_name(subset: tuple[str, ...]) -> str:
    return "+".join(s.removesuffix("_score") for s in subset)


def ablation(rows: DataFrame, target: str = "max_gain_20d", *, least_train: int = 20, least_test: int = 5, **spans) -> DataFrame:
    """Rank correlation with the target of the full score and of the mean z value of each subset of its components, in each fold's test and in
    the holdout (fold -1). Means and deviations are those of the rows before the holdout; nothing else is fitted. mean_dev is a candidate's mean over
    the folds, dev_rank its place by that (ties by name), declared without the holdout.

    Rows are counted by fold and component scores, which ladders bound; candidates are tried on those counts."""
    parted = holdout(rows.where(c(target).isNotNull()).dropna(subset=[*PARTS, "raw_score"]).select("scan_date", *PARTS, "raw_score", c(target).alias("y"))).where("part is not null")
    parted = written(parted, "ablation")
    dev = parted.where("part = 'dev'")
    fit = dev.agg(F.min("scan_date").alias("a"), F.max("scan_date").alias("z"), *(f(p).alias(f"{k}_{p}") for p in PARTS for k, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
    fold = fold_table(rows.sparkSession, fit["a"], fit["z"], **spans)
    placed = in_folds(dev, fold)
    enough = placed.groupBy("fold").agg(F.count(F.when(c("side") == "train", 1)).alias("a"), F.count(F.when(c("side") == "test", 1)).alias("b")).where((c("a") >= least_train) & (c("b") >= least_test))
    tests = placed.where("side = 'test'").join(F.broadcast(enough.select("fold")), "fold")  # a row for each fold
    kept = ["fold", *PARTS, "raw_score", "y"]
    pieces = tests.select(*kept).unionByName(parted.where("part = 'holdout'").withColumn("fold", F.lit(-1)).select(*kept))
    ranked = ranks_of_values(pieces.groupBy("fold", "y").agg(F.count("*").alias("k")), "y", ("fold",)).select("fold", "y", "rank")
    by = ["fold", *PARTS, "raw_score"]
    cells = pieces.join(ranked, ["fold", "y"]).groupBy(*by).agg(F.count("*").alias("n"), F.sum("rank").alias("ry"), F.sum(c("rank") * c("rank")).alias("ryy"))

    def z(part: str) -> Column:
        sd = fit[f"sd_{part}"]
        return (c(part) - F.lit(fit[f"mean_{part}"])) / F.lit(sd) if sd else F.lit(None).cast("double")

    whole = lambda x: F.floor(x * 1e9 + 0.5)  # noqa: E731  # equal scores of different sums are ties
    listed = [F.struct(F.lit(FULL).alias("candidate"), whole(c("raw_score")).alias("x"))]
    listed += [F.struct(F.lit(subset_name(s)).alias("candidate"), whole(sum((z(p) for p in s[1:]), z(s[0])) / len(s)).alias("x")) for s in SUBSETS]
    each = cells.select("fold", "n", "ry", "ryy", F.inline(F.array(*listed))).groupBy("fold", "candidate", "x").agg(*(F.sum(k).alias(k) for k in ("n", "ry", "ryy")))
    upto = Window.partitionBy("fold", "candidate").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # a row for each sum of ladder values
    each = each.withColumn("rx", F.sum("n").over(upto) - (c("n") - 1) / 2)
    n = F.sum("n")
    middle = n * F.pow((n + 1) / 2, F.lit(2.0))
    value = ratio(F.sum(c("rx") * c("ry")) - middle, F.sqrt((F.sum(c("n") * c("rx") * c("rx")) - middle) * (F.sum("ryy") - middle)))
    found = each.groupBy("fold", "candidate").agg(n.alias("n"), F.when(n >= LEAST, value).alias("s"))
    means = found.withColumn("mean_dev", rounded(F.avg(F.when(c("fold") >= 0, c("s"))).over(Window.partitionBy("candidate"))))
    place = F.dense_rank().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last("mean_dev"), "candidate"))  # 16 rows
    return means.select(c("fold").cast("long").alias("fold"), "candidate", "n", rounded("s").alias("spearman"), "mean_dev", place.cast("long").alias("dev_rank"))


def date_weights(days: np.ndarray, first: int, last: int) -> np.ndarray:
    """(days, replicates first to last - 1): how often each date is drawn. days: numbers since 1970."""
    names = [(dt.date(1970, 1, 1) + dt.timedelta(days=int(d))).isoformat() for d in days]
    draws = [int.from_bytes(hashlib.md5(f"{d}:{r}".encode()).digest()[:4], "big") for d in names for r in range(first, last)]
    return np.searchsorted(POISSON, np.array(draws, float) / 2**32, side="right").reshape(len(names), last - first)


def _expanded(days: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights of each row's day."""
    own, which = np.unique(days, return_inverse=True)
    return date_weights(own, first, last)[which]


def _level_totals(levels: DataFrame, first: int, last: int) -> list[tuple[int, int, np.ndarray]]:
    """levels: kind, level, day, n, dealt out by kind and level. Each level's rows in each replicate."""

    def run(batches: Batches) -> Batches:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            kind, level, day, n = (batch.column(i).to_numpy() for i in range(4))
            weighed = _expanded(day, first, last) * n[:, None]
            order = np.lexsort((level, kind))
            heads = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0] | np.r_[True, np.diff(level[order]) != 0]) if len(order) else []
            for at, total in zip(order[heads], np.add.reduceat(weighed[order], heads, axis=0) if len(order) else [], strict=True):
                key = int(kind[at]), int(level[at])
                totals[key] = totals.get(key, 0) + total
        if totals:
            keys = list(totals)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([v for _, v in keys], pa.int64()), pa.array([totals[k].astype(np.int64).tobytes() for k in keys], pa.binary())], names=["kind", "level", "totals"])

    found = levels.mapInArrow(run, "kind int, level long, totals binary").collect()  # a row for each level, which the resolution bounds
    return [(r["kind"], r["level"], np.frombuffer(r["totals"], np.int64)) for r in found]


def paired_bootstrap(rows: DataFrame, first: str, second: str, target: str = "max_gain_20d", *, replicates: int = REPLICATES, score_digits: int = 2, target_digits: int = 3) -> DataFrame:
    """One row: how much better the first score's rank correlation with the target is than the second's, over replicates of whole dates, the
    same for both: mean, 95 % interval, and the share above 0. Replicates with fewer than LEAST rows or without spread are left out.

    Values are taken to the given digits, so they have a bounded number of levels. Of each replicate block, levels are totalled by tasks that hold
    them, ranks are read from the totals, and a second pass over the counted rows adds up products of ranks: exact ranks of every
    replicate, without a shuffle of rows times replicates."""
    level = lambda name, digits: F.floor(c(name) * 10.0**digits + 0.5)
    known = rows.dropna(subset=[first, second, target]).select(F.unix_date("scan_date").alias("day"), level(first, score_digits).alias("a"), level(second, score_digits).alias("b"), level(target, target_digits).alias("y"))
    cells = written(known.groupBy("day", "a", "b", "y").agg(F.count("*").alias("n")), "paired")
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), c(x).alias("level")) for k, x in enumerate("aby")))
    levels = written(cells.select("day", "n", F.inline(listed)).groupBy("kind", "level", "day").agg(F.sum("n").alias("n")).select("kind", "level", "day", "n"), "paired-levels")
    values: list[tuple[float, float]] = []
    for low in range(0, replicates, BLOCK):
        high = min(low + BLOCK, replicates)
        totals = _level_totals(levels.repartition("kind", "level"), low, high)
        values += _block_correlations(cells, totals, low, high)
    diffs = np.array([a - b for a, b in values if np.isfinite(a) and np.isfinite(b)])
    half_up = lambda x: float(np.floor(x * 1e6 + 0.5) / 1e6)
    shown = (len(diffs), *((half_up(x) for x in (diffs.mean(), *np.percentile(diffs, [2.5, 97.5]), (diffs > 0).mean())) if len(diffs) else [None] * 4))
    return rows.sparkSession.createDataFrame([shown], "n_replicates long, mean_diff double, ci_low double, ci_high double, p_above_0 double")


def _block_correlations(cells: DataFrame, totals: list[tuple[int, int, np.ndarray]], low: int, high: int) -> list[tuple[float, float]]:
    if not totals:
        return []
    tables, squares, size = [], [], 0.0
    for kind in range(3):
        own = sorted((level, t) for k, level, t in totals if k == kind)
        held = np.array([t for _, t in own], float)
        rank = np.cumsum(held, axis=0) - (held - 1) / 2
        size = held.sum(axis=0)
        tables.append((np.array([level for level, _ in own]), rank))
        squares.append((held * rank * rank).sum(axis=0) - size * ((size + 1) / 2) ** 2)
    shared = cells.sparkSession.sparkContext.broadcast(tables)  # levels by replicates of a block: bounded by the resolution

    def run(batches: Batches) -> Batches:
        sums = np.zeros((2, high - low))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                day, a, b, y, n = (batch.column(i).slice(at, 1000).to_numpy() for i in range(5))
                (la, ra), (lb, rb), (ly, ry) = shared.value
                weighed = _expanded(day, low, high) * n[:, None] * ry[np.searchsorted(ly, y)]
                sums += [(weighed * ra[np.searchsorted(la, a)]).sum(axis=0), (weighed * rb[np.searchsorted(lb, b)]).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sums[:1]], pa.binary()), pa.array([s.tobytes() for s in sums[1:]], pa.binary())], names=["a", "b"])

    parts = cells.select("day", "a", "b", "y", "n").mapInArrow(run, "a binary, b binary").collect()  # a row for each task
    products = [sum(np.frombuffer(p[k], float) for p in parts) - size * ((size + 1) / 2) ** 2 for k in ("a", "b")]
    with np.errstate(all="ignore"):
        found = [np.where((size >= LEAST) & (squares[k] > 0) & (squares[2] > 0), products[k] / np.sqrt(squares[k] * squares[2]), np.nan) for k in range(2)]
    return list(zip(*(x.tolist() for x in found), strict=True))


def _date_products(rows: DataFrame, flag: Column, confounders: tuple[str, ...], target: str, tails: tuple[float, float]) -> tuple[DataFrame, list[str]]:
    """Per date the sums of products of the regression's columns: the flag, standardised confounders, 1 and the target, tails cut off."""
    known = rows.dropna(subset=[*confounders, target]).withColumn("flag", F.coalesce(flag, F.lit(False)).cast("double")).select("scan_date", "flag", *(c(x).cast("double").alias(x) for x in confounders), c(target).alias("y"))
    known = written(known, "controlled")
    cut = {(r["feature"], r["share"]): r["value"] for r in percentiles(known, (*confounders, "y"), tails).collect()}  # two for each column
    clip = lambda x: F.least(F.greatest(c(x), F.lit(cut.get((x, tails[0])))), F.lit(cut.get((x, tails[1])))).alias(x)
    clipped = known.select("scan_date", "flag", *map(clip, (*confounders, "y")))
    fit = clipped.agg(*(f(x).alias(f"{k}_{x}") for x in confounders for k, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
    scaled = lambda x: ((c(x) - F.lit(fit[f"mean_{x}"])) / F.lit(fit[f"sd_{x}"]) if fit[f"sd_{x}"] else F.lit(0.0)).alias(x)
    whole = clipped.select("scan_date", "flag", *map(scaled, confounders), F.lit(1.0).alias("intercept"), "y")
    terms = ["flag", *confounders, "intercept"]
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]] + [(a, "y") for a in terms]
    return whole.groupBy("scan_date").agg(*(F.sum(c(a) * c(b)).alias(f"{a}*{b}") for a, b in pairs)), terms


def _solve(sums: np.ndarray, size: int) -> np.ndarray:
    """Coefficients from the upper triangle of the products and the products with the target; the shortest where they are not unique."""
    upper = size * (size + 1) // 2
    square = np.zeros((size, size))
    square[np.triu_indices(size)] = sums[:upper]
    square = square + np.triu(square, 1).T
    return np.linalg.lstsq(square, sums[upper:], rcond=None)[0]


TAILS = (0.01, 0.99)


def controlled_effect(rows: DataFrame, flag: Column, confounders: tuple[str, ...], target: str = "max_gain_20d", tails: tuple[float, float] = TAILS) -> DataFrame:
    """(term, coefficient) of the least-squares fit of the target, tails cut off, to the flag and the standardised confounders."""
    daily, terms = _date_products(rows, flag, confounders, target, tails)
    sums = daily.agg(*(F.sum(f"`{k}`").alias(k) for k in daily.columns if k != "scan_date")).first()
    values = _solve(np.array(sums, float), len(terms)) if sums[0] is not None else [None] * len(terms)
    found = [(t, None if v is None else float(v)) for t, v in zip(terms, values, strict=True)]
    return rows.sparkSession.createDataFrame(found, "term string, coefficient double").select("term", rounded("coefficient").alias("coefficient"))


def controlled_bootstrap(rows: DataFrame, flag: Column, confounders: tuple[str, ...], target: str = "max_gain_20d", *, tails: tuple[float, float] = TAILS, replicates: int = REPLICATES) -> DataFrame:
    """Per term: the mean of its coefficient over replicates of whole dates, the 95 % interval and the share above 0. A replicate is a
    weighted sum of the dates' products and a small solution; replicates are dealt over tasks, to which the products (a row for each date) are sent."""
    daily, terms = _date_products(rows, flag, confounders, target, tails)
    dated = daily.orderBy("scan_date").collect()  # a row for each date
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.array([(r[0] - dt.date(1970, 1, 1)).days for r in dated]), np.array([r[1:] for r in dated], float)))

    def run(batches: Batches) -> Batches:
        days, products = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for r in ids if len(days) else []:
                weights = date_weights(days, int(r), int(r) + 1)[:, 0]
                if weights.any():
                    yield pa.RecordBatch.from_arrays([pa.array([int(r)] * len(terms)), pa.array(terms), pa.array(_solve(weights @ products, len(terms)))], names=["replicate", "term", "v"])

    each = spark.range(replicates).mapInArrow(run, "replicate long, term string, v double")
    at = lambda q: rounded(F.percentile("v", F.lit(q)))  # noqa: E731  # a value for each replicate
    return each.groupBy("term").agg(F.count("*").alias("n_replicates"), rounded(F.avg("v")).alias("mean"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), rounded(F.avg((c("v") > 0).cast("double"))).alias("p_above_0"))


def bucket_bootstrap(rows: DataFrame, bucket: Column, value: str, replicates: int = REPLICATES) -> DataFrame:
    """Per bucket: rows, their own mean, and a 95 % interval of it over replicates of whole dates. Sums by date and bucket meet the replicates."""
    daily = rows.where(c(value).isNotNull()).withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket", "scan_date").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    daily = written(daily, "bucket-bootstrap")
    each = daily.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.md5(F.concat(F.date_format("scan_date", "yyyy-MM-dd"), F.lit(":"), c("replicate").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = sum(((u >= float(b)).cast("int") for b in POISSON), F.lit(0))
    means = each.withColumn("w", weight).groupBy("bucket", "replicate").agg(ratio(F.sum(c("w") * c("s")), F.nullif(F.sum(c("w") * c("n")), F.lit(0))).alias("m"))
    at = lambda q: rounded(F.percentile("m", F.lit(q)))  # noqa: E731  # a value for each replicate
    spread = means.groupBy("bucket").agg(at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))
    own = daily.groupBy("bucket").agg(F.sum("n").alias("n"), rounded(F.sum("s") / F.sum("n")).alias("mean"))
    return own.join(spread, "bucket")
