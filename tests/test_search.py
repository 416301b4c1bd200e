"""Weight search, resampling, percentiles, filter combinations and held positions against brute force on small tables."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.functions.rolling import rounded, significant
from quarryloom.operators import outcomes as O, positions as H, research as Q, resampling as B, validation as V, weights as W

DAY = dt.date(2020, 1, 1)
SUB_MAX = {"base": 20.0, "trend": 14.0, "rs": 30.0, "volume": 30.0}


def average_ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def spearman(x, y):
    a, b = average_ranks(x), average_ranks(y)
    return np.corrcoef(a, b)[0, 1] if a.std() and b.std() else math.nan


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        parts = [float(rng.integers(0, m * 2 + 1)) / 2 for m in (20, 14, 30, 30)]
        gain = float(np.round(rng.normal(0.02 * parts[0] / 20 + 0.1 * parts[3] / 30, 0.1), 4))
        raw = parts[0] / 2 + parts[1] * 15 / 14 + parts[2] * 25 / 30 + parts[3] * 50 / 30
        rows.append((f"S{k % 5}", DAY + dt.timedelta(days=int(k * 0.6)), *parts, float(raw), max(gain, 0.0), max(gain, 0.0) / 2, gain, 0.05, *((3, None), (None, 4), (5, 2), (None, None))[k % 4], bool(k % 3), float(rng.lognormal(0, 3)), float(k % 17)))
    names = "symbol string, scan_date date, base_score double, trend_score double, rs_score double, volume_score double, raw_score double, max_gain_20d double, max_gain_10d double, realized double, stop_distance_pct double, days_to_breakout int, days_to_stop int, stage2 boolean, tail double, step double"
    return spark.createDataFrame(rows, names).repartition(3).cache()


def objective(rows, weights, name):
    """Of one weight set, over plain rows."""
    parts = np.array([[min(max(r[f"{k}_score"] / SUB_MAX[k], 0), 1) for k in W.COMPONENTS] for r in rows])
    x = np.floor((parts[:, 0] * weights[0] + parts[:, 1] * weights[1] + parts[:, 2] * weights[2] + parts[:, 3] * weights[3]) * 100 + 0.5)
    y20 = np.array([r["max_gain_20d"] for r in rows])
    if name == "spearman_20d":
        return spearman(x, y20)
    if name == "corr_20d":
        return np.corrcoef(x, y20)[0, 1]
    top, sim = x >= np.percentile(x, 75), []
    for r in rows:
        broke, stop = r["days_to_breakout"], r["days_to_stop"]
        risk = max(r["stop_distance_pct"], 0.001)
        sim.append(min(r["max_gain_20d"], 10 * risk) if broke is not None and (stop is None or broke <= stop) else -risk if stop is not None else r["realized"])
    sim = np.array(sim)[top]
    return sim[sim > 0].sum() / -sim[sim < 0].sum()


@pytest.mark.parametrize("name", ["spearman_20d", "corr_20d", "sim_pf"])
def test_objectives_are_those_of_the_rows(labelled, name):
    rows = labelled.collect()
    for r in W.weight_objectives(labelled, SUB_MAX, [(10, 20, 30, 40), (50, 10, 10, 30), (12.25, 30.5, 17.25, 40.0)]).collect():
        assert r[name] == pytest.approx(objective(rows, [r[k] for k in W.NAMES], name), abs=1e-4)


def test_solver_is_never_below_the_grid(labelled):
    held = W.profiles(labelled, SUB_MAX).cache()
    found = W.solved(held, "spearman_20d", restarts=3).collect()
    grid = max(r["spearman_20d"] for r in W.objectives(held, W.weight_sets()).collect())
    best = [r for r in found if r["is_best"]]
    assert len(found) == 4 and len(best) == 1 and best[0]["value"] >= grid and best[0]["value"] == max(r["value"] for r in found)
    for r in found:
        weights = [r[k] for k in W.NAMES]
        assert sum(weights) == 100 and all(W.LOWEST <= w <= W.HIGHEST for w in weights)
    assert best[0]["value"] == pytest.approx(objective(labelled.collect(), [best[0][k] for k in W.NAMES], "spearman_20d"), abs=1e-4)
    assert [tuple(r) for r in W.solved(held, "spearman_20d", restarts=3).collect()] == [tuple(r) for r in found]


def test_a_pull_to_given_weights_is_taken_off(labelled):
    held, current = W.profiles(labelled, SUB_MAX).cache(), (10.0, 15.0, 25.0, 50.0)
    free, held_back = ([r for r in W.solved(held, "corr_20d", restarts=1, current=w, strength=100.0).collect() if r["is_best"]][0] for w in (None, current))
    away = lambda r: sum((r[k] - v) ** 2 for k, v in zip(W.NAMES, current, strict=True))
    assert away(held_back) < 1 and away(free) > away(held_back)


def test_starts_are_seeded_and_within_bounds():
    made = W.starts(50, 3)
    assert made == W.starts(50, 3) != W.starts(50, 4)
    assert all(sum(x) == 100 and min(x) >= W.LOWEST and max(x) <= W.HIGHEST for x in made)


def test_solver_of_no_rows(labelled):
    found = W.solved(W.profiles(labelled.limit(0), SUB_MAX), "corr_20d", restarts=1).collect()
    assert [r["value"] for r in found] == [None, None]
    assert W.walk_forward_weights(labelled.limit(0), SUB_MAX).collect() == []


def test_walk_forward_carries_the_training_choice_to_the_test(labelled):
    rows = labelled.collect()
    found = W.walk_forward_weights(labelled, SUB_MAX, train_months=12, test_months=3).orderBy("fold").collect()
    assert len(found) >= 3
    for f in found:
        train = [r for r in rows if f["train_from"] <= r["scan_date"] <= f["train_to"]]
        test = [r for r in rows if f["test_from"] <= r["scan_date"] < f["test_to"]]
        assert (f["n_train"], f["n_test"]) == (len(train), len(test)) and (f["test_from"] - f["train_to"]).days == 70
        values = {s: np.floor(objective(train, s, "corr_20d") * 1e4 + 0.5) / 1e4 for s in W.weight_sets()}
        best = min(values, key=lambda s: (-values[s], s))
        assert tuple(f[k] for k in W.NAMES) == best and f["train_value"] == pytest.approx(values[best], abs=1e-9)
        assert f["test_value"] == pytest.approx(objective(test, best, "corr_20d"), abs=1e-4)
    gap = np.mean([f["train_value"] - f["test_value"] for f in found])
    assert {f["verdict"] for f in found} == {"overfitted" if gap > 0.05 else "mild" if gap > 0.02 else "ok"}


def test_percentiles_and_ranks_of_a_long_tail(labelled):
    shares = (0.0, 0.01, 0.25, 0.5, 0.975, 1.0)
    found = {(r["feature"], r["share"]): r["value"] for r in V.percentiles(labelled, ("tail", "step"), shares).collect()}
    for name in ("tail", "step"):
        values = [r[name] for r in labelled.collect()]
        for q in shares:
            assert found[name, q] == pytest.approx(np.percentile(values, 100 * q), rel=1e-12)
        held = labelled.groupBy(name).agg(F.count("*").alias("k"))
        ranks = {r[name]: r["rank"] for r in V.ranks_of_values(held, name).collect()}
        assert ranks == dict(zip(values, average_ranks(values), strict=True))
    assert V.percentiles(labelled.limit(0), ("tail",), (0.5,)).collect() == []


def test_paired_bootstrap_is_that_of_repeated_rows(labelled):
    rows = [r for r in labelled.collect()]
    found = B.paired_bootstrap(labelled, "raw_score", "rs_score", "realized", replicates=12).first()
    diffs = []
    for k in range(12):
        day = {d: B.date_weights(np.array([(d - dt.date(1970, 1, 1)).days]), k, k + 1)[0, 0] for d in {r["scan_date"] for r in rows}}
        again = [r for r in rows for _ in range(day[r["scan_date"]])]
        level = lambda n, p: [math.floor(r[n] * 10**p + 0.5) for r in again]  # noqa: E731, B023
        diffs.append(spearman(level("raw_score", 2), level("realized", 3)) - spearman(level("rs_score", 2), level("realized", 3)))
    assert tuple(found) == pytest.approx((12, np.mean(diffs), *np.percentile(diffs, [2.5, 97.5]), np.mean(np.array(diffs) > 0)), abs=2e-6)
    assert tuple(B.paired_bootstrap(labelled.limit(0), "raw_score", "rs_score", "realized", replicates=3).first()) == (0, None, None, None, None)


def test_draws_are_poisson_of_mean_one():
    drawn = B.date_weights(np.arange(200), 0, 200)
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - math.exp(-1)) < 0.01
    assert (drawn[:, 50:60] == B.date_weights(np.arange(200), 50, 60)).all()


def controlled_brute(rows, weights=None):
    names = ("tail", "step")
    clip = lambda x: np.clip(x, *np.percentile(x, [1, 99]))
    columns = [clip(np.array([r[n] for r in rows])) for n in names]
    x = np.column_stack([[float(r["stage2"]) for r in rows], *((v - v.mean()) / v.std(ddof=1) for v in columns), np.ones(len(rows))])
    w = np.ones(len(rows)) if weights is None else weights
    y = clip(np.array([r["realized"] for r in rows]))
    return np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]


def test_controlled_effect_and_its_bootstrap(labelled):
    rows, terms = labelled.collect(), ["flag", "tail", "step", "intercept"]
    found = {r["term"]: r["coefficient"] for r in B.controlled_effect(labelled, F.col("stage2"), ("tail", "step"), "realized").collect()}
    assert [found[t] for t in terms] == pytest.approx(controlled_brute(rows), abs=2e-6)
    spread = {r["term"]: r for r in B.controlled_bootstrap(labelled, F.col("stage2"), ("tail", "step"), "realized", replicates=9).collect()}
    each = []
    for k in range(9):
        days = np.array([(r["scan_date"] - dt.date(1970, 1, 1)).days for r in rows])
        own, which = np.unique(days, return_inverse=True)
        each.append(controlled_brute(rows, B.date_weights(own, k, k + 1)[which, 0].astype(float)))
    for i, t in enumerate(terms):
        v = np.array(each)[:, i]
        assert tuple(spread[t])[1:] == pytest.approx((9, v.mean(), *np.percentile(v, [2.5, 97.5]), (v > 0).mean()), abs=3e-6)
    assert B.controlled_bootstrap(labelled.limit(0), F.col("stage2"), ("tail",), "realized", replicates=2).collect() == []


def test_ablation_uses_statistics_of_the_rows_before_the_holdout(labelled):
    rows = labelled.collect()
    found = B.ablation(labelled, "realized").collect()
    last = max(r["scan_date"] for r in rows)
    hold = dt.date(last.year + (last.month - 7) // 12, (last.month - 7) % 12 + 1, min(last.day, 28))
    dev = [r for r in rows if r["scan_date"] < hold - dt.timedelta(days=70)]
    fit = {p: (np.mean([r[p] for r in dev]), np.std([r[p] for r in dev], ddof=1)) for p in B.PARTS}
    holdout = [r for r in rows if r["scan_date"] >= hold]
    for f in found:
        if f["fold"] == -1 and last.day <= 28:
            own = B.PARTS if f["candidate"] == "full" else tuple(f"{p}_score" for p in f["candidate"].split("+"))
            score = [round(r["raw_score"], 9) if f["candidate"] == "full" else round(np.mean([(r[p] - fit[p][0]) / fit[p][1] for p in own]), 9) for r in holdout]
            assert f["n"] == len(holdout) and f["spearman"] == pytest.approx(spearman(score, [r["realized"] for r in holdout]), abs=2e-6)
    folds = {f["fold"] for f in found}
    assert len(found) == 16 * len(folds) and len(folds) >= 2
    means = {n: np.mean([f["spearman"] for f in found if f["fold"] >= 0 and f["candidate"] == n]) for n in {f["candidate"] for f in found}}
    assert [f["candidate"] for f in sorted(found, key=lambda f: (f["fold"], f["dev_rank"]))[:16]] == sorted(means, key=lambda n: (-round(means[n], 6), n))
    assert B.ablation(labelled.limit(0)).collect() == []


def test_bucket_bootstrap_means_are_the_rows_own(labelled):
    found = {r["bucket"]: r for r in B.bucket_bootstrap(labelled, F.when(F.col("step") < 9, 0.0).when(F.col("step") < 15, 9.0), "realized", 200).collect()}
    for low, high in ((0.0, 9), (9.0, 15)):
        values = [r["realized"] for r in labelled.collect() if low <= r["step"] < high]
        assert found[low]["n"] == len(values) and found[low]["mean"] == pytest.approx(np.mean(values), abs=1e-6)
        assert found[low]["ci_low"] < found[low]["mean"] < found[low]["ci_high"]
    assert set(found) == {0.0, 9.0}


def test_filter_sweep_is_every_combination(spark):
    names, rng = ("a", "b", "c", "d"), np.random.default_rng(1)
    rows = [([n for n in names if rng.random() < 0.4], None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))) for _ in range(300)]
    found = {r["combo"]: r for r in Q.filter_sweep(spark.createDataFrame(rows, "filter_reasons array<string>, fwd_20 double"), names).collect()}
    assert set(found) == set(range(16))
    for combo, r in found.items():
        own = [n for k, n in enumerate(names) if combo >> k & 1]
        kept = [y for fails, y in rows if not set(own) & set(fails)]
        known = [y for y in kept if y is not None]
        assert r["filters"] == ",".join(own) and (r["n"], r["n_returns"]) == (len(kept), len(known))
        assert r["mean_return"] == pytest.approx(np.mean(known), abs=1e-6) and r["win_rate"] == pytest.approx(np.mean(np.array(known) > 0), abs=1e-6)


def test_positions_meet_only_while_both_are_held(spark):
    rng, days = np.random.default_rng(3), [DAY + dt.timedelta(days=k) for k in range(80)]
    close = {s: np.cumprod(1 + rng.normal(0, 0.02, 80)) * 50 for s in "ABCD"}
    bars = spark.createDataFrame([(s, d, float(v)) for s in "ABCD" for d, v in zip(days, close[s], strict=True)], "symbol string, bar_date date, close double")
    spans = {"A": [(5, 30), (20, 40)], "B": [(10, 45)], "C": [(50, 70)], "D": [(0, 4), (60, 75)]}
    positions = spark.createDataFrame([(s, days[a], days[b], 0.1) for s, x in spans.items() for a, b in x], "symbol string, entry_date date, exit_date date, weight double")
    held = {s: {k for a, b in x for k in range(a, b + 1)} - {0} for s, x in spans.items()}
    index = bars.where("symbol = 'D'")
    returns = {s: np.r_[np.nan, close[s][1:] / close[s][:-1] - 1] for s in "ABCD"}
    got = {(r["a"], r["b"]): r for r in H.held_pairs(H.held_days(positions, bars)).collect()}
    expected = {(x, y): held[x] & held[y] for x, y in itertools.combinations("ABCD", 2) if len(held[x] & held[y]) >= H.HELD_DAYS}
    assert set(got) == set(expected) == {("A", "B"), ("C", "D")}
    for (x, y), at in expected.items():
        at = sorted(at)
        assert got[x, y]["n"] == len(at) and got[x, y]["correlation"] == pytest.approx(np.corrcoef(returns[x][at], returns[y][at])[0, 1])
    row = H.held_correlation(positions, bars, index).first()
    counts = [k for k in (sum(d in h for h in held.values()) for d in range(80)) if k]
    rho = max(np.mean([r["correlation"] for r in got.values()]), 0)
    assert row["max_held"] == max(counts) and row["avg_held"] == pytest.approx(np.mean(counts), abs=1e-6)
    assert row["effective_n"] == pytest.approx(np.mean(counts) / (1 + (np.mean(counts) - 1) * rho), abs=1e-6)
    none = H.held_correlation(positions.limit(0), bars, index).first()
    assert none["n_held_corr"] == 0 and none["effective_n"] is None


def test_rounding_of_large_values(spark):
    df = spark.createDataFrame([(1.0e16 + 2,), (-3.0e17,), (4300392463724747.0,), (0.1234565,), (-1.5,), (None,)], "x double")
    found = [r[0] for r in df.select(rounded("x")).collect()]
    assert found[:3] == pytest.approx([1.0e16 + 2, -3.0e17, 4300392463724747.0], rel=1e-15) and found[3:5] == [0.123457, -1.5] and found[5] is None
    assert [r[0] for r in df.where("x > 0").select(significant("x", 3)).collect()] == pytest.approx([1.0e16, 1.0e16 * 0.43, 0.123], rel=1e-12)


def test_atr_of_an_entry_is_of_fourteen_bars_up_to_it(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        low = float(50 + rng.normal())
        rows.append(("A", DAY + dt.timedelta(days=k), low + 0.5, low + float(rng.random()) + 0.6, low, low + 0.4))
    rows += [("F", DAY + dt.timedelta(days=k), 10.0, 10.0, 10.0, 10.0) for k in range(3)] + [("N", DAY, 5.0, 5.0, 5.0, 5.0)]
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double")
    signals = spark.createDataFrame([(s, DAY + dt.timedelta(days=k), 9.9) for s, k in (("A", 0), ("A", 4), ("A", 20), ("F", 1), ("N", 0))], "symbol string, scan_date date, atr double")
    found = {(r["symbol"], (r["scan_date"] - DAY).days): r for r in O.entries(signals, bars).collect()}
    ranges = [max(rows[k][3] - rows[k][4], abs(rows[k][3] - rows[k - 1][5]), abs(rows[k][4] - rows[k - 1][5])) for k in range(1, 25)]
    for k in (0, 4, 20):
        assert found["A", k]["atr"] == pytest.approx(np.mean(ranges[max(0, k + 1 - 14) : k + 1]))
    flat = found["F", 1]
    assert flat["atr"] == pytest.approx(flat["entry"] - flat["stop"]) and ("N", 0) not in found
