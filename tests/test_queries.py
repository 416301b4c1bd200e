"""Every query with SQL gives the same rows at the smallest scale; the others run."""

import datetime
import math

import pytest

from quarryloom.plans import labels, market, research, search, validation
from quarryloom.sources.scratch import scoped

PLANS = (market, labels, research, validation, search)
QUERIES = {k: scoped(f) for plan in PLANS for k, f in plan.queries().items()}
SQL = {k: text for plan in PLANS for k, text in plan.oracle_sql().items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    return v.date() if isinstance(v, datetime.datetime) else v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=2e-5, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", ["bars", "index_bars", "rs_rank", "breakout_level", "weekly_alignment", "total_score", "rs_calibration", "index_trend", "outcomes_historical", "exit_fixed_r", "exit_atr_trail", "outcomes_live", "adjusted_score", "monthly_returns", "signal_thresholds", "score_brackets", "signal_validity", "upsert_latest", "index_gate", "validation_summary", "weight_objectives", "follow_through", "exit_metrics", "filter_sweep"])
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(mine) == len(theirs) > 0
    assert all(same(x, y) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_features_plan_to_one_exchange_by_symbol(spark, sf):
    from quarryloom.operators import features as X

    df = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_partkey % 5 as string) symbol", "to_date(l_shipdate) bar_date", "l_tax open", "l_tax high", "l_tax low", "l_tax close", "cast(l_quantity as bigint) volume")
    plan = X.pivots(X.prior_moves(X.consolidation(X.contractions(X.volumes(X.ranges(X.ma_relations(X.moving_averages(df))))))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
