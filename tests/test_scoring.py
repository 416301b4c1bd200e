"""Ladders, filters and totals on one-row tables."""

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import scoring as S

#: A row that earns every point.
IDEAL = dict(
    close=50.0, high=51.0, low=49.0, sma_10=49.0, sma_20=47.0, sma_50=44.0, sma_150=39.0, sma_200=36.0, ma_alignment=True, mas_rising=True, ema10_surf_ratio=0.80, pct_from_52wk_high=-0.05, pct_from_90d_high=-0.05,
    approaching_annual_high=True, consol_range_60=0.01, range_10=0.01, consol_days=40, vcp_contracting=True, vcp_contraction_ratio=0.20, vcp_contraction_count=3, swing_low_count=3, swing_high_count=3, prior_move_pct=2.5,
    days_since_power_move=30, is_trigger_bar=False, obv_trend=False, weekly_aligned=True, abs_return_63d=0.2, dollar_volume=150e6, volume_declining=True, volume_dryup_ratio=0.50, adr_pct=0.13, relative_volume=0.80,
    close_range_position=0.5, volume_vs_6m_avg=0.5, rs_comp_252=0.1, rs_comp_120=0.25, rs_comp_60=0.55, stop_distance_pct=0.06, stop_distance_20d_pct=0.06, potential_r=6.0, rs_rank=90.0,
)


def row(spark, **changes):
    values = IDEAL | changes
    kinds = {bool: "boolean", int: "long", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v if v is not None else IDEAL[k])]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def value(spark, column, **changes):
    return row(spark, **changes).select(column.alias("x")).first()[0]


def test_ideal_row_is_one_hundred(spark):
    got = S.scored(row(spark), multiplier=0.5).first()
    assert (got.base_score, got.trend_score, got.rs_score, got.volume_score) == (20.0, 14.0, 30.0, 30.0)
    assert got.raw_score == pytest.approx(100.0) and got.grade == "A+"
    assert got.total_score == pytest.approx(50.0) and got.signal == "PASS"


@pytest.mark.parametrize("adr, points", [(0.12, 10.0), (0.149, 10.0), (0.15, 9.0), (0.20, 9.0), (0.21, 5.5), (0.25, 2.0), (0.10, 7.5), (0.08, 5.0), (0.07, 2.5), (0.06, 0.0), (None, 0.0)])
def test_adr_ladder_is_not_monotone(spark, adr, points):
    assert value(spark, S.adr_points(), adr_pct=adr) == points


@pytest.mark.parametrize("rank, points", [(95.0, 8.0), (94.9, 10.0), (85.0, 10.0), (75.0, 7.0), (65.0, 4.0), (64.9, 0.0), (None, 0.0)])
def test_rank_ladder(spark, rank, points):
    assert value(spark, S.rank_points(F.col("rs_rank")), rs_rank=rank) == points


@pytest.mark.parametrize(
    "changes, reasons",
    [
        (dict(close=5.0, sma_50=4.0), []), (dict(close=4.99, sma_50=4.0), ["price"]), (dict(adr_pct=0.08), []), (dict(adr_pct=0.079), ["adr"]), (dict(sma_50=50.0), []), (dict(rs_comp_252=0.0), []),
        (dict(pct_from_52wk_high=-0.6, pct_from_90d_high=-0.08), []), (dict(pct_from_52wk_high=-0.6, pct_from_90d_high=-0.4), ["from_high"]), (dict(pct_from_52wk_high=None), []), (dict(pct_from_52wk_high=None, pct_from_90d_high=None), ["from_high"]),
        (dict(prior_move_pct=None), []), (dict(adr_pct=None, dollar_volume=None), []), (dict(close=4.0, sma_50=5.0, consol_days=4), ["price", "below_sma50", "consolidation"]),
    ],
)
def test_filters_fail_on_known_values_only(spark, changes, reasons):
    got = S.filtered(row(spark, **changes)).first()
    assert got.filter_reasons == reasons and got.passes_filters == (not reasons)


def test_failing_rows_show_zero_null_or_keep(spark):
    bad = row(spark, close=4.0, sma_50=3.0)
    assert S.scored(bad).first().raw_score == 0.0 and S.scored(bad).first().grade == ""
    assert S.scored(bad, failed="null").first().raw_score is None
    assert S.scored(bad, failed="keep").first().raw_score > 0
