"""Defaults of the scan. Thresholds are doubles: ladders compare exactly."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScanConfig:
    base_length_max: int = 60
    vcp_windows: tuple[int, int, int] = (10, 20, 40)
    range_compression: float = 0.05
    atr_period: int = 20
    adr_period: int = 20
    volume_period: int = 20
    dollar_volume_min: float = 10_000_000.0
    dryup_window: int = 10
    volume_history: int = 252
    rs_periods: tuple[int, ...] = (20, 60, 120, 252)
    rs_skip_days: int = 5
    rs_rank_window: int = 60
    prior_move_window: int = 60
    rr_min: float = 3.0
    stop_adr_multiple: float = 5.0
    min_price: float = 5.0
    min_adr: float = 0.08
    max_from_high: float = 0.30
    min_prior_move: float = 0.75
    min_consol_days: int = 5
    weights: dict[str, float] = field(default_factory=lambda: {"base": 10.0, "trend": 15.0, "rs": 25.0, "volume": 50.0})
    sub_max: dict[str, float] = field(default_factory=lambda: {"base": 20.0, "trend": 14.0, "rs": 30.0, "volume": 30.0})
    use_coverage: bool = True
    use_tsmom: bool = False
    missing_prior_move_fails: bool = False
    strong_buy: float = 80.0
    buy: float = 70.0
    watch: float = 60.0


DEFAULT = ScanConfig()
