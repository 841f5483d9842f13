"""Default thresholds of all scans; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: Time at which time-dependent queries are evaluated; nothing reads a clock.
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Limits:
    """The defaults that results must agree with."""

    pair_cost: float = 0.99
    pair_liquidity: float = 500.0
    venue_gap: float = 0.03
    match_floor: float = 0.3
    match_weak: float = 0.5
    shared_entities: int = 2
    large_trade: float = 500.0
    large_trades: int = 3
    wallet_volume: float = 5000.0
    wallets_kept: int = 20
    size_tolerance: float = 0.01
    suspicious_positions: int = 50
    suspicious_value: float = 1000.0
    board_profit: float = 50_000.0
    board_win_rate: float = 0.60
    board_trades: int = 100
    watch_value: float = 100_000.0
    watch_changes: int = 5
    watch_value_with_changes: float = 50_000.0
    trades_looked_at: int = 20
    cooldown_s: int = 900
    duplicate_s: int = 60
    alerts_kept: int = 100
    log_lines_shown: int = 5
    log_line_length: int = 100
    trend_delta: float = 0.1
    history_kept: int = 10
    mm_spread: float = 0.01
    mm_scan_spread: float = 0.015
    mm_scan_depth: float = 5000.0
    mm_low: float = 0.05
    mm_high: float = 0.95
    kelly_fraction: float = 0.25
    news_report: int = 30
    news_signal: int = 50
    approval: float = 0.5
    idle_hours: int = 6


LIMITS = Limits()
