"""Sizing, labels, scorecards and risk reviews: projections over one row each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.columns import bands, clamp, points, ratio, reasons, rounded


def kelly(p: Column, b: Column) -> Column:
    """The Kelly fraction, 0 outside 0 < p < 1 or without odds."""
    valid = (p > 0) & (p < 1) & (b > 0)
    return F.when(valid, clamp((b * p - (1 - p)) / F.when(b > 0, b), 0.0, 1.0)).otherwise(0.0)


def position_size(capital: Column, p: Column, profit: Column, loss: Column, fraction: float = LIMITS.kelly_fraction) -> dict[str, Column]:
    """Kelly, share of capital, size and risk; null where the loss isn't positive."""
    k = F.when(loss > 0, kelly(p, profit / F.when(loss > 0, loss)))
    size = capital * k * fraction
    return {"kelly": k, "share": k * fraction, "size": size, "risk": size * loss / F.when(profit != 0, profit)}


def assessment(margin: Column, risk: Column, win: Column) -> tuple[Column, Column]:
    """(fraction, GOOD / MARGINAL / AVOID)."""
    f = kelly(win * (1 - risk), margin / F.greatest(risk, F.lit(0.01)))
    return f, F.when(f > 0.1, "GOOD").when(f > 0, "MARGINAL").otherwise("AVOID")


def market_status(end: Column, as_of: Column) -> Column:
    """By whole days to the end; blank if that is far or unknown."""
    days = F.floor((F.unix_timestamp(end) - F.unix_timestamp(as_of)) / 86400)
    return F.when(days < -7, "overdue_long").when(days < -1, "overdue_week").when(days < 0, "overdue_day").when(days <= 1, "expiring").when(days <= 3, "soon").otherwise("")


def signal_strength(changes: Column) -> Column:
    return bands(changes, [(5, "strong"), (3, "medium"), (1, "weak")], "none")


def match_quality(similarity: Column) -> Column:
    return bands(similarity, [(0.7, "high"), (0.5, "medium")], "low")


def concentration_label(top5: Column) -> Column:
    return bands(top5, [(0.7, "extreme"), (0.5, "high"), (0.3, "medium")], "spread")


def concentration_score(top5: Column) -> Column:
    return bands(top5, [(0.7, 95), (0.5, 85), (0.3, 70)], 50)


def strategy(trend: Column, positions: Column, changes: Column) -> Column:
    return F.when(trend == "converging", "converging").when(trend == "diverging", "diverging").when(positions > 50, "diversified").when(changes >= 5, "active").otherwise("stable")


def recommendation(top5: Column, changes: Column, pnl: Column) -> Column:
    return F.when((top5 >= 0.6) & (changes >= 3) & (pnl > 0), "follow").when((top5 >= 0.6) & (changes >= 3), "cautious_follow").when(top5 >= 0.5, "observe").otherwise("ignore")


def warnings(top5: Column, pnl: Column, value: Column, positions: Column) -> Column:
    out = reasons((top5 >= 0.9, "concentration 90%"), ((top5 >= 0.8) & (top5 < 0.9), "concentration 80%"), ((value > 0) & (ratio(pnl, value) < -0.2), "loss beyond 20%"), (positions > 100, "over 100 positions"))
    return F.when(out == "", "none").otherwise(out)


def fund_score(value: Column) -> Column:
    return bands(value, [(500_000, 100), (200_000, 90), (100_000, 80), (50_000, 70), (10_000, 60)], 40)


def activity_score(changes: Column) -> Column:
    return bands(changes, [(10, 100), (5, 90), (3, 80), (1, 60)], 30)


def profit_score(pnl: Column, value: Column) -> Column:
    return F.when(value <= 0, 50).otherwise(bands(ratio(pnl, value), [(0.1, 95), (0.05, 85), (0.0, 75), (-0.05, 60), (-0.1, 45)], 30))


def composite(fund: Column, activity: Column, concentration: Column, profit: Column) -> Column:
    """Weights .40, .25, .20, .15 in whole numbers, so that halves are exact."""
    return F.bround((40 * fund + 25 * activity + 20 * concentration + 15 * profit) / 100, 0).cast("long")


def _clear_strategy(top5: Column) -> Column:
    return F.when((top5 >= 0.4) & (top5 <= 0.8), 30.0).when(top5 > 0.8, 20.0).otherwise(top5 * 50)


def _moderate(changes: Column, value: Column) -> Column:
    return F.when((changes >= 1) & (changes <= 5), 25.0).when(changes > 5, 15.0).otherwise(changes * 5.0) + F.when((value >= 50_000) & (value <= 500_000), 20.0).when(value > 500_000, 15.0).otherwise(value / 50_000 * 20)


def copy_score(top5: Column, profit: Column, changes: Column, value: Column) -> Column:
    return F.bround(_clear_strategy(top5) + F.when(profit >= 75, 25.0).otherwise(profit * 0.25) + _moderate(changes, value), 0).cast("long")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def client_composite(value: Column, changes: Column, top5: Column, pnl: Column) -> Column:
    spread = F.when((top5 >= 0.5) & (top5 <= 0.7), 20.0).when(top5 > 0.7, 15.0).otherwise(top5 * 40)
    gain = clamp(ratio(pnl, F.when(value == 0, 1.0).otherwise(value)) * 100, -15.0, 15.0) + 15
    return half_up(rounded(F.least(value / 100_000, F.lit(1.0)) * 40 + F.least(changes / 5, F.lit(1.0)) * 25 + spread + gain, 8))


def client_copy(top5: Column, pnl: Column, changes: Column, value: Column) -> Column:
    return half_up(rounded(_clear_strategy(top5) + F.when(pnl > 0, 25.0).otherwise(0.0) + _moderate(changes, value), 8))


def level(score: Column, low: float = 0.3, medium: float = 0.6) -> Column:
    return F.when(score < low, "low").when(score < medium, "medium").otherwise("high")


def review_pair(profit_pct: Column, liquidity: Column, days: Column, volume: Column, cost: Column) -> tuple[Column, Column]:
    """(score, concerns) of a pair-cost opportunity."""
    rules = [(profit_pct < 1, 3, "tiny profit"), ((profit_pct >= 1) & (profit_pct < 2), 1, "small profit"), (liquidity < 5000, 2, "low liquidity"), ((liquidity >= 5000) & (liquidity < 10_000), 1, "modest liquidity"), (days > 90, 2, "far end"), (days < 1, 3, "near end"), (volume < 10_000, 1, "low volume"), (cost > 0.995, 2, "thin margin")]
    return points(*[(c, p) for c, p, _ in rules]) / 10, reasons(*[(c, t) for c, _, t in rules])


def review_cross(similarity: Column, gap: Column, liquidity: Column) -> tuple[Column, Column]:
    rules = [(similarity < 0.5, 5, "weak match"), ((similarity >= 0.5) & (similarity < 0.7), 2, "modest match"), (gap < 0.05, 2, "small gap"), (gap > 0.20, 2, "odd gap"), (liquidity < 10_000, 2, "low liquidity")]
    return points(*[(c, p) for c, p, _ in rules]) / 10, reasons(*[(c, t) for c, _, t in rules])


def review_whale(volume: Column, changes: Column, new: Column, value: Column, positions: Column, win: Column, is_suspicious: Column) -> Column:
    share, first = ratio(new, changes), (ratio(new, changes) > 0.8) & (ratio(changes, positions) > 0.8)
    total = points((volume < 3000, 2), ((volume >= 3000) & (volume < 8000), 0.5), (value < 10_000, 2), ((value >= 10_000) & (value < 50_000), 0.5), (positions > 50, 1), ((win > 0) & (win < 0.55), 2), (win >= 0.6, -1))
    moves = F.when(changes == 0, 3.0).when(first, 0.5).when(share > 0.5, 1.5).when(changes > 15, 1.0).otherwise(0.0)
    return F.when(is_suspicious, 1.0).otherwise(clamp((total + moves) / 10, 0.0, 1.0))


def contrarian_triggers(yes: Column, consensus: Column, mood: Column) -> Column:
    """How many hold: a price beyond 70 % either way, over 15 % from consensus, a mood beyond 80 of 100."""
    return ((yes > 0.7) | (yes < 0.3)).cast("int") + (rounded(F.abs(yes - consensus), 9) > 0.15).cast("int") + (F.abs(mood) > 80).cast("int")


def sentiment(news: Column, social: Column, influence: Column, chain: Column) -> Column:
    """Weighted mood of four sources, each from -100 to 100."""
    return 0.30 * news + 0.25 * social + 0.20 * influence + 0.25 * chain


def position_cap(strategy: Column) -> Column:
    """The share of capital that a position of a strategy may have."""
    return F.when(strategy == "arbitrage", 0.10).when(strategy == "trend", 0.05).otherwise(0.02)
