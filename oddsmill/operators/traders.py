"""Traders: roll-ups, position changes, rankings, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.columns import rounded


def roll_up(trades: DataFrame, large: float = LIMITS.large_trade) -> DataFrame:
    """Volume, counts, markets and the newest trade of each wallet; case-insensitive, blank wallets go.

    Trades: wallet, volume, market, ts, event_id. The alias is that of the newest trade, the first row if they tie.
    """
    t = trades.withColumn("wallet", F.lower("wallet")).where("wallet <> ''")
    newest = F.max_by("market", F.struct("ts", -F.col("event_id")))
    return t.groupBy("wallet").agg(F.sum("volume").alias("total_volume"), F.count("*").alias("trade_count"), F.count_if(F.col("volume") >= large).alias("large_trades"), F.count_distinct("market").alias("markets"), F.max("ts").alias("last_trade"), newest.alias("last_market"))


def active(wallets: DataFrame, volume: float = LIMITS.wallet_volume, large: int = LIMITS.large_trades, top: int = LIMITS.wallets_kept) -> DataFrame:
    """The wallets with enough volume or large trades, the largest first (a top-k report)."""
    kept = wallets.where((F.col("total_volume") >= volume) | (F.col("large_trades") >= large))
    return kept.orderBy(F.desc("total_volume"), "wallet").limit(top)


def position_changes(before: DataFrame, now: DataFrame, keys: list[str], tolerance: float = LIMITS.size_tolerance) -> DataFrame:
    """new, increased, decreased and closed positions of two snapshots (keys, size): one full outer join."""
    j = before.select(*keys, F.col("size").alias("old_size")).join(now.select(*keys, F.col("size").alias("new_size")), keys, "full_outer")
    change = F.coalesce("new_size", F.lit(0.0)) - F.coalesce("old_size", F.lit(0.0))
    kind = F.when(F.col("old_size").isNull(), "new").when(F.col("new_size").isNull(), "closed").when(rounded(change) > tolerance, "increased").when(rounded(change) < -tolerance, "decreased")
    return j.withColumn("type", kind).where("type is not null").withColumn("change", rounded(change, 2))


def coarse(kind: Column) -> Column:
    """The older labels of changes."""
    return F.when(kind == "new", "new_position").when(kind == "closed", "closed").otherwise("size_change")


def suspicious(positions: Column, value: Column) -> Column:
    return (positions > LIMITS.suspicious_positions) & (value < LIMITS.suspicious_value)


def watchable(value: Column, changes: Column, positions: Column) -> Column:
    """Who goes on the watch list."""
    rejected = (positions == 0) | (value < 1000)
    return ~rejected & ((value >= LIMITS.watch_value) | ((changes >= LIMITS.watch_changes) & (value >= LIMITS.watch_value_with_changes)))


def top_per(rows: DataFrame, key: str, by: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= n)


def activity(changes: DataFrame, trades: DataFrame, looked_at: int = LIMITS.trades_looked_at) -> DataFrame:
    """(wallet, changes, recent_trades, has_activity) of wallets that appear in either: active by a change or a trade, the older rule.

    Of a wallet's trades up to looked_at count, as many as are asked for.
    """
    n = lambda rows, name: rows.groupBy("wallet").agg(F.count("*").alias(name))
    both = n(changes, "changes").join(n(trades, "recent_trades"), "wallet", "full_outer")
    count = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    out = both.select("wallet", count("changes").alias("changes"), F.least(count("recent_trades"), F.lit(looked_at).cast("long")).alias("recent_trades"))
    return out.withColumn("has_activity", (F.col("changes") > 0) | (F.col("recent_trades") > 0))


def records_of(wallets: DataFrame, positions: DataFrame, trades: DataFrame, pnl: DataFrame, latest: int = LIMITS.trades_looked_at) -> DataFrame:
    """What a look-up of each of some wallets gives: its positions, its latest trades, newest first, and its profit, empty or null if there is none.

    positions (wallet, market, value), trades (wallet, id, ts), pnl (wallet, pnl). Only the asked wallets' rows are gathered; of trades the
    latest few are kept before they are.
    """
    asked = wallets.select("wallet").distinct()
    held = positions.join(asked, "wallet", "left_semi").groupBy("wallet").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("o"), "market", "value"))).alias("p"))
    last = top_per(trades.join(asked, "wallet", "left_semi"), "wallet", [F.desc("ts"), F.desc("id")], latest).groupBy("wallet").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("t"))
    out = asked.join(held, "wallet", "left").join(last, "wallet", "left").join(pnl.select("wallet", "pnl"), "wallet", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    listed = F.transform("p", lambda x: F.struct(x["market"].alias("market"), x["value"].alias("value")))
    return out.select("wallet", F.coalesce(listed, none("struct<market:string,value:double>")).alias("positions"), F.coalesce(F.transform("t", lambda x: x["id"]), none("bigint")).alias("trades"), "pnl")
