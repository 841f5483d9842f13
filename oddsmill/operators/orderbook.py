"""Order books: spreads, fills, slippage, quoting. Books are rows of (market, side, level, price, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.columns import clamp, ratio, rounded


def tops(books: DataFrame, levels: int = 5) -> DataFrame:
    """best_bid, best_ask, spread, mid, spread_pct and depth of the first levels, in shares and in money; one pass."""
    side = lambda s: F.col("side") == s
    best = lambda s: F.max(F.when(side(s) & (F.col("level") == 0), F.col("price")))
    depth = lambda s, x: F.coalesce(F.sum(F.when(side(s) & (F.col("level") < levels), x)), F.lit(0.0))
    size, money = F.col("size"), F.col("size") * F.col("price")
    t = books.groupBy("market").agg(best("bid").alias("best_bid"), best("ask").alias("best_ask"), depth("bid", size).alias("bid_depth"), depth("ask", size).alias("ask_depth"), depth("bid", money).alias("bid_money"), depth("ask", money).alias("ask_money"))
    t = t.where("best_bid is not null and best_ask is not null").withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("mid", (F.col("best_ask") + F.col("best_bid")) / 2)
    return t.withColumn("spread_pct", ratio(F.col("spread"), F.col("mid"))).withColumn("min_depth", F.least("bid_depth", "ask_depth")).withColumn("min_money", F.least("bid_money", "ask_money"))


def signals(top: DataFrame, least: float = LIMITS.mm_spread) -> DataFrame:
    """Quotes inside the spread where it is wide enough, with expected profit and confidence."""
    s = top.where(F.col("spread_pct") >= least)
    q = s.withColumn("bid_quote", F.col("best_bid") + 0.3 * F.col("spread")).withColumn("ask_quote", F.col("best_ask") - 0.3 * F.col("spread"))
    q = q.withColumn("profit", ratio(F.col("ask_quote") - F.col("bid_quote"), F.col("mid")))
    return q.withColumn("confidence", confidence(F.col("spread_pct"), F.col("bid_depth"), F.col("ask_depth")))


def confidence(spread_pct: Column, bid_depth: Column, ask_depth: Column) -> Column:
    total = bid_depth + ask_depth
    balance = F.when(total > 0, 1 - F.abs(bid_depth - ask_depth) / F.when(total > 0, total)).otherwise(0.0)
    return F.least(spread_pct / 0.05, F.lit(1.0)) * 0.5 + F.least(F.least(bid_depth, ask_depth) / 10000, F.lit(1.0)) * 0.3 + balance * 0.2


def skewed_quotes(signal: DataFrame, inventory: Column, most: float = 1000.0, size: float = 100.0) -> DataFrame:
    """Quotes shifted against inventory: 0.002 at full skew; sizes halve and grow by half beyond half the skew."""
    skew = clamp(inventory / most, -1.0, 1.0)
    s = signal.withColumn("skew", skew)
    shift = F.col("skew") * 0.002
    factor = lambda sign: F.when(sign * F.col("skew") > 0.5, 0.5).when(sign * F.col("skew") < -0.5, 1.5).otherwise(1.0)
    return s.withColumn("bid_price", rounded(F.col("bid_quote") - shift, 4)).withColumn("ask_price", rounded(F.col("ask_quote") - shift, 4)).withColumn("bid_size", rounded(factor(1) * size, 2)).withColumn("ask_size", rounded(factor(-1) * size, 2))


def fills(books: DataFrame, quantity: float) -> DataFrame:
    """VWAP, filled and best of both sides for an order of some quantity: running sums instead of a walk."""
    w = Window.partitionBy("market", "side").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    take = F.greatest(F.lit(0.0), F.least(F.col("size"), F.lit(quantity) - (F.sum("size").over(w) - F.col("size"))))
    t = books.withColumn("take", take).groupBy("market", "side").agg(F.sum(F.col("price") * F.col("take")).alias("paid"), F.sum("take").alias("filled"), F.max(F.when(F.col("level") == 0, F.col("price"))).alias("best"))
    return t.withColumn("vwap", ratio(F.col("paid"), F.col("filled")))


def slippage(books: DataFrame, quantity: float) -> DataFrame:
    """Buy, sell and round-trip cost in percent against the best prices; 0 for an empty side."""
    f = fills(books, quantity)
    at = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0.0))
    g = f.groupBy("market").agg(at("ask", "vwap").alias("buy_vwap"), at("bid", "vwap").alias("sell_vwap"), at("ask", "best").alias("best_ask"), at("bid", "best").alias("best_bid"), at("ask", "filled").alias("buy_filled"), at("bid", "filled").alias("sell_filled"))
    buy, sell = ratio(F.col("buy_vwap") - F.col("best_ask"), F.col("best_ask")) * 100, ratio(F.col("best_bid") - F.col("sell_vwap"), F.col("best_bid")) * 100
    return g.withColumn("buy_pct", buy).withColumn("sell_pct", sell).withColumn("round_trip_pct", buy + sell)


def impact(books: DataFrame, quantity: float, side: str = "ask") -> DataFrame:
    """Average price, slippage, what remains and the fill rate of an order against one side."""
    f = fills(books.where(F.col("side") == side), quantity)
    slip = F.abs(ratio(F.col("vwap") - F.col("best"), F.col("best"))) * 100
    return f.select("market", rounded(F.col("vwap"), 4).alias("avg_price"), rounded(slip, 2).alias("slippage_pct"), rounded(F.lit(quantity) - F.col("filled"), 2).alias("remaining"), rounded(F.col("filled") / quantity * 100, 1).alias("fill_rate"))


def scanned(top: DataFrame, spread: float = LIMITS.mm_scan_spread, depth: float = LIMITS.mm_scan_depth, low: float = LIMITS.mm_low, high: float = LIMITS.mm_high) -> DataFrame:
    """The first reason against each book, or `ok`, and expected profit."""
    reason = F.when(F.col("spread_pct") < spread, "spread").when(F.col("min_depth") < depth, "depth").when((F.col("best_bid") < low) | (F.col("best_bid") > high), "price").otherwise("ok")
    return top.withColumn("reason", reason).withColumn("expected_profit", 0.4 * F.col("spread_pct"))
