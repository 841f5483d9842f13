"""Complementary-price and cross-venue opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.columns import rounded


def pair_costs(quotes: DataFrame, threshold: float = LIMITS.pair_cost, liquidity: float = LIMITS.pair_liquidity) -> DataFrame:
    """Pair cost, margin and the opportunity flag of each quote; prices are decimals, so the strict bound is exact."""
    cost = (F.col("yes") + F.col("no")).alias("c")
    q = quotes.withColumn("pair_cost", cost)
    flag = (F.col("pair_cost") < F.lit(threshold).cast("decimal(18,6)")) & (F.col("liquidity") >= liquidity)
    return q.withColumn("margin", 1 - F.col("pair_cost")).withColumn("is_opportunity", F.coalesce(flag, F.lit(False)))


def parsed_quotes(raw: DataFrame) -> DataFrame:
    """Raw market rows (outcomePrices as JSON text, numbers as text) to quotes; rows without two numeric prices go."""
    prices = F.coalesce(F.from_json("outcomePrices", "array<string>"), F.array().cast("array<string>"))
    price = lambda i: F.try_element_at(prices, F.lit(i)).try_cast("decimal(18,6)")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    rows = raw.select(F.col("id").alias("market_id"), "slug", "question", price(1).alias("yes"), price(2).alias("no"), number("liquidity"), number("volume"), F.col("endDate").alias("end_date"))
    return rows.dropna(subset=["yes", "no"])


def venue_rows(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """Four venues' rows in one schema: platform, id, question, yes_price, no_price, liquidity.

    a: JSON price vectors; b: a probability and two liquidity fields; c: a nested estimate, 0.5 if missing; d: cents.
    """
    shape = ["platform", "id", "question", "yes_price", "no_price", "liquidity"]
    pa = F.from_json("prices", "array<string>")
    one = a.select(F.lit("a").alias("platform"), "id", "question", F.try_element_at(pa, F.lit(1)).try_cast("double").alias("yes_price"), F.try_element_at(pa, F.lit(2)).try_cast("double").alias("no_price"), "liquidity").dropna(subset=["yes_price", "no_price"])
    two = b.where("probability is not null").select(F.lit("b").alias("platform"), "id", "question", F.col("probability").alias("yes_price"), (1 - F.col("probability")).alias("no_price"), F.coalesce(F.nullif(F.col("liquidity"), F.lit(0.0)), F.col("total_liquidity"), F.lit(0.0)).alias("liquidity"))
    q1 = F.coalesce(F.col("community.q1"), F.lit(0.5))
    three = c.select(F.lit("c").alias("platform"), "id", "question", q1.alias("yes_price"), (1 - q1).alias("no_price"), F.lit(0.0).alias("liquidity"))
    cents = lambda x: F.coalesce(F.col(x) / 100, F.lit(0.0))
    four = d.select(F.lit("d").alias("platform"), "id", "question", cents("yes_ask").alias("yes_price"), cents("no_ask").alias("no_price"), F.coalesce("volume", F.lit(0.0)).alias("liquidity"))
    return one.select(shape).unionByName(two.select(shape)).unionByName(three.select(shape)).unionByName(four.select(shape))


def gaps(prices: DataFrame, least: float = LIMITS.venue_gap) -> DataFrame:
    """Events (key, prices map<platform, price>) with a gap of at least `least`: where it is low and high, first wins ties."""
    entries = F.map_entries("prices")
    low = F.array_min(F.transform(entries, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    high = F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    out = prices.withColumn("lo", low).withColumn("hi", high)
    gap = rounded(-F.col("hi.p") - F.col("lo.p"))
    return out.withColumn("gap", gap).where(F.col("gap") >= least).withColumn("low_platform", F.col("lo.k")).withColumn("high_platform", F.col("hi.k")).drop("lo", "hi")
