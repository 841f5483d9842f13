"""Domain relations over the driver tables, and readers for the raw formats (JSON quotes, logs, report files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.columns import ratio, rounded, summed, table


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, wallet, market, volume, ts of every trade."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.concat(F.lit("w"), "user_id").alias("wallet"), F.col("event_type").alias("market"), F.col("value").alias("volume"), F.col("ts").cast("timestamp").alias("ts"), "props")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided quotes: market_id, yes, no (decimals), liquidity, volume, end date."""
    li = table(spark, sf_dir, "lineitem")
    money = lambda c: c.cast("decimal(18,6)")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("market_id"), (1 - money(F.col("l_discount"))).alias("yes"), money(F.col("l_tax")).alias("no"), F.col("l_extendedprice").alias("liquidity"), (F.col("l_quantity") * 1000).alias("volume"), F.col("l_shipdate").cast("timestamp").alias("end_date"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books, a row per level: market, side (bid or ask), level (0 is best), price, size."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("market"), (F.col("l_extendedprice") / F.col("l_quantity") / 2500).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber", "l_partkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "size"]
    w = Window.partitionBy("market")
    ranked = li.withColumn("rn", F.row_number().over(w.orderBy("price", *keys))).withColumn("half", F.floor(F.count("*").over(w) / 2))
    bid = F.col("rn") <= F.col("half")
    level = F.when(bid, F.col("half") - F.col("rn")).otherwise(F.col("rn") - F.col("half") - 1).cast("long")
    return ranked.select("market", F.when(bid, "bid").otherwise("ask").alias("side"), level.alias("level"), "price", "size")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market (a user's series), seq from 1, price, ts."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("market"), F.row_number().over(w).alias("seq"), (F.col("value") / 500).alias("price"), F.col("ts").cast("timestamp").alias("ts"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position values: wallet by market and week, trades added up in their order; first is the time and id of the first of them."""
    t = trades(spark, sf_dir).withColumn("week", F.date_trunc("week", "ts"))
    return summed(t, ["wallet", "user_id", "market", "week"], "volume", ["ts", "event_id"]).drop("n")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Positions of two adjacent weeks: (wallet, market, size) before and now."""
    t = trades(spark, sf_dir)
    week = lambda a, b: t.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp"))).groupBy("wallet", "market").agg(rounded(F.sum("volume"), 2).alias("size"))
    return week("2024-01-01", "2024-01-08"), week("2024-01-08", "2024-01-15")


def concentration_of(positions: DataFrame, key: str = "wallet", value: str = "value") -> DataFrame:
    """hhi, top5, top10 and positions of each key's values; 0 where the total is 0."""
    w = Window.partitionBy(key)
    ranked = positions.withColumn("rn", F.row_number().over(w.orderBy(F.desc(value), *[c for c in positions.columns if c not in (key, value)])))
    total = F.sum(value)
    share = lambda n: rounded(ratio(F.sum(F.when(F.col("rn") <= n, F.col(value)).otherwise(0.0)), total))
    return ranked.groupBy(key).agg(rounded(ratio(F.sum(F.col(value) * F.col(value)), total * total)).alias("hhi"), share(5).alias("top5"), share(10).alias("top10"), F.count("*").alias("positions"))


#: What a wallet's trades are multiplied by, by user number: spreads values over all bands.
SCALES = (1, 3, 10, 25, 60, 120)


def scale() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SCALES]), (F.col("user_id") % len(SCALES) + 1).cast("int"))


def whales(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """A row per wallet: value, pnl, positions, changes (24 h), top5, win_rate, volume."""
    t = trades(spark, sf_dir)
    v, kind = F.col("volume"), F.col("market")
    pnl = F.when(kind == "purchase", v).when(kind == "error", -v).otherwise(0.0)
    recent = F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    base = t.groupBy("wallet", "user_id").agg(F.sum("volume").alias("sum_volume"), F.sum(pnl).alias("sum_pnl"), F.count("*").alias("positions"), F.count_if(recent).alias("changes"), (F.count_if(kind == "purchase") / F.count("*")).alias("win"))
    top = concentration_of(holdings(spark, sf_dir).select("wallet", "market", "week", "value")).select("wallet", "top5")
    return base.join(top, "wallet").select("wallet", "user_id", rounded(F.col("sum_volume") * scale(), 2).alias("value"), rounded(F.col("sum_pnl") * scale(), 2).alias("pnl"), "positions", "changes", rounded(F.least(F.lit(1.0), F.col("top5") * (1 + (F.col("user_id") % 4) * 0.25))).alias("top5"), rounded(F.col("win") * 3, 4).alias("win_rate"), rounded(F.col("sum_volume"), 2).alias("volume"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan reports, one an hour: scan_time, and counts by stage."""
    e = trades(spark, sf_dir)
    n = lambda kind, name: F.count_if(F.col("market") == kind).alias(name)
    return e.groupBy(F.date_trunc("hour", "ts").alias("scan_time")).agg(n("purchase", "pair_count"), n("signup", "cross_count"), n("error", "mm_count"), n("click", "whale_count"), n("view", "news_count"))


# Readers for raw formats.

MARKET_JSON = "id string, slug string, question string, outcomePrices string, liquidity string, volume string, endDate string"
TRADE_JSON = "proxyWallet string, size double, price double, timestamp long, slug string, pseudonym string, name string"
REPORT_JSON = "scan_time timestamp, pair_cost struct<count:long,approved_count:long>, cross_market struct<count:long,approved_count:long>, whale struct<active:long>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or documents; malformed ones become null rows and are dropped, the file's name is kept."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "false").json(path)
    return rows.withColumn("file", F.col("_metadata.file_path")).where("_corrupt is null").drop("_corrupt")


def parsed_books(raw: DataFrame) -> DataFrame:
    """Raw books (market, bids, asks, and token_id and timestamp if there) to levels (market, side, level, price, size, ...).

    bids and asks are JSON arrays in any order, of objects with price and size as the source sends them, or of pairs [price, size];
    numbers may be text. Level 0 is the best: the highest bid, the lowest ask. Entries without two numbers go.
    """
    kept = [c for c in ("token_id", "timestamp") if c in raw.columns]
    number = lambda s, path: F.get_json_object(s, path).try_cast("double")
    level = lambda s: F.struct(F.coalesce(number(s, "$.price"), number(s, "$[0]")).alias("price"), F.coalesce(number(s, "$.size"), number(s, "$[1]")).alias("size"))
    levels = lambda x: F.filter(F.transform(F.from_json(x, "array<string>"), level), lambda e: e["price"].isNotNull() & e["size"].isNotNull())
    side = lambda name, best_first: raw.select("market", *kept, F.lit(name).alias("side"), F.posexplode(F.sort_array(levels(F.col(f"{name}s")), asc=best_first)).alias("level", "e")).select("market", "side", F.col("level").cast("long").alias("level"), "e.price", "e.size", *kept)
    return side("bid", False).unionByName(side("ask", True))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs with their file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
