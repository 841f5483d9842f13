"""Quotes, venues and order books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.columns import rounded as r
from ..functions.columns import table
from ..operators import arbitrage, orderbook
from ..sources.market_tables import books, quotes
from .registry import query

d = lambda c: F.col(c).cast("double").alias(c)


@query("scan_active", "select market_id, liquidity, volume from quote where end_date >= '2000-01-01' and liquidity >= 500", "quote")
def scan_active(spark, sf):
    return quotes(spark, sf).where((F.col("end_date") >= F.lit("2000-01-01").cast("timestamp")) & (F.col("liquidity") >= 500)).select("market_id", "liquidity", "volume")


@query("pair_cost", """
select market_id, cast(yes as double) as yes, cast(no as double) as no, cast(yes + no as double) as pair_cost, cast(1 - (yes + no) as double) as margin, liquidity
from quote where yes + no < 0.99 and liquidity >= 500""", "quote")
def pair_cost(spark, sf):
    found = arbitrage.pair_costs(quotes(spark, sf)).where("is_opportunity")
    return found.orderBy(F.desc("margin"), "market_id").select("market_id", d("yes"), d("no"), d("pair_cost"), d("margin"), "liquidity")


@query("pair_cost_dirty", """
with raw as (select l_orderkey as id, l_linenumber as ln, l_partkey as pk, l_suppkey as sk, case l_linenumber % 4 when 0 then 'invalid' when 1 then '[]' when 2 then '["0.' || l_quantity::int || '"]'
  else '["' || (1 - cast(l_discount as decimal(18,2)))::varchar || '","' || cast(l_tax as decimal(18,2))::varchar || '"]' end as p from lineitem)
select id, ln, pk, sk, cast(cast(p::json->>0 as decimal(18,6)) + cast(p::json->>1 as decimal(18,6)) as double) as pair_cost from raw where ln % 4 = 3""")
def pair_cost_dirty(spark, sf):
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber") % 4
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    good = F.concat(F.lit('["'), (1 - F.col("l_discount").cast("decimal(18,2)")).cast("string"), F.lit('","'), text("l_tax"), F.lit('"]'))
    prices = F.when(ln == 0, "invalid").when(ln == 1, "[]").when(ln == 2, F.concat(F.lit('["0.'), F.col("l_quantity").cast("int").cast("string"), F.lit('"]'))).otherwise(good)
    raw = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.lit("").alias("slug"), F.lit("").alias("question"), prices.alias("outcomePrices"), F.lit("n/a").alias("liquidity"), F.lit("1").alias("volume"), F.lit("").alias("endDate"))
    q = arbitrage.pair_costs(arbitrage.parsed_quotes(raw))
    part = lambda i, n, t: F.split("market_id", "-")[i].cast(t).alias(n)
    return q.select(part(0, "id", "long"), part(1, "ln", "int"), part(2, "pk", "long"), part(3, "sk", "long"), d("pair_cost"))


@query("pair_cost_stats", "select count(*) as n, cast(avg(yes + no) as double) as mean_cost, cast(min(yes + no) as double) as min_cost, count(*) filter (yes + no < 0.99 and liquidity >= 500) as opportunities from quote".replace("cast(avg(yes + no) as double)", "round_even(avg(cast(yes + no as double)), 6)"), "quote")
def pair_cost_stats(spark, sf):
    return arbitrage.pair_costs(quotes(spark, sf)).agg(F.count("*").alias("n"), r(F.avg(F.col("pair_cost").cast("double"))).alias("mean_cost"), F.min("pair_cost").cast("double").alias("min_cost"), F.count_if("is_opportunity").alias("opportunities"))


@query("normalize_venues", """
with p as (select p_partkey as k, p_name, p_size, p_retailprice from part)
select 'a' as platform, k as id, p_name as question, p_size / 100.0::double as yes_price, 1 - p_size / 100.0::double as no_price, p_retailprice as liquidity from p where k % 4 = 0
union all select 'b', k, p_name, p_size / 50.0::double, 1 - p_size / 50.0::double, p_retailprice from p where k % 4 = 1 and p_size % 5 <> 0
union all select 'c', k, p_name, case when p_size % 3 = 0 then 0.5 else p_size / 60.0::double end, 1 - case when p_size % 3 = 0 then 0.5 else p_size / 60.0::double end, 0 from p where k % 4 = 2
union all select 'd', k, p_name, p_size / 100.0::double, case when p_size % 7 = 0 then 0 else (100 - p_size) / 100.0::double end, p_retailprice from p where k % 4 = 3""".replace("with p as (", "with p as ("))
def normalize_venues(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), "p_size", "p_retailprice")
    size, part = F.col("p_size"), lambda i: p.where(F.col("id") % 4 == i)
    a = part(0).withColumn("prices", F.concat(F.lit('["'), (size / 100.0).cast("string"), F.lit('","'), (1 - size / 100.0).cast("string"), F.lit('"]'))).withColumn("liquidity", F.col("p_retailprice"))
    b = part(1).withColumn("probability", F.when(size % 5 != 0, size / 50.0)).withColumn("liquidity", F.when(size % 2 == 0, F.col("p_retailprice")).otherwise(0.0)).withColumn("total_liquidity", F.col("p_retailprice"))
    c = part(2).withColumn("community", F.struct(F.when(size % 3 != 0, size / 60.0).alias("q1")))
    e = part(3).withColumn("yes_ask", size.cast("double")).withColumn("no_ask", F.when(size % 7 != 0, (100 - size).cast("double"))).withColumn("volume", F.col("p_retailprice"))
    return arbitrage.venue_rows(a, b, c, e)


@query("venue_gap", """
with v as (select p_brand as event, case p_partkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as platform, round_even(avg(p_size) / 100, 6) as price from part group by all),
g as (select event, max(price) - min(price) as gap, arg_min(platform, (price, platform)) as low_platform, arg_min(platform, (-price, platform)) as high_platform from v group by event)
select event, round_even(gap, 6) as gap, low_platform, high_platform from g where round_even(gap, 6) >= 0.01""")
def venue_gap(spark, sf):
    k = F.col("p_partkey") % 3
    v = table(spark, sf, "part").groupBy(F.col("p_brand").alias("event"), F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("platform")).agg(r(F.avg("p_size") / 100).alias("price"))
    prices = v.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("platform", "price"))).alias("prices"))  # three venues an event
    return arbitrage.gaps(prices, 0.01).select("event", "gap", "low_platform", "high_platform")


@query("clob_markets", "select s_suppkey as market, s_name as question, s_acctbal as liquidity from supplier where s_suppkey % 3 <> 0")
def clob_markets(spark, sf):
    k = F.col("s_suppkey")
    ids = F.when(k % 3 != 0, F.concat(F.lit('["'), k, F.lit('","'), k + 1, F.lit('"]'))).otherwise(F.concat(F.lit('["'), k, F.lit('"]')))
    m = table(spark, sf, "supplier").withColumn("tokens", F.from_json(ids, "array<string>")).where(F.size("tokens") >= 2)
    return m.orderBy(F.desc("s_acctbal"), "s_suppkey").select(k.alias("market"), F.col("s_name").alias("question"), F.col("s_acctbal").alias("liquidity"))


BOOK = "select market, round_even(best_bid, 6) as best_bid, round_even(best_ask, 6) as best_ask, round_even(spread_pct, 6) as spread_pct, "


@query("book_spread", BOOK + "min_depth from top", "top")
def book_spread(spark, sf):
    return orderbook.tops(books(spark, sf)).select("market", r(F.col("best_bid")).alias("best_bid"), r(F.col("best_ask")).alias("best_ask"), r(F.col("spread_pct")).alias("spread_pct"), "min_depth")


@query("book_spread_notional", BOOK + "round_even(min_money, 4) as min_money, round_even(spread_pct, 6) >= 0.0015 and min_money >= 20 as is_wide from top", "top")
def book_spread_notional(spark, sf):
    return orderbook.tops(books(spark, sf)).select("market", r(F.col("best_bid")).alias("best_bid"), r(F.col("best_ask")).alias("best_ask"), r(F.col("spread_pct")).alias("spread_pct"), r(F.col("min_money"), 4).alias("min_money"), ((r(F.col("spread_pct")) >= 0.0015) & (F.col("min_money") >= 20)).alias("is_wide"))


SIGNAL = """with s as (select *, best_bid + 0.3 * spread as bid_quote, best_ask - 0.3 * spread as ask_quote from top where spread_pct >= 0.0005)
"""


@query("mm_signal", SIGNAL + "select market, round_even(bid_quote, 6) as bid_quote, round_even(ask_quote, 6) as ask_quote, round_even((ask_quote - bid_quote) / mid, 6) as profit from s", "top")
def mm_signal(spark, sf):
    s = orderbook.signals(orderbook.tops(books(spark, sf)), 0.0005)
    return s.select("market", *[r(F.col(c)).alias(c) for c in ("bid_quote", "ask_quote", "profit")])


@query("mm_confidence", SIGNAL + "select market, round_even(least(spread_pct / 0.05, 1) * 0.5 + least(min_depth / 10000, 1) * 0.3 + (1 - abs(bid_depth - ask_depth) / (bid_depth + ask_depth)) * 0.2, 6) as confidence from s", "top")
def mm_confidence(spark, sf):
    return orderbook.signals(orderbook.tops(books(spark, sf)), 0.0005).select("market", r(F.col("confidence")).alias("confidence"))


@query("mm_quotes", SIGNAL + """, k as (select *, greatest(-1.0, least(1.0, (market % 41 - 20) / 16.0)) as skew from s)
select market, round_even(bid_quote - skew * 0.002, 4) as bid_price, round_even(ask_quote - skew * 0.002, 4) as ask_price,
  case when skew > 0.5 then 50.0::double when skew < -0.5 then 150.0::double else 100.0::double end as bid_size, case when skew > 0.5 then 150.0::double when skew < -0.5 then 50.0::double else 100.0::double end as ask_size from k""", "top")
def mm_quotes(spark, sf):
    s = orderbook.signals(orderbook.tops(books(spark, sf)), 0.0005)
    q = orderbook.skewed_quotes(s, (F.col("market") % 41 - 20) * 62.5)
    return q.select("market", "bid_price", "ask_price", "bid_size", "ask_size")


@query("mm_scan", """select market, case when spread_pct < 0.0015 then 'spread' when min_depth < 60 then 'depth' when best_bid < 0.05 or best_bid > 0.95 then 'price' else 'ok' end as reason,
round_even(0.4 * spread_pct, 6) as expected_profit from top""", "top")
def mm_scan(spark, sf):
    s = orderbook.scanned(orderbook.tops(books(spark, sf)), spread=0.0015, depth=60)
    return s.orderBy(F.desc("spread_pct"), "market").select("market", "reason", r(F.col("expected_profit")).alias("expected_profit"))


@query("mm_sweep", "select t.t as threshold, count(*) filter (spread_pct >= t.t and min_depth >= 60) as n from top, (values (0.0005), (0.001), (0.0015), (0.002), (0.003)) t(t) group by 1".replace("t.t as threshold", "cast(t.t as double) as threshold"), "top")
def mm_sweep(spark, sf):
    steps = (0.0005, 0.001, 0.0015, 0.002, 0.003)
    t = orderbook.tops(books(spark, sf)).agg(*[F.count_if((F.col("spread_pct") >= x) & (F.col("min_depth") >= 60)).alias(str(i)) for i, x in enumerate(steps)])
    return t.select(F.inline(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(str(i)).alias("n")) for i, x in enumerate(steps)])))


FILL = """with f as (select market, side, level, price, greatest(0, least(size, 2000.0 - (sum(size) over (partition by market, side order by level) - size))) as take from book),
v as (select market, side, sum(price * take) / sum(take) as vwap, sum(take) as filled, max(price) filter (level = 0) as best from f group by all)
"""


@query("vwap", FILL + "select market, side, round_even(vwap, 6) as vwap, filled from v", "book")
def vwap(spark, sf):
    return orderbook.fills(books(spark, sf), 2000).select("market", "side", r(F.col("vwap")).alias("vwap"), "filled")


@query("slippage", FILL + """, x as (select a.market, (a.vwap - a.best) / a.best * 100 as buy_pct, (b.best - b.vwap) / b.best * 100 as sell_pct from v a join v b on a.market = b.market and a.side = 'ask' and b.side = 'bid')
select market, round_even(buy_pct, 6) as buy_pct, round_even(sell_pct, 6) as sell_pct, round_even(buy_pct + sell_pct, 6) as round_trip_pct from x""", "book")
def slippage(spark, sf):
    s = orderbook.slippage(books(spark, sf), 2000)
    return s.select("market", *[r(F.col(c)).alias(c) for c in ("buy_pct", "sell_pct", "round_trip_pct")])


@query("market_impact", FILL.replace("2000.0", "20000.0") + """select market, round_even(vwap, 4) as avg_price, round_even(abs((vwap - best) / best) * 100, 2) as slippage_pct, round_even(20000.0 - filled, 2) as remaining,
round_even(filled / 20000.0 * 100, 1) as fill_rate from v where side = 'ask'""", "book")
def market_impact(spark, sf):
    return orderbook.impact(books(spark, sf), 20000)


@query("alert_sizing", """select market_id, least(0.1 * liquidity, 5000) as size, round_even(least(0.1 * liquidity, 5000) * cast(1 - (yes + no) as double), 6) as profit from quote where yes + no < 0.99 and liquidity >= 500""", "quote")
def alert_sizing(spark, sf):
    q = arbitrage.pair_costs(quotes(spark, sf)).where("is_opportunity").withColumn("size", F.least(0.1 * F.col("liquidity"), F.lit(5000.0)))
    return q.select("market_id", "size", r(F.col("size") * F.col("margin").cast("double")).alias("profit"))


@query("backtest_sweep", """with s as (select t, cast(floor(sum(pair_count) * (1 + (0.995 - t) * 100) + 1e-9) as bigint) as found, count(*) as n from report, (values (0.985::double), (0.99::double), (0.995::double), (0.998::double)) x(t) group by t)
select t as threshold, found, round_even(found / greatest(n / 24, 1), 6) as per_day, t = (select arg_max(t, (found, -t)) from s) as is_best from s""", "report")
def backtest_sweep(spark, sf):
    from ..sources.market_tables import reports

    steps = (0.985, 0.99, 0.995, 0.998)
    one = reports(spark, sf).agg(F.sum("pair_count").alias("pairs"), F.count("*").alias("n"))
    x = one.select("n", "pairs", F.explode(F.array(*[F.lit(t) for t in steps])).alias("threshold"))
    x = x.withColumn("found", F.floor(F.col("pairs") * (1 + (0.995 - F.col("threshold")) * 100) + 1e-9))
    best = x.agg(F.max_by("threshold", F.struct("found", -F.col("threshold"))).alias("best"))
    return x.crossJoin(F.broadcast(best)).select("threshold", "found", r(F.col("found") / F.greatest(F.col("n") / 24, F.lit(1.0))).alias("per_day"), (F.col("threshold") == F.col("best")).alias("is_best"))  # four rows against one


@query("market_status", f"""with q as (select market_id, floor(epoch(end_date + interval 8645 day - timestamp '{AS_OF}') / 86400) % 24 - 10 as days from quote)
select market_id, case when days < -7 then 'overdue_long' when days < -1 then 'overdue_week' when days < 0 then 'overdue_day' when days <= 1 then 'expiring' when days <= 3 then 'soon' else '' end as status from q""".replace("floor(epoch(end_date + interval 8645 day - timestamp '2024-01-31 00:00:00') / 86400) % 24 - 10", "cast(epoch(end_date) / 86400 as bigint) % 24 - 10"), "quote")
def market_status(spark, sf):
    from ..operators.scoring import market_status as status

    as_of = F.lit(AS_OF).cast("timestamp")
    day = F.floor(F.unix_timestamp("end_date") / 86400) % 24 - 10
    end = F.timestamp_seconds(F.unix_timestamp(as_of) + day * 86400)
    return quotes(spark, sf).select("market_id", status(end, as_of).alias("status"))


