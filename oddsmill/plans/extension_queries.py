"""Rules that the domain documents but few tools compute: sentiment, consensus, caps, fees; and small reports and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.columns import bands, clamp
from ..functions.columns import rounded as r
from ..operators import arbitrage, orderbook, scoring
from ..sources.market_tables import books, holdings, quotes, trades, whales
from .registry import query

c = F.col
#: Capital that caps and stops refer to.
CAPITAL = 100_000.0


def _d(name: str):
    return c(name).cast("double")


@query("recent_trades", "select event_id, wallet, market, volume from trade order by ts desc, event_id desc limit 100", "trade")
def recent_trades(spark, sf, limit: int = 100):
    """The newest trades."""
    return trades(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", "wallet", "market", "volume")


@query("first_reviewed", "select market_id, cast(1 - (yes + no) as double) as margin from quote where yes + no < 0.99 and liquidity >= 500 order by 1 - (yes + no) desc, market_id limit 5", "quote")
def first_reviewed(spark, sf, k: int = 5):
    """The k most profitable pairs: what a scan passes on to its review."""
    q = arbitrage.pair_costs(quotes(spark, sf)).where("is_opportunity")
    return q.orderBy(F.desc("margin"), "market_id").limit(k).select("market_id", _d("margin").alias("margin"))


@query("backtest_repriced", """select t as threshold, count(*) filter (yes + no < t and liquidity >= 500) as found, round_even(coalesce(avg(cast(1 - (yes + no) as double)) filter (yes + no < t and liquidity >= 500), 0), 6) as margin
from quote, (values (0.985::decimal(18,6)), (0.99::decimal(18,6)), (0.995::decimal(18,6)), (0.998::decimal(18,6))) x(t) group by t""", "quote")
def backtest_repriced(spark, sf):
    """Opportunities at each threshold by pricing all quotes anew, where backtest_sweep extrapolates a count."""
    steps = F.array(*[F.lit(t).cast("decimal(18,6)") for t in ("0.985", "0.99", "0.995", "0.998")])
    q = quotes(spark, sf).select("yes", "no", "liquidity", F.explode(steps).alias("threshold"))
    hit = (c("yes") + c("no") < c("threshold")) & (c("liquidity") >= 500)
    margin = F.avg(F.when(hit, (1 - (c("yes") + c("no"))).cast("double")))
    return q.groupBy("threshold").agg(F.count_if(hit).alias("found"), r(F.coalesce(margin, F.lit(0.0))).alias("margin"))


@query("fee_adjusted_gap", "select * from (select market_id, round_even(cast(abs(yes - (1 - no)) as double), 6) as gap, round_even(cast(abs(yes - (1 - no)) as double) - 0.02::double - 0.01::double, 6) as net from quote) where net > 0", "quote")
def fee_adjusted_gap(spark, sf, fees: tuple[float, float] = (0.02, 0.01)):
    """Gaps of two venues' prices that are left after both venues' fees."""
    gap = F.abs(c("yes") - (1 - c("no"))).cast("double")
    return quotes(spark, sf).select("market_id", r(gap).alias("gap"), r(gap - fees[0] - fees[1]).alias("net")).where("net > 0")


@query("contrarian_signal", """with q as (select market_id, cast(yes as double) as yes, cast(1 - no as double) as consensus, volume / 250 - 100 as mood from quote),
s as (select *, (yes > 0.7 or yes < 0.3)::int + (round_even(abs(yes - consensus), 9) > 0.15)::int + (abs(mood) > 80)::int as triggers from q)
select market_id, triggers, case when yes > 0.5 then 'NO' else 'YES' end as side from s where triggers >= 2""", "quote")
def contrarian_signal(spark, sf):
    """Bets against the crowd: at least two of skewed price, divergence from consensus and extreme mood."""
    q = quotes(spark, sf).select("market_id", _d("yes").alias("yes"), (1 - c("no")).cast("double").alias("consensus"), (c("volume") / 250 - 100).alias("mood"))
    triggers = scoring.contrarian_triggers(c("yes"), c("consensus"), c("mood"))
    return q.withColumn("triggers", triggers).where("triggers >= 2").select("market_id", "triggers", F.when(c("yes") > 0.5, "NO").otherwise("YES").alias("side"))


@query("sentiment_composite", """with p as (select user_id as market, coalesce(avg(value) filter (event_type = 'click'), 250) as a, coalesce(avg(value) filter (event_type = 'view'), 250) as b,
coalesce(avg(value) filter (event_type = 'signup'), 250) as c, coalesce(avg(value) filter (event_type = 'purchase'), 250) as d from events group by user_id),
n as (select market, least(100, greatest(-100, a * 0.4 - 100)) as news, least(100, greatest(-100, b * 0.4 - 100)) as social, least(100, greatest(-100, c * 0.4 - 100)) as influence, least(100, greatest(-100, d * 0.4 - 100)) as chain from p)
select market, round_even(0.30 * news + 0.25 * social + 0.20 * influence + 0.25 * chain, 6) as sentiment from n""")
def sentiment_composite(spark, sf):
    """News, social volume, influencers and chain flows in one number from -100 to 100."""
    part = lambda kind: clamp(F.coalesce(F.avg(F.when(c("market") == kind, c("volume"))), F.lit(250.0)) * 0.4 - 100, -100.0, 100.0)
    p = trades(spark, sf).groupBy("user_id").agg(part("click").alias("news"), part("view").alias("social"), part("signup").alias("influence"), part("purchase").alias("chain"))
    return p.select(c("user_id").alias("market"), r(scoring.sentiment(c("news"), c("social"), c("influence"), c("chain"))).alias("sentiment"))


@query("whale_consensus", """with h as (select wallet, market, week, value, lag(value) over (partition by wallet, market order by week) as before_ from holding),
g as (select market, week, count(*) filter (value > before_) as up, count(*) filter (value < before_) as down from h where before_ is not null group by all)
select market, epoch_us(week) as at, up, down, case when up >= 3 and up >= 0.6 * (up + down) then 'up' when down >= 3 and down >= 0.6 * (up + down) then 'down' else 'none' end as consensus from g""", "holding")
def whale_consensus(spark, sf, least: int = 3, share: float = 0.6):
    """Whether several traders move the same way in a market from one week to the next."""
    h = holdings(spark, sf).withColumn("before", F.lag("value").over(Window.partitionBy("wallet", "market").orderBy("week"))).where("before is not null")
    g = h.groupBy("market", "week").agg(F.count_if(c("value") > c("before")).alias("up"), F.count_if(c("value") < c("before")).alias("down"))
    one_way = lambda n: (c(n) >= least) & (c(n) >= share * (c("up") + c("down")))
    return g.select("market", F.unix_micros(c("week").cast("timestamp")).alias("at"), "up", "down", F.when(one_way("up"), "up").when(one_way("down"), "down").otherwise("none").alias("consensus"))


@query("adaptive_follow", """select wallet, market, epoch_us(week) as at, round_even(value / sum(value) over (partition by wallet, week), 6) as share,
case when round_even(value / sum(value) over (partition by wallet, week), 6) > 0.2 then 'follow' when round_even(value / sum(value) over (partition by wallet, week), 6) < 0.05 then 'watch' else 'half' end as action from holding""", "holding")
def adaptive_follow(spark, sf):
    """How far to follow a trader into a market, by its share of the trader's book."""
    share = r(c("value") / F.sum("value").over(Window.partitionBy("wallet", "week")))
    h = holdings(spark, sf).withColumn("share", share)
    return h.select("wallet", "market", F.unix_micros(c("week").cast("timestamp")).alias("at"), "share", F.when(c("share") > 0.2, "follow").when(c("share") < 0.05, "watch").otherwise("half").alias("action"))


@query("leaderboard_recent", f"select wallet, round_even(sum(volume), 4) as volume, epoch_us(max(ts)) as last_trade from trade group by wallet having max(ts) > timestamp '{AS_OF}' - interval 7 day", "trade")
def leaderboard_recent(spark, sf, days: int = 7):
    """Traders whose last trade is less than so many days old."""
    t = trades(spark, sf).groupBy("wallet").agg(r(F.sum("volume"), 4).alias("volume"), F.max("ts").alias("last"))
    return t.where(c("last") > F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(days))).select("wallet", "volume", F.unix_micros("last").alias("last_trade"))


@query("position_caps", """with q as (select market_id, cast(yes as double) as yes, liquidity, case when yes + no < 0.99 then 'arbitrage' when yes > 0.95 then 'contrarian' else 'trend' end as strategy from quote),
s as (select *, least(liquidity, 100000 * case strategy when 'arbitrage' then 0.10::double when 'trend' then 0.05::double else 0.02::double end) as size from q)
select market_id, strategy, size, round_even(greatest(0, yes - 2000 * yes / size), 6) as stop from s""", "quote")
def position_caps(spark, sf):
    """The largest position by kind of strategy, and the price at which its loss is two hundredths of the capital."""
    q = quotes(spark, sf)
    strategy = F.when(c("yes") + c("no") < F.lit("0.99").cast("decimal(18,6)"), "arbitrage").when(c("yes") > F.lit("0.95").cast("decimal(18,6)"), "contrarian").otherwise("trend")
    s = q.select("market_id", _d("yes").alias("yes"), "liquidity", strategy.alias("strategy")).withColumn("size", F.least("liquidity", CAPITAL * scoring.position_cap(c("strategy"))))
    return s.select("market_id", "strategy", "size", r(F.greatest(F.lit(0.0), c("yes") - 0.02 * CAPITAL * c("yes") / c("size"))).alias("stop"))


@query("mm_alert_sizing", """select market, round_even(best_bid + spread * 0.3, 6) as bid, round_even(best_ask - spread * 0.3, 6) as ask, round_even(((best_ask - spread * 0.3) - (best_bid + spread * 0.3)) / mid, 6) as profit, least(0.1 * min_depth, 1000) as size from top""", "top")
def mm_alert_sizing(spark, sf):
    """Quotes three tenths inside the spread, what they earn, and a tenth of the depth up to 1000."""
    t = orderbook.tops(books(spark, sf))
    bid, ask = c("best_bid") + c("spread") * 0.3, c("best_ask") - c("spread") * 0.3
    return t.select("market", r(bid).alias("bid"), r(ask).alias("ask"), r((ask - bid) / c("mid")).alias("profit"), F.least(0.1 * c("min_depth"), F.lit(1000.0)).alias("size"))


@query("interpretation", """select wallet, concat_ws('; ',
 case when changes >= 5 then 'very active' when changes >= 3 then 'active' when changes >= 1 then 'a few changes' else 'no changes' end,
 case when top5 >= 0.7 then 'highly concentrated' when top5 >= 0.5 then 'concentrating' else 'spread out' end,
 case when pnl > 10000 then 'in profit' when pnl > 0 then 'small profit' when pnl < -10000 then 'large loss' when pnl < 0 then 'small loss' else 'break-even' end,
 case when top5 >= 0.6 and changes >= 3 then 'follow closely' when top5 >= 0.5 then 'watch for convergence' else 'wait for a clear strategy' end) as text from whale""", "whale")
def interpretation(spark, sf):
    """Four clauses on a trader: activity, concentration, profit, advice."""
    w = whales(spark, sf)
    profit = F.when(c("pnl") > 10000, "in profit").when(c("pnl") > 0, "small profit").when(c("pnl") < -10000, "large loss").when(c("pnl") < 0, "small loss").otherwise("break-even")
    advice = F.when((c("top5") >= 0.6) & (c("changes") >= 3), "follow closely").when(c("top5") >= 0.5, "watch for convergence").otherwise("wait for a clear strategy")
    return w.select("wallet", F.concat_ws("; ", bands(c("changes"), [(5, "very active"), (3, "active"), (1, "a few changes")], "no changes"), bands(c("top5"), [(0.7, "highly concentrated"), (0.5, "concentrating")], "spread out"), profit, advice).alias("text"))


_MONEY = "format('{:,}', abs(cast(round_even(pnl, 0) as bigint)))"


@query("interpretation_text", f"""select wallet, concat_ws(', ',
 case when changes >= 5 then 'very active of late, ' || changes || ' changes in 24 hours' when changes >= 3 then 'fairly active of late, ' || changes || ' changes in 24 hours' when changes >= 1 then 'a few changes of late, ' || changes || ' in 24 hours' else 'no changes of late' end,
 case when top5 >= 0.7 then 'holdings highly concentrated, strategy very clear' when top5 >= 0.5 then 'holdings concentrating, strategy getting clear' else 'holdings spread out, strategy unclear' end,
 case when pnl > 10000 then 'total profit +$' || {_MONEY} || ', in profit' when pnl > 0 then 'total profit +$' || {_MONEY} || ', a small one' when pnl < -10000 then 'total loss -$' || {_MONEY} || ', a large one' when pnl < 0 then 'total loss -$' || {_MONEY} || ', a small one' else 'break-even' end) || '. ' ||
 case when top5 >= 0.6 and changes >= 3 then 'Follow what it does next: it may show where the market leans' when top5 >= 0.5 then 'Watch whether it converges further' else 'Wait until its strategy is clear' end as text from whale""", "whale")
def interpretation_text(spark, sf):
    """The four clauses with their figures: changes of 24 hours, concentration, profit as an amount, advice."""
    w = whales(spark, sf)
    n, top5, pnl = c("changes"), c("top5"), c("pnl")
    money = F.format_number(F.abs(F.bround(pnl, 0)), 0)
    active = F.when(n >= 5, F.concat(F.lit("very active of late, "), n, F.lit(" changes in 24 hours"))).when(n >= 3, F.concat(F.lit("fairly active of late, "), n, F.lit(" changes in 24 hours"))).when(n >= 1, F.concat(F.lit("a few changes of late, "), n, F.lit(" in 24 hours"))).otherwise("no changes of late")
    held = bands(top5, [(0.7, "holdings highly concentrated, strategy very clear"), (0.5, "holdings concentrating, strategy getting clear")], "holdings spread out, strategy unclear")
    sized = lambda start, end: F.concat(F.lit(start), money, F.lit(end))
    profit = F.when(pnl > 10000, sized("total profit +$", ", in profit")).when(pnl > 0, sized("total profit +$", ", a small one")).when(pnl < -10000, sized("total loss -$", ", a large one")).when(pnl < 0, sized("total loss -$", ", a small one")).otherwise("break-even")
    advice = F.when((top5 >= 0.6) & (n >= 3), "Follow what it does next: it may show where the market leans").when(top5 >= 0.5, "Watch whether it converges further").otherwise("Wait until its strategy is clear")
    return w.select("wallet", F.concat(F.concat_ws(", ", active, held, profit), F.lit(". "), advice).alias("text"))


#: Labels of kinds of alerts and of changes; others name themselves.
LABELS = {"whale": "Whale", "arbitrage": "Arbitrage", "system": "System", "new_watched": "Newly watched", "activity": "New activity", "new": "New position", "increased": "Increased", "decreased": "Decreased", "closed": "Closed"}
_KIND = "case market when 'purchase' then 'new' when 'error' then 'closed' when 'click' then 'activity' else market end"


@query("alert_labels", f"select event_id as id, case {_KIND} when 'new' then 'New position' when 'closed' then 'Closed' when 'activity' then 'New activity' else market end as label from trade", "trade")
def alert_labels(spark, sf):
    """The label of each alert's kind."""
    kind = F.when(c("market") == "purchase", "new").when(c("market") == "error", "closed").when(c("market") == "click", "activity").otherwise(c("market"))
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return trades(spark, sf).select(c("event_id").alias("id"), F.coalesce(F.try_element_at(labels, kind), kind).alias("label"))
