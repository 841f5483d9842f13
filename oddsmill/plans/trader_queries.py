"""Wallets: roll-ups, positions, concentration, rankings, and the readers behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.columns import epoch_us, table
from ..functions.columns import rounded as r
from ..operators import traders as ops
from ..sources.market_tables import concentration_of, holdings, snapshots, trades, whales
from ..sources.sinks import unwatched, upserted
from .registry import query


def now():
    return F.lit(AS_OF).cast("timestamp")
ROLL = """with w as (select wallet, round_even(sum(volume), 4) as total_volume, count(*) as trade_count, count(*) filter (volume >= 200) as large_trades, count(distinct market) as markets,
  epoch_us(max(ts)) as last_trade, arg_max(market, (ts, -event_id)) as last_market from trade group by wallet)
"""


@query("active_whales", ROLL + "select * from w where total_volume >= 3500 or large_trades >= 3 order by total_volume desc, wallet limit 20", "trade")
def active_whales(spark, sf):
    w = ops.roll_up(trades(spark, sf), large=200).withColumn("total_volume", r(F.col("total_volume"), 4)).withColumn("last_trade", epoch_us(F.col("last_trade")))
    return ops.active(w, volume=3500)


@query("wallet_roll_up", ROLL + "select * from w", "trade")
def wallet_roll_up(spark, sf):
    return ops.roll_up(trades(spark, sf), large=200).withColumn("total_volume", r(F.col("total_volume"), 4)).withColumn("last_trade", epoch_us(F.col("last_trade")))


@query("leaderboard_filter", "select c_custkey as wallet, c_acctbal * 10 as profit, (c_custkey % 100) / 100.0::double as win_rate, c_custkey % 300 as trades from customer where c_acctbal * 10 >= 50000 and (c_custkey % 100) / 100.0::double >= 0.6 and c_custkey % 300 >= 100")
def leaderboard_filter(spark, sf):
    k = F.col("c_custkey")
    b = table(spark, sf, "customer").select(k.alias("wallet"), (F.col("c_acctbal") * 10).alias("profit"), ((k % 100) / 100.0).alias("win_rate"), (k % 300).alias("trades"))
    return b.where("profit >= 50000 and win_rate >= 0.6 and trades >= 100")


@query("position_value", "select wallet, round_even(sum(value), 4) as total_value, count(*) as positions from holding group by wallet", "holding")
def position_value(spark, sf):
    return holdings(spark, sf).groupBy("wallet").agg(r(F.sum("value"), 4).alias("total_value"), F.count("*").alias("positions"))


@query("concentration", "select * from conc", "conc")
def concentration(spark, sf):
    return concentration_of(holdings(spark, sf).select("wallet", "market", "week", "value"))


@query("top_positions", "with x as (select wallet, market, epoch_us(week) as week, round_even(value, 4) as value, row_number() over (partition by wallet order by value desc, market, week) as rank from holding) select * from x where rank <= 3", "holding")
def top_positions(spark, sf):
    t = ops.top_per(holdings(spark, sf), "wallet", [F.desc("value"), F.col("market"), F.col("week")], 3)
    return t.select("wallet", "market", epoch_us(F.col("week")).alias("week"), r(F.col("value"), 4).alias("value"), F.col("rank").cast("long").alias("rank"))


CHANGES = """with j as (select coalesce(b.wallet, n.wallet) as wallet, coalesce(b.market, n.market) as market, b.size as old_size, n.size as new_size,
  round_even(coalesce(n.size, 0) - coalesce(b.size, 0), 2) as change from before_ b full join now_ n on b.wallet = n.wallet and b.market = n.market),
c as (select *, case when old_size is null then 'new' when new_size is null then 'closed' when change > 0.01 then 'increased' when change < -0.01 then 'decreased' end as type from j)
"""


@query("position_changes", CHANGES + "select wallet, market, old_size, new_size, change, type from c where type is not null", "snap")
def position_changes(spark, sf):
    return ops.position_changes(*snapshots(spark, sf), keys=["wallet", "market"])


@query("position_changes_v1", CHANGES + "select wallet, market, case type when 'new' then 'new_position' when 'closed' then 'closed' else 'size_change' end as type from c where type is not null", "snap")
def position_changes_v1(spark, sf):
    return ops.position_changes(*snapshots(spark, sf), keys=["wallet", "market"]).select("wallet", "market", ops.coarse(F.col("type")).alias("type"))


@query("trader_activity", CHANGES + """, n as (select wallet, count(*) as changes from c where type is not null group by wallet), t as (select wallet, least(count(*), 20) as recent_trades from trade where ts >= '2024-01-08' and ts < '2024-01-15' group by wallet)
select coalesce(n.wallet, t.wallet) as wallet, coalesce(changes, 0) as changes, coalesce(recent_trades, 0) as recent_trades, coalesce(changes, 0) > 0 or coalesce(recent_trades, 0) > 0 as has_activity from n full join t on t.wallet = n.wallet""", "snap")
def trader_activity(spark, sf):
    """The older analysis: a trader is active by changes between two snapshots or by trades in the later one's week."""
    week = trades(spark, sf).where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    return ops.activity(ops.position_changes(*snapshots(spark, sf), keys=["wallet", "market"]), week)


@query("wallet_records", """select w.wallet, (select string_agg(market || '=' || v, ',' order by v desc, market) from (select market, cast(round_even(sum(volume) * 100, 0) as bigint) as v from trade t where t.wallet = w.wallet group by market)) as positions,
 (select string_agg(event_id, ',' order by ts desc, event_id desc) from (select event_id, ts from trade t where t.wallet = w.wallet order by ts desc, event_id desc limit 20)) as trades, pnl from whale w where user_id % 10 < 3""", "whale")
def wallet_records(spark, sf):
    """Look-ups of wallets: positions by value in cents, the latest 20 trades, profit."""
    w, t = whales(spark, sf), trades(spark, sf)
    held = t.groupBy("wallet", "market").agg(r(F.sum("volume") * 100, 0).alias("value"))
    found = ops.records_of(w.where("user_id % 10 < 3"), held, t.select("wallet", F.col("event_id").alias("id"), "ts"), w)
    word = F.array_join(F.transform("positions", lambda p: F.concat_ws("=", p["market"], p["value"].cast("long").cast("string"))), ",")
    return found.select("wallet", word.alias("positions"), F.array_join(F.transform("trades", lambda i: i.cast("string")), ",").alias("trades"), "pnl")


@query("suspicious", "select wallet, positions, value, positions > 50 and value < 1000 * 5 as is_suspicious, changes > 0 and not (positions > 50 and value < 5000) as has_activity from whale", "whale")
def suspicious(spark, sf):
    w = whales(spark, sf)
    s = ops.suspicious(F.col("positions"), F.col("value") / 5)
    return w.select("wallet", "positions", "value", s.alias("is_suspicious"), ((F.col("changes") > 0) & ~s).alias("has_activity"))


@query("top_whales", "select row_number() over (order by value desc, wallet) as rank, wallet, value, value >= 100000 as is_watched from whale where not (positions > 50 and value < 5000) order by value desc, wallet limit 10", "whale")
def top_whales(spark, sf):
    w = whales(spark, sf).where(~ops.suspicious(F.col("positions"), F.col("value") / 5))
    ten = w.orderBy(F.desc("value"), "wallet").limit(10)
    ranked = ten.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "wallet")).cast("long"))  # ten rows
    return ranked.select("rank", "wallet", "value", (F.col("value") >= 100_000).alias("is_watched"))


@query("watch_eligibility", "select wallet, not (positions = 0 or value < 1000) and (value >= 100000 or (changes >= 5 and value >= 50000)) as eligible from whale", "whale")
def watch_eligibility(spark, sf):
    return whales(spark, sf).select("wallet", ops.watchable(F.col("value"), F.col("changes"), F.col("positions")).alias("eligible"))


@query("watched_flag", "select wallet, wallet in (select wallet from trade where market = 'purchase' and volume >= 200) as is_watched from whale", "whale")
def watched_flag(spark, sf):
    watched = trades(spark, sf).where("market = 'purchase' and volume >= 200").select("wallet").distinct().withColumn("is_watched", F.lit(True))
    return whales(spark, sf).select("wallet").join(watched, "wallet", "left").select("wallet", F.coalesce("is_watched", F.lit(False)).alias("is_watched"))


@query("unwatch", "select wallet, user_id % 2 = 0 and changes > 0 as is_watched from whale", "whale")
def unwatch(spark, sf):
    w = whales(spark, sf).withColumn("is_watched", F.col("user_id") % 2 == 0)
    return unwatched(w.select("wallet", "is_watched"), w.where("changes > 0"))


@query("whale_sync", "select wallet, case when changes > 1 then value else 0 end as value, case when changes > 1 then case when user_id % 2 = 0 then 'stable' else '' end end as trend from whale", "whale")
def whale_sync(spark, sf):
    w = whales(spark, sf)
    old = w.select("wallet", F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("trend"))
    trend = w.where("user_id % 2 = 0").select("wallet", F.lit("stable").alias("t"))
    new = w.where("changes > 1").join(trend, "wallet", "left").select("wallet", "value", F.coalesce("t", F.lit("")).alias("trend"))
    return upserted(old, new, ["wallet"])


@query("whale_list", "select w.wallet, value, pnl, top5, changes as changes_24h from whale w where value >= 10000 order by value desc, wallet limit 50", "whale")
def whale_list(spark, sf, sort: str = "value", descending: bool = True, limit: int = 50):
    """The list route: a whitelisted sort column, a direction and a limit; changes of 24 hours by one grouped join."""
    if sort not in ("value", "pnl", "top5", "changes_24h", "positions", "wallet"):
        raise ValueError(f"can't sort by {sort}")
    w = whales(spark, sf)
    recent = trades(spark, sf).where(F.col("ts") >= now() - F.expr("INTERVAL 1 DAY")).groupBy("wallet").agg(F.count("*").alias("n"))
    rows = w.drop("changes").join(recent, "wallet", "left").withColumn("changes_24h", F.coalesce("n", F.lit(0)).cast("long")).where("value >= 10000")
    return rows.orderBy(F.desc(sort) if descending else F.asc(sort), "wallet").limit(limit).select("wallet", "value", "pnl", "top5", "changes_24h")


@query("whale_detail", """with p as (select wallet, list(row(market, v) order by v desc, market)::varchar as x, count(*) as n from (select wallet, market, round_even(sum(volume), 2) as v from trade group by all) group by wallet)
select wallet, n as n_positions, (select string_agg(market || '=' || v, ',' order by v desc, market) from (select market, cast(cast(round_even(sum(volume), 2) * 100 + 0.5 as bigint) as varchar) as vv, cast(round_even(sum(volume) * 100, 0) as bigint) as v from trade t where t.wallet = p.wallet group by market)) as positions,
 (select string_agg(event_id, ',' order by ts desc, event_id desc) from (select event_id, ts from trade t where t.wallet = p.wallet order by ts desc, event_id desc limit 20)) as last_changes from p""", "trade")
def whale_detail(spark, sf):
    """The detail route: positions by value and the latest 20 changes, nested per wallet by grouped joins."""
    t = trades(spark, sf)
    cents = r(F.sum("volume") * 100, 0).cast("long")
    p = t.groupBy("wallet", "market").agg(cents.alias("v")).groupBy("wallet").agg(F.count("*").alias("n_positions"), F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("o"), "market", "v"))).alias("x"))
    last = ops.top_per(t, "wallet", [F.desc("ts"), F.desc("event_id")], 20).groupBy("wallet").agg(F.sort_array(F.collect_list(F.struct("rank", "event_id"))).alias("c"))
    word = F.array_join(F.transform("x", lambda s: F.concat_ws("=", s["market"], s["v"].cast("string"))), ",")
    return p.join(last, "wallet").select("wallet", "n_positions", word.alias("positions"), F.array_join(F.transform("c", lambda s: s["event_id"].cast("string")), ",").alias("last_changes"))


@query("recent_changes", f"select event_id, wallet, market from trade where ts > timestamp '{AS_OF}' - interval 1 day", "trade")
def recent_changes(spark, sf):
    return trades(spark, sf).where(F.col("ts") > now() - F.expr("INTERVAL 1 DAY")).select("event_id", "wallet", "market")


@query("whale_lookup", "select wallet, value, pnl, positions from whale where lower(wallet) = 'w7'", "whale")
def whale_lookup(spark, sf, wallet: str = "W7"):
    return whales(spark, sf).where(F.lower("wallet") == wallet.lower()).select("wallet", "value", "pnl", "positions")


@query("cache_lookup", f"select w.wallet, w.value from whale w join (select wallet, max(ts) as made from trade group by wallet) c on c.wallet = w.wallet where c.made + interval 24 hour > timestamp '{AS_OF}' and w.user_id % 3 = 0", "whale")
def cache_lookup(spark, sf):
    """Cached results whose hash still agrees and whose day isn't over."""
    w = whales(spark, sf).withColumn("hash", F.substring(F.md5(F.concat_ws("|", "wallet", F.col("user_id").cast("string"))), 1, 16))
    cached = trades(spark, sf).groupBy("wallet", "user_id").agg(F.max("ts").alias("made")).select("wallet", F.substring(F.md5(F.concat_ws("|", "wallet", F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).otherwise("stale"))), 1, 16).alias("hash"), (F.col("made") + F.expr("INTERVAL 24 HOURS")).alias("expires"))
    return w.join(cached, ["wallet", "hash"]).where(F.col("expires") > now()).select("wallet", "value")


@query("alias_default", "select wallet, substr(wallet || '0000000000', 1, 6) || '...' || right(wallet || '0000000000', 4) as alias from whale", "whale")
def alias_default(spark, sf):
    full = F.concat(F.col("wallet"), F.lit("0000000000"))
    return whales(spark, sf).select("wallet", F.concat(F.substring(full, 1, 6), F.lit("..."), F.substring(full, -4, 4)).alias("alias"))


@query("data_hash", "select wallet, substr(md5(wallet || '|' || positions || '|' || changes), 1, 16) as data_hash from whale", "whale")
def data_hash(spark, sf):
    return whales(spark, sf).select("wallet", F.substring(F.md5(F.concat_ws("|", "wallet", F.col("positions").cast("string"), F.col("changes").cast("string"))), 1, 16).alias("data_hash"))


@query("watched_and_active", "select wallet from trade where market = 'purchase' and volume >= 150 intersect select wallet from trade where market = 'error' and volume >= 150", "trade")
def watched_and_active(spark, sf):
    t = trades(spark, sf).where("volume >= 150")
    return t.where("market = 'purchase'").select("wallet").intersect(t.where("market = 'error'").select("wallet"))


@query("new_wallet_markets", "select wallet, market from now_ except select wallet, market from before_", "snap")
def new_wallet_markets(spark, sf):
    before, now = snapshots(spark, sf)
    return now.select("wallet", "market").exceptAll(before.select("wallet", "market"))


@query("dash_summary", f"""select (select count(*) from whale where value >= 50000) as watched, (select round_even(sum(value), 2) from whale where value >= 50000) as total_value,
(select count(distinct wallet) from trade where ts > timestamp '{AS_OF}' - interval 3 hour) as updated, (select count(*) from trade where event_id % 2 = 1 and volume >= 200) as unread""", "whale")
def dash_summary(spark, sf):
    w = whales(spark, sf).where("value >= 50000").agg(F.count("*").alias("watched"), r(F.sum("value"), 2).alias("total_value"))
    t = trades(spark, sf).agg(F.count_distinct(F.when(F.col("ts") > now() - F.expr("INTERVAL 3 HOURS"), F.col("wallet"))).alias("updated"), F.count_if((F.col("event_id") % 2 == 1) & (F.col("volume") >= 200)).alias("unread"))
    return w.crossJoin(t)  # one row each
