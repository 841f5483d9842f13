"""Scores, sizes and reviews over wallets and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded as r
from ..operators import scoring as s
from ..operators.arbitrage import pair_costs
from ..sources.market_tables import quotes, reports, whales
from .registry import query

c = F.col


@query("kelly", "with k as (select wallet, win_rate as p, abs(pnl) / value * 10 as b from whale) select wallet, round_even(case when p > 0 and p < 1 and b > 0 then greatest(0, least(1, (b * p - (1 - p)) / b)) else 0 end, 6) as kelly, round_even(case when p > 0 and p < 1 and b > 0 then greatest(0, least(1, (b * p - (1 - p)) / b)) else 0 end * 0.25, 6) as quarter from k", "whale")
def kelly(spark, sf):
    k = s.kelly(c("win_rate"), F.abs("pnl") / c("value") * 10)
    return whales(spark, sf).select("wallet", r(k).alias("kelly"), r(k * 0.25).alias("quarter"))


@query("kelly_position", "with k as (select wallet, case when user_id % 10 = 0 then 0 else 50.0::double end as loss, greatest(0, least(1, (2 * win_rate - (1 - win_rate)) / 2)) as f, win_rate as p from whale), g as (select *, case when loss > 0 then case when p > 0 and p < 1 then f else 0 end end as kelly from k) select wallet, round_even(kelly, 6) as kelly, round_even(10000 * kelly * 0.25, 4) as size, round_even(10000 * kelly * 0.25 * loss / 100, 4) as risk from g", "whale")
def kelly_position(spark, sf):
    out = s.position_size(F.lit(10_000.0), c("win_rate"), F.lit(100.0), F.when(c("user_id") % 10 == 0, 0.0).otherwise(50.0))
    return whales(spark, sf).select("wallet", r(out["kelly"]).alias("kelly"), r(out["size"], 4).alias("size"), r(out["risk"], 4).alias("risk"))


@query("kelly_assess", """with a as (select market_id, 0.6 * (1 - no::double) as p, (1 - (yes + no))::double * 20 / greatest(no::double, 0.01) as b from quote where yes + no < 0.99),
f as (select market_id, case when p > 0 and p < 1 and b > 0 then greatest(0, least(1, (b * p - (1 - p)) / b)) else 0 end as fraction from a)
select market_id, round_even(fraction, 6) as fraction, case when fraction > 0.1 then 'GOOD' when fraction > 0 then 'MARGINAL' else 'AVOID' end as verdict from f""", "quote")
def kelly_assess(spark, sf):
    q = pair_costs(quotes(spark, sf)).where("pair_cost < 0.99")
    fraction, verdict = s.assessment(c("margin").cast("double") * 20, c("no").cast("double"), F.lit(0.6))
    return q.select("market_id", r(fraction).alias("fraction"), verdict.alias("verdict"))


@query("signal_strength", "select wallet, case when changes >= 5 then 'strong' when changes >= 3 then 'medium' when changes >= 1 then 'weak' else 'none' end as strength from whale", "whale")
def signal_strength(spark, sf):
    return whales(spark, sf).select("wallet", s.signal_strength(c("changes")).alias("strength"))


@query("match_quality", "select wallet, case when top5 >= 0.7 then 'high' when top5 >= 0.5 then 'medium' else 'low' end as quality, round_even(top5 - 0.04, 6) as net from whale", "whale")
def match_quality(spark, sf):
    return whales(spark, sf).select("wallet", s.match_quality(c("top5")).alias("quality"), r(c("top5") - 0.04).alias("net"))


@query("concentration_band", "select wallet, case when top5 >= 0.7 then 'extreme' when top5 >= 0.5 then 'high' when top5 >= 0.3 then 'medium' else 'spread' end as band, case when top5 >= 0.7 then 95 when top5 >= 0.5 then 85 when top5 >= 0.3 then 70 else 50 end as points from whale", "whale")
def concentration_band(spark, sf):
    return whales(spark, sf).select("wallet", s.concentration_label(c("top5")).alias("band"), s.concentration_score(c("top5")).alias("points"))


@query("pnl_status", "select wallet, round_even(case when value > 0 then pnl / value * 100 else 0 end, 2) as pnl_pct, pnl > 0 as is_profit, pnl < 0 as is_loss from whale", "whale")
def pnl_status(spark, sf):
    return whales(spark, sf).select("wallet", r(F.when(c("value") > 0, c("pnl") / c("value") * 100).otherwise(0.0), 2).alias("pnl_pct"), (c("pnl") > 0).alias("is_profit"), (c("pnl") < 0).alias("is_loss"))


@query("recommendation", "select wallet, case when top5 >= 0.6 and changes >= 3 and pnl > 0 then 'follow' when top5 >= 0.6 and changes >= 3 then 'cautious_follow' when top5 >= 0.5 then 'observe' else 'ignore' end as advice from whale", "whale")
def recommendation(spark, sf):
    return whales(spark, sf).select("wallet", s.recommendation(c("top5"), c("changes"), c("pnl")).alias("advice"))


@query("risk_flags", """with f as (select wallet, concat_ws('; ', case when top5 >= 0.9 then 'concentration 90%' end, case when top5 >= 0.8 and top5 < 0.9 then 'concentration 80%' end, case when value > 0 and pnl * 4 / value < -0.2 then 'loss beyond 20%' end, case when positions > 100 then 'over 100 positions' end) as w from whale)
select wallet, case when w = '' then 'none' else w end as warnings from f""", "whale")
def risk_flags(spark, sf):
    return whales(spark, sf).select("wallet", s.warnings(c("top5"), c("pnl") * 4, c("value"), c("positions")).alias("warnings"))


@query("scorecard", """with d as (select *, case when value >= 500000 then 100 when value >= 200000 then 90 when value >= 100000 then 80 when value >= 50000 then 70 when value >= 10000 then 60 else 40 end as fund,
 case when changes >= 10 then 100 when changes >= 5 then 90 when changes >= 3 then 80 when changes >= 1 then 60 else 30 end as activity, case when top5 >= 0.7 then 95 when top5 >= 0.5 then 85 when top5 >= 0.3 then 70 else 50 end as conc_points,
 case when value <= 0 then 50 when pnl / value >= 0.1 then 95 when pnl / value >= 0.05 then 85 when pnl / value >= 0 then 75 when pnl / value >= -0.05 then 60 when pnl / value >= -0.1 then 45 else 30 end as profit from whale)
select wallet, fund, activity, conc_points, profit, cast(round_even((40 * fund + 25 * activity + 20 * conc_points + 15 * profit) / 100, 0) as bigint) as composite,
 cast(round_even(case when top5 between 0.4 and 0.8 then 30 when top5 > 0.8 then 20 else top5 * 50 end + case when profit >= 75 then 25 else profit * 0.25::double end + case when changes between 1 and 5 then 25 when changes > 5 then 15 else changes * 5 end
 + case when value between 50000 and 500000 then 20 when value > 500000 then 15 else value / 50000 * 20 end, 0) as bigint) as copy from d""", "whale")
def scorecard(spark, sf):
    w = whales(spark, sf).select("*", s.fund_score(c("value")).alias("fund"), s.activity_score(c("changes")).alias("activity"), s.concentration_score(c("top5")).alias("conc_points"), s.profit_score(c("pnl"), c("value")).alias("profit"))
    return w.select("wallet", "fund", "activity", "conc_points", "profit", s.composite(c("fund"), c("activity"), c("conc_points"), c("profit")).alias("composite"), s.copy_score(c("top5"), c("profit"), c("changes"), c("value")).alias("copy"))


@query("client_rank", """with f as (select * from whale order by value desc, wallet limit 50),
x as (select wallet, cast(floor(round_even(least(value / 100000, 1) * 40 + least(changes / 5, 1) * 25 + case when top5 between 0.5 and 0.7 then 20 when top5 > 0.7 then 15 else top5 * 40 end + greatest(-15, least(15, pnl / value * 100)) + 15, 8) + 0.5) as bigint) as composite,
cast(floor(round_even(case when top5 between 0.4 and 0.8 then 30 when top5 > 0.8 then 20 else top5 * 50 end + case when pnl > 0 then 25 else 0 end + case when changes between 1 and 5 then 25 when changes > 5 then 15 else changes * 5 end + case when value between 50000 and 500000 then 20 when value > 500000 then 15 else value / 50000 * 20 end, 8) + 0.5) as bigint) as copy from f)
select * from x order by composite desc, wallet limit 10""", "whale")
def client_rank(spark, sf):
    """The first 50 by value, scored anew as a client would, the best ten."""
    w = whales(spark, sf).orderBy(F.desc("value"), "wallet").limit(50)
    x = w.select("wallet", s.client_composite(c("value"), c("changes"), c("top5"), c("pnl")).alias("composite"), s.client_copy(c("top5"), c("pnl"), c("changes"), c("value")).alias("copy"))
    return x.orderBy(F.desc("composite"), "wallet").limit(10)


@query("risk_pair", """with o as (select market_id, round_even(cast(1 - (yes + no) as double) * 100, 4) as pct, liquidity, volume, cast(yes + no as double) as cost, cast(epoch(end_date) / 86400 as bigint) % 120 - 5 as days from quote where yes + no < 1.0),
p as (select market_id, (case when pct < 1 then 3 when pct < 2 then 1 else 0 end + case when liquidity < 5000 then 2 when liquidity < 10000 then 1 else 0 end + case when days > 90 then 2 when days < 1 then 3 else 0 end + case when volume < 10000 then 1 else 0 end + case when cost > 0.995 then 2 else 0 end) / 10 as score from o)
select market_id, score, case when score < 0.3 then 'low' when score < 0.6 then 'medium' else 'high' end as level, score < 0.5 as approved from p""", "quote")
def risk_pair(spark, sf):
    q = pair_costs(quotes(spark, sf), threshold=1.0).where("pair_cost < 1")
    days = F.floor(F.unix_timestamp("end_date") / 86400) % 120 - 5
    score, _ = s.review_pair(r(c("margin").cast("double") * 100, 4), c("liquidity"), days, c("volume"), c("pair_cost").cast("double"))
    q = q.withColumn("score", score)
    return q.select("market_id", "score", s.level(c("score")).alias("level"), (c("score") < 0.5).alias("approved"))


@query("risk_cross", """with p as (select wallet, (case when top5 < 0.5 then 5 when top5 < 0.7 then 2 else 0 end + case when win_rate / 3 < 0.18 then 2 else 0 end + case when win_rate / 3 > 0.22 then 2 else 0 end + case when value < 10000 then 2 else 0 end) / 10 as score from whale)
select wallet, score, case when score < 0.3 then 'low' when score < 0.6 then 'medium' else 'high' end as level, score < 0.5 as approved from p""".replace("win_rate / 3 < 0.18", "win_rate - 0.5 < 0.05").replace("win_rate / 3 > 0.22", "win_rate - 0.5 > 0.2"), "whale")
def risk_cross(spark, sf):
    score, _ = s.review_cross(c("top5"), c("win_rate") - 0.5, c("value"))
    return whales(spark, sf).withColumn("score", score).select("wallet", "score", s.level(c("score")).alias("level"), (c("score") < 0.5).alias("approved"))


@query("risk_whale", """with n as (select *, least(changes, user_id % 4) as fresh, positions > 80 and value < 50000 as odd from whale),
p as (select wallet, case when odd then 1 else greatest(0, least(1, (case when volume < 3000 then 2 when volume < 8000 then 0.5 else 0 end + case when value < 10000 then 2 when value < 50000 then 0.5 else 0 end + case when positions > 50 then 1 else 0 end
 + case when win_rate > 0 and win_rate < 0.55 then 2 when win_rate >= 0.6 then -1 else 0 end + case when changes = 0 then 3 when fresh / changes > 0.8 and changes / positions > 0.8 then 0.5 when fresh / changes > 0.5 then 1.5 when changes > 15 then 1 else 0 end)::double / 10)) end as score from n)
select wallet, cast(score as double) as score, case when score < 0.25 then 'low' when score < 0.5 then 'medium' else 'high' end as level, score < 0.5 as approved from p""", "whale")
def risk_whale(spark, sf):
    fresh, odd = F.least(c("changes"), c("user_id") % 4), (c("positions") > 80) & (c("value") < 50_000)
    score = s.review_whale(c("volume"), c("changes"), fresh, c("value"), c("positions"), c("win_rate"), odd)
    return whales(spark, sf).withColumn("score", score).select("wallet", "score", s.level(c("score"), 0.25, 0.5).alias("level"), (c("score") < 0.5).alias("approved"))


@query("watch_summary", """with e as (select *, case user_id % 3 when 0 then 'converging' when 1 then 'diverging' else '' end as trend from whale where value >= 100000)
select wallet, value, case when trend = 'converging' then 'converging' when trend = 'diverging' then 'diverging' when positions > 50 then 'diversified' when changes >= 5 then 'active' else 'stable' end as strategy,
 count(*) over () as n, round_even(sum(value) over (), 2) as total from e order by value desc, wallet limit 5""", "whale")
def watch_summary(spark, sf):
    k = c("user_id") % 3
    w = whales(spark, sf).where("value >= 100000").withColumn("trend", F.when(k == 0, "converging").when(k == 1, "diverging").otherwise(""))
    total = w.agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))
    top = w.orderBy(F.desc("value"), "wallet").limit(5).select("wallet", "value", s.strategy(c("trend"), c("positions"), c("changes")).alias("strategy"))
    return top.crossJoin(total)  # one row of totals


@query("report_totals", "select epoch_us(scan_time) as at, pair_count + cross_count + mm_count as total, pair_count + cross_count as approved, whale_count, case when pair_count >= 5 then 'rich' when pair_count >= 1 then 'some' else 'none' end as status from report", "report")
def report_totals(spark, sf):
    from ..functions.columns import bands, epoch_us

    return reports(spark, sf).select(epoch_us(c("scan_time")).alias("at"), (c("pair_count") + c("cross_count") + c("mm_count")).alias("total"), (c("pair_count") + c("cross_count")).alias("approved"), "whale_count", bands(c("pair_count"), [(5, "rich"), (1, "some")], "none").alias("status"))


